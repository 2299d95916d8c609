"""Spark ML pipeline stages around the exact fits (U2 extension point).

``ExactImputer`` and ``PopulationScaler`` are ``Estimator``s whose fitted
models are plain projections; they persist with the pipeline
(``DefaultParamsWritable``), so a saved ``PipelineModel`` carries its
preprocessing -- the "package" of model + preprocessor + statistics.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.operators.prep import fit_median, fit_mode, fit_standard


class _Cols(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[])


class _Fitted(Params):
    fitted = Param(Params._dummy(), "fitted", "fitted values as JSON", TypeConverters.toString)


class ExactImputerModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Fills NULLs with the fitted median / mode (a projection)."""

    def __init__(self, fitted: str = "{}"):
        super().__init__()
        self._set(fitted=fitted)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = json.loads(self.getOrDefault(self.fitted))
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
                           if fills.get(c) is not None else F.col(f"`{c}`") for c in df.columns])


class ExactImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """I1/I2 as a pipeline stage: exact median (numeric) and mode (categorical)."""

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None):
        super().__init__()
        kw = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kw)

    def _fit(self, df: DataFrame) -> ExactImputerModel:
        med = fit_median(df, self.getOrDefault(self.numericCols))
        mode = fit_mode(df, self.getOrDefault(self.categoricalCols))
        return ExactImputerModel(json.dumps({**med, **mode}))


class PopulationScalerModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population std per column; constant columns -> 0."""

    def __init__(self, fitted: str = "{}"):
        super().__init__()
        self._set(fitted=fitted)

    def _transform(self, df: DataFrame) -> DataFrame:
        stats = json.loads(self.getOrDefault(self.fitted))
        out = []
        for c in df.columns:
            if c in stats:
                m, s = stats[c]
                out.append(((F.col(c) - F.lit(m)) / F.lit(s or 1.0)).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)


class PopulationScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """I4 as a pipeline stage (population std, centred -- unlike
    ``pyspark.ml.feature.StandardScaler``'s defaults)."""

    @keyword_only
    def __init__(self, numericCols=None):
        super().__init__()
        kw = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kw)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        return PopulationScalerModel(json.dumps(fit_standard(df, self.getOrDefault(self.numericCols))))
