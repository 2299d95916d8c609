"""Pipeline stages: fit, transform, save and load with a Spark ML model."""

import os
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from medlake.operators.stages import ExactImputer, PopulationScaler


def test_pipeline_roundtrip(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (None, 2.0, 1.0), (3.0, 4.0, 1.0), (5.0, 1.0, 0.0)],
                               "a double, b double, label double")
    pipe = Pipeline(stages=[ExactImputer(numericCols=["a", "b"]), PopulationScaler(numericCols=["a", "b"]),
                            VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                            LogisticRegression(maxIter=20)])
    m = pipe.fit(df)
    out = m.transform(df).select("a", "b", "probability").collect()
    assert all(r["a"] is not None and r["b"] is not None for r in out)
    path = os.path.join(tempfile.mkdtemp(prefix="medlake-pipe-"), "pm")
    m.write().overwrite().save(path)
    back = PipelineModel.load(path).transform(df).select("probability").collect()
    assert [r[0] for r in back] == [r["probability"] for r in out]
