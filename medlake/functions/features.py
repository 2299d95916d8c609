"""Scalar feature functions (P1-P13): built-in column expressions only, so
they stay inside whole-stage codegen.  Each takes column names or Columns
and returns a Column; NULL in gives NULL out unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_from_birth_year(birth_year, as_of_year: int) -> Column:
    """Calendar-year difference (birthday ignored); the clock is a parameter."""
    return (F.lit(as_of_year) - _c(birth_year)).cast("int")


def bmi(weight_kg, height_m) -> Column:
    """Weight / height^2; NULL for a zero height (no ANSI error)."""
    h = _c(height_m)
    return F.try_divide(_c(weight_kg), h * h)


def metabolic_score(glucose="fasting_glucose", hdl="hdl_cholesterol", trig="triglycerides") -> Column:
    """0.5*glucose + 0.3*hdl - 0.2*triglycerides (signs as specified)."""
    return F.lit(0.5) * _c(glucose) + F.lit(0.3) * _c(hdl) - F.lit(0.2) * _c(trig)


# fixed values: smoking points
SMOKING_POINTS = {"never": 0, "former": 1, "current": 3}


def lifestyle_risk(smoking="smoking_status", exercise="exercise_frequency",
                   alcohol="alcohol_consumption", points: dict[str, int] | None = None) -> Column:
    """Smoking points + max(0, 4 - exercise) + min(alcohol, 10).

    Unmapped/NULL smoking -> NULL score.  ``greatest`` skips NULL the way
    Python's ``max(0, nan)`` gives 0; ``least`` would turn NULL into 10,
    so the alcohol term is guarded to stay NULL.
    """
    pts = points or SMOKING_POINTS
    m = F.create_map(*[x for k, v in pts.items() for x in (F.lit(k), F.lit(v))])
    smoke = m[_c(smoking)]
    ex = F.greatest(F.lit(0), F.lit(4) - _c(exercise))
    alc = F.when(_c(alcohol).isNull(), F.lit(None)).otherwise(F.least(_c(alcohol), F.lit(10)))
    return smoke + ex + alc


def pollution_index(pm25="pm2_5", no2="no2_level") -> Column:
    """P5: 0.7*pm2_5 + 0.3*no2."""
    return F.lit(0.7) * _c(pm25) + F.lit(0.3) * _c(no2)


def cumulative_exposure(index, years="years_in_location") -> Column:
    """P5: pollution index times years at the location."""
    return _c(index) * _c(years)


def pollution_exposure(pm25="pm2_5") -> Column:
    """log1p(pm2_5)."""
    return F.log1p(_c(pm25))


def categorize(p, thresholds: dict[str, float], default: str = "low") -> Column:
    """The first category (thresholds sorted high to low) with p >= t."""
    out = None
    for name, t in sorted(thresholds.items(), key=lambda kv: -kv[1]):
        cond = _c(p) >= F.lit(t)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def digitize(x, edges: Sequence[float]) -> Column:
    """Number of edges <= x (``np.digitize`` right=False); NULL -> NULL."""
    terms = [(_c(x) >= F.lit(float(e))).cast("int") for e in edges]
    if not terms:
        return F.when(_c(x).isNotNull(), F.lit(0))
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    return s


def generalize_ranges(x, ranges: Sequence[tuple[str, float, float]], other: str = "other") -> Column:
    """First ``(label, lo, hi)`` with lo <= x <= hi in the given order, else ``other``
    (NULL also lands in ``other``)."""
    out = None
    for label, lo, hi in ranges:
        cond = _c(x).between(F.lit(lo), F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def blood_pressure_parts(bp="blood_pressure") -> tuple[Column, Column]:
    """``"140/90"`` -> (systolic, diastolic) ints; malformed -> NULL."""
    s = F.split(_c(bp), "/")
    return (F.try_element_at(s, F.lit(1)).try_cast("int"),
            F.try_element_at(s, F.lit(2)).try_cast("int"))
