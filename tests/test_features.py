"""Scalar features on hand-computed fixture rows (FIXTURES A7 / A17)."""

import pytest
from pyspark.sql import functions as F

from medlake.functions import features as fx


def _row(spark):
    return spark.createDataFrame(
        [("P001", 1985, 85.5, 1.75, 110.0, 45.0, 150.0, "former", 2, 5.0)],
        "patient_id string, birth_year int, weight_kg double, height_m double, fasting_glucose double, "
        "hdl_cholesterol double, triglycerides double, smoking_status string, exercise_frequency int, "
        "alcohol_consumption double")


def test_hand_computed_a17(spark):
    r = _row(spark).select(fx.age_from_birth_year("birth_year", 2024).alias("age"),
                           fx.bmi("weight_kg", "height_m").alias("bmi"),
                           fx.metabolic_score().alias("ms"), fx.lifestyle_risk().alias("lr")).first()
    assert r["age"] == 39
    assert r["bmi"] == pytest.approx(27.918367, abs=1e-6)
    assert r["ms"] == pytest.approx(38.5)
    assert r["lr"] == pytest.approx(8.0)


def test_lifestyle_nulls(spark):
    df = spark.createDataFrame([("never", 6, None), ("unknown", 1, 3.0), ("current", None, 20.0)],
                               "smoking_status string, exercise_frequency int, alcohol_consumption double")
    got = [r[0] for r in df.select(fx.lifestyle_risk()).collect()]
    # NULL alcohol -> NULL (least() would have said 10); unmapped smoking -> NULL;
    # NULL exercise -> greatest() skips it -> 0 points
    assert got == [None, None, 13.0]


def test_bmi_zero_height(spark):
    df = spark.createDataFrame([(70.0, 0.0)], "w double, h double")
    assert df.select(fx.bmi("w", "h")).first()[0] is None


def test_categorize_and_bins(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.1,), (None,)], "p double")
    cats = [r[0] for r in df.select(fx.categorize("p", {"medium": 0.4, "high": 0.7})).collect()]
    assert cats == ["high", "medium", "medium", "low", "low"]
    bins = [r[0] for r in df.select(fx.digitize("p", [0.4, 0.7])).collect()]
    assert bins == [2, 1, 1, 0, None]


def test_generalize_inclusive_first_wins(spark):
    df = spark.createDataFrame([(18.5,), (25.0,), (99.0,), (None,)], "b double")
    g = [r[0] for r in df.select(fx.generalize_ranges("b", [("a", 0.0, 18.5), ("b", 18.5, 25.0)])).collect()]
    assert g == ["a", "b", "other", "other"]


def test_blood_pressure_parse(spark):
    df = spark.createDataFrame([("140/90",), ("abc",), (None,), ("120",)], "bp string")
    got = [(r[0], r[1]) for r in df.select(*fx.blood_pressure_parts("bp")).collect()]
    assert got == [(140, 90), (None, None), (None, None), (120, None)]
