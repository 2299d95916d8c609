"""Odd rows that every operator must take: nulls, empty and long texts, ties,
repeated rows, extra columns whose names clash with internal ones."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_rk", "_id", "_text", "_cls", "_n", "_ents", "_words", "_llm_rk", "_llm_types", "ids", "n_tokens", "round_trip",
         "score", "spans", "base", "kept", "h", "pii_types", "root", "u", "v", "c")


def long_text(words: int = 20000) -> str:
    return " ".join(f"w{i % 997}x{i}" for i in range(words))


def base_rows() -> list[tuple]:
    body = " ".join(f"alpha{i} beta{i}" for i in range(40))
    return [
        (1, body, "en", "src0", 10), (2, body, "en", "src1", 10), (3, body.upper(), "de", None, None),
        (4, None, "en", "src0", None), (5, "", None, "src0", 0), (6, " \n\t ", "fr", "src0", 4),
        (7, "one two three", "en", "src0", 13), (8, "one two three", "en", "src0", 13), (9, "one two", "en", "src0", 7),
        (None, "one two three", "en", "src0", 13), (None, None, None, None, None), (10, "", "en", "src0", 0),
        (11, long_text(), "en", "src0", 1), (12, long_text() + " tail", "en", "src0", 1),
        (7, "one two three", "en", "src0", 13), (13, "Ünïcödé ßtraße 中文 \U0001f600 é", "es", "src2", 5),
    ]


def docs(spark, rows=None, clash: bool = True):
    df = spark.createDataFrame(base_rows() if rows is None else rows, DOCS).repartition(3)
    if clash:
        df = df.withColumns({c: F.lit(f"x-{c}") for c in CLASH})
    return df


def key(row):
    """Sort key with nulls first."""
    return tuple((v is not None, str(v)) for v in row)
