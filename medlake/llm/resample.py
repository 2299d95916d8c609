"""Importance resampling of documents towards a target corpus.

1. *Weights.*  A feature is a run of consecutive words; its hash bucket has a
   count in the documents and one in the target, and the log of their smoothed
   ratio is the bucket's gain.  The gains are one array (``BUCKETS`` numbers), a
   constant of the plan; a document's weight is the mean of the gains its features
   point at.  A keyed uniform number of the id turns the weight into a score whose
   largest values are a weighted sample without replacement.
2. *Bracket.*  The cutoff of the wanted number of documents is a quantile of the
   scores.  One mergeable quantile sketch proposes brackets around it, narrow to
   wide; the rows above and inside a bracket are then counted exactly, and the next
   wider one is taken until the cutoff provably lies inside (the last one reaches
   from the least to the largest score).
3. *Cutoff.*  Only the bracket's rows are sorted to find where the draw ends.  Rows
   above it are all drawn; they are put in order for their ranks alone.

Sorting is distributed (``ranked``): range partitions of a few hundred thousand
rows, whose counts give each its first rank.

Results for odd input: a null or empty text has no features and weight 0, and no
document of fewer than ``least`` words is drawn; a null id is hashed as the empty
string and comes after all ids; repeated rows are drawn one by one and have ranks of
their own; without any target words all features keep a gain of the smoothed
ratio.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import landed

BUCKETS = 10_000
SEED = 2024
#: Share of the eligible documents that is drawn, in hundredths.
PERCENT = 10
LEAST_WORDS = 20
#: Half widths of the proposed brackets, as shares of the eligible documents.
LADDER = (0.002, 0.01, 0.05, 0.25, 1.0)
#: Relative accuracy of the sketch is one in so many.
SKETCH = 10_000
#: Rows a task sorts.
RUN = 250_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _features(words: str, shortest: int, longest: int) -> Column:
    """All runs of ``shortest`` to ``longest`` words of an array column."""
    def runs(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
    kinds = [F.col(words) if k == 1 else runs(k) for k in range(shortest, longest + 1)]
    return kinds[0] if len(kinds) == 1 else F.concat(*kinds)


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(feature, "UTF-8")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; partial sums hold ``buckets`` rows."""
    words = texts.select(words_of(F.col(text_col)).alias("w"))
    return (words.select(F.explode(_features("w", *runs)).alias("f")).select(_bucket(F.col("f"), buckets).alias("bucket"))
            .groupBy("bucket").agg(F.count("*").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text",
          runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): thousandths of the log of target share over corpus share."""
    have = bucket_counts(docs, text_col, runs, buckets).withColumnRenamed("n", "s")
    want = bucket_counts(target, target_text, runs, buckets).withColumnRenamed("n", "t")
    at = (docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
          .join(have, "bucket", "left").join(want, "bucket", "left").fillna(0))
    at = landed(at, "resample-counts")
    total = at.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    big_s, big_t = float(total["s"] + buckets), float(total["t"] + buckets)
    ratio = (F.col("t") + 1).cast("double") * F.lit(big_s) / ((F.col("s") + 1).cast("double") * F.lit(big_t))
    return at.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def scored(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    # `buckets` numbers, whatever the corpus; one text literal that the optimizer folds
    table = [r["gain"] for r in gain.orderBy("bucket").collect()]
    array = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    words = docs.select(F.col(id_col).cast("long").alias("id"), words_of(F.col(text_col)).alias("w"))
    feats = words.select("id", F.size("w").cast("long").alias("n_words"), _features("w", *runs).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, f: a + array[_bucket(f, buckets)])
    sums = feats.select("id", "n_words", F.size("f").cast("long").alias("n_features"), total.alias("total"))
    n = F.col("n_features")
    weight = F.when(n == 0, F.lit(0).cast("long")).otherwise(
        F.expr("(total - pmod(total, n_features)) div n_features"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return sums.select("id", "n_words", "n_features", weight.alias("weight"), noise.alias("noise")).select(
        "id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def ranked(rows: DataFrame, count: int, first: int) -> DataFrame:
    """``rank`` of each of ``count`` rows from ``first`` on, by falling score, rising
    id, then the row's own number; no task sorts more than about ``RUN`` rows."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc(), F.col("at").asc()]
    parts = max(1, -(-count // RUN))
    split = landed(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "resample-order")
    sizes = split.groupBy("part").agg(F.count("*").alias("n"))
    # one row a range partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (split.join(F.broadcast(offset), "part")
            .select(*rows.columns, (F.col("before") + place + (first - 1)).cast("long").alias("rank")))


def bracket(rows: DataFrame, wanted: int, count: int, ladder: tuple[float, ...] = LADDER) -> tuple[int, int, int, int]:
    """(low, high, rows above, rows inside): the first proposed bracket of scores
    that holds the ``wanted``-th largest of ``count`` rows, by exact counts."""
    centre = 1.0 - wanted / count
    places = [min(1.0, max(0.0, centre + s * e)) for e in ladder for s in (-1, 1)]
    sketch = rows.agg(F.percentile_approx("score", places, SKETCH).alias("q"), F.min("score").alias("lo"),
                      F.max("score").alias("hi")).first()
    for i, half in enumerate(ladder):
        low = sketch["lo"] if half >= 1 else sketch["q"][2 * i]
        high = sketch["hi"] if half >= 1 else sketch["q"][2 * i + 1]
        got = rows.agg(F.count(F.when(F.col("score") > high, 1)).alias("above"),
                       F.count(F.when(F.col("score").between(low, high), 1)).alias("inside")).first()
        if got["above"] < wanted <= got["above"] + got["inside"]:
            return low, high, got["above"], got["inside"]
    raise AssertionError("the bracket of all scores holds every rank")


def draw(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """``rank`` for the drawn rows of a scored table, null for the others."""
    rows = landed(rows.withColumn("at", F.monotonically_increasing_id()), "resample-scores")
    able = rows.filter(F.col("n_words") >= least)
    count = able.count()
    wanted = percent * count // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.drop("at").select("*", none)
    low, high, above, inside = bracket(able, wanted, count, ladder)
    top = ranked(able.filter(F.col("score") > high), above, 1)
    mid = ranked(able.filter(F.col("score").between(low, high)), inside, above + 1)
    mid = mid.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.filter((F.col("n_words") < least) | (F.col("score") < low)).select("*", none)
    return top.union(mid).union(rest).drop("at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT,
             least: int = LEAST_WORDS) -> DataFrame:
    """Every row with n_words, n_features, weight, score and, if drawn, its rank."""
    gain = gains(docs, target, text_col, target_text, runs, buckets)
    return draw(scored(docs, gain, id_col, text_col, runs, buckets, seed), percent, least)


def resample_report(docs: DataFrame, target: DataFrame, id_col: str = "doc_id") -> DataFrame:
    out = resample(docs, target, id_col)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
