"""Interaction audit of document filters: what every filter removes in every order.

Each document fails some of the filters; the set of failed filters is a bit
mask.  What an order of filters does to a part of the corpus depends only on how
many documents hold each mask, so the documents are reduced to at most 32 cells
a part before any order is looked at.  Each cell is then folded across the array
of all orders, a constant of the plan: ``transform`` walks the orders, and
``aggregate`` walks an order's steps with the filters applied so far as its
state.  A cell yields one weighted struct for each (order, step); a part's cells
are merged by elementwise sums.  Everything is column functions.

The duplicate filter compares whole texts by their 256-bit digest.  Of a text's
rows those with its smallest id pass and all others fail, so it needs one
grouped minimum by digest; its counts are totals less the passing rows, and no
group of copies meets in one task.

Results for odd input: a null text is empty (and equal to empty texts), a null
source is the part '', a row with a null id neither fails the duplicate filter
nor makes others fail it, rows repeated with one id and text are equal in id and
do not make each other fail.  Labels of one id given several times count if any
of them says 1; null labels count as none.  An empty table has no parts and no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import landed

FILTERS = "ABCDE"
DUPLICATE = 16
WORDS, DISTINCT, CAPITALS = 50, 65, 5
#: Every order of the filters, and the filters' bits in that order.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def order_bits() -> Column:
    return F.array(*[F.array(*[F.lit(_bit(c)) for c in o]) for o in ORDERS])


def failed(text: Column) -> Column:
    """Bit mask of the failed filters A to D of a text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {"A": n < WORDS, "B": distinct * 100 < n * DISTINCT,
             "C": capitals * 100 > F.length(text) * CAPITALS, "D": text.rlike(r"[#$%&*|]")}
    mask = F.lit(0)
    for letter, fail in fails.items():
        mask = mask + F.when(fail, _bit(letter)).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of
    filters they fail, those labelled good and those labelled toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("h"), failed(text).alias("mask"))
    rows = rows.groupBy("h", "id", "part", "mask").agg(F.count("*").alias("n"))
    said = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("g"),
                 F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t")))
    # a null id meets no label, so those rows stay out of the join
    known = rows.filter("id is not null").join(said, "id", "left").select(
        "h", "id", "part", "mask", "n", (F.col("n") * F.coalesce("g", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic"))
    rows = landed(known.union(rows.filter("id is null").select(
        "h", "id", "part", "mask", "n", F.lit(0).cast("long"), F.lit(0).cast("long"))), "audit-rows")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    every = rows.groupBy("part", "mask").agg(*sums)
    least = rows.filter("id is not null").groupBy("h").agg(F.min("id").alias("id"))
    passing = (rows.join(least, ["h", "id"], "left_semi").select("part", "mask", "n", "good", "toxic")
               .union(rows.filter("id is null").select("part", "mask", "n", "good", "toxic")))
    # totals less the passing rows fail the duplicate filter
    less = passing.groupBy("part", "mask").agg(*sums)
    failing = every.select("part", (F.col("mask") + DUPLICATE).alias("mask"), "n", "good", "toxic").union(
        less.select("part", F.col("mask") + DUPLICATE, *[-F.col(c) for c in ("n", "good", "toxic")]))
    return less.union(failing).groupBy("part", "mask").agg(*sums).filter("n > 0")


def _folded(cell: Column, orders: Column) -> Column:
    """A cell's structs, one for each step of each order in turn."""
    mask, zero = cell["mask"], F.lit(0).cast("long")

    def counted(hit: Column, what: str, name: str) -> Column:
        return F.when(hit, cell[what]).otherwise(zero).alias(name)

    def step(state: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(state["seen"]) != 0
        removed = fails & ~gone
        out = F.struct(counted(~fails & ~gone, "n", "kept"), counted(removed, "n", "removed"),
                       counted(fails & gone, "n", "redundant"), counted(mask == bit, "n", "unique_fails"),
                       counted(removed, "good", "good_lost"), counted(removed, "toxic", "toxic_lost"))
        return F.struct(state["seen"].bitwiseOR(bit).alias("seen"), F.concat(state["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<{_STRUCT}>").alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["out"])))


_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; ``shapley`` is what
    the step's filter removes, summed over all orders."""
    cells = mask_cells(docs, labels, id_col, text_col, part_col)
    steps, width = len(ORDERS) * len(FILTERS), len(FILTERS)
    orders, zero = order_bits(), F.lit(0).cast("long")
    none = F.array_repeat(F.struct(*[zero.alias(c) for c in COUNTS]), steps)
    # at most 32 cells a part
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    merged = by_part.select("part", F.aggregate(
        "cells", none, lambda acc, cell: F.zip_with(acc, _folded(cell, orders), add)).alias("steps"))
    bits = F.flatten(orders)

    def over_orders(bit: Column) -> Column:
        own = F.zip_with("steps", bits, lambda x, b: F.when(b == bit, x["removed"]).otherwise(zero))
        return F.aggregate(own, zero, lambda a, n: a + n)

    total = F.transform(F.array(*[F.lit(_bit(c)) for c in FILTERS]), over_orders)
    names = F.array(*[F.lit(o) for o in ORDERS])
    out = merged.select("part", total.alias("total"), F.posexplode("steps").alias("at", "x")).select(
        "part", "total", "x", F.element_at(names, F.floor(F.col("at") / width).cast("int") + 1).alias("filter_order"),
        (F.col("at") % width + 1).cast("int").alias("step"))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    return out.select("part", "filter_order", "step", *[F.col("x")[c].alias(c) for c in COUNTS],
                      F.element_at("total", own).alias("shapley"))
