"""Genomic risk (L1-L6): per-SNP factors, polygenic risk scores,
percentiles and observed allele frequencies.

Genotypes are a long table ``(patient_id, rsid, genotype)``.  The SNP and
panel tables are tiny fixed lists and are broadcast; the genotype side is
never shuffled for the lookup.  The PRS is a grouped ``product`` with a
map-side partial aggregate, so a patient or a condition holding a large
share of rows does not pile up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.operators.joins import bounded_broadcast
from medlake.operators.ordered import running_totals
from medlake.session import materialize


def allele_count(genotype: Column, allele: Column) -> Column:
    """Occurrences of the risk allele letter in the genotype string."""
    return F.length(genotype) - F.length(F.replace(genotype, allele, F.lit("")))


def snp_factor(genotype: Column, allele: Column, risk: Column) -> Column:
    """L1: two copies -> risk^2, one -> risk, else (or unknown SNP) 1.0."""
    n = allele_count(F.coalesce(genotype, F.lit("NN")), allele)
    return F.coalesce(F.when(n == 2, risk * risk).when(n == 1, risk).otherwise(F.lit(1.0)), F.lit(1.0))


def polygenic_scores(genotypes: DataFrame, panels: DataFrame, snps: DataFrame, patients: DataFrame,
                     key: str = "patient_id", conditions: Sequence[str] | None = None) -> DataFrame:
    """L2/L3: PRS = prod(factor) - 1 per (patient, condition).

    Absent genotypes count as 'NN' (factor 1), and a panel SNP missing
    from the SNP table counts 1.0 [ours].  Every patient in ``patients``
    gets a row per condition (0.0 when nothing matches): the condition
    list is a small fixed array exploded per patient, not a join.
    """
    ref = panels.join(snps.select("rsid", "risk", "allele"), "rsid", "left")
    if conditions is not None:
        ref = ref.where(F.col("condition").isin(list(conditions)))
    conds = [r["condition"] for r in ref.select("condition").distinct().collect()]  # a handful of names
    g = genotypes.join(bounded_broadcast(ref), "rsid", "inner")
    f = g.select(key, "condition", snp_factor(F.col("genotype"), F.col("allele"), F.col("risk")).alias("f"))
    prs = f.groupBy(key, "condition").agg((F.product("f") - F.lit(1.0)).alias("prs"))
    base = patients.select(key).distinct().select(key, F.explode(F.array(*[F.lit(c) for c in sorted(conds)]))
                                                  .alias("condition"))
    return base.join(prs, [key, "condition"], "left").select(key, "condition",
                                                             F.coalesce("prs", F.lit(0.0)).alias("prs"))


def prs_percentile(prs: DataFrame, key: str = "patient_id") -> DataFrame:
    """Percent rank (x100) of each PRS within its condition, ties share
    the lowest rank.  Distinct scores with their counts are ranked with the
    bucketed running count, so one condition is not a single task."""
    counts = prs.groupBy("condition", "prs").agg(F.count(F.lit(1)).alias("n"))
    r = running_totals(counts, ["prs"], ["n"], partition_cols=["condition"])
    pr = F.when(F.col("total_n") > 1, (F.col("cum_n") - F.col("n")) / (F.col("total_n") - 1)).otherwise(F.lit(0.0))
    ranks = r.select("condition", "prs", (pr * 100).alias("percentile"))
    # a score that most rows share means few distinct ones: with the ranks
    # broadcast no row moves; beyond the bound AQE splits hot scores
    return prs.join(bounded_broadcast(materialize(ranks, "prs-ranks")), ["condition", "prs"], "inner")


def allele_frequencies(genotypes: DataFrame, snps: DataFrame) -> DataFrame:
    """Observed risk-allele frequency per SNP (called genotypes only)
    next to the stored population frequency."""
    g = genotypes.where(F.col("genotype").isNotNull()).join(bounded_broadcast(snps.select("rsid", "allele",
                                                                                    "population_freq")), "rsid")
    return g.groupBy("rsid", "population_freq").agg(
        (F.sum(allele_count(F.col("genotype"), F.col("allele"))) / (2.0 * F.count(F.lit(1)))).alias("observed_freq"),
        F.count(F.lit(1)).alias("n_called"))


def prs_wide(prs: DataFrame, key: str = "patient_id", conditions: Sequence[str] | None = None) -> DataFrame:
    """L3: one column per condition (a pivot over the known, small set of
    conditions -- listing them avoids an extra distinct pass)."""
    conds = list(conditions) if conditions else sorted(r[0] for r in prs.select("condition").distinct().collect())
    return prs.groupBy(key).pivot("condition", conds).agg(F.first("prs"))
