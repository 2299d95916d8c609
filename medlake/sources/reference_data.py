"""Small reference tables that must equal the published values.

They are tiny by construction (tens of rows), so operators may broadcast
them without a size probe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: SNP reference (rsid, gene, risk, allele, condition, population_freq)
SNP_TABLE: list[tuple[str, str, float, str, str, float]] = [
    ("rs7903146", "TCF7L2", 1.35, "T", "Type 2 Diabetes", 0.30),
    ("rs4506565", "TCF7L2", 1.20, "A", "Type 2 Diabetes", 0.25),
    ("rs12779790", "CDC123", 1.15, "G", "Type 2 Diabetes", 0.18),
    ("rs17465637", "MIA3", 1.25, "C", "Coronary Artery Disease", 0.12),
    ("rs6725887", "WDR12", 1.18, "T", "Myocardial Infarction", 0.09),
    ("rs3184504", "SH2B3", 1.32, "A", "Stroke", 0.21),
    ("rs2981582", "FGFR2", 1.28, "T", "Breast Cancer", 0.38),
    ("rs1447295", "LOC727677", 1.43, "A", "Prostate Cancer", 0.07),
    ("rs3814113", "BABAM1", 1.17, "C", "Lung Cancer", 0.15),
    ("rs7412", "APOE", 3.10, "C", "Alzheimer’s Disease", 0.14),
    ("rs17646946", "GBA", 2.45, "T", "Parkinson’s Disease", 0.03),
    ("rs1065776", "PLA2G6", 1.89, "G", "ALS", 0.11),
    ("rs2476601", "PTPN22", 1.78, "A", "Rheumatoid Arthritis", 0.09),
    ("rs7574865", "STAT4", 1.55, "T", "Lupus", 0.22),
    ("rs3087243", "CTLA4", 1.34, "G", "Type 1 Diabetes", 0.41),
    ("rs780094", "GCKR", 1.21, "C", "Hypertriglyceridemia", 0.33),
    ("rs1260326", "GCKR", 1.15, "T", "Metabolic Syndrome", 0.28),
    ("rs964184", "ZPR1", 1.42, "G", "Dyslipidemia", 0.05),
    ("rs12248560", "CYP2C19", 2.10, "A", "Clopidogrel Response", 0.15),
    ("rs9923231", "VKORC1", 3.05, "T", "Warfarin Dosing", 0.40),
    ("rs4149056", "SLCO1B1", 4.20, "C", "Statin Myopathy", 0.18),
    ("rs12345678", "FUT2", 0.65, "A", "Vitamin B12 Levels", 0.42),
    ("rs23456789", "HLA-DQB1", 2.10, "G", "Celiac Disease", 0.07),
    ("rs34567890", "FTO", 1.25, "T", "Obesity", 0.31),
]

# fixed values: polygenic score panels (condition, rsid) in panel order
PRS_PANELS: list[tuple[str, str]] = [
    ("diabetes", "rs7903146"),
    ("diabetes", "rs4506565"),
    ("diabetes", "rs12779790"),
    ("alzheimers", "rs7412"),
    ("alzheimers", "rs3851179"),
    ("alzheimers", "rs744373"),
]


def snp_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SNP_TABLE, "rsid string, gene string, risk double, allele string, condition string, population_freq double")


def prs_panels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRS_PANELS, "condition string, rsid string")
