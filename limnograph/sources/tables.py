"""Fixed lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Assessment points by park, sample depth (None: any) and characteristic.
LOWER_RULES = [
    ("MABI", "stream", "DO_mgL", 7.0),
    ("MABI", "stream", "pH", 6.5),
    ("MABI", "epilimnion", "pH", 6.5),
    ("SAGA", "stream", "DO_mgL", 6.0),
    ("SAGA", "epilimnion", "DO_mgL", 5.0),
    ("SAGA", "stream", "pH", 6.5),
    ("SAGA", "epilimnion", "pH", 6.5),
    ("MIMA", None, "pH", 6.5),
    ("SAIR", None, "pH", 6.5),
    ("SARA", None, "DO_mgL", 4.0),
    ("SARA", None, "pH", 6.5),
    ("ROVA", None, "DO_mgL", 4.0),
    ("ROVA", None, "pH", 6.5),
    ("WEFA", None, "DO_mgL", 5.0),
    ("WEFA", None, "pH", 6.5),
    ("WEFA", None, "SDepth1_m", 4.5),
    ("MORR", None, "DO_mgL", 7.0),
    ("MORR", None, "pH", 6.5),
]
UPPER_RULES = [
    ("MABI", "stream", "pH", 8.5),
    ("MABI", "epilimnion", "pH", 8.5),
    ("SAGA", "stream", "pH", 8.5),
    ("SAGA", "epilimnion", "pH", 8.5),
    ("MIMA", None, "pH", 8.3),
    ("MIMA", None, "TP_ugL", 31.25),
    ("MIMA", None, "TN_mgL", 0.71),
    ("SAIR", None, "pH", 8.3),
    ("SAIR", None, "TP_ugL", 31.25),
    ("SAIR", None, "TN_mgL", 0.71),
    ("SAIR", None, "Temp_C", 28.3),
    ("SARA", None, "pH", 8.5),
    ("SARA", None, "TN_mgL", 0.54),
    ("ROVA", None, "pH", 8.5),
    ("ROVA", None, "TP_ugL", 33.0),
    ("ROVA", None, "TN_mgL", 0.54),
    ("WEFA", None, "Temp_C", 29.4),
    ("WEFA", None, "pH", 8.0),
    ("WEFA", None, "TP_ugL", 8.0),
    ("WEFA", None, "TN_mgL", 0.32),
    ("WEFA", None, "ChlA_ugL", 2.9),
    ("MORR", None, "Temp_C", 22.0),
    ("MORR", None, "pH", 8.5),
    ("MORR", None, "TP_ugL", 36.56),
    ("MORR", None, "TN_mgL", 0.69),
    ("MORR", None, "SO4_ueqL", 5200.0),
    ("MORR", None, "Turbidity_NTU", 50.0),
]

# Ecoregion thresholds as printed (type, class, TP, TN, chlorophyll a, turbidity,
# conductivity).
ECOREGION = [
    ("Lake", "Least disturbed", "14.5", "0.4", "3.81", "1.1", None),
    ("Lake", "Most disturbed", "22", "0.6", "7.76", "1.46", None),
    ("Stream", "Least disturbed", "17.1", "0.345", None, None, "500"),
    ("Stream", "Most disturbed", "32.6", "0.482", None, None, "1000"),
]

# State standards as printed (state, type, class, maximum temperature, minimum
# dissolved oxygen, pH range, total nitrogen, total phosphorus, chlorophyll a, secchi depth,
# turbidity).
NATURAL = "As naturally occurs"
DASH = "&ndash;"
STATE_STANDARDS = [
    ("CT", "Lake", "Mesotrophic", "85, or maximum of 4&#176; increase from natural conditions", "5.0",
     "6.5&ndash;8.0", "0.2&ndash;0.6", "10&ndash;30", "2&ndash;15", "2&ndash;6", None),
    ("CT", "Lake", "Eutrophic", "85, or maximum of 4&#176; increase from natural conditions", "5.0",
     "6.5&ndash;8.0", "0.6&ndash;1.0", "30&ndash;50", "15&ndash;30", "1&ndash;2", None),
    ("ME", "Stream", "AA", "As naturally occurs)", "7.0 (or 75% saturation)", NATURAL, NATURAL,
     NATURAL, None, None, DASH),
    ("ME", "Lake", "GPA", NATURAL, NATURAL, NATURAL, NATURAL, NATURAL, NATURAL, NATURAL, None),
    ("MA", "Stream", "A", "68 (cold)", "6.0 (cold)", "6.5&ndash;8.3", NATURAL, NATURAL, None, None,
     "Not objectionable and does not impair use"),
    ("MA", "Stream", "A", "83 (warm)", "5.0 (warm)", "6.5&ndash;8.3", NATURAL, NATURAL, None, None,
     "Not objectionable and does not impair use"),
    ("NH", "Stream", "A", NATURAL, "6.0 (or 75% saturation)", "6.5&ndash;8.0", NATURAL, NATURAL,
     None, None, NATURAL),
    ("NH", "Lake", "Ponds", NATURAL, "5.0 (or 75% saturation)", "6.5&ndash;8.0", NATURAL, NATURAL,
     DASH, DASH, None),
    ("NJ", "Stream", "FW2", "72 (66 for 7-day average max temp)", "7.0", "6.5&ndash;8.5", NATURAL,
     "100", None, None, "50 (15 for 30-day average)"),
    ("NY", "Stream", "AA", DASH, "7.0 (cold)", "6.5&ndash;8.5", "No algae growth", "No algae growth",
     None, None, DASH),
    ("NY", "Stream", "AA", DASH, "4.0 (warm)", "6.5&ndash;8.5", "No algae growth", "No algae growth",
     None, None, DASH),
    ("VT", "Stream", "A(1)", DASH, "6.0&ndash;7.0 (or 70&ndash;75% saturation; cold)",
     "6.5&ndash;8.0", "2.0", NATURAL, None, None, "10"),
    ("VT", "Stream", "A(1)", DASH, "5.0 (or 60% saturation; warm", "6.5&ndash;8.0", "2.0", NATURAL,
     None, None, "10"),
    ("VT", "Lake", "Ponds", DASH, "5.0 (or 60% saturation)", "6.5&ndash;8.0", "5", NATURAL, DASH,
     DASH, None),
]
STANDARD_COLUMNS = ["state", "water_type", "class", "max_temp_f", "min_do", "ph_range", "max_tn",
                    "max_tp", "max_chla", "min_secchi", "turbidity"]
ECOREGION_COLUMNS = ["water_type", "disturbance", "tp", "tn", "chla", "turbidity", "conductivity"]

# Data store code of each park.
PARK_STORE_CODE = {
    "ACAD": "1122",
    "MABI": "1062",
    "MIMA": "1103",
    "MORR": "1138",
    "ROVA": "1146",
    "SAGA": "1159",
    "SAIR": "1153",
    "SARA": "1168",
    "WEFA": "1176",
}


def rule_thresholds(spark: SparkSession) -> DataFrame:
    """The rules in their order (``rule``): of those that fit, the first counts."""
    rows = [("Lower", *r) for r in LOWER_RULES] + [("Upper", *r) for r in UPPER_RULES]
    rows = [(*r, i) for i, r in enumerate(rows)]
    schema = "side string, park string, depth string, characteristic string, point double, rule int"
    return spark.createDataFrame(rows, schema)


def ecoregion_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ECOREGION, ", ".join(f"{c} string" for c in ECOREGION_COLUMNS))


def state_standards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_STANDARDS, ", ".join(f"{c} string" for c in STANDARD_COLUMNS))


def store_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARK_STORE_CODE.items()), "park string, code string")
