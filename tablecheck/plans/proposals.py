"""Proposing checks from a catalog and a profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.local import local_frame

PROFILES = ("smoke", "standard", "deep", "custom")

# Which check is proposed for which layer, how sure the proposal is
# and which profiles ask for it. Columns: layer, prefix of the check name, type,
# severity, gate, confidence, profiles that include it, profiles that may accept
# it without review, what the dataset needs; the rationale is our own wording.
RULES = (
    ("RAW", "pk_uniqueness", "uniqueness", "blocker", "fail", 0.95, "smoke,standard,deep,custom", "standard,deep", "key", "A key that repeats makes every later join count rows twice"),
    ("RAW", "not_null_key", "not_null", "blocker", "fail", 0.90, "smoke,standard,deep,custom", "standard,deep", "key", "A null in a key matches nothing"),
    ("RAW", "freshness", "freshness", "major", "warn", 0.80, "standard,deep", "", "any", "Late input makes everything built on it late"),
    ("RAW", "row_count_stability", "row_count", "major", "warn", 0.70, "deep", "", "any", "A jump in the number of rows points to a lost or doubled load"),
    ("PREP", "schema_contract", "schema", "blocker", "fail", 0.95, "smoke,standard,deep,custom", "smoke,standard,deep,custom", "any", "Consumers rely on the agreed columns and types"),
    ("PREP", "total_consistency", "rule", "major", "fail", 0.85, "smoke,standard,deep,custom", "deep", "order", "The parts of an order must add up to its total"),
    ("PREP", "fk_integrity", "reconciliation", "major", "fail", 0.80, "smoke,standard,deep,custom", "", "reference", "A reference without its parent row is lost in joins"),
    ("MART", "dim_completeness", "not_null", "major", "fail", 0.90, "smoke,standard,deep,custom", "smoke,standard,deep,custom", "dimension", "Facts cannot be attributed to a dimension row without a key"),
    ("MART", "fact_dim_coverage", "reconciliation", "major", "fail", 0.85, "smoke,standard,deep,custom", "", "fact", "Facts without their dimension drop out of reports"),
    ("MART", "agg_consistency", "reconciliation", "major", "fail", 0.75, "deep", "", "any", "Sums must survive the way from the source to the report"),
)

# Name prefixes of the layers.
LAYER_PREFIXES = {
    "RAW": ("RAW.",),
    "PREP": ("PREP.", "STAGE."),
    "MART": ("MART.", "DIM.", "FACT."),
}

RULES_SCHEMA = (
    "layer string, prefix string, type string, severity string, gate string, confidence double, "
    "profiles string, accepted_by string, needs string, rationale string"
)


def layer_of(name: str) -> str:
    upper = name.upper()
    for layer, prefixes in LAYER_PREFIXES.items():
        if upper.startswith(prefixes):
            return layer
    return "UNKNOWN"


def detect_layer(name: Column) -> Column:
    upper = F.upper(name)
    out = F.lit("UNKNOWN")
    for layer, prefixes in reversed(list(LAYER_PREFIXES.items())):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | upper.startswith(p)
        out = F.when(hit, layer).otherwise(out)
    return out


def propose_tests(
    datasets: DataFrame,
    keys: DataFrame | None = None,
    profile: str = "standard",
    layers: Sequence[str] | None = None,
) -> DataFrame:
    """One row per proposed check.

    `datasets` is a catalog's dataset frame; `keys` (dataset, column) are key
    candidates found in the data and serve where the catalog names no key. The
    rules are a constant of ten rows that joins on the layer.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    spark = datasets.sparkSession
    d = datasets.withColumn("layer", detect_layer(F.col("dataset")))
    if layers:
        d = d.filter(F.col("layer").isin([x.upper() for x in layers]))
    if keys is not None:
        # A dataset has a handful of key candidates; the smallest name is taken
        # by a plain minimum, nothing is collected.
        found = keys.groupBy(F.col("dataset").alias("_kd")).agg(F.min("column").alias("_key"))
        d = (
            d.join(found, d.dataset == found._kd, "left")
            .withColumn(
                "primary_key",
                F.when(
                    (F.size("primary_key") == 0) & F.col("_key").isNotNull(), F.array("_key")
                ).otherwise(F.col("primary_key")),
            )
            .drop("_kd", "_key")
        )
    rules = local_frame(spark, RULES, RULES_SCHEMA)
    upper = F.upper("dataset")
    applies = (
        F.when(F.col("needs") == "order", upper.contains("ORDER"))
        .when(F.col("needs") == "dimension", upper.contains("DIM."))
        .when(F.col("needs") == "fact", upper.contains("FACT."))
        .otherwise(True)
    )
    ref = F.transform(
        "foreign_keys",
        lambda k: F.concat(
            F.concat_ws(",", k["columns"]),
            F.lit(" references "),
            k["ref_table"],
        ),
    )
    return (
        d.join(rules, "layer")
        .filter(F.array_contains(F.split("profiles", ","), profile) & applies)
        .select(
            F.concat_ws("_", "prefix", F.replace(F.lower("dataset"), F.lit("."), F.lit("_"))).alias("test"),
            "type",
            "dataset",
            "layer",
            F.when(F.col("type").isin("uniqueness", "not_null"), F.col("primary_key")).alias("keys"),
            F.when(F.col("needs") == "order", F.lit("order_total == items_total + tax + shipping"))
            .when(F.col("needs") == "reference", F.concat_ws("; ", ref))
            .alias("expression"),
            F.when(F.col("type") == "freshness", F.lit(24)).alias("last_hours"),
            F.when(F.col("type") == "row_count", F.lit(10.0)).alias("pct"),
            F.when(F.col("prefix").isin("total_consistency", "agg_consistency"), F.lit(0.01)).alias("abs"),
            F.when(F.col("type") == "uniqueness", F.lit(0)).alias("dup_rows"),
            "severity",
            "gate",
            "rationale",
            "confidence",
            F.array_contains(F.split("accepted_by", ","), profile).alias("auto_approvable"),
        )
    )


def propose_tolerance(history: DataFrame, k: float = 3.0, minimum: float = 0.01) -> DataFrame:
    """(test, center, deviation, runs, tolerance) from past observations.

    Median and median absolute deviation per test, both exact and both by plain
    aggregation over counted values: `history` is (test, observed).
    """
    obs = history.filter(F.col("observed").isNotNull())
    med = obs.groupBy("test").agg(
        F.median("observed").alias("center"), F.count(F.lit(1)).alias("runs")
    )
    dev = (
        obs.join(med, "test")
        .groupBy("test")
        .agg(
            F.median(F.abs(F.col("observed") - F.col("center"))).alias("deviation"),
            F.first("center").alias("center"),
            F.first("runs").alias("runs"),
        )
    )
    return dev.select(
        "test",
        "center",
        "deviation",
        "runs",
        F.greatest(F.lit(minimum), F.lit(k) * F.col("deviation")).alias("tolerance"),
    )
