"""The feature vector of a route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screeline.operators.latest import latest_rows

# fixed values: the fields of a route's vector and what each is divided by
NUMERIC = {
    "gpx_distance_mi": 1.0,
    "gpx_gain_ft": 250.0,
    "crux_density_medium": 2.5,
    "crux_density_extreme": 1.5,
    "longest_medium_section_mi": 0.04,
    "longest_extreme_section_mi": 0.02,
    "yds_class": 0.4,
}
RISKS = ["exposure", "rockfall", "route_finding", "commitment"]
RISK_LEVELS = ["low", "moderate", "considerable", "high", "extreme"]
RISK_UNIT = 0.4


def risk_level(text: Column) -> Column:
    """0 to 4 for a risk label in any case and padding; null for anything else."""
    at = F.array_position(F.array(*[F.lit(x) for x in RISK_LEVELS]), F.lower(F.trim(text)))
    return F.when(at > 0, at - 1).cast("double")


def route_vectors(features: DataFrame) -> DataFrame:
    """(route_id, x): the latest row of each route whose fields are all present, as an array.

    NaN and infinite fields count as missing.  The first six components are continuous, the
    last five lie on steps of 2.5.
    """
    latest = latest_rows(features, "route_id", "exported_at", [*NUMERIC, *RISKS])
    parts = [F.col(c).cast("double") / F.lit(unit) for c, unit in NUMERIC.items()]
    parts += [risk_level(F.col(c)) / F.lit(RISK_UNIT) for c in RISKS]
    vectors = latest.select("route_id", F.array(*parts).alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(good)
