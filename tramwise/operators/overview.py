"""Figures for the network as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordered
from ..functions.stats import count_rows, mean, or_zero, ratio
from ..sources.tables import Tables
from .routes import all_routes


def system_kpis(t: Tables) -> DataFrame:
    """Capacity, mean of the route means (unweighted) and length of the network."""
    return all_routes(t, sort=False).agg(
        F.sum("max_capacity").alias("total_capacity"),
        mean(F.col("avg_travel_time_min")).alias("avg_travel_time"),
        F.sum("distance_km").alias("total_distance_km"),
    )


@ordered("-n", "transport_type")
def routes_by_type(t: Tables) -> DataFrame:
    """Listed routes per transport type; routes without a type are left out."""
    listed = all_routes(t, sort=False).filter(F.col("transport_type").isNotNull())
    return listed.groupBy("transport_type").agg(count_rows().alias("n"))


@ordered("bin")
def fare_histogram(t: Tables, bins: int = 20) -> DataFrame:
    """Listed routes per fare band: ``bins`` bands of equal width.

    Empty bands are listed with zero. A fare on the upper edge belongs to the
    last band; if all fares are equal there is one band. Bands are found in
    whole cents, so a fare on an edge never slips into the band below.
    """
    listed = all_routes(t, sort=False).filter(F.col("base_fare").isNotNull())
    cents = listed.select((F.col("base_fare") * 100).cast("bigint").alias("cents"))
    least, most = F.min("cents"), F.max("cents")
    bounds = cents.agg(
        F.struct(least.alias("lowest"), (most - least).alias("span"))
    ).scalar()
    place = ratio((F.col("cents") - F.col("lowest")) * bins, F.col("span"))
    band = F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(bins - 1))
    counted = (
        cents.select("cents", bounds.alias("bounds"))
        .select("cents", "bounds.lowest", "bounds.span")
        .groupBy(band.cast("int").alias("bin"))
        .agg(count_rows().alias("n"))
    )
    bands = (
        cents.agg(least.alias("lowest"), (most - least).alias("span"))
        .filter(F.col("lowest").isNotNull())
        .withColumn("last", F.when(F.col("span") == 0, 0).otherwise(bins - 1))
        .select("lowest", "span", F.explode(F.sequence(F.lit(0), "last")).alias("bin"))
    )

    def edge(number) -> Column:
        return ratio(F.col("lowest") * bins + number * F.col("span"), F.lit(bins * 100))

    return bands.join(counted, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("lo"),
        edge(F.col("bin") + 1).alias("hi"),
        or_zero(F.col("n")).alias("n"),
    )


@ordered("table_name")
def volume_summary(t: Tables) -> DataFrame:
    """Row counts of the given tables, and the cards that are active."""
    counts = {
        name: frame.agg(count_rows().alias("n")) for name, frame in t.present().items()
    }
    if "fare_cards" in counts:
        counts["active_cards"] = t.fare_cards.agg(F.count_if("is_active").alias("n"))
    named = [
        count.select(F.lit(name).alias("table_name"), "n")
        for name, count in counts.items()
    ]
    return reduce(DataFrame.unionByName, named)
