"""An extension: positions that arrive as a stream, counted by tile region and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import position as P


def region_counts(positions: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """positions (ts, lat, lon), streaming or not -> (start, region, n); rows later than the watermark are left out of a stream."""
    own = positions.withWatermark("ts", late).select(F.window("ts", window).alias("w"), P.coarse(P.place_tile(F.col("lat"), F.col("lon"))).alias("region"))
    return own.groupBy("w", "region").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "region", "n")
