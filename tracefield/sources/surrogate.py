"""A GPS relation made from an event log by arithmetic alone.

Each user is a trip; successive events are samples 5 index steps apart on one
of four headings through a common crossing, moved sideways a little by the
event's value. It gives trace queries something to run on where no GPS data is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.grid import with_cells

#: The same relation as SQL over a table ``events``.
SQL = """
o AS (SELECT user_id AS trip_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
d AS (SELECT *, CASE trip_id % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS ux, CASE trip_id % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS uy FROM o),
s0 AS (SELECT trip_id, k, value,
         42.35e0 + (k * 5 - 150) * 1e-5 * ux + (value - 245e0) * 1e-7 * uy AS lat,
         -71.10e0 + (k * 5 - 150) * 1e-5 * uy + (value - 245e0) * 1e-7 * ux AS lon FROM d),
samples AS (SELECT trip_id, CAST(k * 5 AS BIGINT) AS idx, lat, lon, value / 1000e0 AS speed_inv,
         CAST(floor(lat / 1e-3) AS INT) AS clat, CAST(floor(-lon / 1e-3) AS INT) AS clon FROM s0)
"""


def samples(events: DataFrame) -> DataFrame:
    """trip_id, idx, lat, lon, speed_inv, clat and clon."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select(F.col("user_id").alias("trip_id"), "value", k.alias("k"))
    turn = F.pmod(F.col("trip_id"), F.lit(4))
    ux = F.when(turn == 0, 1).when(turn == 2, -1).otherwise(0)
    uy = F.when(turn == 1, 1).when(turn == 3, -1).otherwise(0)
    along, aside = (F.col("k") * 5 - 150) * F.lit(1e-5), (F.col("value") - F.lit(245.0)) * F.lit(1e-7)
    rows = rows.select(
        "trip_id",
        (F.col("k") * 5).cast("long").alias("idx"),
        (F.lit(42.35) + along * ux + aside * uy).alias("lat"),
        (F.lit(-71.10) + along * uy + aside * ux).alias("lon"),
        (F.col("value") / F.lit(1000.0)).alias("speed_inv"),
    )
    return with_cells(rows)
