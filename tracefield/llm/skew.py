"""Joins of a table with one that has one row for each key, where a key may hold a third of all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than a 1 / HOT share of the rows are dealt over SALTS tasks.
HOT, SALTS = 256, 64
#: Keys that the search for frequent ones follows at a time; it finds all of more than a few times 1 / TRACKED.
TRACKED = 4096


def hot_keys(rows: DataFrame, key: Column) -> list[int]:
    """Values of ``key`` (a long) that more than a 1 / HOT share of the rows have; at most HOT of them, from bounded summaries."""
    found = rows.select(key.alias("_k")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(_k, {HOT}, {TRACKED})").alias("top"))
    r = found.first()
    return sorted(x["item"] for x in r["top"] or [] if x["item"] is not None and x["count"] * HOT > r["n"])


def join_one(rows: DataFrame, one: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined by ``on`` with ``one``, which has at most one row for each key; ``how``: inner or left.

    Rows of a hot key are dealt by the hash of their columns, and the row
    that they meet is there once for each share.
    """
    key = F.xxhash64(*on)
    hot = hot_keys(rows, key)
    if not hot:
        return rows.join(one, on, how)
    is_hot = key.isin(hot)
    plain = [f.name for f in rows.schema if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]  # of types that can be hashed
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(F.lit(1), *plain), F.lit(SALTS))).otherwise(F.lit(0)).cast("long"))
    shares = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(one.withColumn("_salt", F.explode(shares)), [*on, "_salt"], how).drop("_salt")
