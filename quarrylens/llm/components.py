"""Distributed union-find: connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import materialize

SALTS = 16


def _smallest(links: DataFrame) -> DataFrame:
    """Every link (u, v) with the smallest of u and its neighbours; a hub's links are spread by salt."""
    least = (
        links.groupBy("u").agg(F.min("v").alias("m"))
        .select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, (F.col("u") == F.col("hub")) & (salted["s"] == least["s"])).select("u", "v", "m")


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that occurs in ``links``; a component is its smallest id.

    Alternates two steps until nothing changes: each id passes its smallest neighbour to
    its larger ones, then to its smaller ones. Links shrink to stars around the smallest
    ids in a number of rounds that grows with the logarithm of the path lengths. Every
    round is written to the shared folder; the driver sees a count and a checksum.
    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    stars = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        low = _smallest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        stars = materialize(small.where("u <> v").distinct())
        before, state = state, _state(stars)
        if state == before:
            break
    leaves = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
