"""Inheritance: ancestors of classes, and the methods that implement a declared ancestor's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.store import materialise, workspace


def ancestors(bases: DataFrame) -> DataFrame:
    """(cls, base): the transitive closure of bases(cls, base), by doubling; cycles are harmless."""
    where = workspace(bases.sparkSession, "ancestors")
    up, n, k = materialise(bases.select("cls", "base").distinct(), f"{where}/0"), -1, 0
    while (size := up.count()) != n:
        n, k = size, k + 1
        two = up.alias("x").join(up.alias("y"), F.col("x.base") == F.col("y.cls")).select("x.cls", "y.base")
        up = materialise(up.union(two).distinct(), f"{where}/{k}")
    return up


def implements_link(methods: DataFrame, up: DataFrame) -> DataFrame:
    """(source, target): a class's method and the one of that name of an ancestor; methods(cls, name)."""
    declared = methods.select(F.col("cls").alias("base"), "name")
    hit = methods.join(up, "cls").join(declared, ["base", "name"])
    return hit.select(F.concat_ws(".", "cls", "name").alias("source"), F.concat_ws(".", "base", "name").alias("target")).distinct()
