"""Which body a call runs: overloads by arguments, injected declarations by beans. Inputs are declared rows, of any language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick_overload(calls: DataFrame, overloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, source, target) of calls that fit one overload best, and (source, name) of those that could mean several.

    calls(site, source, name, args), overloads(id, name, params): args and params are arrays of types, an arg of unknown
    type is null. Of the overloads with as many parameters those count whose types the known args do not
    contradict most often: the most matches win, and a tie is ambiguous. With one overload of that many it is taken.
    """
    fit = calls.join(overloads.withColumnRenamed("id", "target"), "name").where(F.size("args") == F.size("params"))
    same = F.size(F.filter(F.zip_with("args", "params", lambda a, p: F.coalesce(a == p, F.lit(False))), lambda x: x))
    scored = fit.select("site", "source", "name", F.struct(same.alias("score"), "target").alias("s"))
    best = scored.groupBy("site", "source", "name").agg(F.max("s.score").alias("top"), F.max_by("s.target", "s.score").alias("target"), F.collect_list("s.score").alias("scores"))
    best = best.withColumn("ties", F.size(F.filter("scores", lambda x: x == F.col("top"))))  # as many as a name has overloads
    return best.where("ties = 1").select("site", "source", "target"), best.where("ties > 1").select("source", "name").distinct()


def spring_beans(injections: DataFrame, beans: DataFrame) -> DataFrame:
    """(source, type, target): the class behind each injection(source, type, qualifier), or the type itself where the source does not settle it.

    beans(bean, cls, type, primary, conditional): classes with a component annotation, or what a @Bean method makes.
    A qualifier names its bean; else the only bean of the type is meant, else the only primary one; a
    conditional bean among those of the type leaves it open.
    """
    of_type = beans.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if("primary").alias("primaries"), F.bool_or("conditional").alias("open"),
        F.min("cls").alias("only"), F.min(F.when(F.col("primary"), F.col("cls"))).alias("first"),
    )
    named = beans.groupBy("type", F.col("bean").alias("qualifier")).agg(F.count("*").alias("k"), F.min("cls").alias("named")).where("k = 1").select("type", "qualifier", "named")
    settled = F.when(F.col("qualifier").isNotNull(), F.col("named")).when(F.col("open"), F.lit(None)).when(F.col("n") == 1, F.col("only")).when(F.col("primaries") == 1, F.col("first"))
    return injections.join(of_type, "type", "left").join(named, ["type", "qualifier"], "left").select("source", "type", F.coalesce(settled, "type").alias("target"))
