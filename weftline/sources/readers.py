"""Readers of the formats that graphs, logs and notes come in: text columns to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.graph import known_edges


def walk(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, lang, text) of the source files under roots: those of a known language, outside folders of generated files. A file's listing, not its bytes, decides."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    known = found.select("path", X.lang_of(F.col("path")).alias("lang"), "content").where(F.col("lang").isNotNull() & ~F.col("path").rlike(X.SKIP_DIRS))
    return known.select("path", "lang", F.decode("content", "UTF-8").alias("text"))


def read_graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends exist, from columns json of one object a row."""
    n = nodes.select(F.from_json("json", "id string").alias("j")).select("j.id")
    e = edges.select(F.from_json("json", "source string, target string, type string, line int, loop boolean, cond boolean").alias("j")).select("j.*")
    return known_edges(n, e)


def changed_files(listing: DataFrame) -> DataFrame:
    """(file) of the output of ``git diff --name-only``."""
    return listing.select(F.explode(F.split("value", "\n")).alias("file")).select(F.trim("file").alias("file")).where("file <> ''").distinct()


def git_log(log: DataFrame) -> DataFrame:
    """(hash, author, ts, path, insertions, deletions) of numbered lines (log_id, line_no, value) of
    ``git log --numstat --format=\\x01%H|%an|%aI``; binary files (-) count 0."""
    head = F.when(F.col("value").startswith("\x01"), F.split(F.substring("value", 2, 2147483647), r"\|", 3))
    over = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("head", F.last(head, ignorenulls=True).over(over)).withColumn("p", F.split("value", "\t", 3)).where(F.size("p") == 3)
    number = lambda c: F.coalesce(F.expr(f"try_cast(p[{c}] AS BIGINT)"), F.lit(0))
    return rows.select(F.col("head")[0].alias("hash"), F.col("head")[1].alias("author"), F.to_timestamp(F.col("head")[2]).alias("ts"), F.col("p")[2].alias("path"), number(0).alias("insertions"), number(1).alias("deletions"))


def vault(notes: DataFrame) -> DataFrame:
    """(source, target, kind) of notes(name, text): a link for every [[target]] or [[target|label]], kind from the front matter."""
    kind = F.regexp_extract("text", r"(?s)^---\n.*?\bkind: *([A-Za-z]+).*?\n---", 1)
    links = F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)(\|[^\]]*)?\]\]"), F.lit(1))
    return notes.select(F.col("name").alias("source"), F.explode(F.array_distinct(links)).alias("target"), kind.alias("kind"))
