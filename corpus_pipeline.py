"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each group linked by n-gram Jaccard similarity one row stays, the
   first by id (nulls last) and then by a hash of the text (of rows equal in id and text
   the least by the other columns).
3. decontaminate: documents with an occurrence of a benchmark window go.
4. mix: sources are mixed to their target weights; a row a document and pass, with the
   words taken of it, so an id may return and another be absent.
5. tokens: ids are written in rANS blocks, read back, and a row a document is returned.

Every stage goes by rows, not by ids: null and repeated ids are documents like others.
Texts that are null, empty or without words are scored by the classifier's bias, are
linked with nothing, hold no benchmark window, and are not drawn by the mix. Very long
texts pass whole. An empty table gives empty stages. Columns beyond those of documents
pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard, mixing, quality, queries
from weftline.llm._store import materialise, workspace
from weftline.ship import shipping


def _safe(docs: DataFrame, *taken: str) -> DataFrame:
    """docs with columns of those names out of the operator's way."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_own_{c}" if c in taken else c) for c in docs.columns])


def _narrow(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of docs, by their own names."""
    have = set(found.columns)
    return found.select(*[F.col(f"`_own_{c}`" if f"_own_{c}" in have else f"`{c}`").alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _narrow(docs, quality.score(_safe(docs, "score", "predicted"), model).where("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_rows(docs).where("kept and n_shingles > 0").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    first = materialise(found.select(F.col("doc_id").alias("id"), "mark", "rows"), workspace(spark, "first"), "rows")
    bare = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = docs.where(~bare).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("m"))
    same = F.col("i").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark"))
    out = whole.join(first.where("rows = 1"), same, "left_semi").select("row.*").unionAll(docs.where(bare))
    several = first.where("rows > 1")
    if not several.isEmpty():
        out = out.unionAll(whole.join(several, same, "left_semi").groupBy("i", "m").agg(F.min("row").alias("row")).select("row.*"))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs_in = _safe(docs, *decontaminate.RESULT, "hit_spans")
    found = decontaminate.decontaminate(docs_in, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _narrow(docs, found.where("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_texts(spark, docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.op1_rans(spark, sf_dir, docs)


STAGES = [(name, shipping(f)) for name, f in (("quality", keep_good), ("near_duplicates", one_of_each_group), ("decontaminate", drop_contaminated), ("mix", mix_sources), ("tokens", to_tokens))]

#: Training, drawing and tokenising have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), where, f"stage-{k}")
    return docs
