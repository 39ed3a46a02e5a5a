"""Search: nodes that pass every filter that is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a search where no limit is given.
LIMIT = 50


def search(
    nodes: DataFrame, edges: DataFrame, *, name: str | None = None, doc: str | None = None, layer: str | None = None, kind: str | None = None, file: str | None = None,
    lang: str | None = None, calls: str | None = None, called_by: str | None = None, orphans: bool = False, limit: int | None = LIMIT,
) -> DataFrame:
    """nodes by patterns of id and doc (whatever case), layer, kind, a part of the file, language, a callee, a caller, or no caller; by id up to limit (None: all)."""
    out = nodes
    for column, pattern in (("id", name), ("doc", doc)):
        if pattern is not None:
            out = out.where(F.col(column).rlike(f"(?i){pattern}"))
    for column, value in (("layer", layer), ("kind", kind), ("lang", lang)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if file is not None:
        out = out.where(F.col("file").contains(file))
    if calls is not None:
        out = out.join(edges.where(F.col("target") == calls).select(F.col("source").alias("id")), "id", "left_semi")
    if called_by is not None:
        out = out.join(edges.where(F.col("source") == called_by).select(F.col("target").alias("id")), "id", "left_semi")
    if orphans:
        out = out.join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    return out if limit is None else out.orderBy("id").limit(limit)
