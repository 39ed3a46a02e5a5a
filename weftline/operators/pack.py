"""Composite outputs: the context of one node within a budget, lines of JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbours shown, from the widest to the narrowest; default budget.
CAPS, MAX_CHARS = (12, 6, 3, 1), 8000


def context_pack(node: str, nodes: DataFrame, edges: DataFrame, max_chars: int = MAX_CHARS) -> str:
    """The node, its measures, callers and callees as text of at most max_chars. The driver gets CAPS[0] names a side."""
    row = nodes.where(F.col("id") == node).select("kind", "layer", "file").limit(1).collect()
    sides = []
    for mine, other, title in (("target", "source", "callers"), ("source", "target", "callees")):
        near = edges.where(F.col(mine) == node).select(other).distinct()
        sides.append((title, near.count(), [r[0] for r in near.orderBy(other).limit(CAPS[0]).collect()]))
    head = f"{node}\n" + (f"{row[0]['kind']} in {row[0]['layer']}, {row[0]['file']}\n" if row else "unknown\n")
    for cap in (*CAPS, 0):
        text = head + "".join(f"{title}: {n}" + "".join(f"\n  {x}" for x in names[:cap]) + "\n" for title, n, names in sides)
        if len(text) <= max_chars:
            return text
    return head[:max_chars]


def json_lines(df: DataFrame, *order: str) -> DataFrame:
    """(line) of a small result in a fixed order: identical input gives identical bytes."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"), *order).coalesce(1).sortWithinPartitions(*order).select("line")


def markdown_lines(df: DataFrame, title: str, count: str, *order: str) -> DataFrame:
    return df.select(F.concat(F.lit("- "), F.col(title), F.lit(": "), F.col(count).cast("string")).alias("line"), *order).coalesce(1).sortWithinPartitions(*order).select("line")
