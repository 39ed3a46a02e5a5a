"""Connected components of a link table without gathering it.

Each round every vertex points to its least neighbour, chains of pointers are
shortened, and the links are renamed by the roots they reach; links inside a root
vanish. Rounds are written to the workspace. Once at most LAST links remain, one task
of that bounded size ends the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._store import materialise

LAST = 500_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links (a, b) and the least vertex of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        la, lb = label[x], label[y]
        open_ = la != lb
        if not open_.any():
            return ids, ids[label]
        x, y, la, lb = x[open_], y[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _in_task(batches):
    parts = [b for b in batches if b.num_rows]
    a = np.concatenate([b.column(0).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64)
    b = np.concatenate([b.column(1).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64)
    ids, root = union(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(root, pa.int64())], ["id", "root"])


def components(links: DataFrame, where: str, last: int = LAST) -> DataFrame:
    """(id, root) for every vertex of links(a, b); root is the least id of its component.

    Self-links and repeated links are allowed; an empty table gives an empty table.
    """
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), where, "cc-links-0")
    names: DataFrame | None = None
    k = 0
    while links.limit(last + 1).count() > last:
        k += 1
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
        up = materialise(up, where, f"cc-up-{k}-0")
        j = 0
        while True:  # pointer jumping
            j += 1
            above = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            new = materialise(up.join(above, "root").select("id", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), where, f"cc-up-{k}-{j}")
            up = new.select("id", "root")
            if new.where("moved").isEmpty():
                break
        renamed = links.join(up.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        links = materialise(renamed.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), where, f"cc-links-{k}")
        if names is None:
            names = up
        else:
            to = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            names = materialise(names.join(to, "root", "left").select("id", F.coalesce("top", "root").alias("root")), where, f"cc-names-{k}")
    rest = links.repartition(1).mapInArrow(_in_task, "id long, root long")
    if names is None:
        return rest
    rest = materialise(rest, where, "cc-rest")
    to = rest.select(F.col("id").alias("root"), F.col("root").alias("top"))
    return names.join(to, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
