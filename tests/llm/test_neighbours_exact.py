"""The near-duplicate graph where links lie across many cells."""

import numpy as np

from weftline.llm import neighbours


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)


def brute_force(v):
    """Links and the least vec_id of the component, by row."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    x, y = np.nonzero(link)
    label, old = np.arange(len(v)), None
    while old is None or not np.array_equal(old, label):
        old = label.copy()
        np.minimum.at(label, x, old[y])
    return link.sum(1), label


def test_a_group_over_more_than_ten_cells_is_counted_whole(spark):
    r = np.random.default_rng(4)
    group = r.normal(size=64) + 0.24 * r.normal(size=(500, 64))  # pairwise cosines near 0.95
    v = np.concatenate([group, r.normal(size=(1000, 64))])[r.permutation(1500)]
    n, label = brute_force(v)
    assert (n > 400).sum() > 400
    got = neighbours.near_duplicates(frame(spark, v), cell_size=25, cap=40).toPandas().sort_values("vec_id")
    assert got["n_links"].tolist() == n.tolist()
    assert got["component_id"].tolist() == label.tolist()
    assert got["kept"].tolist() == (label == np.arange(len(v))).tolist()


def test_recall_is_whole_with_two_hundred_cells(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    side = r.normal(size=(1000, 64))
    side -= (side * v[:1000]).sum(1, keepdims=True) * v[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v[1000:2000] = 0.905 * v[:1000] + np.sqrt(1 - 0.905**2) * side  # just above the threshold
    n, _ = brute_force(v)
    assert n.sum() >= 2000
    df = frame(spark, v)
    got = neighbours.near_duplicates(df, cell_size=30)
    assert neighbours.audit(df, got, every=1) == 1.0
    assert got.toPandas().sort_values("vec_id")["n_links"].tolist() == n.tolist()
