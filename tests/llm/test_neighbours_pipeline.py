"""The near-duplicate graph against brute force, and the pipeline as a whole."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests_llm_data import write_tables
from weftline.llm import neighbours
from weftline.llm.queries import tokenizer_file


def test_neighbours_find_what_brute_force_finds(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 16))
    near = np.concatenate([c + 0.08 * r.normal(size=(k, 16)) for c, k in zip(centre, [2, 3, 60, 5, 2, 9, 30, 2, 2, 4, 7, 2], strict=True)])
    v = np.concatenate([near, r.normal(size=(300, 16)), near[:3], 2 * near[3:5]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [1.0, 2.0]), (1005, []), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.near_duplicates(df, cell_size=120, cap=60)
    found = defaultdict(list)
    for x in got.collect():
        found[x["vec_id"]].append(x)
    u = np.concatenate([v, v[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = [*range(len(v)), 0]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert sum(len(x) for x in found.values()) == len(rows)
    true = {i: int(n) for i, n in zip(ids, link.sum(1), strict=True)}
    assert all(x["n_links"] <= true[i] for i in set(ids) for x in found[i])
    recall = sum(found[i][0]["n_links"] for i in set(ids)) / sum(true[i] for i in set(ids))
    assert recall >= 0.9
    label = np.array(ids)
    for _ in range(50):
        for a, b in zip(*np.nonzero(link), strict=True):
            label[a] = min(label[a], label[b])
    same = sum(found[i][0]["component_id"] == label[k] for k, i in enumerate(ids)) / len(ids)
    assert same >= 0.95
    for i in (1000, 1001, 1002, 1003, 1004, 1005):
        assert (found[i][0]["n_links"], found[i][0]["component_id"], found[i][0]["kept"]) == (0, i, True)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_audit_of_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert neighbours.audit(df, neighbours.near_duplicates(df)) >= 0.9


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    import corpus_pipeline

    folder = str(tmp_path_factory.mktemp("tables"))
    docs = write_tables(folder)
    stages, df = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, folder).write.parquet(f"{folder}/stage-{k}")
        df = spark.read.parquet(f"{folder}/stage-{k}")
        stages.append(df.collect())
    return folder, docs, stages


def test_pipeline_stages(run):
    _, docs, (good, single, clean, mixed, tokens) = run
    kept = {r["doc_id"] for r in good}
    assert kept == {i for i, d in docs.items() if d["good"]}
    single_ids = {r["doc_id"] for r in single}
    for i, d in docs.items():
        if d["good"]:
            assert (i in single_ids) == (d["copy_of"] is None), i
    assert {r["doc_id"] for r in clean} == {i for i in single_ids if not docs[i]["leak"]}
    texts = {r["doc_id"]: r["text"] for r in clean}
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(n(r["text"]) for r in mixed) == pytest.approx(sum(map(n, texts.values())), abs=3)
    for r in mixed:
        assert r["text"] == texts[r["doc_id"]] or set(r["text"].split()) <= set(texts[r["doc_id"]].split())
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_file("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], len(ids := t.encode(r["text"], add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in mixed)
    assert want == sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens)
    place = 0
    for r in sorted(tokens, key=lambda r: r["start"]):
        assert r["start"] == place
        place += r["n_tokens"]


def test_pipeline_run_gives_the_last_stage(spark, run):
    import corpus_pipeline

    folder, _, stages = run
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1]))
