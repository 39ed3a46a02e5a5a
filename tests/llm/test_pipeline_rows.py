"""The pipeline's stages by rows: null and repeated ids, copies, bare texts, clashing columns, empty tables."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as C
from weftline.llm import mixing
from weftline.llm._store import running, workspace

A = " ".join(f"w{i}" for i in range(40))
STAGE = dict(C.STAGES)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    pd.DataFrame({"doc_id": [1, 2], "quality": [1, 1], "toxic": [0, 0]}).to_parquet(f"{where}/labels.parquet")
    pd.DataFrame({"item_id": [1], "text": ["seven eight nine ten eleven twelve seven eight nine ten"]}).to_parquet(f"{where}/benchmark.parquet")
    return where


def test_one_row_of_each_group_stays(spark, folder):
    rows = [(2, A, "x"), (5, "completely different words stand here in this row of the table", "x"), (5, A + " tail", "x"), (None, "another text that has nothing in common with any other one", "x"), (None, A + " q", "x"), (7, None, "x"), (7, None, "x"), (None, " ", "x"), (9, "said once and said again by a copy of the row", "b"), (9, "said once and said again by a copy of the row", "a"), (9, "said once and said again by a copy of the row", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(4)
    got = sorted(map(repr, map(tuple, STAGE["near_duplicates"](spark, docs, folder).collect())))
    assert got == sorted(map(repr, [rows[0], rows[1], rows[3], rows[5], rows[6], rows[7], rows[9]]))


def test_stages_on_ugly_and_empty_tables(spark, folder, ugly, empty):
    names = ["hit_spans", "n_hit", "predicted", "row", "_size", "_h", "_runs", "size", "i", "k", "sid", "start", "bucket", "_level"]
    for docs in (ugly, empty):
        for n in names:
            docs = docs.withColumn(n, docs["lang"])
        for name, stage in C.STAGES[:4]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            if docs.isEmpty():
                assert out.isEmpty()
            elif name != "mix":
                assert {repr(r) for r in out.collect()} <= {repr(r) for r in docs.collect()}
        assert STAGE["tokens"](spark, docs, folder).count() == docs.count()
    assert {r["doc_id"] for r in STAGE["near_duplicates"](spark, ugly, folder).collect()} == {1, 3, 4, 5, 6, 7, 8, None}


def test_taken_is_what_the_slots_say(spark):
    """Recomputes every document's taken words from the slots, block by block."""
    rows = [(i, " ".join(["w"] * (1 + i * 13 % 70)), f"s{i % 4}" if i % 9 else None) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.Mix(spark, docs, workspace(spark, "t"), block=16, shard=40, rows_a_bucket=10)
    slots, placed = m.slots.collect(), m.placed.collect()
    assert sorted(s["slot"] for s in slots if s["shard"] == 0) == list(range(40))
    for sid in {p["sid"] for p in placed}:
        own = sorted((p for p in placed if p["sid"] == sid), key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0, *(p["size"] for p in own)])[:-1].tolist()
    got = {r["doc_id"]: r["taken"] for r in m.taken().collect()}
    for p in placed:
        words = Counter()
        for s in slots:
            if s["sid"] == p["sid"]:
                lo, hi = max(p["start"], s["block"] * 16), min(p["start"] + p["size"], s["block"] * 16 + s["words"])
                words.update(range(lo, hi))
        assert sum(words.values()) == got[p["doc_id"]]
    goal = {p["sid"]: p["target"] for p in placed}
    for sid, target in goal.items():
        assert abs(sum(s["words"] for s in slots if s["sid"] == sid) - target) <= 1


def test_shards_are_drawn_alike_from_any_range():
    slots = [1000, 3, 0, 517]
    every = list(mixing.draw(slots, 64, 7))
    assert [k for k, _, _ in every] == list(range(24)) and sum(c for _, _, c in every).tolist() == slots
    for k, first, count in every:
        (one,) = mixing.draw(slots, 64, 7, k, k + 1)
        assert one[0] == k and one[1].tolist() == first.tolist() and one[2].tolist() == count.tolist()
        assert count.sum() == (64 if k < 23 else sum(slots) - 23 * 64)
    for n in (1, 2, 17, 1000):
        x = mixing.permute(np.arange(n), n, 5)
        assert [mixing.inverse(int(y), n, 5) for y in x] == list(range(n))


def test_running_sums(spark):
    rows = [(f"k{i % 3}" if i % 5 else None, i * 7 % 101, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    for r in running(df, "o", {"before": "v"}, "k", width=10).collect():
        assert r["before"] == sum(v for k, o, v in rows if k == r["k"] and o < r["o"])
    for r in running(df, "o", {"before": "v"}, width=7).collect():
        assert r["before"] == sum(v for _, o, v in rows if o < r["o"])


def test_words_of_the_mix_are_those_of_the_text(spark):
    text = "é  日本\tx\n" + " ".join(f"ü{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text, "a" if i else "b") for i in range(4)], "doc_id long, text string, source string")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    for r in mixing.mix_texts(spark, docs, block=8, shard=10).collect():
        got = r["text"].split(" ") if r["text"] != text else words
        assert all(w in words or set(re.findall(r"[^\x20\x09-\x0D]+", w)) <= set(words) for w in got)
