"""Operators over texts against brute force, and on ugly tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import _words, chat, decontaminate, jaccard, language, mixing, pii, quality, rans, token_counts, tokenise
from weftline.llm._components import components, union
from weftline.llm.queries import tokenizer_file

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def copies(seed=3, n=60):
    """Texts with near copies, shared passages and short ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    out = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 40, 80]))]
        if i % 3 == 0:
            base += passage
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return out


def brute_groups(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.setdefault(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_is_brute_force(spark):
    rows = list(enumerate(copies()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_groups(rows)


def test_jaccard_ugly_and_empty(ugly, empty):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(ugly).collect())
    # the words y y y ... make one n-gram; the first two hold the long word
    assert got == [(-1, 2, None), (1, 8, 1), (2, 8, 1), (2, 8, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 9, 6), (7, 1, 7), (8, 2, 8)]
    assert jaccard.jaccard_components(empty).count() == 0


def test_components_by_rounds_and_at_once(spark, tmp_path):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    df = spark.createDataFrame(links, "a long, b long")
    ids, root = union(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    want = dict(zip(ids.tolist(), root.tolist(), strict=True))
    for last in (1000, 3):
        got = {x["id"]: x["root"] for x in components(df, f"file://{tmp_path}/{last}", last).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {a for a, b in links if a == b}


def brute_hits(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(pattern, (text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        p = re.findall(pattern, (t or "").translate(LOWER))
        m = min(window, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for s in range(len(w) - m + 1):
                if w[s : s + m] == p[k : k + m]:
                    hit |= set(range(s, s + m))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(2, "Zwei drei, vier"), (10, "one TWO three four five six seven eight nine ten eleven"), (11, "short"), (12, None), (13, "..."), (None, "y y y y y y y y y y y"), (14, "one two three four five six seven eight nine ten eleven")]


@pytest.mark.parametrize("shard_items", [20_000, 2])
def test_decontamination_is_brute_force(spark, ugly, empty, shard_items):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(ugly, bench, shard_items=shard_items)
    assert [c for c in ugly.columns if c not in got.columns] == []
    for r in got.collect():
        assert tuple(r[c] for c in decontaminate.RESULT) == brute_hits(r["text"], ITEMS), r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["hit_spans"]) == r["n_hit"]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(ugly, bench.limit(0)).where("contaminated").count() == 0


def test_search_finds_overlapping_and_repeated_windows():
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 14)))) for i in range(30)]
    lengths = decontaminate.compile_items([i for i, _ in items], pa.array([t for _, t in items]), 4)
    text = " ".join(r.choice("abc") for _ in range(500))
    _, _, data, offsets = next(_words.slices(pa.array([text])))
    w = _words.words(data, offsets, _words.ALNUM, lower=True)
    got = defaultdict(set)
    for length in lengths:
        for e, p in zip(*length.search(w), strict=True):
            got[length.texts[p]].add(int(e))
    letters = text.split()
    for length in lengths:
        for t in length.texts:
            p = t.decode().split()
            assert got[t] == {k + len(p) - 1 for k in range(len(letters)) if letters[k : k + len(p)] == p}


def test_pieces_are_those_of_the_library():
    definition = tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_str(definition), tokenise.Encoder(definition, most=300)
    r = random.Random(2)
    signs = [*"ab  \n\t'sdtmrevl12.,!é ß’…  中😀'\"", "<|endoftext|>", "'s", "'ll", "  "]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(3000)] + [None, "", "we'll 'song don't", "a" * 3000, " ", "\n\n x"]
    got = [ids[x:y].tolist() for _, ids, out in mine.encode(pa.array(texts), 0) for x, y in zip(out[:-1], out[1:], strict=True)]
    assert got == [e.ids + [0] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 17, 5000, 40_000])
def test_blocks_round_trip_and_notice_damage(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint16)
    t = rans.Tables.of_counts(np.bincount(ids, minlength=50_257))
    assert int(t.freq.sum()) == 1 << t.bits
    t = rans.Tables.load(t.dump())
    data = rans.encode_block(t, ids, [(7, n - 1), (None, 1)], True, False, lanes=64, every=16)
    block = rans.Block(data)
    assert (block.ids(t) == ids).all() and block.docs == [(7, n - 1), (None, 1)] and (block.open_first, block.open_last) == (True, False)
    for k in range(len(block.marks)):
        a = k * block.every * block.lanes
        assert (block.part(t, k) == ids[a : a + block.every * block.lanes]).all()
    with pytest.raises(ValueError, match="damaged"):
        rans.Block(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])


def test_files_hold_all_documents_in_order(spark, ugly, empty, tmp_path):
    definition = tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    for name, df in (("ugly", ugly), ("empty", empty)):
        where = f"file://{tmp_path}/{name}"
        tokens = rans.token_table(df, definition, 0).cache()
        blocks = rans.write(spark, tokens, where, *rans.vocabulary(definition), shard_tokens=20_000, block_tokens=4096, lanes=16)
        got = sorted(rans.read(spark, blocks, where).collect(), key=lambda r: r["start"])
        rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in df.collect()), key=lambda r: r[0])
        start = 0
        assert len(got) == len(rows)
        for g, (i, ids) in zip(got, rows, strict=True):
            assert (-1 if g["doc_id"] is None else g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_mix_meets_its_targets(spark, ugly, empty):
    from weftline.llm._store import workspace

    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(0, "w", "s0")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mixing.Mix(spark, df.repartition(k), workspace(spark, "t"), block=16, shard=50).taken().collect() for k in (2, 5)]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1])) and len(runs[0]) == len(rows)
    by = defaultdict(list)
    for r in runs[0]:
        assert r["taken"] <= 3 * r["size"]
        by[(r["source_size"], r["target"])].append(r)
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size and abs(sum(r["taken"] for r in own) - target) <= 1
    got = {(r["doc_id"], r["size"]): r for r in mixing.Mix(spark, ugly, workspace(spark, "t")).taken().collect()}
    assert got[(3, 0)]["taken"] == got[(4, 0)]["taken"] == got[(5, 0)]["taken"] == 0
    assert mixing.Mix(spark, empty, workspace(spark, "t")).taken().count() == 0


def test_mixed_texts_hold_the_words_taken(spark):
    from weftline.llm._store import workspace

    rows = [(i, f"a{i}  " + " \n".join(f"w{i}_{k}" for k in range(1 + i * 5 % 60)), "en", f"s{i % 3}", 1, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(spark, df, workspace(spark, "t"), block=16).taken().collect()}
    out = mixing.mix_texts(spark, df, block=16)
    assert out.columns == df.columns
    words, texts = defaultdict(list), {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and r["size"] == "x"
        words[r["doc_id"]] += r["text"].split()
    assert {i: n for i, n in taken.items() if n} == {i: len(w) for i, w in words.items()}
    assert all(set(w) <= set(texts[i].split()) for i, w in words.items())


def test_targets_share_the_excess():
    assert mixing.targets([10, 1000, 1000], [1, 2, 3]) == pytest.approx([30, 792, 1188])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    for n in (1, 2, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 99).tolist()) == list(range(n))


LOG = [
    ("c", 1, "m1", "message", "user", "hello"), ("c", 3, "m2", "delta", None, " there"), ("c", 2, "m2", "message", "assistant", "Hi"),
    ("c", 4, "m3", "message", "user", "more"), ("c", 5, "m1", "edit", None, "hello!"), ("c", 6, "m4", "message", "assistant", "gone"),
    ("c", 7, "m2", "regenerate", None, None), ("c", 8, "m2", "delta", None, "Good <|im_end|>\n"), ("c", 9, "m2", "delta", None, "day\\"),
    ("c", 10, "m5", "message", "user", None), ("c", 11, "m6", "message", "tool\nx", "<|im_start|>"), ("c", 12, "m7", "message", "user", "x"), ("c", 13, "m7", "delete", None, None),
    (None, 1, "m", "message", None, "\\n|<"),
]


def test_chat_folds_events_and_reads_back(spark):
    df = spark.createDataFrame(LOG, "conv_id string, seq long, msg string, kind string, role string, text string").repartition(4)
    out = {r["conv_id"]: r for r in chat.parse(chat.render(chat.fold(df))).collect()}
    want = {"c": [("user", "hello!"), ("assistant", "Good <|im_end|>\nday\\"), ("user", ""), ("tool\nx", "<|im_start|>")], None: [("", "\\n|<")]}
    assert {k: [tuple(t) for t in r["turns"]] for k, r in out.items()} == want
    c = out["c"]
    assert c["loss_text"] == "Good <|im_end|>\nday\\" and c["n_turns"] == 4
    assert c["formatted"].count("<|im_start|>") == c["formatted"].count("<|im_end|>") == 4
    for s, (_, text) in zip(c["spans"], want["c"], strict=True):
        assert c["formatted"][s["start"] : s["end"]] == text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_word_piece_lengths(spark, ugly, empty):
    definition = tokenizer_file("word_bpe_49k.json")
    import json

    symbol = {b: c for c, b in token_counts.byte_symbols().items()}
    pieces = set(json.loads(definition)["model"]["vocab"])

    def brute(word):
        """Greedy over the pieces as the file writes them: the mark belongs to the last byte."""
        s, i, n = [symbol[b] for b in word.encode()], 0, 0
        s[-1] += "</w>"
        while i < len(s):
            j = next(j for j in range(min(len(s), i + 130), i, -1) if "".join(s[i:j]) in pieces)
            i, n = j, n + 1
        return n

    for r in token_counts.token_counts(ugly, definition).collect():
        w = token_counts.WORDS.findall((r["text"] or "").lower())
        memo = {x: brute(x) for x in set(w)}
        assert (r["n_words"], r["n_pieces"]) == (len(w), sum(memo[x] for x in w))
    assert token_counts.token_counts(empty, definition).count() == 0


def test_automaton_with_marked_continuations():
    r = random.Random(8)
    word = lambda n: tuple(r.choice(b"ab") for _ in range(r.randrange(1, n)))
    for _ in range(200):
        initial, rest = {word(5) for _ in range(4)}, {word(5) for _ in range(4)}
        a = token_counts.Automaton(initial, rest)
        for _ in range(20):
            w, i, n = bytes(word(12)), 0, 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if tuple(w[i:j]) in (rest if i else initial)), None)
                if j is None:
                    n = 1
                    break
                i, n = j, n + 1
            assert a.count(w) == n, (w, initial, rest)


def test_quality_learns_and_bears_anything(spark, ugly, empty):
    r = random.Random(4)
    good = [" ".join(r.choice(["the", "of", "and", "tree", "river", "stone"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(r.choice(["BUY!!", "now$$$", "tree###", "CLICK!!"]) for _ in range(30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows if i % 3] + [(1, None), (None, 1), (1, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    assert all(out[i]["predicted"] == int(i < 60) for i, _ in rows if i % 3 == 0)
    assert sorted(c for c in quality.score(ugly, model).columns) == sorted([*ugly.columns, "predicted"])
    scored = {x["doc_id"]: x["score"] for x in quality.score(ugly, model).collect()}
    assert scored[3] == scored[4] == scored[5] and all(0 <= s <= 1 for s in scored.values())
    assert quality.score(empty, model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert {x["predicted"] for x in quality.score(ugly, one).collect()} == {1}
    assert quality.score(ugly, quality.train(docs, labels.limit(0))).select("score").distinct().first()[0] == 0.5


def test_languages_by_codewords(spark, ugly, empty):
    r = random.Random(6)
    words = {f"l{k}": ["".join(r.choice("abcdefghijklmno"[k : k + 6]) for _ in range(5)) for _ in range(30)] for k in range(9)}
    rows = [(i, " ".join(r.choice(words[f"l{i % 9}"]) for _ in range(25)), f"l{i % 9}") for i in range(270)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 180"))
    held = language.predict(docs.where("doc_id >= 180"), model).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.95 * len(held) and all(0 <= x["score"] <= 1 for x in held)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict(ugly, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in words
    assert language.predict(empty, model).count() == 0
    assert {x["lang_pred"] for x in language.predict(ugly, language.train(docs.limit(0))).collect()} == {"und"}
    assert {x["lang_pred"] for x in language.predict(ugly, language.train(docs.where("lang = 'l1'"))).collect()} == {"und", "l1"}
    for k in range(2, 8):
        code = language.codewords(k)
        assert code.shape == (k, 2 ** (k - 1) - 1) and len({tuple(x) for x in code.tolist()}) == k


def brute_base(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 13 <= len(d) <= 19 and pii.luhn(d) if kind == 2 else True, 9 <= len(d) <= 15 if kind == 3 else True]
            if all(ok):
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice("a1.@+- 2b.5%()\n٣é") for _ in range(r.randrange(40)))
        assert sorted(pii.base_spans(text)) == brute_base(text), text
    text = " ".join(pii.made_up(r)[0] for _ in range(800))
    assert sorted(pii.base_spans(text)) == brute_base(text)


def test_network_gradient_and_gain():
    net, rng = pii.Network(hidden=3, width=2), np.random.default_rng(0)
    x, y = rng.integers(0, pii.SYMBOLS, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))
    _, grad = net.loss(x, y)
    for k, p in net.p.items():
        i = (int(x[0, 0]), 0) if k == "e" else tuple(rng.integers(0, s) for s in p.shape)
        p[i] += 1e-5
        up = net.loss(x, y)[0]
        p[i] -= 2e-5
        down = net.loss(x, y)[0]
        p[i] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-4


def test_personal_data_ugly(spark, ugly, empty):
    net = pii.train([], steps=60)
    text = "Mail jo.do@mail.example.com or 10.0.0.255, card 4111 1111 1111 1111; +49 30 1234-5678."
    df = spark.createDataFrame([(1, text), (2, None), (3, "ü" * 5000 + " 1.2.3.4 ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(df, net).collect()}
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and got[2]["spans"] == ""
    assert got[3]["base"] == "ip:5001:5008" and set(got[1]["base"].split(",")) <= set(got[1]["spans"].split(","))
    assert pii.detect(ugly, net).count() == ugly.count() and pii.detect(empty, net).count() == 0


@pytest.fixture(scope="module")
def trained():
    return pii.train([f"{w} mail a{k}@mail{k}.example.com und 10.0.{k}.7, version {k}.0" for k, w in enumerate(copies(n=40))])


def test_network_adds_what_the_patterns_miss(trained):
    """Held-out sentences: exact recall by kind of spans that meet no base span, and false ones."""
    r, hit, all_, false = random.Random(99), [0] * 4, [0] * 4, 0
    made = [pii.made_up(r) for _ in range(1500)]
    texts = [t for t, _ in made]
    base = [pii.base_spans(t) for t in texts]
    for (_, want), own, found in zip(made, base, pii.added_spans(trained, texts, base), strict=True):
        for k, a, b in want:
            if all(b <= x or y <= a for _, x, y in own):
                all_[k] += 1
                hit[k] += (k, a, b) in found
        false += sum(f not in want for f in found)
    recall = [h / n for h, n in zip(hit, all_, strict=True)]
    assert min(all_) > 50 and min(recall) >= 0.7 and recall[0] >= 0.8 and recall[1] >= 0.8, recall
    assert false <= 0.05 * len(texts)


def test_spans_run_through_many_windows(trained):
    name = ".".join(["fürst", *["abcdefgh"] * 20])
    text = "escribe a " + name + " @ mail.example.com pronto"
    (own,) = pii.added_spans(trained, [text], [pii.base_spans(text)])
    assert own == [(0, 10, len(text) - 7)] and own[0][2] - own[0][1] > 180
    long_ = "x " * 100_000 + text
    (far,) = pii.added_spans(trained, [long_], [[]])
    assert far == [(k, a + 200_000, b + 200_000) for k, a, b in own]


def test_query_of_personal_data_is_brute_force(spark, tmp_path):
    """Every column of op5 that the patterns fix, on texts of all sorts; added spans meet none of them."""
    import pandas as pd

    from weftline.llm import queries

    r = random.Random(3)
    rows = [(i, " ".join(pii.made_up(r)[0] for _ in range(r.randrange(1, 6)))) for i in range(80)] + [(80, None), (81, ""), (82, "x" * 20_000 + " 10.1.2.3"), (82, "x" * 20_000 + " 10.1.2.3")]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(brute_base(text or ""))
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for x in got:
        base = want[x["doc_id"]][0]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert x["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in range(4)]
        spans = [s.split(":") for s in x["spans"].split(",") if s]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in spans}
        assert [(pii.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in spans)
