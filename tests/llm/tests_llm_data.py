"""Small tables for the pipeline: good and bad texts, copies, leaks."""

import random

import pandas as pd


def write_tables(folder: str) -> dict[int, dict]:
    r = random.Random(12)
    words = ["".join(r.choice("aeioustrnl") for _ in range(r.randrange(3, 8))) for _ in range(600)]
    item = " ".join(r.choice(words) for _ in range(14))
    docs: dict[int, dict] = {}
    for i in range(120):
        kind = i % 6
        w = [r.choice(words) for _ in range(r.randrange(40, 120))]
        d = {"good": kind != 5, "copy_of": None, "leak": False}
        if kind == 5:
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind == 1 and docs[i - 1]["good"]:
            text, d["copy_of"] = docs[i - 1]["text"] + " tail", i - 1
        elif kind == 3:
            text, d["leak"] = " ".join(w[:20]) + " " + item.upper() + " " + " ".join(w[20:]), True
        else:
            text = " ".join(w)
        docs[i] = d | {"text": text}
    pd.DataFrame({"doc_id": list(docs), "text": [d["text"] for d in docs.values()], "lang": "en", "source": [f"s{i % 4}" for i in docs], "n_chars": [len(d["text"]) for d in docs.values()]}).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame({"doc_id": list(docs), "quality": [int(d["good"]) for d in docs.values()], "toxic": 0}).to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(f"{folder}/benchmark.parquet")
    return docs
