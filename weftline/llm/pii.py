"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Every text is scanned whole. The fixed patterns give the base spans; all of them stay.
No span of any kind passes its check without a digit or an @, so windows of WIDTH
characters, half overlapping, lie wherever one is near, and nowhere else could a span be
added. A small network (numpy only) scores tags B/I by kind for every character, Viterbi
decodes each window, and the windows are reconciled over the whole text: every character
takes its tag from the window in whose middle it lies, and spans are read from the joined
tags, so a span may run through many windows. A span is added, moved to whole words or
numbers, if it meets no base span, the network is sure of it (mean probability of its
tags), and its characters pass the check of its kind (Luhn, parts to 255, number of
digits, 254 characters of an e-mail). Of added spans that meet the surer stays, of equal
ones the first.

The network is trained on the driver from labelled spans: sentences made up around
made-up data in many spellings, and windows of at most ``max_train`` documents of at most
``max_chars`` characters that hold a base span, or too few digits for any.

A null text is empty. Very long texts are read whole. Offsets are code points, ends
exclusive. Repeated rows count each. Input columns named like a result column are
replaced. An empty table gives an empty result; training then uses the made-up sentences
alone.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import _words as W
from weftline.llm._store import tidy

KINDS = ("email", "ip", "card", "phone")
WIDTH, MAX_TRAIN, MAX_CHARS, SURE = 64, 200, 5_000, 0.5
LONGEST = 254  # characters of an e-mail address
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]+")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check; linear in the text."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = [p.span() for p in NUMBER.finditer(text, *m.span())]
            for k in range(0, len(parts) - 3, 4):
                if all(small(text[a:b]) for a, b in parts[k : k + 4]):
                    out.append((1, parts[k][0], parts[k + 3][1]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def valid(kind: int, s: str) -> bool:
    """The check that an added span must pass."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == 0:
        domain = s.partition("@")[2].strip(". ")
        return len(s) <= LONGEST and s.count("@") == 1 and "." in domain and not domain.replace(".", "").isdigit() and all(len(x.strip()) > 1 for x in s.split("@"))
    if any(c.isalpha() for c in s):
        return False
    groups = NUMBER.findall(s)
    if kind == 1:
        return len(groups) == 4 and all(map(small, groups))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(groups) >= 2 and (s[0] in "(+" or s[0].isdigit())


_OWN = " \n.,@+-()_%:/#[]='\"!?*&$"


def symbols(text: str) -> np.ndarray:
    """Each character's class: 0 outside, letters by themselves, digits as one, some signs by themselves."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(130, 2, np.int64)
    table[48:58] = 3
    for k in range(26):
        table[97 + k] = table[65 + k] = 4 + k
    for k, s in enumerate(_OWN):
        table[ord(s)] = 30 + k
    table[128] = 1  # letters and signs beyond ASCII
    return table[np.minimum(c, 128)]


SYMBOLS = 30 + len(_OWN)
TAGS = 1 + 2 * len(KINDS)


def tags(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


class Network:
    """Embedding, one LSTM each way (the second reads from the end), tag scores and transitions."""

    def __init__(self, hidden: int = 20, width: int = 12, seed: int = 1, dtype: type = np.float64):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[-2]), s)
        bias = np.zeros((2, 1, 4 * hidden))
        bias[:, :, hidden : 2 * hidden] = 1
        p = {"e": r.normal(0, 0.5, (SYMBOLS, width)), "x": g(2, width, 4 * hidden), "h": g(2, hidden, 4 * hidden), "c": bias, "o": g(2 * hidden, TAGS), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        self.h, self.p = hidden, {k: v.astype(dtype) for k, v in p.items()}

    def scores(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.p["e"][x]
        n, t, w = e.shape
        both = np.stack([e, e[:, ::-1]])
        z = (both.reshape(2, n * t, w) @ self.p["x"] + self.p["c"]).reshape(2, n, t, -1)
        h, steps = self.h, []
        out = np.zeros((2, n, t, h), z.dtype)
        a, c = np.zeros((2, n, h), z.dtype), np.zeros((2, n, h), z.dtype)
        for k in range(t):
            y = z[:, :, k] + a @ self.p["h"]
            gate = 1 / (1 + np.exp(-np.clip(y[..., : 3 * h], -30, 30)))
            new = np.tanh(y[..., 3 * h :])
            c0, a0 = c, a
            c = gate[..., h : 2 * h] * c0 + gate[..., :h] * new
            tc = np.tanh(c)
            a = gate[..., 2 * h :] * tc
            out[:, :, k] = a
            if keep is not None:
                steps.append((gate, new, c0, a0, tc))
        both_ways = np.concatenate([out[0], out[1][:, ::-1]], 2)
        if keep is not None:
            keep |= {"in": both, "steps": steps, "both": both_ways}
        return both_ways @ self.p["o"] + self.p["ob"]

    def _back(self, d: np.ndarray, keep: dict, grad: dict) -> np.ndarray:
        """d: gradient of the states, by way and step; returns that of the embeddings."""
        h, e = self.h, keep["in"]
        de = np.zeros_like(e)
        da, dc = np.zeros((2, e.shape[1], h), e.dtype), np.zeros((2, e.shape[1], h), e.dtype)
        for k in range(e.shape[2] - 1, -1, -1):
            gate, new, c0, a0, tc = keep["steps"][k]
            da = da + d[:, :, k]
            i, f, o = gate[..., :h], gate[..., h : 2 * h], gate[..., 2 * h :]
            dc = dc + da * o * (1 - tc * tc)
            y = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), da * tc * o * (1 - o), dc * i * (1 - new * new)], 2)
            grad["x"] += e[:, :, k].transpose(0, 2, 1) @ y
            grad["h"] += a0.transpose(0, 2, 1) @ y
            grad["c"] += y.sum(1, keepdims=True)
            de[:, :, k] = y @ self.p["x"].transpose(0, 2, 1)
            da, dc = y @ self.p["h"].transpose(0, 2, 1), dc * f
        return de[0] + de[1][:, ::-1]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        keep: dict = {}
        s = self.scores(x, keep)
        n, t, _ = s.shape
        tr = self.p["t"]
        al, be = np.zeros_like(s), np.zeros_like(s)
        al[:, 0] = s[:, 0] + self.p["s"]
        for k in range(1, t):
            al[:, k] = s[:, k] + _lse(al[:, k - 1][:, :, None] + tr, 1)
        for k in range(t - 2, -1, -1):
            be[:, k] = _lse((s[:, k + 1] + be[:, k + 1])[:, None, :] + tr, 2)
        z = _lse(al[:, -1], 1)
        post = np.exp(al + be - z[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(t)
        gold = s[rows, cols, y].sum() + tr[y[:, :-1], y[:, 1:]].sum() + self.p["s"][y[:, 0]].sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        ds = post.copy()
        ds[rows, cols, y] -= 1
        pair = np.exp(al[:, :-1, :, None] + tr + (s + be)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
        grad["t"], grad["s"] = pair / n, ds[:, 0].sum(0) / n
        ds /= n
        grad["o"] = np.einsum("ntk,ntj->kj", keep["both"], ds)
        grad["ob"] = ds.sum((0, 1))
        dboth = ds @ self.p["o"].T
        de = self._back(np.stack([dboth[:, :, : self.h], dboth[:, ::-1, self.h :]]), keep, grad)
        np.add.at(grad["e"], x, de)
        return float((z.sum() - gold) / n), grad

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and the probability of each among all sequences."""
        s, tr = self.scores(x), self.p["t"]
        n, t, _ = s.shape
        best, link = s[:, 0] + self.p["s"], np.zeros(s.shape, np.int64)
        al, be = np.zeros_like(s), np.zeros_like(s)
        al[:, 0] = best
        for k in range(1, t):
            step = best[:, :, None] + tr
            link[:, k] = step.argmax(1)
            best = step.max(1) + s[:, k]
            al[:, k] = s[:, k] + _lse(al[:, k - 1][:, :, None] + tr, 1)
        for k in range(t - 2, -1, -1):
            be[:, k] = _lse((s[:, k + 1] + be[:, k + 1])[:, None, :] + tr, 2)
        y = np.zeros((n, t), np.int64)
        y[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            y[:, k - 1] = link[np.arange(n), k, y[:, k]]
        p = np.exp(al + be - _lse(al[:, -1], 1)[:, None, None])
        return y, np.take_along_axis(p, y[:, :, None], 2)[:, :, 0]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)


def made_up(r: random.Random) -> tuple[str, list[Span]]:
    """A stretch of text around one or no made-up span."""
    some = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    word = lambda: some("abcdefghijklmnopqrstuvwxyzéüñ", 2, 9)
    ascii_word = lambda: some("abcdefghijklmnopqrstuvwxyz", 2, 8)
    digits = lambda n: some("0123456789", n, n)
    kind = r.choice([0, 0, 1, 2, 3, 3, -1, -1, -1])
    if kind == 0:
        name = r.choice([".", "", "_", "+", "-"]).join([r.choice([ascii_word, word])(), r.choice([ascii_word(), digits(2), word()])])
        if r.random() < 0.1:
            name = ".".join([name, *(word() for _ in range(r.randint(2, 6)))])
        s = name + r.choice(["@", "@", " @ ", "@ ", " @"]) + r.choice([".", ".", ".", "-"]).join([r.choice([ascii_word, word])(), r.choice(["mail", digits(1), ascii_word()])]) + "." + r.choice(["com", "org", "example.com", "de", "net", "co.uk"])
    elif kind == 1:
        s = r.choice([".", " . ", "[.]", ". ", " ."]).join(str(r.randint(0, 255)) for _ in range(4))
    elif kind == 2:
        d = digits(r.randint(13, 19))[:-1]
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "/", "_", "  ", " - "])
        s = sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    elif kind == 3:
        sep = r.choice(["-", " ", ".", " - ", "/"])
        s = r.choice(["+" + digits(2) + sep, "+ " + digits(2) + sep, "(" + digits(3) + ") ", "00" + digits(2) + sep, "0" + digits(3) + r.choice(["/", " ", "-"]), digits(3) + sep]) + sep.join(digits(r.randint(3, 4)) for _ in range(r.randint(2, 3)))
    else:
        date = f"{digits(4)}-{digits(2)}-{digits(2)}"
        s = r.choice([digits(r.randint(1, 8)), date, f"{date} {digits(2)}:{digits(2)}:{digits(2)}", f"{date}T{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", some("0123456789abcdef", 32, 40), f"${digits(3)},{digits(3)}", "@" + ascii_word(), f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}/{digits(2)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(2)}.{digits(4)}, {digits(2)}.{digits(4)}", f"pp. {digits(3)}-{digits(3)}", ", ".join(digits(r.randint(2, 4)) for _ in range(r.randint(2, 5))), f"{ascii_word()} @ {ascii_word()} {ascii_word()}"])
    left = " ".join(word() for _ in range(r.randint(0, 6))) + r.choice([" ", "\n", " (", ": ", "= "]) if r.random() < 0.95 else ""
    right = r.choice([" ", ". ", ", ", "\n", ") ", "### ", "; "]) + " ".join(word() for _ in range(r.randint(1, 6))) if r.random() < 0.95 else ""
    return left + s + right, [(kind, len(left), len(left) + len(s))] if kind >= 0 else []


def train(texts: list[str], steps: int = 700, batch: int = 48, seed: int = 4) -> Network:
    """texts: documents whose base spans serve as labels beside the made-up ones."""
    r, net, pool = random.Random(seed), Network(dtype=np.float32), []
    for text in texts:
        spans = base_spans(text)
        for m in re.finditer(r"[0-9@]", text):
            a = max(0, m.start() - r.randint(8, WIDTH - 8))
            if not pool or pool[-1][2] != (id(text), a // 16):
                own = [(k, x - a, y - a) for k, x, y in spans if x >= a and y <= a + WIDTH]
                part = text[a : a + WIDTH]  # without a base span it teaches only if it can hold no span at all
                bare = "@" not in part and sum(c.isdigit() for c in part) < 9 and len(NUMBER.findall(part)) < 4
                if (own or bare) and all(not (x < a < y or x < a + WIDTH < y) for _, x, y in spans):
                    pool.append((text[a : a + WIDTH], own, (id(text), a // 16)))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        x, y = np.zeros((batch, WIDTH), np.int64), np.zeros((batch, WIDTH), np.int64)
        for k in range(batch):
            if pool and k % 6 == 0:
                text, spans, _ = r.choice(pool)
            else:
                text, spans = made_up(r)
                cut = max(0, r.randint(-len(text), max(0, len(text) - 8)))  # a window may begin and end within a span
                text, spans = text[cut : cut + WIDTH], [(q, max(0, a - cut), min(WIDTH, b - cut)) for q, a, b in spans if b > cut and a < cut + WIDTH]
            x[k, : len(text)] = symbols(text)
            y[k, : len(text)] = tags(len(text), spans)
        _, grad = net.loss(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 5 / norm) * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(g.dtype)
    return net


def windows(text: str) -> list[int]:
    """Starts of half-overlapping windows that cover all within half a window of a digit or an @."""
    half, out = WIDTH // 2, []
    for m in re.finditer(r"[0-9@]+", text):
        for k in range(max(0, m.start() // half - 1), m.end() // half + 1):
            if not out or k * half > out[-1]:
                out.append(k * half)
    return out


def joined_tags(net: Network, texts: list[str], chunk: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text every character's tag and its probability, from the window in whose middle it lies; 0 where no window is."""
    quarter = WIDTH // 4
    out = [(np.zeros(len(t), np.int8), np.zeros(len(t), np.float32)) for t in texts]
    jobs = []
    for i, text in enumerate(texts):
        starts = windows(text)
        near = set(starts)
        jobs += [(i, a, quarter if a - WIDTH // 2 in near else 0, WIDTH - quarter if a + WIDTH // 2 in near else WIDTH) for a in starts]
    coded: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
    for lo in range(0, len(jobs), chunk):
        part = jobs[lo : lo + chunk]
        x = np.zeros((len(part), WIDTH), np.int64)
        for k, (i, a, *_) in enumerate(part):
            if coded[0] != i:
                coded = (i, symbols(texts[i]))
            s = coded[1][a : a + WIDTH]
            x[k, : len(s)] = s
        y, p = net.decode(x)
        for k, (i, a, b, e) in enumerate(part):
            e = min(e, len(texts[i]) - a)
            out[i][0][a + b : a + e], out[i][1][a + b : a + e] = y[k, b:e], p[k, b:e]
    return out


def added_spans(net: Network, texts: list[str], bases: list[list[Span]], sure: float = SURE) -> list[list[Span]]:
    """The network's spans of each text, without those that meet a base span or a surer one."""
    out: list[list[Span]] = []
    for text, base, (tag, p) in zip(texts, bases, joined_tags(net, texts), strict=True):
        kinds = (tag.astype(np.int64) + 1) // 2
        edge = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (tag[1:] % 2 == 1)])) if len(tag) else np.zeros(0, np.int64)
        found = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(tag)], strict=True):
            if kinds[a] and (trust := float(p[a:b].mean())) >= sure:
                kind = int(kinds[a]) - 1
                a, b = snapped(text, kind, a, b)
                kind = kind_of(kind, text[a:b]) if a < b else kind
                if a < b and valid(kind, text[a:b]):
                    found.append((-trust, a, b, kind))
        own, taken = [], [(a, b) for _, a, b in base]
        for _, a, b, kind in sorted(found):
            apart = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if apart and all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                own.append((kind, a, b))
        out.append(own)
    return out


def snapped(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """A span moved to whole words or numbers, without signs around it."""
    inside = (lambda c: c.isalnum() or c in "._%+-") if kind == 0 else str.isdigit
    while a > 0 and inside(text[a - 1]):
        a -= 1
    while b < len(text) and (text[b].isalnum() or (kind == 0 and text[b] in ".-" and text[b + 1 : b + 2].isalnum())):
        b += 1
    while a < b and not text[a].isalnum() and not (kind == 3 and text[a] in "+("):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    if kind == 3:
        if a > 0 and text[a - 1] == "(" and text[a] != "(" and ")" in text[a:b]:
            a -= 1
        for sign in ("+", "+ "):
            if text[a - len(sign) : a] == sign and a >= len(sign):
                a -= len(sign)
        if a < b and text[a] == "(" and ")" not in text[a:b]:
            a += 1
    return a, b


def kind_of(kind: int, s: str) -> int:
    """Numbers of 13 digits and more in groups that begin with four, and pass Luhn, are cards; others fit one of the two kinds only."""
    if kind in (2, 3):
        groups = NUMBER.findall(s)
        if valid(2, s) and s[0].isdigit() and len(groups[0]) >= 4:
            return 2
        if kind == 2 and not valid(2, s) and s[0] in "+(":
            return 3
    return kind


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def labelled_sample(docs: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most max_train texts of at most max_chars characters with a digit or an @, those with the smallest hash of their id."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike("[0-9@]") & (F.length("_text") <= max_chars))
    order = F.crc32(F.col("_id").cast("string"))
    keys = rows.select("_id").where("_id is not null").distinct().orderBy(order, "_id").limit(max_train)  # ids first: tasks send no texts but the chosen
    chosen = rows.join(F.broadcast(keys), "_id").orderBy(order, "_id", "_text")
    return [r["_text"] for r in chosen.limit(max_train).collect()]


def detect(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, ...) behind their own columns."""
    added = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in added)])

    def run(batches):
        for batch in batches:
            base: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            extra: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            for a, _, data, offsets in W.slices(batch.column(text_col)):
                marks = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])[offsets]
                at = np.flatnonzero(np.diff(marks))
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in at]
                own = [base_spans(x) for x in texts]
                for i, x, y in zip(at, own, added_spans(shared.value, texts, own), strict=True):
                    base[a + i], extra[a + i] = x, y
            columns = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array([written(x) for x in base], pa.string()), pa.array([written(x + y) for x, y in zip(base, extra, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *added])

    return docs.mapInArrow(tidy(run), schema)
