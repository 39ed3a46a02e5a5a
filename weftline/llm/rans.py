"""Token-ID output: static range asymmetric numeral system in independent interleaved blocks.

Files of one run, all under one folder:

* ``tables``: the token counts scaled to 2^bits, shared by all blocks.
* ``part-NNNNN``: blocks one after another, in ascending order of document id.

A block holds up to ``block_tokens`` ids, coded on ``lanes`` 64-bit states that advance
together: id i goes to lane i mod lanes. Renormalisation moves 32-bit words. A
checkpoint is all states and the word offset before a given step, the first one at
step 0; decoding can begin at any of them, so a block can be read in parts. A block
carries the crc32 of its ids and of its bytes, and which documents it holds parts of.
Blocks do not depend on each other; documents may span blocks. Where each block lies,
and how many ids and documents stand before it, is a table (a row a block), numbered by
running sums; the driver sees none of it.

Layout of a block (little-endian): 8 numbers ``<4sIIIIIII`` (magic WFB1, ids, lanes,
words, checkpoints, checkpoint distance in steps, crc32 of ids as uint32, bytes of the
document index), the index (zlib: flags, then int64 id, uint8 null, int64 count each),
checkpoints (uint32 word offset, lanes x uint64), words (uint32), crc32 of all before.

A null or empty text is an empty document (only the end id); a null id sorts first and
stays null; repeated ids and rows keep one document each, those of one id ordered by a
hash of their ids, so that the rows of one id may fill many files. A very long text
spans blocks and files' blocks are written one by one. Only the id and text columns are
read, whatever others are called. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._store import KEPT, get, materialise, open_fs, put, running, tidy, writing
from weftline.llm.tokenise import Encoder

LOW, WORD = np.uint64(1 << 31), np.uint64(32)
HEAD = struct.Struct("<4sIIIIIII")
BITS = 20
BLOCK, LANES, STEPS = 1 << 18, 512, 256
MOST_SHARDS = 100_000
TASK_BLOCKS = 32  # read by a task, one after another: about as many ids as a file holds
MANIFEST = pa.schema([("place", pa.int64()), ("uri", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n_ids", pa.int64()), ("n_done", pa.int64())])


class Tables:
    """Frequencies scaled to 2^bits, at least 1 for every id that occurs."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.low = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @staticmethod
    def of_counts(counts: np.ndarray, bits: int = BITS) -> Tables:
        used = int((counts > 0).sum())
        bits = max(bits, int(np.ceil(np.log2(used + 1))) + 2)
        share = counts / max(1, counts.sum()) * (1 << bits)
        freq = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
        while used and (gap := (1 << bits) - int(freq.sum())):
            top = np.argsort(-freq, kind="stable")[: min(used, abs(gap))]
            if gap < 0:
                top = top[freq[top] > 1]
            freq[top] += np.sign(gap) * max(1, abs(gap) // max(1, len(top)) if gap > 0 else 1)
        return Tables(freq, bits)

    def dump(self) -> bytes:
        return struct.pack("<4sII", b"WFT1", self.bits, len(self.freq)) + zlib.compress(self.freq.astype(np.uint32).tobytes())

    @staticmethod
    def load(data: bytes) -> Tables:
        magic, bits, _ = struct.unpack_from("<4sII", data)
        if magic != b"WFT1":
            raise ValueError("not a table file")
        return Tables(np.frombuffer(zlib.decompress(data[12:]), np.uint32), bits)


def encode_block(t: Tables, ids: np.ndarray, docs: list[tuple[int | None, int]], open_first: bool, open_last: bool, lanes: int = LANES, every: int = STEPS) -> bytes:
    """docs: (id, ids of it in this block). open_first / open_last: the first document began, the last one goes on, in another block."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 16))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    r = np.uint64(t.bits)
    out, written, marks = [], 0, []
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        f, y = t.freq[s], x[: len(s)]
        full = y >= f << np.uint64(63 - t.bits)
        if full.any():
            out.append((y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(out[-1])
            y[full] >>= WORD
        q = y // f
        x[: len(s)] = (q << r) + (y - q * f) + t.low[s]
        if step % every == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    index = b"".join(struct.pack("<qBq", d or 0, d is None, c) for d, c in docs)
    index = zlib.compress(struct.pack("<BB", open_first, open_last) + index)
    body = [HEAD.pack(b"WFB1", n, lanes, len(words), len(marks), every, zlib.crc32(ids.astype("<u4").tobytes()), len(index)), index]
    for w, state in reversed(marks):
        body += [struct.pack("<I", len(words) - w), state.astype("<u8").tobytes()]
    body = b"".join([*body, words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block as read; checks its bytes on the way in and its ids on the way out."""

    def __init__(self, data: bytes):
        if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged: its bytes do not match their checksum")
        magic, self.n, self.lanes, n_words, n_marks, self.every, self.crc, size = HEAD.unpack_from(data)
        if magic != b"WFB1":
            raise ValueError("not a block")
        at = HEAD.size
        index = zlib.decompress(data[at : at + size])
        self.open_first, self.open_last = (bool(v) for v in struct.unpack_from("<BB", index))
        self.docs = [(None if null else d, c) for d, null, c in struct.iter_unpack("<qBq", index[2:])]
        at += size
        self.marks = []
        for _ in range(n_marks):
            self.marks.append((struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", self.lanes, at + 4)))
            at += 4 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)

    def part(self, t: Tables, k: int) -> np.ndarray:
        """Ids from checkpoint k to the next."""
        at, x = self.marks[k][0], self.marks[k][1].astype(np.uint64)
        r, low = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
        end = min(self.n, (k + 1) * self.every * self.lanes)
        got = []
        for a in range(k * self.every * self.lanes, end, self.lanes):
            y = x[: min(self.lanes, end - a)]
            slot = y & low
            s = t.symbol[slot]
            y = t.freq[s] * (y >> r) + slot - t.low[s]
            need = y < LOW
            c = int(need.sum())
            if c:
                y[need] = (y[need] << WORD) | self.words[at : at + c]
                at += c
            x[: len(y)] = y
            got.append(s)
        return np.concatenate(got) if got else np.zeros(0, np.uint32)

    def ids(self, t: Tables) -> np.ndarray:
        ids = np.concatenate([self.part(t, k) for k in range(len(self.marks))]) if self.marks else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a block is damaged: its ids do not match their checksum")
        return ids


def token_table(docs: DataFrame, definition: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n): ids little-endian, 2 bytes each for up to 65,536 tokens, else 4."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the tokenizer's file, whatever the input

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads of the library would spin on others
        encoder = _encoder(shared.value)
        size = np.dtype(encoder.dtype).itemsize
        for batch in batches:
            for a, ids, out in encoder.encode(batch.column(1), end_id):
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(out) - 1, [None, pa.py_buffer((out * size).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(out) - 1), data.cast(pa.binary()), pa.array(np.diff(out).astype(np.int64))], ["doc_id", "ids", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, "encoders"), "doc_id long, ids binary, n long")


_encoders: dict[int, Encoder] = KEPT.setdefault("encoders", {})


def _encoder(definition: str) -> Encoder:
    """One for each worker, so that what it has learnt serves its next task."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def vocabulary(definition: str) -> tuple[int, type]:
    """Number of ids, and the type that token_table writes them in."""
    e = _encoder(definition)
    return e.size, e.dtype


def counts(tokens: DataFrame, vocabulary: int, dtype: type) -> np.ndarray:
    """Occurrences of every id: summed in each partition, then by id."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), dtype), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    out = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[row.column(0).to_numpy()] = row.column(1).to_numpy()
    return out


def _flat(column: pa.Array, dtype: type) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype)


_loaded: dict[str, Tables] = KEPT.setdefault("tables", {})


def _tables(uri: str) -> Tables:
    """Read once by each worker."""
    if uri not in _loaded:
        _loaded.clear()
        _loaded[uri] = Tables.load(get(uri))
    return _loaded[uri]


def write(spark: SparkSession, tokens: DataFrame, where: str, vocabulary: int, dtype: type, shard_tokens: int = 8_000_000, block_tokens: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """Writes the files under where; returns where each block is: (place, uri, at, size, n_ids, n_done, start, ordinal).

    place rises in document order; start and ordinal are the ids and the whole documents
    before the block. There is a file for shard_tokens ids, or for more of them where
    that would make more than MOST_SHARDS files.
    """
    tables = Tables.of_counts(c := counts(tokens, vocabulary, dtype))
    put(f"{where}/tables", tables.dump())
    shards = min(MOST_SHARDS, max(1, -(-int(c.sum()) // shard_tokens)))
    order = ["doc_id", "h", "ids"]
    ordered = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions(*order)

    def blocks_of(batches, t: Tables):
        """(block, ids, documents that end in it), in order."""
        held, docs = np.zeros(0, dtype), deque()
        carried = False  # the first document of docs began in an earlier block

        def close(size: int) -> tuple[bytes, int, int]:
            nonlocal held, carried
            own, left, open_first, done = [], size, carried, 0
            carried = False
            while docs and not carried:
                d, k = docs[0]
                if k <= left:
                    docs.popleft()
                    done += 1
                elif left == 0:
                    break
                else:
                    docs[0], k, carried = (d, k - left), left, True
                own.append((d, k))
                left -= k
            block = encode_block(t, held[:size], own, open_first, carried, lanes)
            held = held[size:]
            return block, size, done

        for batch in batches:
            docs.extend(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            held = np.concatenate([held, _flat(batch.column(1), dtype)])
            while len(held) >= block_tokens:
                yield close(block_tokens)
        if docs:
            yield close(len(held))

    def run(batches):
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        shard, rows, at = TaskContext.get().partitionId(), [], 0
        uri = f"{where}/part-{shard:05d}"
        with writing(uri) as out:
            for k, (block, n_ids, n_done) in enumerate(blocks_of(chain([head], batches), _tables(f"{where}/tables"))):
                out.write(block)
                rows.append({"place": (shard << 24) + k, "uri": uri, "at": at, "size": len(block), "n_ids": n_ids, "n_done": n_done})
                at += len(block)
        yield pa.RecordBatch.from_pylist(rows, MANIFEST)

    found = ordered.select("doc_id", "ids", "n").mapInArrow(tidy(run, "tables"), "place long, uri string, at long, size long, n_ids long, n_done long")
    found = materialise(found, where, "manifest")
    return materialise(running(found, "place", {"start": "n_ids", "ordinal": "n_done"}), where, "blocks")


def read(spark: SparkSession, blocks: DataFrame, where: str, most_tasks: int = 50_000) -> DataFrame:
    """(ordinal, doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files block by block."""
    n = blocks.count()
    if not n:
        return spark.createDataFrame([], "ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long")
    table = blocks.select("uri", "at", "size", "start", "ordinal").repartition(min(most_tasks, -(-n // TASK_BLOCKS)))

    def run(batches):
        t = _tables(f"{where}/tables")
        for batch in batches:
            for b in batch.to_pylist():
                fs, path = open_fs(b["uri"])
                with fs.open_input_file(path) as f:
                    f.seek(b["at"])
                    block = Block(f.read(b["size"]))
                raw = memoryview(block.ids(t).astype("<u4")).cast("B")
                many = np.array([c for _, c in block.docs], np.int64)
                end = np.cumsum(many)
                cut = np.zeros(len(many), bool)
                cut[:1] |= block.open_first
                cut[-1:] |= block.open_last
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(end.tolist(), many.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b["ordinal"] + np.arange(len(many))), pa.array([d for d, _ in block.docs], pa.int64()), pa.array(b["start"] + end - many), pa.array(many), pa.array(crc, pa.int64()), pa.array(~cut)], ["ordinal", "doc_id", "start", "n_tokens", "ids_crc32", "whole"])

    parts = materialise(table.mapInArrow(tidy(run, "tables"), "ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long, whole boolean"), where, "read")
    names = ["ordinal", "doc_id", "start", "n_tokens", "ids_crc32"]
    cut = parts.where("not whole").groupBy("ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("parts"))

    def join(batches):
        for batch in batches:
            crc = []
            for own in batch.column("parts").to_pylist():
                total = 0
                for x in own:
                    total = crc32_join(total, x["ids_crc32"], 4 * x["n_tokens"])
                crc.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(crc, pa.int64())], names)

    joined = cut.mapInArrow(tidy(join), "ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return parts.where("whole").select(*names).unionAll(joined)


def _times(matrix: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= matrix[k]
        v >>= 1
        k += 1
    return out


def crc32_join(a: int, b: int, n: int) -> int:
    """crc32 of two byte strings one after the other, the second one of n bytes, from their own."""
    odd = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        odd = [_times(odd, x) for x in odd]  # one zero byte
    while n:
        if n & 1:
            a = _times(odd, a)
        n >>= 1
        odd = [_times(odd, x) for x in odd] if n else odd
    return a ^ b
