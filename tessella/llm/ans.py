"""Token archives coded with a static range asymmetric numeral system.

One table of symbol frequencies, counted over the whole corpus, is shared by all files.  A file
is a row of segments; a segment holds whole documents and is cut into blocks of
``BLOCK_TOKENS``.  Each block is coded on its own by ``LANES`` interleaved states (token i by
lane i mod LANES) into one stream of 32-bit words.  Every ``CHECKPOINT_STEPS`` steps the lane
states and the stream position are kept, so a decoder can start there; all stretches between
checkpoints are decoded side by side.  Every block carries the CRC-32 of its tokens, and the
states must end where the coder began.

Segment layout (little endian): documents, blocks (u32 each), tokens (u64); per document its
identifier (i64) and tokens (u64), a null identifier being the smallest i64; per block tokens,
CRC-32, words, checkpoints (u32 each), the checkpoints (position u32, LANES states u64), the
words (u32).

Files are written by tasks under names of their own, and only files named in the index that
Spark commits count, so a lost or repeated task leaves nothing behind that is read.

Null texts count as empty: a document of the end mark alone.  Null identifiers come first.
Repeated rows are documents of their own, in the order (id, text hash, text).  An empty table
gives an archive without segments.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import text_bytes
from tessella.llm.common import new_folder, stage, whole_text, worker_state

BITS = 20  # frequencies add up to 2**BITS
LOW = 1 << 31  # states lie in [LOW, LOW << 32)
LANES, BLOCK_TOKENS, CHECKPOINT_STEPS = 64, 1 << 15, 128
SEGMENT_TOKENS = 1 << 20
SEGMENTS_PER_TASK = 4
NO_ID = -(1 << 63)
_KEPT_PIECES = 900_000
_BLOCK_HEAD, _SEGMENT_HEAD = "<4I", "<2IQ"


# ---- coder -------------------------------------------------------------------------------


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for every symbol that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.maximum(counts * ((1 << BITS) / total), counts > 0).astype(np.int64)
    gap = (1 << BITS) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while gap:  # the rounding rest goes to or comes from the largest, none falls below 1
        room = order if gap > 0 else order[freq[order] > 1]
        part = room[: min(abs(gap), len(room))]
        freq[part] += 1 if gap > 0 else -1
        gap += -len(part) if gap > 0 else len(part)
    return freq.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(freq.argmax())

    def encode_blocks(self, tokens: np.ndarray) -> list[bytes]:
        """Coded blocks of a token array, in order.  Full blocks are coded in lockstep."""
        whole = len(tokens) // BLOCK_TOKENS
        out = self._encode(tokens[: whole * BLOCK_TOKENS].reshape(whole, BLOCK_TOKENS)) if whole else []
        rest = tokens[whole * BLOCK_TOKENS :]
        return out + self._encode(rest.reshape(1, -1)) if len(rest) else out

    def _encode(self, rows: np.ndarray) -> list[bytes]:
        blocks, n = rows.shape
        steps = -(-n // LANES)
        sym = np.full((blocks, steps * LANES), self.pad, np.uint32)
        sym[:, :n] = rows
        sym = np.ascontiguousarray(sym.reshape(blocks, steps, LANES).transpose(1, 0, 2))
        freq, start = self.freq[sym], self.start[sym]
        limit = freq << np.uint64(63 - BITS)
        words = np.zeros((steps, blocks, LANES), np.uint32)
        sent = np.zeros((steps, blocks, LANES), bool)
        x = np.full((blocks, LANES), LOW, np.uint64)
        marks: list[tuple[int, np.ndarray]] = []
        for t in range(steps - 1, -1, -1):
            full = x >= limit[t]
            sent[t] = full
            words[t] = x
            x = np.where(full, x >> np.uint64(32), x)
            q = x // freq[t]
            x = (q << np.uint64(BITS)) + (x - q * freq[t]) + start[t]
            if t % CHECKPOINT_STEPS == 0:
                marks.append((t, x))
        before = np.concatenate([np.zeros((1, blocks), np.int64), sent.sum(axis=2).cumsum(axis=0)])
        out = []
        for b in range(blocks):
            stream = words[:, b][sent[:, b]]
            head = struct.pack(_BLOCK_HEAD, n, zlib.crc32(np.ascontiguousarray(rows[b], "<u4")), len(stream), len(marks))
            kept = [struct.pack("<I", before[t, b]) + s[b].astype("<u8").tobytes() for t, s in reversed(marks)]
            out.append(head + b"".join(kept) + stream.astype("<u4").tobytes())
        return out

    def decode_blocks(self, data: memoryview, blocks: int) -> np.ndarray:
        """The tokens of consecutive blocks.  Raises ValueError if a checksum does not hold."""
        at, base, streams, stretches, spans = 0, 0, [], {}, []
        total = 0
        for _ in range(blocks):
            n, crc, n_words, n_marks = struct.unpack_from(_BLOCK_HEAD, data, at)
            at += struct.calcsize(_BLOCK_HEAD)
            steps = -(-n // LANES)
            for k in range(n_marks):
                pos = struct.unpack_from("<I", data, at)[0]
                state = np.frombuffer(data, "<u8", LANES, at + 4)
                at += 4 + 8 * LANES
                length = min(CHECKPOINT_STEPS, steps - k * CHECKPOINT_STEPS)
                stretches.setdefault(length, []).append((base + pos, state, total + k * CHECKPOINT_STEPS * LANES, k + 1 == n_marks))
            streams.append(np.frombuffer(data, "<u4", n_words, at))
            at += 4 * n_words
            base += n_words
            spans.append((total, n, crc))
            total += steps * LANES
        words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        out = np.empty(total, np.uint32)
        for length, found in stretches.items():
            pos = np.array([f[0] for f in found], np.int64)
            x = np.stack([f[1] for f in found])
            got = np.empty((length, len(found), LANES), np.uint32)
            for t in range(length):
                slot = x & np.uint64((1 << BITS) - 1)
                s = self.symbol[slot]
                got[t] = s
                x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.start[s]
                short = x < LOW
                taken = short.cumsum(axis=1)
                x = np.where(short, x << np.uint64(32) | words[np.minimum(pos[:, None] + taken - 1, len(words) - 1)], x)
                pos += taken[:, -1]
            for k, (_, _, first, last) in enumerate(found):
                out[first : first + length * LANES] = got[:, k].ravel()
                if last and (x[k] != LOW).any():
                    raise ValueError("coder states do not return to their origin")
        parts = []
        for first, n, crc in spans:
            tokens = out[first : first + n]
            if zlib.crc32(tokens.astype("<u4")) != crc:
                raise ValueError("block checksum does not hold")
            parts.append(tokens)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_segment(coder: Coder, docs: list[tuple[int, int]], tokens: np.ndarray) -> bytes:
    """A segment of (id, tokens) documents."""
    blocks = coder.encode_blocks(tokens)
    head = struct.pack(_SEGMENT_HEAD, len(docs), len(blocks), len(tokens))
    return head + np.array(docs, "<i8").reshape(-1, 2).tobytes() + b"".join(blocks)


def decode_segment(coder: Coder, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(id, tokens) of every document of a segment."""
    n_docs, n_blocks, n = struct.unpack_from(_SEGMENT_HEAD, data)
    docs = np.frombuffer(data, "<i8", 2 * n_docs, struct.calcsize(_SEGMENT_HEAD)).reshape(-1, 2)
    tokens = coder.decode_blocks(memoryview(data)[struct.calcsize(_SEGMENT_HEAD) + docs.nbytes :], n_blocks)
    if len(tokens) != n:
        raise ValueError("segment is short")
    at = 0
    for doc, length in docs.tolist():
        yield doc, tokens[at : at + length]
        at += length


# ---- tokens ------------------------------------------------------------------------------


class _Numbers(dict):
    """Keys to 0, 1, ... in order of appearance."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class LibraryTokens:
    """Ids by the tokenizers library.  Words never hold white space and are put in lower case,
    so the ids of a text are those of its lower-cased pieces between ASCII white space, unless
    it holds a special string in capitals; frequent pieces are kept by the worker.

    The pieces of many texts are numbered first: each distinct one is looked up once, and the
    ids of all texts are gathered from theirs by numpy."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        out = list(map(self.pieces.get, pieces))
        new = [k for k, i in enumerate(out) if i is None]
        found = self.tokenizer.encode_batch_fast([pieces[k].decode() for k in new], add_special_tokens=False)
        room = _KEPT_PIECES - len(self.pieces)
        for k, e in zip(new, found, strict=True):
            out[k] = array("I", e.ids).tobytes()
            if room > 0 and len(pieces[k]) <= 64:
                self.pieces[pieces[k]] = out[k]
                room -= 1
        return out

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by ``end``; ends of the texts)."""
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        sizes = np.array([len(s) + 1 for s in split])
        last = (None,)  # the piece that stands for the end of a text
        numbers = _Numbers({None: 0})
        number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(chain(s, last) for s in split)), np.int32, int(sizes.sum()))
        ids = [end.to_bytes(4, "little"), *self._ids(list(numbers)[1:])]
        flat, length = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        n = length[number]
        upto = np.cumsum(n)
        tokens = flat[np.repeat(start[number] - (upto - n), n) + np.arange(int(n.sum()))]
        return tokens, upto[np.cumsum(sizes) - 1]


def tokenise(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, doc_id, h, ids, counts): ids of the whole texts with ``end`` appended, as bytes, in
    ascending order inside and across shards.  A task's last row holds the counts of its ids alone."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ordered = source.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
    ordered = ordered.sortWithinPartitions("doc_id", "h", "text").select(F.spark_partition_id().alias("shard"), "doc_id", "h", "text")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = worker_state(("library", path), lambda: LibraryTokens(path))
        counts = np.zeros(0, np.int64)
        names = ["shard", "doc_id", "h", "ids", "counts"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, ends = library.encode(list(text_bytes(part.column(3))), end)
                counts = _added(counts, np.bincount(tokens))
                offsets = pa.py_buffer(np.r_[0, 4 * ends].astype(np.int64).tobytes())
                ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(tokens.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids.cast(pa.binary()), pa.nulls(len(ends), pa.binary())], names=names)
        none = [pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    return ordered.mapInArrow(run, "shard int, doc_id long, h long, ids binary, counts binary")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two count vectors, the shorter one filled with zeros."""
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[: len(b)] += b
    return a


def count_tokens(tokens: DataFrame) -> DataFrame:
    """(token, n) over the whole corpus, from the counts of all tasks."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                counts = _added(counts, np.frombuffer(row, "<i8"))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["token", "n"])

    own = tokens.where("counts IS NOT NULL").select("counts")
    return own.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


# ---- archives ----------------------------------------------------------------------------


def write_archive(tokens: DataFrame, freq: np.ndarray, folder: str) -> DataFrame:
    """Write the files and return the index: one row per segment, in a committed table."""
    rows = tokens.where("counts IS NULL").select("shard", "doc_id", "h", "ids")
    table = freq.tobytes()

    def run(batches):
        import uuid

        from pyarrow import fs

        coder = worker_state(("coder", zlib.crc32(table)), lambda: Coder(np.frombuffer(table, np.uint32)))
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = f"{uuid.uuid4().hex}.rans"
        name = f"{folder}/{part}"
        offset, index, docs, held, n, shard, first = 0, [], [], [], 0, None, (None, None)
        with store.open_output_stream(f"{root}/{part}", compression=None) as out:
            def flush():
                nonlocal offset, docs, held, n
                if docs:
                    data = encode_segment(coder, docs, np.frombuffer(b"".join(held), "<u4"))
                    out.write(data)
                    index.append((name, offset, len(data), shard, *first, n))
                    offset += len(data)
                docs, held, n = [], [], 0

            for batch in batches:
                for s, d, h, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != shard or n >= SEGMENT_TOKENS:
                        flush()
                        shard = s
                    if not docs:
                        first = (d, h)
                    docs.append((NO_ID if d is None else d, len(ids) // 4))
                    held.append(ids)
                    n += len(ids) // 4
            flush()
        columns = list(zip(*index, strict=True)) if index else [()] * 7
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["file", "offset", "bytes", "shard", "first_id", "first_h", "n_tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return stage(rows.mapInArrow(run, "file string, offset long, bytes long, shard int, first_id long, first_h long, n_tokens long"), "rans-index")


def with_starts(index: DataFrame) -> DataFrame:
    """``start`` of every segment: tokens of all segments before it.  Shards follow each other,
    so totals per shard are added up first, then those of a shard's own segments."""
    inside = Window.partitionBy("shard").orderBy("first_id", "first_h", "offset").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("of_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("of_shard").over(before), F.lit(0)).alias("before"))
    placed = index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(shards, "shard").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_documents(index: DataFrame, freq: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of an index, a segment at a time."""
    table = freq.tobytes()
    tasks = max(1, -(-index.count() // SEGMENTS_PER_TASK))
    segments = with_starts(index).select("file", "offset", "bytes", "start").repartition(tasks, "file", "offset")

    def run(batches):
        from pyarrow import fs

        coder = worker_state(("coder", zlib.crc32(table)), lambda: Coder(np.frombuffer(table, np.uint32)))
        for batch in batches:
            for name, offset, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as f:
                    f.seek(offset)
                    data = f.read(size)
                rows = []
                for doc, ids in decode_segment(coder, data):
                    rows.append((None if doc == NO_ID else doc, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def archive(docs: DataFrame, path: str, end: int = 2, vocabulary: int = 1 << 16) -> tuple[DataFrame, np.ndarray]:
    """Encode and write all documents; the index of the archive and its frequency table.

    The table has one entry per vocabulary id, whatever the corpus."""
    tokens = stage(tokenise(docs, path, end), "rans-ids", compression="zstd")
    counts = np.zeros(vocabulary, np.int64)
    for r in count_tokens(tokens).collect():  # at most one row per vocabulary entry
        counts[r["token"]] = r["n"]
    freq = quantise(counts)
    return write_archive(tokens, freq, new_folder(docs.sparkSession, "rans")), freq
