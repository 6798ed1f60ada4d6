"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

A document's set holds the hashes (64 bits) of its distinct five-word shingles.  Its sketch is the
``K`` smallest of them; a set of at most ``K`` is its own sketch.

1. Documents with equal sets form a class; only its smallest document goes on.
2. Every retained value lists the documents that retain it.  Two sets of Jaccard similarity
   ``LINK`` share at least :func:`least_shared` retained values (exactly so for whole sets, else
   with a margin of 5.5 standard deviations), so they share one among their rarest
   ``retained - least_shared + 1`` values, and only those are indexed, ordered by how many
   sketches hold them.  Passages that many documents share thus produce no lists unless they
   make up most of a document.  Lists of the same documents are processed once.
3. Long lists are cut into blocks of bounded size, and every pair of blocks is one tile.  A tile
   counts the common values of its sketches by matrix products and estimates the similarity from
   the sketch of the union.  Pairs below the threshold by the same margin are filtered out; whole
   sets are decided there.  A tile sends a spanning forest of its certain links, and the documents
   that the filter leaves unsure; no list is ever spelt out as pairs.
4. Unsure documents meet again in the same tile with their whole sets, and exact Jaccard decides.
5. Components of the links give the class ids (:mod:`tessella.llm.components`).

Null texts and texts without words have the empty set and are linked with nothing.  Fewer words
than five make one shingle.  Rows with the same identifier are one node; rows without identifier
have no class and are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import text_bytes
from tessella.llm.common import stage, whole_text, worker_state
from tessella.llm.components import components

WORDS, LINK, K = 5, 0.85, 192
MARGIN = 5.5  # standard deviations
BLOCK = 768  # documents of a list in one block
_KEPT_WORDS = 300_000


# ---- shingles ----------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def word_codes(text: bytes) -> list[int]:
    """Hashes of the words of a text, A-Z in lower case."""
    import xxhash

    found = text.lower().split()
    kept = worker_state("word hashes", dict)
    codes = list(map(kept.get, found))
    if None in codes:
        for k, c in enumerate(codes):
            if c is None:
                codes[k] = c = xxhash.xxh3_64_intdigest(found[k])
                if len(kept) < _KEPT_WORDS:
                    kept[found[k]] = c
    return codes


def shingle_hashes(text: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z in lower case."""
    w = np.array(word_codes(text), np.uint64)
    if not len(w):
        return np.zeros(0, np.int64)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h ^ w[k : k + len(h)])
    return np.unique(h.view(np.int64))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n, fp, sketch): set size, digest of the set, k smallest values."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))

    def run(batches):
        import hashlib

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t) for t in text_bytes(part.column(1))]
                fp = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), _lists([s[:k] for s in sets])],
                    names=["doc_id", "n", "fp", "sketch"])

    return source.mapInArrow(run, "doc_id long, n long, fp binary, sketch array<long>")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def full_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shingles) with the whole sets."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_hashes(t) for t in text_bytes(part.column(1))])], names=["doc_id", "shingles"])

    return source.mapInArrow(run, "doc_id long, shingles array<long>")


# ---- lists -------------------------------------------------------------------------------


def least_shared(n: Column, k: int = K, link: float = LINK) -> Column:
    """Retained values that a set of size n shares at least with any set linked to it.

    The union has at most n / link values.  If they all are retained the count is exact; else k
    of them are drawn without replacement from a union whose common part is ``link`` of it."""
    union = F.floor(n / link + 1e-9)
    whole = F.ceil(link * n - 1e-9)
    spread = F.sqrt(F.greatest(k * link * (1 - link) * (union - k) / F.greatest(union - 1, F.lit(1)), F.lit(0.0)))
    return F.when(union <= k, whole).otherwise(F.least(whole, F.greatest(F.floor(link * k - MARGIN * spread), F.lit(1))))


def rare_lists(reps: DataFrame, k: int = K, link: float = LINK) -> DataFrame:
    """(value, doc_id, m): the indexed values of every document, where m >= 2 documents meet."""
    values = reps.select("doc_id", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("value"))
    held = values.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("value"))).where("df > 1")
    own = Window.partitionBy("doc_id", "n")
    retained = F.least("n", F.lit(k))
    # values that no other sketch holds come first and take up the prefix
    room = retained - least_shared(F.col("n"), k, link) + 1 - (retained - F.count(F.lit(1)).over(own))
    placed = held.withColumn("room", room).withColumn("place", F.row_number().over(own.orderBy("df", "value")))
    listed = stage(placed.where("place <= room").select("value", "doc_id").distinct(), "neardup-lists")
    same = listed.groupBy("value").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"))
    once = same.where("m > 1").groupBy("m", "x", "y").agg(F.min("value").alias("value")).select("value", "m")
    return listed.join(once, "value")


def tiles(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """(value, left, right, side, doc_id): every pair of a list meets in exactly one tile (left,
    right); in a tile of two blocks, side tells them apart."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    spread = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.select(
        "value", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
        (F.col("own") > F.col("other")).alias("side"), "doc_id")


# ---- tiles -------------------------------------------------------------------------------


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def common_values(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common values of every two sets, by products of 0/1 matrices in column chunks."""
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    rows, where = rows[keep], column[where[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(where, [start, start + 4096])
        chunk = np.zeros((len(sets), 4096), np.float32)
        chunk[rows[a:b], where[a:b] - start] = 1
        out += chunk @ chunk.T
    return out


def tile_links(docs: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, k: int | None, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the certain links of a tile, and the places of the documents that
    may have more.  Without ``k`` the sets are whole and everything is certain."""
    inter = common_values(sets)
    size = np.array([len(s) for s in sets])
    whole = np.ones(len(n), bool) if k is None else n <= k
    top = np.array([np.iinfo(np.int64).max if w else s[-1] for w, s in zip(whole, sets, strict=True)], np.int64)
    upto = np.stack([np.searchsorted(s, top, side="right") for s in sets])  # values of i up to the top of j
    below = np.minimum(size[:, None], upto)
    union = below + below.T - inter
    both = whole[:, None] & whole[None, :]
    certain = both & (100 * inter >= percent * union)
    link = percent / 100
    likely = ~both & (inter >= link * union - MARGIN * np.sqrt(link * (1 - link) * union))
    pairs = np.triu(np.ones_like(certain), 1) & (docs[:, None] != docs[None, :])
    pairs &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if side.any() and not side.all():
        pairs &= side[:, None] != side[None, :]
    forest = _Forest()
    links = [(a, b) for i, j in np.argwhere(pairs & certain).tolist() if forest.join(a := int(docs[i]), b := int(docs[j]))]
    roots = np.array([forest.root(int(d)) for d in docs])
    apart = pairs & likely & (roots[:, None] != roots[None, :])
    return links, np.flatnonzero(apart.any(axis=0) | apart.any(axis=1))


_FOUND = "value long, left int, right int, side boolean, a long, b long"


def listed_links(entries: DataFrame, k: int | None = K, percent: int = 85) -> DataFrame:
    """From tile rows with n and sketch: links (a, b), and with null b the documents (a) whose
    tile needs their whole sets.  Both are at most one row per tile row."""
    ordered = entries.select("value", "left", "right", "side", "doc_id", "n", "sketch")
    ordered = ordered.repartition("value", "left", "right").sortWithinPartitions("value", "left", "right")

    def run(batches):
        def groups():
            now, held = None, []
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
                sides, ids, sizes = (batch.column(c).to_pylist() for c in (3, 4, 5))
                offsets, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
                for r, key in enumerate(keys):
                    if key != now:
                        if held:
                            yield now, held
                        now, held = key, []
                    held.append((ids[r], sizes[r], values[offsets[r] : offsets[r + 1]].copy(), sides[r]))
            if held:
                yield now, held

        def batch_of(rows):
            types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["value", "left", "right", "side", "a", "b"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        out = []
        for key, held in groups():
            if len(held) > 1:
                ids, n, sets, side = zip(*held, strict=True)
                links, unsure = tile_links(np.array(ids), np.array(n), list(sets), np.array(side), k, percent)
                out += [(*key, None, a, b) for a, b in links]
                out += [(*key, side[i], ids[i], None) for i in unsure.tolist()]
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, _FOUND)


def verified(found: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Links (a, b) of the tiles that sketches could not decide, from the whole sets."""
    unsure = found.where("b IS NULL").withColumnRenamed("a", "doc_id").drop("b")
    wanted = stage(unsure.select("doc_id").distinct(), "neardup-wanted")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = full_sets(named.join(wanted, "doc_id", "left_semi")).withColumnRenamed("shingles", "sketch")
    return listed_links(unsure.join(sets.withColumn("n", F.size("sketch").cast("long")), "doc_id"), None, percent).select("a", "b")


# ---- classes -----------------------------------------------------------------------------


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sets = stage(sketches(docs, doc_id, text), "neardup-sketches")
    first = F.row_number().over(Window.partitionBy("fp").orderBy("doc_id"))
    some = sets.where("n > 0 AND doc_id IS NOT NULL")
    reps = some.withColumn("first", first).where("first = 1").select("doc_id", "n", "sketch")
    meeting = tiles(rare_lists(reps))
    found = stage(listed_links(meeting.join(sets.select("doc_id", "n", "sketch"), "doc_id")), "neardup-found")
    parts = components(found.where("b IS NOT NULL").select("a", "b").unionByName(verified(found, docs, doc_id, text)))
    owner = some.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    rows = sets.select("doc_id", "n", "fp").join(owner, "fp", "left")
    rows = rows.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that another row of their class stands for."""
    gone = near_classes(docs, doc_id, text).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone"))
    gone = stage(gone.distinct(), "neardup-gone")
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
