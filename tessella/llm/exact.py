"""Exact deduplication with Patricia tries as owners of texts.

Texts are dealt by byte length and content hash (SHA-256), and every task inserts the full bytes,
behind their hash, into a compressed radix trie.  A terminal node keeps the owner of the text,
the row with the smallest or largest identifier, and the number of rows.  Equality is decided by
the bytes on the path, never by the hash.

Tasks first build tries over their own part of the input, so however often a text is repeated,
each task sends it once.  A trie that outgrows its budget gives up whole subtrees, largest first:
before the shuffle their terminals are simply sent early; after it the rows arrive in the order
of the hash, so all subtrees but the current one are complete and are written out.  Memory is
bounded by the budget and one text.

Null texts count as empty.  Of rows equal in text and identifier the one with the largest other
columns stays.  A null identifier never owns a text that has another one.  An empty table gives
an empty one; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import whole_text

BUDGET = 48 << 20  # bytes of labels in one trie
_NODE = 200  # bytes a node takes beside its label


class Trie:
    """Compressed radix trie.  A node is [label, children by first byte, terminal or None]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.held = 0

    def insert(self, key: bytes, terminal, merge) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = terminal if node[2] is None else merge(node[2], terminal)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, terminal]
                self.held += len(key) - at + _NODE
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = self._common(label, key, at)
            upper = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][key[at]] = upper
            self.held += _NODE
            node, at = upper, at + n

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if label[low:mid] == key[at + low : at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def _drain(self, node: list, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node[0]
            self.held -= len(node[0]) + _NODE
            if node[2] is not None:
                yield key, node[2]
            stack += [(c, key) for c in node[1].values()]

    def spill(self, keep: int | None, to: int) -> Iterator[tuple[bytes, tuple]]:
        """Give up subtrees below the root, largest first, until at most ``to`` bytes are held.
        The subtree of first byte ``keep`` stays."""
        size = {}
        for b, child in self.root[1].items():
            n, stack = 0, [child]
            while stack:
                x = stack.pop()
                n += len(x[0]) + _NODE
                stack += x[1].values()
            size[b] = n
        for b in sorted(size, key=size.get, reverse=True):
            if self.held <= to:
                break
            if b != keep:
                yield from self._drain(self.root[1].pop(b), b"")

    def drain(self) -> Iterator[tuple[bytes, tuple]]:
        children, self.root = self.root[1], [b"", {}, None]
        for child in children.values():
            yield from self._drain(child, b"")
        self.held = 0


def _better(largest: bool):
    """Merge of two terminals (identifier, other columns, rows)."""

    def order(t):
        known = t[0] is not None
        return known, (t[0] if largest else -t[0]) if known else 0, repr(t[1])

    def merge(a, b):
        first, n = a, a[2] + b[2]
        if order(b) > order(a):
            first = b
        return (first[0], first[1], n)

    return merge


def owners(df: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """One row per distinct text: its SHA-256, bytes, rows and the columns of the owner."""
    others = [c for c in df.columns if c not in (doc_id, text)]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(1).alias("none"))
    source = df.select(
        F.unhex(F.sha2(whole_text(F.col(f"`{text}`")), 256)).alias("hash"),
        F.octet_length(whole_text(F.col(f"`{text}`"))).cast("long").alias("bytes"),
        whole_text(F.col(f"`{text}`")).cast("binary").alias("body"),
        F.col(f"`{doc_id}`").alias("owner"),
        row.alias("row"),
        F.lit(1).cast("long").alias("rows"),
    )
    schema = source.schema
    budget = BUDGET

    def run(batches, ordered: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        trie, merge = Trie(), _better(largest)

        def table(found):
            part, held = [], 0
            for key, (owner, meta, n) in found:
                part.append((key[:32], len(key) - 32, key[32:], owner, meta, n))
                held += len(key)
                if held > 8 << 20 or len(part) >= 2000:
                    yield batch_of(part)
                    part, held = [], 0
            if part:
                yield batch_of(part)

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            hashes, _, bodies, ids, rows, ns = (batch.column(k) for k in range(6))
            metas = rows.to_pylist()
            for h, body, i, meta, n in zip(hashes, bodies, ids.to_pylist(), metas, ns.to_pylist(), strict=True):
                h = h.as_py()
                trie.insert(h + body.as_py(), (i, meta, n), merge)
                if trie.held > budget:
                    yield from table(list(trie.spill(h[0] if ordered else None, 0 if ordered else budget // 2)))
        yield from table(trie.drain())

    local = source.mapInArrow(lambda b: run(b, False), schema)
    dealt = local.repartition("bytes", "hash").sortWithinPartitions("hash")
    return dealt.mapInArrow(lambda b: run(b, True), schema)


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    own = owners(df.select(doc_id, text), doc_id, text, largest).select("hash", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(whole_text(text), 256)).alias("hash"))
    return rows.join(own, "hash").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("hash")).alias("text_sha256"),
    )


def distinct_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """The owner of every distinct text, with the columns of ``df``; a null text returns empty."""
    own = owners(df, doc_id, text, largest)
    place = {doc_id: F.col("owner"), text: F.col("body").cast("string")}
    return own.select(*[place.get(c, F.col("row").getField(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
