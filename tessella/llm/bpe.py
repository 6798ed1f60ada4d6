"""Exact byte-pair encoding by dynamic programming over prefixes, and its inverse.

A BPE encoding is the only sequence of vocabulary entries in which every two neighbours are
compatible, that is, in which merging their concatenation gives the two back.  So for every
prefix of a word the last token is unique: it is the one match ending there whose predecessor,
the last token of the shorter prefix, is compatible with it.  The matches ending at each
position come from an automaton over the vocabulary (states linked to their longest proper
suffix).  Following the back-pointers from the end yields exactly the ids of the merge loop, in
time linear in the word, without a priority queue.

Words are found as the vocabulary file says (special strings, NFC, lower case, split pattern).
White space never belongs to a word, so texts are cut there and the ids of frequent pieces are
kept by the worker in a table of fixed size; that changes the time, never the result.

Null texts count as empty and have no ids.  Repeated rows give repeated results, an empty table
an empty one.  Other columns are carried as named in ``keep``.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import worker_state

_FINAL = 0x200  # added to the last symbol of a word, as the vocabulary tells it from the others
_NEVER = 1 << 40
_KEPT_PIECES, _KEPT_WORDS, _KEPT_PAIRS = 180_000, 150_000, 200_000
_ROWS_OUT = 256


def byte_symbols() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the
    others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file (BPE with word ends, byte level)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.symbols = {b: c for b, c in byte_symbols().items()}
        # spelling of every token over plain and word-final symbols, through its merges
        spelt = {c + e: (c if not e else chr(ord(c) + _FINAL)) for c in self.symbols.values() for e in ("", end)}
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            spelt[a + b] = spelt[a] + spelt[b]
            self.rank[ids[a] << 20 | ids[b]] = r
            parts[ids[a + b]] = (ids[a], ids[b], r)
        self.length = [0] * (max(ids.values()) + 1)
        for token, s in spelt.items():
            self.length[ids[token]] = len(s)
        self._automaton({s: ids[token] for token, s in spelt.items()})
        self.parts = parts
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.strings: list[str] | None = None
        # characters whose case, class and normal form are the same in every Unicode version
        self.simple = regex.compile(r"[\x21-\x7e\xa1-ſ]+").fullmatch
        self.lower = {"type": "Lowercase"} in spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find_words = regex.compile(split).findall

    def _automaton(self, tokens: dict[str, int]) -> None:
        """States are the prefixes of tokens.  ``step`` holds the edges, ``suffix`` leads to the
        longest proper suffix that is a state, ``ends`` to the longest token that ends there and
        ``shorter`` from a state's token to the next shorter one."""
        self.step: dict[int, int] = {}
        self.suffix, self.ends, letter, above = [0], [-1], [0], [0]
        levels: list[list[int]] = []
        for s, token in tokens.items():
            state = 0
            for depth, c in enumerate(map(ord, s)):
                key = state << 10 | c
                child = self.step.get(key)
                if child is None:
                    child = self.step[key] = len(self.ends)
                    self.suffix.append(0)
                    self.ends.append(-1)
                    letter.append(c)
                    above.append(state)
                    if len(levels) <= depth:
                        levels.append([])
                    levels[depth].append(child)
                state = child
            self.ends[state] = token
        self.shorter: dict[int, int] = {}
        for depth, level in enumerate(levels):
            for state in level:
                if depth:
                    back = self.suffix[above[state]]
                    while back and back << 10 | letter[state] not in self.step:
                        back = self.suffix[back]
                    self.suffix[state] = self.step.get(back << 10 | letter[state], 0)
                inherited = self.ends[self.suffix[state]] if self.suffix[state] else -1
                if self.ends[state] < 0:
                    self.ends[state] = inherited
                else:
                    self.shorter[self.ends[state]] = inherited

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The nodes at the right (1) or left (0) edge of a token's merge tree, each with the
        rank of the merge that absorbs it."""
        out, node = [(token, _NEVER)], token
        while node in self.parts:
            absorbed = self.parts[node][2]
            node = self.parts[node][side]
            out.append((node, absorbed))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b together leaves a and b.

        A merge across the border would join a node at the right edge of a with one at the
        left edge of b while both exist.  Merges of one rank go from left to right, so the
        left node must be absorbed strictly later, the right one not earlier."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = True
            for x, gone_x in self._spine(a, 1):
                for y, gone_y in self._spine(b, 0):
                    r = self.rank.get(x << 20 | y)
                    if r is not None and r < gone_x and r <= gone_y:
                        known = False
            if len(self.pairs) < _KEPT_PAIRS:
                self.pairs[key] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte symbols."""
        letters = list(map(ord, word))
        letters[-1] += _FINAL
        step, suffix, ends, shorter, length = self.step, self.suffix, self.ends, self.shorter, self.length
        compatible, pairs = self.compatible, self.pairs
        last = [-1]
        state = i = 0
        for c in letters:
            i += 1
            to = step.get(state << 10 | c)
            while to is None:
                state = suffix[state]
                to = step.get(state << 10 | c)
            state = to
            token = ends[state]
            while True:
                before = i - length[token]
                if not before:
                    break
                key = last[before] << 20 | token
                ok = pairs.get(key)
                if compatible(last[before], token) if ok is None else ok:
                    break
                token = shorter[token]
            last.append(token)
        out: list[int] = []
        while i:
            out.append(last[i])
            i -= length[last[i]]
        out.reverse()
        return out

    def _words(self, piece: str) -> list[str]:
        if not self.simple(piece):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]
        piece = piece.lower()
        found = [piece] if piece.isalpha() else self.find_words(piece)
        return found if piece.isascii() else ["".join(map(self.symbols.__getitem__, w.encode())) for w in found]

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a text without special strings and without white space, as 32-bit integers."""
        ids: list[int] = []
        for w in self._words(piece.decode()):
            known = self.words.get(w)
            if known is None:
                known = self.encode_word(w)
                if len(self.words) < _KEPT_WORDS and len(w) <= 48:
                    self.words[w] = known
            ids += known
        out = array("I", ids).tobytes()
        if len(self.pieces) < _KEPT_PIECES and len(piece) <= 64:
            self.pieces[piece] = out
        return out

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian 32-bit integers."""
        if b"<|" in text:
            out = []
            for k, part in enumerate(self.special_split(text.decode())):
                out.append(self.special[part].to_bytes(4, "little") if k % 2 else self._plain(part.encode()))
            return b"".join(out)
        return self._plain(text.lower() if self.lower else text)

    def _plain(self, text: bytes) -> bytes:
        pieces = text.split()
        ids = list(map(self.pieces.get, pieces))
        if None in ids:
            ids = [self._piece(p) if i is None else i for p, i in zip(pieces, ids, strict=True)]
        return b"".join(ids)


def token_strings(path: str) -> list[str]:
    """The strings of a vocabulary by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = {**spec["model"]["vocab"], **{a["content"]: a["id"] for a in spec["added_tokens"]}}
    out = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return out


def decode_ids(strings: Sequence[str], ids: Sequence[int]) -> str:
    """The token strings joined by a space, as a vocabulary without a decoder has it."""
    return " ".join(map(strings.__getitem__, ids))


def encoder(path: str) -> PrefixEncoder:
    return worker_state(("bpe", path), lambda: PrefixEncoder(path))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every text, empty where null, without building Python strings."""
    for v in column.cast(pa.large_binary()):
        b = v.as_py()
        yield b"" if b is None else b


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: Sequence[str] = (), decoded: str | None = None) -> DataFrame:
    """``keep`` columns and the ids of every whole text as an array of integers in ``out``.

    With ``decoded``, also the text decoded from those ids, by the same worker: a second pass
    (:func:`decode`) would double the Python workers of an executor."""
    import numpy as np

    fields = [df.schema[c] for c in keep]
    source = df.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        enc = encoder(path)
        if decoded and enc.strings is None:
            enc.strings = token_strings(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(at, _ROWS_OUT)
                ids = [enc.encode(t) for t in text_bytes(part.column(len(keep)))]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                cols = [*(part.column(k) for k in range(len(keep))), pa.ListArray.from_arrays(pa.array(ends), values)]
                if decoded:
                    cols.append(pa.array([decode_ids(enc.strings, np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [*keep, out, *([decoded] if decoded else [])]
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType())), *more])
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the decoded text in ``out``; a null array gives an empty text."""
    names = df.columns

    def run(batches):
        strings = worker_state(("token strings", path), lambda: token_strings(path))
        k = names.index(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(at, _ROWS_OUT)
                texts = [decode_ids(strings, v.values.to_numpy().tolist() if v.is_valid else ()) for v in part.column(k)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def ids_digest(ids: str | Column = "ids") -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.array_join(c.cast("array<string>"), " "), 256)
