"""Exact and near deduplication, repeated passages, components: against all pairs."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tessella.llm import exact, neardup, paragraphs
from tessella.llm.components import components
from tests.llm.corpus import SCHEMA, documents, near_components, shingles, text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(4).cache()


def key(x):
    return x is not None, x or 0


@pytest.mark.parametrize("largest", [True, False])
def test_exact_classes(docs, largest):
    groups = collections.defaultdict(list)
    for r in documents():
        groups[r[1] or ""].append(r[0])
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact.classes(docs, largest=largest).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_rows_keep_all_columns(docs):
    rows = exact.distinct_rows(docs).collect()
    assert rows[0].__fields__ == docs.columns
    assert sorted(r.text for r in rows) == sorted({r[1] or "" for r in documents()})
    source = {(r[0], r[1] or ""): r for r in documents()}
    for r in rows:
        assert tuple(r)[2:] == source[(r.doc_id, r.text)][2:]
    assert exact.distinct_rows(docs.limit(0)).count() == 0


def test_trie_against_a_dictionary():
    rng, trie, plain = random.Random(1), exact.Trie(), {}
    merge = lambda a, b: a + b
    for _ in range(5000):
        k = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        trie.insert(k, 1, merge)
        plain[k] = plain.get(k, 0) + 1
    spilt = dict(trie.spill(ord("a"), 0))
    assert spilt and all(k[:1] == b"b" for k in spilt)
    rest = dict(trie.drain())
    empty = plain.pop(b"")
    assert empty and {**spilt, **rest} == plain and trie.held == 0


def test_small_budget_gives_the_same_classes(spark, docs, monkeypatch):
    want = sorted(map(tuple, exact.classes(docs).collect()), key=repr)
    monkeypatch.setattr(exact, "BUDGET", 2000)
    assert sorted(map(tuple, exact.classes(docs).collect()), key=repr) == want


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_near_classes(spark, docs, monkeypatch, block):
    monkeypatch.setattr(neardup.tiles, "__defaults__", (block,))
    want = near_components(documents())
    rows = documents()
    by = collections.Counter((r[0], len(shingles(r[1])), want.get(r[0]), r[0] == want.get(r[0])) for r in rows)
    got = collections.Counter(tuple(r) for r in neardup.near_classes(docs).collect())
    assert got == by


def test_near_copies_in_a_large_group(spark):
    """Hundreds of copies of one text with edits of their own: links only where Jaccard says so."""
    rng = random.Random(8)
    base = text(rng, 30).split()
    rows = [(0, " ".join(base), "x")]
    for i in range(1, 160):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"w{rng.random()}"
        rows.append((i, " ".join(w), "x"))
    want = near_components(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    assert got == want and 1 < len(set(got.values())) < 160


def test_near_copies_of_long_texts(spark):
    """Sets beyond the sketch around the threshold."""
    rng = random.Random(12)
    base = text(rng, 70).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 50):
        w = list(base)
        for k in range(rng.randint(6, 22)):
            w[rng.randrange(len(w))] = f"v{rng.random()}"
        rows.append((i, " ".join(w)))
    want = near_components(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(base) > 2 * neardup.K and got == want and 1 < len(set(got.values())) < 50


def test_drop_near(docs):
    want = near_components(documents())
    left = neardup.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=key) == sorted((r[0] for r in documents() if r[0] is None or want[r[0]] == r[0]), key=key)
    assert neardup.drop_near(docs.limit(0)).count() == 0


def test_estimates_are_safe_for_long_sets():
    """Sets beyond the sketch: every linked pair is certain or sent to verification."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        n, common = 1200, rng.integers(1090, 1200)
        both = rng.integers(-(1 << 62), 1 << 62, common)
        a = np.unique(np.append(both, rng.integers(-(1 << 62), 1 << 62, n - common)))
        b = np.unique(np.append(both, rng.integers(-(1 << 62), 1 << 62, n - common)))
        linked = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        links, unsure = neardup.tile_links(np.array([1, 2]), np.array([len(a), len(b)]), [a[: neardup.K], b[: neardup.K]], np.array([False, False]), neardup.K, 85)
        assert not links and (not linked or unsure.tolist() == [0, 1])
        exact_links, none = neardup.tile_links(np.array([1, 2]), np.array([len(a), len(b)]), [a, b], np.array([False, False]), None, 85)
        assert exact_links == ([(1, 2)] if linked else []) and not len(none)


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(100, 170)] + [(500, 1000 + k) for k in range(40)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 171)} == {100} and {got[1000 + k] for k in range(40)} == {500}
    assert got[9] == 8 and 7 not in got and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages(seed=3):
    rng = random.Random(seed)
    shared = [text(rng, 9) for _ in range(3)]
    rows = []
    for i in range(90):
        parts = [text(rng, 1) for _ in range(rng.randint(3, 40))]
        if i % 9 == 4:
            p = shared[i // 9 % 3]
            if i % 2:
                w = p.split()
                w[rng.randrange(len(w))] = "changed"
                p = " ".join(w)
            parts.insert(rng.randint(0, len(parts)), p)
        rows.append((i, " ".join(parts), 1))
    return rows, [i for i in range(90) if i % 9 == 4]


def test_repeated_passages(spark):
    rows, planted = passages()
    more = [(1000, None, 1), (1001, "", 1), (None, rows[4][1], 1), (1002, "a b c", 1), rows[0], (1003, (text(random.Random(1), 12) + " ") * 2, 1)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, h long")
    got = {r.doc_id: r for r in paragraphs.removals(df).collect()}
    assert sorted(got) == planted
    texts = dict((r[0], r[1]) for r in rows)
    kept = [d for d, r in got.items() if not r.removed]
    assert len(kept) == 3  # one place of every passage stays
    for d, r in got.items():
        for a, b in (map(int, s.split(":")) for s in r.repeated.split(",")):
            assert len(texts[d][a:b].split()) >= paragraphs.MIN_WORDS
    assert paragraphs.removals(df.limit(0)).count() == 0


def test_variants_of_several_documents_each_are_one_passage(spark):
    rng = random.Random(21)
    for at in (25, 30):
        a = [f"w{rng.random()}" for _ in range(50)]
        b = list(a)
        b[at] = "changed"
        rows = [(d, " ".join(p)) for d, p in ((1, a), (2, a), (3, b), (4, b))]
        got = {r.doc_id: r.removed for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sorted(got) == [1, 2, 3, 4] and [d for d, r in got.items() if not r] == [1]


def test_variants_of_variants_are_one_component(spark):
    """Documents 1 and 2 are similar to 3 only, not to each other: one passage, of which 1 keeps its copy."""
    rng = random.Random(22)
    b = [f"w{rng.random()}" for _ in range(50)]
    a, c = list(b), list(b)
    a[20], c[35] = "changed", "changed"
    p, q = shingles(" ".join(a)), shingles(" ".join(c))
    assert 100 * len(p & q) < 80 * len(p | q)
    rows = [(1, " ".join(c)), (2, " ".join(a)), (3, " ".join(b))]
    got = {r.doc_id: r.removed for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [1, 2, 3] and [d for d, r in got.items() if not r] == [1]


def test_tile_forest_links_equal_starts_only():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 1 << 60, 200)
    sets = [text[0:46], text[3:49], np.r_[text[0:20], -np.arange(1, 4), text[23:46]], np.r_[text[0:30], -9, text[30:45]]]
    near = paragraphs.similar(sets, 80)
    h, doc, span = np.arange(4), np.array([1, 1, 2, 3]), np.array([0 << 32 | 50, 3 << 32 | 53, 0 << 32 | 50, 0 << 32 | 50])
    assert near[0].all() and near[0, 1]
    links = {frozenset(e) for e in paragraphs.tile_forest(near, h, doc, span, sets)}
    assert links == {frozenset({0, 2}), frozenset({0, 3})}


def test_passages_inside_sentences(spark):
    """51 to 60 words at any word of sentences without end, in two documents each."""
    rng = random.Random(31)
    rows = []
    for k in range(60):
        p = [f"p{rng.random()}" for _ in range(51 + k % 10)]
        for d in (2 * k, 2 * k + 1):
            w = [f"o{rng.random()}" for _ in range(rng.randint(60, 90))]
            at = rng.randrange(len(w))
            rows.append((d, " ".join(w[:at] + p + w[at:])))
    got = {r.doc_id: r for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == list(range(120))
    for d, t in rows:
        assert bool(got[d].removed) == d % 2
        a, b = (int(x) for x in got[d].repeated.split(":"))
        words = t[a:b].split()
        ours = [w for w in t.split() if w[0] == "p"]
        assert len(set(words) & set(ours)) >= 45 and len(words) - len(set(words) & set(ours)) <= 10


def test_links_of_overlapping_paragraphs_are_not_chained(spark):
    """The second half of a passage has its first place in document 2, the first half in 1."""
    rng = random.Random(32)
    a, b = ([f"{x}{rng.random()}" for _ in range(120)] for x in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(a + b)), (3, " ".join(b))]
    got = {r.doc_id: r for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = [rows[1][1][x:y] for x, y in (map(int, s.split(":")) for s in got[2].removed.split(","))]
    assert not got[1].removed and got[3].removed
    assert sum(w[0] == "b" for t in removed for w in t.split()) <= 5


def test_passages_of_one_paragraph_are_found(spark):
    """Pairs of 50 words with one changed (similarity 41 of 51), against brute force."""
    rng = random.Random(41)
    rows = []
    for k in range(1000):
        p = [f"w{rng.random()}" for _ in range(50)]
        q = list(p)
        q[rng.randint(4, 45)] = "changed"
        assert 100 * len(shingles(" ".join(p)) & shingles(" ".join(q))) >= 80 * len(shingles(" ".join(p)) | shingles(" ".join(q)))
        rows += [(2 * k, " ".join(p)), (2 * k + 1, " ".join(q))]
    got = paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).where("removed > ''").count()
    print("found", got, "of 1000")
    assert got >= 997


def test_bands_meet_their_recall():
    b = paragraphs.tune(0.8, 2, 0.95)
    assert 1 - (1 - 0.8**2) ** b >= 0.95 > 1 - (1 - 0.8**2) ** (b - 1)


def test_paragraphs_do_not_depend_on_what_surrounds_them():
    rng = random.Random(2)
    p = text(rng, 10)
    spans = set()
    for around in (text(rng, 7), text(rng, 3)):
        t = f"{around} {p} {around}"
        first, end, starts = paragraphs.bounds(t)
        from tessella.llm.neardup import word_codes

        a, b = paragraphs.paragraph_words(starts, np.array(word_codes(t.encode()), np.uint64))
        spans.add(frozenset(t[first[x] : end[y - 1]] for x, y in zip(a, b, strict=True) if t[first[x] : end[y - 1]] in p))
    assert len(spans) == 1 and spans.pop()
