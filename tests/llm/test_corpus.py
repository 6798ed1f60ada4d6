"""Archives, mixing, the pipeline and the registered queries."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import mixing, warc
from tessella.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.corpus import SCHEMA, documents, near_components, words
from tests.llm.test_text_rules import measured

PAGE = "<p>é " + "x" * 200


def test_warc_round_trip(spark):
    rows = [(5, "http://é x/\r\n?a=%20", PAGE), (3, None, PAGE), (9, "u", PAGE), (9, "u", PAGE), (None, "u", PAGE), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "v", "q" * 150), (7, "w", "\r\n\r\nWARC/1.1\r\n" * 9)]
    rows += [(100 + k, f"http://h/{k}", PAGE + str(k)) for k in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.write(df)
    want = collections.Counter()
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    for b, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(b) >= 100 and i != first
            want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    got = warc.resolve(warc.read(index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(map(tuple, got.collect())) == want
    assert {r.url for r in index.collect()} == {r[1] for r in rows}
    some = warc.read(index.where("page_id IN (3, 7, 120)"), payloads=True).collect()
    texts = {r[0]: r[2] for r in rows}
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {i: texts[i] for i in (3, 7, 120)}
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_targets_equal_repeated_sharing(spark):
    sizes = {f"s{k:02d}": v for k, v in enumerate([10, 1000, 3, 0, 500, 40, 70000, 1, 9])} | {None: 77}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    total, open_ = sum(sizes.values()), set(sizes)
    goal = {s: total * weight[s] / sum(weight.values()) for s in sizes}
    while over := [s for s in open_ if goal[s] > 3 * sizes[s] + 1e-9]:
        extra = sum(goal[s] - 3 * sizes[s] for s in over)
        for s in over:
            goal[s] = 3 * sizes[s]
        open_ -= set(over)
        share = sum(weight[s] for s in open_)
        for s in open_:
            goal[s] += extra * weight[s] / share
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(goal)


def brute_tilt(sizes, target, cap=3.0):
    """The multiplier by bisection, on the documents themselves."""
    x = np.array([s for s in sizes if s > 0], float)
    low, high = -700.0 * x.mean() / x.min(), math.log(cap) * x.mean() / x.min()
    for _ in range(300):
        mid = (low + high) / 2
        got = (np.minimum(cap, np.exp(np.minimum(mid * x / x.mean(), 50))) * x).sum()
        low, high = (mid, high) if got < target else (low, mid)
    return mid


def test_newton_meets_every_token_constraint(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{k}": np.maximum(0, rng.lognormal(4, 1.5, 400).astype(int)).tolist() for k in range(5)} | {None: [1] * 50, "one": [7], "none": [0, 0]}
    share = {"s0": 1e-4, "s1": 0.3, "s2": 1.0, "s3": 2.5, "s4": 3.0, None: 0.5, "one": 1.7, "none": 0.0}
    goal = {s: share[s] * sum(v) for s, v in sizes.items()}
    hist = [(s, x, n) for s, v in sizes.items() for x, n in collections.Counter(v).items()]
    state = mixing.tilt(
        spark.createDataFrame(hist, "source string, size long, n long"), spark.createDataFrame(list(goal.items()), "source string, target double")).collect()
    assert len(state) == len(sizes)
    for r in state:
        x = np.array(sizes[r.source], float)
        if r.source == "none":
            assert r.lam is None
            continue
        rates = np.where(x > 0, np.minimum(3, np.exp(np.minimum(r.lam * x / r["mean"], 50))), 0)
        assert abs((rates * x).sum() - goal[r.source]) <= 1e-6 * goal[r.source]  # the gradient of the dual
        if share[r.source] not in (1.0, 3.0):
            assert r.lam == pytest.approx(brute_tilt(sizes[r.source], goal[r.source]), rel=1e-6, abs=1e-9)
        assert len(set(rates[x > 0].round(9))) > 1 or len(set(x[x > 0])) == 1 or share[r.source] in (1.0, 3.0)


def test_equal_rows_have_their_own_copies(spark):
    """Three sources of 3,000 words, the third one row 3,000 times over."""
    rows = [(k, "w " * 30, "a", 1) for k in range(100)] + [(k, "w " * 10, "b", 1) for k in range(200, 500)] + [(900, "w", "c", 1)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h long").repartition(4)
    report = mixing.mix_report(df).collect()
    taken, target = collections.Counter(), {}
    for r in report:
        source = "a" if r.doc_id < 200 else "b" if r.doc_id < 900 else "c"
        taken[source] += r.taken
        target[source] = r.target
    assert target == pytest.approx({"a": 5625, "b": 2250, "c": 1125})
    assert all(abs(taken[s] - target[s]) <= 15 for s in target) and {r.copies for r in report if r.doc_id == 900} == {0, 1}
    mixed = collections.Counter(tuple(r) for r in mixing.mix(df).collect())
    assert mixed[(900, "w", "c", 1)] == taken["c"] and sum(n for r, n in mixed.items() if r[2] == "a") * 30 == taken["a"]


def test_mix_of_long_texts_and_clashing_names(spark):
    rows = [(1, "w " * 400_000, "a", "x", 1.0, 2), (2, "w " * 300_000, "b", "y", 1.0, 2), (3, None, None, None, None, None), (None, "w w", "b", "z", 0.0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, rate double, n int")
    report = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    assert report[1].size == 400_000 and report[3].size == 0 and all(0 <= r.taken <= 3 * r.size for r in report.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {i: r.copies for i, r in report.items() if r.copies}


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(k, "w " * (1 + k * k % 37), f"s{min(k % 7, 2)}", k) for k in range(900)] + [(None, None, None, 1), (5000, "", "s9", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(3)
    report = mixing.mix_report(df).collect()
    by = collections.defaultdict(lambda: [0, 0])
    for r in report:
        assert 0 <= r.taken <= 3 * r.size
        by[(r.source_size, r.target)][0] += r.taken
    for (size, target), (taken, _) in by.items():
        assert abs(taken - target) <= max(2, 0.002 * target), (size, target, taken)
    copies = {r.doc_id: r.copies for r in report}
    mixed = mixing.mix(df.repartition(5))
    assert mixed.columns == df.columns
    got = collections.Counter(r.doc_id for r in mixed.collect())
    assert got == collections.Counter({k: n for k, n in copies.items() if n})
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Decisions of the filtering stages, the mixture's counts and the ids of the last stage."""
    from tessella.llm.bpe import PrefixEncoder
    from tessella.llm.queries import vocabulary_path

    rows = documents()
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "bpe_round_trip":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]

    def fine(t):
        n, chars, symbols, dup, repeated = measured(t)
        return n >= 10 and 100 * repeated <= 20 * n and 2 * n <= chars <= 12 * n and symbols <= 0.25 * n

    passed = seen["quality_rules"]
    assert set(passed) <= {r for r in rows if fine(r[1])}
    assert {r for r in rows if fine(r[1]) and len(words(r[1])) < 50} <= set(passed)
    best = {}
    for r in passed:
        if r[1] not in best or (r[0] is not None, r[0] or 0) > (best[r[1]][0] is not None, best[r[1]][0] or 0):
            best[r[1]] = r
    assert collections.Counter(seen["exact_dedup"]) == collections.Counter(best.values())
    group = near_components(seen["exact_dedup"])
    assert collections.Counter(seen["near_dedup"]) == collections.Counter(r for r in seen["exact_dedup"] if r[0] is None or group[r[0]] == r[0])
    assert set(seen["source_mix"]) <= set(seen["near_dedup"])
    taken = sum(len(words(r[1])) for r in seen["source_mix"])
    assert taken == pytest.approx(sum(len(words(r[1])) for r in seen["near_dedup"]), rel=0.3)
    enc = PrefixEncoder(vocabulary_path())
    want = collections.Counter((r[0], len(enc.encode(r[1].encode())) // 4) for r in seen["source_mix"])
    assert collections.Counter((r[0], r[2]) for r in seen["bpe_round_trip"]) == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(n) for n in names]
    theirs = sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == theirs


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
