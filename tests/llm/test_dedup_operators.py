"""Suffix-array dedup, n-gram Jaccard join, decontamination, training order: against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import covered, documents, overlaps, shingle_groups

from keelson.llm import decontam, graph, jaccard, suffix_dedup, training_order
from keelson.llm.lyndon import suffix_arrays


def test_suffix_arrays_equal_sorting():
    rnd = random.Random(2)
    for _ in range(600):
        strings = [[rnd.randint(0, rnd.choice([1, 2, 4, 20])) for _ in range(rnd.randint(0, rnd.choice([3, 12, 60])))]
                   for _ in range(rnd.randint(0, 6))]
        symbols = np.array([x for s in strings for x in s], np.int64)
        off = np.cumsum([0] + [len(s) for s in strings])
        want = [a + i for a, s in zip(off, strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert suffix_arrays(symbols, off).tolist() == want


def _removed(df, **kw):
    return sorted((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept))
                  for r in suffix_dedup.remove_repeats(df, **kw).collect())


@pytest.mark.parametrize("hot", [1, 128])
def test_suffix_dedup(spark, docs_small, hot):
    assert _removed(documents(spark, docs_small, extra=True), hot=hot) == covered(docs_small)


def test_suffix_dedup_made_cases(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdef ") for _ in range(300))
    rows = [(i, "".join(rnd.choice("ghijkl ") for _ in range(rnd.randint(0, 80))) + passage[rnd.randint(0, 100):rnd.randint(120, 300)]
             + "".join(rnd.choice("mnop ") for _ in range(rnd.randint(0, 80)))) for i in range(200)]
    rows += [(300, "ab" * 200), (301, "ba" * 90), (302, "q" * 49), (303, "q" * 49), (304, "q" * 50), (305, "q" * 50)]
    for hot in (3, 10_000):
        assert _removed(documents(spark, rows), hot=hot) == covered(rows)
    assert _removed(documents(spark, rows[:1]).limit(0)) == []


def _groups(df):
    return sorted(map(tuple, jaccard.near_duplicate_groups(df).collect()))


def test_jaccard_groups(spark, docs_small):
    rows = [r for r in docs_small if r[0] != 9006]       # ids of one text each
    assert _groups(documents(spark, rows, extra=True)) == shingle_groups(rows)


@pytest.mark.parametrize("probes, small", [(1, 2), (1, 10_000)])
def test_jaccard_made_cases(spark, monkeypatch, probes, small):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(150)]
    rows = []
    for i in range(120):                                 # near copies around the bound, in one hot group
        w = list(base)
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(w[rnd.randint(0, 8):])))
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(200 + i, shared + " " + " ".join(f"y{rnd.randint(0, 99999)}" for _ in range(rnd.randint(3, 60)))) for i in range(80)]
    rows += [(400, "a b c d"), (401, "A b  c d"), (402, "a b c"), (403, "a b c d e"), (404, "a b c d e f")]
    monkeypatch.setattr(jaccard, "PROBES", probes)
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = _groups(documents(spark, rows))
    assert got == shingle_groups(rows)
    kept = sorted(r.doc_id for r in jaccard.keep_first(documents(spark, rows + [(400, "a b c d")], extra=True)).collect())
    assert kept == sorted({c for _, _, c in got})
    assert _groups(documents(spark, rows[:1]).limit(0)) == []


def test_overlap_bound():
    rnd = random.Random(7)
    for _ in range(2000):
        a = np.array(sorted(rnd.sample(range(60), rnd.randint(1, 40))))
        b = np.array(sorted(rnd.sample(range(60), rnd.randint(1, 40))))
        o = len(set(a.tolist()) & set(b.tolist()))
        assert jaccard.overlap_reaches(a, b, 40) == (100 * o >= 40 * (len(a) + len(b) - o))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 501)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.label for r in graph.components(df).collect()}
    assert set(got.values()) == {0, 100, 500} and got[40] == 0 and got[159] == 100
    assert graph.components(df.limit(0)).count() == 0


def _bench(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 300])
def test_decontamination(spark, docs_small, monkeypatch, block_bytes):
    import duckdb
    items = duckdb.sql("SELECT CAST(item_id AS VARCHAR), text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    items += [("x1", "The of"), ("x2", "that"), ("x3", None), ("x4", ""), ("x5", items[0][1])]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    if block_bytes == 300:
        monkeypatch.setattr(decontam, "MAX_BLOCKS", 5)
    rows = docs_small + [(9100, "that"), (9101, "the OF x the of"), (9102, items[0][1] + " tail"), (9102, items[0][1] + " tail")]
    got = decontam.find_overlaps(documents(spark, rows, extra=True), _bench(spark, items)).collect()
    import hashlib
    want = overlaps(rows, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(
        (i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, x in want)
    full = [r for r in got if r.doc_id == 9102][0]
    assert full.longest_match >= min(13, full.n_words)
    kept = decontam.remove_contaminated(documents(spark, rows), _bench(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, h, _ in want if not (h > 0 and 20 * h >= n))


def test_decontamination_empty_benchmark(spark):
    df = documents(spark, [(1, "a b"), (2, None)])
    got = decontam.find_overlaps(df, _bench(spark, [("a", "b")]).limit(0)).collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(0, 0, False)] * 2


def test_permutation():
    for n in (1, 2, 3, 5, 100, 1000, 4097):
        x = np.arange(n)
        s = training_order.permute(x, n, 7)
        assert sorted(s.tolist()) == list(range(n))
        assert (training_order.unpermute(s, n, 7) == x).all()
    assert (training_order.permute(np.arange(1000), 1000, 7) != training_order.permute(np.arange(1000), 1000, 8)).mean() > 0.9


def test_training_order_round_trip(spark, docs_small):
    rows = docs_small[:60] + docs_small[-14:] + [(9200, "x" * 1023), (9201, "y" * 512)]
    df = documents(spark, rows, extra=True)
    slots, layout = training_order.materialize(df, 5, length=512, shard_rows=40)
    by_slot = {r.slot: r for r in slots.collect()}
    assert sorted(by_slot) == list(range(layout.sequences))
    got = list(training_order.read_slots(spark, layout))
    assert list(training_order.read_slots(spark, layout, 35, 95)) == got[35:95]
    parts = defaultdict(list)
    for s, raw in enumerate(got):
        assert len(raw) == by_slot[s].n_tokens
        parts[by_slot[s].doc_id].append((by_slot[s].seq, raw))
    seen = {i: sorted(b"".join(x for _, x in sorted(v)).split(b"\xfe")) for i, v in parts.items()}
    want = defaultdict(list)
    for i, t in rows:
        want[i].append((t or "").encode())
    assert seen == {i: sorted(v + [b""]) for i, v in want.items()}
    empty, layout = training_order.materialize(df.limit(0), 5)
    assert empty.count() == 0 and layout.sequences == 0
