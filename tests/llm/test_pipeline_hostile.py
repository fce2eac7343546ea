"""The pipeline over rows that any table can hold: null ids and texts, empty and very long texts, repeated ids with equal and with different texts."""

import os
import sys

import duckdb
from helpers import NON_BLANK, lower, overlaps

from keelson.llm import pii
from keelson.session import scratch_path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, rows):
    """A folder with the given documents and the given benchmark and labels."""
    folder = scratch_path(spark, "hostile")
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(full, DDL).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def hostile_rows():
    given = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY length(text) DESC LIMIT 1").fetchall()[0][0]
    text = {i: t for i, t, _ in given}
    long = " ".join(f"w{k % 9973} {k}" for k in range(60_000))
    return given + [
        (None, "a row without an id, mail x.y@example.com", "en"), (None, None, None), (None, text[3], "de"), (9000, None, "en"), (9001, "", None), (9001, "", None),
        (9002, " \n\t", "xx"), (9003, "short", "en"), (9003, "other short text", "en"), (9003, "short", "en"), (2, "two texts share the id two and this one is new", "fr"),
        (9004, long, "en"), (9005, long + " end", "en"), (9006, item, "en"), (9006, "clean text of the same id as a contaminated one", "en"), (9007, "x" * 300_000, "en"),
        ((1 << 60) + 1, "an id beyond what a double can hold", "en"), (9008, "é" * 40 + " 日本 " * 30, "ja")]


def survivors(rows):
    """Row-by-row: of each group of rows linked by their shingles one row with the least id stays."""
    sets = []
    for _, t, *_ in rows:
        w = NON_BLANK.findall(lower(t))
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)))
    holders, parent = {}, list(range(len(rows)))
    known = [k for k, r in enumerate(rows) if r[0] is not None and sets[k]]
    for k in known:
        for s in sets[k]:
            holders.setdefault(s, []).append(k)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k in known:
        for j in {j for s in sets[k] for j in holders[s] if j < k}:
            o = len(sets[k] & sets[j])
            if 100 * o >= 80 * (len(sets[k]) + len(sets[j]) - o):
                parent[find(k)] = find(j)
    groups = {}
    for k in known:
        groups.setdefault(find(k), []).append(k)
    ids = sorted(min(rows[k][0] for k in g) for g in groups.values())
    loose = [rows[k][:2] for k in range(len(rows)) if k not in set(known)]
    texts = {g: {rows[k][1] for k in ks if rows[k][0] == min(rows[j][0] for j in ks)} for g, ks in groups.items()}
    return ids, loose, texts


def test_stages_on_hostile_rows(spark):
    import corpus_pipeline
    folder = tables(spark, hostile_rows())
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    key = repr
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    safe = seen["toxicity"]
    assert set(safe) <= set(given) and len(safe) > 0.8 * len(given)
    kept = seen["near_duplicates"]
    ids, loose, texts = survivors(safe)
    held = [r for r in kept if r[0] is not None and NON_BLANK.search(r[1] or "")]
    assert sorted(r[0] for r in held) == ids
    assert all(any(r[1] in t for t in texts.values()) for r in held)
    assert sorted((r[:2] for r in kept if r not in held), key=key) == sorted(loose, key=key)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    numbered = [(k, r[1]) for k, r in enumerate(kept)]
    bad = {k for k, n, hit, _ in overlaps(numbered, items) if hit and 20 * hit >= n}
    clean = [r for k, r in enumerate(kept) if k not in bad]
    assert sorted(seen["decontamination"], key=key) == sorted(clean, key=key)
    assert any(r[0] == 9006 for r in clean) and all(r[0] != 9006 or "same id" in r[1] for r in clean)

    masked = [(r[0], None if r[1] is None else pii._mask(r[1], pii.MIN_SCORE)) for r in clean]
    assert sorted((r[:2] for r in seen["pii"]), key=key) == sorted(masked, key=key)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in seen["pii"])
    last = seen["bpe"]
    assert sorted((r[0] for r in last), key=key) == sorted((r[0] for r in seen["pii"]), key=key)
    assert {r[1] for r in last if r[0] in (9000, 9001)} == {0} and next(r[1] for r in last if r[0] == 9004) > 60_000


def test_empty_documents(spark):
    import corpus_pipeline
    folder = tables(spark, [])
    assert corpus_pipeline.run(spark, folder).collect() == []
