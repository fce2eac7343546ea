"""Classifiers by held-out accuracy, URL filters against the SQL oracle, the pipeline and the registered queries."""

import duckdb
import pandas as pd
import pytest
from helpers import documents

from keelson.llm import quality, queries, toxicity, training, urls

SF = "/root/testdata/sf0.01"


def _auc(scores, labels):
    rank = pd.Series(scores).rank().to_numpy()
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("name, label, floor", [("op6_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.7)])
def test_held_out_accuracy(spark, name, label, floor):
    got = queries.QUERIES[name](spark, SF).toPandas().set_index("doc_id")
    truth = duckdb.sql(f"SELECT doc_id, {label} AS y FROM '{SF}/labels.parquet'").df().set_index("doc_id")
    both = got.join(truth, how="inner")
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and len(got) == 1000
    assert _auc(held.score.to_numpy(), held.y.to_numpy()) > floor


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_cases(spark, module):
    rows = [(i, ("good fine text " if i % 2 else "bad awful junk ") * (i % 5 + 1)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "  \n"), (103, "good " * 50_000), (104, rows[0][1]), (104, rows[0][1])]
    df = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(999, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(df, labels)
    got = {r.doc_id: r.score for r in module.score(df, model).collect()}
    assert len(got) == len({i for i, _ in rows}) and all(0 <= s <= 1 for s in got.values())
    assert got[100] == pytest.approx(got[101], abs=1e-5) and got[104] == pytest.approx(got[0], abs=1e-5)
    assert got[1] > got[0]
    blind = module.fit(df, labels.limit(0))
    assert {round(r.score, 6) for r in module.score(df, blind).collect()} == {0.5}
    assert module.score(df.limit(0), model).count() == 0


def test_toxicity_reject(spark):
    rows = [(i, "you vile fool go" if i % 2 else "what a nice day it is") for i in range(60)]
    df = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity.reject(df, toxicity.fit(df, labels))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_held_out_rule(spark):
    import zlib
    got = spark.range(200).select("id", training.held_out(queries.F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


PAGES = [(1, "http://a.com/x", '<link rel="canonical" href="http://www.net/es/1">'), (2, "http://www.net/es/1", None),
         (3, "http://q.org/z", "<META HTTP-EQUIV='refresh' CONTENT='0; URL=http://a.com/x'>"), (6, None, "x"), (7, "nope", None),
         (5, "http://q.org/rel/other?x=1&b=2#f", '<link rel="canonical" href="//foo.net/fr/">'),
         (8, "http://x.net/es/", "<link rel=canonical href=http://m.org/1>"), (9, "http://m.org/1", '<link rel=canonical href="https://b.com/ok">'),
         (10, "https://EXAMPLE.com/en/1?x", ""), (11, "ftp://WWW.example.com/en/", ""), (12, "http://a.com?x", None), (12, "http://a.com?x", None),
         (13, "http://s.org/1", "<link rel=canonical href=/2>"), (14, "http://s.org/2", "<link rel=canonical href='http://t.net/fr/'>")]


def test_urls_equal_oracle(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, node string, label string")
    got = sorted(map(tuple, urls.judge_pages(df, queries.URL_RULES).collect()))
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"])  # noqa: F841
    want = sorted(duckdb.sql(urls.oracle_sql(queries.URL_RULES)).fetchall())
    assert got == want
    verdict = {g[0]: g[4] for g in got}
    assert verdict[5] == "block" and verdict[9] == "allow" and verdict[13] == "block" and verdict[3] == "allow"
    assert urls.judge_pages(df.limit(0), queries.URL_RULES).count() == 0


def test_relative_targets(spark):
    rows = [(1, "http://q.org/rel/p", "<link href='other?x=1&amp;b=2' rel=canonical>"),
            (2, "http://q.org/rel/other?x=1&b=2#f", '<link rel="canonical" href="//foo.net/fr/">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge_pages(df, queries.URL_RULES).collect()} == {1: "block", 2: "block"}


def test_pipeline_equals_stage_models(spark, tmp_path):
    """Every stage's effect recomputed from its own input by plain models."""
    import corpus_pipeline as cp
    from helpers import overlaps, shingle_groups

    from keelson.llm import pii
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "bpe":
            assert docs.columns == list(cp.COLUMNS)
        if name == "toxicity":
            assert {r.doc_id for r in after} < {i for i, _ in before} and len(after) > 0.8 * len(before)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in shingle_groups(before)})
        if name == "decontamination":
            assert sorted(r.doc_id for r in after) == sorted(i for i, n, h, _ in overlaps(before, items) if not (h and 20 * h >= n))
        if name == "pii":
            assert sorted((r.doc_id, r.text) for r in after) == sorted((i, pii._mask(t, pii.MIN_SCORE)) for i, t in before)
            assert all(r.n_chars == len(r.text) for r in after)
    assert len(after) == len(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = got.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.select(*cols).fetchall()))


def test_queries_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
