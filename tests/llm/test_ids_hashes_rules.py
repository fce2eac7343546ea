"""Rows without ids, ids shared by different texts, long repetitive words, long rule lists."""

import random

import numpy as np
import pytest
from helpers import covered, documents, overlaps, shingle_groups

from keelson.llm import decontam, jaccard, suffix_dedup, training_order, urls
from keelson.llm.common import PrefixHash, lowered_values


def thue_morse(n, flip=0):
    """Two words that every polynomial hash modulo 2^64 takes for one, from 1,024 bytes on."""
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_span_hashes_tell_long_words_apart():
    for n in (16, 64, 65, 512, 1024, 2048, 8192):
        buf = np.frombuffer((thue_morse(n) + thue_morse(n, 1) + thue_morse(n).upper()).encode(), np.uint8)
        at = np.array([0, n, 2 * n])
        plain, low = (PrefixHash(buf, *v).spans(at, at + n) for v in ((), (lowered_values(),)))
        assert len(set(plain.tolist())) == 3 and low[0] == low[2] != low[1]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_long_words_in_joins(spark, n):
    a, b = thue_morse(n), thue_morse(n, 1)
    rows = [(1, a), (2, b), (3, a.upper()), (4, f"x {a} y"), (5, f"x {b} y")]
    got = sorted(tuple(r) for r in jaccard.near_duplicate_groups(documents(spark, rows)).collect())
    assert got == shingle_groups(rows)
    items = [("i", b), ("j", f"q {a}")]
    table = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.find_overlaps(documents(spark, rows), table).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found) == [(i, w, h, len(k)) for i, w, h, k in overlaps(rows, items)]
    kept = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in kept) == covered(rows)


BIG = (1 << 60) + 1
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [(None, TEXT), (BIG, TEXT), (7, TEXT + " x"), (None, TEXT), (BIG + 1, "short"), (None, None), (8, None), (8, "")]


def test_rows_without_id(spark):
    docs = documents(spark, ROWS, extra=True)
    got = sorted((tuple(r) for r in jaccard.near_duplicate_groups(docs).collect()), key=repr)
    assert got == sorted([(None, 10, None), (None, 10, None), (None, 0, None), (BIG, 10, 7), (7, 11, 7), (BIG + 1, 1, BIG + 1), (8, 0, 8), (8, 0, 8)], key=repr)
    kept = suffix_dedup.remove_repeats(docs).collect()
    known = [(i, t) for i, t in ROWS if i is not None]
    assert sorted((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in kept if r.doc_id is not None) == covered(known)
    assert sorted((r.n_bytes, len(r.spans), bytes(r.kept).decode()) for r in kept if r.doc_id is None) == [(0, 0, ""), *[(len(TEXT), 0, TEXT)] * 2]
    slots, layout = training_order.materialize(docs, key=5, length=16)
    rows = slots.collect()
    texts = [bytes(t).rstrip(bytes([training_order.END])).decode() for t in training_order.read_slots(spark, layout)]
    assert len(rows) == layout.sequences and sorted(r.slot for r in rows) == list(range(layout.sequences))
    want = sorted((t or "")[k:k + 16] for _, t in ROWS for k in range(0, len(t or "") + 1, 16))
    assert sorted(texts) == want and sum(r.doc_id is None for r in rows) == 2 * (len(TEXT) // 16 + 1) + 1
    assert {r.doc_id for r in rows} == {None, BIG, BIG + 1, 7, 8}


def test_items_and_documents_without_id(spark):
    items = spark.createDataFrame([(None, TEXT), ("b", "short")], "item_id string, text string")
    found = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontam.find_overlaps(documents(spark, ROWS), items).collect()}
    assert found[None, 14] == found[BIG, 14] == (14, 1) and found[BIG + 1, 1] == (1, 1) and found[None, 0] == (0, 0)


def test_rows_of_one_id_are_judged_by_their_texts(spark, monkeypatch):
    """Both forms of the removal agree, with repeated and null ids and clashing columns."""
    clean = "nothing to see here at all"
    rows = [(1, TEXT), (1, clean), (None, TEXT), (None, clean), (2, clean), (2, TEXT), (2, TEXT)]
    items = spark.createDataFrame([(f"i{k}", f"{k} {TEXT}") for k in range(9)] + [("z", TEXT)], "item_id string, text string")
    want = sorted(((i, t) for i, t in rows if t == clean), key=repr)
    docs = documents(spark, rows, extra=True)
    one = decontam.remove_contaminated(docs, items)
    assert one.columns == docs.columns and sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 2)
    many = decontam.remove_contaminated(docs, items)
    assert many.columns == docs.columns and sorted(((r.doc_id, r.text) for r in many.collect()), key=repr) == want


def test_one_row_of_each_group_stays(spark):
    rows = [(5, TEXT), (5, "a b c d e f"), (5, TEXT), (6, TEXT + " more"), (4, "a b c d e f"), (4, "other words of this one here"), (None, TEXT), (9, ""), (9, "")]
    docs = documents(spark, rows, extra=True)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(5, TEXT), (4, "a b c d e f"), (4, "other words of this one here"), (None, TEXT), (9, ""), (9, "")], key=repr)


def test_long_rule_lists_equal_short_ones(spark, monkeypatch):
    rnd = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "x.org", "org", "A.com"]
    rules = [f"{rnd.choice(['allow', 'block'])} {rnd.choice(hosts)}/{rnd.choice(['', 'e', 'en/', 'en/x', 'fr/é'])}" for _ in range(25)]
    rules = list({r.split(" ")[1].lower(): r for r in rules}.values())
    pages = [(k, f"{rnd.choice(['http://', 'https://', ''])}{rnd.choice(['www.', '', 'q.'])}{rnd.choice(hosts)}/{rnd.choice(['', 'en', 'en/x?y', 'fr/é#z', 'e'])}",
              rnd.choice(["", '<link rel="canonical" href="http://b.a.com/en/x">'])) for k in range(300)] + [(None, None, None), (1, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    key = repr
    short = sorted((tuple(r) for r in urls.judge_pages(df, rules).collect()), key=key)
    monkeypatch.setattr(urls, "MAX_EXPRESSION_RULES", 3)
    assert sorted((tuple(r) for r in urls.judge_pages(df, rules).collect()), key=key) == short
    table = spark.createDataFrame([(r.action, r.host, r.path) for r in urls.parse_rules(rules)], "action string, host string, path string")
    assert sorted((tuple(r) for r in urls.judge_pages(df, table).collect()), key=key) == short


def test_more_rules_than_an_expression_holds(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.example.net/p/{k}", None) for k in range(0, 3000, 7)], "page_id long, url string, html string")
    rules = [f"block h{k}.example.net/p/" for k in range(0, 2000, 2)] + ["allow h14.example.net/p/1"]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_pages(pages, rules).collect()}
    for k in range(0, 3000, 7):
        own = ("h14.example.net/p/1", "allow") if k == 14 else (f"h{k}.example.net/p/", "block") if k < 2000 and k % 2 == 0 else (None, "allow")
        assert got[k] == own


def matches_model(docs, items):
    """Maximal runs of equal words along every diagonal, by comparing every pair of words."""
    from helpers import WORD, lower
    out = []
    for i, t in docs:
        d = WORD.findall(lower(t))
        for name, x in items:
            w = WORD.findall(lower(x))
            least = min(13, len(w))
            for shift in range(-len(w), len(d)) if w else ():
                run = 0
                for p in range(len(d) + 1):
                    q = p - shift
                    if p < len(d) and 0 <= q < len(w) and d[p] == w[q]:
                        run += 1
                    elif run:
                        if run >= least:
                            out.append((i, name, p - run, q - run, run))
                        run = 0
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1 << 21, 60])
def test_maximal_matches_and_their_places(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 2)
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(6)}" for _ in range(60)]
    items = [("long", " ".join(base)), ("short", "w1 w2"), ("one", "w3"), ("same", " ".join(["w5"] * 20)), ("empty", ""), ("none", None)]
    docs = [(k, " ".join(base[a:a + rnd.randrange(5, 30)] + ["x"] * rnd.randrange(2) + base[rnd.randrange(40):])) for k, a in enumerate(range(0, 40, 5))]
    docs += [(90, " ".join(["w5"] * 25)), (91, None), (92, ""), (93, "w1 W2 w3 w1 w2")]
    table = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.find_matches(documents(spark, docs), table)
    assert found.columns == ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == matches_model(docs, items)
