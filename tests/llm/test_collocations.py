"""Collocations: the FM-index against counting, the whole operator against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import lower

from keelson.llm import collocations as col
from keelson.llm.fmindex import FMIndex

OUT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    return [w for p in re.split("[.,;:!?\n-\r]", lower(text)) if (w := re.findall("[^ \t]+", p))]


def model(docs, least, top=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i:i + size] for q, a in cands.items() for size in range(2, len(q)) for i in range(len(q) - size + 1)
                if a >= cands[q[i:i + size]]}
        rows = []
        for p, a in cands.items():
            if p not in gone:
                score, _, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        rows.sort()
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def result(df):
    assert df.columns == OUT
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "New", "york", "city", "é", "日本", "x1", "\x00", "ÀB", "b-c"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", "!?", "\x0b"]
    fixed = "one two three four five six"
    docs = [("".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 60))) + (fixed if rnd.random() < .3 else ""),
             rnd.choice(["en", "en", "de", None, "und"])) for _ in range(n)]
    return docs + [(None, "en"), ("", None), (" . ", "fr"), ("lonely", "it"), docs[0], docs[0]]


def frame(spark, docs):
    full = [(t, lang, 1, 2, b"x", "y") for t, lang in docs]
    return spark.createDataFrame(full, "text string, lang string, shard long, total long, words binary, phrase string")


def test_index_counts_extensions():
    rnd = np.random.default_rng(1)
    for trial in range(30):
        text = rnd.integers(0, rnd.integers(2, 6), rnd.integers(1, 200)).astype(np.int32)
        text = np.concatenate([[0], text, [0]]).astype(np.int32)
        if not text.any():
            continue
        index = FMIndex(text, 5)
        for turns in ("rrrr", "llll", "rlrl", "lrrl"):
            p = index.single()
            for length, turn in enumerate(turns, 2):
                p = index.right(p) if turn == "r" else index.left(p)
                want = Counter(tuple(map(int, text[i:i + length])) for i in range(len(text) - length + 1) if text[i:i + length].all())
                assert dict(zip(map(tuple, p.symbols.tolist()), p.count.tolist())) == want


def test_words_and_breaks():
    docs = [t or "" for t, _ in corpus(3)]
    buf = np.frombuffer("".join(docs).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in docs])])
    words, begins = col.words_of(buf, off)
    want = [(w.encode(), k == 0) for t in docs for p in pieces(t) for k, w in enumerate(p)]
    assert list(zip(words.to_pylist(), begins.tolist())) == want


@pytest.mark.parametrize("tokens,least", [(40, 3), (400, 5), (10 ** 6, 2)])
def test_equals_brute_force(spark, tokens, least):
    docs = corpus(tokens)
    got = col.collocations(*col.frequent_phrases(frame(spark, docs).repartition(5), least, shard_tokens=tokens))
    assert result(got) == model(docs, least)


def test_rank_bound_and_equal_scores(spark):
    rnd = random.Random(9)
    docs = [(" ".join(f"{rnd.choice('abcdefgh')}{k % 7}" for k in range(300)), "en") for _ in range(30)]
    got = col.collocations(*col.frequent_phrases(frame(spark, docs), 4, shard_tokens=500), top=25)
    assert result(got) == model(docs, 4, 25)


def test_long_text_and_one_common_phrase(spark):
    docs = [("alpha beta gamma delta. " * 4000 + "tail", "en"), ("alpha beta " * 3000, "en")]
    got = col.collocations(*col.frequent_phrases(frame(spark, docs), 100, shard_tokens=1000))
    assert result(got) == model(docs, 100)


def test_products_beyond_64_bits(spark):
    big = 10 ** 12
    phrases = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, big + 7)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10 ** 15 + 3)], "lang string, n long")
    row = col.collocations(phrases, totals).collect()
    assert [tuple(r) for r in row] == [("en", 1, "a b", big + 7, 3 * big, 2 * big + 1, 10 ** 15 + 3,
                                        1000 * (big + 7) * (10 ** 15 + 3) // (3 * big * (2 * big + 1)))]


def test_empty_table(spark):
    assert result(col.collocations(*col.frequent_phrases(frame(spark, [])))) == []
