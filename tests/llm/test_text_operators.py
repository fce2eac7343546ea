"""PII, BPE, fingerprints: map-like operators against plain models."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import documents

from keelson.llm import bpe, fingerprint, pii, queries

PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
            "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def base_model(t):
    out = []
    for k, p in PATTERNS.items():
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], list(PATTERNS).index(x[2])))


def test_base_spans_equal_patterns(docs_small):
    rnd = random.Random(1)
    parts = [*"ab1290.+-@ ()%_é", "4242424242424242", "4242 4242-4242 4242", "1.2.3.4", "1.2.3.400", "a@b.c", "+1 (283) 555-6500"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(5000)] + [t or "" for _, t in docs_small]
    for t in texts:
        assert pii.base_spans(t) == base_model(t), t


def test_validators_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = lambda t: [k for _, _, k, _ in pii.all_spans(t)]
    assert kinds("IBAN GB82WEST12345698765432 ok") == ["iban"]
    assert kinds("GB82WEST12345698765433") == []
    assert kinds("call me: 555-123-4567") == ["phone_local"] and kinds("order 555-123-4567") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("see 123-45-6789") == []
    assert kinds("9" * 200_000) == [] and kinds("a" * 200_000 + "@") == []


def test_pii_table_cases(spark, docs_small):
    rows = docs_small[-14:] + [(1, "x a@b.co y +1 (283) 555-6500"), (1, "x a@b.co y +1 (283) 555-6500")]
    df = documents(spark, rows, extra=True)
    got = sorted(map(tuple, pii.pii_digest(pii.find_pii(df)).collect()))
    assert len(got) == len(rows)
    one = got[0]
    assert one[:5] == (1, 1, 0, 0, 1) and got[1] == one
    assert one[6] == "email:2:8,phone:11:28" and one[5] == hashlib.sha256(one[6].encode()).hexdigest()
    assert [g for g in got if g[0] == 9000][0][5:] == (hashlib.sha256(b"").hexdigest(), "")
    masked = {(r.doc_id, r.text) for r in pii.mask_pii(df).collect()}
    assert (1, "x <EMAIL> y <PHONE>") in masked and (9000, None) in masked
    assert pii.mask_pii(df).columns == df.columns
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_library(tokenizer, docs_small):
    c = bpe.BpeCodec(queries.tokenizer_path())
    rnd = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "'s", "'ll", "!!", "<|endoftext|>", " ", "　", "\x1c",
             "​", "aaaa", "the", " The", "😀", "\r\n", "%", "ß", "\x00", "٣", "²"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [t or "" for _, t in docs_small] + ["a" * 20_000, "ab" * 5000, " " * 3000, "x1" * 2000, "=" * 3001]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts, want):
        assert c.encode(t) == ids, t[:80]
        assert c.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_cache_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    c = bpe.BpeCodec(queries.tokenizer_path())
    for k in range(20):
        t = " ".join(f"word{k}x{i % 7}" for i in range(30))
        assert c.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_table_cases(spark, docs_small, tokenizer):
    df = documents(spark, docs_small[-14:], extra=True)
    got = {r.doc_id: r for r in bpe.token_digests(df, queries.tokenizer_path()).collect()}
    for i, t in docs_small[-14:]:
        if i in (9006, 9011):
            continue
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.encode_documents(df, queries.tokenizer_path()).collect()}
    assert back[9000] == "" and back[9009] == dict(docs_small)[9009]


def test_fingerprint_properties():
    rnd = np.random.default_rng(4)
    texts = [b"", b"a", b"abc", b"abcd", b"abcd", *[bytes(rnd.integers(97, 123, n, dtype=np.uint8)) for n in (50, 3000, 9000)]]
    d = fingerprint.text_digests(texts)
    assert (d[3] == d[4]).all() and d.shape == (len(texts), fingerprint.DIGEST_BYTES)
    assert (np.concatenate([fingerprint.text_digests([t]) for t in texts]) == d).all()
    assert (fingerprint.likeness(d, d) == 1).all()
    far = fingerprint.difference(d[[0, 7]], d[[7, 0]])
    assert far[0] == far[1] and 0 <= far[0] <= fingerprint.MAX_DIFF
    long = b"abcdefghij" * 900_000                       # over the slice size
    one = fingerprint.text_digests([long])
    assert fingerprint.likeness(one, fingerprint.text_digests([long[:-400_000]]))[0] > 0.9


@pytest.mark.parametrize("parts", ["1", "5"])
def test_neighbour_fingerprints(spark, docs_small, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, queries.fingerprint.digest_text(fingerprint.neighbour_fingerprints(
            documents(spark, docs_small, extra=True))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted((i, t or "") for i, t in docs_small)
    want = []
    fp = fingerprint.text_digests([t.encode() for _, t in rows])
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        e = fingerprint.edited_copy(t, rows[n][1]).encode()
        ef = fingerprint.text_digests([e])
        want.append((i, len(t), hashlib.sha256(e).hexdigest(), fp[k].tobytes().hex(), ef[0].tobytes().hex(),
                     float(fingerprint.likeness(fp[k:k + 1], ef)[0]), float(fingerprint.likeness(fp[k:k + 1], fp[n:n + 1])[0])))
    assert got == sorted(want)


def test_neighbour_fingerprints_small_tables(spark):
    assert fingerprint.neighbour_fingerprints(documents(spark, [(1, "x")]).limit(0)).count() == 0
    (row,) = fingerprint.neighbour_fingerprints(documents(spark, [(1, "abcdefgh")])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdefab").digest()


def test_edited_copy():
    assert fingerprint.edited_copy("abcdefgh", "XYZ") == "abcdefXY"
    assert fingerprint.edited_copy("abcdefgh", "X") == "abcdefX" and fingerprint.edited_copy("abc", "X") == "abc"
