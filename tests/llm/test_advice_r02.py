"""Cases named by the review of round 2."""

from collections import defaultdict

import numpy as np
import pytest
from helpers import documents

from keelson.llm import bpe, pii, quality, queries, toxicity, training, training_order


@pytest.mark.parametrize("vocab_size", [50_257, 70_000])
def test_training_order_of_token_ids(spark, docs_small, vocab_size):
    """Shards hold the ids of the vocabulary, over 255 too, two or four bytes each."""
    rows = docs_small[:40] + docs_small[-14:]
    path = queries.tokenizer_path()
    assert bpe.vocab_size(path) == len(bpe.BpeCodec(path).bytes_of) <= vocab_size
    docs = bpe.encode_documents(documents(spark, rows, extra=True), path)
    slots, layout = training_order.materialize(docs, 5, length=64, shard_rows=40, tokens_col="ids", vocab_size=vocab_size)
    assert layout.stride == 65 * (2 if vocab_size < 65_535 else 4)
    by_slot = {r.slot: r for r in slots.collect()}
    assert sorted(by_slot) == list(range(layout.sequences))
    got = list(training_order.read_slots(spark, layout))
    assert [g.tolist() for g in training_order.read_slots(spark, layout, 35, 95)] == [g.tolist() for g in got[35:95]]
    parts = defaultdict(list)
    for s, ids in enumerate(got):
        assert len(ids) == by_slot[s].n_tokens
        assert by_slot[s].byte_offset == s % 40 * layout.stride
        parts[by_slot[s].doc_id].append((by_slot[s].seq, ids))
    seen = {i: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]).tolist() for i, v in parts.items()}
    c, want = bpe.BpeCodec(path), defaultdict(list)
    for i, t in rows:
        want[i].append(c.encode(t or "") + [vocab_size])
    assert {i: sorted(_ended(v, vocab_size)) for i, v in seen.items()} == {i: sorted(v) for i, v in want.items()}
    assert max(map(max, seen.values())) == vocab_size and max(x for v in seen.values() for x in v if x < vocab_size) > 255


def _ended(ids, end):
    out, row = [], []
    for x in ids:
        row.append(x)
        if x == end:
            out.append(row)
            row = []
    return out


def test_training_order_query_reads_bpe_ids(spark):
    sf = "/root/testdata/sf0.001"
    got = defaultdict(int)
    for r in queries.op3_training_order(spark, sf).collect():
        got[r.doc_id] += r.n_tokens
    want = {r.doc_id: r.n_tokens + 1 for r in queries.op9_bpe(spark, sf).collect()}
    assert got == want


def test_packed_ids_equal_encoding(spark, docs_small):
    path = queries.tokenizer_path()
    rows = docs_small[-14:] + [(9300, "a <|endoftext|> b  c")]
    got = [(r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in bpe.packed_ids(documents(spark, rows), path).collect()]
    c = bpe.BpeCodec(path)
    assert sorted(got) == sorted((i, c.encode(t or "")) for i, t in rows)


def test_training_order_refuses_foreign_ids(spark):
    docs = spark.createDataFrame([(1, [3, 10])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        training_order.materialize(docs, 5, tokens_col="ids", vocab_size=10)


class _Known(toxicity.ToxicityModel):
    """A model whose logit is the text's only word."""

    def logits(self, ids, first):
        return ids[:, 0] / 1000


def test_toxicity_threshold_is_that_of_the_population():
    """A balanced sample and a natural one of the same population give about the same cuts."""
    rng = np.random.default_rng(11)

    def cuts(clean, toxic):
        logits = np.concatenate([rng.normal(-1.5, 1, clean), rng.normal(1, 1, toxic)])
        data = [(np.array([[x * 1000, 0, 0, 0]], np.int32), int(k >= clean), ("en", "de")[k % 2]) for k, x in enumerate(logits)]
        model = _Known(None, [], None, None, 0.0)
        toxicity._calibrate(model, [data[i] for i in rng.permutation(len(data))], 0.1)
        return [model.threshold, model.by_lang["en"], model.by_lang["de"]]

    natural, balanced = cuts(90_000, 10_000), cuts(50_000, 50_000)
    assert natural == pytest.approx(balanced, abs=0.07)


@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"])
@pytest.mark.parametrize("after", ["", " ok", " The transfer", " BIC COBADEFF", " I paid", " 2024", " 12 A", ", X", " DE89 3704 0044 0532 0130 00"])
def test_iban_ends_by_itself(iban, after):
    text = f"to {iban}{after}"
    spans = [text[s:e] for s, e, k, _ in pii.all_spans(text) if k == "iban"]
    assert spans == [iban] + ([after[1:]] if after.startswith(" DE89") else [])
    assert pii._mask(text, pii.MIN_SCORE).startswith(f"to <IBAN>{'' if after.startswith(' DE89') else after}")


def test_iban_refusals_and_unknown_country():
    kinds = lambda t: [k for _, _, k, _ in pii.all_spans(t)]
    assert kinds("DE89 3704 0044 0532 0130 01 The") == [] and kinds("DE89370400440532013000x") == []
    assert kinds("xDE89370400440532013000") == [] and kinds("DE89  370400440532013000") == []
    code = next(f"ZZ{c:02d}" for c in range(2, 99) if pii.mod97(f"ZZ{c:02d}ABCD12345678901"))
    assert kinds(f"{code} ABCD 1234 5678 901 Then") == ["iban"]
    assert kinds("AA00 " * 40_000) == [] and kinds("ZZ00" + "A" * 200_000) == []


@pytest.mark.parametrize("module, max_bytes", [(quality, 10_000), (toxicity, 40_000)])
def test_sample_over_its_bytes_is_no_prefix_of_the_table(spark, monkeypatch, module, max_bytes):
    """Over the bound, both classes and all parts of the table stay in the sample, in any order of the table."""
    seen = []
    monkeypatch.setattr(module, "train", lambda rows, share: seen.append(rows))
    rows = [(i, f"{'fair' if i < 200 else 'vile'} w{i} " * 30) for i in range(400)]         # first all of one class
    labels = spark.createDataFrame([(i, int(i >= 200), int(i >= 200)) for i in range(400)], "doc_id long, quality int, toxic int")
    for order in (rows, rows[::-1]):
        module.fit(documents(spark, order).coalesce(1), labels, max_bytes=max_bytes)
    plain = [sorted(map(tuple, s)) for s in seen]
    assert plain[0] == plain[1] and 20 < len(plain[0]) < 200
    ones = sum(r["label"] for r in seen[0])
    assert abs(2 * ones - len(seen[0])) <= 1
    assert sum(len(x) for r in seen[0] for x in r if isinstance(x, (bytes, bytearray))) <= max_bytes


def test_long_text_does_not_end_the_sample(spark):
    """One labelled text beyond the whole bound, first in the table: the model still learns both classes."""
    rows = [(0, "what a nice day it is " * 20_000)] + [(i, "you vile fool go" if i % 2 else "what a nice day it is") for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = documents(spark, rows).coalesce(1)
    kept = toxicity.reject(docs, toxicity.fit(docs, labels, max_bytes=1 << 16))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_thinned_documents_keep_all_parts():
    ids = np.arange(4000).reshape(1000, 4)
    assert toxicity._thinned(ids, 1000) is ids
    got = toxicity._thinned(ids, 600)
    assert len(got) <= 600 and got[0, 0] == 0 and got[-1, 0] == 3996
    assert toxicity._thinned(ids, 10).shape == (10, 4)


def test_sample_takes_turns():
    assert training._chosen([[(0, 1), (1, 1), (2, 9)], [(3, 1)]], 320) == [0, 3, 1, 2]
    assert training._chosen([[(0, 9), (1, 9), (2, 9)], [(3, 11), (4, 9)]], 320) == [0, 4, 1, 2]
    assert training._chosen([[(k, 10) for k in range(50)], []], 320) == list(range(32))
