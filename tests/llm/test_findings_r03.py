"""Findings of round 3."""

import hashlib
import json
import random
import time
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from helpers import documents
from keelson.llm import bpe, common, decontam, queries, training_order
from keelson.session import folder_exists, scratch_path


def test_ids_are_decoded(spark, tmp_path):
    """the decoded text comes from the ids. Where an added token's characters stand for bytes, it is not the input."""
    tokenizers = pytest.importorskip("tokenizers")
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    size = bpe.vocab_size(queries.tokenizer_path())
    spec["added_tokens"].append({"id": size, "content": "é!", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = f"{tmp_path}/tokenizer.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    rows = [(1, "café! or café"), (2, "plain text"), (3, ""), (4, None), (5, "é!")]
    library = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.token_digests(documents(spark, rows), path).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert got[5].decoded_sha256 != hashlib.sha256("é!".encode()).hexdigest()


def test_pipeline_decodes_ids(spark, tmp_path, monkeypatch):
    """so does the pipeline's last stage."""
    tokenizers = pytest.importorskip("tokenizers")
    path = _with_added(tmp_path, "é!")
    monkeypatch.setattr(corpus_pipeline, "tokenizer_path", lambda: path)
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "café! or café"), (2, "plain text"), (3, "é!"), (4, None)]
    got = {r.doc_id: r.decoded_sha256 for r in dict(corpus_pipeline.STAGES)["bpe"](spark, documents(spark, rows), "").collect()}
    back = {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in back.items()}
    assert back[3] != "é!"


def test_workers_give_back_what_batches_freed(spark, monkeypatch):
    """pipeline: a worker of its last stages kept the most that any batch had taken, and that of the stages before."""
    found, released = [], []
    rows = documents(spark, [(1, "one two three"), (2, None)])
    kind, real = type(rows), type(rows).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **kw: found.append(run) or real(self, run, *a, **kw))
    monkeypatch.setattr(common, "release_memory", lambda: released.append(1))
    bpe.token_digests(rows, queries.tokenizer_path())
    bpe.packed_ids(rows, queries.tokenizer_path())
    decontam.remove_contaminated(rows, spark.createDataFrame([("a", "four five six")], "item_id string, text string"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three", None]})
    for run in (found[0], found[1], found[-1]):
        before = len(released)
        assert sum(b.num_rows for b in run(iter([batch] * 3))) == 6
        assert len(released) - before >= 3
    common.enter_task("one that keeps nothing")
    before = len(released)
    common.enter_task("another")
    assert len(released) == before + 1 and len(common._powers(5)[0]) >= 5
    common.enter_task("another")
    assert len(released) == before + 1


def test_long_pieces_are_kept_by_their_bytes(monkeypatch):
    """pipeline: texts without spaces or ASCII are long pieces; as many as were kept could take 100 MB and more of a worker."""
    monkeypatch.setattr(bpe, "LONG_CACHE", 40_000, raising=False)
    c = bpe.BpeCodec(queries.tokenizer_path())
    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)) for _ in range(200)]
    got = [c.encode(t) for t in texts]
    assert sum(len(p) + len(e) for kept in c.long for p, e in kept.items()) <= 40_000 + 2 * 4_000
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [c.encode(t) for t in texts] == got


def _with_added(tmp_path, content):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": bpe.vocab_size(queries.tokenizer_path()), "content": content, "single_word": False, "lstrip": False,
                                 "rstrip": False, "normalized": False, "special": True})
    path = f"{tmp_path}/tokenizer.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    return path


@pytest.mark.parametrize("kept", [8, 300, 1 << 20])
def test_pieces_are_tokens_of_their_own(kept, monkeypatch):
    """op3_training_order: wherever texts are cut, their ids are the library's, whatever the table of pieces still holds."""
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "CACHE_PIECES", kept)
    monkeypatch.setattr(bpe, "LONG_PIECES", 4)
    monkeypatch.setattr(bpe, "BLOCK", 500)
    atoms = [*"abtsdmlvre''' \n\t\r\x0b.,;!\"()0157éñ中文日\xa0 　\x85\x1c\x00\x7f😀«’́", "'s", "'re", "  ", " \n", "\n\n", "\t ", "word", "don't", " the",
             "<|endoftext|>", "x" * 60, "\0\0", "café", "a" * 23, "b" * 24]
    rnd = random.Random(kept)
    texts = ["".join(rnd.choices(atoms, k=rnd.choice([0, 1, 2, 3, 5, 8, 20, 60]))) for _ in range(3000)]
    library, c = tokenizers.Tokenizer.from_file(queries.tokenizer_path()), bpe.BpeCodec(queries.tokenizer_path())
    for k in range(0, len(texts), 250):
        part = texts[k:k + 250]
        got = [np.frombuffer(x, c.type).tolist() for x in c.packed(part)]
        assert got == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    assert c.table.n <= max(kept, 8)


def test_plain_words_are_encoded_in_bulk(monkeypatch):
    """op3_training_order: ASCII text is cut into words and these are looked up in arrays, without a Python call a word."""
    c = bpe.BpeCodec(queries.tokenizer_path())
    monkeypatch.setattr(bpe, "_PRE", None)
    texts = ["The price rose, by 12.5 (see \"notes\"). Then it fell.", "", "anonly hthat"]
    for _ in range(2):
        assert c.decoded(c.packed(texts)) == texts


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_training_order_keeps_one_copy_of_ids(spark, broadcast_rows, monkeypatch):
    """op3_training_order: each range of shards gives up its shuffle files, and without a broadcast the ids are not kept twice."""
    monkeypatch.setattr(training_order, "BROADCAST_ROWS", broadcast_rows)
    rows = [(k // 2, f"{k % 7} " * (k % 50)) for k in range(200)] + [(None, "no id"), (None, "no id"), (5, None)]
    docs = bpe.encode_documents(documents(spark, rows), queries.tokenizer_path()).collect()
    size = bpe.vocab_size(queries.tokenizer_path())
    df = spark.createDataFrame([(r.doc_id, r.ids) for r in docs], "doc_id long, ids array<int>")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x for x in files.getAllFiles().mkString(" ").split() if x.endswith(".data") and "/shuffle_" in x}
    spark.sparkContext._jvm.System.gc()
    before = shuffles()
    made = []
    monkeypatch.setattr(training_order, "scratch_path", lambda s, name: made.append(scratch_path(s, name)) or made[-1])
    slots, layout = training_order.materialize(df, 5, length=16, shard_rows=40, tokens_col="ids", vocab_size=size)
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left
    held = [p for p in made if "order-ids" in p]
    assert len(held) == 1 and not folder_exists(spark, held[0])     # rows repeat here, so that the ids were dealt once more
    by_slot = {r.slot: r for r in slots.collect()}
    assert sorted(by_slot) == list(range(layout.sequences))
    parts = defaultdict(list)
    for s, ids in enumerate(training_order.read_slots(spark, layout)):
        parts[by_slot[s].doc_id].append((by_slot[s].seq, ids.tolist()))
    got = sorted((-1 if i is None else i, [x for _, p in sorted(v) for x in p].count(size)) for i, v in parts.items())
    counts = Counter(-1 if r.doc_id is None else r.doc_id for r in docs)
    assert got == sorted(counts.items())
    want = Counter(tuple(r.ids) for r in docs)
    ended = [x for _, v in sorted(parts.items(), key=lambda p: str(p[0])) for _, p in sorted(v) for x in p]
    texts, row = Counter(), []
    for x in ended:
        if x == size:
            texts[tuple(row)] += 1
            row = []
        else:
            row.append(x)
    assert texts == want
