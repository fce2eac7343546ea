"""Suffix dedup at size: what a bucket sorts follows the text, not what a key gathers, and rows don't follow blocks times buckets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import covered, documents

from keelson.llm import suffix_dedup
from keelson.llm.common import PrefixHash


def _pieces(seed: int, contexts: int):
    """(key, piece, id): one passage between many beginnings and ends, near copies, equal and lone pieces."""
    rnd = random.Random(seed)
    words = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, left, right = words(62), [words(14) for _ in range(contexts)], [words(14) for _ in range(contexts)]
    out = [(7, (x[rnd.randint(0, 12):] + passage + y[:rnd.randint(0, 12)]), rnd.randint(0, 10**6)) for x in left for y in right]
    for key in range(20, 60):
        base = words(80)
        out += [(key, base[rnd.randint(0, 15):rnd.randint(66, 80)], rnd.randint(0, 10**6)) for _ in range(rnd.randint(1, 4))]
        out += [(key, words(9) + base[:rnd.randint(50, 70)] + words(5), rnd.randint(0, 10**6))]
    out += [(70, "x" * 75, 5), (70, "x" * 60, 4), (71, "xy" * 30, 9), (72, passage, 3)]
    return [(k, p.encode(), i) for k, p, i in out]


def _table(pieces, blocks: int) -> pa.Table:
    rows = []
    for b in range(blocks):
        mine = pieces[b::blocks]
        rows.append((b, 0, np.array([k for k, _, _ in mine], np.uint32).tobytes(), suffix_dedup._pack(np.array([len(p) for _, p, _ in mine], np.int32)),
                     suffix_dedup._pack(np.array([i for _, _, i in mine], np.int64)), suffix_dedup._pack(b"".join(p for _, p, _ in mine))))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=suffix_dedup._PIECE_NAMES)


def _answers(t: pa.Table) -> list[list[int]]:
    return [np.repeat(suffix_dedup._array(r["sizes"], np.int64), suffix_dedup._array(r["keys"], np.int32)).tolist()
            for r in suffix_dedup._answer(t).to_pylist()]


def _brute(pieces, blocks: int) -> list[list[int]]:
    n, low = suffix_dedup.LENGTH, {}
    for k, p, i in pieces:
        for a in range(len(p) - n + 1):
            low[k, p[a:a + n]] = min(i, low.get((k, p[a:a + n]), i))
    return [[low[k, p[a:a + n]] for k, p, _ in pieces[b::blocks] for a in range(len(p) - n + 1)] for b in range(blocks)]


def test_sorted_strings_stay_short(monkeypatch):
    longest = []
    sort = suffix_dedup.suffix_arrays
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda s, off: (longest.append(int(np.diff(off).max())), sort(s, off))[1])
    for contexts in (12, 48):
        pieces = _pieces(contexts, contexts)
        assert _answers(_table(pieces, 3)) == _brute(pieces, 3)
    assert longest and max(longest) < 20_000            # sorted whole, the larger passage's 2,304 pieces are over 150,000 symbols


@pytest.mark.parametrize("plan", [500, 1 << 20])
def test_answers_by_groups_of_keys(monkeypatch, plan):
    monkeypatch.setattr(suffix_dedup, "PLAN_BYTES", plan, raising=False)
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", plan, raising=False)
    for seed in range(4):
        pieces = _pieces(seed, 5)
        assert _answers(_table(pieces, 2)) == _brute(pieces, 2)


@pytest.mark.parametrize("values", [1, 3])
def test_answers_when_hashes_collide(monkeypatch, values):
    """Equal hashes of different bytes make strings longer, never answers wrong."""
    monkeypatch.setattr(PrefixHash, "spans", lambda self, a, b: (self._buf[a] % values).astype(np.uint64))
    pieces = _pieces(3, 4)
    assert _answers(_table(pieces, 2)) == _brute(pieces, 2)


def test_rows_do_not_follow_blocks_times_buckets():
    rows = {}
    for parts in (51, 600):                             # 0.5 and 6 GB of Parquet hold 0.9 and 10.4 GB of text
        buckets, block = suffix_dedup.dealing(parts)
        rows[parts] = -(-17_300_000 * parts // block) * buckets
        assert buckets >= parts
    assert rows[51] < 100_000 and rows[600] < 12 * rows[51]


def test_blocks_of_many_steps(spark, monkeypatch):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abcdef ") for _ in range(rnd.choice([0, 30, 60, 900]))) for _ in range(400)]
    rows = [(i, texts[rnd.randrange(400)][rnd.randint(0, 40):] + texts[rnd.randrange(400)] + ("z" * 150_000 if i == 33 else "")) for i in range(700)]
    buf = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    assert len(list(suffix_dedup._steps(off))) > 4
    for a, b in zip(suffix_dedup.block_runs(buf, off), suffix_dedup.runs(buf, off)):
        assert np.array_equal(a, b)
    monkeypatch.setattr(suffix_dedup, "dealing", lambda parts: (parts, suffix_dedup.BLOCK_BYTES * suffix_dedup.WIDEST))
    for hot in (2, suffix_dedup.HOT):
        got = suffix_dedup.remove_repeats(documents(spark, rows), hot=hot).collect()
        assert sorted((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in got) == covered(rows)


@pytest.mark.parametrize("bits", [33, 50, 62])
def test_stable_order(bits):
    rnd = np.random.default_rng(bits)
    values = rnd.integers(0, 1 << bits, 5000)[rnd.integers(0, 5000, 20_000)]
    assert np.array_equal(suffix_dedup._stable_order(values, bits), np.argsort(values, kind="stable"))
    assert len(suffix_dedup._stable_order(values[:0], bits)) == 0
