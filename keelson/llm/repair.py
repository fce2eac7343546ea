"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

Each row is a symbol: its role's initial and whether it is blank, a duplicate (both must go) or truncated. Reading a symbol is a min-plus
transition over four states (nothing yet, after system, after user, after assistant), so equal consecutive symbols collapse to runs, and a
run of any length is advanced through cached binary powers of its transition (``_power``). Costs to go are computed from the end;
then the choices are unrolled from the start, the ASCII-least edit first among the cheapest. A state and an edit's initial determine
the next state, so that is the least audit.

Rows are range-partitioned and sorted by (conversation, turn, role, text). A conversation that neither begins nor ends its partition
is repaired in one pass over it. The pieces of the others, which may hold any share of all rows, meet by small summaries only: repeated rows by
an aggregate of their digests, costs to go and entry states by parallel prefix scans over one 4 x 4 matrix and one state map a
piece (``plans.scan.block_entries``). No task holds more than one range partition. A conversation's audit is one string, and its text is hashed
in order: that is one streamed pass for each conversation.

Defined cases: a null role or text counts as one space; null conversation ids are one conversation, null turns come first; rows of equal turn are
ordered by role and text; a role's initial is its first character, so any role beginning with s, u or a fits like system, user,
assistant, and an empty role fits nowhere; a conversation without rows keeps its id, with zeros and an empty audit; extra
columns are ignored; ``gaps`` beyond 64 bits stays at the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch_table
from keelson.plans.scan import block_entries
from keelson.session import default_parallelism

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1      # costs; the last one for an undeleted truncated row
NONE, SYSTEM, USER, ASSISTANT = range(4)            # states: the last role given
_FORCED = (USER, USER, ASSISTANT, USER)             # the state that a rerole or an insert leads to
_FITS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 50
_END = (0, 2 * INSERT, INSERT, 0)                   # cost to go after the last row
GONE = "-"                                          # symbol of a row that must be deleted
RANGE_BYTES = 16 << 20
_UNROLL = 1024
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def symbol(role: str, fault: str) -> str:
    """The DP's view of a row: '-' if it must go, else its role's initial (or '?') and '!' if it is truncated."""
    if fault in ("blank", "duplicate"):
        return GONE
    return (role[:1] if role[:1] in _FITS else "?") + ("!" if fault == "truncated" else "")


def _options(sym: str, q: int) -> list[tuple[str, int, int, bool]]:
    """(initial, cost, next state, row consumed) of the edits at a row in state ``q``, in ASCII order."""
    extra = TRUNCATED if sym.endswith("!") else 0
    out = [("D", DELETE, q, True), ("I", INSERT, _FORCED[q], False)]
    if sym != GONE:
        fits = _FITS.get(sym[0], {})
        if q in fits:
            out.append(("K", extra, fits[q], True))
        out.append(("R", REROLE + extra, _FORCED[q], True))
    return out


def _before(sym: str, after: tuple) -> tuple:
    """Costs to go before a row, from those after it."""
    cost = [min(c + after[to] for _, c, to, used in _options(sym, q) if used) for q in range(4)]
    for _ in range(3):                              # inserts in front of the row, at most three in a row make sense
        cost = [min(cost[q], INSERT + cost[_FORCED[q]]) for q in range(4)]
    return tuple(min(c, _FAR) for c in cost)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


@lru_cache(maxsize=1024)
def _power(sym: str, k: int) -> np.ndarray:
    """Transition of 2^k rows of one symbol."""
    if k:
        half = _power(sym, k - 1)
        return _product(half, half)
    return np.array([_before(sym, tuple(0 if q == to else _FAR for q in range(4))) for to in range(4)], np.int64).T


def _run_matrix(sym: str, n: int) -> np.ndarray:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _power(sym, k) if out is None else _product(out, _power(sym, k))
    return out


def _run_back(sym: str, n: int, after: tuple) -> tuple:
    """Costs to go before a run of ``n`` equal symbols."""
    if n < 8:
        for _ in range(n):
            after = _before_cached(sym, after)
        return after
    v = np.array(after, np.int64)
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = np.minimum((_power(sym, k) + v).min(axis=1), _FAR)
    return tuple(int(x) for x in v)


@lru_cache(maxsize=1 << 14)
def _before_cached(sym: str, after: tuple) -> tuple:
    low = min(after)
    if low:                                         # equal up to a constant: few differences occur
        return tuple(min(c + low, _FAR) for c in _before_cached(sym, tuple(min(c - low, _FAR) for c in after)))
    return _before(sym, after)


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def matrix(runs: list[tuple[str, int]]) -> np.ndarray:
    """Min-plus transition of a whole sequence of runs."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
    for sym, n in runs:
        out = _product(out, _run_matrix(sym, n))
    return out


def unroll(runs: list[tuple[str, int]], after: tuple, q: int, last: bool) -> Iterator[tuple[str, int]]:
    """(edit's initial, state after it) of the cheapest, then ASCII-least edits from state ``q``; ``last``: the conversation ends here,
    so roles still missing are inserted. Costs to go are held for the starts of the runs and of one stretch of a run."""
    ends = [after]
    for sym, n in reversed(runs):
        ends.append(_run_back(sym, n, ends[-1]))
    ends.reverse()
    for (sym, n), end in zip(runs, ends[1:]):
        for at in range(0, n, _UNROLL):
            size = min(_UNROLL, n - at)
            costs = [_run_back(sym, n - at - size, end)]
            for _ in range(size):
                costs.append(_before_cached(sym, costs[-1]))
            for k in range(size, 0, -1):
                used = False
                while not used:
                    for initial, cost, to, used in _options(sym, q):
                        if cost + (costs[k - 1] if used else costs[k])[to] == costs[k][q]:
                            break
                    q = to
                    yield initial, q
    while last and _END[q]:
        q = _FORCED[q]
        yield "I", q


# ------------------------------------------------------------------------------------------------ rows

def base_fault(text: str) -> str:
    """blank, truncated or '' of one text."""
    stripped = text.rstrip(_SPACES)
    return "blank" if not stripped else "" if stripped[-1] in ".!?" else "truncated"


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's deterministic damage; dropped rows stay as rows with ``live`` false, so that no conversation is lost."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).when(kind == 0, "").otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (kind != 0).alias("live"), F.explode(times).alias("copy")).drop("copy")


def _ranges(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, live: Column) -> DataFrame:
    """Rows in order, in range partitions of about ``RANGE_BYTES``."""
    space = F.lit(" ")
    rows = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), live.alias("live"))
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 24)).first()[0] or 0
    n = max(default_parallelism(rows.sparkSession), -(-size // RANGE_BYTES))
    # a prefix orders like the whole text and keeps the sample of range bounds small
    split = rows.repartitionByRange(n, "conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 40))
    return split.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "live")


_FIELDS = "part long, step long, whole boolean, edit string, fault string, turn long, old_role string, role string, text string"
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())


def _ddl(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_FIELDS}"


def _edit_rows(conv, part: int, step: int, rows: list[tuple], edits: Iterator[tuple[str, int]]) -> Iterator[tuple]:
    """Edits of (turn, role, text, fault) rows as output rows."""
    todo = iter(rows)
    for initial, q in edits:
        if initial == "I":
            yield conv, part, step, True, "I", "", None, None, _ROLE[q], ""
        else:
            turn, role, text, fault = next(todo)
            new = None if initial == "D" else role if initial == "K" else _ROLE[q]
            yield conv, part, step, True, initial, fault, turn, role, new, text
        step += 1


def _batches(rows: Iterator[tuple], id_type: pa.DataType, size: int = 2000) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *(f.split()[0] for f in _FIELDS.split(", "))]
    held: list[tuple] = []

    def batch():
        cols = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, *_KINDS))], names=names)
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _in_order(batches: Iterator[pa.RecordBatch], columns: tuple) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns))


def _repair_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the conversations inside one range partition; rows of its first and its last one pass on with ``whole`` false."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    id_type = first.schema.field("conv_id").type

    def stream():
        yield first
        yield from batches

    def passed(conv, rows):
        for step, (turn, role, text, live) in enumerate(rows):
            yield conv, part, step, False, "" if live else "X", "", turn, role, None, text

    def whole(conv, rows):
        seen, kept = set(), []
        for turn, role, text, live in rows:
            if live:
                fault = base_fault(text)
                key = hashlib.sha256(f"{role}\0{text}".encode("utf-8", "surrogatepass")).digest()
                if fault != "blank" and key in seen:
                    fault = "duplicate"
                seen.add(key)
                kept.append((turn, role, text, fault))
        runs = runs_of([symbol(r, f) for _, r, _, f in kept])
        step = 0
        for row in _edit_rows(conv, part, 0, kept, unroll(runs, _END, NONE, True)):
            step += 1
            yield row
        if not step:                                # all its rows were dropped
            yield conv, part, 0, True, "X", "", None, None, None, None

    def out():
        held, at, n = None, None, 0                 # the conversation being read; the first one is not held
        for conv, turn, role, text, live in _in_order(stream(), ("conv_id", "turn", "role", "text", "live")):
            if n == 0 or conv != at:
                if n > 1:
                    yield from whole(at, held)
                held, at, n, step = [], conv, n + 1, 0
            if n == 1:
                yield conv, part, step, False, "" if live else "X", "", turn, role, None, text
                step += 1
            else:
                held.append((turn, role, text, live))
        if n > 1:
            yield from passed(at, held)

    yield from _batches(out(), id_type)


def _faults(pending: DataFrame) -> DataFrame:
    """Rows of split conversations with their faults. Repeated rows are found by an aggregate of digests."""
    live = F.col("edit") == ""
    tail = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    key = F.sha2(F.concat(F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n")), F.lit("\0"), F.col("old_role"), F.lit("\0"),
                          F.col("text")), 256)
    rows = pending.withColumns({"_tail": tail, "_at": F.struct("part", "step")}) \
        .withColumn("_key", F.when(live & (F.col("_tail") != ""), key))
    first = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(first.select("_key", "_first"), "_key", "left")
    fault = F.when(~live, "").when(F.col("_tail") == "", "blank").when(F.col("_at") > F.col("_first"), "duplicate") \
        .when(F.col("_tail").isin(".", "!", "?"), "").otherwise("truncated")
    return rows.withColumn("fault", fault).drop("_tail", "_at", "_key", "_first")


def _symbols(piece: pa.Table) -> tuple[list[tuple], list[tuple[str, int]]]:
    cols = [piece.column(c).to_pylist() for c in ("turn", "old_role", "text", "fault", "edit")]
    rows = [(t, r, x, f) for t, r, x, f, e in zip(*cols) if e == ""]
    return rows, runs_of([symbol(r, f) for _, r, _, f in rows])


def _costs(b: bytes) -> tuple:
    return tuple(int(x) for x in np.frombuffer(b, np.int64))


def _repair_split(pending: DataFrame) -> DataFrame:
    """Edits of conversations whose rows lie in several range partitions (or might)."""
    kind = pending.schema["conv_id"].dataType.simpleString()
    rows = scratch_table(_faults(pending), "repair-rows")
    ids = ["conv_id", "part"]
    top = F.lit(rows.agg(F.max("part")).first()[0] or 0).cast("long")

    def small(piece: pa.Table, blob: bytes) -> pa.Table:
        one = piece.slice(0, 1)
        return pa.table([one.column("conv_id"), one.column("part"), pa.array([blob], pa.binary())], names=["conv_id", "part", "summary"])

    def transition(piece):
        return small(piece, matrix(_symbols(piece.sort_by("step"))[1]).tobytes())

    def after(piece):
        _, runs = _symbols(piece.sort_by("step"))
        to = _costs(piece.column("entry")[0].as_py())
        ends = []
        for q in range(4):
            for _, q in unroll(runs, to, q, False):
                pass
            ends.append(q)
        return small(piece, bytes(ends))

    def square(b):
        return np.frombuffer(b, np.int64).reshape(4, 4)

    def product(run):                               # from the last piece backwards
        out = square(run[0])
        for b in run[1:]:
            out = _product(square(b), out)
        return out.tobytes()

    def composed(run):
        out = bytes(range(4))
        for b in run:
            out = bytes(b[q] for q in out)
        return out

    symbols = rows.select(*ids, "step", "turn", "old_role", F.lit("").alias("text"), "fault", "edit")
    blob = f"conv_id {kind}, part long, summary binary"
    matrices = symbols.groupBy(*ids).applyInArrow(transition, blob).withColumn("back", top - F.col("part"))
    to_go = block_entries(matrices, ["conv_id"], "back", "summary", product,
                          lambda v, m: np.minimum((square(m) + np.frombuffer(v, np.int64)).min(axis=1), _FAR).tobytes(),
                          np.array(_END, np.int64).tobytes())
    to_go = scratch_table(to_go.select("conv_id", (top - F.col("idx")).alias("part"), "entry"), "repair-costs")
    ends = _meet(symbols, to_go).groupBy(*ids).applyInArrow(after, blob)
    states = block_entries(ends, ["conv_id"], "part", "summary", composed, lambda q, m: bytes([m[q[0]]]), bytes([NONE]))
    final = to_go.groupBy("conv_id").agg(F.max("part").alias("last"))
    bounds = _meet(_meet(to_go, states.select("conv_id", F.col("idx").alias("part"), F.col("entry").alias("state"))), final, ["conv_id"])

    def edits(piece):
        piece = piece.sort_by("step")
        one = {c: piece.column(c)[0].as_py() for c in ("conv_id", "part", "last", "entry", "state")}
        live, runs = _symbols(piece)
        found = list(_edit_rows(one["conv_id"], one["part"], 0, live,
                                unroll(runs, _costs(one["entry"]), one["state"][0], one["part"] == one["last"])))
        found = found or [(one["conv_id"], one["part"], 0, False, "X", *[None] * 5)]
        return pa.Table.from_batches(list(_batches(((*r[:3], False, *r[4:]) for r in found), piece.schema.field("conv_id").type)))

    return _meet(rows, bounds).groupBy(*ids).applyInArrow(edits, _ddl(pending))


def _meet(left: DataFrame, right: DataFrame, on: list[str] = ["conv_id", "part"]) -> DataFrame:  # noqa: B006
    """Inner join in which null ids are equal."""
    right = right.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]).drop(*[f"_r_{c}" for c in on])


def _staged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, live_col: str | None):
    live = F.lit(True) if live_col is None else F.coalesce(F.col(live_col), F.lit(False))
    ordered = _ranges(rows, id_col, turn_col, role_col, text_col, live)
    return ordered.mapInArrow(_repair_ranges, _ddl(ordered))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           live_col: str | None = None) -> DataFrame:
    """The edits, one row each, in the order (part, step) of their conversation: ``edit`` (K, R, D, I; X marks a conversation without rows), the
    ``fault`` and the ``old_role`` of the row, and ``role`` (null: deleted) and ``text`` after the edit."""
    staged = scratch_table(_staged(rows, id_col, turn_col, role_col, text_col, live_col), "repair-edits")
    return staged.where("whole").unionByName(_repair_split(staged.where("NOT whole")))


class _Digest:
    """What one conversation's edits, read in order, add up to."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = self.rows = 0
        self.low = self.high = self.turn = None
        self.before: str | None = None
        self.audit, self.hash, self.lines = [], hashlib.sha256(), 0

    def add(self, edit, fault, turn, old_role, role, text):
        if edit == "X":
            return
        self.audit.append(edit)
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            for name in ("blank", "duplicate", "truncated"):
                setattr(self, name, getattr(self, name) + (fault == name))
            if self.before is not None and self.before + old_role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = old_role[:1]
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
        if role is not None:
            self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self):
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(pass_on: bool):
    """Folds edits in order to one row per conversation. With ``pass_on``, rows of split conversations go on unchanged instead."""
    kinds = [*(pa.int64(),) * 6, pa.string(), pa.string()]
    edit_cols = ("part", "step", "whole", "edit", "fault", "turn", "old_role", "role", "text")
    names = [f.split()[0] for f in _REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for b in batches:
            id_type, done = b.schema.field("conv_id").type, []
            if pass_on:
                split = b.filter(pc.invert(b.column("whole")))
                if split.num_rows:
                    yield pa.RecordBatch.from_arrays([*(split.column(c) for c in ("conv_id", *edit_cols)),
                                                      *(pa.nulls(split.num_rows, k) for k in kinds)], names=["conv_id", *edit_cols, *names])
                b = b.filter(b.column("whole"))
            for conv, *edit in _in_order([b], ("conv_id", "edit", "fault", "turn", "old_role", "role", "text")):
                if digest is None or conv != at:
                    if digest is not None:
                        done.append((at, *digest.row()))
                    at, digest = conv, _Digest()
                digest.add(*edit)
            if done:
                yield made(done, id_type)
        if digest is not None:
            yield made([(at, *digest.row())], id_type)

    def made(done, id_type):
        cols = [pa.array(c, k) for c, k in zip(zip(*done), (id_type, *kinds))]
        if pass_on:
            cols[1:1] = [pa.array([True] * len(done)) if c == "whole" else pa.nulls(len(done), k) for c, k in zip(edit_cols, _KINDS)]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", *(edit_cols if pass_on else ()), *names])

    return run


def report(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           live_col: str | None = None) -> DataFrame:
    """One row per conversation: turn ``gaps``, faults, ``illegal`` neighbours, ``cost``, ``audit`` and the digest of the repaired text, folded
    from the edits of ``repair``."""
    edits = _staged(rows, id_col, turn_col, role_col, text_col, live_col)
    ddl = _ddl(edits)
    staged = scratch_table(edits.mapInArrow(_reports(True), f"{ddl}, {_REPORT}"), "repair-report")
    names = ["conv_id", *(f.split()[0] for f in _REPORT.split(", "))]
    split = _repair_split(staged.where("NOT whole").drop(*names[1:]))
    split = split.repartition("conv_id").sortWithinPartitions("conv_id", "part", "step")
    kind = edits.schema["conv_id"].dataType.simpleString()
    return staged.where("whole").select(*names).unionByName(split.mapInArrow(_reports(False), f"conv_id {kind}, {_REPORT}"))
