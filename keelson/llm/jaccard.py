"""N-gram Jaccard join: documents linked by the overlap of their word shingles, and the groups that links form.

Links are the entries of a sparse matrix product (documents x shingles times its transpose) that reach a size-derived bound. A group of near copies has
a square number of them, so the product is not formed as such: column blocks sieve out rows without links, and of the others only the
entries that the components need are computed. All bounds are exact, so no link is lost:

1. *Classes.* A document becomes the set of its 64-bit shingle hashes; equal sets form one class, so exact copies
   are never compared.
2. *Sieve.* A set with a link has at most ``n - ceil(t n)`` shingles that the other set lacks. The shingles below
   a fixed hash threshold (a share ``SIEVE`` of all) are dealt by hash range to column blocks, each of which reports which
   of its shingles occur in one document only. A document with too many of those in its sample is out. Shingles travel as
   packed arrays, a few bytes each; texts never move.
3. *Candidates.* Survivors order their shingles from rare to common and keep the first ``n - ceil(t n) + 1``; linked
   sets share one of these. In the documents of one such shingle, a few probes are compared with all others;
   components of verified links are formed, and only documents still in different components go on. Shingles of up to
   ``SMALL`` documents then compare all that is left.
   The documents of larger ones form families (joined by shared candidate shingles). A family has a centre C, the
   shingles of most of its sets, and each set A a difference D(A) to C. As sets, the difference of A and B has
   ``d(A) + d(B) - 2 |D(A) n D(B)|`` shingles, and they are linked when that is at most ``(a + b) (1 - t) / (1 + t)``. So either
   the sizes alone suffice: then both are also linked to the family's set that is nearest to the centre, and a star around it
   finds them; or the differences overlap, and as they are sparse and mostly rare, a prefix filter over them, with
   the exact bound of each pair, finds these. Groups of copies so take a near linear number of products.
4. *Product.* Each candidate pair's overlap is accumulated over column blocks (hash ranges) and dropped as soon as the
   columns left cannot reach the bound ``o >= t (a + b - o)``.

Defined cases: a null or empty text, or one of blanks, has an empty set and no links; a text of fewer than five words is
one shingle, its whole word sequence; equal sets are linked; repeated rows repeat and share a component; rows of one id
with different texts are judged each by its text; a row without an id has its own count, no component and no links, and is kept; extra columns are
ignored by ``near_duplicate_groups`` and kept by ``keep_first``. Different sets are told apart by 128 bits; if two should agree in the first half the run
fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import (PrefixHash, bounded_batches, byte_class, enter_task, known_ids, lowered_values, mix64, release_memory,
                                scratch_table, string_array, text_chunks, word_spans)
from keelson.llm.graph import components

SHINGLE = 5
PERCENT = 80
SIEVE = 0.4
BLOCK_BYTES = 1 << 20
PROBES = 4
SMALL = 64
BROADCAST_IDS = 1_000_000
_NON_BLANK = ~byte_class((0x09, 0x0D), (0x20, 0x20))
_VALUES = lowered_values()
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of every row."""
    start, end, first = word_spans(buf, off, _NON_BLANK)
    words = PrefixHash(buf, _VALUES).spans(start, end)
    rows = len(off) - 1
    n_words = np.diff(first)
    last = np.repeat(first[1:], n_words)
    row = np.repeat(np.arange(rows), n_words)
    at = np.flatnonzero(np.arange(len(words)) + width <= last)
    h = words[at].copy()
    for k in range(1, width):
        h = h * _STEP + words[at + k]
    h, row = mix64(h), row[at]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short.tolist()):
            x = np.array([n_words[r]], np.uint64)
            for k in range(first[r], first[r + 1]):
                x = x * _STEP + words[k:k + 1]
            extra[i] = x[0]
        h, row = np.concatenate([h, mix64(extra)]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))


def _class_keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: the class id and a second check."""
    n = np.diff(off)
    out = []
    for salt in (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344)):
        c = np.concatenate([[_U(0)], np.cumsum(mix64(h ^ salt), dtype=np.uint64)])
        out.append(mix64((c[off[1:]] - c[off[:-1]]) + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Smallest overlap that a linked set of n shingles has."""
    return (PERCENT * n + 99) // 100


def _pass_one(buckets: int):
    limit = _U(int(SIEVE * 2.0 ** 64))
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        enter_task("jaccard")
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, marks = (known_ids(b.column(k))[0] for k in (0, 2))
            for at, buf, off in text_chunks(string_array(b, "text"), BLOCK_BYTES):
                block += 1
                h, cut = shingle_sets(buf, off)
                n = np.diff(cut)
                cid, check = _class_keys(h, cut)
                row = np.repeat(np.arange(len(n), dtype=np.int32), n)
                pick = h < limit
                h, row = h[pick], row[pick]
                info = np.stack([ids[at:at + len(n)], n, np.bincount(row, minlength=len(n)), cid, check, marks[at:at + len(n)]])
                bucket = ((h & _U(0xFFFFF)) % _U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keys = ((h >> _U(20)) & _U(0xFFFFFFFF)).astype(np.uint32)[order]
                row = row[order]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = [k for k in range(buckets) if ends[k] < ends[k + 1]]
                names = [*used, buckets + block % buckets]
                rows = [row[ends[k]:ends[k + 1]].tobytes() for k in used] + [info.tobytes()]
                blobs = [keys[ends[k]:ends[k + 1]].tobytes() for k in used] + [b""]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([block] * len(names), pa.int64()), pa.array(rows, pa.binary()),
                     pa.array(blobs, pa.binary())], schema=schema)
        release_memory()

    return run


def _column_block(buckets: int):
    """One column block: for every document block, the rows whose shingles also occur in another document."""
    schema = pa.schema([("block", pa.int64()), ("info", pa.bool_()), ("rows", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        block, rows = t.column("block"), t.column("rows").to_pylist()
        if t.num_rows and t.column("bucket")[0].as_py() >= buckets:
            return pa.table([block, pa.array([True] * t.num_rows), pa.array(rows, pa.binary())], schema=schema)
        parts = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
        keys = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cut = np.cumsum([len(p) for p in parts])[:-1]
        hits = [np.frombuffer(r, np.int32)[f].tobytes() for r, f in zip(rows, np.split(twice, cut))]
        return pa.table([block, pa.array([False] * len(hits)), pa.array(hits, pa.binary())], schema=schema)

    return run


def _document_block(t: pa.Table) -> pa.Table:
    """One block of documents: which of them can have a link."""
    info, hits = None, []
    for is_info, rows in zip(t.column("info").to_pylist(), t.column("rows").to_pylist()):
        if is_info:
            info = np.frombuffer(rows, np.int64).reshape(6, -1)
        else:
            hits.append(np.frombuffer(rows, np.int32))
    ids, n, sampled, cid, check, mark = info
    hit = np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else np.zeros(len(ids), np.int64)
    keep = (n > 0) & (hit >= sampled - (n - _least_overlap(n)))
    return pa.table([pa.array(ids), pa.array(n), pa.array(cid), pa.array(check), pa.array(keep), pa.array(mark)],
                    names=["doc_id", "n", "cid", "check", "keep", "mark"])


def _set_rows(batches):
    """cid, n and the sorted set (as signed numbers) of each text."""
    for b in batches:
        for _, buf, off in text_chunks(string_array(b, "text"), BLOCK_BYTES):
            h, cut = shingle_sets(buf, off)
            cid, _ = _class_keys(h, cut)
            n = np.diff(cut)
            signed = h.view(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            signed = signed[np.lexsort((signed, row))]
            sets = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed))
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n), sets], ["cid", "n", "shingles"]).filter(some)
    release_memory()


def overlap_reaches(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, blocks: int = 4) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``percent``? Overlaps are added up block by block of the
    shared column range; the pair is dropped once the rest cannot reach the bound."""
    if len(a) > len(b):
        a, b = b, a
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    total, step = 0, -(-len(a) // blocks)
    for i in range(0, len(a), step):
        part = a[i:i + step]
        at = np.searchsorted(b, part)
        total += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        if total >= need:
            return True
        if total + len(a) - i - len(part) < need:
            return False
    return total >= need


def _linked(batches):
    for b in batches:
        sets = []
        for k in (2, 3):
            col = b.column(k)
            off = np.asarray(col.offsets)
            sets.append((np.asarray(col.values), off))
        (va, oa), (vb, ob) = sets
        ok = [overlap_reaches(va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))
    release_memory()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst of the pairs (a, b) that are linked."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_linked, "src long, dst long")


def _pairs(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct pairs of a probe and a member of the same shingle whose sizes allow a link."""
    p = probes.select("h", F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"))
    small, large = F.least("n", "pn"), F.greatest("n", "pn")
    return (members.join(p, "h").where((F.col("comp") != F.col("pc")) & (small * 100 >= large * PERCENT))
            .select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct())


def _in_components(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``members`` with the component of each set as ``comp``."""
    if comp is None:
        return members.withColumn("comp", F.col("cid"))
    named = comp.select(F.col("node").alias("cid"), "label")
    return members.join(named, "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")


def _links(sets: DataFrame) -> DataFrame | None:
    """All verified links that the components need, as (src, dst); None if there is no candidate."""
    rows = sets.select(F.explode("shingles").alias("h"), "cid", "n")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(common, "h")
    by_set = Window.partitionBy("cid")
    ranked = shared.select("h", "cid", "n", F.row_number().over(by_set.orderBy("df", "h")).alias("rank"),
                           F.count("*").over(by_set).alias("shared"))
    # shingles of one set only come first in the order, so they use up places of the prefix
    places = F.expr(f"n - div({PERCENT} * n + 99, 100) + 1 - (n - shared)")
    prefix = scratch_table(ranked.where(F.col("rank") <= places).select("h", "cid", "n"), "jaccard-prefix")
    members = _in_components(prefix, None)
    order = Window.partitionBy("h").orderBy(F.xxhash64("cid"), "cid")
    probes = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PROBES).drop("r")
    links = scratch_table(_verified(_pairs(members, probes), sets), "jaccard-links")
    if links.isEmpty():
        comp = None
    else:
        comp = components(links, "jaccard")
    # shingles whose documents are still in more than one component
    members = _in_components(prefix, comp)
    split = members.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    split = split.where((F.col("lo") < F.col("hi")) & (F.col("size") > PROBES)).select("h", "size")
    open_ = scratch_table(members.join(split, "h"), "jaccard-open")
    small, large = (open_.where(w).drop("size") for w in (f"size <= {SMALL}", f"size > {SMALL}"))
    if not small.isEmpty():
        links = links.unionByName(scratch_table(_verified(_pairs(small, small), sets), "jaccard-links"))
    if not large.isEmpty():
        links = _family_links(large, sets, links)
    return links


def _differences(batches):
    """family, cid, n and the sorted difference of a set to its family's centre."""
    for b in batches:
        out = []
        cols = [(np.asarray(b.column(k).values), np.asarray(b.column(k).offsets)) for k in (3, 4)]
        for i in range(b.num_rows):
            a, c = (v[o[i]:o[i + 1]] for v, o in cols)
            out.append(np.setxor1d(a, c, assume_unique=True))
        off = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        values = np.concatenate(out) if out else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(np.int64)))],
                                         ["family", "cid", "n", "diff"])


def _family_links(large: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and the further ones inside families."""
    hub = large.groupBy("h").agg(F.min("cid").alias("src"))
    families = components(large.join(hub, "h").select("src", F.col("cid").alias("dst")).where("src <> dst"), "jaccard-family")
    in_family = families.select(F.col("node").alias("cid"), F.col("label").alias("family"))
    rows = scratch_table(sets.dropDuplicates(["cid"]).join(in_family, "cid"), "jaccard-families")
    sizes = rows.groupBy("family").agg(F.count("*").alias("members"))
    centre = (rows.select("family", F.explode("shingles").alias("h")).groupBy("family", "h").agg(F.count("*").alias("df"))
              .join(sizes, "family").where("2 * df > members").groupBy("family").agg(F.collect_list("h").alias("centre")))
    centre = centre.select("family", F.array_sort("centre").alias("centre"))
    dealt = rows.join(centre, "family", "left").select(
        "family", "cid", "n", "shingles", F.coalesce("centre", F.array().cast("array<long>")).alias("centre"))
    diffs = scratch_table(dealt.mapInArrow(_differences, "family long, cid long, n long, diff array<long>")
                          .withColumn("d", F.size("diff").cast("long")), "jaccard-differences")
    # sizes alone: a star around the set nearest to the centre
    slack = (100 + PERCENT) * F.col("d") - (100 - PERCENT) * F.col("n")
    nearest = diffs.groupBy("family").agg(F.min_by("cid", F.struct(slack, "cid")).alias("p"))
    star = diffs.join(nearest, "family").where("cid <> p").select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"))
    links = links.unionByName(scratch_table(_verified(star, sets), "jaccard-links"))
    comp = components(links, "jaccard") if not links.isEmpty() else None
    # overlapping differences: rarest first, with the bound of each pair
    flat = _in_components(diffs, comp).select("family", "cid", "n", "d", "comp", F.explode("diff").alias("h"))
    common = flat.groupBy("family", "h").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    by_set = Window.partitionBy("cid")
    flat = flat.join(common.where("df > 1"), ["family", "h"])
    flat = flat.select("family", "h", "cid", "n", "d", "comp", (F.col("lo") < F.col("hi")).alias("mixed"),
                       (F.row_number().over(by_set.orderBy("df", "h")) - 1 + F.col("d") - F.count("*").over(by_set)).alias("place"))
    flat = scratch_table(flat.where("mixed").drop("mixed"), "jaccard-sparse")
    x, y = flat.alias("x"), flat.alias("y")
    both = f"({100 + PERCENT} * (x.d + y.d) - {100 - PERCENT} * (x.n + y.n))"
    need = f"div({both} + {2 * (100 + PERCENT) - 1}, {2 * (100 + PERCENT)})"       # least overlap of the differences
    fits = (f"x.cid < y.cid AND x.comp <> y.comp AND {both} > 0 AND x.place <= x.d - {need} AND y.place <= y.d - {need} "
            f"AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {PERCENT}")
    pairs = x.join(y, F.expr(f"x.family = y.family AND x.h = y.h AND {fits}")).select(
        F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    return links.unionByName(scratch_table(_verified(pairs, sets), "jaccard-links"))


def _few(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Marked for broadcast if it has at most ``limit`` rows (of one number each); otherwise left to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _set_sizes(batches):
    """Number of shingles of texts that are linked with nothing."""
    for b in batches:
        for at, buf, off in text_chunks(string_array(b, "text"), BLOCK_BYTES):
            n = np.diff(shingle_sets(buf, off)[1])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n), pa.nulls(len(n), pa.int64())],
                                             ["doc_id", "n_shingles", "component_id"])


def _groups(src: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n, component_id and label (the component's own name: components may share their smallest id) of every
    row of (doc_id, text); ids are not null."""
    spark = src.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 20, 8 * parts)           # as many as the hash bits kept for them can tell apart
    dealt = src.withColumn("mark", F.xxhash64("text")).mapInArrow(_pass_one(buckets), "bucket int, block long, rows binary, keys binary") \
        .repartition(parts, "bucket")
    flags = dealt.groupBy("bucket").applyInArrow(_column_block(buckets), "block long, info boolean, rows binary")
    table = scratch_table(flags.groupBy("block").applyInArrow(
        _document_block, "doc_id long, n long, cid long, check long, keep boolean, mark long"), "jaccard-docs")
    # a set is named by 64 bits; a second 64 show whether two sets share a name
    classes = table.where("n > 0").groupBy("cid", "check").agg(F.min("doc_id").alias("low"), F.max("keep").alias("keep"))
    classes = scratch_table(classes, "jaccard-classes")
    if not classes.groupBy("cid").count().where("count > 1").isEmpty():
        raise ValueError("two different shingle sets share a 64-bit name; change the salts of _class_keys")
    reps = classes.where("keep").select(F.col("low").alias("doc_id")).distinct()
    sets = scratch_table(src.join(_few(reps), "doc_id", "left_semi").select("text")
                         .mapInArrow(_set_rows, "cid long, n long, shingles array<long>"), "jaccard-sets")
    links = _links(sets)
    low = classes.select("cid", "low", F.col("cid").alias("label"))
    if links is not None and not links.isEmpty():
        comp = components(links, "jaccard")
        named = low.drop("label").join(comp, low["cid"] == comp["node"], "left").select("cid", "low", F.coalesce("label", "cid").alias("label"))
        least = named.groupBy("label").agg(F.min("low").alias("component_id"))
        low = named.join(least, "label").select("cid", F.col("component_id").alias("low"), "label")
    out = table.join(low, (table["cid"] == low["cid"]) & (table["n"] > 0), "left")
    return out.select("doc_id", "mark", "n", F.coalesce("low", "doc_id").alias("component_id"), "label")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of the component) per row. A row without an id has no
    component and links nothing."""
    src = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    unknown = src.where("doc_id IS NULL").mapInArrow(_set_sizes, "doc_id long, n_shingles long, component_id long")
    out = _groups(src.where("doc_id IS NOT NULL"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(unknown)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one row with the smallest id stays. Rows are judged each by its own text, also
    where they share an id; rows without an id, and those linked with nothing, stay. All columns unchanged."""
    src = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = scratch_table(_groups(src.where("doc_id IS NOT NULL")).where("n > 0"), "jaccard-groups")
    kept = groups.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select("k.*")
    gone = groups.select("doc_id", "mark").distinct().join(kept, ["doc_id", "mark"], "left_anti")
    again = groups.groupBy("doc_id", "mark").count().where("count > 1").join(kept, ["doc_id", "mark"], "left_semi")

    def named(rows: DataFrame) -> DataFrame:
        return _few(rows.select(F.col("doc_id").alias("_jaccard_id"), F.col("mark").alias("_jaccard_mark")))

    def same(rows: DataFrame, some: DataFrame):
        return (rows[id_col].cast("long") == some["_jaccard_id"]) & (F.xxhash64(rows[text_col]) == some["_jaccard_mark"])

    gone = named(gone)
    rest = docs.join(gone, same(docs, gone), "left_anti")
    if again.isEmpty():
        return rest
    again = named(again)
    return rest.join(again, same(rest, again), "left_anti").unionByName(
        rest.join(again, same(rest, again), "left_semi").dropDuplicates([id_col, text_col]))
