"""The bounded labelled sample that the classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from keelson.llm.common import bounded_batches, scratch_table

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 48 << 20


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """True for the rows kept from training: crc32 of the id as text has the given remainder."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int],
                    featurize: Callable[[Iterator], Iterator], ddl: str, id_col: str = "doc_id",
                    text_col: str = "text", max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> list:
    """Feature rows of at most ``max_rows`` labelled documents outside the held-out fold (half of them of each class
    where there are enough), chosen by the hash of their ids and held to ``max_bytes`` of features by ``_chosen``.

    Both bounds are fixed, so the driver's part does not grow with the data. Features are made by the executors.
    """
    usable = (labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), *fold))
              .withColumn("pick", F.xxhash64("doc_id", F.lit(7))))
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy("pick", "doc_id").limit(max_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.dropDuplicates(["doc_id"])
    keep = [c for c in ("lang",) if c in docs.columns]
    text = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    if not keep:
        text = text.withColumn("lang", F.lit(None).cast("string"))
    # at most max_rows ids: a bounded broadcast
    rows = text.join(F.broadcast(picked), "doc_id").select("label", "lang", "pick", "text").mapInArrow(featurize, ddl)
    features = [f.name for f in rows.schema if isinstance(f.dataType, BinaryType)]
    size = sum((F.octet_length(c) for c in features), F.lit(0)).cast("long")
    rows = scratch_table(rows.select("*", size.alias("size"), F.xxhash64(*features).alias("mark"),
                                     F.monotonically_increasing_id().alias("row")), "labelled-sample")
    # at most max_rows rows of four numbers, repeated ids or not
    sizes = [rows.where(F.col("label") == v).select("row", "size", "pick", "mark").orderBy("pick", "mark", "row")
             .limit(max_rows // 2).select("row", "size").collect() for v in (0, 1)]
    chosen = _chosen([[tuple(r) for r in part] for part in sizes], max_bytes)
    ids = docs.sparkSession.createDataFrame([(r,) for r in chosen], "row long")
    out = rows.join(F.broadcast(ids), "row").drop("row", "size", "mark").collect()
    out.sort(key=lambda r: (r["pick"], bytes(next(x for x in r if isinstance(x, (bytes, bytearray))))))
    return out


def _chosen(sizes: list[list[tuple[int, int]]], max_bytes: int) -> list[int]:
    """Rows of the sample, from (row, bytes) of each class in the order of its hashes: the classes take turns until the
    next row would exceed ``max_bytes``, so what stays depends on the hashes and never on the table's order. A row too long
    for its turn (over ``row_bytes``) is left out by itself."""
    sizes = [[x for x in part if x[1] <= row_bytes(max_bytes)] for part in sizes]
    out, total = [], 0
    for row, size in (x for turn in zip_longest(*sizes) for x in turn if x is not None):
        total += size
        if total > max_bytes:
            break
        out.append(row)
    return out


def row_bytes(max_bytes: int) -> int:
    """The most that one document's features may take."""
    return max_bytes // 32


def class_shares(labels: DataFrame, label: str, fold: tuple[int, int], id_col: str = "doc_id") -> float:
    """Share of label 1 among the labelled rows outside the held-out fold (0.5 without any), smoothed away from 0 and 1."""
    n, ones = labels.where(~held_out(F.col(id_col), *fold)).select(F.count(label), F.sum(F.col(label).cast("int"))).first()
    return ((ones or 0) + 1) / ((n or 0) + 2)
