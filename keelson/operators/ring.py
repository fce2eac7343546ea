"""Consistent-hash tenant ring.

The ring is a small dimension table: ``virtual`` points per member, point hash
= FNV-1a 64 of ``node + "#" + i``.  A key goes to the first point whose hash is
>= the key's hash (unsigned), wrapping to the first point; ties on a hash go to
the smaller node name.  An empty ring gives "".

Lookup is a range join made into an equi join: ring segments ``(lo, hi]`` are
split by the leading hex digits of the hash (the bucket), so every key probes
one bucket by hash-equality and checks the range as a residual.  The segment
table grows only with ring membership.  It is broadcast if its size, known from
the membership or measured as it is written, is under the limits; the probe side
is then not shuffled.  Otherwise the joins are shuffled ones by hint: membership
is a small file that ``explode`` makes large, which Spark's estimate doesn't see.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.fnv import fnv1a64_hex
from keelson.plans.joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, materialize_observed, materialize_small
from keelson.plans.parallel import ensure_parallelism
from keelson.schema import VIRTUAL_NODES

MAX_HASH = "FFFFFFFFFFFFFFFF"


def members(spark: SparkSession, nodes: Iterable[str]) -> DataFrame:
    """Membership table from configuration (node names, in insertion order)."""
    rows = [(n, i) for i, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "node string, member_no int")


def add_tenant(ring_members: DataFrame, node: str) -> DataFrame:
    spark = ring_members.sparkSession
    nxt = spark.createDataFrame([(node,)], "node string")
    cols = [c for c in ring_members.columns if c != "node"]
    for c in cols:
        nxt = nxt.withColumn(c, F.lit(None).cast(ring_members.schema[c].dataType))
    return ring_members.unionByName(nxt)


def remove_tenant(ring_members: DataFrame, node: str) -> DataFrame:
    """Removing drops every copy of the name."""
    return ring_members.where(F.col("node") != node)


def tenant_count(ring_members: DataFrame) -> DataFrame:
    return ring_members.agg(F.count(F.lit(1)).alias("tenant_count"))


def build_ring(ring_members: DataFrame, node_col: str = "node", virtual: int = VIRTUAL_NODES) -> DataFrame:
    """Ring points (hash, node, vnode).  Duplicate member names give duplicate points."""
    pts = ring_members.select(F.col(node_col).alias("node"),
                              F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("vnode"))
    pts = ensure_parallelism(pts)
    label = F.concat(F.col("node"), F.lit("#"), F.col("vnode").cast("string"))
    return pts.select(fnv1a64_hex(label).alias("hash"), "node", "vnode")


def _bucket_digits(n_points: int) -> int:
    """Leading hex digits that leave some ten points in a bucket, between 2 and 6."""
    digits = 2
    while digits < 6 and n_points > 8 * 16 ** digits:
        digits += 1
    return digits


def _distinct_points(ring: DataFrame) -> DataFrame:
    return ring.groupBy("hash").agg(F.min("node").alias("node"))


def ring_segments(points: DataFrame, digits: int) -> DataFrame:
    """Segments ``(lo, hi] -> node`` covering the whole hash space, split by bucket; ``points`` has one row per hash.

    Points are ordered inside their bucket of leading digits only. The point before a bucket's first one is the last point
    of the nearest bucket with points, carried over a table of bucket edges (at most 16^digits rows) in two levels:
    inside groups of 256 buckets, then over the groups.
    """
    b = lambda c: F.conv(F.substring(c, 1, digits), 16, 10).cast("int")
    points = points.select("hash", "node", b(F.col("hash")).alias("_b"))
    edges = points.groupBy("_b").agg(F.max("hash").alias("_last")).withColumn("_g", F.floor(F.col("_b") / 256))
    groups = edges.groupBy("_g").agg(F.max("_last").alias("_glast"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)      # at most 16^digits / 256 rows
    groups = groups.select("_g", F.max("_glast").over(before).alias("_gprev"))
    inside = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.join(F.broadcast(groups), "_g").select("_b", F.coalesce(F.max("_last").over(inside), "_gprev").alias("_edge"))
    w = Window.partitionBy("_b").orderBy("hash")
    # as many edges as points where buckets hold one each: never a broadcast
    own = points.join(edges.hint("merge"), "_b").select(F.coalesce(F.lag("hash").over(w), "_edge", F.lit("")).alias("lo"),
                                          F.col("hash").alias("hi"), "node")
    # hashes above the last point wrap to the first one
    wrap = points.agg(F.max("hash").alias("lo"), F.min(F.struct("hash", "node")).alias("f")).where("lo IS NOT NULL") \
        .select("lo", F.lit(MAX_HASH).alias("hi"), F.col("f.node").alias("node"))
    segs = own.unionByName(wrap)
    lo_b = F.when(F.col("lo") == "", F.lit(0)).otherwise(b(F.col("lo")))
    return segs.withColumn("bucket", F.explode(F.sequence(lo_b, b(F.col("hi")))))


def prepare_ring(ring: DataFrame, n_points: int | None = None) -> tuple[DataFrame, int, bool]:
    """Count the ring once and build its segment table (reused by many lookups).

    ``n_points`` may be given when the membership is known (members x virtual points): a small ring's segments are then lazy.
    A ring of any size works: points and segments are written once, and the segments are broadcast only if they measure
    under the limits; otherwise the lookup is a shuffled equi join on the bucket.
    """
    points = _distinct_points(ring)
    if n_points is not None:
        digits = _bucket_digits(n_points)
        # segments <= points + one wrap segment + one split per bucket boundary: a proven bound
        bound = n_points + 1 + 16 ** digits
        if bound <= BROADCAST_MAX_ROWS and bound * 160 <= BROADCAST_MAX_BYTES:
            return ring_segments(points, digits), digits, True
    points, seen = materialize_observed(points, "ring-points", n=F.count(F.lit(1)))
    digits = _bucket_digits(seen["n"])
    segs, small = materialize_small(ring_segments(points, digits), BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES)
    return segs, digits, small


def ring_lookup(df: DataFrame, ring: DataFrame, key_col: str, out_col: str = "node",
                hash_col: str | None = None, prepared: tuple[DataFrame, int, bool] | None = None) -> DataFrame:
    """Node for each row's key; '' when the ring is empty."""
    segs, digits, small = prepared or prepare_ring(ring)
    h = "_kh" if hash_col is None else hash_col
    probe = df.withColumn(h, fnv1a64_hex(F.col(key_col)))
    probe = probe.withColumn("_kb", F.conv(F.substring(F.col(h), 1, digits), 16, 10).cast("int"))
    s = segs.select(F.col("bucket").alias("_sb"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                    F.col("node").alias("_node"))
    s = F.broadcast(s) if small else s.hint("merge")
    cond = (F.col("_kb") == F.col("_sb")) & (F.col(h) > F.col("_lo")) & (F.col(h) <= F.col("_hi"))
    out = probe.join(s, cond, "left").withColumn(out_col, F.coalesce(F.col("_node"), F.lit("")))
    drop = ["_kb", "_sb", "_lo", "_hi", "_node"] + (["_kh"] if hash_col is None else [])
    return out.drop(*drop)


def moved_keys(keys: DataFrame, ring_before: DataFrame, ring_after: DataFrame,
               key_col: str = "key") -> DataFrame:
    """Keys whose node changes between two rings (one row per key)."""
    before = ring_lookup(keys, ring_before, key_col, "node_before")
    both = ring_lookup(before, ring_after, key_col, "node_after")
    return both.where(F.col("node_before") != F.col("node_after"))


def assign_tenant(df: DataFrame, ring: DataFrame, key_col: str = "user_id",
                  out_col: str = "tenant", prepared=None) -> DataFrame:
    """Tenant of each event by its user id."""
    return ring_lookup(df, ring, key_col, out_col, prepared=prepared)


def tenant_load(df: DataFrame, tenant_col: str = "tenant") -> DataFrame:
    return df.groupBy(tenant_col).agg(F.count(F.lit(1)).alias("events"))
