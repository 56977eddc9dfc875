"""Sharding along a Hilbert curve over quantised metadata.

Source, language and text size are quantised to ``BITS`` bits each; the index along the
Hilbert curve of that cube orders the rows, so that a run of rows is compact in
every dimension and the shards' min/max statistics prune on any of them. Runs are
cut by rank: shard counts differ by one at most, whatever the skew. Equal texts
take the metadata of their group's smallest source and language and sort together by
digest, so a group of copies is one stretch of the curve and is parted only where a cut falls.

Ranks come from one range partitioning of a narrow table (no text in it) sorted within partitions,
plus running totals of the partition sizes; no global sort in one task.

Defined cases: null source or language sort first, a null text is empty, equal
rows take adjacent slots, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.llm.common import materialize, shuffle_parts

BITS = 10
SHARDS = 24


def hilbert_index(coords: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below 2^bits."""
    x = [c.astype(np.int64).copy() for c in coords]
    n = len(x)
    # undo the excess rotations of the transposed form, from the highest bit down
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | (c >> b) & 1
    return out


def _rank(d: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """``d`` with the value's rank among the distinct values of ``col``, spread over 0 .. 2^bits - 1."""
    vals = d.groupBy(col).count()
    w = Window.orderBy(F.col(col).asc_nulls_first())
    vals = vals.withColumn("_k", F.row_number().over(w) - 1)
    top = F.greatest(F.max("_k").over(Window.partitionBy()), F.lit(1))
    vals = vals.select(F.col(col).alias("_v"), F.floor(F.col("_k") * ((1 << bits) - 1) / top).cast("int").alias(f"r_{col}"))
    vals = materialize(vals, f"hilbert-{col}")
    return d.join(vals, F.col(col).eqNullSafe(F.col("_v"))).drop("_v")


def curve(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, digest, h): the narrow table with each row's place on the curve."""
    t = F.coalesce("text", F.lit(""))
    base = materialize(docs.select(
        "doc_id", "source", "lang", (F.octet_length(t) + 8).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).cast("bigint").alias("text_crc32"), F.md5(t.cast("binary")).alias("digest")), "hilbert-base")
    group = base.groupBy("digest").agg(F.min("source").alias("g_source"), F.min("lang").alias("g_lang"))
    d = base.select("doc_id", "size", "text_crc32", "digest").join(group, "digest")
    d = _rank(_rank(d, "g_source", bits), "g_lang", bits)
    top = float((1 << bits) - 1)
    d = d.withColumn("r_size", F.least(F.lit(top), F.floor(F.log2(F.col("size")) * (top / 32.0))).cast("int"))

    @F.pandas_udf("bigint")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    return d.select("doc_id", "size", "text_crc32", "digest", index("r_g_source", "r_g_lang", "r_size").alias("h"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; law ``rows``."""
    keys = ["h", "digest", "doc_id"]
    d = curve(docs)
    parts = shuffle_parts(docs.sparkSession)
    # within a sorted partition the generated ids count rows up from the partition's base
    placed = materialize(d.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                         .select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("m")), "hilbert-placed")
    placed = placed.withColumn("pid", F.shiftright("m", 33))
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"),
                         F.sum("c").over(Window.partitionBy()).alias("n"))
    rank = F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    few = F.floor(F.col("n") / shards).cast("bigint")
    more = F.col("n") % shards  # so many shards hold one row more
    d = placed.join(sizes, "pid").select("doc_id", "size", "text_crc32", rank.alias("r"), few.alias("few"), more.alias("more"))
    big = F.col("more") * (F.col("few") + 1)
    early = F.col("r") < big
    one = F.greatest(F.col("few"), F.lit(1))
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(early, F.floor(F.col("r") / (F.col("few") + 1))).otherwise(
            F.col("more") + F.floor((F.col("r") - big) / one)).cast("int").alias("shard"),
        F.when(early, F.col("r") % (F.col("few") + 1)).otherwise((F.col("r") - big) % one).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` as one folder per shard, in curve order, and return the assignment.

    Rows of ``docs`` are matched by doc_id, which must be unique here.
    """
    plan = materialize(shard(docs, shards), "hilbert-plan")
    (docs.join(plan.select("doc_id", "shard", "slot"), "doc_id").repartition("shard")
     .sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path))
    return plan
