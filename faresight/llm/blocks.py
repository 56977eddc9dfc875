"""Blocks of documents whose words (or id pairs) are looked up in corpus-wide tables.

A block is a run of documents as one task reads them: one row with their ids, a dictionary of what occurs in
them and, compressed, the dictionary codes of every occurrence in order. Only dictionary entries travel through
shuffles, never occurrences. Blocks are written once as a table bucketed by block number in the shared
folder; what was found out about their entries is brought back by one exchange of the entries, since the
bucketed side is already in place.
"""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import shuffle_parts
from faresight.session import scratch_path

TEXT = 16 << 20        # bytes of text of a block; a longer text makes a block of its own
_BUCKETS = 100_000     # Spark's own bound on buckets of a table
# A place is one number: 20 bits of task, 17 of block within the task, 26 of dictionary code.
CODE_BITS, TURN_BITS = 26, 17


def block_number(task: int, turn: int) -> int:
    if turn >= 1 << TURN_BITS:
        raise ValueError(f"a task holds more than {1 << TURN_BITS} blocks; read smaller partitions")
    return (task << TURN_BITS) + turn


def keep(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks`` written under the shared checkpoint folder, bucketed by ``block`` (an external table of this session)."""
    spark = blocks.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (blocks.write.format("parquet").option("path", scratch_path(spark, name.replace("_", "-"))).option("compression", "zstd")
     .bucketBy(min(_BUCKETS, shuffle_parts(spark)), "block").saveAsTable(table))
    return spark.table(table)


def gather(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Each block with the list ``entries`` of its rows of that table (a list as long as the block's dictionary at most)."""
    cols = [c for c in entries.columns if c != "block"]
    own = entries.groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("entries"))
    return blocks.join(own, "block", "left")


def squeeze(codes: np.ndarray) -> bytes:
    """Unsigned 32-bit codes, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unsqueeze(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, 4 * n)), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the n dictionary entries from frequent to rare, ``codes`` numbered that way): small codes pack better."""
    order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n, dtype=np.uint32)
    return order, rank[codes]


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin[k] ... begin[k] + count[k] - 1 for every k, one after another."""
    at = np.cumsum(count) - count
    return np.repeat(begin - at, count) + np.arange(int(count.sum()))
