"""Importance resampling towards a target distribution, over hashed word and word-pair features.

Texts are lower-cased (A-Z), everything that is no word becomes a blank, and each slice of texts gets an Aho-Corasick automaton of
its distinct words, each between two blanks. A word's payload is its CRC-32 and its length. One scan emits the
payloads in order; the CRC of a pair follows from the payloads of its two words (advance the first CRC over a
blank and the second word's length, then combine), so no pair is ever written out or hashed again. Features are reduced to
their bucket.

One pass over the texts writes the buckets (two bytes a feature); counts, weights and scores read those. Counts are summed per task
before they are shuffled: ``buckets`` rows a task at most. The table of gains has one row per bucket, a fixed parameter, and is
the only thing that passes through the driver. Ranks come from the counts of rows per score (a whole number whose range
does not grow with the input) and the order by id within one score; nothing orders all rows in one task.

Defined cases: a null or empty text has no features, weight 0 and no rank; rows that repeat count each; a null id draws its noise
as an empty id and comes first among ties; an empty target or an empty table is fine (all gains come from the smoothing
alone); other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.llm.common import byte_slices, materialize, text_buffers

BUCKETS = 10_000
LEAST_WORDS = 20
DRAW = 25             # per cent of the documents with enough words
SALT = "7:"
SLICE = 8 << 20       # bytes of text that share an automaton

_WORD = [b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80]
_MAP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in set(_WORD) else 0x20 for b in range(256))

# ---------------------------------------------------------------- CRC-32 arithmetic
_U = np.uint32


def _byte_steps() -> np.ndarray:
    """The register after one zero byte, for each value of its low byte."""
    c = np.arange(256, dtype=_U)
    for _ in range(8):
        c = np.where(c & _U(1), (c >> _U(1)) ^ _U(0xEDB88320), c >> _U(1))
    return c


_STEP = _byte_steps()


def _apply(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as its values per byte."""
    return op[0][c & _U(255)] ^ op[1][(c >> _U(8)) & _U(255)] ^ op[2][(c >> _U(16)) & _U(255)] ^ op[3][c >> _U(24)]


def _doublings(n: int = 32) -> list[np.ndarray]:
    """Maps for 1, 2, 4, ... zero bytes."""
    units = [np.arange(256, dtype=_U) << _U(8 * k) for k in range(4)]
    ops = [np.stack([_STEP[u & _U(255)] ^ (u >> _U(8)) for u in units])]
    while len(ops) < n:
        ops.append(np.stack([_apply(ops[-1], row) for row in ops[-1]]))
    return ops


_ZEROS = _doublings()


def advance(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs ``c`` moved over ``n`` zero bytes each."""
    c = c.astype(_U)
    for k, op in enumerate(_ZEROS):
        if not len(n) or n.max() >> k == 0:
            break
        at = np.flatnonzero((n >> k) & 1)
        c[at] = _apply(op, c[at])
    return c


def pair_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of "first second" from both CRCs and the second one's length in bytes."""
    raw = first.astype(_U) ^ _U(0xFFFFFFFF)
    spaced = _STEP[(raw ^ _U(0x20)) & _U(255)] ^ (raw >> _U(8)) ^ _U(0xFFFFFFFF)
    return advance(spaced, length) ^ second.astype(_U)


# ---------------------------------------------------------------- features
def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, length, text number) of every word of the texts in order, by one scan of an automaton of their distinct words."""
    import ahocorasick
    between = [b" " + t.translate(_MAP) + b" " for t in texts]
    ends = np.cumsum([len(t) for t in between])
    joined = b"".join(between)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for w in set(joined.split()):
        # each byte is one character; CRC and length share a number (more than 32 bits, hence an object)
        auto.add_word((b" " + w + b" ").decode("latin-1"), len(w) << 32 | zlib.crc32(w))
    if not len(auto):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    auto.make_automaton()
    hits = np.fromiter(itertools.chain.from_iterable(auto.iter(joined.decode("latin-1"))), np.int64)
    at, payload = hits[::2], hits[1::2]
    return (payload & 0xFFFFFFFF).astype(_U), payload >> 32, np.searchsorted(ends, at, side="right")


def bucket_lists(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features, words per text); a text's words come first, then its pairs."""
    crc, length, of = scan(texts)
    n = np.bincount(of, minlength=len(texts))
    both = np.flatnonzero(of[1:] == of[:-1])
    pairs = pair_crc(crc[both], crc[both + 1], length[both + 1])
    p = np.maximum(n - 1, 0)
    out = np.zeros(len(crc) + len(pairs), np.int64)
    begin = np.cumsum(n + p) - (n + p)
    out[np.arange(len(crc)) + np.repeat(begin - (np.cumsum(n) - n), n)] = crc % buckets
    out[np.arange(len(pairs)) + np.repeat(begin + n - (np.cumsum(p) - p), p)] = pairs % buckets
    return out, n


def features(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, buckets) per row: the buckets as little-endian unsigned 16-bit numbers (32-bit ones beyond 65,536)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = pc.fill_null(b.column(1), "")
            data, off = text_buffers(col)
            for i, j in byte_slices(off, SLICE):
                got, n = bucket_lists([data[s:e].tobytes() for s, e in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist())], buckets)
                size = n + np.maximum(n - 1, 0)
                raw, width = got.astype(kind).tobytes(), int(kind[-1])
                at = (np.append(0, np.cumsum(size)) * width).tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(size, pa.int64()),
                     pa.array([raw[s:e] for s, e in zip(at[:-1], at[1:])], pa.binary())],
                    names=["key", "n_words", "n_features", "buckets"])

    return docs.select(F.col(key).cast("bigint").alias("key"), "text").mapInArrow(run, "key bigint, n_words bigint, n_features bigint, buckets binary")


def counts(feats: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, _ = text_buffers(b.column(0))
            for k in range(0, len(data), SLICE):
                total += np.bincount(data[k:k + SLICE].view(kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return feats.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from (bucket, n) of both sides."""
    spark = source.sparkSession
    t = (spark.range(buckets).select(F.col("id").alias("bucket"))
         .join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
         .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0, ["s", "t"]))
    all_s, all_t = source.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(), target.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(all_s + buckets) / (d(F.col("s") + 1) * d(all_t + buckets))
    return t.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain"))


def weights(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """``feats`` with ``weight``, the floored mean of its features' gains (0 without any), in place of the buckets."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("buckets"))
            n = b.column("n_features").to_numpy()
            total = np.zeros(len(n), np.int64)
            for i, j in byte_slices(off, SLICE):
                upto = np.append(0, np.cumsum(gain[data[off[i]:off[j]].view(kind)]))
                total[i:j] = np.diff(upto[(off[i:j + 1] - off[i]) // int(kind[-1])])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), b.column("n_features"),
                                              pa.array(total // np.maximum(n, 1), pa.int64())],
                                             names=["key", "n_words", "n_features", "weight"])

    return feats.mapInArrow(run, "key bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, draw: int = DRAW, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``; rows drawn have a rank."""
    feats = materialize(features(docs, buckets=buckets), "dsir-buckets")
    table = gains(counts(feats, buckets), counts(features(target.withColumn("_none", F.lit(None)), "_none", buckets), buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in table.collect():   # one row per bucket, whatever the input
        gain[r.bucket] = r.gain
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    rows = materialize(weights(feats, gain).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least),
                       "dsir-scores")
    # rows per score; the number of scores is bounded by the range of weights and noise
    per = rows.where("able").groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("score").alias("p_score"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    total = rows.where("able").agg(F.count(F.lit(1))).scalar()
    room = F.floor(total * draw / F.lit(100)).cast("bigint")
    within = Window.partitionBy("able", "score").orderBy("key")
    out = rows.join(per, F.col("able") & (F.col("score") == F.col("p_score")), "left")
    place = F.when(F.col("able"), F.col("before") + F.row_number().over(within))
    out = out.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", place.cast("bigint").alias("place"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= room, F.col("place")).alias("rank"))
