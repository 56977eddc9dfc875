"""Document fingerprints from prefix polynomial hashes over code points.

``PrefixHash`` keeps, for two 31-bit primes, the modular sums of c_j * B^j over
every prefix. Any span's hash is then two look-ups and a multiplication,
any two spans compare in constant time, and the longest common extension of two
places (of one text or of two) is found by binary search.

A fingerprint is what those arrays give at fixed places, so that it can be compared
without the texts: the length, the whole text's hash, hashes of prefixes and of suffixes of
geometrically growing lengths (common prefix and suffix lengths by binary search over them),
and the smallest hashes among all spans of 24 code points (a sample that does not depend on position).
``likeness`` of two: 1 exactly for equal texts (up to 62-bit collisions), else the larger of the common
prefix and suffix over the longer length and the Dice estimate of the span samples, below 1.

``neighbour_report`` needs each document's successor by id. Ranges of (id, text hash) are learned from those two
numbers alone; each range goes to one partition, and its first document also to the partition before it, so that
every successor is at hand. Texts are shuffled once, and nothing is written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import U64, mix64, shuffle_parts

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
SPAN = 24
SAMPLE = 24
STEPS = 8  # prefix lengths per doubling
BLOCK = 1 << 18  # code points hashed at a time
NO_ID = -(1 << 63)  # stands for a null id in the order


def _ladder(n: int) -> np.ndarray:
    """Lengths 1, 2, 3, ... growing by 2^(1/STEPS), up to n."""
    if n <= 0:
        return np.zeros(0, np.int64)
    k = np.arange(int(np.log2(n) * STEPS) + STEPS + 1)
    x = np.unique(np.floor(2.0 ** (k / STEPS)).astype(np.int64))
    return x[x <= n]


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self):
        self.up = [np.ones(1, U64) for _ in PRIMES]
        self.down = [np.ones(1, U64) for _ in PRIMES]

    def to(self, n: int) -> None:
        while len(self.up[0]) < n:
            for k, p in enumerate(PRIMES):
                for t, b in ((self.up, BASES[k]), (self.down, pow(BASES[k], -1, p))):
                    t[k] = np.concatenate([t[k], t[k] * U64(pow(b, len(t[k]), p)) % U64(p)])


POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        POWERS.to(self.n + 1)
        self.prefix = []
        for k, p in enumerate(PRIMES):
            out = np.zeros(self.n + 1, U64)
            np.cumsum((points + U64(1)) * POWERS.up[k][:self.n] % U64(p), out=out[1:])
            self.prefix.append(out)

    def spans(self, start, length) -> np.ndarray:
        """62-bit hashes of spans (arrays broadcast); equal spans anywhere have equal hashes."""
        start = np.asarray(start, np.int64)
        both = []
        for k, p in enumerate(PRIMES):
            x = self.prefix[k]
            both.append((x[start + length] - x[start]) % U64(p) * POWERS.down[k][start] % U64(p))
        return both[0] << U64(31) | both[1]

    def same(self, a: int, other: "PrefixHash", b: int, length: int) -> bool:
        return bool(self.spans(a, length) == other.spans(b, length))

    def extension(self, a: int, other: "PrefixHash", b: int) -> int:
        """Length of the longest common extension from ``a`` here and ``b`` there."""
        lo, hi = 0, min(self.n - a, other.n - b)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(a, other, b, mid) else (lo, mid - 1)
        return lo


def _smallest(v: np.ndarray) -> np.ndarray:
    """The SAMPLE smallest distinct values."""
    if len(v) > 4 * SAMPLE:
        # they are among the smallest few unless values repeat a lot
        few = np.unique(np.partition(v, 4 * SAMPLE - 1)[:4 * SAMPLE])
        return (few if len(few) >= SAMPLE else np.unique(v))[:SAMPLE]
    return np.unique(v)[:SAMPLE]


def _scan(points: np.ndarray, places: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Prefix sums and inverse powers (per prime) at ``places``, and the smallest span hashes, block by block."""
    n, s = len(points), min(SPAN, len(points))
    sums = [np.zeros(len(places), U64) for _ in PRIMES]
    downs = [np.zeros(len(places), U64) for _ in PRIMES]
    total, small = [0] * len(PRIMES), np.zeros(0, U64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        h = PrefixHash(points[lo:min(n, hi + s - 1)])
        starts = min(hi, n - s + 1) - lo
        if starts > 0:
            small = _smallest(np.concatenate([small, mix64(h.spans(np.arange(starts), s) + U64(0x632BE59BD9B4E019)) >> U64(32)]))
        here = np.flatnonzero((places >= lo) & ((places < hi) | (places == n) & (hi == n)))
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            up, down = pow(b, lo, p), pow(b, -lo, p)
            at = places[here] - lo
            sums[k][here] = (U64(total[k]) + h.prefix[k][at] % U64(p) * U64(up)) % U64(p)
            downs[k][here] = POWERS.down[k][at] * U64(down) % U64(p)
            total[k] = (total[k] + int(h.prefix[k][hi - lo]) % p * up) % p
    return sums, downs, small


def fingerprint(points: np.ndarray) -> str:
    """length.whole.prefixes.suffixes.sample, in hex."""
    n = len(points)
    if not n:
        return f"0.{0:016x}..."
    steps = _ladder(n)
    m = len(steps)
    sums, downs, small = _scan(points, np.concatenate([steps, n - steps, [n]]))
    front = [x[:m] for x in sums]
    back = [(x[-1] + U64(p) - x[m:-1]) % U64(p) * d[m:-1] % U64(p) for x, d, p in zip(sums, downs, PRIMES)]
    low = lambda x: "".join(f"{v:04x}" for v in (mix64(x[0] << U64(31) | x[1]) & U64(0xFFFF)).tolist())
    whole = int(sums[0][-1]) << 31 | int(sums[1][-1])
    return f"{n:x}.{whole:016x}.{low(front)}.{low(back)}.{''.join(f'{x:08x}' for x in small.tolist())}"


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    na, wa, fa, ba, sa = a.split(".")
    nb, wb, fb, bb, sb = b.split(".")
    if (na, wa) == (nb, wb):
        return 1.0
    n, m = int(na, 16), int(nb, 16)
    if not n or not m:
        return 0.0
    steps = _ladder(min(n, m))

    def common(x: str, y: str) -> int:
        lo, hi = 0, len(steps)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            same = x[4 * mid - 4:4 * mid] == y[4 * mid - 4:4 * mid]
            lo, hi = (mid, hi) if same else (lo, mid - 1)
        return int(steps[lo - 1]) if lo else 0

    shared = min(min(n, m), common(fa, fb) + common(ba, bb)) / max(n, m)
    p = {sa[k:k + 8] for k in range(0, len(sa), 8)}
    q = {sb[k:k + 8] for k in range(0, len(sb), 8)}
    least = sorted(p | q)[:SAMPLE]
    j = sum(x in p and x in q for x in least) / max(1, len(least))
    return round(min(0.999, max(shared, 2 * j / (1 + j))), 6)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


class _Rows:
    SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def __init__(self):
        self.rows = []

    def done(self, one, two):
        e = edited(one[1], two[1])
        fe = fingerprint(code_points(e))
        sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
        self.rows.append((one[0], len(one[1]), sha, one[2], fe, likeness(one[2], fe), likeness(one[2], two[2])))

    def flush(self):
        names = [x.split(" ")[0] for x in self.SCHEMA.split(", ")]
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.TYPES)], names=names)
        self.rows = []
        return b


def _ranges(keys: DataFrame) -> np.ndarray:
    """The first (k, h) of each range, ascending: at most one per shuffle partition, so its size is the setting's."""
    parts = max(shuffle_parts(keys.sparkSession), 1)
    first = (keys.repartitionByRange(parts, "k", "h").groupBy(F.spark_partition_id().alias("pid"))
             .agg(F.min(F.struct("k", "h")).alias("first")).select("first.*").collect())
    return np.array(sorted((r["k"], r["h"]) for r in first), dtype=[("k", "i8"), ("h", "i8")])


def neighbour_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    A null text counts as empty. The successor is the next row by doc_id (null ids first, rows of equal id by a hash of
    their text), the last row's the first one; a single row follows itself. Rows equal in both follow each other and
    share a partition. Very long texts are hashed in blocks. An empty table gives an empty result.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("k"), F.xxhash64("text").alias("h"))
    first = _ranges(d.select("k", "h"))
    n = max(1, len(first))

    @F.pandas_udf("int")
    def target(k: pd.Series, h: pd.Series) -> pd.Series:
        """2 * range, plus 1 for the first row of a range."""
        at = np.zeros(len(k), first.dtype)
        at["k"], at["h"] = k.to_numpy(), h.to_numpy()
        pid = np.searchsorted(first, at, side="right") - 1
        return pd.Series((2 * pid + (first[pid] == at)).astype(np.int32))

    t = F.col("t")
    pid = (t / 2).cast("int")
    own = F.struct(pid.alias("pid"), F.lit(0).alias("next"))
    copy = F.struct(((pid + (n - 1)) % n).alias("pid"), F.lit(1).alias("next"))
    d = (d.withColumn("t", target("k", "h"))
         .select("doc_id", "text", "k", "h", F.inline(F.when(t % 2 == 0, F.array(own)).otherwise(F.array(own, copy))))
         .repartitionById(n, F.col("pid")).sortWithinPartitions("next", "k", "h").select("doc_id", "text", "next"))

    def run(batches):
        out, last = _Rows(), None
        for b in batches:
            for k in range(b.num_rows):
                i, t, copied = (c[k].as_py() for c in b.columns)
                if copied and last is None:
                    continue  # the successor is known already
                now = (i, t, fingerprint(code_points(t)))
                if last is not None:
                    out.done(last, now)
                last = None if copied else now
                if len(out.rows) >= 2000:
                    yield out.flush()
        if out.rows:
            yield out.flush()

    return d.mapInArrow(run, _Rows.SCHEMA)
