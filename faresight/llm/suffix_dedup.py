"""Removal of repeated byte spans by windows split by context (no longest-previous-factor array is computed).

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere else in
the corpus, so all copies go. A suffix array of the whole
corpus is not built in one place; equal windows of SPAN bytes are brought together first:

1. Every window is filed under its minimizer: the window's gram of ``GRAM`` bytes with the
   smallest hash (leftmost if it repeats). Equal windows have equal minimizers, so
   stretches of windows with one minimizer ("runs": one per ~80 bytes) are all that has to be grouped.
   A run is (gram hash, content hash, place) - a few numbers, no text.
2. Grams that occur once are dropped (most). Of the others, runs of equal content repeat as a whole.
3. What is left are runs that share a gram but differ somewhere. One run per distinct content is
   read (texts joined in by doc_id, once). Equal windows hold the gram at the same distance from their start, so
   the windows of a content are cut into blocks of 64 neighbouring distances. All windows of a block share its core (137 bytes
   or more): a core that only one kind of block has cannot repeat and goes. Blocks that are equal in all
   their bytes repeat as a whole; one of them goes on as a partner. What is left is cut into blocks of 16, then 4, then
   single windows, whose core is the window. This is one way for groups of any size: a gram in a third of all documents
   is split by its surroundings, its rows meet as counts by hash only, and a content has about one open block per edge of a repeat.
4. Windows found repeated become byte intervals per document, merged and cut out of the text.

Groups are only ever counted by partial aggregation; copies collapse to
(content, count) before anything is compared. Defined cases: null text is empty; texts under SPAN
bytes keep everything; a null id is kept; rows that repeat an id are told apart by a digest of their text,
and rows equal in both count as two places; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import U64, byte_slices, materialize, mix64, text_buffers

SPAN = 200
GRAM = 40
SLICE = 1 << 19  # bytes hashed at a time
WIDTHS = (64, 16, 4, 1)  # gram distances per block, round by round
NO_ID = -(1 << 63)  # stands for a null id inside

_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)  # odd: invertible modulo 2^64


class _Powers:
    def __init__(self):
        self.up = [np.ones(1, U64) for _ in _BASES]
        self.down = [np.ones(1, U64) for _ in _BASES]

    def to(self, n: int) -> None:
        while len(self.up[0]) < n:
            for k, b in enumerate(_BASES):
                for t, x in ((self.up, b), (self.down, pow(b, -1, 1 << 64))):
                    t[k] = np.concatenate([t[k], t[k] * np.array([pow(x, len(t[k]), 1 << 64)], U64)])


_POWERS = _Powers()


class _Hash:
    """Prefix hashes modulo 2^64 of random byte values, under one base or two."""

    def __init__(self, data: np.ndarray, bases: int = 2):
        _POWERS.to(len(data) + 1)
        self.prefix = []
        for k in range(bases):
            out = np.zeros(len(data) + 1, U64)
            np.cumsum(_BYTE[data] * _POWERS.up[k][:len(data)], out=out[1:])
            self.prefix.append(out)

    def spans(self, start: np.ndarray, length, base: int = 0) -> np.ndarray:
        x = self.prefix[base]
        return mix64((x[start + length] - x[start]) * _POWERS.down[base][start])


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (two passes over blocks of w)."""
    n = len(v) - w + 1
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def runs(data: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Stretches of windows with one minimizer in several texts laid end to end.

    Returns (text, first start in it, windows, gram hash, content hash, the gram's place in the content); content
    is the stretch's bytes, last window included.
    """
    lens = np.diff(off)
    count = np.maximum(0, lens - span + 1)
    text = np.repeat(np.arange(len(lens)), count)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + off[text]
    h = _Hash(data, 2)
    g = h.spans(np.arange(len(data) - gram + 1), gram)
    key = ((g >> U64(33)).astype(np.int64) << 32) | np.arange(len(g))  # 31 bits of hash, then leftmost
    best = (_window_min(key, span - gram + 1) & 0xFFFFFFFF)[start]
    cut = np.flatnonzero((best[1:] != best[:-1]) | (text[1:] != text[:-1])) + 1
    first = np.concatenate([np.zeros(1, np.int64), cut])
    n = np.diff(np.append(first, len(text)))
    lo, at = start[first], best[first]
    c = h.spans(lo, n - 1 + span) ^ mix64(h.spans(lo, n - 1 + span, 1) + n.astype(U64) * U64(977) + (at - lo).astype(U64))
    return text[first], lo - off[text[first]], n, g[at], c, at - lo


def _pieces(off: np.ndarray, limit: int, span: int):
    """(first row, end row, start, end) of slices; a text over ``limit`` bytes in pieces that overlap by span - 1 bytes."""
    for i, j in byte_slices(off, limit):
        size = int(off[j] - off[i])
        if size <= limit:
            yield i, j, 0, None
        else:
            for p in range(0, max(1, size - span + 1), limit):
                yield i, j, p, min(size, p + limit + span - 1)


def _files(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """One row per run: doc_id, digest, lo, n (windows), g (gram hash), c (content hash), at (the gram's place)."""
    names = ["doc_id", "digest", "lo", "n", "g", "c", "at"]

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column(2))
            for i, j, p, q in _pieces(off, SLICE, span):
                inner = off[i:j + 1] - off[i] if q is None else np.array([0, q - p])
                text, lo, n, g, c, at = runs(data[off[i]:off[j]][p:q], inner, span, gram)
                if len(text):
                    lo = lo + p
                    rows = pa.array(text + i)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(1).take(rows), pa.array(lo.astype(np.int32)),
                         pa.array(n.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)),
                         pa.array(at.astype(np.int16))], names=names)

    return docs.mapInArrow(run, "doc_id bigint, digest bigint, lo int, n int, g bigint, c bigint, at smallint")


def blocks(width: int, span: int = SPAN, gram: int = GRAM):
    """Arrow function: contents with stretches of window starts in, blocks of ``width`` gram distances out.

    In: g, c, at, content, parts (stretches [a, b) of starts, alive). Out: g, c, a, b, alive, core (hash of the bytes
    that all windows of the block share), u1 and u2 (128-bit hash of all bytes of the windows at hand).
    """
    names = ["g", "c", "a", "b", "alive", "core", "u1", "u2"]

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(3))
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = batch.column(4)
            for i, j in byte_slices(off, 1 << 19):
                lists = parts.slice(i, j - i)
                flat = lists.flatten()
                row = np.repeat(np.arange(i, j), lists.value_lengths().to_numpy(zero_copy_only=False))
                a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                alive = flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
                near, far = at[row] - b + 1, at[row] - a  # smallest and largest distance to the gram
                n = far // width - near // width + 1
                up = np.repeat(np.arange(len(row)), n)
                k = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n) + (near // width)[up]
                lo, hi = k * width, np.minimum(k * width + width - 1, span - gram)
                near, far, row = np.maximum(near[up], lo), np.minimum(far[up], hi), row[up]
                h = _Hash(data[off[i]:off[j]], 2)
                zero = off[row] - off[i] + at[row]
                core = h.spans(zero - lo, span - (hi - lo)) ^ mix64((lo + 1).astype(U64))
                mark = mix64((near * 1024 + far + 1).astype(U64))
                u = [h.spans(zero - far, span + far - near, x) ^ mark for x in (0, 1)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at[row] - far).astype(np.int32)),
                     pa.array((at[row] - near + 1).astype(np.int32)), pa.array(alive[up]), pa.array(core.view(np.int64)),
                     *(pa.array(x.view(np.int64)) for x in u)], names=names)

    return run


BLOCKS = "g bigint, c bigint, a int, b int, alive boolean, core bigint, u1 bigint, u2 bigint"


def shared_windows(contents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(g, c, a, b): stretches of window starts, of contents with ``once``, that also stand in another content.

    ``contents``: g, c, at, content, once; distinct in (g, c).
    """
    texts = contents.select("g", "c", "at", "content")
    n = (F.octet_length("content") - (span - 1)).cast("int")
    asked = contents.select("g", "c", "at", "content", F.array(F.struct(F.lit(0).alias("a"), n.alias("b"), F.col("once").alias("alive")))
                            .alias("parts"))
    union, found = ["core", "u1", "u2"], None
    for width in WIDTHS:
        rows = materialize(asked.mapInArrow(blocks(width, span, gram), BLOCKS), "span-blocks")
        kinds = materialize(rows.groupBy(*union).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("g", "c", "a", "b", "alive")).alias("r")),
                            "span-unions")
        hits = rows.where("alive").join(kinds.where("m > 1").select(*union), union, "left_semi").select("g", "c", "a", "b")
        found = hits if found is None else found.unionByName(hits)
        if width > 1:
            shared = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("core")
            left = kinds.join(shared, "core", "left_semi").select(
                "r.g", "r.c", F.struct("r.a", "r.b", (F.col("r.alive") & (F.col("m") == 1)).alias("alive")).alias("part"))
            asked = texts.join(left.groupBy("g", "c").agg(F.collect_list("part").alias("parts")), ["g", "c"])
    return found


def repeated_windows(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, digest, hits): stretches [a, b) of starts of windows that occur more than once, a list per run.

    ``docs``: doc_id, digest (of the text; tells rows of one id apart), text.
    """
    filed = _files(docs, span, gram)
    often = filed.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g")
    cand = materialize(filed.join(often, "g", "left_semi"), "span-candidates")
    kinds = cand.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "digest", "lo", "n", "at")).alias("r"))
    kinds = materialize(kinds, "span-kinds")
    many = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("v"))
    whole = kinds.where("k > 1").select("g", "c")
    # one run of each distinct content of a gram that has several
    differ = (kinds.join(many.where("v > 1"), "g")
              .select("g", "c", "k", "r.doc_id", "r.digest", "r.lo", "r.n", "r.at"))
    asked = (differ.groupBy("doc_id", "digest")
             .agg(F.collect_list(F.struct("g", "c", "k", "lo", "n", "at")).alias("asked")))

    def read(batches):
        for b in batches:
            rows = []
            for text, asked_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["g"], x["c"], x["k"], x["at"], raw[x["lo"]:x["lo"] + x["n"] + span - 1]) for x in asked_]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
                    names=["g", "c", "k", "at", "content"])

    joined = docs.join(asked.hint("shuffle_hash"), ["doc_id", "digest"]).select("text", "asked")
    # equal rows (id and digest) read the same content twice: one is enough
    contents = materialize(joined.mapInArrow(read, "g bigint, c bigint, k bigint, at bigint, content binary")
                           .dropDuplicates(["g", "c"]), "span-contents")

    # contents that occur more than once repeat as a whole anyway, and only serve as partners
    parts = shared_windows(contents.withColumn("once", F.col("k") == 1), span, gram)
    partly = materialize(parts.groupBy("g", "c").agg(F.collect_list(F.struct("a", "b")).alias("s")), "span-parts")
    lo = F.col("lo")
    return (cand.join(whole, ["g", "c"], "left_semi")
            .select("doc_id", "digest", F.array(F.struct(lo.alias("a"), (lo + F.col("n")).alias("b"))).alias("hits"))
            .unionByName(cand.join(partly, ["g", "c"]).select(
                "doc_id", "digest", F.transform("s", lambda x: F.struct(
                    (lo + x["a"]).alias("a"), (lo + x["b"]).alias("b"))).alias("hits"))))


def _spans(col: pa.Array, span: int) -> list[tuple[int, int]]:
    """Byte intervals covered by windows that start in the given stretches, merged."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in col):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + span - 1)
        else:
            out.append([a, b + span - 1])
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of ``docs``.

    ``kept`` holds the remaining bytes (they need not be valid UTF-8).
    """
    t = F.coalesce("text", F.lit(""))
    d = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("doc_id"), t.alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    hits = repeated_windows(d, span, gram).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary" if with_text else ""

    def cut(batches):
        for b in batches:
            rows = []
            for i, text, found in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                s = _spans(found or [], span)
                kept, at = [], 0
                for a, e in s:
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                kept = b"".join(kept)
                rows.append((i, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [[]] * 6
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    both = d.join(hits.hint("shuffle_hash"), ["doc_id", "digest"], "left").select("doc_id", "text", "hits")
    return both.mapInArrow(cut, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
