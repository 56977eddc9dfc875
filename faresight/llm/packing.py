"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

``pieces`` tokenizes whole texts where they are read (one pass) and cuts only
documents longer than the sequence length. Tokenizing goes through a cache:
a blank before a visible character always starts a new pre-token of this byte-level
BPE, so texts fall into chunks there, equal chunks are encoded once per
worker, and their ids are put together by array gathers. Texts where that rule does not
hold (runs of white space around a blank, a special token's string) are encoded whole.

``pack`` deals the pieces to islands of bounded size by a hash, so that every island sees the same mix of lengths
and a hot source or a huge group of copies has no effect. An island is one
Spark group: a few populations evolve side by side - crossover injects whole
well-filled bins of one parent into the other, drops bins that then hold a piece twice and puts
displaced pieces back best-fit - and hand their elite on in a ring. Bins that stay
poorly filled are dissolved and their pieces migrate to islands of the next round. Full pieces are sequences of their own.

Defined cases: a null or empty text is its end token alone; rows that repeat
are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import byte_slices, materialize, text_buffers, trimmed

SEQUENCE = 1024
END = 2
ISLAND = 8_000        # pieces of an island
ROUNDS = 3            # of dealing out; each packs what the last left in poorly filled bins
POOR = 0.985          # a bin filled less is dissolved before the next round
CACHE = 300_000       # chunks kept per worker and lead (about 60 MB)
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# Fixed value: the pattern that splits text before the merges of the rank file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """The same vocabulary as merge ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts, chunk by chunk through a bounded cache.

    Chunks of Latin letters go through the same vocabulary's rank file (several times faster on
    short strings; the split pattern has one meaning for them), all else through the tokenizer itself.
    """

    _made: dict = {}

    @classmethod
    def of(cls, path: str, ranks: str | None, cache: int | None = None) -> "Encoder":
        """One encoder per worker process, so that its cache serves all tasks there."""
        if (path, ranks) not in cls._made:
            cls._made[path, ranks] = cls(path, ranks)
        cls._made[path, ranks].cache = cache
        return cls._made[path, ranks]

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.known: dict[str, dict[str, bytes]] = {" ": {}, "": {}}
        self.fast, self.cache = None, None
        if ranks:
            import base64
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, chunks: list[str], lead: str) -> list[bytes]:
        """Ids of ``lead`` + chunk for every chunk, from the cache of that lead."""
        known = self.known[lead]
        if len(known) > (self.cache or CACHE):
            known.clear()
        out, rare, fast = [], [], self.fast
        for c in chunks:
            v = known.get(c)
            if v is None:
                if fast and (c.isascii() or max(c) < "\u0250"):
                    v = known[c] = array("I", fast(lead + c)).tobytes()
                else:
                    rare.append(len(out))
            out.append(v)
        for k in range(0, len(rare), 20_000):
            part = rare[k:k + 20_000]
            for r, e in zip(part, self.tk.encode_batch([lead + chunks[r] for r in part], add_special_tokens=False)):
                out[r] = known[chunks[r]] = array("I", e.ids).tobytes()
        return out

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without an end token."""
        n = len(texts)
        whole = np.zeros(n, bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        codes = split.flatten().dictionary_encode()
        words = codes.dictionary.to_pylist()
        code = codes.indices.to_numpy()
        # chunks after the first start with the blank; one that starts with more white space breaks the rule
        raw, at = text_buffers(codes.dictionary)
        lead = np.full(len(words), 32, np.uint8)
        some = np.flatnonzero(at[1:] > at[:-1])
        lead[some] = raw[at[some]]
        odd = np.zeros(len(words), bool)
        for k in np.flatnonzero((lead <= 32) | (lead >= 0xC2)):  # white space or the first byte of some
            odd[k] = not words[k] or words[k][0].isspace()
        if odd.any():
            later = odd[code]
            later[off[:-1]] = False
            whole[np.searchsorted(off, np.flatnonzero(later), side="right") - 1] = True
        firsts, first_at = np.unique(code[off[:-1]], return_inverse=True)
        enc = self._ids(words, " ") + self._ids([words[k] for k in firsts], "")
        size = np.fromiter(map(len, enc), np.int64, len(enc)) >> 2
        code = code.copy()
        code[off[:-1]] = len(words) + first_at
        flat = np.frombuffer(b"".join(enc), np.uint32)
        begin = np.cumsum(size) - size
        count = size[code]
        out_at = np.cumsum(count) - count
        ids = flat[np.repeat(begin[code] - out_at, count) + np.arange(int(count.sum()))]
        cut = np.append(out_at, len(ids))[off]
        return [self.whole(texts[k].as_py()) if whole[k] else ids[cut[k]:cut[k + 1]] for k in range(n)]


def pieces(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end: int = END,
           with_ids: bool = False, ranks: str | None = None, cache: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece; only the first piece of a cut document is shorter."""
    if path is None:
        path, ranks = tokenizer_path(), ranks_path()

    def run(batches):
        enc = Encoder.of(path, ranks, cache)
        for b in trimmed(batches):
            texts = pc.fill_null(b.column(1), "")
            _, off = text_buffers(texts)
            for i, j in byte_slices(off, 2 << 20):
                rows, ids = ([], [], [], [], []), []
                for k, x in zip(range(i, j), enc.batch(texts.slice(i, j - i))):
                    x = np.append(x, np.uint32(end)).astype("<u4")
                    edge = [0, *range(len(x) % length or length, len(x) + 1, length)] if len(x) > length else [0, len(x)]
                    for p, (s, e) in enumerate(zip(edge[:-1], edge[1:])):
                        raw = x[s:e].tobytes()
                        for out, v in zip(rows, (k, p, s, e - s, zlib.crc32(raw))):
                            out.append(v)
                        ids.append(raw if with_ids else None)
                cols = [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                        *(pa.array(r, pa.int64()) for r in rows[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32).tolist() for r in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


class _Bins:
    """Bins by free space; a bit per amount of space finds the best fit at once."""

    def __init__(self, room: int):
        self.room, self.items, self.free, self.by_free, self.mask = room, [], [], {}, 0

    def add(self, items: list[int], used: int) -> None:
        self._put(len(self.items), self.room - used)
        self.items.append(items)
        self.free.append(self.room - used)

    def _put(self, b: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(b)
        self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        m = self.mask >> size
        if not m:
            self.add([item], size)
            return
        free = size + (m & -m).bit_length() - 1
        own = self.by_free[free]
        b = own.pop()
        if not own:
            self.mask &= ~(1 << free)
        self.items[b].append(item)
        self.free[b] = free - size
        self._put(b, free - size)


def _fill(bins: _Bins, items, size) -> list[list[int]]:
    for k in items:
        bins.best_fit(k, size[k])
    return bins.items


def _cross(a: list[list[int]], b: list[list[int]], size: list[int], room: int, rnd: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``a`` go into ``b``; bins of ``b`` that share a piece go, their other pieces best-fit."""
    full = [x for x in a if room - sum(size[k] for k in x) <= 2]
    inject = [x for x in full if rnd.random() < 0.7]
    taken = {k for x in inject for k in x}
    bins, displaced = _Bins(room), []
    for x in inject:
        bins.add(list(x), sum(size[k] for k in x))
    for x in b:
        if any(k in taken for k in x):
            displaced += [k for k in x if k not in taken]
        elif room - (used := sum(size[k] for k in x)) <= 8 or rnd.random() < 0.6:
            bins.add(list(x), used)
        else:
            displaced += x
    displaced.sort(key=lambda k: -size[k])
    return _fill(bins, displaced, size)


def evolve(size: list[int], room: int = SEQUENCE, seed: int = 1, populations: int = 2, members: int = 3,
           generations: int = 24) -> list[list[int]]:
    """Bins (lists of item numbers) for items of the given sizes; stops as soon as no better is possible."""
    n = len(size)
    least = -(-sum(size) // room)
    order = sorted(range(n), key=lambda k: -size[k])
    best = _fill(_Bins(room), order, size)
    if len(best) <= least:
        return best
    rnd = random.Random(seed)

    def start():
        noise = rnd.random() * 0.3
        return _fill(_Bins(room), sorted(range(n), key=lambda k: -size[k] * (1 + noise * rnd.random())), size)

    def worth(bins):
        return len(bins), -sum((sum(size[k] for k in x) / room) ** 2 for x in bins) / max(1, len(bins))

    pops = [sorted([(worth(x), x) for x in [best, *(start() for _ in range(members - 1))]], key=lambda p: p[0])
            for _ in range(populations)]
    for g in range(generations):
        for pop in pops:
            a, b = rnd.sample(range(len(pop)), 2)
            child = _cross(pop[min(a, b)][1], pop[max(a, b)][1], size, room, rnd)
            pop.append((worth(child), child))
            pop.sort(key=lambda p: p[0])
            pop.pop()
        if g % 4 == 3:  # the elite moves on to the next population
            elite = [pop[0] for pop in pops]
            for k, pop in enumerate(pops):
                pop[-1] = elite[k - 1]
                pop.sort(key=lambda p: p[0])
        top = min((pop[0] for pop in pops), key=lambda p: p[0])
        if top[0][0] < len(best):
            best = top[1]
        if len(best) <= least:
            break
    return best


def _islands(items: DataFrame, turn: int, count: int, length: int) -> DataFrame:
    """One round: ``items`` with sequence_id, offset and the fill of their bin."""

    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["island"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        full = np.flatnonzero(size >= length)
        seq[full], fill[full] = np.arange(len(full)), length
        rest = np.flatnonzero(size < length)
        own = size[rest].tolist()
        for k, b in enumerate(evolve(own, length, seed=number + 1)):
            at = 0
            rows = rest[b]
            for r in rows:
                off[r] = at
                at += size[r]
            seq[rows], fill[rows] = len(full) + k, at
        pdf["sequence_id"] = (turn << 60) + (number << 28) + seq
        pdf["offset"], pdf["fill"] = off, fill
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]

    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id() % 1024, F.lit(turn)), F.lit(count))
    return (items.withColumn("island", deal).groupBy("island")
            .applyInPandas(island, PIECE + ", sequence_id bigint, offset bigint, fill bigint"))


def pack_pieces(items: DataFrame, length: int = SEQUENCE, island: int = ISLAND, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (columns of ``pieces``) with sequence_id and offset, gapless in every sequence."""
    done, left = None, items
    for turn in range(rounds):
        n = left.where(F.col("length") < length).count()
        out = materialize(_islands(left, turn, max(1, round(n / island)), length), "pack-round")
        last = turn == rounds - 1 or n <= island
        keep = out if last else out.where(F.col("fill") >= POOR * length)
        done = keep if done is None else done.unionByName(keep)
        if last:
            break
        left = out.where(F.col("fill") < POOR * length).drop("sequence_id", "offset", "fill")
    return done.drop("fill")


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end: int = END, cache: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of all ``docs``; ``cache``: chunks kept, in place of CACHE."""
    return pack_pieces(materialize(pieces(docs, path, length, end, cache=cache), "pack-pieces"), length)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """The sequences themselves: (sequence_id, ids), at most ``length`` ids each."""
    ids = pieces(docs, path, length, end, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").distinct()
    both = packed.join(ids, ["doc_id", "piece", "ids_crc32"])
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
