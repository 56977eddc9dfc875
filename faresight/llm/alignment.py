"""Alignment of two tokenizers' outputs over the same bytes, all documents of a batch in lockstep.

Both tokenizers read a blank and then the text: a byte-level BPE (A) and a sentencepiece model (B, which adds the
blank itself). Tokens become byte ranges. One state vector holds, per open document, the current A and the current B
token. A step links the two tokens of every document, compares where they end, and advances the one that ends first, or
both; equal ends cut the text into groups. Documents that have ended are compacted away, so a step costs as much as
documents are open. A long document enters as several lanes, cut where both tokenizers end a token, so that one long
text does not run on alone.

Ids come chunk by chunk through a bounded cache: a blank after something visible and before something visible starts a new token
in either tokenizer. A chunk whose pieces of A or B do not spell it makes its text one without tokens.

Corpus-wide counts of linked id pairs are summed per block of documents first (``blocks``); only the distinct pairs of a
block travel, and the links themselves stay in the block as squeezed codes.

Defined cases: null or empty texts, and texts whose A or B bytes differ from blank + text (a text with U+2581), have no tokens: zeros
and an empty digest. Null ids and repeated rows stay, each row on its own; an empty table gives an empty result; other
columns are not read. A tie for the highest count of a B id counts for every pair that has it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm import blocks as B
from faresight.llm.common import byte_slices, materialize, text_buffers
from faresight.llm.word_table import WHITE, Encoder, byte_pieces, ranks_path, vocabulary_path

SLICE = 2 << 20      # bytes of text aligned at a time
LANE = 1024          # A tokens of a lane, about
CACHE = 250_000      # chunks kept per worker
A_SHIFT = 20         # an id pair is one number: A's id above these bits, B's id in them

GLUE = chr(0x2581)  # the model writes a blank so
_CUT = re.compile(f"(?<=[^{WHITE}])(?= )|(?<=[^ ])(?= [^{WHITE}])")
_SAFE = re.compile(f"(?<=[^ ]) (?=[^{WHITE}])")
_FIRST = re.compile(f"[{WHITE}]")
BLOCKS = ("block bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "digests array<string>, n_codes bigint, codes binary, pairs array<bigint>, times array<bigint>")
ROWS = ("doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, "
        "link_a array<int>, link_b array<int>, cuts array<int>")


def piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Ids of both tokenizers for whole texts, and the bytes of every id."""

    _made: dict = {}

    @classmethod
    def of(cls, a: str, ranks: str | None, b: str) -> "Tokens":
        if (a, ranks, b) not in cls._made:
            cls._made[a, ranks, b] = cls(a, ranks, b)
        return cls._made[a, ranks, b]

    def __init__(self, a: str, ranks: str | None, b: str):
        import sentencepiece
        self.a = Encoder(a, ranks, as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = byte_pieces(a)
        self.a_bytes = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            if re.search(f"[^{GLUE}]{GLUE}", p):
                raise ValueError("a piece spans two words; texts cannot be cut at blanks")
            # a control or unknown piece spells nothing that a text could hold
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"\xff\xff"
                                if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(GLUE, " ").encode())
        if len(self.a_bytes) > 1 << 40 or len(self.b_bytes) > 1 << A_SHIFT:
            raise ValueError("a vocabulary is too large for the pair numbers")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # ids in decimal with what follows them within a group string: , or | for A, , or ; for B
        self.shown = [b"%d%s" % (i, s) for n, s in ((len(self.a_bytes), b","), (len(self.a_bytes), b"|"),
                                                    (len(self.b_bytes), b","), (len(self.b_bytes), b";")) for i in range(n)]
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.good: list[bool] = []
        self.ids: tuple[list, list] = ([], [])

    def _b_ids(self, chunks: list[str]) -> list[list[int]]:
        """Every chunk starts with the blank that the model adds; a single blank is read behind a letter."""
        out = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c == " ":
                out[k] = self.b.encode("x ")[len(self.b.encode("x")):]
        return out

    def _learn(self, chunks: list[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        for k in range(0, len(new), 10_000):
            part = new[k:k + 10_000]
            for c, a, b in zip(part, self.a(part), self._b_ids(part)):
                raw = c.encode()
                self.chunks[c] = len(self.good)
                self.good.append(b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw)
                self.ids[0].append(array("i", a).tobytes())
                self.ids[1].append(array("i", b).tobytes())

    def _slow(self, text: str) -> list[str]:
        out, i, s = [], 0, " " + text
        while i < len(s):
            m = _SAFE.search(s, i + 1_000_000)
            j = m.start() if m else len(s)
            out += [c for c in _CUT.split(s[i:j]) if c]
            i = j
        return out

    def texts(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """(A ids and offsets, B ids and offsets) of all texts as flat arrays; texts without tokens have none."""
        if len(self.good) > CACHE:
            self.clear()
        split = pc.split_pattern(texts, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        codes = split.flatten().dictionary_encode()
        seen, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        blank = np.fromiter((not c or _FIRST.match(c) is not None for c in seen), bool, len(seen))
        slow = np.zeros(len(texts), bool)
        slow[np.searchsorted(off, np.flatnonzero(blank[code]), side="right") - 1] = True
        used = np.unique(code[~np.repeat(slow, np.diff(off))])
        self._learn([" " + seen[k] for k in used.tolist()])
        at = np.zeros(len(seen), np.int64)
        at[used] = [self.chunks[" " + seen[k]] for k in used.tolist()]
        runs = []
        for t in range(len(texts)):
            if slow[t]:
                text = texts[t].as_py()
                chunks = self._slow(text) if text else []
                self._learn(chunks)
                runs.append(np.array([self.chunks[c] for c in chunks], np.int64))
            else:
                runs.append(at[code[off[t]:off[t + 1]]])
        good = np.array(self.good, bool)
        runs = [r if len(r) and good[r].all() else r[:0] for r in runs]
        every = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        own, every = np.unique(every, return_inverse=True)
        edge = np.cumsum([0, *map(len, runs)])
        out = []
        for ids in self.ids:
            parts = [ids[k] for k in own.tolist()]
            size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
            flat = np.frombuffer(b"".join(parts), np.int32)
            count = size[every]
            out += [flat[B.ranges((np.cumsum(size) - size)[every], count)], np.append(0, np.cumsum(count))[edge]]
        return out


def _ends(length: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte ends of tokens within their own text."""
    total = np.cumsum(length)
    before = np.append(0, total)[off[:-1]]
    return total - np.repeat(before, np.diff(off))


def _lanes(ea: np.ndarray, eb: np.ndarray, oa: np.ndarray, ob: np.ndarray, lane: int) -> tuple[np.ndarray, ...]:
    """(first A, last A + 1, first B) of every lane: texts, the long ones cut where both end a token."""
    first_a, last_a, first_b = [oa[:-1][np.diff(oa) > 0]], [oa[1:][np.diff(oa) > 0]], [ob[:-1][np.diff(oa) > 0]]
    for k in np.flatnonzero(np.diff(oa) > 2 * lane).tolist():
        x, y = ea[oa[k]:oa[k + 1]], eb[ob[k]:ob[k + 1]]
        cuts_a, cuts_b, i = [], [], lane
        while i < len(x) - 1:
            w = x[i:i + 256]
            at = np.minimum(np.searchsorted(y, w), len(y) - 1)
            hit = np.flatnonzero(y[at] == w)
            if len(hit) and i + hit[0] + 1 < len(x):
                cuts_a.append(oa[k] + i + hit[0] + 1)
                cuts_b.append(ob[k] + at[hit[0]] + 1)
                i += hit[0] + 1 + lane
            else:
                i += 256
        if cuts_a:
            n = int(np.searchsorted(first_a[0], oa[k]))
            last_a[0][n] = cuts_a[0]
            first_a.append(np.array(cuts_a))
            first_b.append(np.array(cuts_b))
            last_a.append(np.array([*cuts_a[1:], oa[k + 1]]))
    return np.concatenate(first_a), np.concatenate(last_a), np.concatenate(first_b)


def lockstep(ea: np.ndarray, eb: np.ndarray, oa: np.ndarray, ob: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether both end there) of every link, text by text and in order.

    ``ea`` and ``eb`` are byte ends within each text, ``oa`` and ``ob`` the texts' offsets in them; a text's last ends are equal.
    """
    i, last, j = _lanes(ea, eb, oa, ob, lane)
    order = np.argsort(i, kind="stable")
    i, last, j = i[order].copy(), last[order], j[order].copy()
    n = len(i)
    open_ = np.arange(n)
    steps, links = np.zeros(n, np.int64), []
    step = 0
    while len(open_):
        x, y = ea[i], eb[j]
        links.append((open_, i, j, x == y))
        step += 1
        i = i + (x <= y)
        j = j + (y <= x)
        going = i < last
        if not going.all():
            steps[open_[~going]] = step
            open_, i, j, last = open_[going], i[going], j[going], last[going]
    total = int(steps.sum())
    a, b, cut = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    begin = np.cumsum(steps) - steps
    for k, (o, p, q, c) in enumerate(links):
        at = begin[o] + k
        a[at], b[at], cut[at] = p, q, c
    return a, b, cut


class Aligned:
    """The alignment of a slice of texts."""

    def __init__(self, tokens: Tokens, texts: pa.Array):
        self.a, self.oa, self.b, self.ob = tokens.texts(texts)
        self.ea, self.eb = _ends(tokens.a_len[self.a], self.oa), _ends(tokens.b_len[self.b], self.ob)
        self.link_a, self.link_b, self.cut = lockstep(self.ea, self.eb, self.oa, self.ob)
        # links and groups per text
        self.lo = np.searchsorted(self.link_a, self.oa)
        self.groups = np.diff(np.append(0, np.cumsum(self.cut))[self.lo])

    def digests(self, tokens: Tokens) -> list[str]:
        """SHA-256 of each text's groups written out; '' without tokens."""
        at = np.flatnonzero(self.cut)
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.link_a[at]], b_last[self.link_b[at]] = True, True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_a, n_b = np.bincount(a_group, minlength=len(at)), np.bincount(b_group, minlength=len(at))
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        na, nb = len(tokens.a_bytes), len(tokens.b_bytes)
        out[np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[a_group]] = self.a + na * a_last
        out[np.arange(len(self.b)) + np.cumsum(n_a)[b_group]] = 2 * na + self.b + nb * b_last
        shown, o = tokens.shown, (self.oa + self.ob).tolist()
        return [hashlib.sha256(b"".join([shown[c] for c in out[s:e].tolist()])[:-1]).hexdigest() if e > s else ""
                for s, e in zip(o[:-1], o[1:])]


def _paths(a, ranks, b) -> tuple[str, str | None, str]:
    return (vocabulary_path(), ranks_path(), b or piece_path()) if a is None else (a, ranks, b or piece_path())


def _slices(batches: Iterator[pa.RecordBatch], limit: int):
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        _, off = text_buffers(texts)
        for i, j in byte_slices(off, limit):
            yield batch.column(0).slice(i, j - i), texts.slice(i, j - i), int(off[j] - off[i])


def align(docs: DataFrame, a: str | None = None, ranks: str | None = None, b: str | None = None) -> DataFrame:
    """Per row of ``docs`` (columns doc_id, text): both tokenizers' ids and the byte ends of their tokens in blank + text, the
    links (numbers of A and B tokens, pairwise) and the byte offsets of the cuts."""
    paths = _paths(a, ranks, b)

    def run(batches):
        tk = Tokens.of(*paths)
        for ids, texts, _ in _slices(batches, SLICE):
            al = Aligned(tk, texts)
            cuts = al.ea[al.link_a[al.cut]]
            lists = lambda x, o: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x, pa.int32()))
            links = np.diff(al.lo)
            yield pa.RecordBatch.from_arrays(
                [ids, lists(al.a, al.oa), lists(al.b, al.ob), lists(al.ea, al.oa), lists(al.eb, al.ob),
                 lists(al.link_a - np.repeat(al.oa[:-1], links), al.lo), lists(al.link_b - np.repeat(al.ob[:-1], links), al.lo),
                 lists(cuts, np.append(0, np.cumsum(al.groups)))],
                names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b", "cuts"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ROWS)


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    pairs, code = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
    edge = np.cumsum([0, *(len(h[6]) for h in held)])
    code = code.astype(np.uint32)
    codes = np.concatenate([code[s:e][h[7]] for h, s, e in zip(held, edge[:-1], edge[1:])])
    times = np.bincount(codes, minlength=len(pairs))
    order, codes = B.by_frequency(codes, len(pairs))
    one = lambda x, t: pa.array([x], pa.list_(t))
    flat = [np.concatenate([h[k] for h in held]) for k in range(1, 5)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one([i for h in held for i in h[0]], pa.int64()), *(one(x, pa.int64()) for x in flat),
         one([d for h in held for d in h[5]], pa.string()), pa.array([len(codes)], pa.int64()),
         pa.array([B.squeeze(codes)], pa.binary()), one(pairs[order], pa.int64()), one(times[order], pa.int64())],
        names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "n_codes", "codes", "pairs", "times"])


def align_blocks(docs: DataFrame, paths: tuple, size: int = B.TEXT) -> DataFrame:
    """One row per block of about ``size`` bytes of text: its documents' figures, its distinct id pairs and its links' pair codes."""

    def run(batches):
        tk = Tokens.of(*paths)
        task, turn, held, n = TaskContext.get().partitionId(), 0, [], 0
        for ids, texts, size_ in _slices(batches, min(size, SLICE)):
            if held and n + size_ > size:
                yield _block(B.block_number(task, turn), held)
                held, n, turn = [], 0, turn + 1
            al = Aligned(tk, texts)
            pairs, code = np.unique((al.a[al.link_a].astype(np.int64) << A_SHIFT) | al.b[al.link_b], return_inverse=True)
            held.append((ids.to_pylist(), np.diff(al.oa), np.diff(al.ob), al.groups, np.diff(al.lo), al.digests(tk), pairs,
                         code.astype(np.uint32)))
            n += size_
        if held:
            yield _block(B.block_number(task, turn), held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, links, best): how many links hold each id pair, and whether no other pair of its B id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = materialize(each.groupBy("pair").agg(F.sum("times").alias("links")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << A_SHIFT) - 1))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("links").alias("most"))
    return (counts.withColumn("b", b_id).join(top, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(len(b)):
            get = lambda c: b.column(c)[k]  # noqa: E731, B023
            codes = B.unsqueeze(get("codes").as_py(), get("n_codes").as_py())
            n = len(get("pairs"))
            links, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if get("entries").is_valid:
                e = get("entries").values
                at = e.field("code").to_numpy(zero_copy_only=False)
                links[at] = e.field("links").to_numpy(zero_copy_only=False)
                best[at] = e.field("best").to_numpy(zero_copy_only=False)
            if n and not links.all():
                raise ValueError("an id pair of a block came back without a count")
            per = get("n_links").values.to_numpy()
            upto = np.append(0, np.cumsum(per))
            total = lambda x: np.diff(np.append(0, np.cumsum(x[codes]))[upto])  # noqa: E731, B023
            flat = lambda c: get(c).values  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [flat("ids"), flat("n_a"), flat("n_b"), flat("n_groups"), flat("n_links"), pa.array(total(best)), pa.array(total(links)),
                 flat("digests")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def report(docs: DataFrame, a: str | None = None, ranks: str | None = None, b: str | None = None, size: int = B.TEXT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``."""
    blocks = B.keep(align_blocks(docs, _paths(a, ranks, b), size), "pair_blocks")
    entries = blocks.select("block", F.posexplode("pairs").alias("code", "pair")).join(pair_counts(blocks), "pair")
    return B.gather(blocks, entries.select("block", "code", "links", "best")).mapInArrow(
        _finish, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
