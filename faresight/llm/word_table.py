"""BPE encoding and decoding of whole texts through a distinct-word table.

1. Split (one pass over the texts). Words are the pre-tokens of this byte-level BPE. Texts fall first into chunks at
   blanks, equal chunks are split further once, and a block of documents becomes one row: its distinct words and the
   squeezed word codes of its documents in order (``blocks``).
2. Word table. (block, code) places of every word meet by word: one row per distinct word of the corpus. Each is
   encoded once. A word holds at most one place per block; a list ends after the blocks of 4,096
   read tasks, so that no row grows with the corpus (a word is encoded anew after that).
3. Decoding. The ids of each distinct word are joined with the id-to-piece table (one row per id of the
   vocabulary, the only table that is broadcast: 50,257 rows whatever the input) and the pieces are put together again.
4. Ids and pieces go back to the blocks, a packed row per task and block, and there to their positions.

A word whose pieces spell the word itself travels without its bytes; the block has them.

Words: a run of anything but white space with the blank before it, or a run of white space without the blank that belongs to the next
word, always starts and ends a pre-token. Within such a run the vocabulary's own pattern splits further, as long as
all characters lie in ranges where any Unicode version knows the same letters and digits (``_PLAIN``); other runs stay
whole, and the tokenizer splits them itself. A special token's string is a word of its own.

Defined cases: a null or empty text has no tokens and decodes to the empty text; null ids and repeated rows stay, each row
on its own; an empty table gives an empty result; a text without white space is one long word (held by one task, as the
text itself is); other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import os
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
from faresight.llm.common import byte_slices, text_buffers

# White space as the tokenizer's pattern knows it, and the pattern itself.
_span = lambda a, b: chr(a) + "-" + chr(b)
WHITE = ("\t-\r \x85\xa0" + chr(0x1680) + _span(0x2000, 0x200A) + chr(0x2028) + chr(0x2029) + chr(0x202F) + chr(0x205F)
         + chr(0x3000))
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Ranges where every Unicode version has the same letters and digits, and letters are what isalpha() says.
_PLAIN = "\x00-" + chr(0x52F) + "".join(_span(a, b) for a, b in [
    (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)])
_ODD = re.compile(f"[^{_PLAIN}]")
_CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_SAFE = re.compile(f" (?=[^{WHITE}])")
_WHITE = re.compile(f"[{WHITE}]")

SLICE = 1 << 20       # bytes of text split at a time
TASKS = 12            # a list of places spans the blocks of 2 ** TASKS read tasks
BLOCKS = "block bigint, ids array<bigint>, counts array<bigint>, n_codes bigint, codes binary, words array<string>"
PACKED = "block bigint, n array<bigint>, codes binary, sizes binary, ids binary, other binary, lengths binary"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """The same vocabulary as merge ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- words
class Splitter:
    """Word codes of texts against a growing dictionary of one block; chunks are known for one slice of texts."""

    def __init__(self, special: list[str]):
        import regex
        self.fine = regex.compile(SPLIT).findall
        self.special = special
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.flat, self.size = array("I"), array("I")

    def _chunk(self, c: str) -> int:
        n = len(self.size)
        known = self.chunks.setdefault(c, n)
        if known == n:
            words = self.words
            if c in self.special or not (c.isascii() or not _ODD.search(c)):
                own = [c]
            elif (c[1:] if c[0] == " " else c).isalpha():
                own = [c]
            else:
                own = self.fine(c)
            self.size.append(len(own))
            self.flat.extend([words.setdefault(w, len(words)) for w in own])
        return known

    def _slow(self, text: str) -> np.ndarray:
        """Chunk by chunk; long texts in slices that end where a word ends."""
        out = array("I")
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                out.append(self._chunk(part))
                continue
            i = 0
            while i < len(part):
                m = _SAFE.search(part, i + 1_000_000)
                j = m.start() if m else len(part)
                out.extend([self._chunk(c) for c in _CHUNK.findall(part[i:j])])
                i = j
        return np.frombuffer(out, np.uint32)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word codes of all texts in order, words per text)."""
        self.chunks, self.flat, self.size = {}, array("I"), array("I")
        runs = self._chunks_of(texts)
        size, flat = np.frombuffer(self.size, np.uint32).astype(np.int64), np.frombuffer(self.flat, np.uint32)
        begin = np.cumsum(size) - size
        counts = np.array([size[r].sum() for r in runs], np.int64)
        out = np.empty(counts.sum(), np.uint32)
        at = 0
        for r in runs:
            for part in _parts(r, 200_000):
                got = flat[B.ranges(begin[part], size[part])]
                out[at:at + len(got)] = got
                at += len(got)
        return out, counts

    def _chunks_of(self, texts: pa.Array) -> list[np.ndarray]:
        """Chunk codes of each text. Where every blank is followed by something visible, texts are cut at blanks at once."""
        split = pc.split_pattern(texts, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        codes = split.flatten().dictionary_encode()
        seen, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        first = off[:-1]
        blank = np.fromiter((not c or _WHITE.match(c) is not None for c in seen), bool, len(seen))
        inner = np.fromiter((any(s in c for s in self.special) for c in seen), bool, len(seen)) if self.special else np.zeros(len(seen), bool)
        odd = blank[code]
        odd[first] = False
        odd |= inner[code]
        slow = np.zeros(len(texts), bool)
        slow[np.searchsorted(off, np.flatnonzero(odd), side="right") - 1] = True
        if any(" " in s for s in self.special):
            for s in self.special:
                slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        use = np.ones(len(code), bool)
        use[first] = False
        use &= ~np.repeat(slow, np.diff(off))
        later = np.zeros(len(seen), np.uint32)
        for k in np.unique(code[use]).tolist():
            later[k] = self._chunk(" " + seen[k])
        lead = np.zeros(len(seen), np.uint32)
        for k in np.unique(code[first[~slow]]).tolist():
            if seen[k]:
                lead[k] = self._chunk(seen[k])
        out = []
        for t in range(len(texts)):
            if slow[t]:
                out.append(self._slow(texts[t].as_py()))
                continue
            c = code[off[t]:off[t + 1]]
            x = later[c]
            if seen[c[0]]:
                x[0] = lead[c[0]]
                out.append(x)
            else:
                out.append(x[1:])
        return out

    def block(self, number: int, ids: list, codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        order, codes = B.by_frequency(np.concatenate(codes), len(self.words))
        words = pa.array(list(self.words), pa.string()).take(pa.array(order))
        if len(words) >> B.CODE_BITS:
            raise ValueError("a block holds too many distinct words")
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(ids, pa.int64()), one(np.concatenate(counts), pa.int64()), pa.array([len(codes)], pa.int64()),
             pa.array([B.squeeze(codes)], pa.binary()), one(words, pa.string())],
            names=["block", "ids", "counts", "n_codes", "codes", "words"])


def split(docs: DataFrame, special: list[str], size: int = B.TEXT) -> DataFrame:
    """One row per block of about ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        s, ids, codes, counts, held = Splitter(special), [], [], [], 0
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            _, off = text_buffers(texts)
            for i, j in byte_slices(off, min(size, SLICE)):
                if ids and held + off[j] - off[i] > size:
                    yield s.block(B.block_number(task, turn), ids, codes, counts)
                    turn, s, ids, codes, counts, held = turn + 1, Splitter(special), [], [], [], 0
                c, n = s.codes(texts.slice(i, j - i))
                codes.append(c)
                counts.append(n)
                ids += b.column(0).slice(i, j - i).to_pylist()
                held += off[j] - off[i]
        if ids:
            yield s.block(B.block_number(task, turn), ids, codes, counts)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BLOCKS)


# ---------------------------------------------------------------- ids and pieces
class Encoder:
    """Ids of words. Words of letters that every Unicode version knows go through the rank file of the same
    vocabulary (several times faster on short strings), all others and special tokens through the tokenizer itself."""

    _made: dict = {}

    @classmethod
    def of(cls, path: str, ranks: str | None) -> "Encoder":
        if (path, ranks) not in cls._made:
            cls._made[path, ranks] = cls(path, ranks)
        return cls._made[path, ranks]

    def __init__(self, path: str, ranks: str | None = None, as_text: bool = False):
        self.path, self.as_text = path, as_text     # as_text: special tokens' strings are ordinary text
        self.special = [] if as_text else special_tokens(path)
        self.fast = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    @functools.cached_property
    def tk(self):
        """The tokenizer itself, loaded when a word needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tk = Tokenizer.from_file(self.path)
        tk.no_truncation()
        tk.no_padding()
        tk.encode_special_tokens = self.as_text
        return tk

    def __call__(self, words: list[str]) -> list[list[int]]:
        out, rare, fast = [None] * len(words), [], self.fast
        for k, w in enumerate(words):
            if fast and w not in self.special and (w.isascii() or not _ODD.search(w)):
                out[k] = fast(w)
            else:
                rare.append(k)
        for i in range(0, len(rare), 1000):
            part = rare[i:i + 1000]
            for k, e in zip(part, self.tk.encode_batch([words[k] for k in part], add_special_tokens=False)):
                out[k] = e.ids
        return out


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def byte_pieces(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]     # bytes written as themselves
    hidden = [b for b in range(256) if b not in set(shown)]                   # the others as U+0100 and on
    byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
    out = {i: bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p, i in spec["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece) for every id of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in byte_pieces(path).items()], "id int, piece binary")


def with_pieces(rows: DataFrame, path: str) -> DataFrame:
    """Per id of each row's ``ids`` one row (n, pos, id, piece), in order and next to each other; the row's other columns
    stand where pos is 0."""
    carried = [c for c in rows.columns if c != "ids"]
    one = rows.select(*carried, F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "id"))
    one = one.select(*[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in carried], "n", "pos", "id")
    pieces = F.broadcast(piece_table(rows.sparkSession, path).withColumnRenamed("id", "p_id"))   # bounded by the vocabulary
    return one.join(pieces, one.id == pieces.p_id, "left").drop("p_id")


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``with_pieces`` regrouped so that none ends within a row's ids."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        pos, n = b.column("pos").to_numpy(), b.column("n").to_numpy()
        ends = np.flatnonzero(pos == n - 1)
        if not len(ends):
            rest.append(b)
            continue
        cut = int(ends[-1]) + 1
        whole = pa.Table.from_batches([*rest, b.slice(0, cut)]).combine_chunks().to_batches()[0]
        rest = [b.slice(cut)] if cut < len(b) else []
        pos, n = whole.column("pos").to_numpy(), whole.column("n").to_numpy()
        head = np.flatnonzero(pos == 0)
        if not len(head) or not np.array_equal(pos, B.ranges(np.zeros(len(head), np.int64), n[head].astype(np.int64))):
            raise ValueError("ids of a row are not next to each other")
        if whole.column("piece").null_count:
            raise ValueError("an id is not in the vocabulary")
        yield whole
    if rest:
        raise ValueError("ids of a row are missing")


def _joined(whole: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each row, ids per row, ids, piece bytes, byte offsets of the rows)."""
    head = np.flatnonzero(whole.column("pos").to_numpy() == 0)
    n = whole.column("n").to_numpy()[head].astype(np.int64)
    data, off = text_buffers(whole.column("piece"))
    return head, n, whole.column("id").to_numpy(), data, np.append(off[head], off[-1])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (any columns and ``ids`` array<int>) with ``text`` in place of the ids: their pieces, joined and read as UTF-8
    (what is no UTF-8 becomes U+FFFD). Null or empty ids give the empty text."""
    path = path or vocabulary_path()
    carried = [f for f in rows.schema.fields if f.name != "ids"]
    kept = rows.select(F.struct(*[F.col(f.name).alias(f"c{k}") for k, f in enumerate(carried)], F.lit(1).alias("c")).alias("row"), "ids")

    def run(batches):
        for w in _whole_rows(batches):
            head, _, _, data, off = _joined(w)
            raw = data.tobytes()
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([w.column("row").take(pa.array(head)), pa.array(texts, pa.string())], names=["row", "text"])

    some = with_pieces(kept.where("size(ids) > 0"), path)
    out = some.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, text string")
    out = out.unionByName(kept.where("ids is null or size(ids) = 0").select("row", F.lit("").alias("text")))
    return out.select(*[F.col(f"row.c{k}").alias(f.name) for k, f in enumerate(carried)], "text")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the word table with pieces -> one packed row per block (of those that this task has met)."""
    held: dict[int, list] = {}
    size = 0

    def flush():
        for block, rows in held.items():
            codes, sizes, ids, other, lengths = (np.concatenate([r[k] for r in rows]) for k in range(5))
            # in the order of their codes, which then differ by little
            order = np.argsort(codes, kind="stable")
            ids = ids[B.ranges((np.cumsum(sizes) - sizes)[order], sizes[order])]
            width = np.maximum(lengths, 1) - 1
            other = other[B.ranges((np.cumsum(width) - width)[order], width[order])]
            parts = [np.diff(codes[order], prepend=0), sizes[order], ids, other, lengths[order]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                 *(pa.array([B.squeeze(x)], pa.binary()) for x in parts)],
                names=["block", "n", "codes", "sizes", "ids", "other", "lengths"])

    for w in _whole_rows(batches):
        head, n, ids, data, off = _joined(w)
        word, places = w.column("word").take(pa.array(head)), w.column("places").take(pa.array(head))
        text, at = text_buffers(word)
        # a word that its pieces do not spell carries their bytes
        same = np.diff(at) == np.diff(off)
        check = np.flatnonzero(same)
        if len(check):
            ends = np.cumsum(np.diff(at)[check])
            unlike = text[B.ranges(at[check], np.diff(at)[check])] != data[B.ranges(off[check], np.diff(off)[check])]
            same[check[np.unique(np.searchsorted(ends, np.flatnonzero(unlike), side="right"))]] = False
        length = np.where(same, 0, np.diff(off) + 1)
        each = np.diff(places.offsets.to_numpy())
        place = places.flatten().to_numpy()
        row = np.repeat(np.arange(len(head)), each)
        order = np.argsort(place, kind="stable")
        place, row = place[order], row[order]
        block = place >> B.CODE_BITS
        edge = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            r = row[s:e]
            far = r[length[r] > 0]
            parts = [place[s:e] & ((1 << B.CODE_BITS) - 1), n[r], ids[B.ranges(head[r], n[r])].astype(np.uint32),
                     data[B.ranges(off[far], np.diff(off)[far])], length[r]]
            held.setdefault(int(block[s]), []).append(parts)
            size += sum(x.nbytes for x in parts)
        if size > 24 * SLICE:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def word_table(blocks: DataFrame, path: str, ranks: str | None) -> DataFrame:
    """(word, places, ids): every distinct word of all blocks, encoded once; places are block and code in one number."""
    at = blocks.select("block", F.posexplode("words").alias("code", "word"))
    at = at.select("word", (F.shiftleft("block", B.CODE_BITS) + F.col("code")).alias("place"))
    # equal words meet first, so that no partial lists travel
    at = at.repartition("word")
    words = at.groupBy("word", F.shiftright("place", B.CODE_BITS + B.TURN_BITS + TASKS).alias("span")).agg(F.collect_list("place").alias("places"))

    def run(batches):
        enc = Encoder.of(path, ranks)
        for b in batches:
            ids = enc(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "places", "ids"])

    return words.select("word", "places").mapInArrow(run, "word string, places array<bigint>, ids array<int>")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their packed entries -> documents with ids and decoded text."""
    for b in batches:
        for k in range(len(b)):
            get = lambda c: b.column(c)[k].as_py()  # noqa: E731, B023
            docs, counts, n_codes = get("ids"), np.array(get("counts"), np.int64), get("n_codes")
            codes = B.unsqueeze(get("codes"), n_codes)
            text, at = text_buffers(b.column("words")[k].values)
            entries = get("entries") or []
            cat = lambda c, k: np.concatenate([B.unsqueeze(e[c], e["n"][k]) for e in entries] or [np.zeros(0, np.uint32)])  # noqa: E731, B023
            code = np.concatenate([np.cumsum(B.unsqueeze(e["codes"], e["n"][0])) for e in entries] or [np.zeros(0, np.int64)]).astype(np.int64)
            n, ids, other, length = cat("sizes", 1).astype(np.int64), cat("ids", 2), cat("other", 3).astype(np.uint8), cat("lengths", 4).astype(np.int64)
            del entries
            if len(code) != len(at) - 1:
                raise ValueError("a word of a block came back twice or not at all")
            # by dictionary code: where a word's ids begin and how many they are, where its bytes begin and how many
            begin, many, w_begin, w_many = (np.zeros(len(code), np.int64) for _ in range(4))
            begin[code], many[code] = np.cumsum(n) - n, n
            w_begin[:], w_many[:] = at[:-1], np.diff(at)
            far = length > 0
            w_many[code[far]] = length[far] - 1
            w_begin[code[far]] = len(text) + np.cumsum(length[far] - 1) - (length[far] - 1)
            data = np.concatenate([text, other]) if len(other) else text
            upto = np.append(0, np.cumsum(counts))
            step = 100_000  # word occurrences put together at a time
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + step, side="right")) - 1)
                c = codes[upto[i]:upto[j]]
                edge = upto[i:j + 1] - upto[i]
                t_at = np.append(0, np.cumsum(many[c]))[edge]
                b_at = np.append(0, np.cumsum(w_many[c]))[edge]
                flat = np.concatenate([ids[B.ranges(begin[x], many[x])] for x in _parts(c, step)] or [ids[:0]]).astype("<u4").tobytes()
                raw = np.concatenate([data[B.ranges(w_begin[x], w_many[x])] for x in _parts(c, step)] or [data[:0]]).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[i:j], pa.int64()), pa.array(np.diff(t_at), pa.int64()),
                    pa.array([flat[4 * s:4 * e] for s, e in zip(t_at[:-1].tolist(), t_at[1:].tolist())], pa.binary()),
                    pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(b_at[:-1].tolist(), b_at[1:].tolist())], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])
                i = j


def _parts(c: np.ndarray, step: int) -> list[np.ndarray]:
    return [c[k:k + step] for k in range(0, len(c), step)]


def round_trip(docs: DataFrame, path: str | None = None, ranks: str | None = None, size: int = B.TEXT) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row of ``docs`` (columns doc_id, text): ids as little-endian unsigned 32-bit
    integers, and the text that the ids' pieces give."""
    if path is None:
        path, ranks = vocabulary_path(), ranks_path()
    blocks = B.keep(split(docs, special_tokens(path), size), "word_blocks")
    packed = with_pieces(word_table(blocks, path, ranks), path).mapInArrow(_pack, PACKED)
    return B.gather(blocks, packed).mapInArrow(_finish, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row."""
    return round_trip(docs, path, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                                F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
