"""Operators 11 to 13 against the libraries themselves and plain Python, on the awkward table and on arbitrary texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faresight.llm import alignment, blocks, importance, word_table
from test_contracts import _rows, by_id, docs, none  # noqa: F401

ENC = word_table.Encoder(word_table.vocabulary_path(), word_table.ranks_path())
TK = alignment.Tokens(word_table.vocabulary_path(), word_table.ranks_path(), alignment.piece_path())
BITS = st.sampled_from([" ", "  ", "\n", "\t", " \n", "a", "it's", "We'LL", "é", "ß12", "ñ", "<|endoftext|>", "x" * 40, "12,5", "…",
                        "中文", " ", "\u0085", "　", "\U0001f642", "-", "'s", "ẞ", "\x1c", "\x00", "", "▁", "՘", "֋",
                        "<s>", "<unk>", "<0x0A>", "​", "́"])
TEXTS = st.lists(st.one_of(st.lists(BITS, max_size=12).map("".join), st.text(max_size=30)), min_size=1, max_size=5)


# ---------------------------------------------------------------- 12
def test_ranges_that_are_split_further_agree_with_the_tokenizer():
    from faresight.llm.word_table import _ODD, WHITE
    pre = ENC.tk.pre_tokenizer.pre_tokenize_str
    fine = word_table.Splitter([]).fine
    white = re.compile(f"[{WHITE}]")
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        assert (len(pre("  " + s)) == 1) == bool(white.match(s)), hex(c)
        if not _ODD.search(s):
            t = f"a{s}1{s}!{s} {s}  {s}"
            assert [t[b:e] for _, (b, e) in pre(t)] == fine(t), hex(c)
            assert s.isalpha() == (len(pre("a" + s + "a")) == 1), hex(c)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_op12_words_give_the_tokenizers_ids(texts):
    s = word_table.Splitter(ENC.special)
    codes, counts = s.codes(pa.array(texts, pa.string()))
    ids, edge = ENC(list(s.words)), np.cumsum([0, *counts.tolist()])
    got = [[i for k in codes[x:y].tolist() for i in ids[k]] for x, y in zip(edge[:-1], edge[1:])]
    assert got == [e.ids for e in ENC.tk.encode_batch(texts, add_special_tokens=False)]


def _digests(t):
    ids = ENC.tk.encode(t or "", add_special_tokens=False).ids
    text = ENC.tk.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [2000, 32 << 20])
def test_op12_round_trip(spark, docs, size):  # noqa: F811
    out = word_table.round_trip(docs, word_table.vocabulary_path(), word_table.ranks_path(), size)
    out = out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("i"), F.sha2("decoded", 256).alias("d"))
    want = {}
    for i, t, *_ in _rows():
        want.setdefault(i, []).append(_digests(t))
    assert by_id(out, "n_tokens", "i", "d") == {k: sorted(v, key=repr) for k, v in want.items()}


def test_op12_each_word_is_encoded_once(spark, docs):  # noqa: F811
    split = word_table.split(docs, ENC.special, 2000)
    words = [r.word for r in word_table.word_table(split, word_table.vocabulary_path(), None).select("word").collect()]
    assert len(words) == len(set(words)) and " the" in words and "<|endoftext|>" in words


def test_op12_decode_joins_pieces_and_mends_broken_utf8(spark):
    rows = [(1, "k", [262, 50256]), (2, None, []), (None, "x", None), (3, "y", ENC.tk.encode("中").ids[:-1]), (4, "z", [220] * 30_000)]
    df = spark.createDataFrame(rows, "pos long, id string, ids array<int>")   # names used inside
    got = {r.pos: (r.id, r.text) for r in word_table.decode(df).collect()}
    assert got == {i: (k, ENC.tk.decode(x or [], skip_special_tokens=False)) for i, k, x in rows}
    with pytest.raises(Exception, match="not in the vocabulary"):
        word_table.decode(spark.createDataFrame([(1, [70_000])], "k int, ids array<int>")).collect()


def test_op12_other_pieces_travel_as_bytes():
    """A word whose pieces spell something else comes back with those bytes."""
    cols = {"word": ["ab", None, "c"], "places": [[(3 << 26) + 1], None, [(3 << 26), (4 << 26)]], "n": [2, 2, 1], "pos": [0, 1, 0],
            "id": [7, 8, 9], "piece": [b"a", b"b", b"XY"]}
    types = [pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], names=list(cols))
    out = {b.column("block")[0].as_py(): {c: b.column(c)[0].as_py() for c in b.schema.names[1:]}
           for b in word_table._pack(iter([batch.slice(0, 1), batch.slice(1)]))}
    back = lambda b, c, k: blocks.unsqueeze(out[b][c], out[b]["n"][k]).tolist()
    assert np.cumsum(back(3, "codes", 0)).tolist() == [0, 1] and bytes(back(3, "other", 3)) == b"XY"
    assert back(3, "lengths", 4) == [3, 0] and back(3, "ids", 2) == [9, 7, 8] and back(4, "ids", 2) == [9]


# ---------------------------------------------------------------- 11
def _tokens(t):
    """[(id, bytes)] of A and B for blank + text, by the libraries on the whole text."""
    a = TK.a.tk.encode(" " + t, add_special_tokens=False).ids
    b = TK.b.encode(t)
    whole = (" " + t).encode()
    x, y = [(i, TK.a_bytes[i]) for i in a], [(i, TK.b_bytes[i]) for i in b]
    if not t or b"".join(p for _, p in x) != whole or b"".join(p for _, p in y) != whole:
        return [], []
    return x, y


def _links(x, y):
    """All overlapping pairs, by comparing every A range with every B range."""
    ra, rb, out = [], [], []
    for toks, r in ((x, ra), (y, rb)):
        at = 0
        for i, p in toks:
            r.append((i, at, at + len(p)))
            at += len(p)
    j0 = 0
    for n, (_, s, e) in enumerate(ra):
        while j0 < len(rb) and rb[j0][2] <= s:
            j0 += 1
        j = j0
        while j < len(rb) and rb[j][1] < e:
            out.append((n, j))
            j += 1
    return ra, rb, out


def _groups(ra, rb):
    cuts = sorted({e for *_, e in ra} & {e for *_, e in rb})
    sides = []
    for r in (ra, rb):
        own, it = [[] for _ in cuts], 0
        for i, _, e in r:
            while cuts[it] < e:
                it += 1
            own[it].append(str(i))
        sides.append(own)
    return cuts, [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides)]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 6))
def test_op11_ids_links_and_groups(texts, lane):
    al = alignment.Aligned(TK, pa.array(texts, pa.string()))
    digests = al.digests(TK)
    a, b, cut = alignment.lockstep(al.ea, al.eb, al.oa, al.ob, lane)
    assert a.tolist() == al.link_a.tolist() and b.tolist() == al.link_b.tolist() and cut.tolist() == al.cut.tolist()
    for k, t in enumerate(texts):
        x, y = _tokens(t)
        assert al.a[al.oa[k]:al.oa[k + 1]].tolist() == [i for i, _ in x], t
        assert al.b[al.ob[k]:al.ob[k + 1]].tolist() == [i for i, _ in y], t
        ra, rb, links = _links(x, y)
        s, e = al.lo[k], al.lo[k + 1]
        assert list(zip((al.link_a[s:e] - al.oa[k]).tolist(), (al.link_b[s:e] - al.ob[k]).tolist())) == links
        cuts, parts = _groups(ra, rb)
        assert al.groups[k] == len(cuts)
        assert digests[k] == (hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")


def test_op11_byte_pieces_are_the_models(spark):
    assert TK.a_bytes[50256] == b"<|endoftext|>" and TK.b_bytes[3 + 0x0A] == b"\n" and len(TK.b_bytes) == 32_000


@pytest.mark.parametrize("size", [2000, 32 << 20])
def test_op11_report(docs, size):  # noqa: F811
    rows = [(i, *_links(*_tokens(t or ""))) for i, t, *_ in _rows()]
    count = Counter((ra[m][0], rb[n][0]) for _, ra, rb, links in rows for m, n in links)
    most = {}
    for (_, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    want = {}
    for i, ra, rb, links in rows:
        cuts, parts = _groups(ra, rb)
        own = [(count[ra[m][0], rb[n][0]], rb[n][0]) for m, n in links]
        want.setdefault(i, []).append((len(ra), len(rb), len(cuts), len(links), sum(c == most[b] for c, b in own), sum(c for c, _ in own),
                                       hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    got = by_id(alignment.report(docs, size=size), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}


def test_op11_align_gives_the_links_themselves(docs):  # noqa: F811
    for r in alignment.align(docs.where("doc_id in (4, 6, 11, 12)")).collect():
        t = next(t for i, t, *_ in _rows() if i == r.doc_id)
        ra, rb, links = _links(*_tokens(t))
        assert list(zip(r.link_a, r.link_b)) == links and r.a_ends == [e for *_, e in ra] and r.cuts == _groups(ra, rb)[0]


# ---------------------------------------------------------------- 13
@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.lists(BITS, max_size=12).map("".join), min_size=1, max_size=6), st.integers(2, 10_000))
def test_op13_buckets_of_payloads(texts, buckets):
    got, n = importance.bucket_lists([t.encode() for t in texts], buckets)
    want = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
        want += [zlib.crc32(f.encode()) % buckets for f in w + [f"{x} {y}" for x, y in zip(w, w[1:])]]
    assert got.tolist() == want


def test_op13_pair_crc_of_long_words():
    words = [b"x" * n for n in (1, 63, 64, 65, 1000, 70_000)]
    crc, size = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for k in range(len(words)):
        got = importance.pair_crc(np.repeat(crc[k:k + 1], len(words)), crc, size)
        assert got.tolist() == [zlib.crc32(words[k] + b" " + w) for w in words]


def _dsir(rows, target):
    feats = lambda t: (lambda w: w + [f"{x} {y}" for x, y in zip(w, w[1:])])(
        re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))
    bucket = lambda t: [zlib.crc32(f.encode()) % 10000 for f in feats(t)]
    s, t = Counter(b for _, x in rows for b in bucket(x)), Counter(b for x in target for b in bucket(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in rows:
        f = bucket(x)
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r in out if r[1] >= 39]
    for k, r in enumerate(sorted(able, key=lambda r: (-r[3], r[0] is not None, r[0] or 0))[:25 * len(able) // 100]):
        r[4] = k + 1
    return out


def test_op13_resample(spark, docs):  # noqa: F811
    target = spark.createDataFrame([(1, "the cat and the dog were in the house"), (2, None), (3, "")], "item_id long, text string")
    want = {}
    for r in _dsir([(i, t) for i, t, *_ in _rows()], ["the cat and the dog were in the house", None, ""]):
        want.setdefault(r[0], []).append(tuple(r[1:]))
    got = by_id(importance.resample(docs, target), "n_features", "weight", "score", "rank")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}


def test_empty_tables(spark, none):  # noqa: F811
    target = spark.createDataFrame([], "item_id long, text string")
    for out in (word_table.digests(none), alignment.report(none), alignment.align(none), importance.resample(none, target)):
        assert out.collect() == []
