"""Language identification: a family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the whole text (letters lower-cased,
other ASCII read as a blank), taken as the square root of their shares and
scaled to length one. A linear SVM per language family picks the family (largest margin); between every two
languages of that family another one votes. The models are fitted on a sample
of ``per_language`` labelled texts of each language (a documented bound, drawn by
a seeded hash), the prediction reads every text whole, in place: no shuffle
of texts at all.

Defined cases: a null text or one without a letter gives ``und`` with score 0;
no labelled rows at all give ``und`` everywhere; a family of one language needs no
second step. The score is the product of the two steps' squashed margins.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import byte_slices, text_buffers, trimmed

# Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "bn", "ur", "mr", "pa"],
    "turkic": ["tr", "az", "kk", "uz"],
}
FAMILY_OF = {c: f for f, codes in FAMILIES.items() for c in codes}

DIM = 1 << 12
PER_LANGUAGE = 800  # labelled texts of each language that the models are fitted on
STEEPNESS = 4.0     # of the squashing of margins into a score

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unit-length rows of square-rooted trigram shares, one per text."""
    out = np.zeros((len(off) - 1, DIM), np.float32)
    if len(data) < 3:
        return out
    c = _FOLD[data]
    # 3 x 21 bits of the folded bytes, scattered by a multiplicative hash
    idx = (((c[:-2] << 16) | (c[1:-1] << 8) | c[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    for k in range(len(off) - 1):
        a, b = off[k], off[k + 1] - 2
        if b > a:
            out[k] = np.bincount(idx[a:b], minlength=DIM)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.maximum(norm, 1e-9)
    return out


def _svm(x1: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by accelerated gradient steps; classes weigh alike.

    The last column of ``x1`` is all ones (the bias). No step copies the matrix.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x1.shape[1], np.float32)
    v, t, rate = w.copy(), 1.0, 1.0 / (4.0 + reg)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = x1.T @ (-2 * weight * slack * y) + reg * v
        new, t2 = v - rate * grad, (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1].astype(np.float32), float(w[-1])


def _fit(x: np.ndarray, lang: np.ndarray) -> list[tuple[str, str, np.ndarray, float]]:
    """(winner, loser, weights, bias) of every model; a family model has the loser ''. The last column of ``x`` is all ones."""
    langs = sorted(set(lang))
    fams = np.array([FAMILY_OF.get(c, c) for c in lang])
    models = []
    if len(set(fams)) > 1:
        for f in sorted(set(fams)):
            models.append((f, "", *_svm(x, np.where(fams == f, 1, -1).astype(np.float32))))
    for f in sorted(set(fams)):
        for a, b in combinations([c for c in langs if FAMILY_OF.get(c, c) == f], 2):
            pick = (lang == a) | (lang == b)
            models.append((a, b, *_svm(x[pick], np.where(lang[pick] == a, 1, -1).astype(np.float32))))
    return models


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
        per_language: int = PER_LANGUAGE, seed: int = 7) -> dict:
    """Fit the models on a bounded sample; returns plain arrays (a few kB per model).

    The sample: per language, the texts with the smallest seeded hashes. A
    first pass counts the labels (one column), so that a hash cut leaves little more
    than the wanted number before anything is ranked.
    """
    d = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in d.groupBy(label_col).count().collect()}
    if not counts:
        return {"langs": [], "models": []}
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    keep = F.lit(False)
    for lang, n in counts.items():
        cut = min(1.0, 1.3 * per_language / n + 20.0 / n)
        bound = int(-(2 ** 63) + cut * (2 ** 64 - 1)) if cut < 1 else 2 ** 63 - 1
        keep = keep | ((F.col(label_col) == lang) & (h <= F.lit(bound)))
    chosen = d.where(keep).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))

    def sparse(batches):
        for b in trimmed(batches):
            data, off = text_buffers(b.column(1))
            idx, val = [], []
            for i, j in byte_slices(off):
                x = _features(data[off[i]:off[j]], off[i:j + 1] - off[i])
                for row in x:
                    nz = np.flatnonzero(row)
                    idx.append(nz.astype(np.uint16).tobytes())
                    val.append(row[nz].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(idx, pa.binary()),
                                              pa.array(val, pa.binary())], ["lang", "h", "idx", "val"])

    def train(pdfs):
        import pandas as pd
        rows = pd.concat(list(pdfs)).sort_values(["lang", "h"], kind="stable")
        rows = rows.groupby("lang").head(per_language)
        if not len(rows):
            return
        x = np.zeros((len(rows), DIM + 1), np.float32)
        x[:, DIM] = 1
        for k, (i, v) in enumerate(zip(rows["idx"], rows["val"])):
            x[k, np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float32)
        m = _fit(x, rows["lang"].to_numpy())
        yield pd.DataFrame([(a, b, w.tobytes(), c) for a, b, w, c in m], columns=["a", "b", "w", "bias"])

    sample = chosen.mapInArrow(sparse, "lang string, h bigint, idx binary, val binary")
    got = sample.repartition(1).mapInPandas(train, "a string, b string, w binary, bias double").collect()
    return {"langs": sorted(counts), "models": [(r.a, r.b, bytes(r.w), r.bias) for r in got]}


def _decide(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    langs = model["langs"]
    n = len(x)
    if not langs:
        return np.full(n, "und", object), np.zeros(n)
    ms = model["models"]
    if ms:
        w = np.stack([np.frombuffer(m[2], np.float32) for m in ms], axis=1)
        z = x @ w + np.array([m[3] for m in ms], np.float32)
    squash = lambda a: 1 / (1 + np.exp(-STEEPNESS * a))
    fam = sorted({FAMILY_OF.get(c, c) for c in langs})
    pick, sure = np.zeros(n, int), np.ones(n)
    at = {m[0]: k for k, m in enumerate(ms) if not m[1]}
    if len(fam) > 1:
        zf = np.stack([z[:, at[f]] for f in fam], axis=1)
        pick = zf.argmax(axis=1)
        top = np.sort(zf, axis=1)
        sure = squash((top[:, -1] - top[:, -2]) / 2)
    out, score = np.empty(n, object), sure.astype(float)
    for f, name in enumerate(fam):
        own = [c for c in langs if FAMILY_OF.get(c, c) == name]
        rows = np.flatnonzero(pick == f)
        if len(own) == 1:
            out[rows] = own[0]
            continue
        votes, margin = np.zeros((len(rows), len(own))), np.full((len(rows), len(own)), np.inf)
        for k, (a, b, *_) in enumerate(ms):
            if b and a in own:
                i, j, s = own.index(a), own.index(b), z[rows, k]
                votes[:, i] += s >= 0
                votes[:, j] += s < 0
                margin[:, i] = np.minimum(margin[:, i], s)
                margin[:, j] = np.minimum(margin[:, j], -s)
        best = (votes + 0.5 * squash(margin)).argmax(axis=1)
        out[rows] = np.array(own, object)[best]
        score[rows] *= squash(margin[np.arange(len(rows)), best])
    return out, np.clip(score, 0, 1)


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (existing columns of these names are replaced).

    Every batch is scored where it is read; texts are cut into slices of a few
    MB, so memory stays bounded whatever a text's length.
    """
    docs = docs.drop("lang_pred", "score", "_letter")
    plain = docs.withColumn("_letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = docs.columns
    at = names.index(text_col)

    def score(batches):
        for b in trimmed(batches):
            data, off = text_buffers(b.column(at))
            letter = np.asarray(b.column(len(names)).to_numpy(zero_copy_only=False), bool)
            lang, conf = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for i, j in byte_slices(off, 2 << 20):
                for k in range(i, j, 512):  # rows of features held at once
                    m = min(j, k + 512)
                    x = _features(data[off[k]:off[m]], off[k:m + 1] - off[k])
                    lang[k:m], conf[k:m] = _decide(x, model)
            lang[~letter] = "und"
            conf[~letter | (lang == "und")] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(len(names))), pa.array(lang, pa.string()), pa.array(conf, pa.float64())],
                names=[*names, "lang_pred", "score"])

    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return plain.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Fold 0 of 5 by the CRC of the id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the rows not held out, applied to all."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(out, model).select("doc_id", "held_out", "lang_pred", "score")


MIN_SCORE = 0.25  # a decided text gets 0.5 x 0.5 at least, so beyond `und` only inconsistent votes go


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language is recognised; ``und`` and near toss-ups go. Columns stay."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that cannot clash with the added ones
    slim = predict(plain, model, f"c{docs.columns.index('text')}")
    kept = slim.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return kept.select(*plain.columns).toDF(*docs.columns)
