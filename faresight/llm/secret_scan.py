"""Secret scan: pattern rules plus sliding-window Shannon entropy, in DataFrame expressions only.

Rules: ``assign`` (a credential word, a separator and a value of 6 or more
characters), ``access`` (``AKIA`` keys) and ``hex`` (24 or more lower-case hex
digits). Beside them candidate strings (runs of 20 or more characters of the
base-64 alphabets) are read through a window of 20 characters: one step adds the
entering character's count and takes the leaving one's off, so the entropy is updated, never recounted.
A candidate whose window reaches the threshold of its character class
adds a span ``entropy`` from its first to its last such window, unless the
allow-list knows it as harmless. Stretches known as harmless (examples, alphabets) end a candidate, so a
key joined to one keeps its span. Rule spans always stay.

Everything happens in the row: no shuffle, no Python. Rows without any
candidate skip the work. A null or empty text has no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faresight.llm.native import matches

# The rules' patterns.
_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Character class of a candidate (first that matches it whole) and the entropy a window of it must reach (bits).
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("upper", r"^[A-Z0-9]+$", 3.5), ("base64", r"^.*$", 3.8)]
# Candidates known as harmless: nothing but letters and joints (words, names; not letters whose case changes as in a
# random key), nothing but digits, UUIDs.
ALLOW = [r"^(?!.*[a-z][A-Z](?![a-z]{2}))[A-Za-z+/_=-]*$", r"^[0-9+/_=-]*$",
         r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"]
# Stretches known as harmless wherever they stand: documentation examples, alphabets from their start (longest first).
# No window may touch one; what stands beside it is read as if it ended there.
KNOWN = ["EXAMPLE", "example", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnop", "ABCDEFGHIJKLMNOP"]
STRETCHES = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
             *(x[:k] for k in range(26, 16, -1) for x in (ALPHABET[:26], ALPHABET[26:52])), *reversed(KNOWN)]

_PLOGP = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 2)]


def _window_span(text: Column, threshold: Column) -> Column:
    """struct<lo,hi> from the first to the last window whose entropy reaches the threshold (-1 if none)."""
    chars = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    plogp = F.array(*[F.lit(x) for x in _PLOGP])
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("last"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def step(acc, c):
        full = acc["i"] >= WINDOW
        out = F.when(full, F.get(acc["last"], F.lit(0))).otherwise(F.lit(-1))
        a = F.get(acc["n"], c)
        # the leaving character's count, with the entering one already in it
        b = F.when(full, F.get(acc["n"], out) + F.when(out == c, 1).otherwise(0))
        s = (acc["s"] + F.get(plogp, a + 1) - F.get(plogp, a)
             + F.coalesce(F.get(plogp, b - 1) - F.get(plogp, b), F.lit(0.0)))
        n = F.transform(acc["n"], lambda v, j: v + F.when(j == c, 1).otherwise(0) - F.when(j == out, 1).otherwise(0))
        last = F.concat(F.when(full, F.slice(acc["last"], 2, WINDOW - 1)).otherwise(acc["last"]), F.array(c))
        hit = (acc["i"] >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - s / WINDOW >= threshold)
        return F.struct(
            n.alias("n"), s.alias("s"), (acc["i"] + 1).alias("i"), last.alias("last"),
            F.when(hit & (acc["lo"] < 0), acc["i"] - (WINDOW - 1)).otherwise(acc["lo"]).alias("lo"),
            F.when(hit, acc["i"] + 1).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(chars, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _masked(text: Column) -> Column:
    """The text, of the same length, with the known stretches in characters that no candidate holds."""
    some, out = F.lit(False), text
    for x in KNOWN:
        some = some | F.contains(text, F.lit(x))
    for x in STRETCHES:
        out = F.replace(out, F.lit(x), F.lit(" " * len(x)))
    return F.when(some, out).otherwise(text)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), m["e"].alias("e")))


def _entropy_spans(found: Column) -> Column:
    def judge(m):
        limit = F.lit(CLASSES[-1][2])
        for _, whole, bits in reversed(CLASSES[:-1]):
            limit = F.when(m["t"].rlike(whole), F.lit(bits)).otherwise(limit)
        return F.struct(m["s"].alias("s"), _window_span(m["t"], limit).alias("w"))

    def strange(m):
        known = F.lit(False)
        for p in ALLOW:
            known = known | m["t"].rlike(p)
        return ~known

    judged = F.filter(F.transform(F.filter(found, strange), judge), lambda m: m["w"]["lo"] >= 0)
    return F.transform(judged, lambda m: F.struct(
        (m["s"] + m["w"]["lo"]).alias("s"), F.lit(KINDS.index("entropy")).alias("k"),
        (m["s"] + m["w"]["hi"]).alias("e")))


_SPAN = "array<struct<s:int,k:int,e:int>>"


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (rule spans) and ``_all`` (all spans): array<struct<s,k,e>> by start, then kind.

    Names of ``docs`` that start with an underscore are reserved; ``redact`` and ``scan`` take any.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(_SPAN)
    d = docs.withColumn("_t", t).withColumn("_m", _masked(F.col("_t")))
    t, m = F.col("_t"), F.col("_m")
    d = d.withColumns({
        "_a": F.when(t.rlike(ASSIGN), F.filter(
            matches(t, ASSIGN, 2), lambda m: F.length(m["t"]) >= 6)),
        "_k": F.when(t.rlike(ACCESS), matches(t, ACCESS)),
        "_h": F.when(t.rlike(HEX), matches(t, HEX)),
        "_c": F.when(m.rlike(CANDIDATE), matches(m, CANDIDATE)),
    })
    d = d.withColumn("_base", F.array_sort(F.concat(
        *[F.coalesce(_spans(F.col(c), k).cast(_SPAN), none) for c, k in (("_a", "assign"), ("_k", "access"), ("_h", "hex"))])))
    d = d.withColumn("_more", F.coalesce(_entropy_spans(F.col("_c")).cast(_SPAN), none))
    d = d.withColumn("_all", F.when(F.size("_more") > 0, F.array_sort(F.concat("_base", "_more"))).otherwise(F.col("_base")))
    return d.drop("_t", "_m", "_a", "_k", "_h", "_c", "_more")


def _joined(col: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(col), lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``."""
    d = with_spans(docs.select("doc_id", "text"))

    def count(kind):
        k = KINDS.index(kind)
        return F.size(F.filter("_base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{kind}")

    return d.select("doc_id", count("assign"), count("access"), count("hex"),
                    F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans by one); all rows and columns stay.

    ``n_chars``, where there is one, follows the new text. Null and empty texts, repeated rows and rows without
    a span come out as they are, an empty table empty; other columns may have any names.
    """
    read = ("text", "n_chars")  # the others get names that cannot clash with the added ones
    names = [c if c in read else f"c{i}" for i, c in enumerate(docs.columns)]
    d = with_spans(docs.toDF(*names))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        return F.when(x["e"] <= acc["at"], acc).when(x["s"] < acc["at"], F.struct(
            x["e"].alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                x["e"].alias("at"),
                F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)).alias("out")))

    clean = F.aggregate(F.col("_all"), start, step,
                        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    d = d.withColumn("text", F.when(F.size("_all") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(F.size("_all") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return d.select(*names).toDF(*docs.columns)
