"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule reads a few measures of the whole text and votes good, bad or
abstains. A two-class Dawid-Skene model learns how each rule votes on good and on bad texts
by expectation-maximisation; the posterior of "good" replaces
"must pass every rule". EM sees the corpus as counts per vote pattern (at most
3^rules rows whatever the corpus); each round is one small aggregate over that
written table, and the posterior is an expression of the votes, so no row is ever joined or shuffled.

Defined cases: a null or blank text has no words (0 in every count) and is not
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import materialize
from faresight.llm.native import words

SYMBOLS = "#*$%&|<>"
FALSE_ALARM = 0.002  # a rule votes bad on at most this share of good texts: what ties the class "good" to its meaning


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures that the rules read, of every whole text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    d = d.withColumn("n_words", F.size("w").cast("bigint"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # 64-bit hashes stand for the 3-word windows of one text
    tri = F.when(F.col("n_words") > 2, F.transform(
        F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(1))),
        lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    d = d.withColumns({"tri": F.coalesce(tri, F.array().cast("array<bigint>")), "lines": lines})
    d = d.withColumn("sorted", F.when(
        F.size(F.array_distinct("tri")) < F.size("tri"),
        F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(
        F.transform("sorted", lambda x, j: F.when(
            (x["h"] == F.get("sorted", j - 1)["h"]) | (x["h"] == F.get("sorted", j + 1)["h"]), x["i"])),
        lambda i: i.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2))))
    count = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    return d.select(
        "doc_id", "n_words",
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        count("!").cast("bigint").alias("n_shouts"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_upper"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes -1 (bad), 1 (good) or 0 (abstains) of the measures."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "length": _vote(F.col("n_words") < 50, F.col("n_words") >= 80),
        "repeats": _vote(F.col("n_repeat_words") > 0.3 * n, F.col("n_repeat_words") < 0.1 * n),
        "lines": _vote((F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")), F.col("n_dup_lines") == 0),
        "symbols": _vote(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") < 0.03 * n),
        "shouting": _vote(F.col("n_shouts") > 0.1 * n, F.col("n_shouts") < 0.03 * n),
        "capitals": _vote(F.col("n_upper") > 0.3 * F.col("word_chars"), F.col("n_upper") < 0.15 * F.col("word_chars")),
        "word_length": _vote((mean < 2.0) | (mean > 12.0), (mean >= 3.0) & (mean <= 10.0)),
    }


def _posterior(names: list[str], prior: float, seen: dict) -> Column:
    """P(good | votes): seen[rule][vote] = (P(vote | good), P(vote | bad))."""
    z = F.lit(math.log(prior / (1 - prior)))
    for r in names:
        llr = {v: math.log(g / b) for v, (g, b) in seen[r].items()}
        z = z + F.when(F.col(r) == 1, llr[1]).when(F.col(r) == -1, llr[-1]).otherwise(llr[0])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(votes: DataFrame, names: list[str], rounds: int = 20, tol: float = 1e-3) -> tuple[float, dict]:
    """EM over vote patterns: (share of good texts, vote probabilities per rule and class).

    Start: a text with any bad vote is good with probability 0.2, one without
    with 0.95. Estimates are smoothed by one imagined text per vote, and no
    rule's rate of false alarms may be estimated above ``FALSE_ALARM``: without that, EM may take
    any large cluster of alike votes for a class.
    """
    t = materialize(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "quality-votes")
    p = F.when(F.least(*(F.col(r) for r in names)) < 0, F.lit(0.2)).otherwise(F.lit(0.95))
    prior, seen = 0.5, {r: {v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for r in names}
    for _ in range(rounds):
        d = t.withColumn("g", p * F.col("n")).withColumn("b", (1 - p) * F.col("n"))
        sums = [F.coalesce(F.sum(F.when(F.col(r) == v, F.col(c))), F.lit(0.0)).alias(f"{r}:{v}:{c}")
                for r in names for v in (-1, 0, 1) for c in "gb"]
        s = d.agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"), *sums).first()
        new_prior = (s["g"] + 1) / (s["g"] + s["b"] + 2)
        seen = {r: {v: tuple((s[f"{r}:{v}:{c}"] + 1) / (s[c] + 3) for c in "gb") for v in (-1, 0, 1)} for r in names}
        for r in names:
            false = min(seen[r][-1][0], FALSE_ALARM)
            spare = (1 - false) / (seen[r][0][0] + seen[r][1][0])
            seen[r] = {-1: (false, seen[r][-1][1]), **{v: (seen[r][v][0] * spare, seen[r][v][1]) for v in (0, 1)}}
        done = abs(new_prior - prior) < tol
        prior, p = new_prior, _posterior(names, new_prior, seen)
        if done:
            break
    return prior, seen


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good)."""
    m = materialize(measures(docs), "quality-measures")
    votes = rules()
    names = list(votes)
    voted = m.select("*", *(c.alias(r) for r, c in votes.items()))
    prior, seen = fit(voted, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = _posterior(names, prior, seen)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (p >= 0.5)).alias("kept"), p.alias("p_good"))
