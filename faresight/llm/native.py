"""Text measures as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faresight.llm.common import SPACE

BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text in order (null or blank text: none)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE, -1))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s,e,t>>: start, end (code points) and text of a group of every leftmost non-overlapping match.

    The pieces between the matches and the matches themselves add up to the
    positions, so nothing is searched twice. The pattern must not match the
    empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.split(text, pattern, -1)
    rows = F.arrays_zip(parts.alias("gap"), hits.alias("hit"), texts.alias("t"))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    return F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, r: F.when(r["hit"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + F.length(r["gap"]) + F.length(r["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(r["gap"])).alias("s"),
                (acc["at"] + F.length(r["gap"]) + F.length(r["hit"])).alias("e"),
                r["t"].alias("t")))).alias("out"))),
        lambda acc: acc["out"])
