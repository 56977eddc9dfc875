"""Mixing sources to target weights by capped water-filling, in DataFrame expressions only.

Every source gets a share of the mix by its weight, at most ``max_epochs`` times its
own size; what is cut off goes to the others by weight until none is above its
cap. That fixed point is a water level L with target_i = min(cap_i, L * weight_i):
sources sorted by cap_i / weight_i fill up in that order, so one running sum
over the sources (a table as small as their number) finds it.

A source's target is met by whole repetitions of all its documents and a
fractional one: its documents in the order of a seeded hash, until the target is
reached; the document at the cut gives its first words only, so the sum is exact to
half a word. The order is never a sort of a whole source: documents fall into
buckets by that hash, bucket totals are summed first, and only within a bucket are rows ranked.

Defined cases: a null text has size 0, null sources form one source (last), a corpus
without words gives targets of 0, equal rows get equal or interchangeable shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faresight.llm.common import materialize
from faresight.llm.native import word_count, words

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"


def water_fill(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET,
               max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with ``weight`` and ``target``; weights repeat over sources by code point, null last."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("turn", F.row_number().over(fill))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget))
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that the level does not fill to its cap sets it
    s = s.withColumn("open", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("turn", "level")))
    level = F.min("open").over(every)["level"]
    return s.select("source", "source_size", "weight",
                    F.when(level.isNull() | (level * F.col("weight") > F.col("cap")), F.col("cap"))
                    .otherwise(level * F.col("weight")).alias("target"))


def _order(seed: str) -> Column:
    """The seeded hash that documents are taken by; its first three digits are the bucket."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _cuts(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source: source_size, target, whole epochs, words of the fractional one; per (source, bucket): words before."""
    by_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    total = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    sources = water_fill(total).withColumn("epochs", epochs.cast("bigint"))
    sources = materialize(sources.select(
        F.col("source").alias("s_source"), "source_size", "target", "epochs",
        (F.floor(F.col("target") + 0.5).cast("bigint") - F.col("epochs") * F.col("source_size")).alias("rest")),
        "mix-sources")
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = by_bucket.select("source", "bucket", "bucket_size",
                               F.coalesce(F.sum("bucket_size").over(below), F.lit(0)).alias("below"))
    return sources, buckets.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).select(
        "s_source", F.col("bucket").alias("s_bucket"), "bucket_size", "below", "source_size", "target", "epochs", "rest")


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("h"))
                       .withColumn("bucket", F.substring("h", 1, 3)), "mix-sizes")


def _parts(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, h, bucket) with the words that the fractional repetition takes of each."""
    d = rows.join(buckets, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    inside = (Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    done = F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return d.withColumn("part", F.least(F.greatest(F.col("rest") - done, F.lit(0)), F.col("size")).cast("bigint"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs`` (columns doc_id, text, source are read)."""
    base = _sizes(docs, seed)
    _, buckets = _cuts(base)
    return _parts(base, buckets).select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("bigint").alias("taken"))


def repeat_by_plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: whole repetitions, then the fractional one.

    A document cut by the fraction comes with its first words (joined by
    blanks) and its own n_chars. Columns stay, whatever the others are named. Texts are not shuffled: whole
    repetitions and buckets clear of the cut follow from the source alone; only the bucket at
    each source's cut (about 1 row in 4,096) is ranked.
    """
    given = docs.columns
    read = ("doc_id", "text", "source", "n_chars")  # the others get names that cannot clash with the added ones
    docs = docs.toDF(*[c if c in read else f"c{i}" for i, c in enumerate(given)])
    base = _sizes(docs, seed)
    sources, buckets = _cuts(base)
    at_cut = materialize(buckets.where("below < rest and rest < below + bucket_size"), "mix-cuts")
    cut = at_cut.select(F.col("s_source").alias("c_source"), F.col("s_bucket").alias("c_bucket"))
    # the bucket before which the fraction takes all; sources without a cut take nothing or everything
    edge = sources.join(cut, F.col("s_source").eqNullSafe(F.col("c_source")), "left").select(
        "s_source", "epochs", "rest", "source_size", "c_bucket")
    full = buckets.where("bucket_size > 0 and below + bucket_size <= rest").groupBy("s_source").agg(
        F.max("s_bucket").alias("last_full")).withColumnRenamed("s_source", "f_source")
    edge = materialize(edge.join(full, F.col("s_source").eqNullSafe(F.col("f_source")), "left").select(
        F.col("s_source").alias("_s"), F.col("epochs").alias("_epochs"), F.col("c_bucket").alias("_cut"),
        F.col("last_full").alias("_full")), "mix-edges")
    d = docs.withColumn("_bucket", F.substring(_order(seed), 1, 3))
    d = d.join(edge, F.col("source").eqNullSafe(F.col("_s")))
    clear = F.coalesce(F.col("_bucket") <= F.col("_full"), F.lit(False))
    times = F.col("_epochs") + F.when(clear, 1).otherwise(0)
    whole = d.where(times > 0).withColumn("_r", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)
    # rows at a cut, matched with their parts by rank among rows of equal id and size
    near = d.where(F.col("_bucket") == F.col("_cut")).withColumn("_words", words(F.col("text")))
    near = near.withColumn("_size", F.size("_words"))
    same = Window.partitionBy("doc_id", "source", "_size").orderBy("text")
    near = near.withColumn("_n", F.row_number().over(same))
    parts = _parts(base.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
                   .select("doc_id", "source", "size", "h", "bucket"), at_cut).where("part > 0")
    rank = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("part"))
    parts = parts.select(F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("size").alias("_p_size"),
                         F.col("part").alias("_part"), F.row_number().over(rank).alias("_p_n"))
    got = near.join(parts, F.col("doc_id").eqNullSafe(F.col("_p_id")) & F.col("source").eqNullSafe(F.col("_p_source"))
                    & (F.col("_size") == F.col("_p_size")) & (F.col("_n") == F.col("_p_n")))
    short = F.col("_part") < F.col("_size")
    got = got.withColumn("text", F.when(short, F.array_join(F.slice("_words", F.lit(1), F.col("_part").cast("int")), " "))
                         .otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return whole.unionByName(got.select(*docs.columns)).toDF(*given)


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s),
l AS (
  SELECT *, row_number() OVER f AS turn,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, source IS NULL, source)),
v AS (SELECT arg_min(level, turn) AS level FROM l WHERE level <= cap / weight),
t AS (
  SELECT w.source, source_size,
         CASE WHEN v.level IS NULL OR v.level * weight > cap THEN cap ELSE v.level * weight END AS target
  FROM w, v),
e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS epochs FROM t),
c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
         (floor(e.target + 0.5)::BIGINT - e.epochs * e.source_size)
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(open, 0), size))::BIGINT AS taken
FROM c
"""
