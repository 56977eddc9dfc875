"""Profiles of text files, kept per file and merged on demand.

Every (file, column) is one row: rows, nulls, the type that all of its values have, moments, extremes, and two sketches that can be
merged (HyperLogLog for distinct values, KLL for quantiles). The rows are stored; when files arrive, only those are read. The
profile of a whole dataset comes from the stored rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K = 400           # about 0.7 % rank error
GROUPS = 4_096        # pairs of file and column that a task holds
INTEGER = r"^[+-]?[0-9]{1,18}$"


def profile_files(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(path, column, position, dtype, row_count, null_count, n_numeric, mean, m2, min, max, hll, kll) per file and column.

    ``df`` is a scan of files (its ``_metadata.file_path`` is read); values of any type are profiled by their text. dtype: bigint if
    all values are whole numbers, double if all are numbers, else string; void without values. Moments cover the values that are
    numbers (NaN is not). One pass over the files, one shuffle of one row per task, file and column.
    """
    cols = list(columns or df.columns)
    _groups_in_memory(df.sparkSession)
    text = lambda c: F.col(c).cast("string")
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), text(c).alias("v")) for k, c in enumerate(cols)]))
    long = df.select(F.col("_metadata.file_path").alias("uri"), one.alias("s"))
    x = F.expr("try_cast(s.v AS double)")
    long = long.select("uri", "s.position", "s.v", F.when(~F.isnan(x), x).alias("x"), F.col("s.v").rlike(INTEGER).alias("whole"))
    got = long.groupBy("uri", "position").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("v").alias("n"), F.count("x").alias("n_numeric"),
        F.sum(F.col("whole").cast("bigint")).alias("n_whole"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.hll_sketch_agg("v").alias("hll"), F.kll_sketch_agg_double("x", KLL_K).alias("kll"))
    names = F.element_at(F.array(*map(F.lit, cols)), F.col("position") + 1)
    path = F.regexp_replace(F.url_decode("uri"), "^file:/+", "/").alias("path")
    return got.select(path, names.alias("column"), "position", _dtype().alias("dtype"), "row_count", (F.col("row_count") - F.col("n")).alias("null_count"),
                      "n_numeric", F.coalesce("n_whole", F.lit(0)).alias("n_whole"), "mean", "m2", "min", "max", "hll", "kll")


def _groups_in_memory(spark: SparkSession) -> None:
    """Raises, where it is lower, how many groups an aggregation with sketches holds (some 15 KB each) before it sorts its remaining
    rows. A task that reads several small files meets more than the usual 128 pairs of file and column."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    if int(spark.conf.get(key)) < GROUPS:
        spark.conf.set(key, str(GROUPS))


def _dtype():
    n = F.col("n")
    return (F.when(n == 0, "void").when(F.col("n_whole") == n, "bigint").when(F.col("n_numeric") == n, "double").otherwise("string"))


def update_profiles(spark: SparkSession, directory: str, store: str, columns: Sequence[str] | None = None) -> int:
    """Profiles the CSV files of ``directory`` that ``store`` does not hold yet (by path, size and time), and appends them; a file that has
    changed is profiled anew and its newest rows count. Returns the number of files read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(directory)
             .select(F.col("path").alias("uri"), F.regexp_replace(F.url_decode("path"), "^file:/+", "/").alias("path"),
                     F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")))
    known = _stored(spark, store)
    new = files if known is None else files.join(known.select("path", "size_bytes", "modified").distinct(), ["path", "size_bytes", "modified"], "left_anti")
    paths = [r.uri for r in new.select("uri").collect()]     # names of the files that this call reads
    if not paths:
        return 0
    rows = profile_files(spark.read.option("header", True).csv(paths), columns)
    rows.join(F.broadcast(spark.createDataFrame([(p,) for p in paths], "uri string").join(files, "uri").drop("uri")), "path").write.mode("append").parquet(store)
    return len(paths)


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":   # nothing was profiled yet
            return None
        raise


def stored_profiles(spark: SparkSession, store: str) -> DataFrame:
    """The newest rows of every file in ``store``."""
    rows = spark.read.parquet(store)
    last = rows.groupBy("path").agg(F.max("modified").alias("modified"))
    return rows.join(last, ["path", "modified"])


def merge_profiles(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(column, position, dtype, row_count, null_count, n_numeric, mean, std, min, max, approx_distinct, p25, p50, p75) of all files together,
    or of the files that agree in the columns ``by`` (which then come first; nulls are a group).

    A column that is a whole number in one file and a number in another is a double; any text makes it a string."""
    keys = [*by, "column"]
    same = [f"_{k}" for k in keys]
    totals = rows.groupBy(*[F.col(k).alias(s) for k, s in zip(keys, same)]).agg(
        F.sum("n_numeric").alias("t_n"), F.sum(F.col("mean") * F.col("n_numeric")).alias("t_s"))
    mean = F.try_divide("t_s", "t_n")
    alike = reduce(and_, [F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, same)])
    both = rows.join(F.broadcast(totals), alike)             # one row per group and column
    got = both.groupBy(*keys).agg(
        F.min("position").alias("position"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.sum("n_numeric").alias("n_numeric"), F.sum("n_whole").alias("n_whole"), F.first(mean).alias("mean"),
        F.sum(F.col("m2") + F.col("n_numeric") * (F.col("mean") - mean) * (F.col("mean") - mean)).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))
    got = got.withColumn("n", F.col("row_count") - F.col("null_count"))
    quantile = lambda q: F.when(F.col("n_numeric") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(q)))
    return got.select(*keys, "position", _dtype().alias("dtype"), "row_count", "null_count", "n_numeric", "mean", std(), "min", "max",
                      F.hll_sketch_estimate("hll").alias("approx_distinct"), *[quantile(q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)])


def std():
    """Sample standard deviation from the sum of squared deviations."""
    return F.sqrt(F.try_divide(F.col("m2"), F.when(F.col("n_numeric") > 1, F.col("n_numeric") - 1))).alias("std")
