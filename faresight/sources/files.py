"""File sources and sinks: CSV / Parquet / JSON reports / file manifests.

Reads declare a schema (inference only on request), so scans are one pass
with column pruning. Writes never funnel through one task unless the
output is a small aggregate (``single_file``).
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.session import scratch_path


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None,
             header: bool = True, recursive: bool = False) -> DataFrame:
    """Header CSV; declared ``schema`` or inferred types (bigint/double/string)."""
    r = spark.read.option("header", header)
    if recursive:
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.csv,*.csv.gz}")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(list(paths) if not isinstance(paths, str) else paths)


# How a cell reads, narrowest first; a column takes the widest of its cells (whole numbers beyond 18 digits stay strings).
WHOLE = r"^[+-]?\d{1,18}$"
REAL = r"^([+-]?(\d{1,18}(\.\d*)?|\.\d+|\d+\.\d*)([eE][+-]?\d+)?|NaN|[+-]?Inf(inity)?)$"
WIDENING = ["string", "bigint", "double", "string"]  # no cell, whole numbers, numbers, anything


def concat_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None,
                 header: bool = True) -> DataFrame:
    """Vertical concatenation of several CSV inputs.

    With a declared schema it is a single scan. Without one, files may hold
    different columns in different orders: columns are matched by name
    (without header lines by position), those a file lacks are NULL, and each gets the narrowest of
    bigint, double and string that holds all its cells. One plan reads all files, however many:
    a small written table says where each file keeps each column.
    """
    ordered = sorted(paths)
    if schema is not None:
        return read_csv(spark, ordered, schema, header)
    columns, places, width = _layouts(spark, ordered, header)
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    cells = T.StructType([T.StructField(f"p{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(cells).option("header", header).csv(ordered)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.array(*cells.names).alias("cells"))
    rows = raw.join(places, "path").select(*[F.get("cells", F.get("at", F.lit(i))).alias(f"c{i}") for i in range(len(columns))])
    kinds = [F.max(F.when(F.col(c).isNull(), 0).when(F.col(c).rlike(WHOLE), 1).when(F.col(c).rlike(REAL), 2).otherwise(3)).alias(c)
             for c in rows.columns]
    widest = rows.agg(*kinds).first()
    return rows.select(*[F.col(c).cast(WIDENING[widest[c] or 0]) for c in rows.columns]).toDF(*columns)


def _layouts(spark: SparkSession, paths: Sequence[str], header: bool) -> tuple[list[str], DataFrame, int]:
    """(all columns, a written table of each file's path and the place of every column in it or -1, widest file).

    A file's layout is its first line that is not blank; only distinct layouts come to the driver, which has
    to know the columns of the result."""
    lines = spark.read.text(paths).where((F.col("_metadata.file_block_start") == 0) & (F.btrim("value") != ""))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("line"))
    heads = scratch_path(spark, "csv-heads")
    lines.groupBy("path").agg(F.min_by("value", "line").alias("head")).write.parquet(heads)
    heads = spark.read.parquet(heads)
    layouts = {r.head: _names(r.head, header) for r in heads.groupBy("head").agg(F.min("path").alias("path")).orderBy("path").collect()}
    columns = list(dict.fromkeys(c for names in layouts.values() for c in names))
    known = spark.createDataFrame([(head, [names.index(c) if c in names else -1 for c in columns]) for head, names in layouts.items()],
                                  "head string, at array<int>")
    places = scratch_path(spark, "csv-places")
    heads.join(known, "head").select("path", "at").write.parquet(places)
    return columns, spark.read.parquet(places), max(map(len, layouts.values()), default=0)


def _names(head: str, header: bool) -> list[str]:
    """Column names of a header line; a missing one is named by its place, a repeated one gets its place appended."""
    cells = next(csv.reader([head.lstrip("\ufeff")]))
    if not header:
        return [f"_c{i}" for i in range(len(cells))]
    lower = [c.lower() for c in cells]
    return [(c + str(i) if lower.count(c.lower()) > 1 else c) or f"_c{i}" for i, c in enumerate(cells)]


def row_count(df: DataFrame) -> DataFrame:
    """One-row count (Parquet answers it from footers)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False,
              compression: str = "none") -> str:
    """Header CSV. ``compression="gzip"`` takes about a fifth of the disk; a packed file is read by one task, so the
    table must be in many parts."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path, compression=compression)
    return path


def write_csv_folders(df: DataFrame, path: str, by: str, compression: str = "none", writers: int = 64) -> str:
    """Header CSV in a folder per value of ``by``. A task keeps a file open for each value it meets, so its rows need no
    sorting; rows of further values than ``writers`` are sorted."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(writers))
    try:
        df.write.partitionBy(by).option("header", True).csv(path, compression=compression)
    finally:
        conf.set(key, before)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> str:
    """Snappy Parquet; ``mode="ignore"`` skips when the output already exists."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_json_maps(df: DataFrame, path: str, name_col: str, key_col: str, value_col: str,
                    suffix: str = "") -> str:
    """One JSON object file per ``name_col`` value ``{key: value, ...}``,
    written by Spark as partitioned text (``<path>/<name_col>=<name>/``)."""
    maps = df.groupBy(name_col).agg(F.to_json(F.map_from_entries(
        F.collect_list(F.struct(F.col(key_col).cast("string"), F.col(value_col).cast("double"))))).alias("value"))
    maps.write.mode("overwrite").partitionBy(name_col).text(path)
    return path


def read_json_maps(spark: SparkSession, path: str, name_col: str = "model", key_col: str = "feature",
                   value_col: str = "importance") -> DataFrame:
    """Read flat ``{key: number}`` JSON files back to long form
    ``(name, key, value)``; the name comes from the file's folder or stem."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_p"))
    name = F.coalesce(F.nullif(F.regexp_extract("_p", rf"{name_col}=([^/]+)/", 1), F.lit("")),
                      F.regexp_extract("_p", r"([^/]+?)(_feature_importance|_metrics)?\.json$", 1))
    m = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
    return raw.select(name.alias(name_col), F.explode(m).alias(key_col, value_col))


def file_manifest(spark: SparkSession, directory: str, dataset: str | None = None) -> DataFrame:
    """Dataset manifest from file metadata only (the ``content`` column is never read): a row per file, and one
    with a NULL path for all of them."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
                  .select("path", "length", "modificationTime"))
    both = files.rollup("path").agg(F.count(F.lit(1)).alias("total_files"), F.sum("length").alias("total_size_bytes"),
                                    F.max("modificationTime").alias("latest_modified"))
    return both.select(F.lit(dataset or directory.rstrip("/").split("/")[-1]).alias("dataset"), "path",
                       F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "total_files", "total_size_bytes",
                       (F.col("total_size_bytes") / F.lit(1024.0 * 1024.0)).alias("total_size_mb"),
                       "latest_modified", F.current_timestamp().alias("created_at"))


def file_summary(df: DataFrame, directory: str) -> DataFrame:
    """Per input file: path, name, size (bytes, MB), row count and column count.

    Rows come from one aggregate over the scan grouped by the hidden
    ``_metadata.file_path`` column; sizes from file metadata (content never
    read). Both are keyed by the path (files of one name in several folders
    stay apart) and joined."""
    spark = df.sparkSession
    plain = lambda c: F.regexp_replace(F.url_decode(c), "^file:/+", "/")  # noqa: E731  both readers' spelling of a path
    rows = df.groupBy(plain(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("row_count"))
    sizes = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
                  .select(plain(F.col("path")).alias("path"), F.col("length").alias("size_bytes")))
    return (rows.join(sizes, "path", "left")
                .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "size_bytes",
                        F.round(F.col("size_bytes") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"),
                        "row_count", F.lit(len(df.columns)).alias("column_count")))
