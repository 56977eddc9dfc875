"""Incremental (micro-batch) ingest of CSV files into a Parquet table.

``readStream`` over a folder; ``maxFilesPerTrigger`` and ``maxBytesPerTrigger`` bound what a micro-batch admits;
``trigger(availableNow=True)`` processes everything that is there and stops. A file larger than the byte bound is a batch of its own,
so batches are also cut in rows: every output file is a chunk of at most ``max_rows`` rows, written as it streams by.
``foreachBatch`` writes each batch to its own ``batch_id=<n>`` partition with overwrite, so a retried batch (after an
executor or driver failure; progress lives in the checkpoint folder) replaces its own output instead of duplicating it, and
a ledger gets its row count, its chunks and its largest chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.schema import CHUNK_SIZE


def ingest_csv_stream(spark: SparkSession, source_dir: str, schema: T.StructType, table_path: str,
                      checkpoint: str, max_files_per_trigger: int | None = 1, transform=None, max_bytes_per_trigger: int | None = None,
                      max_rows: int = CHUNK_SIZE) -> dict:
    """Run the stream to completion; returns the table and ledger paths. One of the two admission bounds holds: bytes if
    given (at least one file), else files."""
    ledger_path = table_path.rstrip("/") + "_ledger"
    bound = ("maxBytesPerTrigger", max_bytes_per_trigger) if max_bytes_per_trigger else ("maxFilesPerTrigger", max_files_per_trigger or 1000)
    stream = spark.readStream.schema(schema).option("header", True).option(*bound).csv(source_dir)
    if transform is not None:
        stream = transform(stream)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{table_path}/batch_id={batch_id}")
        written = spark.read.parquet(f"{table_path}/batch_id={batch_id}")
        chunks = written.groupBy(F.col("_metadata.file_path").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
        (chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("n_chunks"), F.max("n").alias("largest_chunk"))
                .select(F.lit(batch_id).cast("bigint").alias("batch_id"), "rows",
                        F.lit(len(written.columns)).alias("n_columns"), "n_chunks", "largest_chunk")
                .write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}"))

    q = (stream.writeStream.foreachBatch(write_batch)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return {"table": table_path, "ledger": ledger_path}
