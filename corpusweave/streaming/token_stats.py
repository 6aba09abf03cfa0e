"""Tokenizer statistics and filters over a stream of rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusweave.operators.statistics import tokenizer_stats
from corpusweave.operators.tokenizers import Tokenizer
from corpusweave.plans.staging import shared_path


def read_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None, **options
) -> DataFrame:
    """Files of a folder as a stream; a stream needs its schema up front."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def tokenizer_stats_stream(
    stream: DataFrame,
    columns: Sequence[str],
    tokenizers: Mapping[str, Tokenizer],
    name: str,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Keep the statistics of everything seen so far in the in-memory table ``name``.

    The state is one row of counters, so there is nothing to expire.
    """
    stats = tokenizer_stats(stream, columns, tokenizers)
    return (
        stats.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint or shared_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )


def write_stream_with_exclusions(
    judged: DataFrame, kept: str, dropped: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Write kept and dropped rows of each micro-batch to their own folders.

    A batch is written under its number, so that a repeated batch replaces itself.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.where("keep").drop("keep", "drop_reason").write.mode("overwrite").parquet(
            f"{kept}/batch={batch_id}"
        )
        batch.where(~F.col("keep")).drop("keep").write.mode("overwrite").parquet(
            f"{dropped}/batch={batch_id}"
        )

    return run_batches(judged, split, checkpoint)


def run_batches(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(fn)
        .option("checkpointLocation", checkpoint or shared_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
