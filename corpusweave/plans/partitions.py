"""Partition counts that follow the input and the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Input per core below which a scan leaves cores idle (the default size of a scan split).
BYTES_PER_CORE = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when the input is too small to occupy them.

    That is so when there are fewer files than cores and less than a scan split per core, so
    the one shuffle before CPU-heavy row-wise work moves little.  Larger input is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # The list of files stays in the JVM; only its length and the planned size are asked for.
    files = len(df._jdf.inputFiles())
    if not 0 < files < cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(2 * cores) if size < cores * BYTES_PER_CORE else df
