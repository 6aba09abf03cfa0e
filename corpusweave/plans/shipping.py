"""Make the package importable inside Python workers, and bound what they are sent at a time."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of rows that a Python worker is sent at a time, where the application does not say.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the memory of Python workers depend on bytes, not on how long the rows are.

    Results do not depend on it.  A value given with the application stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application (as ``--py-files`` would), and
    bound the batches of the session."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="corpusweave-py-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
