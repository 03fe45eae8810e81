"""How much of a table a Python worker holds at once."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most: rows are texts, and each batch is held by the JVM and by a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession | None = None) -> None:
    """From now on in this session (the active one if none is given). A session that asks for smaller batches keeps them."""
    spark = spark or SparkSession.getActiveSession()
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)) if spark else ():
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        plain = re.fullmatch(r"(\d+)b?", now or "")
        if not plain or not 0 < int(plain[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
