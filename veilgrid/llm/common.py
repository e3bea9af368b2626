"""What the corpus operators share: scratch tables in the cluster's shared folder, and batch helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset and Spark runs in this process alone (tests), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veilgrid-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to a Python worker at once; the session's setting holds where it is smaller.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, after bounding the session's Arrow batches: texts are long, and the default of 10,000 rows is a lot of them."""
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        size = int(re.match(r"-?\d+", now).group()) if now else 0
        if size <= 0 or size > most or not now.lstrip("-").isdigit():
            conf.set(key, str(most))
    return docs


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes of text; a longer text by itself. Views, not copies."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)] if len(batch) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
