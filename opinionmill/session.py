"""Session-level helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such
    a folder would not outlive the machine that wrote it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        shared = tempfile.mkdtemp(prefix="opinionmill-")
    context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_down(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the shared checkpoint folder and read it from there.

    Compressed and columnar, so it suits large tables that are read several times, column by column.  ``options`` are
    those of the Parquet files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parquet stores a value that repeats once per row group, as long as the different values of the column fit this
#: dictionary; the default of 1 MB is full after a few hundred reviews, and their text is then stored with every row.
#: A writer holds the dictionary of each column, and copies it twice when the group ends: groups end after so many rows
#: that the texts of most fill a part of it.  Where the dictionary is full, texts are held row by row, and Parquet looks
#: at their size after up to 10,000 rows if those before were short: here it looks after 100.
REPEATS = {
    "parquet.dictionary.page.size": str(16 << 20), "parquet.block.size": str(16 << 20),
    "parquet.block.row.count.limit": "50000", "parquet.page.size.row.check.max": "100",
}
#: Bounds of a repeated text would be compared with it in full for every row; nobody looks for ranges of whole texts.
NO_BOUNDS = "parquet.column.statistics.enabled#{}"


def repeats_of(*columns: str) -> dict[str, str]:
    """Settings of Parquet files in which the long texts of ``columns`` stand in many rows."""
    return REPEATS | {NO_BOUNDS.format(column): "false" for column in columns}


def hold_repeats(spark: SparkSession, *columns: str) -> None:
    """Let Parquet files that this session writes store the long texts of ``columns`` that repeat once per row group.

    For tables that repeat a text in many rows; settings that the session already has stay.
    """
    for key, value in repeats_of(*columns).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def collect_small(df: DataFrame, max_rows: int, max_bytes: int, *text_columns: str) -> list[Row]:
    """The rows of ``df``; raises if there are more than ``max_rows`` or over ``max_bytes`` of text.

    The rows are written once, measured there and read from there, so nothing larger than the limits reaches the
    driver and ``df`` is computed once.
    """
    df = cut_lineage(df)
    size = F.lit(0).cast("long")
    for column in text_columns:
        size = size + F.coalesce(F.octet_length(F.col(column)), F.lit(0))
    measured = (
        df.select(size.alias("bytes"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    if measured["rows"] > max_rows or measured["bytes"] > max_bytes:
        raise ValueError(
            f"over {max_rows} rows or {max_bytes} bytes of text: too large to travel inside the tasks; use the join"
        )
    return df.collect()


def spread(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Deal a table over ``partitions``, for a file that one task would read; 0 leaves it as it is.

    A table in one file with one row group is read by one task whatever its length.  The text is shuffled for it, so
    this is the caller's choice and not made by size.
    """
    return df.repartition(partitions, *keys) if partitions else df


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession, *folders: str) -> None:
    """Give the Python workers of this application the packages, once; the staging folder goes with the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    staging = tempfile.TemporaryDirectory(prefix="opinionmill-code-")
    _STAGED.append(staging)
    staged = os.path.join(staging.name, "code")
    for folder in (os.path.dirname(os.path.abspath(__file__)), *folders):
        target = os.path.join(staged, os.path.basename(folder))
        shutil.copytree(folder, target, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(staging.name, "opinionmill"), "zip", staged))
    _SHIPPED.add(app)


_STAGED: list[tempfile.TemporaryDirectory] = []
