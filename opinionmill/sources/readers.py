"""Readers for raw reviews, annotated reviews, splits, predictions and labelled quadruples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip_space
from ..operators.cleaning import require_columns

ANNOTATED_COLUMNS = (
    "Review ID",
    "Full review",
    "Component sentence",
    "Aspect Category",
    "Aspect Terms",
    "Opinion Terms",
    "Polarity Sentiment",
)

# The cell texts that a CSV of reviews uses for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", multi_line: bool = True) -> DataFrame:
    """A CSV with a header and quoted cells; every column is a string.

    The header names the columns, so types are not inferred and the data is read
    once.  With ``multi_line`` a cell may span lines and each file is one task;
    without it large files are split.
    """
    try:
        reader = spark.read.option("header", True).option("multiLine", multi_line)
        return reader.option("quote", '"').option("escape", '"').option("encoding", encoding).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"input not found: {path}") from error
        raise


def missing_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Turn the missing-value tokens of string columns into NULL."""
    return df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")) for c in columns or df.columns}
    )


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Number rows in file order.  Prefer a key of the source where there is one."""
    return df.withColumn(out, F.monotonically_increasing_id())


def read_raw_reviews(
    spark: SparkSession,
    path: str,
    text_col: str = "review_text",
    id_col: str | None = None,
    encoding: str = "utf-8",
    multi_line: bool = True,
) -> DataFrame:
    """``(row_id, review_text)``; other columns, such as a leading index, are dropped.  Ids of a file stay texts."""
    df = require_columns(read_csv(spark, path, encoding, multi_line), text_col, *([id_col] if id_col else []))
    if id_col:
        return df.select(F.col(id_col).alias("row_id"), F.col(text_col))
    return with_row_id(df).select("row_id", text_col)


def read_annotated(
    spark: SparkSession, path: str, encoding: str = "utf-8", multi_line: bool = True
) -> DataFrame:
    """The seven annotation columns and ``pos``, the order of the rows."""
    df = require_columns(read_csv(spark, path, encoding, multi_line), *ANNOTATED_COLUMNS)
    df = df.select(*[F.col(f"`{c}`") for c in ANNOTATED_COLUMNS])
    return with_row_id(missing_to_null(df, *ANNOTATED_COLUMNS), "pos")


def read_reviews(
    spark: SparkSession,
    path: str,
    text_col: str = "review",
    id_col: str | None = None,
    encoding: str = "utf-8",
    multi_line: bool = True,
) -> DataFrame:
    """``(review_id, review)`` for prediction; a missing review is read as empty.  Ids of a file stay texts."""
    df = require_columns(read_csv(spark, path, encoding, multi_line), text_col, *([id_col] if id_col else []))
    df = with_row_id(df, "review_id") if id_col is None else df.withColumn("review_id", F.col(id_col))
    return fill_reviews(df.select("review_id", F.col(text_col).alias("review")))


def fill_reviews(df: DataFrame, text_col: str = "review") -> DataFrame:
    return df.fillna("", [text_col])


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The split table, or one split: only the files of that split are read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def quad_lines(lines: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``sentence####[[term, category, sentiment, opinion], ...]`` lines as one row per quadruple.

    No line is lost: one without quadruples gives a row without them, ``bad`` if its label can't be read.
    """
    parts = F.split(F.col(value_col), "####", 2)
    quads = F.from_json(F.get(parts, F.lit(1)), "array<array<string>>")
    # Read once per line: what stands beside a generator would be computed for every row that it makes.
    read = lines.select(*keep, strip_space(F.get(parts, F.lit(0))).alias("sentence"), quads.alias("quads"))
    return read.select(
        *keep, "sentence", F.col("quads").isNull().alias("bad"), F.posexplode_outer("quads").alias("pos", "q")
    ).select(
        *keep,
        "sentence",
        "pos",
        F.get("q", F.lit(0)).alias("term"),
        F.get("q", F.lit(1)).alias("aspect"),
        F.get("q", F.lit(2)).alias("sentiment"),
        F.get("q", F.lit(3)).alias("opinion"),
        "bad",
    )


def read_quad_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file of labelled lines: ``(line_id, sentence, pos, term, aspect, sentiment, opinion, bad)``."""
    return quad_lines(with_row_id(spark.read.text(path), "line_id"), keep=("line_id",))


def read_predictions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A stored prediction table ``(row_id, input, reference, prediction)``, all strings.

    Parquet is split over tasks; a CSV, whose cells may span lines, is one task per file.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).withColumn("row_id", F.col("row_id").cast("string"))
    columns = ("row_id", "input", "reference", "prediction")
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    # With a null token that no cell holds, a quoted empty cell stays an empty text.
    return reader.option("nullValue", "\0").schema(schema).csv(path)


def fingerprint(df: DataFrame) -> str:
    """An order-free digest of all rows: two numbers, combined in the tasks."""
    rows = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0))).first()
    return f"{rows[0]}-{rows[1]}"


def read_or_build(
    spark: SparkSession, root: str, task: str, model_type: str, build: Callable[[], DataFrame], *inputs: object
) -> DataFrame:
    """A Parquet table kept per task, model type and ``inputs``: read if complete, else built and written.

    ``inputs`` is all that the table depends on (sizes, lengths, :func:`fingerprint` of the rows): with other values
    it is another table.
    """
    key = hashlib.sha256(repr(inputs).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{task}/{model_type}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # A missing folder, or one left by a job that was stopped before it committed.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
