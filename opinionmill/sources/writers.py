"""Writers; each is the one action of its job and writes in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import repeats_of

PREDICTION_COLUMNS = ("row_id", "input", "reference", "prediction")
OPINION_COLUMNS = (
    "review_id", "pos", "full_review", "component", "aspect", "aspect_term", "opinion_term", "sentiment",
)


def _csv(df: DataFrame, path: str) -> None:
    # An empty text stays apart from a missing one: "" is written quoted, NULL is not.
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", **options: str) -> None:
    """``options`` are those of the Parquet files."""
    if fmt == "csv":
        _csv(df, path)
    elif fmt == "parquet":
        df.write.mode("overwrite").options(**options).parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_cleaned(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The cleaned reviews."""
    write_table(df, path, fmt)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split, ``split=train`` and so on."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """``(row_id, input, reference, prediction)``."""
    write_table(df.select(*PREDICTION_COLUMNS), path, fmt)


def write_opinions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The flat opinion table; Parquet holds the text of a review once per row group, not with each component."""
    write_table(df.select(*OPINION_COLUMNS), path, fmt, **repeats_of("full_review"))


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table as JSON lines."""
    df.write.mode("overwrite").json(path)
