"""Helpers the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def null_safe_key(column: str) -> Column:
    """A string that is equal exactly where the column is equal, NULL included."""
    return F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(column).cast("string")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where Spark moves the expression elsewhere."""
    return F.transform(F.array(value), body)[0]


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, safe when executors go."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_name() -> Column:
    """What a row is drawn by: its doc_id, or where that is NULL a digest of its text, so that such rows spread too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text_of())))


def uniform(seed: int, *columns: Column) -> Column:
    """A reproducible number in (0, 1) from the first 48 bits of an MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(2**48)
