"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import stored, text_of


def content_classes(base: DataFrame, salts: int) -> DataFrame:
    """One row per text: local winners, then winners per salt, then one winner.

    Spark's map-side half of the first aggregate is the local pass, so a task
    sends one row per text however often the text occurs in it. The salt is the
    number of the task; a text held by every task meets in `salts` reducers
    first. Each stage groups by digest and whole text.
    """
    salted = (
        base.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("rows"))
    )
    return salted.groupBy("digest", "body").agg(F.max("top").alias("keep_id"), F.sum("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, digest: Column | None = None, salts: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    Texts are equal when they are identical; NULL counts as empty, so NULL and
    empty texts form one group. The row with the largest doc_id stays; a NULL
    doc_id is smaller than any other and wins only where all are NULL. Of rows
    with the same doc_id and text one stays. Extra columns are ignored. An empty
    table gives an empty result.

    `digest` may be any function of the text column; it only speeds up the
    comparison. While each digest has one text, rows find their group by digest;
    otherwise they find it by digest and text.
    """
    body = text_of()
    sha = F.sha2(body, 256)
    base = docs.select("doc_id", body.alias("body"), sha.alias("text_sha256"), (sha if digest is None else digest).alias("digest"))
    classes = content_classes(base, salts)
    light = stored(classes.select("digest", "keep_id", "group_size"))
    if light.groupBy("digest").count().filter("count > 1").isEmpty():
        key, classes = ["digest"], light
    else:
        key = ["digest", "body"]
    rows = base.groupBy("doc_id", "text_sha256", *key).agg(F.count(F.lit(1)).alias("copies"))
    return (
        rows.join(classes, key)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
