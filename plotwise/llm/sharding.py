"""Shards by proportional stratified interleaving."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.llm.common import null_safe_key, row_name, stored, text_of, uniform


def ranked(df: DataFrame, piece: list[str], order: list, group: list[str], name: str) -> DataFrame:
    """0-based rank within `group` along `piece`, then `order`, and the rows of the group as `<name>_of`.

    Rows are numbered inside (group, piece) and moved on by the counts of the
    pieces before. They are dealt by group and piece only, so no group is ever
    sorted in one task.
    """
    keys = [*group, *piece]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(offsets, keys).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def interleaved_shards(docs: DataFrame, shards: int = 24, seed: int = 17, piece_rows: int = 2_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    Rows of a source are shuffled by a seeded hash and numbered; all rows are
    then ordered by (rank + 1/2) / rows of the source and cut into shards, so
    each shard, and any stretch of one, holds the sources in their overall
    proportion. Law `rows`: shard counts are at most one apart. Equal texts are
    not kept together; copies of a hot text spread like other rows.

    A NULL source is a source of its own, last; a NULL text has 0 bytes; a NULL
    doc_id is replaced by a digest of the text. Ties fall to doc_id, then size and CRC; rows
    equal in all of them are interchangeable. With fewer rows than shards some
    shards stay empty; an empty table gives an empty result.
    """
    text = text_of()
    rows = docs.select(
        "doc_id",
        null_safe_key("source").alias("_source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        uniform(seed, row_name()).alias("_u"),
    )
    rows = stored(rows)
    total = rows.count()
    pieces = max(1, ceil(total / piece_rows))
    rows = rows.withColumn("_piece", F.floor(F.col("_u") * pieces))
    rows = ranked(rows, ["_piece"], ["_u", "doc_id", "size", "text_crc32"], ["_source"], "_rank")
    share = (F.col("_rank") + 0.5) / F.col("_rank_of")
    rows = (
        rows.drop("_piece")
        .withColumn("_share", share)
        .withColumn("_piece", F.least(F.floor(F.col("_share") * pieces), F.lit(pieces - 1)))
        .withColumn("_all", F.lit(0))
    )
    rows = ranked(rows, ["_piece"], ["_share", F.desc("_source"), "_rank"], ["_all"], "_at")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.expr(f"_at * {shards} div {max(total, 1)}").cast("int").alias("shard"),
        F.expr(f"_at - (_at * {shards} div {max(total, 1)} * {total} + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
