"""Source mixing by weighted sampling without replacement, epoch after epoch."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.llm.common import WORD, null_safe_key, row_name, stored, text_of, uniform, unused, words_of

SYMBOLS = "#*$%&|<>!"
#: Quality weights lie between these two; the rate spreads keys evenly over pieces.
LOW, HIGH = 0.5, 1.0
RATE = (LOW * HIGH) ** 0.5


def document_quality(text: Column, size: Column) -> Column:
    """1 for text without symbols, falling to 1/2 at a symbol for every second word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, F.greatest(F.lit(LOW), HIGH - symbols / size)).otherwise(F.lit(LOW))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """Words to take from each source: `sizes` has _source, one row each, and source_size.

    Targets share the total by weight; none passes `limit` times its source, and
    what is cut goes to the others by weight. Sorted by limit per weight, the
    sources that are cut come first, so running sums give the level at which the
    rest stand. This table has a row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy("_last", "_source")) - 1
    table = (
        sizes.withColumn("_last", F.col("_source") == "0")
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * limit)
        .withColumn("_total", F.sum("source_size").over(everything))
    )
    cut = everything.orderBy(F.col("_cap") / F.col("_weight"), "_last", "_source")
    table = (
        table.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(cut.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("_weight").over(cut.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_cap") * F.col("_open") < F.col("_weight") * F.col("_left"))
    )
    table = table.withColumn("_order", F.row_number().over(cut))
    first = F.min(F.when(~F.col("_full"), F.struct("_order", (F.col("_left") / F.col("_open")).alias("at")))).over(everything)["at"]
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(first, F.lit(0.0)) * F.col("_weight"))
    return table.select(*sizes.columns, target.alias("target"))


def mixture(docs: DataFrame, keep: list[str] | None = None, seed: int = 23, piece_rows: int = 2_000, quality: Column | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and size, source_size, target and taken of each row.

    Each source gives whole epochs while its target allows; the rest of the
    target is filled by its documents in the order of -ln(u) / quality, smallest
    first, and the document that crosses the budget is cut there. `taken` counts
    words, repeats included; it is at most 3 times the size and sums to the
    rounded target of each source. Keys are cut into as many pieces as the table
    has `piece_rows` rows, sums of earlier pieces are added, and rows are dealt by
    source and piece only, so no source is ever sorted in one task.

    A NULL source is a source of its own, last in order; NULL and empty texts
    have size 0 and are never taken. Equal keys fall to doc_id, then size; rows
    equal in both are interchangeable. An empty table gives an empty result.
    Columns named size, source_size, target or taken are replaced.
    """
    text = text_of()
    docs = docs.drop("size", "source_size", "target", "taken")
    keep = docs.columns if keep is None else keep
    key, piece, src, inside, before = (unused(docs, n) for n in ("_key", "_piece", "_source", "_inside", "_before"))
    rows = docs.withColumns({src: null_safe_key("source"), "size": F.regexp_count(text, F.lit(WORD)).cast("long")})
    weight = document_quality(text, F.col("size")) if quality is None else quality
    own = dict.fromkeys(["doc_id", *keep])
    rows = stored(rows.withColumn(key, -F.log(uniform(seed, row_name())) / weight).select(*own, src, "size", key))
    sizes = rows.groupBy(F.col(src).alias("_source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes).withColumnRenamed("_source", src)
    share = 1 - F.exp(-RATE * F.col(key))
    rows = rows.withColumn(piece, F.floor(share * max(1, ceil(rows.count() / piece_rows))))
    sums = rows.groupBy(src, piece).agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy(src).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(src, piece, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before)).join(targets, src)
    inner = Window.partitionBy(src, piece).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(inside, F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, [src, piece])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(before) - F.col(inside)))
    return rows.withColumn("taken", (epochs * F.col("size") + part).cast("long")).select(*keep, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: whole copies, then the words a partial copy takes."""
    columns = docs.columns
    clashes = {c: unused(docs, f"_own_{c}") for c in columns if c.lower() in ("size", "source_size", "target", "taken")}
    docs = docs.withColumnsRenamed(clashes)
    copy, copies = unused(docs, "_copy"), unused(docs, "_copies")
    rows = mixture(docs, **options).filter("taken > 0")
    rows = rows.withColumn(copies, F.expr("taken div size + if(taken % size > 0, 1, 0)")).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    partial = F.array_join(F.slice(words_of(F.col("text")), 1, F.greatest(F.lit(1), (F.col("taken") % F.col("size")).cast("int"))), " ")
    rows = rows.withColumn("text", F.when(F.col(copy) > F.expr("taken div size"), partial).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*[F.col(clashes.get(c, c)).alias(c) for c in columns])
