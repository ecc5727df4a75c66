"""Secrets: patterns propose, ownership across the corpus decides which look live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import null_safe_key, stored, text_of
from plotwise.llm.spans import joined, with_spans

# fixed values -----------------------------------------------------------------
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "token"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "token": r"(?<![A-Za-z0-9_])(?:gh[oprsu]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_live_[A-Za-z0-9]{16,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++)",
}
VALUE = r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# ------------------------------------------------------------------------------


def candidates(docs: DataFrame) -> DataFrame:
    """`docs` and `_spans`: (start, kind, end, hash of the value), by start, then kind as listed."""
    rows = docs.withColumn("_body", text_of())
    body = F.col("_body")
    sign = F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))
    needs = {"assign": sign, "access": F.contains(body, F.lit("AKIA")), "token": body.rlike("gh[oprsu]_|xox[abprs]-|[rs]k_live_|eyJ")}
    for kind in KINDS:
        rows = with_spans(rows, "_body", f"_{kind}", PATTERNS[kind], needs.get(kind))

    def listed(kind: str):
        value = lambda s: F.regexp_extract(s["match"], VALUE, 1) if kind == "assign" else s["match"]
        spans = F.col(f"_{kind}")
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], VALUE, 1)) >= 6)
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.sha2(value(s), 256).alias("hash")
            ),
        )

    return rows.withColumn("_spans", F.sort_array(F.concat(*map(listed, KINDS)))).drop("_body", *[f"_{k}" for k in KINDS])


def ownership(found: DataFrame, common_owners: int, common_repos: int) -> DataFrame:
    """Distinct owners and repositories per value; a value that many hold is an example.

    Rows are first reduced to one per (value, owner, repository) and task, so a
    value that a third of the corpus quotes costs a row per task.
    """
    pairs = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses")).withColumn(
        "live", (F.col("owners") < common_owners) & (F.col("repos") < common_repos)
    )


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "lang", common_owners: int = 3, common_repos: int = 4) -> DataFrame:
    """doc_id and `secrets` of each row: (start, kind, end, owners, repos, uses, live), by start, then kind.

    A repository is a value of `repo` within a value of `owner`; NULLs count as
    one value. A candidate held by fewer owners and repositories than the given
    numbers looks live, others are widely copied examples. Base spans stay
    either way; spans of the added kind stay only if live. Places are code
    points of the whole text, end exclusive. NULL and empty texts have none;
    repeated rows are rows of their own; extra columns are ignored.
    """
    rows = candidates(docs.select("doc_id", "text", null_safe_key(owner).alias("owner"), null_safe_key(repo).alias("repo"))).drop("text")
    rows = stored(rows.withColumn("_row", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())))
    found = rows.select("_row", "owner", "repo", F.inline("_spans"))
    judged = found.join(ownership(found, common_owners, common_repos), "hash").filter(F.col("live") | F.col("kind").isin(BASE))
    spans = judged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "owners", "repos", "uses", "live"))).alias("secrets"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,owners:bigint,repos:bigint,uses:bigint,live:boolean>>)")
    quiet = rows.filter(F.size("_spans") == 0).select("doc_id", empty.alias("secrets"))
    loud = rows.filter(F.size("_spans") > 0).select("_row", "doc_id").join(spans, "_row", "left").select("doc_id", F.coalesce("secrets", empty).alias("secrets"))
    return quiet.unionByName(loud)


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans, live and example counts."""
    rows = find_secrets(docs, **options)
    base = F.filter("secrets", lambda s: s["kind"].isin(BASE))
    count = lambda test: F.size(F.filter("secrets", test)).cast("long")
    is_kind = lambda kind: lambda s: s["kind"] == kind
    return rows.select(
        "doc_id",
        *[count(is_kind(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )
