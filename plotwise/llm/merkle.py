"""A Merkle manifest of the documents, and the recursive climb that checks every row against its root."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.llm.common import null_safe_key, stored

LEVELS = 10  # levels of the tree between stored nodes; 1 stores every level
PIECE_ROWS = 20_000  # rows that one task numbers
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

#: The digest of a node from its own digest and the siblings on its way up; odd places stand to the right.
FOLD = """aggregate({path}, struct({digest} AS h, {turn} AS t), (a, s) -> struct(
  unhex(sha2(lower(hex(if(a.t & 1 = 1, concat(s, a.h), concat(a.h, s)))), 256)) AS h, shiftright(a.t, 1) AS t), a -> a.h)"""
JOIN = "aggregate({path}, X'', (a, s) -> concat(a, s))"


def digest(parts: Column) -> Column:
    """SHA-256 of a text or of the hexadecimal text of digests, as bytes."""
    return F.unhex(F.sha2(parts, 256))


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def leaf_text(n_chars: Column) -> Column:
    """The fields of a document, each with its length in bytes before it; `-` stands for NULL."""
    values = [n_chars.cast("string") if c == "n_chars" else F.col(c).cast("string") for c in FIELDS]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def leaves_of(docs: DataFrame) -> DataFrame:
    """grp, doc_id, digest, and the digest of the tampered row where the row is tampered with."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    count = F.col("n_chars").cast("decimal(20,0)")
    return docs.select(
        null_safe_key("lang").alias("grp"),
        "doc_id",
        digest(leaf_text(F.col("n_chars"))).alias("digest"),
        F.when(chosen, digest(leaf_text(count + 1))).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`rows` with idx, their 0-based place within grp along `order`.

    Ranges of the whole order are sorted side by side, so a group may be of any
    size; a place is the rows of the group in earlier ranges plus those before it
    in its own. Equal rows are told apart by a running number, so they may fill
    more than one range.
    """
    ties = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = max(1, ceil(rows.count() / piece_rows))
    dealt = ties.repartitionByRange(ranges, "grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie")
    place = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    dealt = stored(dealt.withColumn("_piece", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dealt.groupBy("grp", "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("grp").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = dealt.join(offsets, ["grp", "_piece"])
    return joined.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_piece", "_at", "_first", "_before")


def raised(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks of 2 ** levels neighbouring nodes: grp, parent, top, leaves and members with the siblings on their way.

    A block that isn't its group's first is always built over all levels: its
    group goes on beyond it. A first block that isn't full is the whole group,
    which ends where one node remains.
    """
    extra = [c for c in nodes.columns if c not in ("grp", "idx")]
    members = F.sort_array(F.collect_list(F.struct("idx", *extra)))
    blocks = nodes.groupBy("grp", F.shiftright("idx", levels).alias("parent")).agg(members.alias("m"), F.sum("leaves").alias("leaves"))
    n = F.size("m")
    height = F.when(n == 1, 0).otherwise(F.length(F.bin(n - 1)))
    blocks = blocks.withColumn("height", F.when((F.col("parent") == 0) & (n < 1 << levels), height).otherwise(levels))
    blocks = blocks.withColumn("l0", F.expr("transform(m, x -> x.digest)"))
    for k in range(levels):
        up = f"transform(sequence(0, (size(l{k}) - 1) div 2), j -> unhex(sha2(lower(hex(concat(l{k}[2 * j], coalesce(get(l{k}, 2 * j + 1), X'')))), 256)))"
        blocks = blocks.withColumn(f"l{k + 1}", F.expr(f"if({k} < height, {up}, l{k})"))
    beside = ", ".join(f"coalesce(get(l{k}, cast(shiftright(i, {k}) ^ 1 AS int)), X'')" for k in range(levels))
    kept = ", ".join(f"x.{c} AS {c}" for c in ["idx", *extra])
    climbing = F.expr(f"transform(m, (x, i) -> struct({kept}, slice(array({beside}), 1, height) AS path))")
    return blocks.select("grp", "parent", F.col(f"l{levels}")[0].alias("top"), "leaves", climbing.alias("members"))


def built(nodes: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """The one node left of each group, and the stored node rows of each step with their parents."""
    steps = []
    while True:
        blocks = stored(raised(nodes, levels))
        steps.append(blocks.select("grp", "parent", F.explode("members").alias("x")).select("grp", "parent", "x.*"))
        nodes = blocks.select("grp", F.col("parent").alias("idx"), F.col("top").alias("digest"), "leaves")
        if nodes.filter("idx > 0").isEmpty():
            return nodes, steps


def copies(rows: DataFrame, step: int, first: Column, levels: int) -> DataFrame:
    """Node rows of a step, once per block of leaves below them, `first` being the place of their first leaf.

    A block of leaves climbs with its own copies, so the join of the climb has no
    key with more than 2 ** levels leaves; there is a copy per 2 ** levels leaves
    and step.
    """
    blocks = F.sequence(F.shiftright(first, levels), F.shiftright(first + F.col("leaves") - 1, levels))
    return rows.select("grp", F.lit(step).alias("step"), "idx", "parent", "path", "turn", "top", F.explode(blocks).alias("block"))


def linked_above(steps: list[DataFrame], levels: int, ends: DataFrame | None = None) -> DataFrame | None:
    """Node rows above the first step and, on top of each group, the row of `ends` that leads out of it."""
    parts = []
    for step, rows in enumerate(steps[1:], 1):
        rows = rows.withColumns({"turn": F.col("idx"), "top": F.lit(None).cast("binary")})
        parts.append(copies(rows, step, F.expr(f"shiftleft(idx, {levels * step})"), levels))
    if ends is not None:
        ends = ends.withColumns({"idx": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
        parts.append(copies(ends, len(steps), F.col("idx"), levels))
    return reduce(DataFrame.unionByName, parts) if parts else None


def climbed(start: DataFrame, above: DataFrame | None, last: int, levels: int, names: list[str], joined: bool = True) -> DataFrame:
    """Every row of `start` at step `last`, by a recursive query: the columns `names`, top, turn, proof and folded.

    `start` has grp, idx, digest (what is folded), path and parent. Each turn a row joins the stored
    node that it has reached, puts the siblings of this node behind its own and
    folds its digest with them. `proof` is one run of bytes, or the list of
    siblings where not `joined`; a list holds empty ones for levels without a sibling.
    """
    spark = start.sparkSession
    own, mine = "".join(f"{c}, " for c in names), "".join(f"c.{c}, " for c in names)
    gathered = JOIN if joined else "{path}"
    first = f"""SELECT {own}grp, idx AS turn, 1 AS step, parent AS at, cast(NULL AS binary) AS top,
      {gathered.format(path="path")} AS proof, {FOLD.format(path="path", digest="digest", turn="idx")} AS folded FROM {{start}}"""
    if above is None:
        return stored(spark.sql(first, start=start).select(*names, "top", "turn", "proof", "folded"))
    query = f"""
    WITH RECURSIVE climb AS (
      {first}
      UNION ALL
      SELECT {mine}c.grp, c.turn, c.step + 1, n.parent, n.top, concat(c.proof, {gathered.format(path="n.path")}),
             {FOLD.format(path="n.path", digest="c.folded", turn="n.turn")}
      FROM climb c JOIN {{above}} n ON c.grp = n.grp AND c.step = n.step AND c.at = n.idx AND shiftright(c.turn, {levels}) = n.block
      WHERE c.step < {last}
    ) SELECT {own}top, turn, proof, folded FROM climb WHERE step = {last}
    """
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # the climb has a row per leaf and step, however many there are
    try:
        return stored(spark.sql(query, start=start, above=above))
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Rows of a language ascend by doc_id and pair up until one node, the subroot,
    remains; subroots pair up in the order of languages to the root. The levels
    are built block by block and stored as node rows that name their parent and
    the siblings on the way to it. A recursive query then climbs from every row:
    it gathers the siblings and folds the digest of the row as it stands now,
    which for some rows is a tampered one, so those don't reach the root.

    NULL fields count as `-`; a NULL language is a group of its own, first; NULL
    doc_ids come first. Rows that share a language and a doc_id are ordered by
    their leaves, and equal rows are interchangeable. A lone row is its
    group's subroot. Extra columns are ignored. An empty table gives an empty
    result.
    """
    one = F.lit(1).cast("long").alias("leaves")
    rows = numbered(leaves_of(docs), ["doc_id", "digest"])
    tops, steps = built(rows.select("*", one), levels)
    groups = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("leaves").alias("rows")), ["name"])
    roots, above = built(groups.select("*", one), levels)
    ways = climbed(above[0].withColumn("subroot", F.col("digest")), linked_above(above, levels), len(above), levels, ["name", "rows", "subroot"], joined=False)
    ends = ways.select(F.col("name").alias("grp"), F.col("rows").alias("leaves"), F.col("proof").alias("path"), "turn", F.col("subroot").alias("top"))
    start = steps[0].withColumns({"leaf": F.col("digest"), "digest": F.coalesce("tampered", "digest")})
    reached = climbed(start, linked_above(steps, levels, ends), len(steps) + 1, levels, ["doc_id", "leaf"])
    first = roots.first()
    root = F.lit(first["digest"].hex() if first else None).cast("string")
    return reached.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("top")).alias("subroot"),
        root.alias("root"),
        F.sha2(hexed(F.col("proof")), 256).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"),
        (hexed(F.col("folded")) == root).alias("verified"),
    )
