"""Near duplicates from bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from plotwise.llm.common import stored, text_of, unused
from plotwise.llm.graph import components

WORDS = 5  # words of a shingle
KEPT = 48  # values of a sketch
SPARE = 6  # largest lists that a set leaves
SHORT = 64  # longest list whose pairs become rows
BLOCK = 2048  # sets of a longer list in a block
LIKELY = 45  # estimated percentage from which a pair is verified
ENOUGH = 75  # percentage that links
REMEMBERED = 200_000  # words whose hash a task remembers; more begin afresh
SKETCHES = "doc_id long, row long, text_key long, n_shingles long, set_key binary, sid long, sketch array<long>, packed binary"
SIGN = np.uint64(1 << 63)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: bytes, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences of a text.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer
    words than a shingle gives its whole sequence, a text without words nothing.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    size = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows to set size, set key, sketch and packed text."""
    known, packer = WordHash(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for first in range(0, len(batch), 512):
            part = batch.iloc[first : first + 512]
            rows = []
            for doc_id, row, text_key, text in zip(part.doc_id, part.row, part.text_key, part.text):
                raw = text.encode()
                found = shingle_hashes(raw, known)
                key = xxhash.xxh3_128_digest(found.tobytes())
                sid = int.from_bytes(key[:8], "little", signed=True)
                sketch = (found[:KEPT] ^ SIGN).view(np.int64)
                rows.append((doc_id, row, text_key, len(found), key, sid, sketch, packer.compress(raw)))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "text_key", "n_shingles", "set_key", "sid", "sketch", "packed"]).astype({"doc_id": "Int64"})


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the whole sets of two packed texts have 100 * both >= 75 * either."""
    known, reader = WordHash(), zstandard.ZstdDecompressor()
    last, last_set, out = None, None, []
    for x, y in zip(a, b):
        if y != last:  # rows come sorted, so a hub is unpacked once
            last, last_set = y, shingle_hashes(reader.decompress(y), known)
        one = shingle_hashes(reader.decompress(x), known)
        both = len(np.intersect1d(one, last_set, assume_unique=True))
        out.append(100 * both >= ENOUGH * (len(one) + len(last_set) - both))
    return pd.Series(out, dtype=bool)


def estimated(a: Column, b: Column) -> Column:
    """Percentage of the union's bottom-k values that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, KEPT)
    return 100 * F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def comparable(a: Column, b: Column) -> Column:
    """Set sizes that a link allows at all."""
    return (100 * F.least(a, b) >= ENOUGH * F.greatest(a, b)) & (F.least(a, b) > 2)


def inverted_lists(sketches: DataFrame) -> DataFrame:
    """key, sid, n_shingles and list_size: a list for each two neighbouring retained values.

    Sets that overlap by three quarters share many such lists: more than 6 of
    them but for 2 in 10^7 pairs at the threshold, and sets of n values, all
    retained, at least n / 2 - 1. So each set may leave its largest lists, one
    fewer than it is bound to share: of those a pair shares, the smallest is
    never among them. That keeps passages which very many documents hold from
    making lists. Equal sets are one entry. Sets of one or two shingles can only
    link to equal sets.
    """
    pairs = F.expr("transform(sequence(0, size(sketch) - 2), i -> xxhash64(sketch[i], sketch[i + 1]))")
    entries = sketches.filter("n_shingles > 2").select(F.explode(pairs).alias("key"), "sid", "n_shingles")
    entries = entries.groupBy("key", "sid").agg(F.min("n_shingles").alias("n_shingles"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("list_size")).filter("list_size > 1")
    spare = F.when(F.col("n_shingles") > KEPT, F.lit(SPARE)).otherwise(F.greatest(F.lit(0), F.least(F.lit(SPARE), F.floor(F.col("n_shingles") / 2) - 2)))
    largest = Window.partitionBy("sid").orderBy(F.desc("list_size"), "key")
    numbered = entries.join(shared, "key").withColumn("place", F.row_number().over(largest))
    return stored(numbered.filter(F.col("place") > spare).drop("place"))


def star_pairs(lists: DataFrame) -> DataFrame:
    """a, b and overlap: each member of a list beside the list's hub, the set with the most company.

    A list of n sets gives n - 1 pairs.
    """
    company = lists.groupBy("sid").agg(F.sum("list_size").alias("company"))
    known = lists.join(company, "sid")
    hubs = known.groupBy("key").agg(F.max(F.struct("company", "sid", "n_shingles")).alias("hub"))
    pairs = known.join(hubs, "key").filter((F.col("sid") != F.col("hub.sid")) & comparable(F.col("n_shingles"), F.col("hub.n_shingles")))
    return pairs.groupBy(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).agg(F.count(F.lit(1)).alias("overlap"))


def sets_of(sketches: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """One row per different set that `pairs` name, with the given columns."""
    needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    picked = sketches.join(needed, "sid", "left_semi")
    return picked.groupBy("sid", "set_key").agg(F.min(F.struct("row", *columns)).alias("_s")).select("sid", "set_key", *[f"_s.{c}" for c in columns])


def both_sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs` with set_key and the columns of both sides, as structs x and y."""
    side = lambda name, key: sets.select(F.col("sid").alias(key), F.struct(*sets.columns[1:]).alias(name))
    return pairs.join(side("x", "a"), "a").join(side("y", "b"), "b")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose union sketch comes near the threshold, with the estimate."""
    joined = both_sides(pairs, sets_of(sketches, pairs, "sketch"))
    rated = joined.select("a", "b", estimated(F.col("x.sketch"), F.col("y.sketch")).alias("estimate"))
    return stored(rated.filter(F.col("estimate") >= LIKELY))


def verified(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that link, by whole sets, as set keys a and b."""
    joined = both_sides(pairs.select("a", "b"), sets_of(sketches, pairs, "packed"))
    joined = joined.select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b"), F.col("x.packed").alias("xp"), F.col("y.packed").alias("yp"))
    return stored(joined.sortWithinPartitions("b").filter(alike("xp", "yp")).select("a", "b"))


def labelled(sketches: DataFrame, links: DataFrame) -> DataFrame:
    """sid and label of every set that has a list."""
    labels = components(links)
    keys = sketches.filter("n_shingles > 2").select("sid", "set_key").distinct()
    joined = keys.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
    return stored(joined.groupBy("sid").agg(F.min(F.coalesce("label", "set_key")).alias("label")))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose sets aren't in one component yet."""
    a = labels.select(F.col("sid").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("sid").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a").join(b, "b").filter("la <> lb").drop("la", "lb")


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that more than one component shares, with the label of each entry."""
    marked = lists.select("key", "sid", "n_shingles", "list_size").join(labels, "sid")
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return marked.join(mixed, "key")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets.

    Values that many sets hold are counted by one matrix product, values that few
    hold pair by pair.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    often = times[value] > 16
    both = np.zeros((n, n), dtype=np.float32)
    if often.any():
        columns = np.unique(value[often], return_inverse=True)[1]
        for first in range(0, columns.max() + 1, 4096):
            part = (columns >= first) & (columns < first + 4096)
            held = np.zeros((n, min(4096, columns.max() + 1 - first)), dtype=np.float32)
            held[owner[often][part], columns[part] - first] = 1
            both += held @ held.T
    owner, value = owner[~often], value[~often]
    for step in range(1, 16):
        same = value[step:] == value[:-step]
        np.add.at(both, (owner[:-step][same], owner[step:][same]), 1)
        np.add.at(both, (owner[step:][same], owner[:-step][same]), 1)
    return both.astype(np.int64)


def linked_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links that span the components of a block of a long list: one fewer than sets, by whole sets."""
    known, reader = WordHash(), zstandard.ZstdDecompressor()
    sets = [shingle_hashes(reader.decompress(x), known) for x in rows.packed]
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    link = 100 * both >= ENOUGH * (size[:, None] + size[None, :] - both)
    keys, out = rows.set_key.tolist(), []
    unseen = np.ones(len(sets), dtype=bool)
    for start in range(len(sets)):
        if unseen[start]:
            unseen[start], reached = False, [start]
            while reached:
                at = reached.pop()
                near = np.flatnonzero(link[at] & unseen)
                unseen[near] = False
                reached += near.tolist()
                out += [(keys[at], keys[k]) for k in near]
    return pd.DataFrame(out, columns=["a", "b"])


def long_list_links(lists: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links, as set keys a and b, within the mixed lists that are too long for pairs as rows.

    A list is cut into blocks; each two blocks meet in one task, which compares
    whole sets and returns links that span what it joined.
    """
    marked = mixed_lists(lists, labels).filter(F.col("list_size") > SHORT).select("key", "sid", F.ceil(F.col("list_size") / BLOCK).cast("int").alias("blocks"))
    texts = sets_of(sketches, marked.select(F.col("sid").alias("a"), F.col("sid").alias("b")), "packed")
    rows = marked.join(texts, "sid").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_key", "packed")
    return stored(rows.groupBy("key", "i", "j").applyInPandas(linked_block, "a binary, b binary").distinct())


def remaining_pairs(lists: DataFrame, labels: DataFrame, sketches: DataFrame, tried: DataFrame) -> DataFrame:
    """Likely pairs within a short list whose sets are in different components, but for those tried.

    The estimate is part of the join, so unlikely pairs are never rows.
    """
    marked = mixed_lists(lists, labels).filter(F.col("list_size") <= SHORT).drop("list_size")
    held = sets_of(sketches, marked.select(F.col("sid").alias("a"), F.col("sid").alias("b")), "sketch").select("sid", "sketch")
    marked = stored(marked.join(held, "sid"))
    x = marked.select("key", *[F.col(c).alias(f"x_{c}") for c in ("sid", "label", "n_shingles", "sketch")])
    y = marked.select("key", *[F.col(c).alias(f"y_{c}") for c in ("sid", "label", "n_shingles", "sketch")])
    fits = (
        (x["key"] == y["key"])
        & (F.col("x_sid") < F.col("y_sid"))
        & (F.col("x_label") != F.col("y_label"))
        & comparable(F.col("x_n_shingles"), F.col("y_n_shingles"))
        & (estimated(F.col("x_sketch"), F.col("y_sketch")) >= LIKELY)
    )
    pairs = x.join(y, fits).select(F.col("x_sid").alias("a"), F.col("y_sid").alias("b")).distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(pairs.join(known, ["a", "b"], "left_anti"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_key, n_shingles, component_id and kept of each row.

    Sets of distinct 5-word shingles link when 100 * intersection >= 75 * union;
    components close over links. Equal sets are one node from the start. Members
    of a list are first compared with its hub, best estimate first; then sets
    that still lie in different components are compared, long lists block by
    block and short ones pair by pair, so each likely pair is either verified or
    already joined.

    NULL and empty texts have no set and link with nothing. component_id is the
    smallest doc_id of the component; NULLs come after numbers. The row with it
    is kept; of rows that repeat it, one. Extra columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    sketches = stored(rows.mapInPandas(sketched, SKETCHES))
    lists = inverted_lists(sketches)
    tried = likely(star_pairs(lists), sketches)
    best = tried.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    links = verified(best, sketches)
    labels = labelled(sketches, links)
    links = links.unionByName(verified(apart(tried, labels), sketches))
    labels = labelled(sketches, links)
    links = links.unionByName(long_list_links(lists, labels, sketches))
    links = links.unionByName(verified(remaining_pairs(lists, labels, sketches, tried), sketches))
    nodes = components(links).withColumnRenamed("node", "set_key")
    own = F.when(F.col("n_shingles") == 0, F.concat(F.lit(b"row"), F.col("row").cast("string").cast("binary"))).otherwise(F.coalesce("label", "set_key"))
    placed = stored(sketches.select("doc_id", "row", "text_key", "n_shingles", "set_key").join(nodes, "set_key", "left").select("doc_id", "row", "text_key", "n_shingles", own.alias("group")))
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return placed.join(first, "group").select(
        "doc_id", "row", "text_key", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns: one of each component.

    Decisions find their rows by doc_id and a hash of the text; of rows equal in
    both one stays.
    """
    key, turn = unused(docs, "_text_key"), unused(docs, "_turn")
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_hash")).distinct()
    rows = docs.withColumn(key, F.xxhash64(text_of()))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows[key] == kept["_hash"]), "left_semi")
    one = Window.partitionBy("doc_id", key).orderBy(key)
    return rows.withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1).select(*docs.columns)
