"""Ranked lexical search of many queries at once, with the sums that queries share computed once."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotwise.llm.common import scratch, text_of
from plotwise.session import stored_in_batches

TOP = 50
BLOCK_ITEMS = 256  # queries that one pass over the documents answers
BLOCK_TERMS = 20_000  # terms of those queries, each as often as queries hold it
CELLS = 8_000_000  # numbers that a task's accumulators hold at most
CHUNK = 2048  # documents whose accumulators are held at once
SALTS = 32
#: ASCII letters and digits and everything beyond ASCII; A-Z are lower-cased, the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
POSTINGS = "doc_id long, n long, terms array<int>, tf array<long>"
RANKED = "item_id long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Plan:
    """How queries are summed: `shared` partial sums and, for each query, what it adds up.

    Numbers from 0 are terms; `terms` + k is the k-th shared sum, whose parts
    come before it.
    """

    def __init__(self, terms: int, shared: list[tuple[int, ...]], items: list[tuple[int, ...]]):
        self.terms, self.shared, self.items = terms, shared, items

    def additions(self) -> int:
        return sum(len(p) - 1 for p in self.shared) + sum(max(0, len(p) - 1) for p in self.items)

    def expanded(self, number: int) -> set[int]:
        return {number} if number < self.terms else set().union(*map(self.expanded, self.shared[number - self.terms]))


def shared_sums(items: list[set[int]], terms: int) -> Plan:
    """The sets of terms that queries have in common, as a graph of sums.

    Terms that stand in exactly the same two or more queries are one sum. Then
    the two parts that most queries add to each other become a sum of their own, again and again,
    until no two parts meet in a second query.
    """
    holders = defaultdict(list)
    for i, held in enumerate(items):
        for t in held:
            holders[t].append(i)
    alike = defaultdict(list)
    for t in sorted(holders):
        if len(holders[t]) > 1:
            alike[tuple(holders[t])].append(t)
    shared: list[tuple[int, ...]] = []
    parts: list[set[int]] = [{t for t in held if len(holders[t]) == 1} for held in items]
    common: list[set[int]] = [set() for _ in items]
    for where, group in alike.items():
        node = group[0]
        if len(group) > 1:
            shared.append(tuple(group))
            node = terms + len(shared) - 1
        for i in where:
            common[i].add(node)
    meets = Counter(p for held in common for p in combinations(sorted(held), 2))
    queue = [(-n, a, b) for (a, b), n in meets.items() if n > 1]
    heapify(queue)
    while queue:
        n, a, b = heappop(queue)
        now = meets[a, b]
        if now != -n:
            if now > 1:
                heappush(queue, (-now, a, b))
            continue
        shared.append((a, b))
        node, grown = terms + len(shared) - 1, Counter()
        for held in common:
            if a in held and b in held:
                held -= {a, b}
                for x in held:
                    meets[min(a, x), max(a, x)] -= 1
                    meets[min(b, x), max(b, x)] -= 1
                    grown[x] += 1
                held.add(node)
        del meets[a, b]
        for x, k in grown.items():
            meets[x, node] = k
            if k > 1:
                heappush(queue, (-k, x, node))
    return Plan(terms, shared, [tuple(sorted(a | b)) for a, b in zip(parts, common)])


def posted(vocabulary: dict[bytes, int]):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents to their number of terms and the counts of those that queries hold."""
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                held = Counter(filter(None.__ne__, map(vocabulary.get, words)))
                sizes.append(len(words))
                terms.append(np.fromiter(held, dtype=np.int32))
                counts.append(np.fromiter(held.values(), dtype=np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    return postings


def accumulated(plan: Plan, per_term: list[tuple[np.ndarray, np.ndarray] | None], rows: int) -> Iterator[np.ndarray]:
    """The scores of `rows` documents for each query in turn; shared sums are held, and made once."""

    def total(parts: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(rows, dtype=np.int64)
        for p in parts:
            if p >= plan.terms:
                out += held[p - plan.terms]
            elif per_term[p] is not None:
                at, value = per_term[p]
                out[at] += value
        return out

    held: list[np.ndarray] = []
    for parts in plan.shared:
        held.append(total(parts))
    for parts in plan.items:
        yield total(parts)


def scorer(plan: Plan, names: list, weights: np.ndarray, documents: int, length: int, top: int):
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best documents of the task for each query."""
        chunk = max(16, min(CHUNK, CELLS // (len(plan.shared) + 1)))
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in names]
        for batch in batches:
            for first in range(0, len(batch), chunk):
                part = batch.iloc[first : first + chunk]
                ids = part.doc_id.astype("Int64")
                none, ids = ids.isna().to_numpy(), ids.fillna(0).to_numpy(dtype=np.int64)
                sizes = np.array([len(t) for t in part.terms])
                if not sizes.sum():
                    continue
                row = np.repeat(np.arange(len(part)), sizes)
                term, tf = np.concatenate(part.terms.to_list()), np.concatenate(part.tf.to_list())
                m = 50 + (50 * part.n.to_numpy(dtype=np.int64) * documents) // length
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                order = np.argsort(term, kind="stable")
                edges = np.searchsorted(term[order], np.arange(plan.terms + 1))
                per_term = [(row[order[a:b]], value[order[a:b]]) if b > a else None for a, b in zip(edges[:-1], edges[1:])]
                for i, score in enumerate(accumulated(plan, per_term, len(part))):
                    old, old_ids, old_none = best[i]
                    least = old.min() if len(old) >= top else 1
                    new = np.flatnonzero(score >= max(1, least))
                    if len(new):
                        s, d, x = np.concatenate([old, score[new]]), np.concatenate([old_ids, ids[new]]), np.concatenate([old_none, none[new]])
                        kept = np.lexsort((d, x, -s))[:top]
                        best[i] = s[kept], d[kept], x[kept]
        for name, (score, ids, none) in zip(names, best):
            if len(score):
                yield pd.DataFrame({"item_id": pd.array([name] * len(score), dtype="Int64"), "doc_id": pd.array(ids, dtype="Int64"), "score": score}).assign(
                    doc_id=lambda d: d.doc_id.mask(none)
                )

    return scored


def item_blocks(items: DataFrame) -> Iterator[dict]:
    """item_id to the set of its terms, in blocks of bounded size; rows that share an item_id are one query."""
    block, size = {}, 0
    rows = items.select("item_id", F.encode(text_of(), "UTF-8").alias("text")).sort(F.col("item_id").asc_nulls_first())
    for row in rows.toLocalIterator():
        held = set(terms_of(bytes(row.text)))
        if block and row.item_id not in block and (len(block) >= BLOCK_ITEMS or size + len(held) > BLOCK_TERMS):
            yield block
            block, size = {}, 0
        block.setdefault(row.item_id, set()).update(held)
        size += len(held)
    if block:
        yield block


def block_ranking(docs: DataFrame, block: dict, top: int) -> DataFrame:
    """item_id, doc_id and score of the best documents of each task, for the queries of a block."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
    plan = shared_sums([{vocabulary[t] for t in held} for held in block.values()], len(vocabulary))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"))
    postings = stored_in_batches(texts.mapInArrow(posted(vocabulary), POSTINGS))
    sums = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    count, length = sums["documents"], sums["length"] or 1
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[row["term"]] = math.floor(1000 * math.log((2 * count + 2) / (2 * row["count"] + 1)))
    return postings.mapInPandas(scorer(plan, list(block), weights, count, length, top), RANKED)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` highest-scoring rows of `docs` for each item.

    Queries are taken in blocks of bounded size. Of each block the sets of terms
    that several queries share are found first; a task holds one accumulator
    per shared set for the documents before it, computes it once, and adds up the queries from them
    along the graph of sums. Document frequencies and lengths come from one stored table of counts.
    The best of each task meet in two rounds.

    Weights are made in doubles; everything else is whole numbers. Equal scores
    go by doc_id, NULL last; repeated rows rank side by side. A NULL text, or one without
    terms, matches nothing. Items that share an item_id, NULL included, are one
    query. Extra columns are ignored. No documents or no items give an empty
    result.
    """
    spark = docs.sparkSession
    path = scratch(spark)
    spark.createDataFrame([], RANKED).write.parquet(f"{path}/block=-1")
    for number, block in enumerate(item_blocks(items)):
        if any(block.values()):
            block_ranking(docs, block, top).write.parquet(f"{path}/block={number}")
    found = spark.read.schema(RANKED + ", block int").parquet(path).drop("block")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")
