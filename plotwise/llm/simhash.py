"""Near duplicates by SimHash fingerprints, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import stored, text_of
from plotwise.llm.graph import components
from plotwise.session import stored_in_batches

BITS = 64
WORDS = 3  # words of a shingle
SEED = 42
RADIUS = 2  # differing bits that still link
FULL = 2048  # fingerprints that one comparison takes at most; fuller buckets are split
CHUNK = 65_536  # shingles whose bits are counted at once
LANES = 8192  # small buckets are compared together up to so many fingerprints
ONES = (1 << BITS) - 1


def fingerprint(text: bytes) -> int:
    """64 bits, each set where over half the hashes of the word sequences of a text have it.

    Words are lower-cased in A-Z and split at ASCII white space; sequences count
    as often as they occur. Fewer words than a sequence count as one; no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[first : first + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to doc_id and fp; texts become Python objects one at a time."""
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def deeper(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks of the tables below the one whose buckets share the bits of `mask`.

    The other bits are cut into radius + 1 parts: fingerprints within the radius
    that share the mask also share a part. Five steps down from no shared bit, a
    bucket can't hold more than 1024 different fingerprints (radius 2).
    """
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * p // (radius + 1) for p in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:])]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def lanes_mask(held: np.ndarray) -> int:
    return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")


def within(planes: list[int], apart: int, alive: int, radius: int) -> int:
    """The lanes of `alive` whose fingerprint and that of the lane `apart` further differ in at most `radius` bits.

    Lanes are the bits of whole numbers, so each step counts for all of them. A carry-save counter
    starts so that the bit over the radius carries out of it; that lane is
    done, and the comparison is abandoned when no lane is left.
    """
    width = (radius + 1).bit_length()
    begin = (1 << width) - radius - 1
    counter = [alive if begin >> k & 1 else 0 for k in range(width)]
    for plane in planes:
        carry = (plane ^ plane >> apart) & alive
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        alive &= ~carry
        if not alive:
            break
    return alive


def block_links(buckets: list[np.ndarray], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span what buckets of different fingerprints join; buckets come largest first."""
    values = np.concatenate(buckets).astype(np.int64)
    sizes = np.array([len(b) for b in buckets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(values))  # lanes up to the end of the bucket
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = [lanes_mask(bits[:, b]) for b in range(BITS)]
    label, out = np.arange(len(values)), []
    for apart in range(1, int(sizes.max())):
        lanes = int(sizes[sizes > apart].sum())
        held = left[:lanes] > apart
        alive = within([p & (1 << lanes) - 1 for p in planes] if lanes < len(values) else planes, apart, lanes_mask(held), radius)
        if not alive:
            continue
        near = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((lanes + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))
        for i in near[label[near] != label[near + apart]].tolist():
            a, b = label[i], label[i + apart]
            if a != b:
                part = slice(starts[bucket[i]], starts[bucket[i]] + sizes[bucket[i]])
                label[part][label[part] == max(a, b)] = min(a, b)
                out.append((int(values[i]), int(values[i + apart])))
    return out


def linker(radius: int):
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of buckets to links, many small buckets at a time."""
        for batch in batches:
            waiting, count, out = [], 0, []
            for bucket in sorted(batch.fps, key=len, reverse=True):
                if waiting and count + len(bucket) > LANES:
                    out += block_links(waiting, radius)
                    waiting, count = [], 0
                waiting.append(np.asarray(bucket))
                count += len(bucket)
            if waiting:
                out += block_links(waiting, radius)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return linked


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp) that span the components of those within the radius.

    Each bucket of a table holds the fingerprints that agree on the bits of its
    mask. Buckets of up to `full` fingerprints are compared whole, in one row; fuller ones
    are dealt to the tables below, so no bucket grows with the input and none is left out.
    """
    masks, links = deeper(0, radius), None
    rows = prints.select(F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"), "fp")
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = stored(rows.join(counts, ["mask", "key"]))
        small = rows.filter(F.col("n") <= full).groupBy("mask", "key").agg(F.collect_set("fp").alias("fps")).select("fps")
        found = stored_in_batches(small.mapInPandas(linker(radius), "a long, b long").distinct())
        links = found if links is None else links.unionByName(found)
        rows = rows.filter(F.col("n") > full).select("mask", "fp")
        if rows.isEmpty():
            return links
        pairs = sorted({(signed(m), signed(d)) for m in masks for d in deeper(m, radius)})
        masks = sorted({d & ONES for _, d in pairs})
        tables = prints.sparkSession.createDataFrame(pairs, "mask long, below long")  # three times as many on each of five steps
        rows = rows.join(F.broadcast(tables), "mask").select(F.col("below").alias("mask"), "fp")


def simhash_classes(docs: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and kept of each row.

    Rows whose fingerprints differ in at most `radius` bits are linked; classes
    close over links. Equal fingerprints are one from the start, and equal rows
    share them. NULL and empty texts and those of white space have fingerprint
    zero and link like any other. component_id is the smallest doc_id of the class, NULL where all
    its doc_ids are NULL; NULL doc_ids are placed like other rows. The rows with that doc_id
    are kept. Extra columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"))
    rows = stored_in_batches(texts.mapInArrow(fingerprinted, "doc_id long, fp long"))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(fingerprint_links(prints, radius, full)).withColumnRenamed("node", "fp")
    classes = prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = stored(classes.select("fp", "label").join(firsts, "label").select("fp", "component_id"))
    return rows.join(placed, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
