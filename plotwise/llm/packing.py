"""Packing documents into sequences with a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import stored, text_of

LIMIT = 2048
BLOCK = 2000  # pieces per block
ISLANDS = 2
MOST_WORDS = 400_000  # words of a generation that a task remembers
MARKED_WORD = re.compile("([a-zà-öø-ÿ]+)([.,!?;:*$%&#|]*)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid string"
PACKED = "uid string, length long, block long, island int, bin int, offset long, fill long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones are themselves, others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """Ids of a word as little-endian 32-bit words, worked out when first met.

    The vocabulary lower-cases and never joins across ASCII white space, nor
    letters with a mark after them; so ids of a text are those of its words, and
    words come again. Lower-case letters need no normalising: the vocabulary's
    model gets them directly, byte by byte as its characters. Two generations are
    remembered: words not met again while one fills are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.as_characters = self.tokenizer.model, byte_characters()
        self.raw = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        self[word] = ids
        return ids

    def _encoded(self, word: bytes) -> bytes:
        match = MARKED_WORD.fullmatch(word.decode())
        if not match:
            return b"".join([self.raw[k] for k in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
        letters, marks = match.groups()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.as_characters)
        ids = b"".join([self.raw[t.id] for t in self.model.tokenize(letters)])
        return ids + self[marks.encode()] if marks else ids

    def of(self, text: str) -> bytes:
        raw = text.encode()
        words = (raw if b"<|" in raw else raw.lower()).split()  # names of special tokens are case-sensitive
        return b"".join(map(self.__getitem__, words))

    def forget(self) -> None:
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()


def cut_into_pieces(path: str, limit: int):
    """Rows to pieces of at most `limit` ids; each document ends with id 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(path)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.iloc[first : first + 512]
                words.forget()
                rows = []
                for doc_id, uid, text in zip(part.doc_id, part.uid, part.text):
                    ids = words.of(text) + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * limit)):
                        cut = ids[at : at + 4 * limit]
                        rows.append((None if pd.isna(doc_id) else int(doc_id), k, at // 4, len(cut) // 4, zlib.crc32(cut), f"{uid}-{k}"))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
                yield out.astype({"doc_id": "Int64"})

    return run


# packings: lists of bins, a bin is a list of item numbers ---------------------
def best_fit(bins: list[list[int]], fills: list[int], items: list[int], lengths, limit: int) -> None:
    """Put items, longest first, where they leave the least room; open bins as needed."""
    room = sorted((limit - f, i) for i, f in enumerate(fills) if f < limit)
    for item in sorted(items, key=lambda x: (-lengths[x], x)):
        need = lengths[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, i = room.pop(at)
        else:
            left, i = limit, len(bins)
            bins.append([])
            fills.append(0)
        bins[i].append(item)
        fills[i] += need
        if left - need:
            insort(room, (left - need, i))


def fills_of(bins: list[list[int]], lengths) -> list[int]:
    return [sum(lengths[x] for x in b) for b in bins]


def worth(bins: list[list[int]], lengths, limit: int) -> tuple[int, float]:
    """Fewer bins first; among as many, fuller bins beside emptier ones."""
    return -len(bins), sum((f / limit) ** 2 for f in fills_of(bins, lengths))


def crossover(mother, father, lengths, limit: int, dice: random.Random):
    """Whole well-filled bins of the father go into the mother; her bins with the same items go, what they lose is fitted again."""
    fills = fills_of(father, lengths)
    order = sorted(range(len(father)), key=lambda i: -fills[i])
    best = order[: max(1, len(order) // 2)]
    injected = [list(father[i]) for i in best if dice.random() < 0.5] or [list(father[best[0]])]
    inside = {x for b in injected for x in b}
    kept, displaced = injected, []
    for b in mother:
        if any(x in inside for x in b):
            displaced += [x for x in b if x not in inside]
        else:
            kept.append(list(b))
    best_fit(kept, fills_of(kept, lengths), displaced, lengths, limit)
    return kept


def mutated(bins, lengths, limit: int, dice: random.Random):
    """Empty the emptiest bins and some others, and fit their items again."""
    fills = fills_of(bins, lengths)
    order = sorted(range(len(bins)), key=lambda i: fills[i])
    gone = set(order[: max(1, len(bins) // 20)]) | {dice.randrange(len(bins)) for _ in range(max(1, len(bins) // 20))}
    kept = [list(b) for i, b in enumerate(bins) if i not in gone]
    loose = [x for i in gone for x in bins[i]]
    best_fit(kept, fills_of(kept, lengths), loose, lengths, limit)
    return kept


def evolve(lengths, limit: int, seed: int, elites=(), size: int = 5, rounds: int = 12):
    """The best packing found; `elites` are packings that came from other islands."""
    dice = random.Random(seed)
    least = -(-sum(lengths) // limit)
    everything = list(range(len(lengths)))
    population = [list(map(list, e)) for e in elites]
    start: list[list[int]] = []
    best_fit(start, [], everything, lengths, limit)
    population.append(start)
    while len(population) < size and len(start) > least:
        population.append(mutated(population[-1], lengths, limit, dice))
    population.sort(key=lambda p: worth(p, lengths, limit), reverse=True)
    for _ in range(rounds):
        if len(population[0]) <= least or len(population) < 2:
            break
        mother, father = sorted(dice.sample(range(len(population)), 2))
        child = mutated(crossover(population[mother], population[father], lengths, limit, dice), lengths, limit, dice)
        population[-1] = max(population[-1], child, key=lambda p: worth(p, lengths, limit))
        population.sort(key=lambda p: worth(p, lengths, limit), reverse=True)
    return population[0]


def packed_rows(pieces: pd.DataFrame, bins, lengths, island: int) -> pd.DataFrame:
    uid, block = pieces.uid.to_numpy(), int(pieces.block.iloc[0])
    rows = []
    for number, b in enumerate(bins):
        fill, at = sum(lengths[x] for x in b), 0
        for x in b:
            rows.append((uid[x], lengths[x], block, island, number, at, fill))
            at += lengths[x]
    return pd.DataFrame(rows, columns=["uid", "length", "block", "island", "bin", "offset", "fill"])


def settle(limit: int):
    """An island's first epoch: its best packing of the block."""

    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = pieces.length.tolist()
        return packed_rows(pieces, evolve(lengths, limit, seed=int(key[1])), lengths, int(key[1]))

    return run


def migrate(limit: int):
    """The last epoch: the islands' elites of a block meet and are crossed."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = rows[rows.island == rows.island.min()].sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths, number = one.length.tolist(), {u: i for i, u in enumerate(one.uid)}
        elites = []
        for _, part in rows.groupby("island"):
            bins = part.groupby("bin").uid.apply(lambda us: [number[u] for u in us])
            elites.append(bins.tolist())
        return packed_rows(one, evolve(lengths, limit, seed=97, elites=elites), lengths, 0)

    return run


def evolved(pieces: DataFrame, blocks: int, limit: int, turn: int) -> DataFrame:
    """uid, length and place of each piece after both epochs; each turn deals anew."""
    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks)).alias("block"))
    islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    first = islands.groupBy("block", "island").applyInPandas(settle(limit), PACKED)
    return first.groupBy("block").applyInPandas(migrate(limit), PACKED)


def bin_number(turn: int):
    """A number below 0 per (turn, block, bin); full pieces have numbers from 0 on."""
    return -1 - (F.lit(turn).cast("long") * F.lit(2**51) + F.col("block") * F.lit(2**24) + F.col("bin"))


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, block: int = BLOCK, full: float = 0.99) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    A document's ids end with id 0; only documents longer than `limit` are cut.
    Full pieces are sequences as they are. The others are dealt to blocks of
    about `block` pieces; each block is evolved on two islands, whose elites then
    meet. Bins that are `full` stay; what the others hold is dealt anew to blocks
    of that size. The end is a single block, or a turn that saves less than a bin
    per block: then lengths leave no better fit, and the better of the last two
    packings stays.

    NULL and empty texts are the id 0 alone; each row is a document of its own,
    also where a doc_id repeats or is NULL. Extra columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("uid", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()))
    pieces = stored(rows.mapInPandas(cut_into_pieces(path or tokenizer_path(), limit), PIECES))
    whole = pieces.filter(F.col("length") == limit).select("uid", F.lit(0).cast("long").alias("offset"), F.monotonically_increasing_id().alias("sequence_id"))
    places, left, turn = [whole], pieces.filter(F.col("length") < limit).select("uid", "length"), 0
    number, waiting, before = left.count(), None, 0
    while number:
        blocks = ceil(number / block)
        now = stored(evolved(left, blocks, limit, turn)).withColumn("sequence_id", bin_number(turn))
        bins = now.filter("offset = 0").count()
        if blocks == 1 or (turn and before - bins < blocks):
            last = now if turn == 0 or bins < before else waiting
            places.append(last.select("uid", "offset", "sequence_id"))
            break
        stay = F.col("fill") >= full * limit
        places.append(now.filter(stay).select("uid", "offset", "sequence_id"))
        waiting = now.filter(~stay)
        left = waiting.select("uid", "length")
        number, before, turn = left.count(), waiting.filter("offset = 0").count(), turn + 1
    placed = places[0]
    for p in places[1:]:
        placed = placed.unionByName(p)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


