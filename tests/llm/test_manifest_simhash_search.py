"""The Merkle manifest, SimHash classes and ranked search against plain Python, on edge rows and made-up families."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute as B
import numpy as np
import pytest
import xxhash
from test_operators import SF, edge, empty, sentence, small  # noqa: F401

from plotwise.llm import merkle, search, simhash
from plotwise.llm.common import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(level):
    """The last node, and per leaf (whether the sibling stands right, sibling or nothing) on its way up."""
    ways, row, k = [[] for _ in level], list(level), 0
    while len(row) > 1:
        for i, way in enumerate(ways):
            beside = (i >> k) ^ 1
            way.append((beside > i >> k, row[beside] if beside < len(row) else ""))
        row, k = [hashed("".join(row[i : i + 2])) for i in range(0, len(row), 2)], k + 1
    return row[0], ways


def manifest_want(rows):
    token = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: hashed("".join(map(token, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text))))
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0, x[0]))
    trees = {g: tree([h for h, _ in groups[g]]) for g in names}
    root, ways = tree([trees[g][0] for g in names]) if names else (None, [])
    out = Counter()
    for g, last in zip(names, ways):
        for (h, r), way in zip(groups[g], trees[g][1]):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf(r, 1) if changed else h
            for right, x in way + last:
                folded = hashed(folded + x if right else x + folded)
            out[r.doc_id, h, trees[g][0], root, hashed("".join(x for _, x in way + last)), folded, folded == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def by_row(found, columns):
    return Counter(tuple(r[c] for c in columns) for r in found)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_of_edge_rows(edge, levels):  # noqa: F811
    _, df = edge
    assert by_row(merkle.manifest(df, levels).collect(), COLUMNS) == manifest_want(df.collect())


@pytest.mark.parametrize(("sizes", "levels"), [([1], 2), ([1, 1, 1], 1), ([4, 2, 9], 1), ([5, 8, 3, 17, 1], 2)])
def test_manifest_of_group_sizes(spark, sizes, levels):
    rows = [(100 * g + i, "s", f"l{g}", i if i % 3 else None, f"t{i}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(df, levels).collect()
    assert by_row(found, COLUMNS) == manifest_want(df.collect())
    assert all(r.verified for r in found if zlib.crc32(str(r.doc_id).encode()) % 7)


def test_manifest_over_many_ranges(spark, monkeypatch):
    rows = [(k // 3, "s", "en" if k % 5 else None, 7, "same" if k % 3 else f"t{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    numbered = merkle.numbered
    monkeypatch.setattr(merkle, "numbered", lambda rows, order: numbered(rows, order, 7))
    assert by_row(merkle.manifest(df, 3).collect(), COLUMNS) == manifest_want(df.collect())


def fingerprint_want(text):
    words = B.WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes_want(rows, radius=2):
    prints = [fingerprint_want(t) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (prints[a] ^ prints[b]).bit_count() <= radius]
    comp = B.components(range(len(rows)), links)
    low = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return Counter((rows[k][0], f"{prints[k]:016x}", low.get(comp[k])) for k in comp)


def test_simhash_of_edge_rows(edge, small, spark):  # noqa: F811
    rows, df = edge
    found = simhash.simhash_classes(df).collect()
    assert by_row(found, ["doc_id", "fingerprint", "component_id"]) == classes_want(rows)
    found = simhash.simhash_classes(documents(spark, SF)).collect()
    assert by_row(found, ["doc_id", "fingerprint", "component_id"]) == classes_want(small)


def family(dice, centres, members, flips):
    out = set()
    for _ in range(centres):
        base = dice.getrandbits(64)
        for _ in range(members):
            x = base
            for _ in range(dice.randrange(flips)):
                x ^= 1 << dice.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("radius", "full"), [(2, 2048), (2, 12), (1, 3), (3, 200)])
def test_fingerprint_links(spark, radius, full):
    """Families with chains of near fingerprints; a small `full` deals every bucket to deeper tables."""
    dice = random.Random(radius * 100 + full)
    values = [simhash.signed(x) for x in family(dice, 12, 40, 7)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = [(r.a, r.b) for r in simhash.fingerprint_links(df, radius, full).collect()]
    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & simhash.ONES).bit_count() <= radius]
    assert all(((a ^ b) & simhash.ONES).bit_count() <= radius for a, b in found)
    assert B.components(values, found) == B.components(values, near) and len(near) > 50


def test_planes_abandon_and_count():
    dice = random.Random(4)
    buckets = [np.array([simhash.signed(x) for x in family(dice, 2, n, 5)]) for n in (30, 20, 9, 2, 1)]
    buckets.sort(key=len, reverse=True)
    for radius in (0, 1, 2, 3, 6):
        found = simhash.block_links(buckets, radius)
        for bucket in buckets:
            values = bucket.tolist()
            near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & simhash.ONES).bit_count() <= radius]
            assert B.components(values, [x for x in found if x[0] in values]) == B.components(values, near)


def test_masks_bound_every_bucket():
    """Five steps down no bucket holds more than 1024 fingerprints, and some table on every step has both of a near pair in one bucket."""
    level = [0]
    for _ in range(5):
        level = [d for m in level for d in simhash.deeper(m)]
    assert all(m.bit_count() >= 54 for m in level)
    dice = random.Random(2)
    for _ in range(300):
        x = dice.getrandbits(64)
        y, mask = x ^ 1 << dice.randrange(64) ^ 1 << dice.randrange(64), 0
        for _ in range(5):
            mask = next(d for d in simhash.deeper(mask) if x & d == y & d)


def search_want(docs, items, top=50):
    split = lambda t: TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    terms = [split(t) for _, t, *_ in docs]
    count, length = sum(map(bool, terms)), sum(map(len, terms))
    held = Counter(w for t in terms for w in set(t))
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(split(text))
    out = Counter()
    tfs = [Counter(t) for t in terms]
    for item, query in queries.items():
        rated = []
        for (doc_id, *_), t, tf in zip(docs, terms, tfs):
            m = 50 + 50 * len(t) * count // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in query if w in tf)
            if score > 0:
                rated.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(rated)[:top], 1):
            out[item, rank, None if none else doc_id, -score] += 1
    return out


RANKING = ["item_id", "rank", "doc_id", "score"]


def test_search_of_edge_rows(edge, spark):  # noqa: F811
    rows, df = edge
    items = [(1, "One"), (2, None), (3, ""), (4, "é😀 mail 10.0.0.1 Token"), (5, sentence(1, 300)), (6, sentence(1, 200) + " one a b"), (7, "!!! --"), (None, "a b"), (6, "x" * 200_000), (8, "a-b a_b A")]
    table = spark.createDataFrame([(*i, "clash", 1) for i in items], "item_id long, text string, score string, rank int")
    for top in (50, 2):
        assert by_row(search.search(df, table, top).collect(), RANKING) == search_want(rows, items, top)


def test_search_in_blocks(small, spark, monkeypatch):  # noqa: F811
    monkeypatch.setattr(search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(search, "CHUNK", 32)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = search.search(documents(spark, SF).repartition(6), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert by_row(found.collect(), RANKING) == search_want(small, items, 5)


def test_ties_go_by_doc_id(spark):
    docs = [(k, "the same words") for k in range(300, 0, -1)]
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "words other")], "item_id long, text string"))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(1, 51))
    assert by_row(found.collect(), RANKING) == search_want(docs, [(1, "words other")])


def test_shared_sums():
    """Every query's graph adds up to its own terms, once each, with fewer additions where queries overlap."""
    dice = random.Random(6)
    themes = [set(dice.sample(range(200), 12)) for _ in range(6)]
    items = [set().union(*dice.sample(themes, 2), dice.sample(range(200), 5)) for _ in range(40)] + [set(), {3}]
    plan = search.shared_sums(items, 200)
    for held, parts in zip(items, plan.items):
        sets = [plan.expanded(p) for p in parts]
        assert sum(map(len, sets)) == len(held) and set().union(*sets) == held
    assert all(p < 200 + k for k, parts in enumerate(plan.shared) for p in parts)
    assert plan.additions() < 0.6 * sum(max(0, len(i) - 1) for i in items)
    apart = search.shared_sums([{0, 1}, {2, 3}, {4}], 5)
    assert not apart.shared and apart.items == [(0, 1), (2, 3), (4,)]


def test_empty_tables_of_new_operators(empty, spark):  # noqa: F811
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (merkle.manifest(empty), simhash.simhash_classes(empty), search.search(empty, items), search.search(documents(spark, SF), items.filter("false"))):
        assert out.count() == 0
