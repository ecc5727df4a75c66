"""Learned quality rules: an ordered decision list over statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import SPACE, let

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
#: What rules may test: a count over another, or alone.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


def feature(name: str, count) -> Column:
    """The value of a feature; count(name) gives a count."""
    over, under = FEATURES[name]
    return count(over).cast("double") if under is None else count(over) / F.greatest(count(under), F.lit(1))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_words(words: Column) -> Column:
    """Places in three-word windows that occur twice or more.

    Where all windows hash differently none occurs again. Otherwise windows are
    sorted with their places; one that equals a neighbour occurs again and covers
    its place and the next two.
    """

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(3)]

    def placed(i: Column) -> Column:
        return F.struct(*[w.alias(f"w{k}") for k, w in enumerate(window(i))], i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])

    def covered(windows: Column) -> Column:
        again = F.filter(windows, lambda x, j: same(x, F.get(windows, j - 1)) | same(x, F.get(windows, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(places: Column) -> Column:
        different = F.size(F.array_distinct(F.transform(places, lambda i: F.xxhash64(*window(i)))))
        return F.when(different == F.size(places), F.lit(0)).otherwise(let(F.sort_array(F.transform(places, placed)), covered))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sequence(F.lit(0), F.size(words) - 3), counted))


def counts(text: Column) -> Column:
    """A struct of counts of the whole text; NULL counts as empty.

    One pass drops all characters but those that are counted; the counts come
    from what is left.
    """
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, SPACE + "+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rare = F.regexp_replace(body, f"[^{SYMBOLS}!?0-9{UPPER}]+", "")

    def of(w: Column, x: Column, r: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": _removed(r, SYMBOLS),
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": _repeated_words(w),
            "n_lines": F.size(x),
            "n_marks": _removed(r, "!?"),
            "n_upper": _removed(r, UPPER),
            "n_digits": _removed(r, "0123456789"),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in found.items()])

    return let(F.struct(words.alias("w"), lines.alias("x"), rare.alias("r")), lambda t: of(t["w"], t["x"], t["r"]))


def with_counts(docs: DataFrame) -> DataFrame:
    """`docs` and the counts as columns."""
    return docs.withColumn("_stats", counts(F.col("text"))).select(*docs.columns, "_stats.*")


def base_failed(count) -> Column:
    return (count("n_words") < 50) | (100 * count("n_repeat_words") > 50 * count("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.bound) == self.above

    def column(self, count) -> Column:
        value = feature(self.feature, count)
        return value > self.bound if self.above else value <= self.bound


def _split(rows: list[dict], tests: list[Test]) -> tuple[int, int]:
    """Bad and good rows that pass all tests."""
    held = [r for r in rows if all(t.holds(r) for t in tests)]
    bad = sum(r["bad"] for r in held)
    return bad, len(held) - bad


def _gains(rows: list[dict], feature: str):
    """(information gain, test) for every cut between two values of the feature."""
    ordered = sorted(rows, key=lambda r: r[feature])
    bad = sum(r["bad"] for r in ordered)
    base = log2(bad / len(ordered))
    low_bad = 0
    for i, (r, following) in enumerate(zip(ordered, ordered[1:]), 1):
        low_bad += r["bad"]
        if r[feature] < following[feature]:
            bound = (r[feature] + following[feature]) / 2
            for above, b, n in ((False, low_bad, i), (True, bad - low_bad, len(ordered) - i)):
                if b:
                    yield b * (log2(b / n) - base), Test(feature, above, bound)


def _grow(rows: list[dict], longest: int) -> list[Test]:
    """Add the test with the largest information gain while good rows are left."""
    rule: list[Test] = []
    while len(rule) < longest and 0 < sum(r["bad"] for r in rows) < len(rows):
        gain, best = max((g for f in FEATURES for g in _gains(rows, f)), key=lambda g: (g[0], g[1].feature, g[1].bound), default=(0.0, None))
        if gain <= 0:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def _prune(rule: list[Test], rows: list[dict]) -> list[Test]:
    """Drop tests from the end while (bad - good) / (bad + good) on unseen rows doesn't fall."""

    def worth(tests):
        b, g = _split(rows, tests)
        return (b - g) / (b + g) if b + g else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(rows: list[dict], most_rules: int = 12, longest: int = 3, precision: float = 0.9) -> list[list[Test]]:
    """Sequential covering of the bad rows, in order.

    Each rule is grown on two thirds of the rows that are left and pruned on the
    other third; it is taken while at least `precision` of what it covers is bad
    in either part, and what it covers goes.
    """
    rules: list[list[Test]] = []
    left = list(rows)
    while len(rules) < most_rules:
        grow, prune = [r for i, r in enumerate(left) if i % 3 != 2], [r for i, r in enumerate(left) if i % 3 == 2]
        rule = _grow(grow, longest)
        if not rule:
            break
        rule = _prune(rule, prune)
        sides = [_split(part, rule) for part in (grow, prune)]
        if any(b < precision * (b + g) for b, g in sides) or sides[0][0] < 3:
            break
        rules.append(rule)
        left = [r for r in left if not all(t.holds(r) for t in rule)]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int) -> list[dict]:
    """Features and verdict of at most `limit` labelled documents that pass the base rules, the smallest by hash."""
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(limit)
    counted = with_counts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    bad = (F.col("quality") == 0).cast("int")
    rows = counted.select(bad.alias("bad"), base_failed(F.col).alias("failed"), *[feature(f, F.col).alias(f) for f in FEATURES]).collect()
    return sorted((r.asDict() for r in rows if not r.failed), key=lambda r: (r["bad"], *[r[f] for f in FEATURES]))


def verdict(rules: list[list[Test]], count) -> Column:
    """The base rules, then the decision list as one ordered conditional expression: true stays."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = rule[0].column(count)
        for test in rule[1:]:
            holds = holds & test.column(count)
        out = F.when(holds, F.lit(False)).otherwise(out)
    return ~base_failed(count) & out


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = 4000) -> list[list[Test]]:
    """Rules learned from a bounded sample: at most `limit` labelled documents reach the driver."""
    return learn_rules(labelled_rows(docs, labels, limit))


def judged(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """A row per document: `_row`, a struct of its columns, the counts, base_failed and kept.

    NULL and empty texts have no words and fail. Rules see shares of the counts
    only, so equal texts get equal verdicts. Without labels there are no rules
    and the base decides. Columns of any name fit, as they are nested.
    """
    nested = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("text"))
    return with_counts(nested).withColumns({"base_failed": base_failed(F.col), "kept": verdict(rules, F.col)})


def quality_digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, counts, base_failed and kept of each row; extra columns are ignored."""
    rows = judged(docs.select("doc_id", "text"), fit_rules(docs, labels, **options))
    return rows.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the base and the learned rules keep, with their own columns."""
    rules = fit_rules(docs, labels, **options)
    return docs.filter(let(counts(F.col("text")), lambda c: verdict(rules, lambda name: c[name])))
