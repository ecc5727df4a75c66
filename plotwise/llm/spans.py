"""Character spans of pattern matches, from Spark's own text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwise.llm.common import let

EMPTY = "cast(array() as array<struct<start:int,end:int,match:string,before:string,after:string>>)"


def with_spans(df, text: str, name: str, pattern: str, needs: Column | None = None):
    """Add `name`: the leftmost non-overlapping matches as (start, end, match, before, after).

    Splitting by the pattern gives the text between the matches; the lengths of
    pieces and matches add up to the places, in code points, end exclusive.
    before and after are the neighbouring pieces, cut to 40 characters. `needs`
    is a cheap test that holds wherever the pattern can match.
    """
    none = F.expr("cast(array() as array<string>)")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    found = found if needs is None else F.when(needs, found).otherwise(none)

    def placed(m: Column, pieces: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            start = done["at"] + F.char_length(F.get(pieces, i))
            end = start + F.char_length(F.get(m, i))
            before, after = F.right(F.get(pieces, i), F.lit(40)), F.left(F.get(pieces, i + 1), F.lit(40))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(m, i).alias("match"), before.alias("before"), after.alias("after"))
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step, lambda done: done["out"])

    spans = let(found, lambda m: F.when(F.size(m) == 0, F.expr(EMPTY)).otherwise(let(F.split(F.col(text), pattern, -1), lambda pieces: placed(m, pieces))))
    return df.withColumn(name, spans)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
