"""Personal data: patterns propose, checksums confirm, context adjusts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import text_of, unused
from plotwise.llm.spans import digits_of, joined, with_spans

# fixed values -----------------------------------------------------------------
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "id"]
#: Where a pattern begins with a run of one class, a run can only match from its
#: first character or from the end of the last match; saying so, and not giving
#: back characters that can't help, keeps long texts linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])",
}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|correo|kontakt",
    "ip": r"(?i)\bip\b|host|server|address|adresse",
    "card": r"(?i)card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|ruf",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "id": r"(?i)ssn|social|security|identity|number",
}
#: Score of a confirmed span before context; context adds 0.3.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "id": 0.3}
#: Added kinds count from this score on; base kinds always stay.
THRESHOLD = 0.6
# ------------------------------------------------------------------------------


def luhn(digits: Column) -> Column:
    """Digits from the right, every second doubled, sum to a multiple of 10."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """First four characters moved to the end, letters as 10 to 35: remainder 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.when(value(c) > 9, (r * 100 + value(c)) % 97).otherwise((r * 10 + value(c)) % 97)
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda part: ~part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), mod97(match)).otherwise(F.lit(False))
    if kind == "id":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("^...[ -]00") & ~match.rlike("0000$")
    return F.lit(True)


def find_pii(docs: DataFrame) -> DataFrame:
    """`docs` and `pii`: an array of (kind, start, end, score), by kind as listed, then start.

    Places are code points of the whole text, end exclusive. Spans of base kinds
    stay whatever their score; IBANs and identity numbers stay from a score of
    0.6 on, which an identity number reaches by a context word only. Context is
    the 40 characters on each side up to the next proposal of the kind. NULL and
    empty texts have no spans, repeated rows the same ones; texts of any length are
    read whole. An existing column `pii` is replaced, others stay. An empty table
    gives an empty result.
    """
    text, found = unused(docs, "_text"), {kind: unused(docs, f"_{kind}") for kind in KINDS}
    rows = docs.withColumn(text, text_of())
    digit = F.col(text).rlike("[0-9]")
    needs = {"email": F.contains(F.col(text), F.lit("@")), "phone": F.contains(F.col(text), F.lit("+")) & digit}
    for kind in KINDS:
        rows = with_spans(rows, text, found[kind], PATTERNS[kind], needs.get(kind, digit))

    def scored(kind: str) -> Column:
        def one(s):
            near = s["before"].rlike(CONTEXT[kind]) | s["after"].rlike(CONTEXT[kind])
            score = F.round(F.lit(PRIOR[kind]) + F.when(near, F.lit(0.3)).otherwise(F.lit(0.0)), 2)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

        spans = F.transform(F.filter(F.col(found[kind]), lambda s: confirmed(kind, s["match"])), one)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    return rows.withColumn("pii", F.concat(*map(scored, KINDS))).drop(text, *found.values())


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans of each row."""
    rows = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        count("iban").alias("n_iban"),
        count("id").alias("n_id"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
