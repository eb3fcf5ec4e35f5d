"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (fixed rules): email, ip, card (Luhn), phone. They are always reported. The method adds iban (mod-97), amex
(15 digits, Luhn) and ssn; an added span is reported if its score, raised by context words within ``CONTEXT`` characters
on either side, is at least ``least``. Offsets are code points, ends exclusive; matches of a kind are leftmost and do not
overlap, and one that fails its check is dropped.

Null text counts as empty and has no spans. Very long texts are searched whole: the patterns cannot backtrack over more
than one run of their characters, and places are summed up in blocks, so many matches in one text stay cheap. Repeated rows give equal results. Empty table: no rows. Extra columns are ignored.

Only DataFrame functions are used. The positions of matches come from the lengths of what ``split`` leaves between them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
#: The base patterns, written so that a search never starts twice in one run of characters. ``\G`` keeps
#: a match that begins where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)

    def add(total, i):
        d = F.substr(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters go last, letters count from 10."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), step) == 1


def short_parts(match: Column) -> Column:
    """Whether all four numbers are at most 255, however many leading zeros they have."""
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """``ok`` checks a match; ``score`` is its confidence before context; ``words`` are the context words."""

    name: str
    pattern: str
    ok: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


def long_between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(low, high)


KINDS = [
    Kind("email", EMAIL, lambda m: F.lit(True), 0.9, "mail|contact|courriel|correo|write"),
    Kind("ip", IP, short_parts, 0.6, r"\bip\b|address|adresse|host|server"),
    Kind("card", CARD, lambda m: F.when(long_between(16, 19)(m), luhn(digits(m))).otherwise(False), 0.8, "card|karte|carte|tarjeta|visa|credit"),
    Kind("phone", PHONE, long_between(8, 15), 0.6, "phone|call|tel|mobil|fax"),
    Kind("iban", IBAN, mod97, 0.9, "iban|account|konto|compte|cuenta|bank", base=False),
    Kind("amex", CARD, lambda m: F.when(digits(m).rlike("^3[47][0-9]{13}$"), luhn(digits(m))).otherwise(False), 0.5, "card|karte|carte|tarjeta|amex|credit", base=False),
    Kind("ssn", SSN, lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, r"\bssn\b|social security", base=False),
]
SPAN = "array<struct<start:int,end:int,match:string>>"


#: Matches whose places are summed up together; a list of n is handled in about n * BLOCK / 2 steps.
BLOCK = 256


def matched(text: Column, pattern: str) -> Column:
    """All matches, each with the length of the text since the one before. ``split`` gives the text between matches, one entry
    more than there are matches."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    return F.when(text.rlike(pattern), pairs)


def blocks(pairs: Column) -> Column:
    """The matches in blocks, with the length of text that each block covers; null without matches."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK))

    def covered(part):
        return F.aggregate(part, F.lit(0), lambda total, p: total + p["gap"] + F.length(p["match"]))

    return F.when(pairs.isNotNull() & (F.size(pairs) > 0), F.transform(parts, lambda part: F.struct(part.alias("part"), covered(part).alias("covered"))))


def begins(blocked: Column) -> Column:
    """Where each block begins."""

    def step(acc, block):
        return F.struct((acc["at"] + block["covered"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))

    return F.aggregate(blocked, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])


def located(blocked: Column, starts: Column) -> Column:
    """All matches with their places."""

    def step(acc, pair):
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    def within(block, at):
        return F.aggregate(block["part"], F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])

    return F.coalesce(F.flatten(F.zip_with(blocked, starts, within)), F.array().cast(SPAN))


def scored(text: Column, kind: Kind) -> Callable[[Column], Column]:
    """Adds kind and score to a span: 0.25 more where a context word is near."""

    def add(span: Column) -> Column:
        from_ = F.greatest(span["start"] - CONTEXT, F.lit(0))
        before = F.substr(text, from_ + 1, span["start"] - from_)
        after = F.substr(text, span["end"] + 1, F.lit(CONTEXT))
        near = F.lower(F.concat_ws(" ", before, after)).rlike(kind.words)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.25).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), score.alias("score"))

    return add


def checked(kind: Kind) -> Callable[[Column], Column]:
    return lambda span: kind.ok(span["match"])


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Columns doc_id and one array per kind of (kind, start, end, score)."""
    raw = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = list(dict.fromkeys(k.pattern for k in KINDS))
    names = [f"p{i}" for i in range(len(patterns))]
    # one step after the other, so that no list is made twice
    raw = raw.select("*", *[matched(F.col("text"), p).alias(n) for n, p in zip(names, patterns)])
    raw = raw.select("doc_id", "text", *[blocks(F.col(n)).alias(n) for n in names])
    raw = raw.select("*", *[begins(F.col(n)).alias(f"{n}_at") for n in names])
    raw = raw.select("doc_id", "text", *[located(F.col(n), F.col(f"{n}_at")).alias(n) for n in names])
    columns = []
    for kind in KINDS:
        passed = F.filter(F.col(f"p{patterns.index(kind.pattern)}"), checked(kind))
        spans = F.transform(passed, scored(F.col("text"), kind))
        columns.append((spans if kind.base else F.filter(spans, lambda s: s["score"] >= least)).alias(kind.name))
    return raw.select("doc_id", *columns)


def written(spans: list[str]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, joined by commas."""
    every = F.concat(*[F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for c in spans])
    return F.array_join(every, ",")


def digest(found: DataFrame) -> DataFrame:
    base, every = [k.name for k in KINDS if k.base], [k.name for k in KINDS]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{c}") for c in base],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(every).alias("spans"),
    )
