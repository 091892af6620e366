"""Personal data by weak supervision.

Patterns propose spans.  Five labelers vote on each span, for or against, or abstain: the strictness of its form
(regex), lists of reserved and well-known values (gazetteer), cue words before it (context), what touches it
(boundary), and the variety of its digits (variety).  Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; no label is needed.  The expected labels then train the span classifier, a naive Bayes
over kind, length, cue, neighbours and digits, which decides which proposed spans are added to the base spans.

DataFrame functions only; rows stay where they are, and only counts by vote pattern or feature value (bounded by
the labelers and features) reach the driver.  A null text counts as empty.  Repeated rows are reported, and counted, each.
Extra columns are ignored.  An empty table gives no rows; texts of any length are read whole; spans that start together are ordered by kind.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.registry import query, table
from tributary.session import cut_lineage

# Kinds in the order in which they are listed, base kinds first.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "local_phone", "iban", "short_card", "person"]

#: A match has to start where a plain left-to-right search would: not inside a run of its own signs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+().-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,4}(?![\x20-]?[0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?(?![a-z])",
}
#: A cheap test that every text with a match passes.
SIGNS = {
    "email": "@", "ip": ".", "card": None, "phone": "+", "ssn": "-", "local_phone": None, "iban": None, "short_card": None, "person": None,
}
GUARDS = {
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "ip": r"[0-9]\.[0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "local_phone": r"[0-9]{3}[.-][0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}", "short_card": r"[0-9]{4}[\x20-][0-9]{4}",
    "person": r"(?:r|s|of|rau|ra|me)\.?\x20[A-Z][a-z]",
}
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel", "ip": "ip|address|host|server|adresse", "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|cell", "ssn": "ssn|social|security", "local_phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|account|bank|konto|cuenta|compte", "short_card": "card|visa|credit|karte|tarjeta|carte", "person": "name|patient|client|from|signed",
}
AGAINST = "version|release|isbn|order|invoice|serial|section|part no|build"
#: Characters before and after a span that labelers see.
BEFORE, AFTER = 24, 1
LABELERS = ["regex", "gazetteer", "context", "boundary", "variety"]
ROUNDS = 12
SPAN = "struct<start:int,order:int,kind:string,end:int>"


def located(text: Column, kind: str) -> Column:
    """Array of (start, value) of the pattern's matches.  Matches and the pieces between them give the places:
    a match starts after all that comes before it, in code points."""
    pattern = PATTERNS[kind]
    empty = F.array().cast("array<struct<start:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(seen: Column, both: Column) -> Column:
        start = seen["at"] + F.length(both["gap"])
        found = F.struct(
            (start + F.length(both["value"])).alias("at"),
            F.concat(seen["out"], F.array(F.struct(start.alias("start"), both["value"].alias("value")))).alias("out"))
        return F.when(both["value"].isNull(), seen).otherwise(found)

    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")))
    matches = F.aggregate(pairs, state, step, lambda seen: seen["out"])
    possible = F.lit(True)
    if SIGNS[kind]:
        possible = F.contains(text, F.lit(SIGNS[kind]))
    if kind in GUARDS:
        possible = possible & text.rlike(GUARDS[kind])
    return F.when(possible, matches).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits pass the check: every second one from the right doubled, the sum a multiple of ten."""
    signs = F.reverse(digits(value))
    total = F.aggregate(F.sequence(F.lit(1), F.length(signs)), F.lit(0), lambda sum_, place: sum_ + F.when(
        place % 2 == 1, F.substring(signs, place, F.lit(1)).cast("int")
    ).otherwise(F.substring(F.lit("0246813579"), F.substring(signs, place, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts for its kind."""
    size = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= F.lit(3)) & F.forall(
            F.split(value, r"\."), lambda part: F.coalesce(F.substring(F.concat(F.lit("000"), part), -3, 3).cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return size.between(14, 19) & luhn(value)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def proposed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans``: start, order, kind, end, base, value, and what stands before and after, of every valid match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col(key).alias("key"), text.alias("text"))
    found = found.select("key", "text", *[located(F.col("text"), kind).alias(kind) for kind in KINDS])

    def spans(kind: str) -> Column:
        kept = F.filter(kind, lambda x: valid(kind, x["value"]))
        end = lambda x: x["start"] + F.length(x["value"])
        from_ = lambda x: F.greatest(x["start"] - BEFORE, F.lit(0))
        return F.transform(kept, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), end(x).alias("end"),
            F.lit(kind in BASE).alias("base"), x["value"].alias("value"),
            F.substring(F.col("text"), from_(x) + 1, x["start"] - from_(x)).alias("before"),
            F.substring(F.col("text"), end(x) + 1, F.lit(AFTER)).alias("after")))

    return cut_lineage(found.select("key", F.array_sort(F.concat(*[spans(kind) for kind in KINDS])).alias("spans")))


def _by_kind(kind: Column, of: dict[str, Column], other: Column) -> Column:
    return reduce(lambda rest, name: F.when(kind == name, of[name]).otherwise(rest), of, other)


def votes(span: Column) -> Column:
    """A vote of each labeler: 1 for, 0 against, -1 abstains."""
    value, kind, before = span["value"], span["kind"], F.lower(span["before"])
    number = digits(value)
    yes, no, none = F.lit(1), F.lit(0), F.lit(-1)
    form = _by_kind(kind, {
        "email": F.when(value.rlike(r"\.[A-Za-z]{2,}$"), yes).otherwise(no),
        "ip": F.when(value.rlike(r"^0|\.0[0-9]"), no).otherwise(yes),
        "card": F.when(value.rlike("^[3-6]"), yes).otherwise(no),
        "phone": F.when(value.rlike(r"^\+[1-9]"), yes).otherwise(no),
        "ssn": F.when(value.rlike("^(000|666|9)|-00-|-0000$"), no).otherwise(yes),
        "local_phone": F.when(value.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"), yes).otherwise(no),
        "short_card": F.when(F.length(number).between(14, 19) & luhn(value), yes).otherwise(no),
        "iban": F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), yes).otherwise(no),
    }, none)
    listed = _by_kind(kind, {
        "email": F.when(F.lower(value).rlike(r"@(gmail|yahoo|hotmail|outlook|mail[0-9]*)\."), yes).when(F.lower(value).rlike(r"^(noreply|no-reply|info|admin|support)@"), no).otherwise(none),
        "ip": F.when(value.rlike(r"^(0|10|127|192\.168|255|22[4-9]|23[0-9])\."), no).otherwise(none),
        "phone": F.when(value.rlike(r"^\+(1|33|34|49|44)[^0-9]"), yes).otherwise(none),
        "iban": F.when(value.rlike("^(DE|FR|ES|GB|IT|NL|BE|AT|CH)"), yes).otherwise(no),
    }, none)
    cued = _by_kind(kind, {name: before.rlike(f"(?:{words})[a-z]{{0,8}}[^a-z0-9]{{0,6}}$") for name, words in CUES.items()}, F.lit(False))
    context = F.when(before.rlike(f"(?:{AGAINST})[^a-z0-9]{{0,6}}$"), no).when(cued, yes).otherwise(none)
    touched = before.rlike(r"[a-z0-9_/=.\\-]$") | span["after"].rlike(r"[A-Za-z0-9_/=\\-]")
    boundary = F.when(touched, no).otherwise(yes)
    kinds = F.size(F.array_distinct(F.split(number, "")))
    variety = F.when(F.length(number) < 5, none).when(kinds <= 2, no).otherwise(yes)
    return F.array(form, listed, context, boundary, variety)


def features(span: Column, cast: Column) -> Column:
    """Feature values of a span as texts, one list for all spans."""
    last = F.substring(span["before"], -1, 1)

    def sort_of(sign: Column) -> Column:
        return (F.when(sign == "", "edge").when(sign.rlike(r"\s"), "space").when(sign.rlike("[A-Za-z]"), "letter").when(sign.rlike("[0-9]"), "digit").otherwise("sign"))

    return F.concat(
        F.array(F.concat(F.lit("kind="), span["kind"]), F.concat(F.lit("last="), sort_of(last)), F.concat(F.lit("next="), sort_of(span["after"])),
                F.concat(F.lit("size="), F.least(F.length(span["value"]) / 4, F.lit(9)).cast("int").cast("string")),
                F.concat(F.lit("digits="), F.least(F.length(digits(span["value"])), F.lit(20)).cast("string"))),
        F.transform(cast, lambda vote, place: F.concat(F.lit("vote"), place.cast("string"), F.lit("="), vote.cast("string"))),
    )


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """By expectation-maximisation over (cast, n): the share of true spans, and of each labeler the chance
    that it votes for a true and for a false span, given that it votes."""
    share, chances = 0.5, [(0.8, 0.3)] * len(LABELERS)
    for _ in range(rounds):
        p, sums = posterior(share, chances), []
        for i in range(len(LABELERS)):
            vote = F.col("cast")[i]
            for weight in (F.col("n") * p, F.col("n") * (1 - p)):
                sums += [F.sum(F.when(vote == 1, weight).otherwise(0.0)), F.sum(F.when(vote >= 0, weight).otherwise(0.0))]
        row = patterns.agg(F.sum(F.col("n") * p), F.sum("n"), *sums).first()
        if not row[1]:
            return share, chances
        share = min(0.98, max(0.02, (row[0] + 1) / (row[1] + 2)))
        found = [min(0.98, max(0.02, (row[i] + 1) / (row[i + 1] + 2))) for i in range(2, len(row), 2)]
        chances = [(max(a, b), min(a, b)) for a, b in zip(found[::2], found[1::2])]  # a labeler is no worse than chance
    return share, chances


def posterior(share: float, chances: list[tuple[float, float]]) -> Column:
    """Chance that a span with the votes ``cast`` is true."""
    odds = F.lit(math.log(share / (1 - share)))
    for i, (true, false) in enumerate(chances):
        vote = F.col("cast")[i]
        odds = odds + F.when(vote == 1, math.log(true / false)).when(vote == 0, math.log((1 - true) / (1 - false))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def classifier(voted: DataFrame, share: float, chances: list[tuple[float, float]]) -> dict[str, float]:
    """Log odds of each feature value (key "" for the prior), from the expected labels of rows (cast, features, n)."""
    p = posterior(share, chances)
    soft = voted.select(F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("feature"), (F.col("n") * p).alias("true"), (F.col("n") * (1 - p)).alias("false"))
    rows = soft.groupBy("feature").agg(F.sum("true").alias("true"), F.sum("false").alias("false")).collect()
    whole = next(((r.true, r.false) for r in rows if not r.feature), (0.0, 0.0))
    prior = math.log((whole[0] + 1) / (whole[1] + 1))
    return {r.feature: math.log((r.true + 1) / (r.false + 1)) - prior for r in rows if r.feature} | {"": prior}


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans`` (start, order, kind, end): the base spans, and those that the classifier adds beside them."""
    found = proposed(docs, key)
    cast = found.select("key", F.transform("spans", lambda x: F.struct(x.alias("span"), votes(x).alias("cast"))).alias("voted"))
    full = cut_lineage(cast.select("key", F.transform("voted", lambda x: F.struct(
        *[x["span"][n].alias(n) for n in ("start", "order", "kind", "end", "base")], x["cast"].alias("cast"), features(x["span"], x["cast"]).alias("features"))).alias("voted")))
    each = full.select(F.explode("voted").alias("x"))
    voted = cut_lineage(each.groupBy("x.cast", "x.features").agg(F.count("*").alias("n")))
    patterns = cut_lineage(voted.groupBy("cast").agg(F.sum("n").alias("n")))
    share, chances = reliabilities(patterns)
    odds = classifier(voted, share, chances)
    table_ = F.create_map(*[F.lit(v) for pair in odds.items() for v in pair])
    score = lambda x: F.aggregate(x["features"], F.lit(odds[""]), lambda s, f: s + F.coalesce(F.element_at(table_, f), F.lit(0.0)))
    base = F.filter("voted", lambda x: x["base"])
    apart = lambda x: F.forall(base, lambda b: (b["end"] <= x["start"]) | (b["start"] >= x["end"]))
    added = F.filter("voted", lambda x: ~x["base"] & (score(x) > 0) & apart(x))
    kept = F.transform(F.concat(base, added), lambda x: F.struct(*[x[n].alias(n) for n in ("start", "order", "kind", "end")]))
    return full.select(F.col("key").alias(key), F.array_sort(kept).cast(f"array<{SPAN}>").alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The query's columns from the spans of each row."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    return found.select(key, *[of(kind).alias(f"n_{kind}") for kind in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))
