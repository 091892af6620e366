"""Quality rules with thresholds that adapt to language and source.

Base counts of a text decide the base rules.  Beyond them, four rates are compared with fences: the quartiles of
the rate among documents of the same language and source, widened by three times their distance and a
tolerance.  Quartiles come from a quantile sketch, the number of documents by bucket of the rate; a bucket is 1/32
of its value wide at most.  Sketches merge by adding counts: tasks merge into groups, sources into languages,
and languages into the whole.  A group of under ``LEAST_ROWS`` documents uses the sketch of its language, or
else of the whole.

Null language and source are groups of their own.  A null or empty text has zero counts, fails the base rules
and enters no sketch.  Repeated rows count each.  Extra columns are ignored.  An empty table gives no rows; texts of any length are
counted whole; a rate that equals its fence passes.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import Columns, map_columns, words_of
from tributary.llm.registry import query, table
from tributary.session import cut_lineage

#: Base rules: least words, and the most words in repeated windows, in percent.
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rates as whole numbers, (numerator, factor, denominator), and the tolerance that each fence gets besides.
RATES = {
    "symbols": ("n_symbols", 1000, "n_words", 100),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 500),
    "repeats": ("n_repeat_words", 1000, "n_words", 350),
    "word_length": ("word_chars", 100, "n_words", 150),
}
#: Rates with a lower fence too.
TWO_SIDED = ["word_length"]
FENCE = 3
LEAST_ROWS = 200
#: Groups whose fences every task may hold; more are joined by shuffle.
HELD_GROUPS = 50_000


def repeated_words(words: list) -> int:
    """Words in windows of ``WINDOW`` words that are found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    found, covered = Counter(windows), bytearray(len(words))
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered[at:at + WINDOW] = b"\x01" * WINDOW
    return sum(covered)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def step(batch: Columns) -> Columns:
        out: Columns = {"doc_id": batch["doc_id"], "lang": batch["lang"], "source": batch["source"], **{name: [] for name in names}}
        for text in batch["text"]:
            text = text or ""
            words = words_of(text)
            lines = [line for line in text.split("\n") if line.strip(SPACES)]
            out["n_words"].append(len(words))
            out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
            out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
            out["n_lines"].append(len(lines))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(repeated_words(words))
        return out

    fields = {"doc_id": "long", "lang": "string", "source": "string", **{name: "long" for name in names}}
    return map_columns(docs.select("doc_id", "text", "lang", "source"), fields, lambda: step)


def rate(name: str) -> Column:
    above, factor, below, _ = RATES[name]
    return F.floor(F.col(above) * factor / F.greatest(F.col(below), F.lit(1)))


def bucket(value: Column) -> Column:
    """Number of the bucket: 64 steps for each power of two, of which the upper 32 are used beyond the first."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 64 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_start(number: Column) -> Column:
    return ((number % 64) * F.pow(F.lit(2.0), F.floor(number / 64))).cast("long")


def sketches(counted: DataFrame) -> DataFrame:
    """Documents by level (2 language and source, 1 language, 0 all), group, rate and bucket."""
    rates = F.array(*[F.struct(F.lit(name).alias("rate"), bucket(rate(name)).alias("bucket")) for name in RATES])
    cells = counted.filter("n_words > 0").select("lang", "source", F.explode(rates).alias("x")).groupBy(
        "lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))
    nothing = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), nothing.alias("source")),
        F.struct(F.lit(0).alias("level"), nothing.alias("lang"), nothing.alias("source")),
    )
    return cells.select(F.explode(levels).alias("g"), "rate", "bucket", "n").groupBy(
        "g.level", "g.lang", "g.source", "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """``low`` and ``high`` of each rate (arrays in the order of RATES) for every language and source."""
    cells = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    grouped = sketch.groupBy("level", "lang", "source", "rate").agg(F.sum("n").alias("total"), cells.alias("cells"))

    def quartile(k: int) -> Column:
        empty = F.struct(F.lit(0).cast("long").alias("below"), F.lit(-1).cast("long").alias("at"))
        walk = F.aggregate("cells", empty, lambda seen, cell: F.struct(
            (seen["below"] + cell["n"]).alias("below"),
            F.when((seen["at"] < 0) & ((seen["below"] + cell["n"]) * 4 >= F.col("total") * k), cell["bucket"]).otherwise(seen["at"]).alias("at")))
        return bucket_start(walk["at"])

    reach = F.lit(0)
    for name, (*_, tolerance) in RATES.items():
        reach = F.when(F.col("rate") == name, tolerance).otherwise(reach)
    quartiles = grouped.select("level", "lang", "source", "rate", "total", quartile(1).alias("q1"), quartile(3).alias("q3"))
    margins = quartiles.withColumn("margin", FENCE * (F.col("q3") - F.col("q1")) + reach)
    low = F.when(F.col("rate").isin(TWO_SIDED), F.col("q1") - F.col("margin")).otherwise(F.lit(-1))
    fence = F.struct("rate", low.alias("low"), (F.col("q3") + F.col("margin")).alias("high"))
    tables = margins.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(fence)).alias("fences"))
    tables = cut_lineage(tables)
    own, by_lang = (tables.filter(F.col("level") == level).alias(f"l{level}") for level in (2, 1))
    whole = tables.filter("level = 0").first()  # one row, of a fence for each rate
    general = F.array(*[F.struct(F.lit(f.rate).alias("rate"), F.lit(f.low).cast("long").alias("low"), F.lit(f.high).cast("long").alias("high"))
                        for f in (whole.fences if whole else [])]).cast(tables.schema["fences"].dataType)
    chosen = own.join(by_lang, F.col("l2.lang").eqNullSafe(F.col("l1.lang")), "left")
    best = F.when(F.col("l2.total") >= LEAST_ROWS, F.col("l2.fences")).when(F.col("l1.total") >= LEAST_ROWS, F.col("l1.fences")).otherwise(general)
    return chosen.select(F.col("l2.lang").alias("lang"), F.col("l2.source").alias("source"), best.alias("fences"))


def judge(docs: DataFrame, held_groups: int = HELD_GROUPS) -> DataFrame:
    """Counts, ``base_failed``, the rates outside their fences (``outside``) and ``kept`` of every row."""
    counted = cut_lineage(counts(docs))
    found = cut_lineage(fences(sketches(counted)).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "fences"))
    if found.count() <= held_groups:
        found = F.broadcast(found)
    joined = counted.join(found, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    names = sorted(RATES)  # the order of the sorted fences
    outside = F.array(*[
        F.when((rate(name) < F.col("fences")[i]["low"]) | (rate(name) > F.col("fences")[i]["high"]), F.lit(name)) for i, name in enumerate(names)
    ])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        joined.withColumn("base_failed", failed)
        .withColumn("outside", F.array_join(F.array_compact(outside), ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))
        .drop("fences", "g_lang", "g_source")
    )


_WORD = r"[^\x20\x09-\x0D]"
_SQL_RATES = ", ".join(f"({above} * {factor}) // greatest({below}, 1) AS r_{name}" for name, (above, factor, below, _) in RATES.items())
_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
listed AS (SELECT *, regexp_extract_all(text, '{_WORD}+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
windows AS (SELECT r, i, words[i:i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM listed)),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM found WHERE times > 1) GROUP BY r),
counted AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM listed LEFT JOIN covered USING (r)),
rated AS (SELECT *, {_SQL_RATES} FROM counted),
long AS (SELECT lang, source, unnest([{", ".join(f"'{n}'" for n in RATES)}]) AS rate, unnest([{", ".join(f"r_{n}" for n in RATES)}]) AS v
    FROM rated WHERE n_words > 0),
cells AS (SELECT lang, source, rate, s * 64 + (v >> s) AS bucket FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS s FROM long)),
levels AS (SELECT 2 AS level, lang, source, rate, bucket FROM cells UNION ALL SELECT 1, lang, NULL, rate, bucket FROM cells
    UNION ALL SELECT 0, NULL, NULL, rate, bucket FROM cells),
sketch AS (SELECT level, lang, source, rate, bucket, count(*) AS n FROM levels GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS below,
    sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM sketch),
quartiles AS (SELECT level, lang, source, rate, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bucket END) AS b1,
    min(CASE WHEN below * 4 >= total * 3 THEN bucket END) AS b3 FROM summed GROUP BY ALL),
starts AS (SELECT level, lang, source, rate, total, (b1 % 64) << (b1 // 64) AS q1, (b3 % 64) << (b3 // 64) AS q3 FROM quartiles),
fenced AS (SELECT level, lang, source, rate, total, CASE WHEN rate IN ({", ".join(f"'{n}'" for n in TWO_SIDED)}) THEN q1 - m ELSE -1 END AS low, q3 + m AS high
    FROM (SELECT *, {FENCE} * (q3 - q1) + CASE rate {" ".join(f"WHEN '{n}' THEN {t}" for n, (*_, t) in RATES.items())} END AS m FROM starts)),
chosen AS (SELECT a.lang, a.source, a.rate,
    CASE WHEN a.total >= {LEAST_ROWS} THEN a.low WHEN b.total >= {LEAST_ROWS} THEN b.low ELSE c.low END AS low,
    CASE WHEN a.total >= {LEAST_ROWS} THEN a.high WHEN b.total >= {LEAST_ROWS} THEN b.high ELSE c.high END AS high
    FROM fenced a JOIN fenced b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate
    JOIN fenced c ON c.level = 0 AND a.rate = c.rate WHERE a.level = 2),
wide AS (SELECT lang, source, {", ".join(f"max(CASE WHEN rate = '{n}' THEN low END) AS low_{n}, max(CASE WHEN rate = '{n}' THEN high END) AS high_{n}" for n in RATES)}
    FROM chosen GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {" AND ".join(f"r_{n} >= low_{n} AND r_{n} <= high_{n}" for n in RATES)} AS kept
FROM (SELECT r.*, w.* EXCLUDE (lang, source), n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
    FROM rated r LEFT JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source)
"""


@query("op1_quality_rules", sql=_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
