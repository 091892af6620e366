"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a pattern over host and path and the literal tokens that every match of it must hold.  It is filed
under the token that is rarest in the table of URLs (counted for the rules' tokens alone, ties by name).  A URL's
own tokens fetch the rules filed under them, and only those run their regular expressions.  Host rules come
first: of those that fit, the longest decides; pattern rules decide for URLs that no host rule fits; the rest is allowed.

The rules are a parameter of the call, a list in the driver that every task holds.  A null URL, or one without
``://``, has an empty host and path, fits no rule and is allowed.  Repeated rows are judged each; extra columns
are ignored; an empty table gives no rows; URLs of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import Columns, map_columns
from tributary.llm.registry import query, table

TOKEN = re.compile("[a-zA-Z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` orders and reports the rule; ``host_rule``: the longest name wins, else the first in the list."""

    verdict: str
    name: str
    pattern: str
    literals: tuple[str, ...]
    host_rule: bool = False


def host_rule(verdict: str, name: str) -> Rule:
    """A rule ``host/path``: that host and its subdomains, paths that start with the path."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    # a path token is sure to be whole in a URL only if another sign follows it in the rule
    whole = [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(verdict, name, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*TOKEN.findall(host), *whole), True)


def phrase_rule(verdict: str, phrase: str) -> Rule:
    """A rule for words joined by ``-`` that stand alone between separators, in host or path."""
    return Rule(verdict, phrase, rf"(?:^|[./_-]){re.escape(phrase)}(?:[./_-]|$)", tuple(TOKEN.findall(phrase)))


# The host rules.  The phrases are in url_rules.txt.
HOST_RULES = [
    host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"), host_rule("block", "net/fr/"),
]


def phrases_of(lines: Iterable[str]) -> list[str]:
    """Phrases, one a line; blank lines and those that begin with ``#`` are passed over, repeated ones kept once."""
    return list(dict.fromkeys(line.strip() for line in lines if line.strip() and not line.startswith("#")))


PHRASE_RULES = [phrase_rule("block", phrase) for phrase in phrases_of(Path(__file__).with_name("url_rules.txt").read_text().splitlines())]
RULES = HOST_RULES + PHRASE_RULES


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


class Index:
    """Rules by the rarest of their tokens; rules without a literal are tried for every URL."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[int, Rule, re.Pattern]] = []
        for order, rule in enumerate(rules):
            filed = (order, rule, re.compile(rule.pattern))
            if rule.literals:
                self.by_token[min(rule.literals, key=lambda t: (frequency.get(t, 0), t))].append(filed)
            else:
                self.always.append(filed)

    def candidates(self, host: str, path: str) -> list[tuple[int, Rule, re.Pattern]]:
        tokens = set(TOKEN.findall(host)) | set(TOKEN.findall(path))
        return [filed for token in tokens if token in self.by_token for filed in self.by_token[token]] + self.always

    def decide(self, host: str, path: str) -> tuple[str | None, str]:
        """The host rule that decides (or none) and the verdict."""
        subject = host + path
        fits = [(order, rule) for order, rule, pattern in self.candidates(host, path) if pattern.search(subject)]
        hosts = [rule for _, rule in fits if rule.host_rule]
        if hosts:
            best = max(hosts, key=lambda rule: (len(rule.name), rule.name))
            return best.name, best.verdict
        return None, min(fits, key=lambda fit: fit[0])[1].verdict if fits else "allow"


def token_frequency(urls: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """Rows of ``urls`` that hold each token of the rules; the result has a row for each such token at most."""
    wanted = {token for rule in rules for token in rule.literals}

    def start():
        def step(batch: Columns) -> Columns:
            found = Counter(token for value in batch["url"] for token in wanted.intersection(
                t for part in parts(value) for t in TOKEN.findall(part)))
            return {"token": list(found), "n": list(found.values())}

        return step

    counted = map_columns(urls.select(F.col(url).alias("url")), {"token": "string", "n": "long"}, start)
    return {row.token: row.n for row in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge(urls: DataFrame, rules: list[Rule] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule and verdict of every row."""
    rules = RULES if rules is None else rules
    frequency = token_frequency(urls, rules, url)

    def start():
        index = Index(rules, frequency)

        def step(batch: Columns) -> Columns:
            split = [parts(value) for value in batch["url"]]
            decided = [index.decide(host, path) for host, path in split]
            return {key: batch[key], "host": [h for h, _ in split], "path": [p for _, p in split],
                    "rule": [r for r, _ in decided], "verdict": [v for _, v in decided]}

        return step

    fields = {key: "long", "host": "string", "path": "string", "rule": "string", "verdict": "string"}
    return map_columns(urls.select(key, F.col(url).alias("url")), fields, start)


def _sql() -> str:
    host = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{rule.name}'"
        for rule in sorted(HOST_RULES, key=lambda r: -len(r.name)) for h, p in [(rule.name.split("/", 1)[0], "/" + rule.name.split("/", 1)[1])])
    verdicts = " ".join(f"WHEN '{rule.name}' THEN '{rule.verdict}'" for rule in HOST_RULES)
    phrases = "|".join(rule.pattern for rule in PHRASE_RULES)
    return rf"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, CASE {fits} END AS rule FROM split)
SELECT page_id, host, path, rule,
    CASE rule {verdicts} ELSE CASE WHEN regexp_matches(host || path, '{phrases}') THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""


@query("op6_url_filters", sql=_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
