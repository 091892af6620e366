import duckdb
import pytest
from helpers import SMALL, have_tables, rows

from tributary.llm import url_filters as u
from tributary.llm.registry import ORACLES, QUERIES

URLS = [
    "https://www.example.com/en/1", "https://example.com/en/1", "http://EXAMPLE.com/en", "http://a.b.example.com/en/x?y=/es/", "https://x.net/es/", "https://x.net/es",
    "https://net/fr/1", "https://notexample.com/en/", "https://foo.org/a/cheap-pills/b", "https://cheap-pills.foo.org", "https://cheap-pillsx.foo.org/", "no scheme", "", None,
    "https://com", "https://x.com?/en/", "https://x.com#a/b", "https:///path", "https://x.org/p?casino", "https://x.org/casino", "a://b://c/d", "https://x.org/" + "a/" * 5000,
]


def plain(url):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = rest[:n].lower()
        path = rest[n:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules(spark):
    docs = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0]), (None, None)], "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS token")
    out = rows(u.judge(docs))
    assert len(out) == len(URLS) + 2
    for page_id, host, path, rule, verdict in out:
        h, p, best = plain(URLS[page_id] if page_id is not None else None)
        assert (host, path, rule) == (h, p, best and best[0])
        assert verdict == (best[1] if best else "block" if page_id in (8, 9, 19) else "allow")
    assert u.judge(docs.limit(0)).count() == 0


def test_the_index_runs_only_rules_of_the_rarest_token():
    index = u.Index(u.RULES, {"com": 1000, "example": 5, "en": 400, "www": 700, "net": 3, "es": 2, "fr": 9, "cheap": 4, "pills": 1})
    names = {rule.name for _, rule, _ in index.candidates("shop.example.org", "/en/")}
    assert names == {"example.com/en/", "www.example.com/en/"}
    assert {rule.name for _, rule, _ in index.candidates("a.com", "/cheap")} == {"com/"}
    assert {rule.name for _, rule, _ in index.candidates("a.org", "/pills/net")} == {"cheap-pills", "net/fr/"}


def test_the_index_changes_no_verdict():
    class All(u.Index):
        def candidates(self, host, path):
            return [filed for found in self.by_token.values() for filed in found] + self.always

    some, every = u.Index(u.RULES, {}), All(u.RULES, {})
    for url in URLS:
        assert some.decide(*u.parts(url)) == every.decide(*u.parts(url))


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_sql(spark):
    frame = QUERIES["op6_url_filters"](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    result = connection.execute(ORACLES["op6_url_filters"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(rows(frame.select(*names)))


def test_thousands_of_rules_change_no_verdict_and_few_run():
    import random

    chance = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    rules = u.HOST_RULES + [u.phrase_rule(chance.choice(["block", "allow"]), "-".join(chance.sample(words, chance.randint(1, 3)))) for _ in range(5000)]
    urls = [f"https://{'-'.join(chance.choices(words, k=3))}.{chance.choice(['org', 'net', 'com'])}/{'/'.join(chance.choices(words, k=4))}" for _ in range(150)]
    frequency = dict(u.Counter(t for url in urls for part in u.parts(url) for t in set(u.TOKEN.findall(part))))
    index = u.Index(rules, frequency)

    class All(u.Index):
        def candidates(self, host, path):
            return [filed for found in self.by_token.values() for filed in found] + self.always

    every, run = All(rules, frequency), []
    for url in urls:
        host, path = u.parts(url)
        assert index.decide(host, path) == every.decide(host, path)
        run.append(len(index.candidates(host, path)))
    assert sum(run) / len(run) < 60  # of more than 5000


def test_the_rule_file():
    names = [rule.name for rule in u.PHRASE_RULES]
    assert len(names) == len(set(names)) > 150 and all(rule.literals for rule in u.PHRASE_RULES)
    assert u.phrases_of(["# kind", "", " a-b ", "a-b", "c"]) == ["a-b", "c"]
    index = u.Index(u.RULES, {})
    for url, verdict in [("http://free-bets.x.org/1", "block"), ("http://x.org/adult-cams/1", "block"), ("http://x.org/adult-education/", "allow"), ("http://x.org/essays", "allow"),
                         ("http://pokerface.org/", "allow"), ("http://x.org/online-poker.html", "block")]:
        assert index.decide(*u.parts(url))[1] == verdict, url
