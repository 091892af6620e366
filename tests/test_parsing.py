import pytest
from pyspark.sql import functions as F

from tributary.functions import actors, answers, diffs, patches, references, text


def value(spark, raw, expression, kind="string"):
    return spark.createDataFrame([(raw,)], f"x {kind}").select(expression(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize("raw, label", [
    ("DECISION: MERGE\nCONFIDENCE: 0.8", "MERGE"),
    ("maybe merge\n**DECISION: CLOSE**", "CLOSE"),
    ("DECISION: not closed, so MERGE", "MERGE"),
    ("decision = no", "CLOSE"),
    ("DECISION:\n  approved", "MERGE"),
    ("DECISION: merge\nlater DECISION: unclear", None),
    ("It was disclosed that yes", None),
    ("therefore it will be merged.\n\n  ", "MERGE"),
    ("merge this\nno verdict here", None),
    ("   ", None), (None, None),
])
def test_decision(spark, raw, label):
    assert value(spark, raw, answers.decision) == label


@pytest.mark.parametrize("raw, expected", [
    ("CONFIDENCE: 85%", 0.85), ("confidence= .4", 0.4), ("Confidence: 7", 1.0), ("none", None)])
def test_confidence(spark, raw, expected):
    assert value(spark, raw, answers.confidence) == expected


@pytest.mark.parametrize("raw, items", [
    ("x\n<review>\n- one\n\n2) two\n</review> tail", ["one", "two"]),
    ("pre <REVIEW>\n* one\n• two", ["one", "two"]),
    ("just prose\r\n-not a bullet", ["just prose", "-not a bullet"]),
    ("", []),
])
def test_review_comments(spark, raw, items):
    assert value(spark, raw, answers.review_comments) == items


def test_issue_references(spark):
    raw = "Fixes #12, closes: GH-3 and https://github.com/a/b/issues/9; see x#5, a/#6, #12 and #7"
    assert value(spark, raw, references.closing_references) == [12, 3, 9]
    assert value(spark, raw, references.mentioned_references) == [7]


def test_hunk_headings_are_distinct_and_limited(spark):
    patch = "\n".join(f"@@ -1 +1 @@ f{i % 7}()\n+x" for i in range(20))
    assert value(spark, patch, references.hunk_headings) == [f"f{i}()" for i in range(5)]


@pytest.mark.parametrize("login, kind, category", [
    ("Copilot", "Bot", "ai_coding_agent"), ("devin-ai-integration[bot]", "User", "ai_coding_agent"),
    ("coderabbitai", "Bot", "ai_review_bot"), ("dependabot[bot]", "Bot", "other_bot"), ("ann", "User", "human"),
    ("ann", None, "unknown"), (None, None, "unknown"),
])
def test_classify_actor(spark, login, kind, category):
    row = spark.createDataFrame([(login, kind)], "a string, b string").select(actors.classify_actor(F.col("a"), F.col("b")).alias("v")).first()
    assert row["v"]["category"] == category


def test_post_images(spark):
    patch = "@@ -1,2 +1,2 @@ f\n-a\n+b\n c\n\\ No newline\n@@ -9 +9 @@\n-only\n@@ -10 +9 @@\nodd\n"
    assert value(spark, patch, patches.post_images) == ["b\nc", "odd"]
    assert value(spark, None, patches.hunk_count) == 0


def test_words_and_lines(spark):
    assert value(spark, " a b\n c ", text.words) == 3
    assert value(spark, "", text.words) == 0
    assert value(spark, "a\r\nb\x0bc\n", text.lines) == ["a", "b", "c"]


def test_response_key_equals_canonical_json(spark):
    import hashlib
    import json

    from tributary.operators.replay import prompt_key, transcript_key

    user = 'a "quoted" \\ line\nnext\tétoile'
    payload = {"model": "m", "system": "s", "user": user, "temperature": 0.2, "max_output_tokens": 512}
    expected = hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    settings = (F.lit("m"), F.lit("s"))
    got = value(spark, user, lambda x: prompt_key(*settings, x, F.lit(0.2), F.lit(512)))
    assert got == expected
    talk = {"model": "m", "system": "s", "temperature": 0.2, "max_output_tokens": 512,
            "messages": [{"role": "user", "content": user}, {"role": "assistant", "content": "ok"}]}
    expected = hashlib.sha256(json.dumps(talk, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    got = value(spark, user, lambda x: transcript_key(*settings, [("user", x), ("assistant", F.lit("ok"))], F.lit(0.2), F.lit(512)))
    assert got == expected


DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,3 +1,3 @@ def f
 def helper(x):
-    return 0
+    return total(x)
 tail
diff --git a/old.ts b/new.ts
similarity index 100%
rename from old.ts
rename to new.ts
"""


def test_parse_blocks(spark):
    rows = value(spark, DIFF, lambda d: F.transform(diffs.file_blocks(d), diffs.parse_block))
    assert [(r["filename"], r["status"], r["additions"], r["deletions"]) for r in rows] == [("src/a.py", "modified", 1, 1), ("new.ts", "renamed", 0, 0)]
    assert rows[0]["patch"].startswith("@@ -1,3") and rows[0]["patch"].endswith(" tail")


@pytest.mark.parametrize("comment, expected", [
    ("`helper` in a.py", ("src/a.py", 1, "line")),
    ("a.py line 2 is odd", ("src/a.py", 2, "line")),
    ("a.py line 99 is odd", ("src/a.py", 1, "file")),
    ("`total` overflows", ("src/a.py", 2, "line")),
    ("looks fine", None),
])
def test_anchor(spark, comment, expected):
    frame = spark.createDataFrame([(comment, DIFF)], "c string, d string").select("c", diffs.file_maps(F.col("d")).alias("f"))
    row = frame.withColumn("n", diffs.named_file(F.col("c"), F.col("f"))).select(diffs.anchor(F.col("c"), F.col("f"), F.col("n")).alias("v")).first()["v"]
    got = None if row is None else (row["path"], row["line"], row["precision"])
    if expected and expected[2] == "file":
        assert got[0] == expected[0] and got[2] == "file"
    else:
        assert got == expected


def test_lines_of_a_diff_are_numbered_once(spark):
    """Each place that names the numbered lines would work them out again for every file."""
    frame = spark.createDataFrame([(DIFF,)], "d string").select(diffs.file_maps(F.col("d")).alias("f"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.count("flatten(") == 1


def test_structure_counts_equal_their_patterns(spark):
    import re

    raw = ["", "a", " \t if (x_1) {\n\tdef f(é, ...):\n\n  [", "))((", "]\t\n\n \t\t x\u2028y  ", "é̀ß+\r\n--9a"]
    rows = spark.createDataFrame([(t,) for t in raw], "t string").select(
        "t", patches.hunk_tokens(F.col("t")).alias("tokens"), patches.hunk_depth(F.col("t")).alias("depth"), patches.hunk_balanced(F.col("t")).alias("balanced")).collect()
    for row in rows:
        t = row["t"]
        indents = [re.match(r"[ \t]*", line)[0].replace("\t", "    ") for line in t.split("\n")]
        assert row["tokens"] == len(re.findall(r"(?a)\w+|[^\s\w]", t)), t
        assert row["depth"] == 1 + max(map(len, indents)) // 4, t
        assert row["balanced"] == all(t.count(a) == t.count(b) for a, b in ("()", "[]", "{}")), t


def test_diff_features_parse_a_diff_once(spark):
    from tributary.operators.diffs import diff_features

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def changed(name):
        calls.add(1)
        return f"diff --git a/{name}.py b/{name}.py\n--- a/{name}.py\n+++ b/{name}.py\n@@ -1 +1,2 @@\n-x\n+if x:\n+    y()\n"

    table = spark.createDataFrame([(i, f"n{i}", "t", None) for i in range(8)], "diff_id long, name string, title string, description string")
    rows = diff_features(table.select("diff_id", changed("name").alias("diff"), "title", "description")).collect()
    assert {(r["m_additions"], r["m_deletions"], r["m_changed_files"], r["m_num_hunks"], r["m_files_modified"]) for r in rows} == {(2, 1, 1, 1, 1)}
    assert len(rows) == 8 and calls.value == 8
