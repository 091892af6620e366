import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tributary.functions import answers
from tributary.operators import contexts, issues, prompts, replay, similar, textmetrics


def greedy(blocks, budget):
    total, kept = 0, []
    for block in blocks:
        if total + len(block) <= budget:
            kept.append(block)
            total += len(block)
    return kept


def test_packing_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    groups = {k: ["x" * rng.choice([1, 2, 5, 9, 30, 61]) + str(i) for i in range(n)] for k, n in (("a", 400), ("b", 3), ("c", 40))}
    rows = [(k, i, b) for k, bs in groups.items() for i, b in enumerate(bs)]
    frame = spark.createDataFrame(rows, "pr_id string, ord long, block string")
    got = {r["pr_id"]: r for r in contexts.pack(frame, "pr_id", ["ord"], 200, "|", shortest=2).collect()}
    for key, blocks in groups.items():
        kept = greedy(blocks, 200)
        assert got[key]["text"] == "|".join(kept)
        assert (got[key]["n_kept"], got[key]["n_blocks"]) == (len(kept), len(blocks))


def test_a_block_is_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def block(n):
        calls.add(1)
        return "x" * n

    frame = spark.createDataFrame([("a", i, i + 2) for i in range(20)], "pr_id string, ord long, n int").select("pr_id", "ord", block("n").alias("block"))
    assert contexts.pack(frame, "pr_id", ["ord"], 12, "|", shortest=2).first()["text"] == "xx|xxx|xxxx"
    assert calls.value == 20


def test_commit_numbers_keep_gaps(spark):
    rows = [("p", 0, "first"), ("p", 1, "  "), ("p", 2, None), ("p", 3, "last"), ("q", 0, " ")]
    frame = spark.createDataFrame(rows, "pr_id string, commit_ord long, message string")
    got = {r["pr_id"]: r["commit_message"] for r in contexts.commit_text(frame).collect()}
    assert got == {"p": "1. first\n4. last", "q": "(no non-empty commit messages)"}


def test_reference_across_two_texts(spark):
    pulls = spark.createDataFrame([("p", "r", "This closes"), ("q", "r", None)], "id string, repo string, body string")
    rows = [("p", 0, None), ("p", 1, "   "), ("p", 2, " #44 at last"), ("q", 0, "see #5"), ("q", 2000, "fixes"), ("q", 5000, "#6")]
    commits = spark.createDataFrame(rows, "pr_id string, commit_ord long, message string")
    got = {(r["pr_id"], r["number"], r["tier"]) for r in issues.references_by_pr(pulls, commits).collect()}
    assert got == {("p", 44, 0), ("q", 5, 1), ("q", 6, 0)}


@pytest.mark.parametrize("busy", [0, 3, 1000])
def test_similar_comments_equal_brute_force(spark, busy):
    rng = random.Random(7)
    folders = [f"d{i}" for i in range(6)]
    touched = {i: {"hot"} | set(rng.sample(folders, rng.randint(0, 3))) if i % 5 else set() for i in range(120)}
    repo = {i: "big" if i % 4 else "small" for i in touched}
    queries = [i for i in touched if i % 6 == 0]
    pool = [i for i in touched if i % 6]
    length = {i: 40 + rng.randint(0, 12) for i in pool}
    files = spark.createDataFrame([(i, f"{d}/f.py") for i, ds in touched.items() for d in ds], "pr_id long, filename string")
    comments = spark.createDataFrame([(i, i, "ann", "c" * n) for i, n in length.items()], "pr_id long, comment_id long, author_login string, body string")
    q = spark.createDataFrame([(i, repo[i]) for i in queries + pool[:10]], "pr_id long, repo string")
    t = spark.createDataFrame([(i, repo[i]) for i in pool], "pr_id long, repo string")
    got: dict[int, list] = {}
    for r in similar.similar_comments(q, t, files, comments, 3, busy).orderBy("pr_id", "rank").collect():
        got.setdefault(r["pr_id"], []).append((r["past_pr_id"], round(r["similarity"], 9)))

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    for i in queries + pool[:10]:
        ranked = sorted(((-jaccard(touched[i], touched[j]), -length[j], j) for j in pool if repo[j] == repo[i] and j != i))[:3]
        assert got[i] == [(j, round(-s, 9)) for s, _, j in ranked]


def test_class_pairs_do_not_grow_with_the_square_of_the_classes(spark):
    """Classes that all share a folder; one class is wider than the limit, some are copies of the query."""
    rng = random.Random(11)
    sets = [tuple(sorted({40, *rng.sample(range(40), 3)})) for _ in range(900)] + [tuple(range(20))]
    sizes = [len(s) + i % 3 for i, s in enumerate(sets)]
    past = spark.createDataFrame(
        [("r", list(s), n, [(-(i % 7), i, i % 7)]) for i, (s, n) in enumerate(zip(sets, sizes, strict=True))],
        "repo string, _past_folders array<long>, _b long, _members array<struct<_order:long,past_pr_id:long,chars:long>>").cache()
    asked = sorted(set(sets[::30] + sets[-1:]))
    queries = spark.createDataFrame([("r", list(s), len(s)) for s in asked], "repo string, busy_folders array<long>, n_folders long")

    def found(n):
        pairs = similar.class_candidates(queries, past.where(f"_members[0].past_pr_id >= {900 - n}"), 4, wide=12).collect()
        assert len(pairs) < 0.7 * len(asked) * n
        return pairs

    pairs, fewer = found(900), found(225)
    assert len(pairs) < 3 * len(fewer)
    got: dict[tuple, set] = {}
    for r in pairs:
        got.setdefault(tuple(r["busy_folders"]), set()).update(m["past_pr_id"] for m in r["_members"])
    for q in asked:
        def order(i, q=q):
            shared = len(set(q) & set(sets[i]))
            return (-shared / (len(q) + sizes[i] - shared), -(i % 7), i)

        meeting = [i for i in range(len(sets)) if set(q) & set(sets[i])]
        assert set(sorted(meeting, key=order)[:4]) <= got[q]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_text_metrics_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "x", "y"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    refs = {1: [prose(2), prose(1), prose(1), prose(30)], 2: [prose(5)]}
    hyps = {(1, "k", "s"): prose(25), (1, "k", "t"): prose(3), (2, "k", "s"): prose(70)}
    references = spark.createDataFrame(
        [(p, 1000 * i + 1, t.split()) for p, ts in refs.items() for i, t in enumerate(ts)], "pr_id long, comment_id long, tokens array<string>")
    hypotheses = spark.createDataFrame([(*k, t.split()) for k, t in hyps.items()], "pr_id long, context_kind string, strategy string, tokens array<string>")

    def grams(tokens, n):
        counts = {}
        for i in range(len(tokens) - n + 1):
            g = tuple(tokens[i:i + n])
            counts[g] = counts.get(g, 0) + 1
        return counts

    matched = {}
    for r in textmetrics.gram_matches(hypotheses, references, 4).collect():
        matched[(r["pr_id"], r["context_kind"], r["strategy"]), r["n"]] = (r["matched"], r["n_hyp"], r["n_ref"])
    for key, hyp in hyps.items():
        joined = " ".join(refs[key[0]]).split()
        for n in range(1, 5):
            ours, theirs = grams(hyp.split(), n), grams(joined, n)
            if ours:
                assert matched[key, n] == (sum(min(c, theirs.get(g, 0)) for g, c in ours.items()), sum(ours.values()), sum(theirs.values()))
    for r in textmetrics.rouge_l(hypotheses, references).collect():
        key = (r["pr_id"], r["context_kind"], r["strategy"])
        a, b = hyps[key].split(), " ".join(refs[key[0]]).split()
        assert r["rougeL"] == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)), abs=1e-4)


def test_reference_totals_make_no_grams(spark):
    rows = [(1, 1, ["a", "b"]), (1, 2, []), (1, 3, ["c"]), (1, 4, ["d", "e", "f", "g", "h"]), (2, 9, ["x"]), (3, 5, []), (4, 6, ["a"] * 7), (None, 8, ["q", "r"])]
    references = spark.createDataFrame(rows, "pr_id long, comment_id long, tokens array<string>")
    across = textmetrics._seam_grams(references, 4)
    counted = textmetrics.reference_grams(references, 4, across).groupBy("pr_id", "n").agg(F.sum("ref_count").alias("n_ref"))
    totals = textmetrics.reference_totals(references, 4, across)
    assert sorted(map(str, totals.select("pr_id", "n", "n_ref").collect())) == sorted(map(str, counted.collect()))
    assert {(r["pr_id"], r["n"]): r["n_ref"] for r in totals.where("pr_id = 1").collect()} == {(1, 1): 8, (1, 2): 7, (1, 3): 6, (1, 4): 5}
    # hypotheses are dealt once: by pr_id, n and gram, on which they are counted and joined
    hypotheses = spark.createDataFrame([(1, "k", "s", ["a", "b"])], "pr_id long, context_kind string, strategy string, tokens array<string>")
    plan = textmetrics.gram_matches(hypotheses, references, 2)._jdf.queryExecution().executedPlan().toString()
    by_cell_and_gram = [line for line in plan.splitlines() if "hashpartitioning(" in line and "strategy" in line and "gram" in line]
    assert not by_cell_and_gram


def test_demonstration_contract(spark):
    cells = spark.createDataFrame([("few_shot", 0)], "strategy string, n_demos long")
    with pytest.raises(PySparkException):
        prompts.require_demonstrations(cells).collect()
    cells = spark.createDataFrame([("cot", 2)], "strategy string, n_demos long")
    with pytest.raises(PySparkException):
        prompts.require_demonstrations(cells).collect()


def test_resume_is_idempotent(spark):
    cells = spark.createDataFrame([(i, "diff", "cot", "t") for i in range(5)], replay.CELL)
    first = replay.budgeted(replay.missing_cells(cells, cells.limit(0)), 3)
    rest = replay.missing_cells(cells, first)
    assert rest.count() == 2 and replay.missing_cells(cells, first.union(rest)).count() == 0


def test_tiers_mark_empty_sections(spark):
    frame = spark.createDataFrame(
        [("p", "r", "t", "d", None, "1. m", None, None, " ")],
        "pr_id string, repo string, title string, diff string, pr_description string, commit_message string, repo_context string, issue_text string, historical_comments string")
    rows = {r["context_kind"]: r for r in contexts.tier_contexts(frame).collect()}
    assert rows["diff"]["second_text"] is None and rows["diff"]["context_text"] == "Diff:\nd"
    assert rows["diff_issue"]["context_text"] == "Linked issue:\n(no linked issue information available)\n\nDiff:\nd"
    assert rows["complete_se_context"]["second_text"].count("(no ") == 4


def test_substantive_comment(spark):
    frame = spark.createDataFrame([("```suggestion\nx\n```",), ("  needs a test case ",)], "b string")
    got = [r["t"] for r in frame.select(answers.substantive_comment(F.col("b")).alias("t")).collect()]
    assert got == [None, "needs a test case"]


def test_long_references_take_rounds(spark, monkeypatch):
    """Hypotheses beyond one state word against references of several chunks, and of none."""
    rng = random.Random(8)
    prose = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    refs = {1: [prose(40) for _ in range(9)], 2: [prose(3)], 3: [prose(100)], 4: [[]]}
    hyps = {(1, "k", "s"): prose(62), (1, "k", "t"): prose(63), (1, "k", "u"): prose(200), (2, "k", "s"): prose(1), (3, "k", "s"): [], (4, "k", "s"): prose(5), (9, "k", "s"): prose(5)}
    references = spark.createDataFrame([(p, i, t) for p, ts in refs.items() for i, t in enumerate(ts)], "pr_id long, comment_id long, tokens array<string>")
    hypotheses = spark.createDataFrame([(*k, t) for k, t in hyps.items()], "pr_id long, context_kind string, strategy string, tokens array<string>")
    for size in (50_000, 70):
        monkeypatch.setattr(textmetrics, "CHUNK_TOKENS", size)
        got = {(r["pr_id"], r["context_kind"], r["strategy"]): r["rougeL"] for r in textmetrics.rouge_l(hypotheses, references).collect()}
        assert set(got) == {key for key in hyps if key[0] in refs}
        for key, value in got.items():
            a, b = hyps[key], [t for tokens in refs[key[0]] for t in tokens]
            common = lcs(a, b) if a and b else 0
            assert value == pytest.approx(2 * common / (len(a) + len(b)) if common else 0, abs=1e-4)


def test_hypotheses_are_dealt_once(spark):
    """Their tokens are exploded where they lie: one deal, by what the cells are joined on."""
    hypotheses = spark.createDataFrame([(1, "k", "s", ["a", "b"])], "pr_id long, context_kind string, strategy string, tokens array<string>")
    plan = textmetrics._bits_of_tokens(hypotheses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
