"""Text contexts of pull requests: diffs, commit messages, metadata, repository view, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions import text
from tributary.functions.references import hunk_headings
from tributary.operators.sampling import first_k
from tributary.session import worked_out

NO_DIFF = "(no file diff available)"
#: Characters that every block has by its layout, whatever its texts.
SHORTEST_FILE_BLOCK = len("---  ()\n") + 1
SHORTEST_COMMIT_BLOCK = len("1. ") + 1


def pack(blocks: DataFrame, key: str, order: Sequence[str], budget: int, separator: str, shortest: int) -> DataFrame:
    """Greedy packing of ordered text blocks under a character budget, per key.

    A block that does not fit is skipped and the next one is tried.  Result:
    ``key, text, n_kept, n_blocks``; ``text`` joins the kept blocks.

    The remaining budget never grows, so the kept blocks of one length L are the
    first ones of that length, and at most ``budget // L`` of them.  Only those are
    gathered per key, which bounds the row whatever the number of blocks.  ``shortest``
    (at least 1) is the least length that the layout of the blocks allows, and a shorter
    block is an error; so ``budget // shortest`` is a constant limit beside the one by
    length, by which Spark prunes inside the map tasks (up to its own limit for that).
    """
    size = F.length("block").cast("long")
    short = F.raise_error(F.concat(F.lit(f"a block is shorter than {shortest}: "), F.col("block")))
    sized = worked_out(blocks.withColumn("_size", F.when(size < shortest, short.cast("long")).otherwise(size)), "block", "_size")
    counts = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n_blocks"))
    same_length = Window.partitionBy(key, "_size").orderBy(*order)
    candidates = (
        sized.where(F.col("_size") <= budget)
        .withColumn("_nth", F.row_number().over(same_length))
        .where((F.col("_nth") <= budget // shortest) & (F.col("_nth") <= F.floor(F.lit(budget) / F.col("_size"))))
    )
    gathered = candidates.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, "_size", "block"))).alias("_blocks")
    )

    def step(state: Column, block: Column) -> Column:
        total = state["total"] + block["_size"]
        taken = F.struct(total.alias("total"), F.concat(state["kept"], F.array(block["block"])).alias("kept"))
        return F.when(total <= budget, taken).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("kept"))
    kept = gathered.select(key, F.aggregate("_blocks", start, step, lambda s: s["kept"]).alias("_kept"))
    return counts.join(kept, key, "left").select(
        key,
        F.coalesce(F.array_join("_kept", separator), F.lit("")).alias("text"),
        F.coalesce(F.greatest(F.size("_kept"), F.lit(0)), F.lit(0)).cast("long").alias("n_kept"),
        "n_blocks",
    )


def file_blocks(files_changed: DataFrame, file_limit: int) -> DataFrame:
    """``pr_id, neg_churn, file_ord, block``: header and capped patch of each file, largest change first."""
    zero = F.lit(0).cast("long")
    size = F.coalesce("additions", zero) + F.coalesce("deletions", zero)
    patch = F.coalesce("patch", F.lit(""))
    head = F.concat(F.lit("--- "), F.col("filename"), F.lit(" ("), F.col("status"))
    block = F.when(
        patch != "", F.concat(head, F.lit(")\n"), text.truncate(patch, file_limit, fixed.FILE_MARKER))
    ).otherwise(F.concat(head, F.lit(", no textual diff)")))
    return files_changed.select("pr_id", (-size).alias("neg_churn"), "file_ord", block.alias("block"))


def diff_text(
    files_changed: DataFrame, budget: int = fixed.DIFF_BUDGET, file_limit: int = fixed.FILE_PATCH_BUDGET
) -> DataFrame:
    """``pr_id, diff``: packed file diffs with the number of files left out."""
    packed = pack(file_blocks(files_changed, file_limit), "pr_id", ["neg_churn", "file_ord"], budget, "\n\n", SHORTEST_FILE_BLOCK)
    left_out = F.col("n_blocks") - F.col("n_kept")
    note = F.concat(F.lit("\n\n... ["), left_out, F.lit(" additional changed file(s) omitted for length]"))
    return packed.select("pr_id", F.concat("text", F.when(left_out > 0, note).otherwise("")).alias("diff"))


def commit_text(commits: DataFrame, budget: int = fixed.COMMIT_BUDGET) -> DataFrame:
    """``pr_id, commit_message``: numbered messages, blank ones skipped but counted, packed."""
    message = text.strip(F.coalesce("message", F.lit("")))
    numbered = commits.withColumn("_m", message).where(F.col("_m") != "").select(
        "pr_id", "commit_ord", F.concat(F.col("commit_ord") + 1, F.lit(". "), F.col("_m")).alias("block")
    )
    packed = pack(numbered, "pr_id", ["commit_ord"], budget, "\n", SHORTEST_COMMIT_BLOCK)
    left_out = F.col("n_blocks") - F.col("n_kept")
    note = F.concat(F.lit("\n... ["), left_out, F.lit(" additional commit message(s) omitted for length]"))
    filled = F.concat("text", F.when(left_out > 0, note).otherwise(""))
    # Requests whose messages are all blank still get a row.
    every = commits.groupBy("pr_id").agg(F.count(F.lit(1)).alias("_n"))
    return every.join(packed, "pr_id", "left").select(
        "pr_id",
        F.when(F.coalesce("n_kept", F.lit(0)) == 0, F.lit("(no non-empty commit messages)"))
        .otherwise(filled).alias("commit_message"),
    )


def metadata_text(
    pull_requests: DataFrame, files_changed: DataFrame, listed: int = fixed.FILE_LIST_LENGTH
) -> DataFrame:
    """``pr_id, metadata``: labels, size and the first changed files."""
    counts = files_changed.groupBy("pr_id").agg(F.count(F.lit(1)).alias("n_files"))
    line = F.concat(F.lit("  - "), F.col("filename"), F.lit(" ("), F.col("status"), F.lit(")"))
    shown = (
        first_k(files_changed.select("pr_id", "file_ord", line.alias("line")), ["pr_id"], ["file_ord"], listed)
        .groupBy("pr_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_lines"))
    )
    zero = F.lit(0).cast("long")
    labels = F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise("(none)")
    files = F.coalesce("n_files", zero)
    size = F.concat(
        F.lit("Size: "), files, F.lit(" file(s) changed, +"), F.coalesce("additions", zero),
        F.lit("/-"), F.coalesce("deletions", zero), F.lit(" lines"),
    )
    more = F.when(files > listed, F.concat(F.lit("  ... and "), files - listed, F.lit(" more file(s)")))
    names = F.when(F.col("_lines").isNotNull(), F.array_join(F.transform("_lines", lambda l: l["line"]), "\n"))
    return (
        pull_requests.select(F.col("id").alias("pr_id"), "labels", "additions", "deletions")
        .join(counts, "pr_id", "left")
        .join(shown, "pr_id", "left")
        .select(
            "pr_id",
            F.concat_ws("\n", F.concat(F.lit("Labels: "), labels), size, F.lit("Changed files:"), names, more).alias("metadata"),
        )
    )


def context_parts(
    pull_requests: DataFrame, files_changed: DataFrame, commits: DataFrame,
    budget: int = fixed.DIFF_BUDGET, file_limit: int = fixed.FILE_PATCH_BUDGET,
) -> DataFrame:
    """``pr_id, repo, title, body, diff, commit_message, metadata``: every part once per pull request."""
    return (
        pull_requests.select(F.col("id").alias("pr_id"), "repo", "title", "body")
        .join(diff_text(files_changed, budget, file_limit), "pr_id", "left")
        .join(commit_text(commits), "pr_id", "left")
        .join(metadata_text(pull_requests, files_changed), "pr_id", "left")
    )


def context_kinds(parts: DataFrame, context_limit: int | None = None) -> DataFrame:
    """``pr_id, repo, title, context_kind, context_text``: the four contexts of each pull request."""
    diff = F.concat(F.lit("Diff:\n"), F.coalesce("diff", F.lit(NO_DIFF)))
    description = text.or_placeholder(F.col("body"), "(no PR description provided)")
    messages = F.coalesce("commit_message", F.lit("(no commit messages available)"))
    texts = {
        "diff_only": diff,
        "diff_description": F.concat(F.lit("PR description:\n"), description, F.lit("\n\n"), diff),
        "diff_commit_message": F.concat(F.lit("Commit messages:\n"), messages, F.lit("\n\n"), diff),
        "diff_metadata": F.concat(F.col("metadata"), F.lit("\n\n"), diff),
    }
    if context_limit is not None:
        texts = {k: text.truncate(t, context_limit, fixed.CONTEXT_MARKER) for k, t in texts.items()}
    kinds = F.array(*[
        F.struct(F.lit(k).alias("context_kind"), texts[k].alias("context_text")) for k in fixed.CONTEXT_KINDS
    ])
    return parts.select("pr_id", "repo", "title", F.explode(kinds).alias("_k")).select("pr_id", "repo", "title", "_k.*")


def pr_contexts(
    pull_requests: DataFrame, files_changed: DataFrame, commits: DataFrame,
    budget: int = fixed.DIFF_BUDGET, file_limit: int = fixed.FILE_PATCH_BUDGET, context_limit: int | None = None,
) -> DataFrame:
    """The four contexts of each pull request, straight from the tables."""
    return context_kinds(context_parts(pull_requests, files_changed, commits, budget, file_limit), context_limit)


def repo_context(files_changed: DataFrame, max_files: int = fixed.REPO_CONTEXT_FILES) -> DataFrame:
    """``pr_id, repo_context``: the largest files with their hunk headings, and the folders they span."""
    zero = F.lit(0).cast("long")
    size = F.coalesce("additions", zero) + F.coalesce("deletions", zero)
    headings = F.array_join(hunk_headings(F.col("patch")), "; ")
    line = F.concat(F.lit("- "), F.col("filename"), F.lit(" ("), F.col("status"), F.lit(")"))
    noted = F.concat(line, F.when(
        headings != "", F.concat(F.lit("\n    enclosing region(s) (git hunk headings): "), headings)).otherwise(""))
    rows = files_changed.select(
        "pr_id", (-size).alias("neg_churn"), "file_ord", noted.alias("line"),
        text.directory(F.col("filename")).alias("folder"),
    )
    chosen = first_k(rows, ["pr_id"], ["neg_churn", "file_ord"], max_files)
    listed = chosen.groupBy("pr_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "line", "folder"))).alias("_files")  # at most max_files
    )
    folders = F.transform("_files", lambda f: f["folder"])
    spans = F.transform(
        F.array_distinct(folders),
        lambda d: F.concat(F.lit("- "), d, F.lit("/  ("), F.size(F.filter(folders, lambda x: x == d)), F.lit(" file(s))")),
    )
    spanned = F.when(
        F.size(F.array_distinct(folders)) > 1,
        F.concat(F.lit("\nDirectories spanned:\n"), F.array_join(spans, "\n")),
    )
    # The wording of this block, which stored answers depend on.
    closing = ("\n(Approximate: derived from the diff's own file list and git hunk headings, "
               "not from fetched file bodies or a call graph.)")
    return listed.select("pr_id", F.concat_ws(
        "\n", F.lit("Files touched by this change (repository-level view):"),
        F.array_join(F.transform("_files", lambda f: f["line"]), "\n"), spanned, F.lit(closing)).alias("repo_context"))


def _section(heading: str, column: str, note: str) -> Column:
    return F.concat(F.lit(f"{heading}:\n"), text.or_placeholder(F.col(column), f"({note})"))


def _diff_section() -> Column:
    return F.concat(F.lit("Diff:\n"), text.or_placeholder(F.col("diff"), NO_DIFF))


def _added_sections(tier: str) -> list[Column]:
    return [_section(*section) for section in fixed.TIER_SECTIONS[tier]]


def tier_contexts(augmented: DataFrame) -> DataFrame:
    """``pr_id, repo, title, context_kind, context_text, first_text, second_text`` for the five tiers.

    ``first_text`` and ``second_text`` split a tier for a two-turn exchange: the
    diff, then the rest.  The bare-diff tier has no second part.
    """
    tiers = []
    for tier in fixed.TIERS:
        added = _added_sections(tier)
        second = F.concat_ws("\n\n", *added) if added else F.lit(None).cast("string")
        tiers.append(F.struct(
            F.lit(tier).alias("context_kind"),
            F.concat_ws("\n\n", *added, _diff_section()).alias("context_text"),
            _diff_section().alias("first_text"),
            second.alias("second_text"),
        ))
    return augmented.select("pr_id", "repo", "title", F.explode(F.array(*tiers)).alias("_t")).select(
        "pr_id", "repo", "title", "_t.*")


def slot_availability(augmented: DataFrame) -> DataFrame:
    """Share of pull requests for which each section of the tiers has content."""
    slots = ["pr_description", "commit_message", "repo_context", "issue_text", "historical_comments"]

    def present(slot: str) -> Column:
        return (F.coalesce(text.strip(F.col(slot)), F.lit("")) != "").cast("double")

    return augmented.agg(
        F.count(F.lit(1)).alias("n_prs"), *[F.round(F.avg(present(s)), 4).alias(s) for s in slots]
    )


def demonstration_context(pull_requests: DataFrame, files_changed: DataFrame) -> DataFrame:
    """``pr_id, context_text``: title and the files' patches in stored order, cut.

    A part has at least 8 characters with its separator, so the first
    ``budget / 8`` files already exceed the budget.
    """
    budget = fixed.DEMO_DIFF_BUDGET
    part = F.concat(F.lit("--- "), F.col("filename"), F.lit("\n"), F.col("patch"))
    parts = files_changed.where(F.coalesce(F.col("patch"), F.lit("")) != "").select(
        "pr_id", "file_ord", F.substring(part, 1, budget + 1).alias("part"))
    joined = first_k(parts, ["pr_id"], ["file_ord"], budget // 8 + 1).groupBy("pr_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "part"))).alias("_parts"))
    diff = text.truncate(
        F.array_join(F.transform("_parts", lambda p: p["part"]), "\n"), budget, fixed.DEMO_DIFF_MARKER)
    header = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"))).otherwise("")
    return pull_requests.select(F.col("id").alias("pr_id"), "title").join(joined, "pr_id", "left").select(
        "pr_id", F.concat(header, F.coalesce(F.concat(F.lit("Diff:\n"), diff), F.lit(NO_DIFF))).alias("context_text"))


def cap_coverage(lengths: DataFrame, size: str, caps: Sequence[int]) -> DataFrame:
    """Share of rows whose size fits each candidate cap."""
    fits = [F.sum((F.col(size) <= cap).cast("long")).alias(f"c{cap}") for cap in caps]
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), *fits)
    rows = F.array(*[
        F.struct(F.lit(cap).cast("long").alias("cap"), F.col(f"c{cap}").alias("n_fit")) for cap in caps
    ])
    return totals.select("n", F.explode(rows).alias("_c")).select(
        "_c.cap", "_c.n_fit", "n", F.round(F.try_divide(F.col("_c.n_fit").cast("double"), F.col("n").cast("double")), 4).alias("share"))
