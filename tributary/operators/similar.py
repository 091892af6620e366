"""Comments on similar past pull requests, by overlap of changed folders.

Similarity is the Jaccard index of the folder sets inside one repository.  The
top matches are exact, and no step pairs up all members of a folder:

* folders that few requests touch are joined member by member;
* folders that many touch are joined class by class, where a class is all
  requests with the same busy folders and the same number of folders.  All
  members of a class are equally similar to a query unless a rare folder links
  them too, so the first k + 1 members of the class are enough (one of them may
  be the query itself);
* classes meet in combinations of busy folders (:func:`class_candidates`), each of
  which lists a bounded number of past classes;
* candidates without overlap rank by comment length alone, so the first k + 1 of
  the repository are enough.

A candidate found twice keeps its higher similarity, which is the true one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions import text
from tributary.operators.sampling import first_k, longest_human_comment
from tributary.session import cut_lineage

BUSY_FOLDER = 1000
#: A combination of busy folders lists all its past classes up to this number; beyond it, longer combinations do.
LISTED_CLASSES = 16
#: Classes of more busy folders than this are compared with every class that shares one.
WIDE_CLASS = 12
CLASS = ["repo", "busy_folders", "n_folders"]


def changed_folders(files_changed: DataFrame) -> DataFrame:
    """``pr_id, folder``: distinct folders of the changed files."""
    return files_changed.select("pr_id", text.directory(F.col("filename")).alias("folder")).distinct()


def folder_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of two folder arrays, of their intersection and union, and the Jaccard index, by ``pr_id``."""
    a, b = F.col("left_folders"), F.col("right_folders")
    shared, united = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return left.join(right, "pr_id").select(
        "pr_id", F.size(a).cast("long").alias("n_left"), F.size(b).cast("long").alias("n_right"),
        shared.cast("long").alias("n_shared"), united.cast("long").alias("n_united"),
        F.coalesce(F.round(F.try_divide(shared.cast("double"), united.cast("double")), 6), F.lit(0.0)).alias("jaccard"),
    )


def _jaccard(shared, a, b):
    return shared.cast("double") / (a + b - shared).cast("double")


def _meet(asked: DataFrame, past: DataFrame) -> DataFrame:
    """Pairs of classes that share a busy folder, each pair once: at the first folder they share."""
    met = asked.withColumn("_folder", F.explode("busy_folders")).join(
        past.withColumn("_folder", F.explode("_past_folders")), ["repo", "_folder"])
    return met.where(F.col("_folder") == F.array_min(F.array_intersect("busy_folders", "_past_folders"))).drop("_folder")


def class_candidates(asked: DataFrame, past: DataFrame, k: int, listed: int = LISTED_CLASSES, wide: int = WIDE_CLASS) -> DataFrame:
    """Pairs of an asked class with past classes, among them the ``k`` most similar members of every asked class.

    ``asked`` is ``repo, busy_folders, n_folders``; ``past`` is ``repo, _past_folders, _b, _members``, the members
    by length and id.  Folders are numbers, rare folders first, sorted in each class.

    A combination of folders lists its past classes.  Smaller classes are more similar to any query that
    shares just this combination, and longer comments break ties, so the first k in this order are enough for
    such queries.  Queries that share more of a past class find it in its list if that is complete (up to ``listed``
    classes), else under the combination extended by the next shared folder.  So each list is bounded,
    whatever the number of classes, and every past class is in a list that a query sharing folders with it reads.
    """
    listed = max(listed, k)
    narrow_asked, narrow_past = (x.where(F.size(c) <= wide) for x, c in ((asked, "busy_folders"), (past, "_past_folders")))
    found = _meet(asked, past.where(F.size("_past_folders") > wide)).unionByName(
        _meet(asked.where(F.size("busy_folders") > wide), narrow_past))
    singles = lambda frame, column: frame.withColumn("_combination", F.explode(F.transform(column, lambda f: F.array(f))))
    asking, listing = singles(narrow_asked, "busy_folders"), singles(narrow_past, "_past_folders")
    place = ["repo", "_combination"]
    best = F.element_at("_members", 1)
    order = ["_b", F.desc(best["chars"]), best["past_pr_id"], "_past_folders"]
    while True:
        lists = cut_lineage(first_k(listing, place, order, listed + 1, "_nth"))
        longer = lists.where(F.col("_nth") > listed).select(*place, F.lit(True).alias("_is_open"))
        kept = lists.join(longer, place, "left").where(F.col("_nth") <= F.when(F.col("_is_open"), k).otherwise(listed))
        found = found.unionByName(asking.join(kept.drop("_nth", "_is_open"), place).drop("_combination"))
        if longer.isEmpty():
            return found

        def extended(frame: DataFrame, column: str) -> DataFrame:
            last = F.element_at("_combination", -1)
            following = F.filter(column, lambda f: f > last)
            return cut_lineage(frame.join(longer.drop("_is_open"), place, "left_semi").withColumn(
                "_combination", F.explode(F.transform(following, lambda f: F.concat("_combination", F.array(f))))))

        asking, listing = extended(asking, "busy_folders"), extended(listing, "_past_folders")


def similar_comments(
    queries: DataFrame, train_pool: DataFrame, files_changed: DataFrame, review_comments: DataFrame,
    k: int = fixed.HISTORY_COMMENTS, busy: int = BUSY_FOLDER,
) -> DataFrame:
    """``pr_id, rank, past_pr_id, similarity, chars, comment_id, body``: up to ``k`` past comments per query.

    ``queries`` and ``train_pool`` are ``pr_id, repo``.  Candidates are training
    requests of the same repository with a human comment; ties go to the longer
    comment, then to the smaller id.
    """
    comments = longest_human_comment(review_comments)
    pool = train_pool.select("pr_id", "repo").join(comments.select("pr_id", "chars"), "pr_id")
    wanted = queries.select("pr_id", "repo")
    folders = files_changed.select("pr_id", text.directory(F.col("filename")).alias("folder"))

    # Mark busy folders: more than ``busy`` candidates or queries of a repository touch them.
    sides = pool.select("pr_id", "repo", F.lit(1).alias("is_past"), F.lit(0).alias("is_query"), "chars").unionByName(
        wanted.select("pr_id", "repo", F.lit(0).alias("is_past"), F.lit(1).alias("is_query"), F.lit(None).cast("long").alias("chars"))
    )
    members = sides.groupBy("pr_id", "repo").agg(
        F.max("is_past").alias("is_past"), F.max("is_query").alias("is_query"), F.max("chars").alias("chars"))
    # The files of other requests fall out in the join, so only the rest is made distinct and written.
    placed = cut_lineage(members.join(folders, "pr_id", "left").distinct())
    # Numbered by how many touch them, so combinations begin with the rarest.
    popular = cut_lineage(
        placed.where(F.col("folder").isNotNull()).groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > busy).orderBy("_n", "repo", "folder")
        .select("repo", "folder", F.monotonically_increasing_id().alias("_number"))
    )
    marked = placed.join(popular, ["repo", "folder"], "left")
    # Read by five branches below; narrow rows, written once.
    profiles = cut_lineage(marked.groupBy("pr_id", "repo", "is_past", "is_query", "chars").agg(
        F.count("folder").alias("n_folders"),
        F.array_sort(F.collect_list("_number")).alias("busy_folders"),
        F.collect_list(F.when(F.col("_number").isNull(), F.col("folder"))).alias("rare_folders"),
    ))
    past = profiles.where("is_past = 1")
    asked = profiles.where("is_query = 1")

    # Members linked by at least one rare folder.
    past_rare = past.select(
        "repo", F.explode("rare_folders").alias("folder"), F.col("pr_id").alias("past_pr_id"), "chars",
        F.col("n_folders").alias("_b"), F.col("busy_folders").alias("_past_busy"))
    asked_rare = asked.select(
        "repo", F.explode("rare_folders").alias("folder"), "pr_id", F.col("n_folders").alias("_a"),
        F.col("busy_folders").alias("_asked_busy"))
    rare = (
        asked_rare.join(past_rare, ["repo", "folder"])
        .groupBy("pr_id", "past_pr_id")
        .agg(
            F.count(F.lit(1)).alias("_rare"), F.first("chars").alias("chars"), F.first("_a").alias("_a"), F.first("_b").alias("_b"),
            F.first(F.size(F.array_intersect("_asked_busy", "_past_busy"))).alias("_busy"),
        )
        .select("pr_id", "past_pr_id", "chars", _jaccard(F.col("_rare") + F.col("_busy"), F.col("_a"), F.col("_b")).alias("similarity"))
    )

    # Classes linked by busy folders.
    longest = [F.desc("chars"), "pr_id"]
    member = F.struct((-F.col("chars")).alias("_order"), F.col("pr_id").alias("past_pr_id"), "chars")
    past_classes = cut_lineage(
        first_k(past.where(F.size("busy_folders") > 0).select("pr_id", "chars", *CLASS), CLASS, longest, k + 1, "_nth")
        .groupBy(*CLASS).agg(F.array_sort(F.collect_list(member)).alias("_members"))  # at most k + 1
        .select("repo", F.col("busy_folders").alias("_past_folders"), F.col("n_folders").alias("_b"), "_members"))
    asked_classes = cut_lineage(asked.where(F.size("busy_folders") > 0).select(*CLASS).distinct())
    shared = F.size(F.array_intersect("busy_folders", "_past_folders"))
    linked = class_candidates(asked_classes, past_classes, k + 1).select(
        *CLASS, _jaccard(shared, F.col("n_folders"), F.col("_b")).alias("similarity"), F.inline("_members")).drop("_order")
    # A member found by several combinations has one rank, and falls together below.
    rank = F.dense_rank().over(Window.partitionBy(*CLASS).orderBy(F.desc("similarity"), F.desc("chars"), "past_pr_id"))
    best_of_class = linked.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    by_class = asked.select("pr_id", *CLASS).join(best_of_class, CLASS).select("pr_id", "past_pr_id", "chars", "similarity")

    # Candidates without overlap.
    longest_of_repo = first_k(past.select("repo", "pr_id", "chars"), ["repo"], longest, k + 1, "_nth").select(
        "repo", F.col("pr_id").alias("past_pr_id"), "chars")
    apart = asked.select("pr_id", "repo").join(longest_of_repo, "repo").select("pr_id", "past_pr_id", "chars", F.lit(0.0).alias("similarity"))

    found = (
        rare.unionByName(by_class).unionByName(apart)
        .where(F.col("pr_id") != F.col("past_pr_id"))
        .groupBy("pr_id", "past_pr_id")
        .agg(F.max("similarity").alias("similarity"), F.max("chars").alias("chars"))
    )
    top = first_k(found, ["pr_id"], [F.desc("similarity"), F.desc("chars"), "past_pr_id"], k, "rank")
    bodies = comments.select(F.col("pr_id").alias("past_pr_id"), "comment_id", "body")
    return top.join(bodies, "past_pr_id").select("pr_id", "rank", "past_pr_id", "similarity", "chars", "comment_id", "body")


def historical_comments(
    similar: DataFrame, pull_requests: DataFrame, limit: int = fixed.HISTORY_COMMENT_BUDGET
) -> DataFrame:
    """``pr_id, historical_comments``: the similar past comments as one text."""
    titles = pull_requests.select(F.col("id").alias("past_pr_id"), "title", "repo")
    body = text.truncate(text.strip(F.col("body")), limit, fixed.COMMENT_MARKER, right_trim=True)
    block = F.concat(
        F.lit("On a past PR in "), F.col("repo"), F.lit(' ("'), text.or_placeholder(F.col("title"), "(no title)"),
        F.lit('"), a reviewer commented:\n"'), body, F.lit('"'),
    )
    blocks = similar.join(titles, "past_pr_id").select("pr_id", "rank", block.alias("block"))
    joined = blocks.groupBy("pr_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_b"))  # at most k
    return joined.select("pr_id", F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n").alias("historical_comments"))
