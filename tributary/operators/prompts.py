"""Prompts for every cell of a grid, as columns.

Templates are constants, so a cell is a concatenation chosen by its task and
strategy; demonstrations are one small row per (task, context kind).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import fixed_prompts as texts
from tributary import fixed_values as fixed
from tributary.functions.text import project_phrase, strip

SLOT = re.compile(r"\{(\w+)\}")


def fill(template: str, **slots: Column) -> Column:
    """The template with its ``{slot}`` marks replaced by columns."""
    pieces = SLOT.split(template)
    return F.concat(*[
        slots[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(pieces) if piece or i % 2
    ])


def content(title: Column, context: Column) -> Column:
    """Header and context of the request a prompt asks about."""
    header = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("PR title: "), title, F.lit("\n"))).otherwise("")
    return F.concat(header, F.lit("Pull request content:\n"), strip(context))


def _choose(options: dict[tuple[str, str], Column]) -> Column:
    chosen = F.lit(None).cast("string")
    for (task, strategy), column in options.items():
        chosen = F.when((F.col("task") == task) & (F.col("strategy") == strategy), column).otherwise(chosen)
    return chosen


def demonstration_blocks(demos: DataFrame) -> DataFrame:
    """``task, context_kind, demos, n_demos`` from ``task, context_kind, position, context_text, target``.

    One row per task and kind, of k demonstrations each.
    """
    block = F.lit(None).cast("string")
    for task, template in texts.DEMONSTRATIONS.items():
        filled = fill(
            template, i=F.col("position").cast("string"), context=strip(F.col("context_text")), target=F.col("target"))
        block = F.when(F.col("task") == task, filled).otherwise(block)
    return demos.withColumn("_block", block).groupBy("task", "context_kind").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "_block"))), lambda b: b["_block"]), "\n\n").alias("demos"),
        F.count(F.lit(1)).alias("n_demos"),
    )


def grid_cells(contexts: DataFrame, tasks: list[str], strategies: list[str]) -> DataFrame:
    """Each context once per task and strategy; an undefined cell (two turns without a second part) is left out."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("task"), F.lit(s).alias("strategy")) for t in tasks for s in strategies
    ])
    rows = contexts.select("*", F.explode(cells).alias("_cell")).select(*contexts.columns, "_cell.*")
    if "second_text" in contexts.columns:
        rows = rows.where(~((F.col("strategy") == "multi_turn") & F.col("second_text").isNull()))
    return rows


def with_demonstrations(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``demos, n_demos`` to the few-shot cells; the blocks are one row per task and kind."""
    few = F.col("strategy") == "few_shot"
    joined = cells.join(F.broadcast(blocks), ["task", "context_kind"], "left")
    return joined.withColumn("demos", F.when(few, F.col("demos"))).withColumn("n_demos", F.when(few, F.col("n_demos")))


def require_demonstrations(cells: DataFrame) -> DataFrame:
    """Fail when a few-shot cell has no demonstrations or another cell carries some."""
    few, has = F.col("strategy") == "few_shot", F.coalesce(F.col("n_demos"), F.lit(0)) > 0
    checked = (
        F.when(few & ~has, F.raise_error(F.lit("few_shot requires at least one demonstration")))
        .when(~few & has, F.raise_error(F.concat(F.lit("demonstrations were passed for "), F.col("strategy"))))
        .otherwise(F.col("strategy"))
    )
    return cells.withColumn("strategy", checked.cast("string"))


def single_prompts(cells: DataFrame) -> DataFrame:
    """Add ``system, user, contract`` for the one-turn strategies."""
    slots = {
        "project": project_phrase(F.col("repo")),
        "content": content(F.col("title"), F.col("context_text")),
        "demos": F.coalesce("demos", F.lit("")),
        "n_demos": F.coalesce("n_demos", F.lit(0)).cast("string"),
    }
    contract = F.lit(None).cast("string")
    for task, value in texts.CONTRACTS.items():
        contract = F.when(F.col("task") == task, F.lit(value)).otherwise(contract)
    return cells.select(
        "*",
        _choose({key: fill(template, **slots) for key, template in texts.SYSTEMS.items()}).alias("system"),
        _choose({key: fill(template, **slots) for key, template in texts.USERS.items()}).alias("user"),
        contract.alias("contract"),
    )


def conversations(cells: DataFrame) -> DataFrame:
    """Add ``system, turns`` to cells of any strategy of the tiered grid.

    One-turn strategies have one turn.  Self-reflection drafts over the whole tier
    and then criticises the draft; the multi-turn strategy shows the diff first and
    the rest of the tier second.
    """
    project = project_phrase(F.col("repo"))
    slots = {
        "project": project,
        "demos": F.coalesce("demos", F.lit("")),
        "n_demos": F.coalesce("n_demos", F.lit(0)).cast("string"),
    }
    whole = content(F.col("title"), F.col("context_text"))
    local = content(F.col("title"), F.col("first_text"))
    first: dict[tuple[str, str], Column] = {}
    systems: dict[tuple[str, str], Column] = {}
    for task in fixed.TASKS:
        for strategy in fixed.SHARED_STRATEGIES:
            first[task, strategy] = fill(texts.USERS[task, strategy], content=whole, **slots)
            systems[task, strategy] = fill(texts.SYSTEMS[task, strategy], **slots)
        for strategy, shown in (("self_reflection", whole), ("multi_turn", local)):
            first[task, strategy] = fill(texts.USERS[task, "zero_shot"], content=shown, **slots)
            systems[task, strategy] = fill(texts.SYSTEMS[task, "zero_shot"], **slots)
    second = {
        key: fill(template, project=project, second=F.coalesce("second_text", F.lit("")))
        for key, template in texts.SECOND_TURNS.items()
    }
    opening, closing = _choose(first), _choose(second)
    return cells.select(
        "*", _choose(systems).alias("system"),
        F.filter(F.array(opening, closing), lambda t: t.isNotNull()).alias("turns"),
    )


def messages(system: Column, turns: Column) -> Column:
    """Message list for the first call: the system message unless empty, then the user turns."""
    head = F.array(F.struct(F.lit("system").alias("role"), F.coalesce(system, F.lit("")).alias("content")))
    asked = F.transform(turns, lambda t: F.struct(F.lit("user").alias("role"), t.alias("content")))
    return F.concat(F.filter(head, lambda m: m["content"] != ""), asked)
