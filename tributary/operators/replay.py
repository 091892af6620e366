"""Stored model answers: content keys, replay, pending cells and run counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["pr_id", "context_kind", "strategy", "task"]


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def prompt_key(model: Column, system: Column, user: Column, temperature: Column, max_tokens: Column) -> Column:
    """SHA-256 of the canonical JSON of a one-turn request (keys sorted, text not escaped to ASCII)."""
    return F.sha2(F.concat(
        F.lit('{"max_output_tokens": '), max_tokens.cast("string"), F.lit(', "model": '), _quoted(model),
        F.lit(', "system": '), _quoted(system), F.lit(', "temperature": '), temperature.cast("string"),
        F.lit(', "user": '), _quoted(user), F.lit("}")), 256)


def transcript_key(
    model: Column, system: Column, transcript: list[tuple[str, Column]], temperature: Column, max_tokens: Column
) -> Column:
    """SHA-256 of the canonical JSON of a whole conversation so far: ``(role, content)`` in order."""
    parts: list[Column] = []
    for i, (role, content) in enumerate(transcript):
        lead = '{"content": ' if i == 0 else ', {"content": '
        parts += [F.lit(lead), _quoted(content), F.lit(f', "role": "{role}"}}')]
    return F.sha2(F.concat(
        F.lit('{"max_output_tokens": '), max_tokens.cast("string"), F.lit(', "messages": ['), *parts,
        F.lit('], "model": '), _quoted(model), F.lit(', "system": '), _quoted(system),
        F.lit(', "temperature": '), temperature.cast("string"), F.lit("}")), 256)


def replay(prompts: DataFrame, responses: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Prompts with their stored answer; ``response_text`` stays null where none is stored."""
    return prompts.join(responses, key, "left")


def pending(prompts: DataFrame, responses: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Prompts without a stored answer."""
    return prompts.join(responses, key, "left_anti")


def replay_conversation(
    conversations: DataFrame, responses: DataFrame, model: Column, temperature: Column, max_tokens: Column
) -> DataFrame:
    """Two-turn conversations answered from storage, as a whole or not at all.

    ``conversations`` has ``system, turns``; the key of the second turn contains the
    first reply, so the two look-ups follow each other.  Adds ``reply_1, reply_2,
    available``.
    """
    stored = responses.select("prompt_key", "response_text")
    system, first, second = F.col("system"), F.col("turns")[0], F.try_element_at("turns", F.lit(2))
    opened = (
        conversations.withColumn("prompt_key", transcript_key(model, system, [("user", first)], temperature, max_tokens))
        .join(stored.withColumnRenamed("response_text", "reply_1"), "prompt_key", "left")
        .drop("prompt_key")
    )
    history = [("user", first), ("assistant", F.col("reply_1")), ("user", second)]
    closed = (
        opened.withColumn("prompt_key", transcript_key(model, system, history, temperature, max_tokens))
        .join(stored.withColumnRenamed("response_text", "reply_2"), "prompt_key", "left")
        .drop("prompt_key")
    )
    complete = F.col("reply_1").isNotNull() & (second.isNull() | F.col("reply_2").isNotNull())
    return closed.withColumn("available", complete)


def missing_cells(cells: DataFrame, recorded: DataFrame) -> DataFrame:
    """Cells that no earlier run recorded."""
    return cells.join(recorded.select(*CELL), CELL, "left_anti")


def budgeted(cells: DataFrame, max_new: int) -> DataFrame:
    """The first ``max_new`` pending cells in cell order."""
    return cells.orderBy(*CELL).limit(max_new)


def run_counters(cells: DataFrame, recorded: DataFrame, written: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Total, skipped, written, failed, live calls and cache misses of one run.

    ``written`` are the rows of this run: cell columns, ``error``, ``from_cache``.  Where a budget left pending cells
    out, ``asked`` are the others, and only those can be misses.
    """
    done = recorded.select(*CELL).distinct().withColumn("_done", F.lit(True))
    now = written.select(*CELL, F.lit(True).alias("_now"), "error", "from_cache")
    marked = cells.select(*CELL).join(done, CELL, "left").join(now, CELL, "left")
    skipped = F.coalesce("_done", F.lit(False))
    wrote = F.coalesce("_now", F.lit(False))
    missed = ~skipped & ~wrote
    if asked is not None:
        marked = marked.join(asked.select(*CELL).distinct().withColumn("_asked", F.lit(True)), CELL, "left")
        missed = missed & F.coalesce("_asked", F.lit(False))
    return marked.agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.count_if(skipped).alias("n_skipped_already_done"),
        F.count_if(~skipped & wrote).alias("n_written_this_run"),
        F.count_if(~skipped & wrote & F.col("error").isNotNull()).alias("n_recorded_failures"),
        F.count_if(~skipped & wrote & F.col("error").isNull() & ~F.coalesce("from_cache", F.lit(False))).alias("n_new_api_calls"),
        F.count_if(missed).alias("n_cache_misses_skipped"),
    )


def response_rows(turns: DataFrame) -> DataFrame:
    """Shape answered cells: ``turns`` is an array of ``text, latency_ms, from_cache, total_time, model``.

    The last turn is the answer; latencies add up; a cell counts as cached only
    when every turn is.
    """
    last = F.element_at("turns", -1)
    return turns.select(
        *CELL, "repo",
        last["text"].alias("response_text"),
        F.when(F.size("turns") > 1, F.transform("turns", lambda t: t["text"])).alias("turn_texts"),
        (F.size("turns") > 1).alias("is_conversational"),
        F.forall("turns", lambda t: t["from_cache"]).alias("from_cache"),
        F.aggregate("turns", F.lit(0.0), lambda total, t: total + t["latency_ms"]).alias("latency_ms"),
        last["total_time"].alias("total_time"),
        F.when(F.size("turns") > 1, F.transform("turns", lambda t: t["total_time"])).alias("turn_times"),
        last["model"].alias("model"),
        F.size(F.filter("turns", lambda t: ~t["from_cache"])).cast("long").alias("n_live_calls"),
    )


def ask(prompts: DataFrame, responder: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Send pending prompts to an injected responder, batch by batch inside the tasks."""
    return prompts.mapInPandas(responder, schema)
