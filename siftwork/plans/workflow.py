"""The review loop: all items of a step at once, bounded rounds and retries, every node injected as a function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import review

MAX_ITEMS, MAX_TOP_K, RETRIES, ROUNDS, RECURSION_LIMIT = 10, 30, 2, 2, 100
OVERFLOW = "graph_recursion_limit_exceeded"


def budget_stop(cancelled: Column, stop_reason: Column, calls: Column, max_calls: int, tokens: Column, max_tokens: int) -> Column:
    """The first reason to stop, or null."""
    return F.when(cancelled, "cancelled").when(stop_reason.isNotNull(), stop_reason).when(calls >= max_calls, "max_calls").when(tokens >= max_tokens, "token_budget")


def clamped(top_k: Column, most: int = MAX_TOP_K) -> Column:
    return F.least(F.greatest(top_k, F.lit(1)), F.lit(most))


def plan_items(items: DataFrame, most: int = MAX_ITEMS, max_top_k: int = MAX_TOP_K) -> DataFrame:
    """At most most items of each task in order, with top_k between 1 and max_top_k."""
    w = Window.partitionBy("task_id").orderBy("position")
    return items.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank").withColumn("top_k", clamped(F.col("top_k"), max_top_k))


def retried_items(items: DataFrame, attempt: int) -> DataFrame:
    """The items of a retrieval retry: first with keywords and focus words as query, then with parent folders and twice the top_k."""
    if attempt == 0:
        words = F.array_join(F.concat("keywords", "risk_focus"), " ")
        return items.withColumn("query", F.when(words != "", words).otherwise(F.col("query")))
    clean = F.filter(F.transform("target_paths", lambda p: F.rtrim(p, F.lit("/"))), lambda p: p != "")
    return items.withColumn("target_paths", paths.with_parents(clean)).withColumn("top_k", clamped(F.col("top_k") * 2))


def joined_contexts(contexts: DataFrame, by: list[str], order: str, context: str = "context") -> DataFrame:
    """(by, context): the contexts of an item's queries in order, a blank line between them."""
    return contexts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, context))), lambda x: x[context]), "\n\n").alias(context))


def review_rounds(issues: DataFrame, decisions: DataFrame, max_rounds: int = ROUNDS) -> DataFrame:
    """(fingerprint, ..., round, outcome, needs_human_review): verified or rejected issues after up to max_rounds rounds.

    issues and decisions have a round; in a round only issues that failed in the one before are reviewed again. The loop
    builds one plan: its length does not depend on the data.
    """
    done, retry = [], None
    for k in range(1, max_rounds + 1):
        now = issues.where(F.col("round") == k)
        if retry is not None:
            now = review.failed_again(now, retry)
        out = review.merged(now, decisions.where(F.col("round") == k), k, max_rounds)
        done.append(out.where("outcome <> 'retry'"))
        retry = out.where("outcome = 'retry'")
    return reduce(DataFrame.unionByName, done)


@dataclass(frozen=True)
class Nodes:
    """What a review needs from outside; each takes and returns tables.

    planner: tasks to items (task_id, item_id, position, top_k, query, keywords, risk_focus, target_paths). retrieve: items
    and the attempt, from 0, to the same rows with context and sufficient, so that what is retried needs no join. reviewer: items with context, the round and the issues
    that failed before (None in the first) to issues (task_id, item_id, fingerprint, pos, ...). evidence: issues to issues
    with evidence_status. critic: issues and the round to decisions (fingerprint, pos, decision, reason). guard: tasks to
    (task_id, stop_reason), null where a task may go on. recorder: is told of each step's name and rows.
    """

    planner: Callable[[DataFrame], DataFrame]
    retrieve: Callable[[DataFrame, int], DataFrame]
    reviewer: Callable[[DataFrame, int, DataFrame | None], DataFrame]
    evidence: Callable[[DataFrame], DataFrame]
    critic: Callable[[DataFrame, int], DataFrame]
    guard: Callable[[DataFrame], DataFrame] = lambda tasks: tasks.select("task_id", F.lit(None).cast("string").alias("stop_reason"))
    recorder: Callable[[str, DataFrame], None] = lambda name, rows: None


@dataclass
class Outcome:
    """The state after the last step. issues: verified and rejected ones with outcome; warnings: (task_id, item_id, warning);
    stops: (task_id, stop_reason) of tasks that the guard held; partial: whether the recursion limit cut the loop short."""

    issues: list[DataFrame] = field(default_factory=list)
    warnings: list[DataFrame] = field(default_factory=list)
    stops: DataFrame | None = None
    steps: int = 0
    partial: bool = False

    @property
    def stop_reason(self) -> str | None:
        return OVERFLOW if self.partial else None

    @property
    def status(self) -> str:
        return "partial_success" if self.partial else "success"


class _Overflow(Exception):
    pass


def run_review(tasks: DataFrame, nodes: Nodes, max_rounds: int = ROUNDS, retries: int = RETRIES, limit: int = RECURSION_LIMIT) -> Outcome:
    """Plans, retrieves with retries, reviews, checks evidence, asks the critic, and again for what failed, for all tasks at once.

    Each node is one step. A review that needs more than limit steps keeps what it has by then, marked partial.
    """
    out = Outcome()

    def step(name: str, rows: DataFrame) -> DataFrame:
        if out.steps >= limit:
            raise _Overflow
        out.steps += 1
        nodes.recorder(name, rows)
        return rows

    try:
        held = step("guard", nodes.guard(tasks))
        out.stops = held.where("stop_reason is not null")
        items = step("planner", plan_items(nodes.planner(tasks.join(held.where("stop_reason is null").select("task_id"), "task_id", "left_semi"))))
        ready = []
        for attempt in range(retries + 1):
            told = step("retrieve", nodes.retrieve(items, attempt))
            ready.append(told.where("sufficient").select("task_id", "item_id", "context"))
            items = told.where("not sufficient").select(*items.columns)
            if attempt < retries:
                items = step("rewrite_query", retried_items(items, attempt))
        out.warnings.append(items.select("task_id", "item_id", F.lit("insufficient_context_exhausted").alias("warning")))
        contexts, retry = reduce(DataFrame.unionByName, ready), None
        for k in range(1, max_rounds + 1):
            found = step("review", nodes.reviewer(contexts, k, retry))
            if retry is not None:
                found = review.failed_again(found, retry)
            checked = step("evidence_verify", nodes.evidence(found))
            failed = checked.where("evidence_status <> 'passed'")
            rejected = failed.withColumns({"decision": F.lit(None).cast("string"), "reason": F.lit("evidence"), "outcome": F.lit("rejected"), "needs_human_review": F.lit(False)})
            asked = checked.where("evidence_status = 'passed'")
            said = step("critic", review.merged(asked, nodes.critic(asked, k), k, max_rounds))
            out.issues += [x.withColumn("round", F.lit(k)) for x in (rejected, said.where("outcome <> 'retry'"))]
            retry = said.where("outcome = 'retry'")
    except _Overflow:
        out.partial = True
    return out


