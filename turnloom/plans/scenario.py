"""The offline scenario: every turn's pack held against the whole transcript by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators import extract as X
from ..operators import fold
from ..operators import metrics as M
from ..operators.views import replay_tokens

RECALL_GATE = 0.30


def so_far(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, terms, words): reference terms and keywords of the transcript up to each turn,
    read from "role: text" lines."""
    line = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", X.reference_terms(line).alias("r"), T.keyword_set(line).alias("k"))
    return rows.select("conv_id", "turn", *[F.array_distinct(F.flatten(F.collect_list(c).over(w))).alias(n) for c, n in (("r", "terms"), ("k", "words"))])


def scenario(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """A row a turn: its pack, the tokens a replay would take, and how much of the transcript the pack
    with its hot set still says."""
    packs = fold.conversation_packs(turns, config)
    rows = packs.join(replay_tokens(turns).drop("tokens"), ["conv_id", "turn"]).join(so_far(turns), ["conv_id", "turn"])
    payload = F.concat_ws("\n", "context", "hot_set")
    return rows.select(
        "conv_id", "turn", "t", "method", "packed_tokens", "budget", "novel_tokens", "dup_tokens", "replay_tokens", F.round(T.jaccard(F.col("words"), T.keyword_set(payload)), 9).alias("jaccard"),
        F.round(M.entity_recall(F.col("terms"), payload), 9).alias("recall"), F.round(M.pollution(F.col("hot_set"))["pollution"], 9).alias("pollution"),
        F.round(M.budget_fill(F.col("packed_tokens"), F.col("budget")), 9).alias("fill"), F.round(M.dedup_yield(F.col("dup_tokens"), F.col("novel_tokens")), 9).alias("yield"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row: tokens saved against a full replay, pack sizes, skips, and whether recall passes."""
    out = rows.agg(
        F.sum("replay_tokens").alias("replayed"), F.sum("packed_tokens").alias("packed"), M.percentile("packed_tokens", 50).cast("long").alias("median"), M.percentile("packed_tokens", 95).cast("long").alias("p95"),
        F.round(M.skip_rate(F.col("method")), 9).alias("skip_rate"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("pollution"), 9).alias("pollution"), F.round(M.dedup_yield(F.sum("dup_tokens"), F.sum("novel_tokens")), 9).alias("yield"),
    )
    delta = F.col("replayed") - F.col("packed")
    return out.withColumns({"delta": delta, "eta": F.round(1 - F.try_divide(F.col("packed"), F.col("replayed")), 9), "passed": F.col("recall") >= RECALL_GATE})


def forward_prompt(gist: Column, hot_set: Column, prior: Column, task: Column, context: Column | None = None) -> Column:
    """The text of a next step: what is remembered, the last reply, and the task."""
    said = F.when(T.strip(F.coalesce(prior, F.lit(""))) == "", "(none)").otherwise(T.strip(prior))
    parts = [F.concat(F.lit(f"{k}: "), v) for k, v in (("FORWARD_GIST", gist), ("HOT_SET", hot_set), ("PRIOR_STEP_REPLY", said), ("NEXT_TASK", task))]
    more = [] if context is None else [F.when(T.strip(context) != "", F.concat(F.lit("\nWORKSPACE_INVENTORY:\n"), T.strip(context)))]
    return F.concat_ws("\n", *parts, *more)


def prompt_chain(snapshots: DataFrame, tasks: list[str]) -> DataFrame:
    """(conv_id, step, prompt) from (conv_id, gist, hot_set, replies): each task with the reply to the
    one before it."""
    steps = F.posexplode(F.array(*[F.lit(t) for t in tasks])).alias("step", "task")
    rows = snapshots.select("conv_id", "gist", "hot_set", "replies", steps)
    prior = F.coalesce(F.get("replies", F.when(F.col("step") > 0, F.col("step") - 1)), F.lit(""))
    return rows.select("conv_id", "step", forward_prompt(F.col("gist"), F.col("hot_set"), prior, F.col("task")).alias("prompt"))


def report(summary_row: DataFrame) -> DataFrame:
    """One column ``proof``: the scenario's figures as a Markdown table."""
    names = [c for c in summary_row.columns]
    cells = [F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")), F.lit(" |")) for c in names]
    return summary_row.select(F.concat_ws("\n", F.lit("| measure | value |"), F.lit("|-|-|"), *cells).alias("proof"))
