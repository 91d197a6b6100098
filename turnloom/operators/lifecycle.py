"""Open and finished items: what a turn opens, closes, defers or reports, and which meets which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract as X
from .facts import KEYS, distinct_first, exploded, headings, sentence_facts


def open_items(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, item, state, family)."""
    return exploded(turns, list(KEYS), X.open_items(F.col("text")), "item", "state", "family")


def done_items(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, item, family)."""
    return exploded(turns, list(KEYS), X.done_items(F.col("text")), "item", "family")


def outcome_items(turns: DataFrame) -> DataFrame:
    return exploded(turns, list(KEYS), X.outcomes(F.col("text")))


def deferred_items(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, item): bullets of sections of deferred work."""
    return exploded(turns, list(KEYS), X.deferred_section(F.col("text")))


def design_facts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, summary, hint)."""
    return exploded(turns, list(KEYS), X.design_facts(F.col("text")), "summary", "hint")


def topic_labels(turns: DataFrame, limit: int = 8) -> DataFrame:
    """(conv_id, turn, pos, item): labelled topics, top headings, and names that a turn uses twice."""
    text = F.col("text")
    heads = F.transform(F.filter(X.headings(text), lambda x: x["level"] <= 2), lambda x: x["heading"])
    twice = F.transform(F.filter(X.names(text), lambda x: x["n"] >= 2), lambda x: x["name"])
    found = F.filter(F.concat(X.topic_lines(text), heads, twice), lambda x: F.length(x) >= 2)
    return exploded(turns, list(KEYS), T.first_distinct(found, limit=limit))


def closures(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, done, open_turn, opened): each finished item with the newest open item of an
    earlier turn that equals it, contains it or is contained in it."""
    opened = open_items(turns).select("conv_id", F.col("turn").alias("open_turn"), F.col("pos").alias("open_pos"), F.col("item").alias("opened"))
    done = done_items(turns).select(*KEYS, F.col("item").alias("done"))
    a, b = F.lower("done"), F.lower("opened")
    # the conversation is the equality key; its items are few, the substring test is the residue
    met = done.join(opened, "conv_id").where((F.col("open_turn") < F.col("turn")) & (F.contains(a, b) | F.contains(b, a)))
    newest = Window.partitionBy("conv_id", "turn", "done").orderBy(F.desc("open_turn"), F.desc("open_pos"))
    return met.withColumn("n", F.row_number().over(newest)).where("n = 1").select("conv_id", "turn", "done", "open_turn", "opened")


def top_headings(turns: DataFrame) -> DataFrame:
    return headings(turns).where("level <= 2")


def retained_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, line): the first of each line of a conversation, without regard to case."""
    rows = turns.select(*KEYS, F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    return distinct_first(rows, ["conv_id"], "line", ["turn", "pos"])


def newest_facts(turns: DataFrame, keep: int = 48) -> DataFrame:
    """The newest sentence facts of a conversation: what pruning leaves of them."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("rank"))
    return sentence_facts(turns).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep)


def last_query(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of the last user turn of each conversation."""
    user = F.col("role") == "user"
    best = turns.where(user).groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("x"))
    return best.select("conv_id", "x.turn", "x.text")


def align_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, mass) from (i, token) and (j, token): the equal token; else all tokens that start with
    the same two characters, in equal shares; else the one at i modulo the size of ``b``."""
    size = b.agg(F.count(F.lit(1)).alias("size"))
    same = a.join(b.groupBy("token").agg(F.max("j").alias("j")), "token").select("i", "j", F.lit(1.0).alias("mass"))
    rest = a.join(same, "i", "left_anti")
    near = rest.withColumn("p", F.substring("token", 1, 2)).join(b.select("j", F.substring("token", 1, 2).alias("p")), "p")
    near = near.select("i", "j", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("i"))).alias("mass"))
    else_ = rest.join(near, "i", "left_anti").join(F.broadcast(size), F.lit(True)).where("size > 0")  # one row
    return same.unionAll(near).unionAll(else_.select("i", F.expr("i % size").alias("j"), F.lit(1.0).alias("mass")))
