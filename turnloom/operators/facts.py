"""Extractors: turns to rows of facts, quotes, names, headings, items. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import lexicon as L
from ..functions import text as T
from . import extract as X

KEYS = ("conv_id", "turn")


def with_prior_user(turns: DataFrame) -> DataFrame:
    """Add the text of the last user turn before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("prior_user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))


def scored_sentences(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(conv_id, turn, pos, sentence, score) of sentences of 20 characters or more."""
    rows = with_prior_user(turns).withColumn("prior_words", F.when(F.coalesce("prior_user", F.lit("")) != "", T.keyword_set(F.col("prior_user"))))
    rows = rows.select(*KEYS, "prior_words", F.posexplode(T.sentences(F.col("text"))).alias("pos", "raw"))
    rows = rows.withColumn("raw", T.strip(F.col("raw"))).where(F.length("raw") >= 20)
    rows = rows.withColumn("sentence", T.clip(F.col("raw"), 240))
    return rows.select(*KEYS, "pos", "sentence", T.fact_score(F.col("sentence"), F.col("prior_words"), config.identifiers).alias("score"))


def sentence_facts(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The best sentences of each turn; those without points only where no other has any."""
    per_turn = Window.partitionBy(*KEYS)
    ranked = per_turn.orderBy(F.desc("score"), F.asc("pos"))
    rows = scored_sentences(turns, config).withColumn("best", F.max("score").over(per_turn)).where("score > 0 OR best <= 0")
    rows = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= config.facts_per_turn)
    return rows.select(*KEYS, "rank", "sentence", "score", F.when(F.col("score") >= 2, "decision").otherwise("sentence").alias("kind_hint"))


def distinct_first(rows: DataFrame, keys: list[str], value: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The first of each value that differs by more than case, in order, ``limit`` a key."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, F.lower(value)).orderBy(*order))).where("__n = 1").drop("__n")
    if limit is None:
        return first
    return first.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def matches(rows: DataFrame, pattern: str, group: int, keys: list[str], text: str = "text") -> DataFrame:
    return rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("pos", "item"))


def exploded(rows: DataFrame, keys: list[str], found: Column, *names: str) -> DataFrame:
    """A row an element of ``found``: (keys, pos, the element or its named fields)."""
    out = rows.select(*keys, F.posexplode(found).alias("pos", "x"))
    return out.select(*keys, "pos", *[F.col(f"x.{n}") for n in names]) if names else out.withColumnRenamed("x", "item")


def quoted_items(rows: DataFrame, keys: list[str], limit: int = 8) -> DataFrame:
    return exploded(rows, keys, X.quoted(F.col("text"), limit))


def repeated_names(rows: DataFrame, keys: list[str], at_least: int = 2) -> DataFrame:
    """Capitalised word groups, of ASCII letters and blanks, that a text uses ``at_least`` times."""
    found = matches(rows, L.PROPER_ASCII_RE, 1, keys)
    return found.groupBy(*keys, F.lower("item").alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def headings(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, heading, level), the first eight outside of fences that differ a turn."""
    return exploded(turns, list(KEYS), X.headings(F.col("text")), "heading", "level")


def checkbox_items(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, item, state) of checkbox lines."""
    return exploded(turns, list(KEYS), X.checkboxes(F.col("text")), "item", "state")


def path_mentions(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(conv_id, turn, pos, path, mentions, salience): the paths of each turn that count, the best
    first; ``mentions`` runs over the conversation, and a path seen in fences only needs two."""
    rows = exploded(turns, list(KEYS), X.paths(F.col("text")), "path", "outside", "inside")
    so_far = Window.partitionBy("conv_id", F.lower("path")).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mentions", F.sum(F.col("outside") + F.col("inside")).over(so_far)).where("outside > 0 OR mentions >= 2")
    low = F.lower("path")

    def on(test: Column, points: float) -> Column:
        return F.when(test, F.lit(points)).otherwise(F.lit(0.0))

    salience = (
        F.lit(0.45) + F.least(F.col("mentions"), F.lit(3)) * 0.1 + on(F.col("outside") > 0, 0.15) + on(F.concat(F.lit("/"), low).contains("/scripts/"), 0.5) + on(F.concat(F.lit("/"), low).contains("/figures/"), 0.5)
        + on(low.rlike(r"\.(py|json|sh|tex|png)$"), 0.25) - on(low.rlike(r"\.log\.txt$|test-results/|\.cursor/"), 0.4) - on(low.startswith("/users/"), 0.2)
    )
    best = Window.partitionBy(*KEYS).orderBy(F.desc("salience"), F.asc("pos"))
    return rows.withColumn("salience", F.round(salience, 9)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.paths_per_turn).select(*KEYS, "pos", "path", "mentions", "salience", "rank")
