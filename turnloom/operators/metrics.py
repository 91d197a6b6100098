"""Measures of packs and texts, as column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def payload_stats(raw: Column, gist: Column, graph: Column) -> Column:
    n = [F.length(F.coalesce(x, F.lit(""))).cast("long") for x in (raw, gist, graph)]
    return F.struct(
        n[0].alias("raw_chars"), n[1].alias("gist_chars"), n[2].alias("graph_chars"), F.coalesce(F.try_divide(n[1], n[0]), F.lit(0.0)).alias("ratio"),
        T.estimate_tokens(raw).alias("raw_tokens"), T.estimate_tokens(gist).alias("gist_tokens"),
    )


def entity_recall(terms: Column, payload: Column) -> Column:
    """Share of the distinct terms that a payload holds: as a keyword, inside its text, or in pieces."""
    low, own = F.lower(F.coalesce(payload, F.lit(""))), T.keyword_set(payload)
    wanted = F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(T.strip(t))), lambda t: t != ""))

    def has(t: Column) -> Column:
        return F.array_contains(own, t) | F.contains(low, t)

    def met(t: Column) -> Column:
        pieces = F.filter(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_./#-]+"), F.lit(0)), lambda p: F.length(p) > 1)
        return has(t) | ((F.size(pieces) > 0) & F.forall(pieces, has))

    return T.let(wanted, lambda ws: F.when(F.size(ws) == 0, F.lit(1.0)).otherwise(F.size(F.filter(ws, met)) / F.greatest(F.size(ws), F.lit(1))))


def harmonic_f1(precision: Column, recall: Column) -> Column:
    return F.when((precision <= 0) | (recall <= 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def dedup_yield(dup: Column, novel: Column) -> Column:
    """Suppressed share of what could have been sent; null where that is nothing."""
    d, n = F.greatest(dup, F.lit(0)), F.greatest(novel, F.lit(0))
    return F.when(d + n > 0, d / F.greatest(d + n, F.lit(1)))


def budget_fill(packed: Column, budget: Column) -> Column:
    return F.when(budget > 0, packed / F.greatest(budget, F.lit(1)))


def tokens_per_decision(tokens: Column, present: Column) -> Column:
    return F.when(present > 0, tokens / F.greatest(present, F.lit(1)))


def skip_rate(method: Column) -> Column:
    return F.coalesce(F.avg(F.when(method == "skip", 1.0).otherwise(0.0)), F.lit(0.0))


def percentile(value: str, p: float) -> Column:
    """Nearest rank: the least value with ``p`` percent of all at or below it; null of nothing."""
    return F.expr(f"percentile_disc({min(max(p, 0.0), 100.0) / 100}) WITHIN GROUP (ORDER BY {value})")


def retained(text: Column) -> Column:
    """Distinct lines that say something, without regard to case."""
    return T.first_distinct(F.filter(F.transform(T.lines(text), T.strip), lambda x: x != ""))


def design_precision(lines: Column, decisions: Column | None = None) -> Column:
    """Share of the lines that hold a labelled decision or are no small talk; 0 of nothing."""
    hit = (lambda x: F.exists(decisions, lambda d: F.contains(F.lower(x), F.lower(d)))) if decisions is not None else (lambda x: F.lit(False))
    kept = F.filter(lines, lambda x: T.strip(x) != "")
    return T.let(kept, lambda xs: F.when(F.size(xs) == 0, F.lit(0.0)).otherwise(F.size(F.filter(xs, lambda x: hit(x) | ~T.is_preamble(x))) / F.greatest(F.size(xs), F.lit(1))))


def pollution(hot_set: Column) -> Column:
    """Tokens of a hot set's distinct lines by what they are, and the share of paths and headings."""

    def kind(x: Column) -> Column:
        low = F.lower(x)
        item = F.contains(F.substring(low, 1, 20), F.lit("openitem "))
        path = x.rlike("(?iU)" + L.PATH_LIKE_RE)
        return F.when(item, "decision").when(path, "path").when(x.rlike("(?iU)" + L.HOT_KIND_RE), "decision").otherwise("other")

    def tokens(xs: Column, name: str) -> Column:
        return F.aggregate(F.filter(xs, lambda x: kind(x) == name), F.lit(0).cast("long"), lambda s, x: s + T.estimate_tokens(x))

    def all_of(xs: Column) -> Column:
        p, d, o = (tokens(xs, n) for n in ("path", "decision", "other"))
        return F.struct(p.alias("path_tokens"), d.alias("decision_tokens"), o.alias("other_tokens"), (p + d + o).alias("total_tokens"), F.coalesce(F.try_divide(p, p + d + o), F.lit(0.0)).alias("pollution"))

    return T.let(retained(hot_set), all_of)


def grade(ok: Column, attempted: Column) -> Column:
    """Of an array of step results."""
    return F.when(~attempted, "NOT_RUN").when(F.size(ok) == 0, "FAIL").when(F.forall(ok, lambda x: x), "FULL").when(F.exists(ok, lambda x: x), "PARTIAL").otherwise("FAIL")


def pick_model(available: Column, want: Column, aliases: Column) -> Column:
    """The name wanted, else that of the first alias there is, else the first that contains either."""
    first = lambda xs: F.get(xs, F.lit(0))
    named = lambda w: F.element_at(F.concat(F.filter(available, lambda x: F.lower(x) == F.lower(w)), F.array(F.lit(None).cast("string"))), 1)
    # of names that differ by case alone the last one stands
    last = lambda w: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(available, lambda x: F.lower(x) == F.lower(w))), -1)
    by_alias = first(F.filter(F.transform(aliases, last), lambda x: x.isNotNull()))
    inside = first(F.filter(available, lambda x: F.contains(F.lower(x), F.lower(want)) | F.exists(aliases, lambda a: F.contains(F.lower(x), F.lower(a)))))
    return F.coalesce(F.when(named(want).isNotNull(), last(want)), by_alias, inside)


def classify_method(producer: Column, via: Column) -> Column:
    own = via.isin("p2", "extractive+hot", "extractive", "hot_set", "p1-debug", "query-pack")
    return F.when(own, via).when(via == "p1", F.when(producer == "embed", "digest+p1").otherwise("gist-hf+p1")).otherwise("digest")


def roi(packs: DataFrame) -> DataFrame:
    """(conv_id, t, line): a pack's gains and the graph's make-up, as the stage log has them."""
    mix = F.concat_ws(",", *[F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("Turn", "n_turns"), ("Topic", "n_topics"), ("Fact", "n_facts"), ("OpenItem", "n_items"), ("Event", "n_events"))])
    line = F.concat(F.lit("novel_tokens="), F.col("novel_tokens").cast("string"), F.lit(" dup_suppressed_tokens="), F.col("dup_tokens").cast("string"), F.lit(" facts_by_kind="), mix, F.lit(" durable_facts="), F.col("n_durable").cast("string"))
    return packs.select("conv_id", "t", line.alias("line"))
