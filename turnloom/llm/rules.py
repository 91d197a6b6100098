"""Quality rules: a ledger that judges every rule once and keeps all the failures as bits.

Every rule is evaluated a single time per document. The ledger row holds the measurements and
one bit a failed rule, so a policy (a versioned mask of the rules that count) is one ``&``,
and an ablation over any number of policies is one aggregation over the distinct masks.

DataFrame functions only: no Python runs on the executors.

Repeated three-word windows are told by a 64-bit hash within one text.

Defined cases: a null text has no words, an empty or blank one neither, so both fail ``short``.
Repeated rows, and rows of one doc_id, are judged row by row; no rule has ties. ``passing`` returns
rows as they came, whatever their columns are called; ``ledger`` replaces columns named like its own.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements, true where the document breaks the rule."""

    name: str
    bit: int
    fails: str
    base: bool = False


@dataclass(frozen=True)
class Policy:
    """A version of what counts: a document is kept if none of these rules failed."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Iterable[Rule]) -> int:
        known = {r.name: r.bit for r in rules}
        return sum(1 << known[n] for n in self.rules)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_distinct_words")

RULES = (
    Rule("short", 0, "n_words < 50", base=True),
    Rule("repetitive", 1, "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", 2, "2 * n_symbols > n_words"),
    Rule("dup_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("shouting", 4, "3 * n_shouts > n_words"),
    Rule("word_length", 5, "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    # distinct words grow about as the square root of a text's length
    Rule("few_words", 6, "n_words >= 50 AND n_distinct_words * n_distinct_words < 4 * n_words"),
)

POLICIES = (
    Policy("v1", ("short", "repetitive")),
    Policy("v2", ("short", "repetitive", "symbols", "shouting", "word_length")),
    Policy("v3", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text as long columns."""
    drop = [c for c in df.columns if c.lower() in MEASURES]
    t = F.col("__t")
    df = df.drop(*drop).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__w", F.filter(F.split(t, BLANKS, -1), lambda w: w != "")).withColumn(
        "__l", F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    )
    w = F.col("__w")
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("__g", F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    g = F.col("__g")
    # (hash, place) in order: a place whose neighbour has its hash starts a repeated window
    placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(g)) < F.size(g), placed))
    s = F.col("__s")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])))
    df = df.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    lines = F.col("__l")
    out = {
        "n_words": n,
        "word_chars": _length_without(t, " \t\n\x0b\x0c\r"),
        "n_symbols": F.length(t) - _length_without(t, SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_shouts": F.expr("(length(__t) - length(replace(__t, '!!', ''))) div 2"),
        "n_distinct_words": F.size(F.array_distinct(w)),
    }
    return df.withColumns({k: v.cast("long") for k, v in out.items()}).drop("__t", "__w", "__l", "__g", "__s", "__p")


def ledger(df: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """Measurements plus ``failed``: bit r is set where rule r failed."""
    df = measure(df.drop("failed"), text)
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return df.withColumn("failed", bits)


def base_mask(rules: Iterable[Rule] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.base)


def apply_policy(entries: DataFrame, policy: Policy = CURRENT, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``policy`` to a ledger; the texts are not read again."""
    failed = F.col("failed")
    return entries.withColumns(
        {
            "base_failed": failed.bitwiseAND(F.lit(base_mask(rules))) != 0,
            "kept": failed.bitwiseAND(F.lit(policy.mask(rules) | base_mask(rules))) == 0,
            "policy": F.lit(policy.version),
        }
    )


def passing(df: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, as they came.

    Each row travels as one struct beside its text, so none of its columns meets a measurement. The
    row number keeps the optimiser from moving the filter below the measurements, where each would be
    spelt out again inside the next."""
    rows = df.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    judged = apply_policy(ledger(rows, "__text"), policy)
    return judged.withColumn("__n", F.monotonically_increasing_id()).where("kept AND __n >= 0").select("__row.*")


def ablations(entries: DataFrame, policies: Iterable[Policy] = POLICIES, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, that it alone rejects, and that would be kept
    without it. The ledger shrinks to its distinct masks first (2 to the number of rules at most)."""
    rules = tuple(rules)
    masks = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.version, p.mask(rules), r.name, 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    case = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("bigint").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for v, m, r, b in cases]))
    x = masks.select("failed", "n", case.alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return x.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def query(docs: DataFrame) -> DataFrame:
    judged = apply_policy(ledger(docs.select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_shouts", "n_distinct_words", "failed")


ORACLE = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
b AS (
  SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g
  FROM a),
p AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM b),
r AS (SELECT doc_id, g, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p),
s AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM s GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, ((length(t) - length(replace(t, '!!', ''))) // 2)::BIGINT AS n_shouts,
    len(list_distinct(w))::BIGINT AS n_distinct_words
  FROM b LEFT JOIN n ON b.doc_id = n.doc_id),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 3 * n_shouts > n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words >= 50 AND n_distinct_words * n_distinct_words < 4 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  failed = 0 AS kept, n_lines, n_shouts, n_distinct_words, failed
FROM f
"""
