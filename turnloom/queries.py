"""The engine's registered queries: (spark, sf_dir) -> DataFrame, and the SQL that must agree."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import text as T
from .functions import vectors as V
from .operators import facts, lifecycle, views
from .sources import transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.read_conversations(spark, d)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


_KEYWORDS = "list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_./#-]+'), lambda x: length(x) > 1), lambda x: lower(x)))"
_TAU = "CASE WHEN length(coalesce({0}, '')) = 0 THEN 0 ELSE (length({0}) + 3) // 4 END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, ({_TAU.format('text')})::BIGINT AS tokens FROM conversations")
def token_estimate(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n FROM conversations")
def count_tokens(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("n"))


@query(f"SELECT conv_id, turn, substring(sha1(lower({_STRIP.format('text')})), 1, 16) AS h FROM conversations")
def line_hash(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.line_hash(F.col("text")).alias("h"))


@query(f"SELECT conv_id, turn, len({_KEYWORDS})::BIGINT AS n FROM conversations")
def keyword_set_size(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.size(T.keyword_set(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH a AS (SELECT conv_id, turn, {_KEYWORDS} AS k FROM conversations),
b AS (SELECT conv_id, turn, k, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM a)
SELECT conv_id, turn, round(len(list_intersect(k, p)) / greatest(len(list_distinct(list_concat(k, p))), 1), 9) AS j FROM b WHERE p IS NOT NULL""")
def turn_jaccard_prev(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", T.keyword_set(F.col("text")).alias("k"))
    rows = rows.selectExpr("conv_id", "turn", "k", "lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p").where("p IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("k"), F.col("p")), 9).alias("j"))


#: Written out apart from the library's patterns, so that a wrong one there shows.
_REDACTIONS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"\b(?:cursor_|sk-|ghp_|github_pat_|xox[baprs]-|AIza)[A-Za-z0-9_\-\.]{8,}\b", "<KEY>"),
    (r"(?i)\b(?:bearer|api[_-]?key|token)\s*[:=]\s*\S+", "<CREDENTIAL>"),
    (r"/(?:Users|home)/[^/\s]+", "<HOME>"),
    (r"[ \t]{2,}", " "),
)


def _redact_sql(x: str) -> str:
    for pattern, to in _REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _STRIP.format(x)


@query(f"SELECT doc_id, md5({_redact_sql('text')}) AS h FROM documents")
def redact_documents(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("h"))


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT conv_id, turn, len({_SENTENCES})::BIGINT AS n, md5(array_to_string({_SENTENCES}, '|')) AS h FROM conversations")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("h"))


def _kw(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[A-Za-z0-9_./#-]+'), lambda x: length(x) > 1), lambda x: lower(x)))"


def _on(pattern: str, points: float) -> str:
    quoted = pattern.replace("'", "''")
    return f"CASE WHEN regexp_matches(sentence, '(?i){quoted}') THEN {points} ELSE 0 END"


_SCORED = f"""u AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations),
s AS (SELECT conv_id, turn, prior, unnest({_SENTENCES}) AS raw, unnest(range(0, len({_SENTENCES}))) AS pos FROM u),
t AS (SELECT conv_id, turn, pos, prior, CASE WHEN length(raw) <= 240 THEN raw ELSE substring(raw, 1, 237) || '...' END AS sentence
  FROM (SELECT * REPLACE ({_STRIP.format("raw")} AS raw) FROM s) WHERE length(raw) >= 20),
f AS (SELECT conv_id, turn, pos, sentence, ({_on(r"\b(decided|chose|instead of|because|so that|constraint|invariant|must not|rather than|the fix is|impose|should not|reveal rule|contract|policy)\b", 3.0)} + {_on(r"\b(vs\.?|versus|trade-?off|rather than|instead of|compared to)\b", 1.5)} + {_on(r"\b\d+(\.\d+)?\s*(pages?|%|percent|tokens?|chars?|hours?|ms|kb|mb|lines?|chapters?|turns?)\b", 1.0)} + {_on(r"\b(is defined as|means that|defines |definition|fix:|replaces|maps? that)\b|\b\w+ is a \b", 2.0)} + {_on(r"^\s*(let me|i'll|i will|i'm going to|i am going to|reading|checking|running|thanks|thank you|got it|sure[,.]|looking at|let's see|i can |i'm finding|i read )\b", -3.0)}
  + 1.5 * least(len(regexp_extract_all(sentence, '(?i)\\b(phi|φ|part ii|part i|tier-?\\d|c\\d{{2}}-\\d{{2}}|unicity|hourglass|shannon)\\b')), 4)
  + CASE WHEN coalesce(prior, '') <> '' AND (CASE WHEN len(list_distinct(list_concat({_kw("sentence")}, {_kw("prior")}))) = 0 THEN 1.0
      ELSE len(list_intersect({_kw("sentence")}, {_kw("prior")})) / len(list_distinct(list_concat({_kw("sentence")}, {_kw("prior")}))) END) >= 0.6 THEN -4.0 ELSE 0.0 END)::DOUBLE AS score FROM t)"""


@query(f"WITH {_SCORED} SELECT conv_id, turn, pos::BIGINT AS pos, md5(sentence) AS h, score FROM f")
def sentence_fact_scores(spark, d):
    return facts.scored_sentences(_turns(spark, d)).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5(F.col("sentence").cast("binary")).alias("h"), "score")


@query(f"""WITH {_SCORED}, g AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS best FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pos) AS rank FROM g WHERE score > 0 OR best <= 0)
SELECT conv_id, turn, rank::BIGINT AS rank, md5(sentence) AS h, CASE WHEN score >= 2 THEN 'decision' ELSE 'sentence' END AS kind_hint FROM r WHERE rank <= 3""")
def sentence_facts_topn(spark, d):
    return facts.sentence_facts(_turns(spark, d)).select("conv_id", "turn", F.col("rank").cast("long").alias("rank"), F.md5(F.col("sentence").cast("binary")).alias("h"), "kind_hint")


@query("""SELECT conv_id, turn, md5(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS h FROM conversations""")
def prior_user_text(spark, d):
    return facts.with_prior_user(_turns(spark, d)).select("conv_id", "turn", F.md5(F.coalesce("prior_user", F.lit("")).cast("binary")).alias("h"))


@query(r"""WITH m AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '["'']([^"'']{2,80})["'']', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
  list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '(?i)\badd\b[:\s]+(.+)', 1), lambda x: string_split(x, ','))), lambda p: regexp_replace(p, '^[ .]+|[ .]+$', '', 'g')),
    lambda p: length(p) BETWEEN 2 AND 40 AND NOT contains(substring(p, 2), ' '))) AS found FROM documents),
f AS (SELECT doc_id, list_filter(found, lambda x: length(x) BETWEEN 2 AND 80) AS found FROM m),
s AS (SELECT doc_id, unnest(found) AS item, unnest(range(0, len(found))) AS p FROM f),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY p) AS n FROM s),
r AS (SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos FROM u WHERE n = 1)
SELECT doc_id, pos::BIGINT AS pos, item FROM r WHERE pos < 8""")
def quoted_items_documents(spark, d):
    return facts.quoted_items(_table(spark, d, "documents"), ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "item")


@query(r"""SELECT doc_id, name, count(*)::BIGINT AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b', 1))) AS name FROM documents) GROUP BY doc_id, name HAVING count(*) >= 2""")
def proper_noun_topics_documents(spark, d):
    return facts.repeated_names(_table(spark, d, "documents"), ["doc_id"])


@query("SELECT conv_id, turn AS src, p AS dst FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL")
def turn_continues_edges(spark, d):
    return views.continues_edges(_turns(spark, d))


@query("SELECT conv_id, turn, age::BIGINT AS age FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 32")
def active_turn_window32(spark, d):
    return views.active_turns(_turns(spark, d)).select("conv_id", "turn", F.col("age").cast("long").alias("age"))


@query(f"""SELECT conv_id, turn, ({_TAU.format("text")})::BIGINT AS tokens, (sum({_TAU.format("text")}) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS replay_tokens FROM conversations""")
def replay_tokens(spark, d):
    return views.replay_tokens(_turns(spark, d))


_NOVELTY = rf"""l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations),
h AS (SELECT conv_id, turn, substring(sha1(lower({_STRIP.format("line")})), 1, 16) AS h, ({_TAU.format("line")}) AS n FROM l WHERE {_STRIP.format("line")} <> ''),
q AS (SELECT *, count(*) OVER (PARTITION BY conv_id, h ORDER BY turn RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) > 0 AS dup FROM h),
v AS (SELECT conv_id, turn, sum(CASE WHEN NOT dup THEN n ELSE 0 END)::BIGINT AS novel_tokens, sum(CASE WHEN dup THEN n ELSE 0 END)::BIGINT AS dup_tokens FROM q GROUP BY conv_id, turn)"""


@query(f"WITH {_NOVELTY} SELECT * FROM v")
def line_novelty(spark, d):
    return views.line_novelty(_turns(spark, d))


@query(f"""WITH {_NOVELTY}, w AS (SELECT conv_id, turn, sum(novel_tokens + dup_tokens) OVER z AS p, sum(novel_tokens) OVER z AS n FROM v WINDOW z AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
r AS (SELECT conv_id, turn, CASE WHEN coalesce(p, 0) <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, n::DOUBLE / p)) END AS rate FROM w)
SELECT conv_id, turn, round(rate, 9) AS rate, (CASE WHEN turn <= 3 THEN 1024 ELSE greatest(64, least(1024, floor(1024 * greatest(0.5, rate)))) END)::BIGINT AS budget FROM r""")
def adaptive_budget(spark, d):
    return views.adaptive_budget(views.line_novelty(_turns(spark, d)))


@query("""WITH a AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(e::DOUBLE[], p::DOUBLE[]), 6) AS cos FROM a WHERE p IS NOT NULL""")
def adjacent_cosine(spark, d):
    return views.adjacent_cosine(_table(spark, d, "embeddings"))


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, count(DISTINCT vec_id)::BIGINT AS k, (count(*) // count(DISTINCT vec_id))::BIGINT AS d, round(sqrt(sum(x * x)), 6) AS frobenius, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY label""")
def matrix_stats(spark, d):
    return views.matrix_stats(_table(spark, d, "embeddings"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 5""")
def cosine_topk_embeddings(spark, d):
    v = _table(spark, d, "embeddings")
    return views.cosine_topk(v, v.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8) AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS s FROM n""")
def l2_normalize(spark, d):
    unit = V.normalise(F.col("embedding"))
    return _table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS n_conv FROM conversations GROUP BY role")
def session_turn_stats(spark, d):
    return _turns(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("n_conv"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(" + _redact_sql("text") + ") AS h FROM conversations WHERE role IN ('user', 'assistant', 'system')")
def transcript_roundtrip(spark, d):
    """Turns written as JSON lines and read back."""
    lines = transcripts.to_lines(_turns(spark, d)).withColumnRenamed("turn", "line")
    return transcripts.parse_lines(lines).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("h"))


@query()
def hash_embed_blake2b(spark, d):
    return _turns(spark, d).select("conv_id", "turn", V.embed(DEFAULT.dim)(F.col("text")).alias("vector"))


@query(f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM conversations),
s AS (SELECT conv_id, turn, pos, {_STRIP.format("line")} AS line FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(line) ORDER BY turn, pos) AS n FROM s WHERE line <> '')
SELECT conv_id, turn, pos::BIGINT AS pos, md5(line) AS h FROM u WHERE n = 1""")
def retained_lines(spark, d):
    return lifecycle.retained_lines(_turns(spark, d)).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5(F.col("line").cast("binary")).alias("h"))


@query(f"""WITH {_SCORED}, g AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS best FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pos) AS rank FROM g WHERE score > 0 OR best <= 0),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, rank DESC) AS age FROM r WHERE rank <= 3)
SELECT conv_id, turn, rank::BIGINT AS rank, age::BIGINT AS age, md5(sentence) AS h FROM a WHERE age <= 48""")
def prune_newest_facts(spark, d):
    rows = lifecycle.newest_facts(_turns(spark, d))
    return rows.select("conv_id", "turn", F.col("rank").cast("long").alias("rank"), F.col("age").cast("long").alias("age"), F.md5(F.col("sentence").cast("binary")).alias("h"))


@query("SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS h FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_query(spark, d):
    return lifecycle.last_query(_turns(spark, d)).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"))


@query("""WITH a AS (SELECT n_nationkey::BIGINT AS i, n_name AS token FROM nation), b AS (SELECT r_regionkey::BIGINT AS j, r_name AS token FROM region),
m AS (SELECT i, j, a.token = b.token AS same, bool_or(a.token = b.token) OVER (PARTITION BY i) AS hit, count(*) OVER (PARTITION BY i) AS n FROM a JOIN b ON substring(a.token, 1, 2) = substring(b.token, 1, 2))
SELECT i, j, round(CASE WHEN hit THEN 1.0 ELSE 1.0 / n END, 9)::DOUBLE AS mass FROM m WHERE same OR NOT hit
UNION ALL SELECT i, i % (SELECT count(*) FROM b), 1.0 FROM a WHERE i NOT IN (SELECT i FROM m)""")
def vocab_alignment(spark, d):
    a = _table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS i", "n_name AS token")
    b = _table(spark, d, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS j", "r_name AS token")
    return lifecycle.align_vocabularies(a, b).select("i", "j", F.round("mass", 9).alias("mass"))


from .plans import catalog as _catalog  # noqa: E402, F401  registers the rest
