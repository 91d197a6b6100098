"""The rest of the registered queries: extractors over marked texts, the graph, packs, stores, events.

The driver's conversations hold no marks, so extractors run on ``MARKS``, whose lines go through every
family with its limits, fences, repeats and near misses. The SQL twins are written out by hand, apart
from the library's patterns; where SQL can't say it, tests hold the query against brute force.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..functions import vectors as V
from ..operators import bridge, chunk, facts, fold, lifecycle, rank, views
from ..operators import extract as X
from ..operators import metrics as M
from ..queries import _STRIP, _TAU, _table, _turns, query
from ..sources import store, transcripts
from ..streaming import events
from . import scenario as S

MARKS = (
    (1, 0, "user", "# Plan\n- [ ] write docs\n- [x] set up ci\n## Next steps\nTODO: call Bob\nnext: mow `lawn`\nremaining: tests\n* [ ] Write  Docs"),
    (1, 1, "assistant", 'Drafted "write docs", rest later.\nfixed: tests.\nvalidation passed; 3 broken links; fixed src/a.py now. 3 broken links\ncompleted: "ci"'),
    (1, 2, "user", "## Deferred work\n- move db\n### Sub\n* rename `x`\n## Other\n- not this\n- this is out of scope\nleft alone for now\n# deferred heading"),
    (1, 3, "assistant", "# Out of scope\n- x1\ntext\n- [x] x2\nmark 'ship it' and 'call Bob' done\n## Left unresolved\n- deep\n# Again\n- gone\n1. fix the door\n2. look away\n 3. must go"),
    (2, 0, "user", "Topic: glossary rewrite\ngoal:  standardise fields \n# Setup\n```md\n# in a fence\nsrc/in.py and data/x.json\n```\n## Setup\n## Use it\nNew York and New York, Los Angeles"),
    (2, 1, "assistant", "Recommended structure\n- structure: term -> definition -> example\n- short\ndecision: keep hashed ranking as the default\n\nplain line after a blank\narrow -> without a block. And more"),
    (2, 2, "user", 'add milk, bread, two words. Open "the box" and \'a jar\'\nSee scripts/run.py, src/in.py and docs/README.md, SRC/in.py'),
    (2, 3, "assistant", "data/x.json\n```\nsrc/only.tex\n```\n```\nsrc/only.tex data/x.json\n```\nfigures/a.png test-results/b.log.txt c.md d.md e.md f.md g.md h.md"),
    (3, 0, "user", ""),
    (3, 1, "assistant", "nothing here"),
)
_V = "v(conv_id, turn, role, text) AS (VALUES " + ", ".join(f"({c}::BIGINT, {t}::BIGINT, '{r}', '" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for c, t, r, x in MARKS) + ")"
_L = "l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM v)"


def _marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m,) for m in MARKS], "conv_id long, turn long, role string, text string")


def _pos(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.col("pos").cast("long"))


def _first(source: str, value: str, limit: int, columns: str) -> str:
    """Twin of first-wins: rows of ``source`` (conv_id, turn, p and columns) numbered anew."""
    return f"""(SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) - 1 AS pos, {columns}
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower({value}) ORDER BY p) AS n FROM {source}) WHERE n = 1) WHERE pos < {limit}"""


def _clean(x: str) -> str:
    y = rf"regexp_replace({_STRIP.format(f'regexp_replace({x}, {chr(39)}[*`]+{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '\s+', ' ', 'g')"
    return f"regexp_replace(CASE WHEN length({y}) <= 80 THEN {y} ELSE substring({y}, 1, 77) || '...' END, '^[ .]+|[ .]+$', '', 'g')"


# ------------------------------------------------------------------ extractors

_HEADS = rf"""{_V}, u AS (SELECT conv_id, turn, regexp_replace(text, '(?s)```[^\n]*\n.*?```', chr(10), 'g') AS text FROM v),
h AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?m)^(#{{1,6}})\s+(.+)$', 1)) AS marks, unnest(regexp_extract_all(text, '(?m)^(#{{1,6}})\s+(.+)$', 2)) AS heading, unnest(range(0, len(regexp_extract_all(text, '(?m)^(#{{1,6}})\s+(.+)$')))) AS p FROM u),
g AS (SELECT conv_id, turn, p, trim(heading) AS heading, length(marks) AS level FROM h WHERE length(trim(heading)) >= 2)"""


@query(f"WITH {_HEADS} SELECT conv_id, turn, pos::BIGINT AS pos, heading, level::BIGINT AS level FROM {_first('g', 'heading', 8, 'heading, level')}")
def headings(spark, d):
    return _pos(facts.headings(_marks(spark))).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_HEADS} SELECT conv_id, turn, pos::BIGINT AS pos, heading, level::BIGINT AS level FROM {_first('g', 'heading', 8, 'heading, level')} AND level <= 2")
def headings_h1_h2(spark, d):
    return _pos(lifecycle.top_headings(_marks(spark))).withColumn("level", F.col("level").cast("long"))


@query(rf"""WITH {_V}, c AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?m)^\s*[-*]\s+\[([ xX])\]\s+(.+)$', 1)) AS mark, unnest(regexp_extract_all(text, '(?m)^\s*[-*]\s+\[([ xX])\]\s+(.+)$', 2)) AS x, unnest(range(0, len(regexp_extract_all(text, '(?m)^\s*[-*]\s+\[([ xX])\]\s+(.+)$')))) AS p FROM v)
SELECT conv_id, turn, p::BIGINT AS pos, {_clean('x')} AS item, CASE WHEN mark = ' ' THEN 'open' ELSE 'done' END AS state FROM c""")
def checkbox_items(spark, d):
    return _pos(facts.checkbox_items(_marks(spark)))


_SECTION = rf"""{_L},
s(conv_id, turn, pos, level) AS (SELECT conv_id, turn, -1::BIGINT, 0::BIGINT FROM v
  UNION ALL SELECT l.conv_id, l.turn, l.pos, CASE WHEN regexp_matches(l.line, '^#{{1,6}}\s+.') AND regexp_matches(l.line, '(?i)\b(left unresolved|deferred|out of scope|unresolved)\b') THEN length(regexp_extract(l.line, '^(#+)', 1))
      WHEN regexp_matches(l.line, '^#{{1,6}}\s+.') AND length(regexp_extract(l.line, '^(#+)', 1)) <= s.level THEN 0 ELSE s.level END
    FROM s JOIN l ON l.conv_id = s.conv_id AND l.turn = s.turn AND l.pos = s.pos + 1),
sec AS (SELECT l.conv_id, l.turn, l.pos, {_clean(r"regexp_extract(line, '^\s*[-*]\s+(?:\[[ xX]\]\s+)?(.+)$', 1)")} AS item FROM l JOIN s USING (conv_id, turn, pos) WHERE level > 0 AND regexp_matches(line, '^\s*[-*]\s+.'))"""


@query(f"WITH RECURSIVE {_V}, {_SECTION} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS pos, item FROM sec WHERE item <> ''")
def deferred_items(spark, d):
    return _pos(lifecycle.deferred_items(_marks(spark)))


def _family(number: int, name: str, pattern: str, state: str = "open") -> str:
    found = f"regexp_extract_all(text, '{pattern}', 1)"
    return f"SELECT conv_id, turn, {number} * 1000000 + unnest(range(0, len({found}))) AS p, '{name}' AS family, '{state}' AS state, unnest({found}) AS x FROM v"


_QUOTES = """list_concat(list_transform(regexp_extract_all(text, '["'']([^"'']{2,80})["'']', 1), lambda x: trim(x)),
  list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '(?i)\\badd\\b[:\\s]+(.+)', 1), lambda x: string_split(x, ','))), lambda y: regexp_replace(y, '^[ .]+|[ .]+$', '', 'g')), lambda y: length(y) BETWEEN 2 AND 40 AND NOT contains(substring(y, 2), ' ')))"""
_OPEN = rf"""{_V}, {_SECTION},
f AS ({_family(1, 'checkbox', r'(?m)^\s*[-*]\s+\[ \]\s+(.+)$')}
  UNION ALL {_family(2, 'todo', r'(?mi)\bTODO:\s*(.+)$')}
  UNION ALL {_family(3, 'next', r'(?mi)^\s*next:\s*(.+)$')}
  UNION ALL {_family(4, 'label', r'(?mi)^\s*(?:[-*]\s*)?(?:open item|todo|remaining|follow-up|next)\s*:\s*(.+)$')}
  UNION ALL SELECT conv_id, turn, 5000000 + pos, 'section', 'deferred', item FROM sec
  UNION ALL SELECT conv_id, turn, 6000000 + 2 * pos, 'hint', 'deferred', CASE WHEN regexp_matches(line, '^\s*[-*]\s+.') THEN regexp_extract(line, '^\s*[-*]\s+(?:\[[ xX]\]\s+)?(.+)$', 1) ELSE line END FROM l
    WHERE regexp_matches(line, '(?i)\b(deferred|out of scope|left unresolved|left alone|untouched because)\b') AND NOT regexp_matches(line, '^#{{1,6}}\s+')
  UNION ALL SELECT conv_id, turn, 6000001 + 2 * pos, 'numbered', 'open', regexp_extract(line, '^\s*\d+\.\s+(.+)$', 1) FROM l
    WHERE regexp_matches(line, '^\s*\d+\.\s+.') AND regexp_matches(line, '(?i)\b(should|must|need to|fix|add|move|keep|treat|impose|defer|todo)\b')
  UNION ALL SELECT conv_id, turn, 7000000 + i, 'quoted', 'open', x FROM (SELECT conv_id, turn, unnest(q) AS x, unnest(range(0, len(q))) AS i FROM (SELECT conv_id, turn, {_QUOTES} AS q FROM v WHERE regexp_matches(text, '(?i)\b(todo|open|add|create|remain|left|item)\b')))),
c AS (SELECT conv_id, turn, p, family, state, {_clean('x')} AS item FROM f), o AS (SELECT * FROM c WHERE length(item) >= 2)"""


@query(f"WITH RECURSIVE {_OPEN} SELECT conv_id, turn, pos::BIGINT AS pos, item, state, family FROM {_first('o', 'item', 16, 'item, state, family')}")
def open_items(spark, d):
    return _pos(lifecycle.open_items(_marks(spark)))


_DONE_Q = r"(?i)(?:mark(?:ed)?|completed?)\s+[\"'']([^\"'']+)[\"'']|[\"'']([^\"'']+)[\"'']\s+(?:done|complete)|completed[:\s]+[\"'']([^\"'']+)[\"'']"
_DONE = rf"""{_V}, q AS (SELECT conv_id, turn, {', '.join(f"regexp_extract_all(text, '{_DONE_Q}', {g}) AS g{g}" for g in (1, 2, 3))} FROM v),
dn AS (SELECT conv_id, turn, 1000000 + i AS p, 'quoted' AS family, trim(coalesce(g1[i], '') || coalesce(g2[i], '') || coalesce(g3[i], '')) AS item FROM (SELECT *, unnest(range(1, len(g1) + 1)) AS i FROM q)
  UNION ALL SELECT conv_id, turn, p, family, regexp_replace(trim(x), '^[-*\[\]() \t`"''.]+|[-*\[\]() \t`"''.]+$', '', 'g') FROM ({_family(2, 'line', r'(?mi)^\s*(?:[-*]\s*)?(?:completed|done|fixed|resolved|validation)\s*:\s*(.+)$')})
  UNION ALL SELECT conv_id, turn, p, family, regexp_replace(trim(x), '^[ .]+|[ .]+$', '', 'g') FROM ({_family(3, 'verb', r'(?i)\b(?:drafted|implemented|verified|completed|marked)\s+["'']?([^"''\n,]{2,80})["'']?')}) WHERE length(regexp_replace(trim(x), '^[ .]+|[ .]+$', '', 'g')) >= 2
  UNION ALL SELECT conv_id, turn, p, family, {_clean('x')} FROM ({_family(4, 'checkbox', r'(?m)^\s*[-*]\s+\[[xX]\]\s+(.+)$')})),
dd AS (SELECT * FROM dn WHERE item <> '')"""


@query(f"WITH {_DONE} SELECT conv_id, turn, pos::BIGINT AS pos, item, family FROM {_first('dd', 'item', 10**6, 'item, family')}")
def done_items(spark, d):
    return _pos(lifecycle.done_items(_marks(spark)))


@query(rf"""WITH RECURSIVE {_OPEN}, {_DONE.partition(', q AS')[2] and 'q AS' + _DONE.partition(', q AS')[2]},
op AS (SELECT * FROM {_first('o', 'item', 16, 'item')}), dp AS (SELECT * FROM {_first('dd', 'item', 10**6, 'item')}),
m AS (SELECT a.conv_id, a.turn, a.item AS done, b.turn AS open_turn, b.item AS opened, row_number() OVER (PARTITION BY a.conv_id, a.turn, a.item ORDER BY b.turn DESC, b.pos DESC) AS n
  FROM dp a JOIN op b ON a.conv_id = b.conv_id AND b.turn < a.turn AND (contains(lower(a.item), lower(b.item)) OR contains(lower(b.item), lower(a.item))))
SELECT conv_id, turn, done, open_turn, opened FROM m WHERE n = 1""")
def item_closures(spark, d):
    return lifecycle.closures(_marks(spark))


@query(rf"""WITH {_V}, r AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)\b(?:\d+\s+(?:entries?\s+standardized|broken\s+links?)|Ch\d+\s+[A-Z]{{1,4}}-\d+\s+link\s+fixed|validation\s+passed|fixed\s+[\w./#-]+)\b')) AS x,
  unnest(range(0, len(regexp_extract_all(text, '(?i)\b(?:\d+\s+(?:entries?\s+standardized|broken\s+links?)|Ch\d+\s+[A-Z]{{1,4}}-\d+\s+link\s+fixed|validation\s+passed|fixed\s+[\w./#-]+)\b')))) AS p FROM v)
SELECT conv_id, turn, pos::BIGINT AS pos, item FROM {_first(r"(SELECT conv_id, turn, p, regexp_replace(x, '\s+', ' ', 'g') AS item FROM r)", 'item', 8, 'item')}""")
def outcome_items(spark, d):
    return _pos(lifecycle.outcome_items(_marks(spark)))


_EDGE = r"[-*\[\]() \t`\"'']"


@query(rf"""WITH RECURSIVE {_V}, {_L},
t AS (SELECT conv_id, turn, pos, trim(line) AS line, trim(line) = '' AS blank,
  starts_with(trim(line), '#') OR (NOT regexp_matches(trim(line), '^[-*]') AND regexp_matches(line, '(?i)\b(?:recommended structure|template|decision|design|glossary design)\b') AND NOT regexp_matches(line, '[=:]')) AS opens FROM l),
b(conv_id, turn, pos, before, after) AS (SELECT conv_id, turn, -1::BIGINT, false, false FROM v
  UNION ALL SELECT t.conv_id, t.turn, t.pos, b.after, NOT t.blank AND (t.opens OR b.after) FROM b JOIN t ON t.conv_id = b.conv_id AND t.turn = b.turn AND t.pos = b.pos + 1),
m AS (SELECT t.conv_id, t.turn, t.pos AS p, line, before, lower(regexp_extract(line, '(?i)^\s*(?:[-*]\s*)?(?:(structure|entry fields|fields|recommendation|decision|design)\s*[=:]\s*)?(.+)$', 1)) AS marker,
  regexp_replace(trim(regexp_extract(line, '(?i)^\s*(?:[-*]\s*)?(?:(structure|entry fields|fields|recommendation|decision|design)\s*[=:]\s*)?(.+)$', 2)), '^[-*\[\]() \t`"''.]+|[-*\[\]() \t`"''.]+$', '', 'g') AS body
  FROM t JOIN b USING (conv_id, turn, pos) WHERE NOT blank AND NOT opens),
k AS (SELECT conv_id, turn, p, trim(regexp_replace(regexp_replace(string_split(CASE WHEN marker <> '' THEN marker || ': ' || body ELSE body END, '. ')[1], '\s+', ' ', 'g'), '^{_EDGE}+|{_EDGE}+$', '', 'g')) AS summary,
  CASE WHEN marker = 'decision' OR starts_with(lower(line), 'decision') THEN 'decision' ELSE 'design' END AS hint FROM m WHERE length(body) >= 8 AND (before OR marker <> '' OR contains(body, '->')))
SELECT conv_id, turn, pos::BIGINT AS pos, summary, hint FROM {_first('k', 'summary', 8, 'summary, hint')}""")
def design_facts(spark, d):
    return _pos(lifecycle.design_facts(_marks(spark)))


@query(rf"""WITH {_HEADS}, hh AS (SELECT * FROM {_first('g', 'heading', 8, 'heading, level')} AND level <= 2),
n AS (SELECT conv_id, turn, name, min(i) AS i FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b', 1)) AS name, unnest(range(0, len(regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b')))) AS i FROM v) GROUP BY conv_id, turn, name HAVING count(*) >= 2),
a AS (SELECT conv_id, turn, p, regexp_replace(trim(x), '^[-*\[\]() \t`"''.]+|[-*\[\]() \t`"''.]+$', '', 'g') AS item FROM ({_family(1, 'topic', r'(?mi)^[ \t]*(?:topic|goal|workstream|task)[ \t]*:[ \t]*(.+)$')})
  UNION ALL SELECT conv_id, turn, 2000000 + pos, heading FROM hh UNION ALL SELECT conv_id, turn, 3000000 + i, name FROM n)
SELECT conv_id, turn, pos::BIGINT AS pos, item FROM {_first('a', 'item', 8, 'item')}""")
def topic_labels(spark, d):
    return _pos(lifecycle.topic_labels(_marks(spark)))


_EXT = r"(?:md|py|ts|tsx|json|tex|sh|bash|zsh|yaml|yml|toml|cfg|ini|sql|rs|go|java|kt|swift|c|h|cpp|css|scss|html|png|jpg|svg|pdf|log\.txt)"
_PATHS = rf"(?i)(?:[\w./-]+/)*[\w.-]+\.{_EXT}\b"


@query(rf"""WITH {_V}, u AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '(?s)```[^\n]*\n.*?```', chr(10), 'g'), '{_PATHS}') AS a, regexp_extract_all(array_to_string(regexp_extract_all(text, '(?s)```[^\n]*\n.*?```'), chr(10)), '{_PATHS}') AS b FROM v),
e AS (SELECT conv_id, turn, unnest(list_concat(a, b)) AS path, unnest(range(0, len(a) + len(b))) AS p, len(a) AS n_out FROM u),
g AS (SELECT conv_id, turn, lower(path) AS k, arg_min(path, p) AS path, min(p) AS p, count(*) AS n, count_if(p < n_out) AS outside FROM e GROUP BY conv_id, turn, lower(path)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) - 1 AS pos, (sum(n) OVER (PARTITION BY conv_id, k ORDER BY turn))::BIGINT AS mentions FROM g),
s AS (SELECT *, round(0.45::DOUBLE + 0.1 * least(mentions, 3) + CASE WHEN outside > 0 THEN 0.15 ELSE 0 END + CASE WHEN contains('/' || k, '/scripts/') THEN 0.5 ELSE 0 END + CASE WHEN contains('/' || k, '/figures/') THEN 0.5 ELSE 0 END
  + CASE WHEN regexp_matches(k, '\.(py|json|sh|tex|png)$') THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(k, '\.log\.txt$|test-results/|\.cursor/') THEN 0.4 ELSE 0 END - CASE WHEN starts_with(k, '/users/') THEN 0.2 ELSE 0 END, 9)::DOUBLE AS salience FROM o WHERE outside > 0 OR mentions >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY salience DESC, pos) AS rank FROM s)
SELECT conv_id, turn, pos::BIGINT AS pos, path, mentions, salience, rank::BIGINT AS rank FROM r WHERE rank <= 8""")
def path_facts(spark, d):
    return _pos(facts.path_mentions(_marks(spark))).withColumn("rank", F.col("rank").cast("long"))


@query(rf"""SELECT doc_id, len(list_distinct(r))::BIGINT AS n, md5(array_to_string(list_sort(list_distinct(r)), '|')) AS h FROM (SELECT doc_id, list_filter(list_concat(regexp_extract_all(text, '{_PATHS}'),
  list_transform(regexp_extract_all(text, '(?m)^#{{1,6}}\s+(.+)$', 1), lambda x: trim(x)), list_transform(regexp_extract_all(text, '["'']([^"'']{{2,80}})["'']', 1), lambda x: {_STRIP.format('x')})), lambda x: length(x) >= 2) AS r FROM documents)""")
def reference_terms(spark, d):
    r = F.array_sort(X.reference_terms(F.col("text")))
    return _table(spark, d, "documents").select("doc_id", F.size(r).cast("long").alias("n"), F.md5(F.array_join(r, "|").cast("binary")).alias("h"))


@query()
def extractive_gist_documents(spark, d):
    """Tested against the fold's own gist over whole tables."""
    return _table(spark, d, "documents").select("doc_id", X.gist(F.col("text"), DEFAULT.gist_tokens).alias("gist"))


@query(r"""SELECT conv_id, turn, len(t)::BIGINT AS n, md5(array_to_string(list_sort(t), '|')) AS h FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(translate(text, '/-.', '   ')), '\s+'), lambda w: length(w) >= 3)) AS t FROM conversations)""")
def query_terms(spark, d):
    t = F.array_sort(T.query_terms(F.col("text")))
    return _turns(spark, d).select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "|").cast("binary")).alias("h"))


@query(r"""WITH a AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS k FROM conversations),
b AS (SELECT conv_id, turn, k, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM a)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(k, p))) = 0 THEN 1.0 ELSE len(list_intersect(k, p)) / len(list_distinct(list_concat(k, p))) END, 9)::DOUBLE AS j FROM b WHERE p IS NOT NULL""")
def token_jaccard_prev(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", T.alnum_set(F.col("text")).alias("k")).selectExpr("conv_id", "turn", "k", "lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p").where("p IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("k"), F.col("p")), 9).alias("j"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS x FROM documents), b AS (SELECT doc_id, x, rtrim(substring(x, 1, 93), ' ') AS c FROM a),
e AS (SELECT *, length(c) - strpos(reverse(c), ' ') AS i FROM b)
SELECT doc_id, CASE WHEN length(x) <= 96 THEN x ELSE regexp_replace(CASE WHEN contains(c, ' ') AND i >= 48 THEN substring(c, 1, i) ELSE c END, '[ ,;:-]+$', '') || '...' END AS label FROM e""")
def label_documents(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.label(F.col("text")).alias("label"))


@query(r"""SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN 0.0 ELSE round(len(list_filter(l, lambda x: NOT regexp_matches(lower(x), '^((openitem|fact|topic|event|turn)\s*:?\s+)?[: ]*(let me|i''ll|i will|reading|checking|running|thanks|thank you|got it|looking at|let''s see)'))) / len(l), 9) END::DOUBLE AS p
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)""")
def design_precision(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return _turns(spark, d).select("conv_id", "turn", F.round(M.design_precision(lines), 9).alias("p"))


# ------------------------------------------------------------------ sources

_CONTENT = (
    ('"plain"', "plain"), ("null", ""), ('{"type":"text","text":"one"}', "one"), ('[{"type":"text","text":"a"},"b",{"type":"image"},["c"],{"type":"text","text":""},"d"]', "a\nb\nd"),
    ('{"content":{"content":[{"type":"text","text":"deep"}]}}', "deep"), ('{"text":"bare"}', "bare"), ('{"type":"image"}', ""), ("7", ""), ("[]", ""), ('{"type":"text","text":5}', "5"), ('{"type":"tool","content":null,"text":"t"}', "t"),
)


def _values(rows, names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


@query(_values([(k, t) for k, (_, t) in enumerate(_CONTENT)], "id, text"))
def flatten_content(spark, d):
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(_CONTENT)], "id int, j string").selectExpr("id", "parse_json(j) AS content")
    return rows.select("id", transcripts.flatten_content("content").alias("text"))


_RECORDS = (
    '{"role":"User","content":"hi  there"}', "not json", "[1]", '{"role":"tool","content":"no"}', '{"role":"assistant","message":{"content":[{"type":"text","text":"mail a@b.io"}]},"content":"unused"}',
    '{"role":"system","content":"","text":"by text"}', '{"role":"user","message":{"content":null},"content":"unused"}', '{"role":"user","message":"x","content":[{"type":"text","text":"list"}]}', '{"role":"user","content":"   "}',
)


@query(_values([("c", 0, "user", "hi there"), ("c", 1, "assistant", "mail <EMAIL>"), ("c", 2, "system", "by text"), ("c", 3, "user", "list")], "conv_id, turn, role, text"))
def role_filter_parse(spark, d):
    lines = spark.createDataFrame([("c", k, v) for k, v in enumerate(_RECORDS)], "conv_id string, line long, value string")
    return transcripts.parse_lines(lines).withColumn("turn", F.col("turn").cast("int"))


@query("SELECT conv_id, turn, md5(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS h FROM conversations")
def replay_text(spark, d):
    return transcripts.replay_text(_turns(spark, d)).select("conv_id", "turn", F.md5(F.col("replay").cast("binary")).alias("h"))


_LOG = (
    "[PASS] beforeSubmitPrompt agent=a1 ingest_ok=1 error_class= t=3 packed_tokens=120 budget=1024", "[FAIL] afterAgentResponse agent=b ingest_ok=0 error_class=ValueError t=0", "[PASS] sessionStart agent=c ingest_ok=1 error_class= packed_tokens=-1", "junk",
)


@query(_values([("PASS", "beforeSubmitPrompt", "a1", "", 120, 1), ("FAIL", "afterAgentResponse", "b", "ValueError", None, 0), ("PASS", "sessionStart", "c", "", -1, 1), ("", "", "", "", None, None)], "status, event, agent, error_class, packed_tokens, ingest_ok").replace("SELECT *", "SELECT status, event, agent, error_class, coalesce(packed_tokens, -9)::BIGINT AS packed_tokens, coalesce(ingest_ok, -9)::BIGINT AS ingest_ok"))
def stage_log(spark, d):
    return transcripts.parse_stage_log(spark.createDataFrame([(x,) for x in _LOG], "value string")).fillna(-9, ["packed_tokens", "ingest_ok"])


@query("SELECT 1::BIGINT AS failed_stages, 1::BIGINT AS error_lines, false AS healthy")
def stage_log_health(spark, d):
    errors = spark.createDataFrame([("2026-01-02T10:00 boom",), ("2026-01-01T09:00 old",)], "value string")
    return transcripts.stage_health(spark.createDataFrame([(x,) for x in _LOG], "value string"), errors, "2026-01-02")


_ENV = ("# note", "A=1", " B = 'two words' ", 'C="x=y"', "nothing", "=5", "D=", "E=own", "F='odd\"")


@query(_values([("A", "1", "true"), ("B", "two words", "true"), ("C", "x=y", "true"), ("D", "", "true"), ("E", "env", "false"), ("F", "'odd\"", "true")], "key, value, applied").replace("SELECT *", "SELECT key, value, applied = 'true' AS applied"))
def settings_overlay(spark, d):
    file = transcripts.settings(spark.createDataFrame([(x,) for x in _ENV], "value string"))
    return transcripts.overlay(file, spark.createDataFrame([("E", "env"), ("A", "  "), ("Z", "z")], "key string, value string"))


# ------------------------------------------------------------------ stores


def _states(spark: SparkSession, d: str) -> DataFrame:
    """The states' lineage without their matrices: one a turn."""
    return _turns(spark, d).selectExpr("conv_id", "turn + 1 AS t", "concat('state:', conv_id, ':', turn + 1) AS state_id", "CASE WHEN turn > 0 THEN concat('state:', conv_id, ':', turn) END AS parent_id")


_STATES = "s AS (SELECT conv_id, turn + 1 AS t, 'state:' || conv_id || ':' || (turn + 1) AS state_id, CASE WHEN turn > 0 THEN 'state:' || conv_id || ':' || turn END AS parent_id FROM conversations)"


@query(f"WITH {_STATES} SELECT conv_id, max(t) AS t, arg_max(state_id, t) AS state_id, arg_max(parent_id, t) AS parent_id FROM s GROUP BY conv_id")
def latest_state(spark, d):
    return store.latest_states(_states(spark, d))


@query(f"WITH {_STATES} SELECT a.state_id, a.t, a.parent_id, coalesce(b.t, -1) AS parent_t FROM s a LEFT JOIN s b ON a.parent_id = b.state_id")
def state_parents(spark, d):
    return store.parents(_states(spark, d)).fillna(-1, ["parent_t"])


@query(f"WITH RECURSIVE {_STATES}, w(state_id, parent_id, depth) AS (SELECT state_id, parent_id, 0::INT FROM s WHERE state_id = 'state:1:5' UNION ALL SELECT s.state_id, s.parent_id, depth + 1 FROM w JOIN s ON s.state_id = w.parent_id) SELECT state_id, depth FROM w")
def lineage_walk(spark, d):
    return store.walk(_states(spark, d), "state:1:5")


@query(f"WITH {_STATES} SELECT conv_id, t, state_id FROM s WHERE conv_id = 3 ORDER BY t")
def lineage(spark, d):
    return store.lineage(_states(spark, d), 3).select("conv_id", "t", "state_id")


@query(f"WITH {_STATES} SELECT state_id FROM s WHERE t % 5 = 0 OR (conv_id = 2 AND t = 3)")
def due_snapshots(spark, d):
    forced = spark.createDataFrame([(2, 3), (2, 5)], "conv_id long, t long")
    return store.due_snapshots(_states(spark, d), forced=forced).select("state_id")


@query(f"WITH {_STATES}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) AS n FROM s) SELECT conv_id, t FROM r WHERE n <= 3")
def history_retention(spark, d):
    both = _states(spark, d)
    return store.append_history(both.where("t <= 4"), both.where("t > 4"), 3).select("conv_id", "t")


@query("SELECT o_custkey AS conv_id, o_orderpriority AS name, o_orderkey AS turn, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey), -1) AS end_turn, CASE WHEN lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) IS NULL THEN 'active' ELSE 'superseded' END AS status FROM orders")
def supersede_scd2(spark, d):
    rows = _table(spark, d, "orders").selectExpr("o_custkey AS conv_id", "o_orderpriority AS name", "o_orderkey AS turn")
    return store.intervals(rows).fillna(-1, ["end_turn"])


_AGENTS = "(SELECT conv_id, min(turn) AS first_turn FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)"


@query(f"SELECT conv_id, first_turn FROM {_AGENTS} UNION ALL SELECT DISTINCT conv_id, -1 FROM conversations WHERE conv_id % 2 = 1")
def agents_if_absent(spark, d):
    turns = _turns(spark, d)
    have = turns.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    return store.add_agents(have, turns.select("conv_id", F.lit(-1).cast("long").alias("first_turn")))


@query(f"WITH {_STATES} SELECT conv_id, first_turn, state_id FROM s JOIN {_AGENTS} USING (conv_id)")
def states_of_agents(spark, d):
    agents = _turns(spark, d).where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    return store.states_of_agents(agents, _states(spark, d)).select("conv_id", "first_turn", "state_id")


_NODES = (
    (1, "Turn:0:0", "Turn", "user:0", "first words", "active", 0, 0, None, "user", "", False), (1, "Fact:0:1", "Fact", "a.py", "path: a.py", "active", 0, 1, None, "", "", True), (1, "OpenItem:0:2", "OpenItem", "milk", "open: milk", "superseded", 0, 2, 1, "", "open", False),
    (1, "Turn:1:3", "Turn", "assistant:1", "an answer", "active", 1, 3, None, "assistant", "", False), (1, "OpenItem:1:4", "OpenItem", "milk", "completed: milk", "active", 1, 4, None, "", "done", False), (1, "OpenItem:1:5", "OpenItem", "bread", "open: bread", "active", 1, 5, None, "", "open", False),
    (2, "Turn:0:0", "Turn", "user:0", "", "pruned", 0, 0, 3, "user", "", False), (2, "Topic:0:1", "Topic", "New York", "New York", "active", 0, 1, None, "", "", False), (2, "Turn:3:2", "Turn", "user:3", "last", "active", 3, 2, None, "user", "", False),
)
_NODE_NAMES = "conv_id, node_id, kind, label, summary, status, start_turn, seq, end_turn, role, state, durable"
_N = f"n AS ({_values(_NODES, _NODE_NAMES)})"


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*n,) for n in _NODES], "conv_id int, node_id string, kind string, label string, summary string, status string, start_turn int, seq int, end_turn int, role string, state string, durable boolean")


@query(f"WITH {_N} SELECT conv_id, {', '.join(f'''count_if(status = 'active' AND kind = '{k}')::BIGINT AS "{k}"''' for k in ('Turn', 'Topic', 'Fact', 'OpenItem', 'Event'))}, count_if(status = 'active' AND kind = 'Fact' AND durable)::BIGINT AS durable, count_if(status = 'superseded')::BIGINT AS superseded FROM n GROUP BY conv_id")
def kind_counts(spark, d):
    return store.kind_counts(_nodes(spark))


@query(f"WITH {_N} SELECT conv_id, coalesce(substring(sha1(string_agg(node_id || '|' || state || '|' || summary || '|' || label, chr(10) ORDER BY node_id) FILTER (status = 'active' AND kind = 'OpenItem')), 1, 16), 'empty') AS signature FROM n GROUP BY conv_id")
def openitem_signature(spark, d):
    return store.item_signature(_nodes(spark))


@query(_values([(1, "first words\nan answer\na.py\nbread"), (2, "last")], "conv_id, text"))
def window_text(spark, d):
    return store.window_text(_nodes(spark))


@query(_values([(1, "Turn:1:3", "first words"), (2, "Turn:3:2", "last")], "conv_id, last_turn, last_user_text"))
def graph_reload(spark, d):
    return store.reloaded(_nodes(spark))


@query(f"WITH {_N} SELECT conv_id, node_id FROM n WHERE start_turn <= 0 AND (end_turn IS NULL OR end_turn > 0)")
def graph_as_of(spark, d):
    return store.as_of(_nodes(spark), 0).select("conv_id", "node_id")


@query(f"WITH {_N} SELECT conv_id, node_id, label, coalesce(end_turn, -1) AS end_turn FROM n")
def graph_json_roundtrip(spark, d):
    nodes = _nodes(spark)
    return store.from_json(store.to_json(nodes), nodes.schema).select("conv_id", "node_id", "label", F.coalesce("end_turn", F.lit(-1)).alias("end_turn"))


_HISTORY = ('{"turns":[{"t":1,"packed_tokens":100,"novel_tokens":100,"hashes":["a","b"]},{"t":2,"packed_tokens":50,"novel_tokens":0,"hashes":["b"]},{"t":3}]}', '[{"t":1,"packed_tokens":0}]', '"text"', "broken", '{"turns":7}')


@query(_values([(0, 0, 1.0, ""), (0, 1, 1.0, "a,b"), (0, 2, 0.666666667, "a,b"), (1, 0, 1.0, "")], "conv_id, pos, novelty, recent").replace("SELECT *", "SELECT conv_id, pos, novelty::DOUBLE AS novelty, recent"))
def inject_history(spark, d):
    rows = store.read_history(spark.createDataFrame([(k, v) for k, v in enumerate(_HISTORY)], "conv_id int, value string"))
    recent = store.recent_hashes(rows).select("conv_id", "pos", F.array_join("recent", ",").alias("recent"))
    return store.rolling_novelty(rows).join(recent, ["conv_id", "pos"])


# ------------------------------------------------------------------ measures and ranking

_SCALARS = ((1, 30, 70, 500, 1024, 0.5, 0.25), (2, 0, 0, 0, 0, 0.0, 1.0), (3, -5, 10, 64, 64, 1.0, 1.0))


@query(f"WITH x AS ({_values(_SCALARS, 'id, dup, novel, packed, budget, p, r')}) SELECT id, round(CASE WHEN greatest(dup, 0) + greatest(novel, 0) > 0 THEN greatest(dup, 0)::DOUBLE / (greatest(dup, 0) + greatest(novel, 0)) END, 9) AS y, round(CASE WHEN budget > 0 THEN packed::DOUBLE / budget END, 9) AS fill, round(CASE WHEN p > 0 AND r > 0 THEN 2.0 * p * r / (p + r) ELSE 0 END, 9)::DOUBLE AS f1, round(CASE WHEN novel > 0 THEN packed::DOUBLE / novel END, 9) AS per FROM x")
def pack_measures(spark, d):
    x = spark.createDataFrame([(*s,) for s in _SCALARS], "id int, dup int, novel int, packed int, budget int, p double, r double")
    c = F.col
    cols = {"y": M.dedup_yield(c("dup"), c("novel")), "fill": M.budget_fill(c("packed"), c("budget")), "f1": M.harmonic_f1(c("p"), c("r")), "per": M.tokens_per_decision(c("packed"), c("novel"))}
    return x.select("id", *[F.round(v, 9).alias(k) for k, v in cols.items()])


_RECALL = (("docs/a.md|Buy Milk|zzz", "got docs/a.md and milk, buy", 2 / 3), ("", "x", 1.0), ("Plan", "planning", 1.0), ("a b|  ", "nothing", 0.0), ("UPPER|upper", "say upper", 1.0))


@query(_values([(k, round(r, 9)) for k, (_, _, r) in enumerate(_RECALL)], "id, recall").replace("SELECT *", "SELECT id, recall::DOUBLE AS recall"))
def entity_recall(spark, d):
    x = spark.createDataFrame([(k, t.split("|"), p) for k, (t, p, _) in enumerate(_RECALL)], "id int, terms array<string>, payload string")
    return x.select("id", F.round(M.entity_recall(F.col("terms"), F.col("payload")), 9).alias("recall"))


_HOT = "OpenItem milk: open: milk\nFact src/a.py: path: src/a.py\nFact Setup: heading: Setup\nFact we chose x: we chose x\nodd line\nodd line"


@query(rf"""WITH x AS (SELECT unnest(string_split({"'" + _HOT.replace(chr(10), "' || chr(10) || '") + "'"}, chr(10))) AS line), u AS (SELECT DISTINCT lower(line) AS line, (length(line) + 3) // 4 AS n FROM x),
k AS (SELECT n, CASE WHEN contains(substring(line, 1, 20), 'openitem ') THEN 'd' WHEN regexp_matches(line, '(^|\s)(fact\s+)?([\w.-]+/)+[\w.-]+|heading:|\b[\w.-]+\.(md|py|json|sh|tex|png|jpg)\b') THEN 'p' WHEN regexp_matches(line, '^(openitem|fact|topic|event|turn)\s*:?\s+') THEN 'd' ELSE 'o' END AS k FROM u),
s AS (SELECT coalesce(sum(n) FILTER (k = 'p'), 0)::BIGINT AS path_tokens, coalesce(sum(n) FILTER (k = 'd'), 0)::BIGINT AS decision_tokens, coalesce(sum(n) FILTER (k = 'o'), 0)::BIGINT AS other_tokens, sum(n)::BIGINT AS total_tokens FROM k)
SELECT *, path_tokens / total_tokens AS pollution FROM s""")
def hot_set_pollution(spark, d):
    return spark.createDataFrame([(_HOT,)], "x string").select(F.inline(F.array(M.pollution(F.col("x")))))


@query("SELECT event_type, round(avg(CASE WHEN event_type = 'skip' THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS skip_rate FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'skip' ELSE 'query-pack' END AS event_type FROM lineitem) GROUP BY event_type")
def skip_rate(spark, d):
    rows = _table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "skip").otherwise("query-pack").alias("event_type"))
    return rows.groupBy("event_type").agg(F.round(M.skip_rate(F.col("event_type")), 9).alias("skip_rate"))


@query(f"SELECT role, quantile_disc(t, 0.5)::BIGINT AS median, quantile_disc(t, 0.95)::BIGINT AS p95, min(t)::BIGINT AS p0, max(t)::BIGINT AS p100 FROM (SELECT role, {_TAU.format('text')} AS t FROM conversations) GROUP BY role")
def percentiles(spark, d):
    rows = _turns(spark, d).select("role", T.estimate_tokens(F.col("text")).alias("t"))
    return rows.groupBy("role").agg(*[M.percentile("t", p).cast("long").alias(n) for n, p in (("median", 50), ("p95", 95), ("p0", -1), ("p100", 100))])


@query(f"""WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, length(text)::BIGINT AS raw_chars, length(coalesce(prev, ''))::BIGINT AS gist_chars, 0::BIGINT AS graph_chars, round(CASE WHEN length(text) > 0 THEN length(coalesce(prev, '')) / length(text) ELSE 0 END, 9)::DOUBLE AS ratio, ({_TAU.format('text')})::BIGINT AS raw_tokens, ({_TAU.format('prev')})::BIGINT AS gist_tokens FROM a""")
def payload_stats(spark, d):
    rows = _turns(spark, d).selectExpr("conv_id", "turn", "text", "lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev")
    s = rows.select("conv_id", "turn", M.payload_stats(F.col("text"), F.col("prev"), F.lit("")).alias("s")).select("conv_id", "turn", "s.*")
    return s.withColumn("ratio", F.round("ratio", 9))


@query(_values([(0, "FULL"), (1, "PARTIAL"), (2, "FAIL"), (3, "FAIL"), (4, "NOT_RUN")], "id, grade"))
def run_grades(spark, d):
    x = spark.createDataFrame([(0, [True, True], True), (1, [True, False], True), (2, [False], True), (3, [], True), (4, [True], False)], "id int, ok array<boolean>, tried boolean")
    return x.select("id", M.grade(F.col("ok"), F.col("tried")).alias("grade"))


_MODELS = ((["Alpha-2", "beta"], "alpha-2", [], "Alpha-2"), (["x", "beta"], "alpha", ["no", "BETA"], "beta"), (["my-alpha-fast", "beta-1"], "alpha", [], "my-alpha-fast"), (["x"], "alpha", ["b"], None), (["one", "two-bees"], "alpha", ["bee"], "two-bees"))


@query(_values([(k, x) for k, (*_, x) in enumerate(_MODELS)], "id, model"))
def model_pick(spark, d):
    x = spark.createDataFrame([(k, a, w, al) for k, (a, w, al, _) in enumerate(_MODELS)], "id int, available array<string>, want string, aliases array<string>")
    return x.select("id", M.pick_model(F.col("available"), F.col("want"), F.col("aliases")).alias("model"))


_METHODS = (("embed", "p1", "digest+p1"), ("hf", "p1", "gist-hf+p1"), ("embed", "query-pack", "query-pack"), ("embed", "p2", "p2"), ("embed", "other", "digest"))


@query(_values([(k, m) for k, (*_, m) in enumerate(_METHODS)], "id, method"))
def method_labels(spark, d):
    x = spark.createDataFrame([(k, p, v) for k, (p, v, _) in enumerate(_METHODS)], "id int, producer string, via string")
    return x.select("id", M.classify_method(F.col("producer"), F.col("via")).alias("method"))


@query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT vec_id, list_transform(e, lambda x: exp(x / 0.5 - list_max(e) / 0.5)) AS p FROM a)
SELECT vec_id, round(list_max(p) / list_sum(p), 6) AS top, round(list_min(p) / list_sum(p), 6) AS low FROM b""")
def softmax_scores(spark, d):
    p = V.softmax(F.col("embedding"), 0.5)
    return _table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.array_min("p"), 6).alias("low"))


_GRAMS = """w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_'']+') AS w FROM conversations),
g AS (SELECT conv_id, turn, list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w)"""


@query(f"WITH {_GRAMS} SELECT conv_id, turn, len(b)::BIGINT AS n, list_sum(b)::BIGINT AS s FROM (SELECT conv_id, turn, list_distinct(list_transform(g, lambda x: ('0x' || substring(sha1(x), 1, 8))::BIGINT % 256)) AS b FROM g)")
def hash_embed_sha1(spark, d):
    b = rank.sha1_buckets(F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", F.size("b").cast("long").alias("n"), F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM s)
SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 50 AND (score >= 0.5 OR (top < 0.5 AND rank <= 3))""")
def relevance_floor_fallback(spark, d):
    from dataclasses import replace

    v = _table(spark, d, "embeddings")
    ranked = views.cosine_topk(v, v.where("vec_id % 100 = 0"), 50)
    return rank.floor_or_best(ranked, ["query_id"], replace(DEFAULT, min_cosine=0.5)).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT t.conv_id, t.turn, t.topic, t.fact FROM (" + _values([(2, 0, "glossary rewrite", "Topic: glossary rewrite goal"), (2, 0, "standardise fields", "standardise all"), (2, 1, "x", "exact x here")], "conv_id, turn, topic, fact") + ") t")
def topic_fact_join(spark, d):
    topics = spark.createDataFrame([(2, 0, "glossary rewrite"), (2, 0, "standardise fields"), (2, 1, "x"), (2, 1, "tiny bits")], "conv_id int, turn int, item string")
    found = spark.createDataFrame([(2, 0, "", "Topic: glossary rewrite goal"), (2, 0, "", "standardise all"), (2, 1, "", "exact x here"), (2, 1, "tin", "bit of it"), (3, 0, "", "glossary")], "conv_id int, turn int, label string, summary string")
    return store.topic_facts(topics, found)


# ------------------------------------------------------------------ events

_PAYLOADS = (
    {"conversation_id": " a b/c ", "hook_event_name": "sessionStart", "seq": 1}, {"agentId": "x1", "prompt": "hello there", "seq": 2}, {"workspace_roots": ["/r1", "/r2"], "session_id": "s", "event": "afterAgentResponse", "response": "ok", "seq": 3},
    {"workspaceRoots": "/only", "userPrompt": " ", "input": "go", "seq": 4}, {"conversation_id": 5, "event": "odd", "text": "t", "seq": 5},
)


@query(_values([("a-b-c", 1, "sessionStart", None), ("x1", 2, "beforeSubmitPrompt", "hello there")], "agent_id, seq, event, text") + " UNION ALL SELECT 'ws-' || substring(sha256('/r1|/r2|s'), 1, 24), 3, 'afterAgentResponse', 'ok' UNION ALL SELECT 'ws-' || substring(sha256('/only|'), 1, 24), 4, 'beforeSubmitPrompt', 'go' UNION ALL SELECT 'ws-' || substring(sha256('|'), 1, 24), 5, 'odd', NULL UNION ALL SELECT 'ws-' || substring(sha256('|'), 1, 24), 0, 'beforeSubmitPrompt', NULL")
def agent_id_resolve(spark, d):
    lines = [json.dumps(p) for p in _PAYLOADS] + ["[not an object"]
    return events.payloads(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("seq", F.col("seq").cast("int"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as host events: prompts, answers, and a session start at the end of each."""
    turns = _turns(spark, d)
    name = F.when(F.col("role") == "user", "beforeSubmitPrompt").otherwise("afterAgentResponse")
    lines = turns.select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("conversation_id"), F.col("turn").alias("seq"), name.alias("event"), F.col("text"))).alias("value"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return lines.unionAll(last.select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("conversation_id"), (F.col("m") + 1).alias("seq"), F.lit("sessionStart").alias("event"))).alias("value")))


@query()
def hook_replay(spark, d):
    """The stream's answers, over a finite table; a test holds the two against each other."""
    return events.replay(_events(spark, d))


# ------------------------------------------------------------------ folds


@query()
def pack_forward(spark, d):
    return fold.conversation_packs(_turns(spark, d))


@query()
def graph_nodes(spark, d):
    return fold.graph_nodes(_turns(spark, d).unionByName(_marks(spark).withColumn("conv_id", -F.col("conv_id"))))


@query()
def graph_edges(spark, d):
    return fold.graph_edges(_turns(spark, d).unionByName(_marks(spark).withColumn("conv_id", -F.col("conv_id"))))


@query()
def chunk_text(spark, d):
    return chunk.chunks_of(_turns(spark, d))


@query()
def encode_rows(spark, d):
    return fold.chunk_vectors(_turns(spark, d))


@query()
def append_then_pool(spark, d):
    """Each conversation's bounded matrix after every turn."""
    return fold.matrix_states(_turns(spark, d))


@query()
def expand_spans(spark, d):
    """The spans of each conversation nearest to its last user turn."""
    turns = _turns(spark, d)
    wanted = lifecycle.last_query(turns).select("conv_id", F.col("text").alias("query"))
    return rank.nearest_spans(chunk.chunks_of(turns, DEFAULT.chunks_per_window), wanted)


@query()
def p1_decode(spark, d):
    return bridge.decode_states(store.latest_states(fold.matrix_states(_turns(spark, d))))


@query()
def adapter_forward(spark, d):
    return bridge.adapt_states(store.latest_states(fold.matrix_states(_turns(spark, d))), bridge.Adapter(DEFAULT.dim, DEFAULT.dim))


@query()
def scenario(spark, d):
    return S.scenario(_turns(spark, d))


@query()
def savings_delta_eta(spark, d):
    """Tokens that packs save against full replays, from packs that were really made."""
    rows = fold.conversation_packs(_turns(spark, d)).select("conv_id", "turn", "packed_tokens").join(views.replay_tokens(_turns(spark, d)), ["conv_id", "turn"])
    return views.savings(rows)


@query()
def packed_median(spark, d):
    packs = fold.conversation_packs(_turns(spark, d))
    return packs.agg(*[M.percentile("packed_tokens", p).cast("long").alias(n) for n, p in (("median", 50), ("p95", 95))])


@query()
def roi_fields(spark, d):
    return M.roi(fold.conversation_packs(_turns(spark, d)))


_TASKS = ["analyse the context", "plan the next step", "say it in one line"]


@query()
def prompt_chain(spark, d):
    packs = fold.conversation_packs(_turns(spark, d)).where("t = 2").select("conv_id", F.col("context").alias("gist"), "hot_set", F.array(F.lit("first reply"), F.lit("second reply")).alias("replies"))
    return S.prompt_chain(packs, _TASKS)


