"""Host events as a stream: JSON payloads in, answers out, the memory in keyed state.

``payloads`` and ``features`` are column expressions; only the fold is Python. Within a micro-batch the
events of an agent go by ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators import extract
from ..operators.fold import in_order
from ..operators.session import EVENTS, RESPONSE_DDL, Session

AGENT_KEYS = ("conversation_id", "conversationId", "agent_id", "agentId")
PROMPT_KEYS = ("prompt", "user_prompt", "userPrompt", "message", "text", "input")
ANSWER_KEYS = ("text", "response", "assistant_text", "assistantText", "output", "message")
EVENT_KEYS = ("hook_event_name", "hookEventName", "event")
SESSION_KEYS = ("session_id", "sessionId", "generation_id", "generationId")


def _string(name: str) -> Column:
    """A field of the variant ``j`` that is a string and not blank."""
    v = F.expr(f"CASE WHEN schema_of_variant(try_variant_get(j, '$.{name}', 'variant')) = 'STRING' THEN try_variant_get(j, '$.{name}', 'string') END")
    return F.when(T.strip(v) != "", v)


def _first(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_string(n) for n in names])


def agent_id() -> Column:
    """The conversation's or agent's name made safe; else a digest of the workspace and session."""
    named = F.substring(F.regexp_replace(T.strip(_first(AGENT_KEYS)), "[^A-Za-z0-9._-]+", "-"), 1, 120)
    lists = [F.expr(f"CASE WHEN schema_of_variant(try_variant_get(j, '$.{n}', 'variant')) LIKE 'ARRAY%' THEN try_variant_get(j, '$.{n}', 'array<string>') WHEN schema_of_variant(try_variant_get(j, '$.{n}', 'variant')) = 'STRING' THEN array(try_variant_get(j, '$.{n}', 'string')) END") for n in ("workspace_roots", "workspaceRoots")]
    roots = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))
    session = F.coalesce(*[F.expr(f"nullif(try_variant_get(j, '$.{n}', 'string'), '')") for n in SESSION_KEYS], F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.array_join(roots, "|"), F.lit("|"), session).cast("binary"), 256), 1, 24)
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.concat(F.lit("ws-"), digest))


def payloads(lines: DataFrame) -> DataFrame:
    """(agent_id, seq, event, text) of JSON lines (value, and seq if the payload lacks one); what can't
    be read is an empty payload."""
    j = F.expr("CASE WHEN schema_of_variant(try_parse_json(value)) LIKE 'OBJECT%' THEN try_parse_json(value) ELSE parse_json('{}') END")
    seq = F.coalesce(F.expr("try_variant_get(j, '$.seq', 'long')"), F.col("seq") if "seq" in lines.columns else F.lit(0).cast("long"))
    rows = lines.withColumn("j", j).withColumn("event", F.coalesce(T.strip(_first(EVENT_KEYS)), F.lit(EVENTS[0])))
    text = F.when(F.col("event") == EVENTS[1], _first(ANSWER_KEYS)).when(F.col("event") == EVENTS[0], _first(PROMPT_KEYS))
    return rows.select(agent_id().alias("agent_id"), seq.alias("seq"), "event", text.alias("text"))


def _ready(events: DataFrame, config: EngineConfig) -> DataFrame:
    return events.select("agent_id", "seq", "event", "text", extract.features(F.col("text"), config).alias("features"))


def replay(lines: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Answers to a finite table of payloads."""

    def start(agent: object):
        session = Session.start(agent, config)
        return lambda r: [session.handle(r["turn"], r["event"], r["text"], r["features"])], list

    events = payloads(lines).select(F.col("agent_id").alias("conv_id"), F.col("seq").alias("turn"), "event", "text")
    out = in_order(events, start, RESPONSE_DDL.replace("agent_id string", "conv_id string"), lambda rows: rows.withColumn("features", extract.features(F.col("text"), config)))
    return out.withColumnRenamed("conv_id", "agent_id")


def _plain(x):
    """Rows and arrays of a pandas cell as dicts and lists."""
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, str | bytes) or not hasattr(x, "__iter__"):
        return x
    return [_plain(v) for v in x]


def answers(lines: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Answers to a stream of payloads; a session lives in the state store as one binary."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session.loads(key[0], bytes(state.get[0])) if state.exists else Session.start(key[0], config)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = [session.handle(int(r.seq), r.event, r.text, _plain(r.features)) for r in rows.itertuples(index=False)]
        state.update((session.dumps(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESPONSE_DDL.split(", ")])

    return _ready(payloads(lines), config).groupBy("agent_id").applyInPandasWithState(fold, RESPONSE_DDL, "memory binary", "append", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream over a folder of JSON-lines files."""
    return spark.readStream.options(**options).text(path)


def write_answers(lines: DataFrame, path: str, checkpoint: str, config: EngineConfig = DEFAULT, **trigger):
    """Start the stream; answers are appended as Parquet."""
    out = answers(lines, config).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
