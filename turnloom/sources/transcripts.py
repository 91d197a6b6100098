"""Transcript sources and sinks: JSON lines in, turns out, and back; stage logs and settings files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import redact

ROLES = ("user", "assistant", "system")


def read_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text) of the conversations table."""
    return spark.read.parquet(os.path.join(sf_dir, "conversations.parquet"))


def _is(v: str, kind: str) -> str:
    return f"schema_of_variant({v}) LIKE '{kind}%'"


def _string(v: str) -> str:
    """A variant's text: strings as they are, null as nothing, other values as JSON."""
    return f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN '' WHEN {_is(v, 'STRING')} THEN try_variant_get({v}, '$', 'string') ELSE to_json({v}) END"


def _content(v: str, depth: int) -> str:
    inner = f"try_variant_get({v}, '$.content', 'variant')"
    block = f"""CASE WHEN {_is('b', 'STRING')} THEN try_variant_get(b, '$', 'string')
        WHEN {_is('b', 'OBJECT')} AND try_variant_get(b, '$.type', 'string') = 'text' THEN {_string("try_variant_get(b, '$.text', 'variant')")} END"""
    deeper = f"WHEN {inner} IS NOT NULL AND NOT is_variant_null({inner}) THEN {_content(inner, depth - 1)}" if depth else ""
    own = _string(f"try_variant_get({v}, '$.text', 'variant')")
    return f"""CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN ''
      WHEN {_is(v, 'STRING')} THEN try_variant_get({v}, '$', 'string')
      WHEN {_is(v, 'ARRAY')} THEN array_join(filter(transform(try_variant_get({v}, '$', 'array<variant>'), b -> {block}), x -> x IS NOT NULL AND x <> ''), '\\n')
      WHEN {_is(v, 'OBJECT')} THEN CASE WHEN try_variant_get({v}, '$.type', 'string') = 'text' THEN {own} {deeper} ELSE {own} END
      ELSE '' END"""


def flatten_content(name: str, depth: int = 3) -> Column:
    """Text of the polymorphic VARIANT column ``name``: a string, a text block, a list of both, or an
    object around any of these, ``depth`` objects deep; anything else is nothing."""
    return F.expr(_content(name, depth))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from (conv_id, line, value): unreadable lines, other roles and
    empty texts go; turns are numbered densely in the order of ``line``."""
    rows = lines.withColumn("j", F.expr("try_parse_json(value)")).where("j IS NOT NULL AND schema_of_variant(j) LIKE 'OBJECT%'")
    content, empty = "try_variant_get(j, '$.content', 'variant')", "('\"\"', '[]', '{}', '0', 'false', 'null')"
    rows = rows.selectExpr(
        "conv_id", "line", "lower(CASE WHEN schema_of_variant(try_variant_get(j, '$.role', 'variant')) = 'STRING' THEN try_variant_get(j, '$.role', 'string') END) AS role",
        f"""CASE WHEN schema_of_variant(try_variant_get(j, '$.message', 'variant')) LIKE 'OBJECT%' THEN try_variant_get(j, '$.message.content', 'variant')
              WHEN {content} IS NOT NULL AND to_json({content}) NOT IN {empty} THEN {content} ELSE try_variant_get(j, '$.text', 'variant') END AS content""",
    )
    rows = rows.where(F.col("role").isin(*ROLES)).withColumn("text", redact(flatten_content("content"))).where("text <> ''")
    return rows.selectExpr("conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY line) - 1 AS turn", "role", "text")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of JSON-lines files, a conversation a file, named by its path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("conv_id"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parse_lines(files.where(T.strip(F.col("value")) != ""))


def from_records(spark: SparkSession, records: list[dict], conv_id: str = "records") -> DataFrame:
    """Turns of records in memory, which have the shape of the files' lines."""
    import json

    return parse_lines(spark.createDataFrame([(conv_id, k, json.dumps(r)) for k, r in enumerate(records)], "conv_id string, line long, value string"))


def to_lines(turns: DataFrame) -> DataFrame:
    """One JSON line a turn, in the shape that ``parse_lines`` reads."""
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    return turns.select("conv_id", "turn", F.to_json(F.struct("role", F.struct(F.array(block).alias("content")).alias("message"))).alias("value"))


def replay_text(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, replay): all turns up to each, as "role: text" lines."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(so_far), "\n").alias("replay"))


def stage_line(event: Column, agent: Column, ingest_ok: Column, error_class: Column, method: Column, body: Column) -> Column:
    """A log line of one event: what it was, whether it passed, and its figures."""
    failed = (ingest_ok == 0) | (error_class != "") | (method == "none")
    return F.rtrim(F.concat(F.lit("["), F.when(failed, "FAIL").otherwise("PASS"), F.lit("] "), event, F.lit(" agent="), agent, F.lit(" ingest_ok="), ingest_ok.cast("string"), F.lit(" error_class="), error_class, F.lit(" "), T.strip(body)))


def parse_stage_log(lines: DataFrame) -> DataFrame:
    """(status, event, agent, error_class, packed_tokens, ingest_ok) of stage-log lines."""
    v = F.col("value")
    number = lambda key: F.expr(f"try_cast(regexp_extract(value, '\\\\b{key}=(-?[0-9]+)', 1) AS BIGINT)")
    return lines.select(
        F.regexp_extract(v, r"^\[(PASS|FAIL)\]", 1).alias("status"), F.regexp_extract(v, r"^\[\w+\]\s+(\S+)", 1).alias("event"), F.regexp_extract(v, r"\bagent=(\S*)", 1).alias("agent"),
        F.regexp_extract(v, r"\berror_class=(\S*)", 1).alias("error_class"), number("packed_tokens").alias("packed_tokens"), number("ingest_ok").alias("ingest_ok"),
    )


def stage_health(lines: DataFrame, errors: DataFrame, day: str) -> DataFrame:
    """One row: failed stage lines of the log, error lines of the day (YYYY-MM-DD), and whether all is well."""
    bad = parse_stage_log(lines).agg(F.count_if(F.col("ingest_ok") == 0).alias("failed_stages"))
    mine = errors.agg(F.count_if(F.col("value").startswith(day)).alias("error_lines"))
    return bad.join(mine).withColumn("healthy", (F.col("failed_stages") == 0) & (F.col("error_lines") == 0))


def settings(lines: DataFrame) -> DataFrame:
    """(key, value) of KEY=VALUE lines: comments and blank keys go, one pair of quotes around a value too."""
    v = T.strip(F.col("value"))
    rows = lines.select(v.alias("v")).where("v <> '' AND NOT startswith(v, '#') AND contains(v, '=')")
    raw = T.strip(F.substring(F.col("v"), F.locate("=", F.col("v")) + 1, F.length("v")))
    plain = F.when((F.length(raw) >= 2) & raw.rlike("""(?s)^(["']).*\\1$"""), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return rows.select(T.strip(F.substring_index("v", "=", 1)).alias("key"), plain.alias("value")).where("key <> ''")


def overlay(file: DataFrame, environment: DataFrame) -> DataFrame:
    """(key, value, applied): what is set and not blank in the environment wins over the file."""
    env = environment.select("key", F.col("value").alias("own")).where(T.strip(F.col("own")) != "")
    return file.join(env, "key", "left").select("key", F.coalesce("own", "value").alias("value"), F.col("own").isNull().alias("applied"))


def inventory(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, length, headline) of the files under a folder; the first line that says something."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    lines = F.filter(F.transform(F.split(F.decode("content", "utf-8"), "\n"), T.strip), lambda x: x != "")
    return files.select("path", "length", F.get(lines, F.lit(0)).alias("headline")).where(~F.col("path").endswith("/__init__.py"))
