"""Tables of what conversations remember: states, agents, sent packs, spans and frozen graphs.

Every function takes and returns DataFrames, so a store is any folder or catalogue that Spark writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators.graph import KINDS


def append_new(df: DataFrame, path: str, key: str = "state_id") -> None:
    """Insert only: rows whose key the table at ``path`` has already are left out."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)


def load_state(states: DataFrame, state_id: str) -> Row:
    row = states.where(F.col("state_id") == state_id).first()
    if row is None:
        raise KeyError(state_id)
    return row


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each conversation."""
    best = states.groupBy("conv_id").agg(F.max_by(F.struct(*states.columns), "t").alias("x"))
    return best.select("x.*")


def lineage(states: DataFrame, conv_id) -> DataFrame:
    return states.where(F.col("conv_id") == F.lit(conv_id)).orderBy("t")


def parents(states: DataFrame) -> DataFrame:
    """(state_id, t, parent_id, parent_t): each state with the one it came from."""
    up = states.select(F.col("state_id").alias("parent_id"), F.col("t").alias("parent_t"))
    return states.select("state_id", "t", "parent_id").join(up, "parent_id", "left").select("state_id", "t", "parent_id", "parent_t")


def walk(states: DataFrame, state_id: str) -> DataFrame:
    """(state_id, depth): a state and its ancestors, by their parent pointers."""
    states.select("state_id", "parent_id").createOrReplaceTempView("turnloom_states")
    return states.sparkSession.sql(
        """WITH RECURSIVE up(state_id, parent_id, depth) AS (
             SELECT state_id, parent_id, 0 FROM turnloom_states WHERE state_id = :start
             UNION ALL SELECT s.state_id, s.parent_id, depth + 1 FROM up JOIN turnloom_states s ON s.state_id = up.parent_id)
           SELECT state_id, depth FROM up""",
        {"start": state_id},
    )


def add_agents(agents: DataFrame, new: DataFrame) -> DataFrame:
    """``agents`` with those of ``new`` that it lacks; the first one written stays."""
    return agents.unionByName(new.dropDuplicates(["conv_id"]).join(agents.select("conv_id"), "conv_id", "left_anti").select(agents.columns))


def states_of_agents(agents: DataFrame, states: DataFrame) -> DataFrame:
    return agents.join(states, "conv_id")


def newest(rows: DataFrame, keep: int = DEFAULT.history_rows) -> DataFrame:
    """The last ``keep`` rows of each conversation by t."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("t"))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")


def append_history(history: DataFrame, new: DataFrame, keep: int = DEFAULT.history_rows) -> DataFrame:
    return newest(history.unionByName(new), keep)


def read_history(files: DataFrame) -> DataFrame:
    """(conv_id, pos, t, packed_tokens, novel_tokens, hashes) from (conv_id, value): JSON that is a
    list of rows, or an object with one as its ``turns``; anything else has no rows."""
    j = files.select("conv_id", F.expr("try_parse_json(value)").alias("j"))
    rows = j.select("conv_id", F.expr("try_variant_get(CASE WHEN schema_of_variant(j) LIKE 'OBJECT%' THEN try_variant_get(j, '$.turns', 'variant') ELSE j END, '$', 'array<variant>')").alias("rows"))
    rows = rows.select("conv_id", F.posexplode("rows").alias("pos", "r"))
    get = lambda name, kind: F.expr(f"try_variant_get(r, '$.{name}', '{kind}')").alias(name)
    return rows.select("conv_id", "pos", get("t", "long"), get("packed_tokens", "long"), get("novel_tokens", "long"), get("hashes", "array<string>"))


def recent_hashes(history: DataFrame, k: int = DEFAULT.dedup_turns) -> DataFrame:
    """(conv_id, pos, recent): the line hashes of the ``k`` packs before each."""
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(-k, -1)
    return history.select("conv_id", "pos", F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes").over(w)))).alias("recent"))


def rolling_novelty(history: DataFrame, k: int = DEFAULT.dedup_turns) -> DataFrame:
    """(conv_id, pos, novelty): the new share of the ``k`` packs before each; 1 where there is none."""
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(-k, -1)
    packed, novel = (F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("packed_tokens", "novel_tokens"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(novel, packed)))
    return history.select("conv_id", "pos", F.round(F.when(packed <= 0, F.lit(1.0)).otherwise(share), 9).alias("novelty"))


def due_snapshots(states: DataFrame, every: int = DEFAULT.flush_every, forced: DataFrame | None = None) -> DataFrame:
    """States whose graph is written as a version of its own: every few turns, and where ``forced``
    (conv_id, t) asks for it."""
    due = states.where(F.col("t") % every == 0)
    return due if forced is None else due.unionByName(states.join(forced.select("conv_id", "t"), ["conv_id", "t"], "left_semi")).dropDuplicates(["state_id"])


def freeze(nodes: DataFrame, edges: DataFrame, path: str, snapshot: str) -> None:
    """A graph as it is now, under a name of its own; earlier snapshots stay readable."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(f"{path}/{name}")


def as_of(nodes: DataFrame, turn: int) -> DataFrame:
    """The nodes that were active after a turn."""
    return nodes.where((F.col("start_turn") <= turn) & (F.col("end_turn").isNull() | (F.col("end_turn") > turn)))


def save_alignment(edges: DataFrame, path: str) -> None:
    """A vocabulary alignment (i, j, mass) as a table; nothing of it is a dense matrix."""
    edges.select("i", "j", "mass").write.mode("overwrite").parquet(path)


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where("status = 'active' AND end_turn IS NULL")


def to_json(nodes: DataFrame) -> DataFrame:
    """(conv_id, value): each conversation's nodes as one JSON document, in their order."""
    fields = sorted(c for c in nodes.columns if c != "conv_id")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("n")))), lambda x: x["n"])
    doc = F.to_json(F.struct(rows.alias("nodes"), F.lit("ctx-graph/v1").alias("schema")))
    return nodes.groupBy("conv_id").agg(doc.alias("value"))


def from_json(docs: DataFrame, schema) -> DataFrame:
    """The nodes of such documents; ``schema`` is that of the nodes table. Fields that lack are null."""
    inner = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema if f.name != "conv_id")
    rows = docs.select("conv_id", F.explode(F.from_json("value", f"nodes array<struct<{inner}>>")["nodes"]).alias("n"))
    return rows.select("conv_id", "n.*")


def reloaded(nodes: DataFrame) -> DataFrame:
    """(conv_id, last_turn, last_user_text): what a graph knows of its past once it is read back."""
    turns = active(nodes).where("kind = 'Turn'")
    user = F.max_by(F.when(F.col("role") == "user", F.col("summary")), F.when(F.col("role") == "user", F.col("seq")))
    return turns.groupBy("conv_id").agg(F.max_by("node_id", "seq").alias("last_turn"), F.coalesce(user, F.lit("")).alias("last_user_text"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    """(conv_id, one column a kind, durable, superseded): active nodes, and all that were superseded."""
    live = (F.col("status") == "active") & F.col("end_turn").isNull()
    counts = [F.count_if(live & (F.col("kind") == k)).alias(k) for k in KINDS]
    return nodes.groupBy("conv_id").agg(*counts, F.count_if(live & (F.col("kind") == "Fact") & F.col("durable")).alias("durable"), F.count_if(F.col("status") == "superseded").alias("superseded"))


def item_signature(nodes: DataFrame) -> DataFrame:
    """(conv_id, signature) over the active open items, done ones too; "empty" without any."""
    line = F.when((F.col("status") == "active") & (F.col("kind") == "OpenItem"), F.concat_ws("|", "node_id", "state", "summary", "label"))
    lines = F.array_sort(F.collect_list(line))
    return nodes.groupBy("conv_id").agg(F.when(F.size(lines) == 0, "empty").otherwise(F.substring(F.sha1(F.array_join(lines, "\n").cast("binary")), 1, 16)).alias("signature"))


def window_text(nodes: DataFrame, turns: int = DEFAULT.window_turns) -> DataFrame:
    """(conv_id, text): the last turns' summaries, then labels of open items and durable facts."""
    live = active(nodes)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("start_turn"), F.desc("seq")))
    recent = live.where("kind = 'Turn'").withColumn("n", rank).where((F.col("n") <= turns) & (F.col("summary") != "")).select("conv_id", F.lit(0).alias("part"), "seq", F.col("summary").alias("x"))
    labels = live.where("(kind = 'OpenItem' AND state <> 'done') OR (kind = 'Fact' AND durable)").select("conv_id", F.lit(1).alias("part"), "seq", F.col("label").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("part", "seq", "x")))
    return recent.unionAll(labels).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("text"))


def intervals(versions: DataFrame) -> DataFrame:
    """Versions (conv_id, name, turn, value) with the turn at which the next one closed each, and status."""
    nxt = F.lead("turn").over(Window.partitionBy("conv_id", "name").orderBy("turn"))
    return versions.withColumn("end_turn", nxt).withColumn("status", F.when(F.col("end_turn").isNull(), "active").otherwise("superseded"))


def topic_facts(topics: DataFrame, facts: DataFrame) -> DataFrame:
    """(conv_id, turn, topic, fact): topics of a turn with its facts that hold the topic or one of its
    longer words. Both sides are a turn's own few rows."""
    hay = F.lower(F.concat_ws(" ", "label", "summary"))
    rows = topics.select("conv_id", "turn", F.col("item").alias("topic")).join(facts.withColumn("hay", hay), ["conv_id", "turn"])
    words = F.filter(F.split(F.lower("topic"), r"\s+"), lambda w: F.length(w) > 4)
    hit = F.contains("hay", F.lower("topic")) | F.exists(words, lambda w: F.contains("hay", w))
    return rows.where(hit).select("conv_id", "turn", "topic", F.col("summary").alias("fact"))
