"""Folds over conversations: each one's turns in order, through a state of bounded size.

Extraction is set-based and comes first. Then conversations are dealt by id and sorted within their
partitions, and one Arrow pass streams the rows: a long conversation is never gathered, only its state
and one batch are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import DEFAULT, EngineConfig
from ..functions import producers
from ..functions import vectors as V
from .chunk import chunks_of
from .extract import with_features
from .graph import Node
from .pack import Memory, state_id

PACK_DDL = (
    "conv_id {id}, turn long, t long, method string, packed_tokens long, tokens_ws long, budget long, rate double, novel_tokens long, dup_tokens long, n_lines int, "
    "hot_set string, n_turns int, n_topics int, n_facts int, n_items int, n_events int, n_durable int, n_superseded int, signature string, context string"
)
NODE_DDL = (
    "conv_id {id}, node_id string, kind string, label string, summary string, status string, start_turn long, seq long, end_turn long, role string, hint string, state string, "
    "durable boolean, salience double, reason string"
)
EDGE_DDL = "conv_id {id}, src string, dst string, rel string, turn long"
STATE_DDL = "conv_id {id}, state_id string, parent_id string, t long, k int, d int, matrix array<array<float>>"

Step = Callable[[dict], list[tuple]]


def in_order(rows: DataFrame, start: Callable[[object], tuple[Step, Callable[[], list[tuple]]]], ddl: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``start`` gives a conversation's functions: one for each row, in the order of ``turn``, and one
    for its end; both return output rows. ``prepare`` adds columns row by row once the rows are dealt,
    so that the shuffle carries texts and not what is found in them."""
    schema = StructType.fromDDL(ddl.format(id=rows.schema["conv_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, end = object(), None, list
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != key or step is None:
                    out += end()
                    key = row["conv_id"]
                    step, end = start(key)
                out += step(row)
            if out:
                yield table(out)
        out = end()
        if out:
            yield table(out)

    # as many partitions as the session shuffles into: the work is in the rows, so small ones are not joined
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prepare(rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn")).mapInArrow(run, schema)


def conversation_packs(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One pack a turn of every conversation, as it would be sent for the last user turn by then."""

    def start(conv: object):
        memory = Memory(config)

        def step(row: dict) -> list[tuple]:
            t = memory.step(row["role"], row["features"])
            p, g = memory.sample(), memory.graph
            g.drain()
            n = g.kind_counts()
            counts = (n["Turn"], n["Topic"], n["Fact"], n["OpenItem"], n["Event"], g.durable_facts(), g.n_superseded)
            return [(conv, row["turn"], t, p.method, p.packed_tokens, p.tokens_ws, p.budget, p.rate, p.novel_tokens, p.dup_tokens, len(p.hashes), g.hot_set(), *counts, g.item_signature(), p.text)]

        return step, list

    return in_order(turns.select("conv_id", "turn", "role", "text"), start, PACK_DDL, lambda rows: with_features(rows, config))


def _node_row(conv: object, n: Node) -> tuple:
    return conv, n.id, n.kind, n.label, n.summary, n.status, n.start, n.seq, n.end, n.role, n.hint, n.state, n.durable, n.salience, n.reason


def _graph(turns: DataFrame, config: EngineConfig, ddl: str, edges: bool) -> DataFrame:
    def start(conv: object):
        memory = Memory(config)

        def step(row: dict) -> list[tuple]:
            memory.step(row["role"], row["features"])
            closed, linked = memory.graph.drain()
            return [(conv, *e) for e in linked] if edges else [_node_row(conv, n) for n in closed]

        return step, lambda: [] if edges else [_node_row(conv, n) for n in memory.graph.active.values()]

    return in_order(turns.select("conv_id", "turn", "role", "text"), start, ddl, lambda rows: with_features(rows, config))


def graph_nodes(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Every node that the conversations ever had, with the turns it was valid in."""
    return _graph(turns, config, NODE_DDL, False)


def graph_edges(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return _graph(turns, config, EDGE_DDL, True)


def chunk_vectors(turns: DataFrame, config: EngineConfig = DEFAULT, seed: int = 0, producer: str | None = None) -> DataFrame:
    """(conv_id, turn, row, text, vector): the chunks of each turn, embedded by the producer of that name."""
    return chunks_of(turns, config.chunks_per_turn, config).withColumn("vector", producers.embed(producer, config.dim, seed)(F.col("text")))


def matrix_states(turns: DataFrame, config: EngineConfig = DEFAULT, seed: int = 0) -> DataFrame:
    """A state row a turn: the bounded matrix after that turn's chunks were appended and pooled."""
    blank = V.embed_text("", config.dim, seed)

    def embedded(text: str | None) -> np.ndarray:
        from .chunk import chunk_text

        return np.stack([V.embed_text(x, config.dim, seed) if x.strip() else blank for x in chunk_text(text, config.chunks_per_turn, config)])

    def start(conv: object):
        matrix, t = None, 0

        def step(row: dict) -> list[tuple]:
            nonlocal matrix, t
            matrix = V.pool(matrix, embedded(row["text"]), config.k_max, config.ema)
            t += 1
            return [(conv, state_id(str(conv), t), state_id(str(conv), t - 1) if t > 1 else None, t, *matrix.shape, matrix.tolist())]

        return step, list

    return in_order(turns.select("conv_id", "turn", "text"), start, STATE_DDL)
