"""One agent's events: what each does to its memory and what it answers. The batch replay and the
stream run this same code, so their answers are the same."""

from __future__ import annotations

import json
import pickle
from dataclasses import dataclass

from ..config import DEFAULT, EngineConfig
from .pack import Memory, Pack, state_id

EVENTS = ("beforeSubmitPrompt", "afterAgentResponse", "preCompact", "sessionStart")
RESPONSE_DDL = (
    "agent_id string, seq long, event string, t long, ingest_ok int, error_class string, method string, packed_tokens long, budget long, novel_tokens long, dup_tokens long, "
    "flushed boolean, response string, snapshot string"
)


def default_answer(event: str) -> dict:
    """What an event is answered when anything goes wrong, or when nobody knows it."""
    return {"beforeSubmitPrompt": {"continue": True}, "sessionStart": {"additional_context": ""}}.get(event, {})


def snapshot(memory: Memory) -> str:
    """The active graph as JSON: keys in order, no blanks."""
    rows = [{"end": n.end, "hint": n.hint, "id": n.id, "kind": n.kind, "label": n.label, "salience": n.salience, "start": n.start, "state": n.state, "status": n.status, "summary": n.summary} for n in memory.graph.active.values()]
    return json.dumps({"nodes": rows, "schema": "ctx-graph/v1", "t": memory.t}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass
class Session:
    agent: str
    memory: Memory

    @classmethod
    def start(cls, agent: str, config: EngineConfig = DEFAULT) -> Session:
        return cls(agent, Memory(config))

    def dumps(self) -> bytes:
        return pickle.dumps(self.memory, protocol=5)

    @classmethod
    def loads(cls, agent: str, raw: bytes) -> Session:
        return cls(agent, pickle.loads(raw))

    def handle(self, seq: int, event: str, text: str | None, features: dict | None) -> tuple:
        """One row of ``RESPONSE_DDL``. A failure in taking the turn in leaves the memory as it was; one
        in packing keeps the turn. Both answer as if there were no memory."""
        m, c = self.memory, self.memory.config
        answer, pack, ok, error, flushed, frozen = default_answer(event), Pack(method="none", budget=c.forward_budget), 1, "", False, None
        before = self.dumps() if event in EVENTS[:2] and text else b""
        try:
            if event in EVENTS[:2] and text:
                m.step("user" if event == EVENTS[0] else "assistant", features)
                flushed = m.t % c.flush_every == 0
            elif event in EVENTS[2:]:
                flushed = True
        except Exception as e:  # the host must never fail for its memory
            self.memory, ok, error = pickle.loads(before), 0, type(e).__name__
        m = self.memory
        m.graph.drain()
        if ok:
            try:
                if event == EVENTS[0] and text or event == EVENTS[3]:
                    pack = m.sample(text if event == EVENTS[0] else None)
                    answer = {**answer, "additional_context": m.context(pack, self.agent)}
                elif event == EVENTS[2]:
                    where = f"t={m.t or None}, state_id={state_id(self.agent, m.t) if m.t else None}"
                    answer = {"user_message": f"TURNLOOM: frozen context graph snapshot for {self.agent} ({where})."}
                frozen = snapshot(m) if flushed else None
            except Exception as e:
                error = type(e).__name__
        return self.agent, seq, event, m.t, ok, error, pack.method, pack.packed_tokens, pack.budget, pack.novel_tokens, pack.dup_tokens, flushed, json.dumps(answer, ensure_ascii=False), frozen
