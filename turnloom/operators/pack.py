"""Packs: what of a conversation's memory is sent along with a turn, under a token budget."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from ..config import DEFAULT, EngineConfig
from .graph import ContextGraph, keywords, overlap
from .rank import relevant

HOT = "HOT_SET:\n"


def tokens_of(text: str) -> int:
    """Four characters a token, begun ones counted."""
    return (len(text) + 3) // 4


def line_hash(text: str) -> str:
    return hashlib.sha1(text.strip().lower().encode()).hexdigest()[:16]


def to_width(text: str, width: int) -> str:
    return text if len(text) <= width else text[: max(0, width - 3)].rstrip() + "..."


@dataclass
class Pack:
    text: str = ""
    method: str = "hot_set"
    budget: int = 0
    packed_tokens: int = 0
    tokens_ws: int = 0
    novel_tokens: int = 0
    dup_tokens: int = 0
    hashes: tuple[str, ...] = ()

    @property
    def rate(self) -> float:
        return self.packed_tokens / self.budget if self.budget else 0.0


def in_hot(text: str, hot: str) -> bool:
    """Whether the hot set says the text, or what follows its first colon."""
    if not hot or not text:
        return False
    rest = text.partition(":")[2].strip().lower()
    return text.lower() in hot.lower() or bool(rest) and rest in hot.lower()


def pack_forward(
    hot: str = "", typed: list[str] = (), chunks: list[str] = (), budget: int | None = None, recent: frozenset[str] = frozenset(), items_changed: bool = True, superseded: bool = False, may_skip: bool = False, config: EngineConfig = DEFAULT
) -> Pack:
    """The hot set, then typed lines, then chunks: each that is not packed yet, not sent lately, not
    mostly said by the others, and still fits. What does not fit is passed over, not the end.

    ``recent`` are hashes of lines sent lately; a node superseded since lifts them. With ``may_skip`` a
    small pack without a change of open items is not sent at all."""
    cap = max(1, config.forward_budget if budget is None else budget)
    lately = recent if config.cross_turn_dedup and not superseded else frozenset()
    hot = hot.strip()
    parts, said, used, dup = [], set(), 0, 0
    if hot:
        parts.append(to_width(HOT + hot, 4 * cap) if tokens_of(HOT + hot) > cap else HOT + hot)
        used = tokens_of(parts[0])
        said = {hot.lower(), *(line.strip().lower() for line in hot.splitlines())}
    n_hot, packed = len(parts), set()
    for k, text in enumerate([*typed, *chunks]):
        text = (text or "").strip()
        if not text or text.lower() in said or k >= len(typed) and in_hot(text, hot):
            continue
        cost, own = tokens_of(text), keywords(text)
        if lately and line_hash(text) in lately or len(parts) > n_hot and overlap(own, packed) > config.marginal_jaccard:
            dup += cost
        elif used + cost <= cap:
            parts.append(text)
            used += cost
            said.add(text.lower())
            packed |= own
    # the blank lines between parts were not counted, so the whole may have to be cut
    body = "\n\n".join(parts).strip()
    body = to_width(body, 4 * cap) if tokens_of(body) > cap else body
    total = tokens_of(body)
    if may_skip and config.cross_turn_dedup and not items_changed and not superseded and total < config.skip_floor:
        return Pack(method="skip", budget=cap, dup_tokens=dup + total)
    lines = [line for line in body.splitlines() if line.strip()]
    novel = tokens_of("\n".join(line for line in lines if line_hash(line) not in recent)) if lately and lines else total
    return Pack(body, "query-pack" if len(parts) > n_hot else "hot_set", cap, total, len(body.split()), novel, dup, tuple(map(line_hash, lines)))


def adaptive_budget(t: int, novelty: float, config: EngineConfig = DEFAULT) -> int:
    """The whole budget at first, then as much of it as lately was new."""
    cap = max(1, config.forward_budget)
    if t <= config.warmup_turns or not config.cross_turn_dedup:
        return cap
    return max(config.skip_floor, min(cap, int(cap * max(config.novelty_floor, min(1.0, max(0.0, novelty))))))


@dataclass
class Sent:
    """What is remembered of a pack that was sent."""

    t: int
    hashes: tuple[str, ...]
    text: str
    signature: str
    n_superseded: int
    packed: int
    novel: int
    dup: int


@dataclass
class Memory:
    """One conversation's graph and the packs sent lately."""

    config: EngineConfig = DEFAULT
    graph: ContextGraph = None
    history: list[Sent] = field(default_factory=list)
    t: int = 0

    def __post_init__(self) -> None:
        self.graph = self.graph or ContextGraph(self.config)

    def step(self, role: str, features: dict) -> int:
        if self.config.reload_each_turn:
            self.graph.reload()
        self.graph.ingest(role, self.t, features)
        self.t += 1
        return self.t

    def novelty(self) -> float:
        last = self.history[-self.config.dedup_turns :]
        packed = sum(s.packed for s in last)
        return min(1.0, max(0.0, sum(s.novel for s in last) / packed)) if packed > 0 else 1.0

    def sample(self, query: str | None = None, p1: str = "") -> Pack:
        """The pack for a query, by default the last user turn; remembers it if it is sent. ``p1`` is a
        decoded text that may fill what is left, where the configuration lets it."""
        c, g = self.config, self.graph
        query = (query or "").strip() or g.last_query()
        hot = g.hot_set(query or None)
        dedup = c.cross_turn_dedup and bool(self.history)
        last = self.history[-1] if dedup else None
        chunks = [text for text, _ in relevant(query, g.candidates(query), c)] if query else []
        gist = False
        if not chunks:
            from .bridge import plain_gist

            text = plain_gist(g.window_text().strip() or hot, c.gist_tokens)
            chunks, gist = [text] * bool(text), bool(text)
        pack = pack_forward(
            hot, g.typed_lines(query or None), chunks, adaptive_budget(self.t, self.novelty(), c),
            frozenset(h for s in self.history[-c.dedup_turns :] for h in s.hashes) if dedup else frozenset(),
            last is None or g.item_signature() != last.signature, last is not None and g.n_superseded > last.n_superseded, c.cross_turn_dedup and self.t > c.warmup_turns, c,
        )
        if pack.method != "skip":
            if gist:
                pack.method = "extractive" if not hot else "extractive+hot" if pack.method == "hot_set" and pack.text else pack.method
            room = pack.budget - pack.packed_tokens
            if c.inject_p1 and p1.strip() and tokens_of(p1.strip()) <= room and overlap(keywords(p1), keywords(hot) | keywords(pack.text)) >= c.p1_jaccard:
                pack.text, pack.method = f"{pack.text}\n{p1.strip()}".strip(), "p1-debug"
                pack.packed_tokens = tokens_of(pack.text)
            if pack.hashes:
                sent = Sent(self.t, pack.hashes, pack.text[: c.context_chars], g.item_signature(), g.n_superseded, pack.packed_tokens, pack.novel_tokens, pack.dup_tokens)
                self.history = [*self.history, sent][-c.history_rows :]
        return pack

    def sample_for(self, target: str, matrix=None, query: str | None = None, bridge=None, adapter=None):
        """What a target reads: a pack for "text", the words of the matrix with it where these are let in;
        for "local:<id>" the matrix in that model's space, by the adapter or else by expectation. Anything
        else is refused."""
        if target == "text" or matrix is None:
            return self.sample(query, " ".join(bridge.decode(matrix)) if bridge is not None and matrix is not None else "")
        if target.startswith("local:"):
            return adapter.forward(matrix) if adapter is not None else bridge.expectation(matrix)
        raise ValueError(f"unknown target: {target}")

    def context(self, pack: Pack, agent: str) -> str:
        """What goes to the model: a banner, the pack (or the hot set), and where the memory stands."""
        parts = ["TURNLOOM session memory (prefer HOT_SET / typed / ranked lines; do not restate full history)."]
        hot = "" if pack.text or pack.method == "skip" else self.graph.hot_set()
        parts += [pack.text.strip()] if pack.text.strip() else [HOT + hot] if hot else []
        if self.t:
            parts.append(f"STATE: agent_id={agent} t={self.t} state_id={state_id(agent, self.t)}")
        return to_width("\n\n".join(parts).strip(), self.config.context_chars)


def state_id(agent: str, t: int) -> str:
    return f"state:{agent}:{t}"
