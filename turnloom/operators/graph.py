"""The context graph of one conversation: typed nodes with valid turns, folded turn by turn.

``ContextGraph`` holds the active nodes only, indexed by what they are looked up by; a node that is
superseded or pruned leaves it for ``closed``, an edge goes to ``edges`` at once, and the driver takes
both away after each turn. What one conversation needs in memory is bounded by the caps, but for
topics, events and open items, which have none.

Nodes are numbered in the order of their insertion; an id is kind:turn:number. Of nodes that a lookup
could mean the newest wins; of nodes that rank the same the later turn goes first, then the earlier one.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from ..config import DEFAULT, EngineConfig
from ..functions import lexicon as L
from ..functions.text import ECHO, ECHO_POINTS
from .rank import rank

KINDS = ("Turn", "Topic", "Fact", "OpenItem", "Event")
RELATIONS = ("mentions", "contains", "continues", "supersedes", "derived_from")
_WORD = re.compile(r"[A-Za-z0-9_./#-]+")
_PATH = re.compile(L.PATH_RE, re.I)


@functools.lru_cache(maxsize=50_000)
def keywords(text: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _WORD.findall(text) if len(w) > 1)


def overlap(a: frozenset[str] | set[str], b: frozenset[str] | set[str]) -> float:
    """Jaccard: 1 for two empty sets, 0 where only one is."""
    return len(a & b) / len(a | b) if a or b else 1.0


def clip(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 3] + "..."


def short_label(text: str, width: int = 96) -> str:
    """One line of at most ``width`` characters, cut at a blank where that keeps half of it."""
    text = " ".join(text.split())
    if len(text) <= width:
        return text
    cut = text[: width - 3].rstrip()
    blank = cut.rfind(" ")
    return (cut[:blank] if blank >= width // 2 else cut).rstrip(" ,;:-") + "..."


def split_terms(text: str) -> set[str]:
    return {w for w in re.split(r"[/\-.\s]+", text.lower()) if len(w) >= 3}


@dataclass(slots=True)
class Node:
    kind: str
    label: str
    summary: str
    start: int
    seq: int
    role: str = ""
    hint: str = ""
    state: str = ""
    durable: bool = False
    salience: float = 0.0
    status: str = "active"
    end: int | None = None
    reason: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}:{self.start}:{self.seq}"

    @property
    def pathish(self) -> bool:
        """Path or heading."""
        return self.hint in ("path", "heading") or bool(_PATH.search(self.label)) or self.summary.startswith("heading:")

    @property
    def decisive(self) -> bool:
        return not self.pathish and (self.hint in ("decision", "design", "outcome") or self.salience >= 2.0)

    @property
    def pending(self) -> bool:
        return self.kind == "OpenItem" and self.state != "done"


def path_salience(path: str, mentions: int, outside: bool) -> float:
    low = path.lower()
    points = 0.45 + 0.1 * min(mentions, 3) + 0.15 * outside
    points += 0.5 * ("/scripts/" in "/" + low) + 0.5 * ("/figures/" in "/" + low)
    points += 0.25 * low.endswith((".py", ".json", ".sh", ".tex", ".png"))
    return points - 0.4 * (low.endswith(".log.txt") or "test-results/" in low or ".cursor/" in low) - 0.2 * low.startswith("/users/")


@dataclass
class ContextGraph:
    config: EngineConfig = DEFAULT
    active: dict[int, Node] = field(default_factory=dict)
    index: dict[tuple[str, str], list[int]] = field(default_factory=dict)
    closed: list[Node] = field(default_factory=list)
    edges: list[tuple[str, str, str, int]] = field(default_factory=list)  # src, dst, relation, turn
    mentions: dict[str, int] = field(default_factory=dict)  # of paths, so far
    last_turn: str | None = None
    last_user: frozenset[str] | None = None  # keywords of the last user text, if it had any text
    n_nodes: int = 0
    n_superseded: int = 0

    # ------------------------------------------------------------ nodes and edges

    @staticmethod
    def _names(n: Node) -> Iterator[tuple[str, str]]:
        if n.kind == "Fact":
            yield "fact", n.label.lower()
            yield "said", n.summary.lower()
        elif n.kind == "Topic":
            yield "topic", n.label.lower()
        elif n.pending:
            yield "item", n.label.lower()

    def insert(self, kind: str, label: str, summary: str, turn: int, **more) -> Node:
        if kind not in KINDS:
            raise ValueError(f"no such kind of node: {kind}")
        node = Node(kind, label, summary, turn, self.n_nodes, **more)
        self.n_nodes += 1
        self.active[node.seq] = node
        for name in self._names(node):
            self.index.setdefault(name, []).append(node.seq)
        return node

    def link(self, src: str, dst: str, relation: str, turn: int) -> None:
        if relation not in RELATIONS:
            raise ValueError(f"no such relation: {relation}")
        self.edges.append((src, dst, relation, turn))

    def close(self, node: Node, status: str, reason: str, turn: int) -> None:
        node.status, node.reason, node.end = status, reason, turn
        self.closed.append(self.active.pop(node.seq))
        self.n_superseded += status == "superseded"
        for name in self._names(node):
            left = [s for s in self.index.get(name, ()) if s != node.seq]
            if left:
                self.index[name] = left
            else:
                self.index.pop(name, None)

    def supersede(self, old: Node, reason: str, turn: int, kind: str, label: str, summary: str, **more) -> Node:
        """Close ``old`` in favour of a new node, which points to it."""
        self.close(old, "superseded", reason, turn)
        new = self.insert(kind, label, summary, turn, **more)
        self.link(new.id, old.id, "supersedes", turn)
        return new

    def find(self, what: str, label: str) -> Node | None:
        """The newest active node of that name: a fact by label or by what it said, a topic, an open item."""
        seqs = self.index.get((what, label.lower().strip()))
        return self.active[seqs[-1]] if seqs else None

    def nodes(self, *kinds: str) -> list[Node]:
        return [n for n in self.active.values() if not kinds or n.kind in kinds]

    # ------------------------------------------------------------ a turn comes in

    def ingest(self, role: str, turn: int, f: dict) -> Node:
        """Fold one turn's features (``extract.features``) in, then prune."""
        own = self.insert("Turn", f"{role}:{turn}", f["summary"], turn, role=role)
        if self.last_turn:
            self.link(own.id, self.last_turn, "continues", turn)
        self.last_turn = own.id
        new = [*self._sentences(f, turn), *self._paths(f, turn), *self._headings(f, turn), *self._designs(f, turn)]
        for node in new:
            self.link(own.id, node.id, "contains", turn)
        new += self._outcomes(f, turn, own)
        self._topics(f, turn, own, new)
        self._items(f, turn, own)
        if role == "user":
            self.last_user = None if f["words"] is None else frozenset(f["words"])
        self.prune(turn)
        return own

    def _sentences(self, f: dict, turn: int) -> list[Node]:
        scored = []
        for s in f["sentences"]:
            echo = self.last_user is not None and overlap(frozenset(s["words"]), self.last_user) >= ECHO
            scored.append((s["score"] - ECHO_POINTS * echo, s["sentence"]))
        good = [x for x in scored if x[0] > 0] or scored
        best = sorted(good, key=lambda x: -x[0])[: self.config.facts_per_turn]
        return [self.insert("Fact", s[:80], s, turn, salience=x, hint="decision" if x >= 2 else "sentence") for x, s in best]

    def _upsert(self, label: str, summary: str, salience: float, hint: str, turn: int) -> Iterator[Node]:
        """A durable fact, or more weight for the active one of that label."""
        known = self.find("fact", label)
        if known is None:
            yield self.insert("Fact", label[:80] if hint == "heading" else label, summary, turn, durable=True, hint=hint, salience=salience)
        else:
            known.salience = max(known.salience, salience)

    def _paths(self, f: dict, turn: int) -> Iterator[Node]:
        scored = []
        for p in f["paths"]:
            key = p["path"].lower()
            n = self.mentions[key] = self.mentions.get(key, 0) + p["outside"] + p["inside"]
            if p["outside"] or n >= 2:
                scored.append((path_salience(p["path"], n, p["outside"] > 0), p["path"]))
        for salience, path in sorted(scored, key=lambda x: -x[0])[: self.config.paths_per_turn]:
            yield from self._upsert(path, f"path: {path}", salience, "path", turn)

    def _headings(self, f: dict, turn: int) -> Iterator[Node]:
        for h in f["headings"]:
            yield from self._upsert(h["heading"], f"heading: {h['heading']}", {1: 0.7, 2: 0.55}.get(h["level"], 0.4), "heading", turn)

    def _designs(self, f: dict, turn: int) -> Iterator[Node]:
        for d in f["designs"]:
            if self.find("said", d["summary"]) is None:
                yield self.insert("Fact", short_label(d["summary"]), d["summary"], turn, durable=True, hint=d["hint"], salience=2.5 if d["hint"] == "decision" else 2.0)

    def _outcomes(self, f: dict, turn: int, own: Node) -> list[Node]:
        facts = []
        for text in f["outcomes"]:
            if self.find("said", text) is None:
                event = self.insert("Event", short_label(text), text, turn, hint="outcome")
                fact = self.insert("Fact", short_label(text), text, turn, durable=True, hint="outcome", salience=1.8)
                for node in (event, fact):
                    self.link(own.id, node.id, "contains", turn)
                facts.append(fact)
        return facts

    def _topics(self, f: dict, turn: int, own: Node, new: list[Node]) -> None:
        labels = f["topics"] + [h["heading"] for h in f["headings"] if h["level"] <= 2]
        labels += [n["name"] for n in f["names"] if n["n"] >= 2 or self.find("topic", n["name"])]
        first: dict[str, str] = {}
        for label in labels:
            if len(label) >= 2:
                first.setdefault(label.lower(), label)
        for key, label in list(first.items())[: self.config.topics_per_turn]:
            topic = self._topic(label, turn, own)
            hints = [w for w in key.split() if len(w) > 4]
            for fact in new:
                hay = f"{fact.label} {fact.summary}".lower()
                if key in hay or any(w in hay for w in hints):
                    self.link(topic.id, fact.id, "contains", turn)

    def _topic(self, label: str, turn: int, own: Node) -> Node:
        known = self.find("topic", label)
        if known is not None:
            return known
        a = label.lower().strip()
        for old in self.nodes("Topic"):
            b = old.label.lower().strip()
            if a != b and (a in b or b in a):  # the longer of the two stands for both
                name = label if len(label) >= len(old.label) else old.label
                topic = self.supersede(old, "subsumed", turn, "Topic", name[:80], name, salience=0.8)
                break
        else:
            topic = self.insert("Topic", label[:80], label, turn, salience=0.8)
        self.link(own.id, topic.id, "mentions", turn)
        return topic

    def _pending_like(self, label: str) -> Node | None:
        """The newest open item that contains the label or is contained in it."""
        key = label.lower().strip()
        return next((n for n in reversed(self.active.values()) if n.pending and (key in n.label.lower() or n.label.lower() in key)), None)

    def _items(self, f: dict, turn: int, own: Node) -> None:
        """What is done closes items first, then what is open and not done in this turn opens some."""
        done = {x.lower(): x for x in reversed(f["done"])}
        for item in dict.fromkeys(x.lower() for x in f["done"]):
            old = self.find("item", done[item]) or self._pending_like(done[item])
            if old is not None:
                new = self.supersede(old, "completed", turn, "OpenItem", old.label, f"completed: {old.label}", state="done")
                self.link(own.id, new.id, "mentions", turn)
        for o in f["open"]:
            if o["item"].lower() not in done and self.find("item", o["item"]) is None:
                new = self.insert("OpenItem", o["item"][:80], f"{o['state']}: {o['item']}", turn, state=o["state"])
                self.link(own.id, new.id, "mentions", turn)

    def prune(self, turn: int) -> int:
        """Close what is beyond the caps: the oldest turns and passing facts, the lightest durable ones."""
        c, before = self.config, len(self.closed)
        facts = self.nodes("Fact")
        durable = sorted((n for n in facts if n.durable), key=lambda n: (n.salience, n.start))
        for nodes, cap, reason in ((self.nodes("Turn"), c.max_active_turns, "max_turns"), ([n for n in facts if not n.durable], c.max_facts, "max_facts"), (durable, c.max_durable_facts, "max_durable_facts")):
            for node in nodes[: max(0, len(nodes) - cap)]:
                self.close(node, "pruned", reason, turn)
        return len(self.closed) - before

    def reload(self) -> None:
        """What is lost when each event rebuilds the graph from its stored form."""
        turns = self.nodes("Turn")
        users = [n for n in turns if n.role == "user"]
        self.mentions = {}
        self.last_turn = turns[-1].id if turns else None
        self.last_user = keywords(users[-1].summary) if users and users[-1].summary else None

    def drain(self) -> tuple[list[Node], list[tuple[str, str, str, int]]]:
        """Closed nodes and edges since the last call."""
        out = self.closed, self.edges
        self.closed, self.edges = [], []
        return out

    # ------------------------------------------------------------ views

    def hot_set(self, query: str | None = None, max_chars: int | None = None) -> str:
        """A few lines by quota: decisions, open items, paths and headings, then other facts. A line
        that does not fit is passed over."""
        c = self.config
        limit = c.hot_chars if max_chars is None else max_chars
        wanted = keywords(query or "")

        def weight(n: Node) -> tuple[float, int]:
            return n.salience + (0.5 * overlap(keywords(f"{n.label} {n.summary}"), wanted) if wanted else 0.0), n.start

        groups: dict[str, list[Node]] = {"decision": [], "open": [], "path": [], "other": []}
        for n in self.active.values():
            if n.pending:
                groups["open"].append(n)
            elif n.kind == "Fact":
                groups["path" if n.pathish else "decision" if n.decisive else "other"].append(n)
        slots = max(5, limit // 64)
        quota = {"decision": max(1, int(slots * c.decision_share)), "open": max(1, int(slots * c.open_share)), "path": max(1, int(slots * c.path_share)), "other": slots}
        out, used, seen = [], 0, set()
        for name, members in groups.items():
            left = quota[name]
            for n in sorted(members, key=weight, reverse=True):
                if used >= limit or not left:
                    break
                line = f"{n.kind} {n.label}: {clip((n.summary or n.label).strip(), 64)}"
                key = (n.kind, n.label.lower())
                if key not in seen and used + len(line) + 1 <= limit:
                    seen.add(key)
                    out.append(line)
                    used += len(line) + 1
                    left -= 1
        return "\n".join(out)

    def typed_lines(self, query: str | None = None, top_k: int | None = None) -> list[str]:
        """Open items, facts and paths as labelled lines, the last event at the end; with a query the
        nearest ones first."""
        lines, event = [], None
        for n in self.active.values():
            body = (n.summary or n.label).strip()
            if n.pending:
                lines.append(f"OpenItem: {body}")
            elif n.kind == "Fact":
                lines.append(f"Path: {n.label.strip()}" if n.hint == "path" or _PATH.search(n.label) else f"Fact: {body}")
            elif n.kind == "Event" and (event is None or n.start >= event.start):
                event = n
        if event:
            lines.append(f"Event: {(event.summary or event.label).strip()}")
        first = {line.lower(): line for line in reversed(lines)}
        lines = [first[k] for k in dict.fromkeys(line.lower() for line in lines)]
        if query and query.strip():
            lines = [text for text, _ in rank(query, lines, self.config)]
        return lines[: self.config.typed_top_k if top_k is None else top_k]

    def window_text(self, turns: int | None = None) -> str:
        """The last turns' summaries, then labels of open items and durable facts in order."""
        last = self.nodes("Turn")[-(turns or self.config.window_turns) :]
        return "\n".join([n.summary for n in last if n.summary] + [n.label for n in self.active.values() if n.pending or n.kind == "Fact" and n.durable])

    def candidates(self, query: str | None = None) -> list[str]:
        """Texts that a pack may quote: window chunks, summaries, typed lines, and what the nodes say."""
        from .chunk import chunk_text

        c, terms = self.config, split_terms(query or "")
        found = chunk_text(self.window_text(), c.chunks_per_window, c)
        found += [n.summary or n.label for n in self.nodes("Turn")[-c.window_turns :]]
        found += self.typed_lines(query or None, c.candidate_typed_top_k)
        for n in self.active.values():
            said = n.summary or n.label
            if n.kind in ("Topic", "Event"):
                found.append(said)
            elif n.kind == "Fact" and n.durable:
                strong = n.hint in ("design", "decision", "outcome") or bool(terms & split_terms(f"{n.label} {said}"))
                if strong or n.hint not in ("path", "heading"):
                    found += [said, n.label] if strong else [said]
            elif n.pending:
                found.append(n.label)
        first: dict[str, str] = {}
        for text in map(str.strip, found):
            if text:
                first.setdefault(text.lower(), text)
        return list(first.values())

    def last_query(self) -> str:
        users = [n for n in self.nodes("Turn") if n.role == "user"]
        return users[-1].summary.strip() if users else ""

    def kind_counts(self) -> dict[str, int]:
        return {k: sum(n.kind == k for n in self.active.values()) for k in KINDS}

    def durable_facts(self) -> int:
        return sum(n.kind == "Fact" and n.durable for n in self.active.values())

    def item_signature(self) -> str:
        rows = sorted(f"{n.id}|{n.state}|{n.summary}|{n.label}" for n in self.nodes("OpenItem"))
        return hashlib.sha1("\n".join(rows).encode()).hexdigest()[:16] if rows else "empty"


def fold(turns: Iterable[tuple[str, dict]], config: EngineConfig = DEFAULT) -> ContextGraph:
    """All turns (role, features) of one conversation; closed nodes and edges stay in the graph."""
    graph = ContextGraph(config)
    for k, (role, f) in enumerate(turns):
        graph.ingest(role, k, f)
    return graph
