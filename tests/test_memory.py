"""The stateful part against traced expectations and brute force: graph, packs, chunks, stores, stream."""

import json
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.config import DEFAULT, EngineConfig
from turnloom.functions import producers
from turnloom.functions import vectors as V
from turnloom.operators import bridge, chunk, extract, facts, fold, rank
from turnloom.operators.graph import ContextGraph, keywords, overlap
from turnloom.operators.pack import Memory, Pack, adaptive_budget, in_hot, line_hash, pack_forward, tokens_of
from turnloom.operators.session import Session, default_answer
from turnloom.plans import catalog, scenario
from turnloom.sources import store, transcripts
from turnloom.streaming import events

from .conftest import DATA

DDL = "conv_id long, turn long, role string, text string"


def turns_of(spark, *texts, conv=1):
    return spark.createDataFrame([(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)], DDL)


@pytest.fixture(scope="module")
def features_of(spark):
    def run(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", extract.features(F.col("text")).alias("f")).orderBy("k").collect()
        return [r.f.asDict(recursive=True) for r in rows]

    return run


def graph_of(features_of, *texts, config=DEFAULT):
    g = ContextGraph(config)
    for k, f in enumerate(features_of(*texts)):
        g.ingest("user" if k % 2 == 0 else "assistant", k, f)
    return g


# ------------------------------------------------------------------ the graph, traced by hand


def test_items_open_close_and_stay_closed(spark):
    """Traced by hand: who opens what, which mark closes it, and what stays as it is."""
    turns = turns_of(
        spark,
        'Please add a todo called "water plants" to the weekly plan.',  # the quote, as add and todo are there
        'Opened "water plants" as an item. Nothing else is on it until you add seeds.',  # the piece after add: seeds
        "Add soil and pots to the plan of this week.",  # a piece with blanks opens nothing
        'Now "soil" and "pots" are open under water plants.',
        'Mark "soil" done after lunch on Friday.',
        'Marked "soil" complete. The item "pots" remains open.',  # soil is no longer pending
    )
    nodes = {(r.kind, r.label, r.start_turn): r for r in fold.graph_nodes(turns).collect()}
    items = {k[1:]: (v.status, v.state, v.end_turn, v.reason) for k, v in nodes.items() if k[0] == "OpenItem"}
    assert items == {
        ("water plants", 0): ("active", "open", None, ""), ("seeds", 1): ("active", "open", None, ""), ("soil", 3): ("superseded", "open", 4, "completed"), ("pots", 3): ("active", "open", None, ""), ("soil", 4): ("active", "done", None, ""),
    }
    edges = [tuple(r)[1:] for r in fold.graph_edges(turns).collect()]
    soil = {k[2]: v.node_id for k, v in nodes.items() if k[1] == "soil"}
    assert (soil[4], soil[3], "supersedes", 4) in edges
    assert sum(e[2] == "continues" for e in edges) == 5 and sum(e[2] == "mentions" for e in edges) == 5
    assert sum(e[2] == "contains" for e in edges) == sum(v.kind == "Fact" for v in nodes.values())


def test_completion_without_quotes_and_by_containment(features_of):
    g = graph_of(features_of, 'Create todo "wire hooks"', "Implemented wire hooks in the install script.")
    item = [n for n in g.active.values() if n.kind == "OpenItem"]
    assert [(n.label, n.state) for n in item] == [("wire hooks", "done")] and g.n_superseded == 1
    g = graph_of(features_of, "TODO: first\nTODO: second first", "done: first of all")
    assert {n.label: n.state for n in g.nodes("OpenItem")} == {"first": "done", "second first": "open"}


def test_topics_are_upserted_and_subsumed(features_of):
    g = graph_of(features_of, "Topic: glossary", "topic: glossary rewrite", "goal: glossary", "Topic: glossary rewrite")
    assert [n.label for n in g.nodes("Topic")] == ["glossary rewrite"]
    assert [(n.label, n.reason) for n in g.closed if n.kind == "Topic"] == [("glossary", "subsumed"), ("glossary rewrite", "subsumed")]
    g = graph_of(features_of, "New York is near New York.", "New York again")
    assert [n.label for n in g.nodes("Topic")] == ["New York"]


def test_durable_facts_gain_weight_and_are_pruned_by_it(features_of):
    texts = ["see scripts/run.py", "see scripts/run.py again"] + [f"see notes/n{k}.md" for k in range(40)] + ["scripts/run.py and notes/n0.md"]
    g = graph_of(features_of, *texts)
    durable = [n for n in g.nodes("Fact") if n.durable]
    assert len(durable) == 32 and len(g.nodes("Turn")) == 32
    run = next(n for n in durable if n.label == "scripts/run.py")
    assert run.start == 0 and abs(run.salience - (0.45 + 0.3 + 0.15 + 0.5 + 0.25)) < 1e-9
    again = [n for n in durable if n.label == "notes/n0.md"]
    assert len(again) == 1 and again[0].start == 42  # pruned, then a node of its own
    assert {n.reason for n in g.closed} == {"max_turns", "max_durable_facts"}


def test_passing_facts_keep_the_newest(features_of):
    g = graph_of(features_of, *[f"Sentence number {k} is long enough. And sentence {k} has a second part." for k in range(40)])
    facts_ = [n for n in g.nodes("Fact") if not n.durable]
    assert len(facts_) == 48 and min(n.start for n in facts_) == 16


def test_echo_of_the_user_costs_points(features_of):
    g = graph_of(features_of, "we decided to keep the long table", "We decided to keep the long table. It was chosen because of its wide and sturdy legs.")
    kinds = {n.summary: n.hint for n in g.nodes("Fact") if n.start == 1}
    assert kinds == {"It was chosen because of its wide and sturdy legs.": "decision"}
    g = graph_of(features_of, "你好你好你好", "这是一个非常长的句子，没有任何拉丁字母，足够二十个字符了吧。好的，就是这样的一句话而已啊啊啊啊啊啊。")
    assert all(n.salience == -4.0 for n in g.nodes("Fact") if n.start == 1)  # two empty sets are alike


def test_unknown_kinds_and_relations_are_refused():
    g = ContextGraph()
    a = g.insert("Event", "x", "y", 0)
    with pytest.raises(ValueError):
        g.insert("Thing", "x", "y", 0)
    with pytest.raises(ValueError):
        g.link(a.id, a.id, "likes", 0)


def test_views_of_the_graph(features_of):
    g = graph_of(features_of, 'Create todo "buy paint". See docs/README.md and lists/x.json.', "Recommended structure\ndecision: keep the hashed ranking as it is", "validation passed for the paint")
    typed = g.typed_lines("paint readme")
    assert "OpenItem: open: buy paint" in typed and "Path: docs/README.md" in typed and any(x.startswith("Event: validation passed") for x in typed) and len(typed) <= 12
    assert g.typed_lines()[-1] == "Event: validation passed" and g.typed_lines(top_k=2) == g.typed_lines()[:2]
    hot = g.hot_set().split("\n")
    assert hot[0].startswith("Fact decision: keep") and "OpenItem buy paint: open: buy paint" in hot and sum("path:" in x for x in hot) == 1
    assert len(g.hot_set()) <= 400 and len(g.hot_set(max_chars=90)) <= 90
    assert g.window_text().split("\n")[:3] == [n.summary for n in g.nodes("Turn")] and "docs/README.md" in g.window_text()
    found = g.candidates("what about paint")
    assert len({x.lower() for x in found}) == len(found) and {"buy paint", "validation passed", "decision: keep the hashed ranking as it is"} <= set(found)
    assert g.kind_counts() == {"Turn": 3, "Topic": 0, "Fact": len(g.nodes("Fact")), "OpenItem": 1, "Event": 1} and g.last_query() == "validation passed for the paint"
    before = g.item_signature()
    g.reload()
    assert g.mentions == {} and g.last_user == keywords("validation passed for the paint") and g.item_signature() == before != "empty"
    assert ContextGraph().item_signature() == "empty" and ContextGraph().hot_set() == ""


# ------------------------------------------------------------------ packs


def brute_pack(hot, typed, chunks, budget, recent):
    parts, used = (["HOT_SET:\n" + hot], tokens_of("HOT_SET:\n" + hot)) if hot else ([], 0)
    extra, dup = [], 0
    for k, text in enumerate(typed + chunks):
        seen = {hot.lower(), *hot.lower().split("\n")} if hot else set()
        if text.lower() in seen | {x.lower() for x in extra} or (k >= len(typed) and in_hot(text, hot)):
            continue
        if line_hash(text) in recent or (extra and overlap(keywords(text), keywords("\n".join(extra))) > 0.8):
            dup += tokens_of(text)
        elif used + tokens_of(text) <= budget:
            extra.append(text)
            used += tokens_of(text)
    return parts + extra, dup


def test_packs_equal_brute_force():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta open: milk bread src/a.py".split())
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 9)))
    for _ in range(300):
        hot = "\n".join(line() for _ in range(rng.randint(0, 3)))
        typed, chunks = [line() for _ in range(rng.randint(0, 8))], [line() for _ in range(rng.randint(0, 8))]
        recent = frozenset(line_hash(x) for x in rng.sample(typed + chunks, k=len(typed + chunks) // 3))
        budget = rng.randint(20, 120)
        got = pack_forward(hot, typed, chunks, budget, recent)
        parts, dup = brute_pack(hot, typed, chunks, budget, recent)
        whole = "\n\n".join(parts)
        assert got.text == (whole if tokens_of(whole) <= budget else whole[: 4 * budget - 3].rstrip() + "...") and got.dup_tokens == dup
        assert got.packed_tokens <= budget and got.novel_tokens <= got.packed_tokens and got.hashes == tuple(line_hash(x) for x in got.text.split("\n") if x.strip())
        lifted = pack_forward(hot, typed, chunks, budget, recent, superseded=True)
        assert lifted.novel_tokens == lifted.packed_tokens


def test_small_packs_are_skipped_only_without_changes():
    assert pack_forward("Fact x: x", items_changed=False, may_skip=True).method == "skip"
    for how in ({"items_changed": True}, {"items_changed": False, "superseded": True}, {"items_changed": False, "config": replace(DEFAULT, cross_turn_dedup=False)}):
        assert pack_forward("Fact x: x", may_skip=True, **how).method == "hot_set"
    assert pack_forward("Fact x: x", items_changed=False).text == "HOT_SET:\nFact x: x"
    assert pack_forward().method == "hot_set" and pack_forward("a" * 9000, budget=10).packed_tokens <= 10
    assert pack_forward("h", ["line one of it"], items_changed=False).method == "query-pack"


def test_budgets_follow_novelty():
    assert [adaptive_budget(t, 0.1) for t in (1, 3, 4)] == [1024, 1024, 512] and adaptive_budget(9, 0.75) == 768 and adaptive_budget(9, 7) == 1024
    assert adaptive_budget(9, 0.1, replace(DEFAULT, forward_budget=40)) == 64  # the floor, above the cap
    assert adaptive_budget(9, 0.1, replace(DEFAULT, cross_turn_dedup=False)) == 1024


def test_packs_of_the_table(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    packs = fold.conversation_packs(turns).toPandas()
    assert len(packs) == turns.count() and (packs.packed_tokens <= packs.budget).all() and (packs.novel_tokens <= packs.packed_tokens).all()
    assert all(tokens_of(c) == n for c, n in zip(packs.context, packs.packed_tokens)) and (packs.hot_set.str.len() <= 400).all()
    assert (packs.n_turns == packs.t.clip(upper=32)).all() and set(packs.method) <= {"query-pack", "hot_set", "skip", "extractive", "extractive+hot"}
    many = fold.conversation_packs(turns.repartition(7)).toPandas()
    assert many.sort_values(["conv_id", "t"]).reset_index(drop=True).equals(packs.sort_values(["conv_id", "t"]).reset_index(drop=True))


def test_a_memory_sends_less_of_what_it_sent(features_of):
    m = Memory()
    f = features_of('Create todo "buy paint" because the wall is bare.', "Noted. The wall will be painted when the paint is here.", "And what else is there to do on the wall then?", "Nothing else is there to do on the wall for now.", "fine")
    packs = []
    for k, x in enumerate(f):
        m.step("user" if k % 2 == 0 else "assistant", x)
        packs.append(m.sample())
    assert packs[0].novel_tokens == packs[0].packed_tokens and all(p.dup_tokens > 0 for p in packs[1:])
    assert len(m.history) == 5 and m.context(packs[-1], "a").endswith("STATE: agent_id=a t=5 state_id=state:a:5")
    assert m.context(Pack(), "a").count("HOT_SET") == 2 and "HOT_SET:\n" not in m.context(Pack(method="skip"), "a")
    p1 = Memory(replace(DEFAULT, inject_p1=True, p1_jaccard=0.0))
    p1.step("user", f[0])
    assert p1.sample(p1="todo paint wall").method == "p1-debug"


def test_targets_of_a_sample(features_of):
    m, matrix = Memory(), np.ones((3, 256), np.float32)
    m.step("user", features_of("Create todo \"paint\" for the wall")[0])
    b, a = bridge.Bridge(), bridge.Adapter(256, 8)
    assert m.sample_for("text", matrix, bridge=b).method == "query-pack" and m.sample_for("text").packed_tokens > 0
    assert np.allclose(m.sample_for("local:x", matrix, bridge=b), b.expectation(matrix)) and m.sample_for("local:x", matrix, adapter=a).shape == (3, 8)
    with pytest.raises(ValueError):
        m.sample_for("elsewhere", matrix)


def test_producers_by_name(spark, monkeypatch):
    monkeypatch.setenv("TURNLOOM_EMBED", " ")
    assert producers.chosen() == producers.HASHED
    rows = spark.createDataFrame([("a b",), (None,)], "t string")
    assert rows.select(producers.embed(dim=8)("t").alias("v")).where("size(v) = 8").count() == 2
    with pytest.raises(Exception, match="sentence_transformers"):
        rows.select(producers.embed("some-model", 8)("t")).collect()


def test_summary_of_the_scenario(spark):
    rows = scenario.scenario(spark.read.parquet(f"{DATA}/conversations.parquet")).cache()
    one = scenario.summary(rows).first()
    assert one.delta == one.replayed - one.packed > 0 and 0 < one.eta < 1 and one.median <= one.p95 <= 1024 and one.passed == (one.recall >= 0.3)
    assert rows.where("recall < 0 OR recall > 1 OR jaccard < 0 OR jaccard > 1 OR fill > 1").count() == 0
    assert "| eta |" in scenario.report(scenario.summary(rows)).first()[0]
    rows.unpersist()


# ------------------------------------------------------------------ chunks, gists, ranking, vectors


def test_chunks_keep_what_must_stay_whole():
    text = "# Setup\nIntro about it.\n```python\ndef helper(x):\n    return x\n```\ndef pack(hot, budget):\nMore after that. See src/app.py for details.\n## Last\nend"
    got = chunk.chunk_text(text, 16)
    assert got[:2] == ["# Setup", "## Last"] and "```python\ndef helper(x):\n    return x\n```" in got and any("def pack(hot, budget):" in c for c in got) and any("src/app.py" in c for c in got)
    few = chunk.chunk_text(text, 3)
    assert len(few) == 3 and few[:2] == ["# Setup", "## Last"] and few[2].startswith("```")
    long = " ".join(f"Sentence {k} has a few words in it." for k in range(200))
    parts = chunk.chunk_text(long, 1000)
    assert all(96 <= chunk.words(c) <= 128 for c in parts[:-1]) and " ".join(parts) == long
    assert len(chunk.chunk_text(long, 5)) == 5 and chunk.chunk_text(long, 5)[0] == parts[0] and chunk.chunk_text(long, 5)[-1] == parts[-1]
    assert chunk.chunk_text(" ", 4) == [""] and chunk.chunk_text(None, 4) == [""] and chunk.spread(9, 4) == [0, 3, 5, 8] and chunk.spread(6, 3) == [0, 2, 5]
    assert chunk.chunk_text("\ue000P0\ue001 odd", 4) == ["\ue000P0\ue001 odd"]


def test_gists_of_columns_and_strings_agree(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").unionByName(spark.createDataFrame([(m[3],) for m in catalog.MARKS], "text string"))
    rows = docs.select("text", extract.gist(F.col("text"), 32).alias("g")).collect()
    assert all(r.g == bridge.plain_gist(r.text or "", 32) for r in rows) and any(r.g for r in rows)
    gist = bridge.plain_gist('See docs/README.md and src/app.py.\n# Setup Guide\nCreate todo "buy groceries" and add "milk".', 16).lower().split()
    assert len(set(gist)) == len(gist) and {"docs/readme.md", "buy", "groceries", "milk"} <= set(gist)


def test_ranking_depends_on_the_query():
    texts = ["SQL inner join customers table for the report.", "Python def encode_rows(text) hashes n-grams.", "Grocery list remains open: milk, bread.", "Health check returned 200."]
    assert rank.rank("How does the SQL join on customers work?", texts)[0][0] == texts[0] and rank.rank("What grocery items are open on the list?", texts)[0][0] == texts[2]
    assert rank.rank(" ", texts) == [] and [x for x, _ in rank.rank("milk", ["Milk", "milk", " "])] == ["Milk"]
    far = rank.relevant("zebra", ["aa", "bb", "cc", "dd"])
    assert far and len(far) <= 3 or all(s >= DEFAULT.min_cosine for _, s in far)
    exact = [(x, float(np.dot(V.embed_text("milk bread", 256, 0).astype(float), V.embed_text(x, 256, 0).astype(float)))) for x in texts]
    assert all(abs(dict(rank.rank("milk bread", texts))[x] - s) < 1e-6 for x, s in exact)


def test_ranked_rows_equal_ranked_lists(spark):
    texts = ["open the milk list", "bread and milk", "Bread and MILK", "nothing alike", "", "a longer text about milk and the bread list of the week"]
    rows = spark.createDataFrame([(1, 0, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, row int, text string")
    got = rank.nearest_spans(rows, spark.createDataFrame([(1, "milk list")], "conv_id long, query string"), 3).orderBy("rank").collect()
    assert [r.text for r in got] == [t for t, _ in rank.rank("milk list", texts)][:3]
    assert not rank.nearest_spans(rows, spark.createDataFrame([(1, "")], "conv_id long, query string")).take(1)


def brute_pool(prev, new, k_max, ema):
    rows = [np.asarray(r, np.float32) for r in [*(prev if prev is not None else []), *new]]
    while len(rows) > k_max:
        sims = [float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for a, b in zip(rows, rows[1:])]
        k = max(range(len(sims)), key=lambda i: (sims[i], -i))
        rows = rows[:k] + [(ema * rows[k] + (1 - ema) * rows[k + 1]).astype(np.float32)] + rows[k + 2 :]
    m = np.stack(rows)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def test_pooling_turn_by_turn():
    rng = np.random.default_rng(1)
    a = b = None
    for n in (3, 5, 1, 9, 4, 2):
        new = rng.normal(size=(n, 16)).astype(np.float32)
        a, b = V.pool(a, new, 8, 0.7), brute_pool(b, new, 8, 0.7)
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-5) and len(a) <= 8
    assert V.live_mask(3, 5).tolist() == [1, 1, 1, 0, 0] and V.live_mask(2).tolist() == [1, 1]


def test_matrix_states_pool_each_turn(spark):
    turns = turns_of(spark, *[f"Text {k} of many. " * 3 for k in range(40)])
    rows = fold.matrix_states(turns).orderBy("t").collect()
    m = None
    for k, r in enumerate(rows):
        m = brute_pool(m, [V.embed_text(c, 256, 0) for c in chunk.chunk_text(f"Text {k} of many. " * 3, 8)], 32, 0.7)
        assert r.t == k + 1 and (r.k, r.d) == m.shape and r.parent_id == (f"state:1:{k}" if k else None)
    assert np.allclose(np.array(rows[-1].matrix), m, atol=1e-4) and rows[-1].k == 32


# ------------------------------------------------------------------ bridge and adapter


def test_decoding_takes_each_word_once():
    b = bridge.Bridge(dim=64)
    same = np.ones((4, 64), np.float32)
    assert len(set(b.decode(same))) == 4 and np.allclose(np.linalg.norm(b.expectation(same), axis=1), 1, atol=1e-5) and np.allclose(b.shares(same).sum(1), 1, atol=1e-5)
    assert b.decode(b.table[[5]] * 50)[0] == b.target[5]
    m = bridge.alignment(["add", "adze", "zzz"], ["add", "adder", "b"])
    assert m.tolist() == [[1, 0, 0], [0.5, 0.5, 0], [0, 0, 1]]


def test_merging_a_hot_set_with_words():
    assert bridge.merge_forward("OpenItem bread: open", "milk bread Milk", "file right add") == ("OpenItem bread: open\nmilk", "extractive+hot")
    assert bridge.merge_forward("hot", "", "")[1] == "hot_set" and bridge.merge_forward("", "a b a", most=1) == ("a", "extractive") and bridge.merge_forward() == ("", "hot_set")
    assert bridge.merge_forward("buy milk", "", "milk buy", allow_p1=True)[1] == "p1-debug" and bridge.merge_forward("buy milk", "", "far off", allow_p1=True)[1] == "hot_set"


def test_adapter_learns_and_survives_storage(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 12)).astype(np.float32)
    y = (x[:, :8] * 0.1).astype(np.float32)
    a = bridge.Adapter(12, 8)
    first = a.train_step(x, y, rate=0.5)
    for _ in range(200):
        last = a.train_step(x, y, rate=0.5)
    assert last < first and a.forward(x).shape == (200, 8)
    bridge.save_adapter(spark, a, str(tmp_path / "w"))
    assert np.array_equal(bridge.load_adapter(spark, str(tmp_path / "w")).forward(x), a.forward(x))


def test_pairs_of_two_producers(spark):
    turns = turns_of(spark, "one two three. " * 4, "four five six. " * 4)
    x, y = bridge.collect_pairs(fold.matrix_states(turns, replace(DEFAULT, dim=32)), fold.matrix_states(turns, replace(DEFAULT, dim=16), seed=99))
    assert x.shape[1] == 32 and y.shape[1] == 16 and len(x) == len(y) == 3 and bridge.train_adapter(x, y, 2).forward(x).shape == y.shape


# ------------------------------------------------------------------ sources and stores


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role":"user","content":"hi there"}\n\nbroken\n{"role":"assistant","message":{"content":[{"type":"text","text":"yes"}]}}\n')
    (tmp_path / "b.jsonl").write_text('{"role":"tool","content":"x"}\n')
    rows = transcripts.read_transcripts(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in rows] == [(0, "user", "hi there"), (1, "assistant", "yes")] and rows[0].conv_id.endswith("a.jsonl")
    assert [r.text for r in transcripts.from_records(spark, [{"role": "user", "content": "a"}, {"role": "user"}]).collect()] == ["a"]
    (tmp_path / "m.py").write_text("\n# head line\nx = 1\n")
    assert [r.headline for r in transcripts.inventory(spark, str(tmp_path)).collect()] == ["# head line"]


def test_settings_from_the_environment(monkeypatch):
    for k, v in {"FORWARD_BUDGET": "77", "FACTS_PER_TURN": "99", "K_MAX": "-1", "EMA": "x", "CROSS_TURN_DEDUP": "off", "INJECT_P1": "maybe"}.items():
        monkeypatch.setenv("TURNLOOM_" + k, v)
    c = EngineConfig.from_env()
    assert (c.forward_budget, c.facts_per_turn, c.k_max, c.ema, c.cross_turn_dedup, c.inject_p1) == (77, 12, 32, 0.7, False, False)


def test_identifiers_of_the_caller(spark):
    turns = turns_of(spark, "Here the word zorblax stands in a text.")
    got = [facts.scored_sentences(turns, c).first().score for c in (DEFAULT, replace(DEFAULT, identifiers=("zorblax",)))]
    assert got == [0.0, 1.5]


def test_stores_append_only_and_look_up(spark, tmp_path):
    states = fold.matrix_states(turns_of(spark, "a b c", "d e f"))
    path = str(tmp_path / "states")
    store.append_new(states, path)
    store.append_new(states, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and store.load_state(back, "state:1:2").parent_id == "state:1:1" and store.latest_states(back).first().t == 2
    with pytest.raises(KeyError):
        store.load_state(back, "state:1:9")
    nodes, edges = fold.graph_nodes(turns_of(spark, "TODO: xy")), fold.graph_edges(turns_of(spark, "TODO: xy"))
    for name in ("s1", "s2"):
        store.freeze(nodes, edges, str(tmp_path / "frozen"), name)
    assert spark.read.parquet(str(tmp_path / "frozen/nodes")).where("snapshot = 's1'").count() == nodes.count()
    assert store.kind_counts(nodes).first().OpenItem == 1
    store.save_alignment(spark.createDataFrame([(0, 1, 0.5)], "i long, j long, mass double"), str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).first().mass == 0.5


# ------------------------------------------------------------------ events


def test_answers_never_fail(features_of):
    f = features_of("Create todo \"paint\" because it is needed now")[0]
    s = Session.start("a")
    ok = s.handle(1, "beforeSubmitPrompt", "x", f)
    assert ok[3:6] == (1, 1, "") and json.loads(ok[12])["continue"] is True and "paint" in json.loads(ok[12])["additional_context"]
    bad = s.handle(2, "beforeSubmitPrompt", "x", {"summary": "only"})
    assert bad[3:6] == (1, 0, "KeyError") and json.loads(bad[12]) == {"continue": True} and s.memory.t == 1 and len(s.memory.graph.nodes("Turn")) == 1
    assert json.loads(s.handle(3, "beforeSubmitPrompt", None, f)[12]) == {"continue": True} and json.loads(s.handle(4, "afterAgentResponse", "y", f)[12]) == {}
    assert "frozen context graph" in json.loads(s.handle(5, "preCompact", None, None)[12])["user_message"]
    start = s.handle(6, "sessionStart", None, None)
    assert "HOT_SET" in json.loads(start[12])["additional_context"] and json.loads(start[13])["t"] == 2
    assert s.handle(7, "other", "z", f)[3] == 2 and default_answer("sessionStart") == {"additional_context": ""}
    s.memory.graph.candidates = None  # packing breaks, the turn stays
    broken = s.handle(8, "beforeSubmitPrompt", "x", f)
    assert broken[3:6] == (3, 1, "TypeError") and json.loads(broken[12]) == {"continue": True}


def test_events_of_one_process_each(features_of):
    f = features_of("see a/b.md", "```\na/b.md\n```", "```\nc/d.md\n```", "```\nc/d.md\n```")
    for reload, known in ((False, {"a/b.md", "c/d.md"}), (True, {"a/b.md"})):
        m = Memory(replace(DEFAULT, reload_each_turn=reload))
        for x in f:
            m.step("user", x)
        assert {n.label for n in m.graph.nodes("Fact") if n.hint == "path"} == known  # counts of fenced paths are lost with the process


def test_the_stream_answers_like_the_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lines = [r.value for r in catalog._events(spark, DATA).limit(60).collect()] + ["not json", '{"event":"preCompact","conversation_id":"c0","seq":99}']
    lines.sort(key=lambda x: json.loads(x).get("seq", -1) if x[0] == "{" else -1)
    for k, at in enumerate(range(0, len(lines), 25)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(lines[at : at + 25]) + "\n")
        os.utime(tmp_path / "in" / f"{k}.jsonl", (1e9 + k, 1e9 + k))  # files come in by their age
    source = events.read_events(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    events.write_answers(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = sorted(map(tuple, events.replay(spark.createDataFrame([(x,) for x in lines], "value string")).collect()), key=str)
    assert got == want and len(got) == len(lines)
