"""Each operator against brute force, with nulls, empties, repeats, ties and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import common, extract, gam, leaks, lm, mixing, neardup, queries, rules, suffixes, tokens, toxicity

DATA = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, n_words string"
LONG = " ".join(f"w{k} x{k * 7 % 90}" for k in range(150))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, LONG, "en", "c"), (5, LONG, "en", "c"), (6, LONG + " tail end", "de", None),
    (7, "start " + LONG[:700], "fr", "x"), (8, "one two", "en", "y"), (9, "é ü 😀 " * 40, "de", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a = queries.QUERIES[name](spark, DATA).toPandas()
    b = duck.sql(queries.ORACLES[name]).df()
    a, b = (x[sorted(x.columns)].sort_values("doc_id").astype(str).values.tolist() for x in (a, b))
    assert a == b


def test_rules_edge_cases(docs, none):
    got = {r.doc_id: r for r in rules.query(docs).collect()}
    assert len(got) == len(ROWS) and got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert not got[1].kept and got[4].kept and got[9].base_failed
    assert rules.passing(docs).columns == docs.columns and not rules.query(none).take(1)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n, letters in ((2000, 2), (3000, 1), (1, 5), (4000, 50)):
        t = rng.integers(0, letters, n).astype(np.uint8)
        sa, rank = suffixes.suffix_array(t, 24)
        b = t.tobytes()
        assert [b[i : i + 24] for i in sa] == sorted(b[i : i + 24] for i in range(n))
        lcp = suffixes.kasai(t, sa, rank, 24)
        for k in range(1, n):
            x, y = b[sa[k] : sa[k] + 24], b[sa[k - 1] : sa[k - 1] + 24]
            assert lcp[k] == next((q for q in range(min(len(x), len(y))) if x[q] != y[q]), min(len(x), len(y)))


@pytest.mark.parametrize("how", [{}, {"n_shards": 2, "shard_bytes": 4096}])
def test_repeats_equal_brute_force(docs, none, how):
    seen = Counter()
    for _, t, *_ in ROWS:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    got = {r.doc_id: r for r in suffixes.query(docs, **how).collect()}
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(left).hexdigest())
    assert not suffixes.query(none).take(1)
    assert suffixes.without_repeats(docs).columns == docs.columns


def test_darts_estimate_similarity():
    e = np.random.default_rng(0).integers(0, 2**63, 700, dtype=np.int64).astype(np.uint64)
    own = np.repeat([0, 1], 600)
    s = neardup.dart_minhash(np.concatenate([e[:600], e[60:660]]), own, 2, 1024)
    assert abs((s[0] == s[1]).mean() - 540 / 660) < 0.05
    w = np.array([2.5, 1, 0.5, 1.25, 1, 1.0])
    s = neardup.dart_minhash(np.concatenate([e[:3], e[:3]]), np.repeat([0, 1], 3), 2, 2048, w)
    assert abs((s[0] == s[1]).mean() - 2.75 / 4.5) < 0.05


def test_classes_equal_brute_force(spark, docs, none):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (table, docs.select("doc_id", "text")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        sets = {}
        for i, t in texts.items():
            w = [x for x in t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).replace(b"\x0b", b" ").split() if x]
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {("", t)}
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        have = defaultdict(set)
        for i, s in sets.items():
            for g in s:
                have[g].add(i)
        for i, s in sets.items():
            shared = Counter(j for g in s for j in have[g] if j > i)
            for j, n in shared.items():
                if n / (len(s) + len(sets[j]) - n) >= 0.8:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        got = {r.doc_id: r.class_id for r in neardup.query(df).collect()}
        assert got == {i: find(i) for i in sets}
    assert not neardup.query(none).take(1)


@pytest.mark.parametrize("how", [{}, {"small": 3, "block": 40}, {"small": 1000}])
def test_classes_of_a_star_of_edited_copies(spark, how):
    """Copies of a base text, edited at random: most pairs of them are no links, but base and copy are."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    texts = [base]
    for _ in range(400):
        w = list(base)
        for at in rng.choice(200, 4, replace=False):
            w[at] = f"e{rng.integers(1 << 30)}"
        texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.classes(df, **how).collect()}
    assert sum(r == 0 for r in map(find, root)) > 300 and got == {i: find(i) for i in range(len(root))}


def test_leaks_of_short_items_and_blocks(spark, docs):
    bench = spark.createDataFrame([(1, "ONE two"), (2, None), (3, "w3 x21 w4 x28 w5 x35 w6 x42 w7 x49 w8"), (3, "!!")], "item_id long, text string")
    whole = leaks.query(docs, bench).orderBy("doc_id").collect()
    index = common.cut(leaks.build_index(docs), "t")
    assert {r.doc_id for r in whole if r.contaminated} == {4, 5, 6, 7, 8}
    split = leaks.search(index, bench, block_bytes=64).selectExpr("explode(flatten(items)) AS i").groupBy("i").count().collect()
    assert {r.i: r["count"] for r in split} == {"1": 1, "3": 4}
    assert not leaks.query(docs, bench.limit(0)).where("contaminated").take(1)


def test_leaks_without_ids(spark, docs, duck):
    bench = spark.createDataFrame([(None, "one two"), (7, "w3 x21 w4 x28 w5 x35 w6 x42 w7 x49"), (None, "w9 x63 w10")], "item_id long, text string")
    got = sorted(map(tuple, leaks.query(docs, bench).collect()))
    con = duck.cursor()
    documents, benchmark = (x.toPandas() for x in (docs.select("doc_id", "text"), bench))
    con.register("documents", documents)
    con.register("benchmark", benchmark.astype({"item_id": "Int64"}))
    assert got == sorted(con.sql(leaks.ORACLE).fetchall()) and {r[0] for r in got if r[5]} == {4, 5, 6, 7, 8}
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") < 8, F.col("doc_id")))
    left = leaks.without_hits(unnamed, bench)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.where("doc_id IS NULL OR doc_id > 1").collect()) == [(0, ROWS[8][1]), (2, ""), (3, ROWS[2][1])]


def test_lm_scores_equal_the_formula(spark):
    rows = [(k, t) for k, (_, t, *_) in enumerate(ROWS * 3)]
    got = {r.doc_id: r for r in lm.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import re

    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c, b, fol = Counter(), Counter(), defaultdict(set)
    n_docs = sum(not h for h in held.values())
    for i, t in toks.items():
        if not held[i]:
            c.update(t)
            for p, w in zip(["<s>", *t], t):
                b[p, w] += 1
                fol[p].add(w)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        base = path = 0.0
        for p, w in zip(["<s>", *t], t):
            p1 = (c[w] + 1) / (n + v + 1)
            seen = n_docs if p == "<s>" else c[p]
            q = p1 if p != "<s>" and seen < lm.MIN_STATE else (max(b[p, w] - 0.75, 0) + 0.75 * len(fol[p]) * p1) / seen
            base, path = base + np.log10(p1), path + np.log10(q)
        assert got[i].n_tokens == len(t) and got[i].train_tokens == n and got[i].held_out == held[i]
        assert abs(got[i].base_score - base) < 1e-6 and abs(got[i].score - path) < 1e-6


def test_lm_scores_words_after_a_rare_context(spark):
    """``rare`` is seen once in training; the word after it scores by that context, not as a plain unigram."""
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    free = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 != 2)
    got = {r.doc_id: r for r in lm.query(spark.createDataFrame([(held, "rare name"), (free, "rare name")], "doc_id long, text string")).collect()}
    p1 = 2 / (3 + 3 + 1)  # rare, name and the end, once each
    assert abs(got[held].score - 3 * np.log10((1 - 0.75) / 1 + 0.75 * p1)) < 1e-6


def test_token_counts_equal_the_library():
    c = tokens.TokenCounter(tokens.model_path(), chunk=100, overlap=20)
    rng = np.random.default_rng(1)
    cases = ["", " ", "  ", "a ", "\n", "<s> x </s>", "▁a ▁ b", "x" * 900, " " * 900, "a" * 300 + " " + "b" * 500]
    cases += ["".join(rng.choice(list(" ab é\n▁|the  "), rng.integers(900))) for _ in range(200)]
    assert [c.count(x) for x in cases] == [len(c.sp.encode(x)) for x in cases] and c.count(None) == 0


def test_main_text():
    page = "<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>Some <b>long</b>\n text&nbsp;here.<p>More</article><footer>f</footer><script>var a='</p>'"
    assert extract.main_text(page) == "T & t\nSome long text here.\nMore"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<!-- open") == ""


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    t, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    got = gam.query(t, labels).join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert got > 0.95
    scored = toxicity.query(t, labels).join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.min("score"), F.max("score")).first()
    assert scored[0] > 0.9 and 0 <= scored[1] <= scored[2] <= 1


def test_learners_without_labels_or_rows(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in gam.query(docs, labels).collect()} == {0.5}
    assert {r.score for r in toxicity.query(docs, labels).collect()} == {0.5}
    assert not gam.query(none, labels).take(1) and not mixing.query(none, labels).take(1)


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    table = spark.createDataFrame([(k, int(n), list(map(float, x))) for k, (n, x) in enumerate(zip(rng.integers(1, 90, 400), p))], "doc_id long, n_tokens long, posteriors array<double>")
    want = np.array([0.6, 0.3, 0.1])
    out = mixing.rates(table, want, ridge=0.001, steps=60).toPandas()
    got = (np.stack(out.posteriors) * (out.rate * out.n_tokens).to_numpy()[:, None]).sum(0) / out.n_tokens.sum()
    assert (out.rate >= 0).all() and np.abs(got - want).max() < 0.02


@pytest.mark.parametrize("shares, want", [([0.9, 0.05, 0.045, 0.005], [0.85, 0.03, 0.02, 0.10]), ([0.6, 0.3, 0.095, 0.005], list(mixing.TARGETS.values()))])
@pytest.mark.parametrize("clear", [1.0, 0.9])
def test_production_rates_reach_rare_targets(spark, shares, want, clear):
    """With the parameters that the query uses, clear and blurred posteriors, and a domain of 0.5 % of the tokens."""
    own = np.repeat(np.arange(4), (np.array(shares) * 2000).round().astype(int))
    p = np.eye(4)[own] * clear + (1 - clear) / 4
    table = spark.createDataFrame([(k, 10, list(map(float, x))) for k, x in enumerate(p)], "doc_id long, n_tokens long, posteriors array<double>")
    want = np.array(want) * clear + (1 - clear) / 4
    out = mixing.rates(table, want).toPandas()
    got = (np.stack(out.posteriors) * (out.rate * out.n_tokens).to_numpy()[:, None]).sum(0) / out.n_tokens.sum()
    assert (out.rate >= 0).all() and np.abs(got - want).max() < mixing.TOLERANCE


def test_rates_of_a_domain_without_documents(spark):
    table = spark.createDataFrame([(k, 10, [1.0, 0.0] if k else [0.5, 0.0]) for k in range(50)], "doc_id long, n_tokens long, posteriors array<double>")
    out = mixing.rates(table, np.array([0.7, 0.3])).toPandas()
    assert np.abs((np.stack(out.posteriors)[:, 0] * out.rate).mean() - 0.7) < mixing.TOLERANCE
