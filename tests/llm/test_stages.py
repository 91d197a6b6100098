"""The pipeline's stages and the operators' harder cases, against brute force and known truth."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import common, extract, features, gam, leaks, lm, mixing, neardup, queries, rules, suffixes, tokens, toxicity

LONG = " ".join(f"w{k} x{k * 7 % 90}" for k in range(150))
CLASH = "n_words string, failed string, kept string, row string, key string, id string, copies string, spans string, bad string, `__text` string, `__row` string, `__key` string, class_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def brute_classes(texts, threshold=0.8):
    """Class roots of a list of word lists or texts (the place of each class's first)."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {("", t)})
    root, have = list(range(len(sets))), defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in have[g])
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                a, b = find(root, i), find(root, j)
                root[max(a, b)] = min(a, b)
        for g in s:
            have[g].append(i)
    return [find(root, i) for i in range(len(root))]


def brute_cut(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore"))
    return out


def leak_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_leaks(texts, items, window=10):
    wanted = defaultdict(set)
    for t in items:
        w = leak_words(t)
        size = min(window, len(w))
        if size:
            wanted[size] |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return [any(tuple(w[k : k + n]) in g for n, g in wanted.items() for k in range(len(w) - n + 1)) for w in map(leak_words, texts)]


# ------------------------------------------------------------------ near duplicates


def test_classes_of_edits_near_the_threshold_and_of_chains(spark):
    rng = np.random.default_rng(11)
    texts = []
    for family in range(3):
        base = [f"f{family}b{k}" for k in range(200)]
        for _ in range(100):
            w = list(base)
            for at in rng.choice(200, rng.integers(1, 7), replace=False):
                w[at] = f"e{rng.integers(1 << 30)}"
            texts.append(" ".join(w))
    chain = [f"c{k}" for k in range(120)]
    for step in range(40):  # each link of the chain moves on; its ends share nothing
        texts.append(" ".join(chain))
        chain = chain[4:] + [f"n{step}x{k}" for k in range(4)]
    want = brute_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.query(df).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) > 5 and want[300:] == [300] * 40


@pytest.mark.parametrize("kind", ["long", "string"])
def test_classes_go_by_texts_whatever_the_ids(spark, kind):
    other = " ".join(f"z{k}" for k in range(90))
    rows = [(1, LONG), (1, other), (2, LONG + " more"), (None, LONG), (None, other + " t"), (-5, other + " t u"), (7, None), (None, ""), (1, LONG), (None, "all alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = sorted((str(r.doc_id), (r.text if hasattr(r, "text") else ""), str(r.class_id), r.copies) for r in neardup.query(df).collect())
    low = "-5" if kind == "long" else min("1", "-5")
    want = [("1", "1", 3), ("1", low, 1), ("2", "1", 1), ("None", "1", 3), ("None", low, 1), ("-5", low, 1), ("7", "7", 2), ("None", "7", 2), ("1", "1", 3), ("None", "None", 1)]
    assert got == sorted((a, "", b, n) for a, b, n in want)
    kept = sorted((str(r.doc_id), r.text or "") for r in neardup.representatives(df).collect())
    assert kept == sorted([("1", LONG), ("-5", other + " t u"), ("7", ""), ("None", "all alone here")])


# ------------------------------------------------------------------ values of clashing columns


def test_stages_leave_clashing_columns_alone(spark):
    texts = [LONG, "one two", None, "start " + LONG[:900] + " and " + " ".join(f"q{k} r{k}" for k in range(60)), " ".join(f"u{k} v{k % 9}" for k in range(80))]
    rows = [(k, t, *[f"{c}{k}" for c in "abcdefghijklm"]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")
    bench = spark.createDataFrame([(1, "u3 v3 u4 v4 u5 v5 u6 v6 u7 v7 u8")], "item_id long, text string")
    of = lambda out: {r.doc_id: tuple(r) for r in out.collect()}
    before = of(df)
    passed = of(rules.passing(df))
    assert passed == {k: before[k] for k in (0, 3, 4)}
    assert of(neardup.representatives(df)) == before
    assert of(leaks.without_hits(df, bench)) == {k: before[k] for k in (0, 1, 2, 3)}
    cut = of(suffixes.without_repeats(df))
    want = brute_cut(texts)
    assert cut == {k: (k, want[k] if texts[k] is not None else None, *before[k][2:]) for k in before} and want[0] != texts[0]
    for stage in (rules.passing, neardup.representatives, suffixes.without_repeats):
        assert stage(df).columns == df.columns and not stage(df.limit(0)).take(1)


def test_a_clean_row_stays_beside_a_hit_one_of_its_id(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "x y z"), (None, "a b c d"), (2, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "A b C")], "item_id string, text string")
    assert sorted(map(tuple, leaks.without_hits(df, bench).collect())) == [(1, "x y z"), (2, "x y z")]


# ------------------------------------------------------------------ suffix arrays, phrases, rules


@pytest.mark.parametrize("shard_bytes", [600, 1000])
def test_contexts_longer_than_a_shard(spark, shard_bytes):
    rng = np.random.default_rng(2)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    period = noise(37)
    texts = [period * 60, noise(300) + period * 30 + noise(40), None, "ab" * 900, noise(5000), "x" * 1500, "", "z" * 199, "z" * 200 + noise(80)]
    texts.append(texts[4][1000:1400] + noise(50))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.without_repeats(df, n_shards=3, shard_bytes=shard_bytes).collect()}
    assert [got[k] or "" for k in range(len(texts))] == brute_cut(texts)


def test_words_close_together(spark):
    df = spark.createDataFrame([(1, "red x x blue"), (2, "blue x x x x x red"), (3, "Red blue. red"), (4, "blue"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, leaks.proximity(df, [("q", "Blue red"), ("none", "green red")], 3).collect()))
    assert got == [(1, "q", 1), (3, "q", 1)]


def test_ablations_count_each_policy(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,), (5,)], "failed long")
    got = {(r.version, r.rule): tuple(r)[2:] for r in rules.ablations(entries).collect()}
    flags = [0, 1, 1, 3, 4, 64, 5]
    for p in rules.POLICIES:
        mask = p.mask(rules.RULES)
        for r in rules.RULES:
            if r.name in p.rules:
                bit = 1 << r.bit
                want = (7, sum(x & bit > 0 for x in flags), sum(x & mask == bit for x in flags), sum(x & mask == 0 for x in flags), sum(x & mask & ~bit == 0 for x in flags))
                assert got[p.version, r.name] == want


def test_few_words_whatever_the_length(spark):
    df = spark.createDataFrame([(n, " ".join(f"j{k % 25}" for k in range(n))) for n in (60, 4999, 5000, 40000)], "doc_id long, text string")
    bit = 1 << next(r.bit for r in rules.RULES if r.name == "few_words")
    assert {r.doc_id: bool(r.failed & bit) for r in rules.query(df).collect()} == {60: False, 4999: True, 5000: True, 40000: True}


# ------------------------------------------------------------------ learners by plain loops


def test_additive_model_by_plain_loops():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    how = {"n_bins": 5, "rounds": 6, "rate": 0.3, "depth": 2, "n_pairs": 1, "pair_rounds": 4, "l2": 1.0}
    m = gam.fit(x, y, **how)
    p0 = y.mean()
    z = [np.log(p0 / (1 - p0))] * 300
    edges = [sorted(set(np.quantile(x[:, k], np.linspace(0, 1, 6)[1:-1]))) for k in range(3)]
    bins = [[sum(v >= e for e in edges[k]) for k, v in enumerate(row)] for row in x]

    def grads():
        p = [1 / (1 + np.exp(-v)) for v in z]
        return [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p]

    def tree(g, h, depth):
        total = sum(g) ** 2 / (sum(h) + 1.0)
        gains = [(sum(g[:c]) ** 2 / (sum(h[:c]) + 1.0) + sum(g[c:]) ** 2 / (sum(h[c:]) + 1.0) - total, -c) for c in range(1, len(g))]
        if not depth or not gains or max(gains)[0] <= 1e-9:
            return [-sum(g) / (sum(h) + 1.0)] * len(g)
        c = -max(gains)[1]
        return tree(g[:c], h[:c], depth - 1) + tree(g[c:], h[c:], depth - 1)

    tables = [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(6):
        for k in range(3):
            g, h = grads()
            hg, hh = [0.0] * len(tables[k]), [0.0] * len(tables[k])
            for i in range(300):
                hg[bins[i][k]] += g[i]
                hh[bins[i][k]] += h[i]
            step = [0.3 * v for v in tree(hg, hh, 2)]
            tables[k] = [a + b for a, b in zip(tables[k], step)]
            for i in range(300):
                z[i] += step[bins[i][k]]
    for k in range(3):
        assert np.allclose(m.tables[k], tables[k])
    (i, j), pair = m.pairs[0], m.pair_tables[0]
    score = [1 / (1 + np.exp(-(m.intercept + sum(tables[k][b[k]] for k in range(3)) + pair[b[i], b[j]]))) for b in bins]
    assert np.allclose(m.score(x), score) and np.mean((m.score(x) > 0.5) == y) > 0.8


def test_ftrl_by_plain_loops():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    y = np.array([float(3 in r or 5 in r) for r in rows])
    model = toxicity.ftrl([r.copy() for r in rows], y, bits=6, alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=3, min_count=1)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(k):
        l1 = 0.0 if k == 64 else 0.3
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((1.0 + n[k] ** 0.5) / 0.5 + 0.1)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(80):
            at = [*rows[r].tolist(), 64]
            w = [weight(k) for k in at]
            g = 1 / (1 + np.exp(-sum(w))) - y[r]
            for k, v in zip(at, w):
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.5 * v
                n[k] += g * g
    assert np.allclose(model.bias, weight(64)) and model.ids.tolist() == [k for k in range(64) if weight(k)]
    assert np.allclose(model.weights, [weight(k) for k in model.ids])
    first = np.cumsum([0] + [len(r) for r in rows])
    got = model.score(np.concatenate(rows), first)
    assert np.allclose(got, [1 / (1 + np.exp(-(weight(64) + sum(weight(k) for k in r)))) for r in rows])
    assert model.score(np.zeros(0, np.int32), np.array([0, 0])).tolist() == [1 / (1 + np.exp(-model.bias))]


def test_measurements_by_plain_loops():
    texts = ["", "One two, two!\n\nOne two\none | é 12", " a\tb  a b a b\nx\nx\n", "ABC def" * 3]
    raw = [t.encode() for t in texts]
    x = features.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    for t, r, got in zip(texts, raw, x):
        w = re.findall(rb"[^\x20\x09-\x0D]+", r)
        lines = [y for y in r.split(b"\n") if y]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        per = max(1, len(w))
        upper, lower = sum(65 <= c < 91 for c in r), sum(97 <= c < 123 for c in r)
        want = [
            np.log1p(len(w)), sum(map(len, w)) / per, sum(c in b"#*$%&|<>" for c in r) / per, sum(c in b"!?" for c in r) / per, upper / max(1, upper + lower),
            sum(48 <= c < 58 for c in r) / max(1, len(r)), len(set(w)) / per, len(set(tri)) / max(1, len(tri)), 1 - len(set(lines)) / max(1, len(lines)),
            sum(c in b".,;:" for c in r) / per, sum(c >= 128 for c in r) / max(1, len(r)), len(lines) / per, r.count(b"|") / per, max(Counter(w).values(), default=0) / per,
        ]
        assert np.allclose(got, want), t


@pytest.mark.parametrize("size", [10, 1 << 16, 200_000])
def test_hashes_of_ranges_over_many_blocks(size):
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, size + 50, dtype=np.int64).astype(np.uint8)
    buf = np.concatenate([buf, buf])  # every range stands twice, at another place of its block
    starts, ends = np.array([0, 3, size // 2]), np.array([size + 50, size, size // 2])
    one = common.span_hash(buf, starts, ends)
    two = common.span_hash(buf, starts + size + 50, ends + size + 50)
    assert (one == two).all() and len(set(one.tolist())) == 3
    assert common.span_hash(buf, starts, ends - 1)[0] != one[0]


# ------------------------------------------------------------------ pages


PROSE = "the people of the town had been there for as long as they could say and it was not that they had to be"


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    line = lambda k: " ".join(rng.permutation(PROSE.split())[: rng.integers(14, 22)]) + f" {seed}.{k}."
    truth = [f"Title {seed} & more"] + [line(k) for k in range(rng.integers(3, 9))]
    body = [f"<h1>Title {seed} &amp; more</h1>"]
    for k, t in enumerate(truth[1:]):
        shown = t.replace("people", pick("people", "<b>people</b>", "<a href='/p'>people</a>", "<!-- no -->people"))
        body.append(pick("<p>{}</p>", "<p>{}", "<p class='par'>{}\n</p>", "<p title='it's'>{}</p>", '<p data-x="a>b">{}</p>', "<div>{}</div>", "<P\nID=p>{}</P>").format(shown.replace(" and ", pick(" and ", "\n and ", "&nbsp;and "))))
        if rng.random() < 0.4:
            body.append(pick('<div class="ad">Buy now, buy it here</div>', "<script>document.write('<body><p>not text</p>');</script>", "<style>p{}</style>", '<aside><p>' + PROSE + "</p></aside>", '<form action="/s"><input name=q><label>Find</label></form>', '<svg width="3"/>'))
    main = pick("<article>{}</article>", "<main>{}</main>", '<div class="article-body">{}</div>', '<article class="post">{}</article>').format("".join(body))
    menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>Menu {k}</a></li>" for k in range(5)) + "</ul></nav>"
    rest = "".join(
        x for x in (
            pick("", "<header><a href=/>Home</a> Site</header>"), menu, pick("", '<div class="cookie-notice">We use cookies on the site for all of you.</div>'), main,
            pick("", f'<section class="comments"><h2>Comments</h2><p>{PROSE}, says a reader.</p></section>'), pick("", f'<div id="sidebar"><p>{PROSE}</p></div>'), "<footer>All rights of the site</footer>",
        )
    )
    head = pick('<head><title>T</title><script>var b="<body>";</script></head><body>', "<head><meta charset=utf-8><title>T</title>", "")
    got = extract.main_text(f"<!DOCTYPE html><html>{head}{rest}</body></html>")
    assert got == "\n".join(" ".join(t.split()) for t in truth)


def test_odd_pages():
    body = "<p>" + PROSE + " " + PROSE + ".</p>"
    text = extract.main_text(body)
    assert text == PROSE + " " + PROSE + "."
    for page in (f"<svg/>{body}", f"<article><button>{body}", f'<article><div class="form">{body}</div></article>', f"<head><title>x</title>{body}", f"{body}<textarea>open", f"{body}<tag never closed"):
        assert extract.main_text(page) == text, page
    assert extract.main_text(f'<article>{body}<div class="comments">{body}</div></article>') == text
    assert extract.main_text("<article><p>a\x1cb\x85c</article>") == "a b c"
    assert extract.main_text("<div>" * 50_000 + "x" + "</p>" * 50_000 + "<button>" * 50_000) is not None


# ------------------------------------------------------------------ queries on tables


def test_the_query_meets_its_targets(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    rated = mixing.query(docs, labels).cache()
    got = {r.domain: r for r in mixing.report(rated).collect()}
    assert set(got) == set(mixing.TARGETS) and all(abs(r.residual) < 1e-3 and abs(r.target + r.residual - r.reached) < 1e-9 for r in got.values())
    assert rated.count() == docs.count() and rated.agg(F.min("rate")).first()[0] >= 0
    rated.unpersist()


def test_token_counts_of_the_query(spark):
    import sentencepiece

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(9)
    big = [(-1, None), (-2, ""), (-3, "ab " * 9000), (-4, "x" * 30_000), (-5, "".join(rng.choice(list("abc é\n▁  the "), 60_000))), (-6, " " * 20_000), (-5, "again")]
    docs = table.unionAll(spark.createDataFrame(big, "doc_id long, text string"))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096) for r in docs.collect())
    assert Counter(map(tuple, tokens.token_counts(docs).collect())) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (rules.query(docs), gam.query(docs, labels), neardup.query(docs), suffixes.query(docs), leaks.query(docs, bench), toxicity.query(docs, labels), lm.query(docs), extract.extract_pages(pages), mixing.query(docs, labels), tokens.token_counts(docs)):
        assert not out.take(1)


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "v", "<article><p>Hi</article>")], "page_id long, url string, html string")
    assert sorted(map(str, extract.extract_pages(pages).collect())) == sorted(["Row(page_id=1, url=None, text='', n_chars=0)", "Row(page_id=1, url='u', text='', n_chars=0)", "Row(page_id=None, url='v', text='Hi', n_chars=2)"])


def test_pipeline_equals_brute_force(spark, duck, tmp_path):
    """run() on a small table with planted copies, passages, leaks, nulls and repeated ids."""
    rng = np.random.default_rng(21)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("ban", "den", "fol", "gar", "hum", "jit", "kel", "lor", "mas", "nov")]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, item = prose(60), prose(25)
    texts = [prose(int(n)) for n in rng.integers(60, 200, 60)]
    texts += [texts[0], texts[1] + " tail", texts[2], None, "", "short text", "!! " * 90, prose(30) + " " + passage + " " + prose(40), passage + " " + prose(50), prose(20) + " " + item + " " + prose(60)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(3, prose(80), "en", "s", 5), (None, prose(90), "en", "s", 6), (0, texts[0], "en", "s", 7)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("i1", item), (None, "nothing like it at all in here")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    con = duck.cursor()
    con.execute("CREATE TEMP TABLE numbered AS SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if r[1] is None else repr(r[1])})" for k, r in enumerate(rows)) + ") t(doc_id, text)")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({rules.ORACLE.replace('FROM documents', 'FROM numbered')}) WHERE kept").fetchall()}
    left = sorted((rows[k] for k in kept), key=lambda r: (r[0] is None, r[0] or 0))
    left = [r for k, r in enumerate(left) if brute_classes([x[1] for x in left])[k] == k]
    left = [(r[0], t) for r, t in zip(left, brute_cut([r[1] for r in left]))]
    left = [r for r, bad in zip(left, brute_leaks([t for _, t in left], [item, "nothing like it at all in here"])) if not bad]
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((d, len(words(t))) for d, t in left)
    assert 50 < len(out) < len(rows) - 8 and all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in out)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        assert stage(spark, docs, sf).columns == docs.columns and not stage(spark, docs.limit(0), sf).take(1), name


def test_scratch_is_released(spark):
    one, two = common.cut(spark.range(3).toDF("a"), "one"), None
    spare = common.mark()
    two = common.cut(spark.range(4).toDF("a"), "two")
    common.release(spark, spare=spare)
    assert one.count() == 3 and not os.path.exists(two._cut.removeprefix("file:"))
    common.forget(one)
    assert not os.path.exists(one._cut.removeprefix("file:")) and queries.QUERIES
