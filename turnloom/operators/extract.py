"""What a turn holds, as one struct of short arrays: everything the fold needs, row by row.

All of it is column expressions on the turn's own text, without a join, a window or Python, so the
batch fold and the streaming one read the same features. Families keep the order in which they are
listed; of elements that differ by case alone the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import lexicon as L
from ..functions import text as T

_NONE = "array<string>"


def unfenced(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), L.FENCE_RE, "\n")


def fenced(x: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(L.FENCE_RE), F.lit(0)), "\n")


def _no_strings() -> Column:
    return F.array().cast(_NONE)


def _nonempty(xs: Column, at_least: int = 1) -> Column:
    return F.filter(xs, lambda x: F.length(x) >= at_least)


def sentences(text: Column, identifiers: tuple[str, ...] = ()) -> Column:
    """array<struct<sentence, score, words>>: sentences of 20 characters or more, cut to 240; the
    score lacks what an echo of the last user turn costs."""
    parts = F.filter(F.transform(T.sentences(text), T.strip), lambda x: F.length(x) >= 20)
    cut = F.transform(parts, lambda x: T.clip(x, 240))
    return F.transform(cut, lambda x: F.struct(x.alias("sentence"), T.cue_score(x, identifiers).alias("score"), T.keyword_set(x).alias("words")))


def paths(text: Column) -> Column:
    """array<struct<path, outside, inside>>: distinct paths, those outside of fences first, with
    their counts outside and inside."""
    out, inn = T.every(unfenced(text), L.PATH_RE), T.every(fenced(text), L.PATH_RE)

    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: F.lower(y) == F.lower(x)))

    both = F.struct(out.alias("o"), inn.alias("i"))
    return T.let(both, lambda s: F.transform(T.first_distinct(F.concat(s["o"], s["i"])), lambda x: F.struct(x.alias("path"), count(s["o"], x).alias("outside"), count(s["i"], x).alias("inside"))))


def headings(text: Column, limit: int = 8) -> Column:
    """array<struct<heading, level>> outside of fences."""
    plain = unfenced(text)
    found = F.zip_with(T.every(plain, L.HEADING_RE, 1), T.every(plain, L.HEADING_RE, 2), lambda a, b: F.struct(T.strip(b).alias("heading"), F.length(a).alias("level")))
    return T.first_distinct(F.filter(found, lambda x: F.length(x["heading"]) >= 2), lambda x: F.lower(x["heading"]), limit)


def design_facts(text: Column, limit: int = 8) -> Column:
    """array<struct<summary, hint>>: lines in a block under a heading, with a design marker or an arrow."""
    kind = "array<struct<summary:string,hint:string>>"

    def step(s: Column, raw: Column) -> Column:
        line = T.strip(raw)
        title = T.strip(F.regexp_replace(line, "^#+", ""))
        opens = line.startswith("#") | (~line.rlike("^[-*]") & title.rlike("(?iU)" + L.DESIGN_HEADING_RE) & ~line.rlike("[=:]"))
        marker = F.lower(F.regexp_extract(line, "(?iU)" + L.DESIGN_LINE_RE, 1))
        body = T.strip_item(F.regexp_extract(line, "(?iU)" + L.DESIGN_LINE_RE, 2))
        hint = F.when((marker == "decision") | F.lower(line).startswith("decision"), "decision").otherwise("design")
        fact = F.struct(T.fragment(F.when(marker != "", F.concat(marker, F.lit(": "), body)).otherwise(body)).alias("summary"), hint.alias("hint"))
        keep = (line != "") & ~opens & (F.length(body) >= 8) & (s["block"] | (marker != "") | F.contains(body, F.lit("->")))
        return F.struct(((line != "") & (opens | s["block"])).alias("block"), F.when(keep, F.concat(s["found"], F.array(fact))).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit(False).alias("block"), F.array().cast(kind).alias("found"))
    return T.first_distinct(F.aggregate(T.lines(text), start, step, lambda s: s["found"]), lambda x: F.lower(x["summary"]), limit)


def outcomes(text: Column, limit: int = 8) -> Column:
    found = F.transform(T.every(text, L.OUTCOME_RE), lambda x: T.label(T.fragment(x), 120))
    return T.first_distinct(_nonempty(found), limit=limit)


def checkboxes(text: Column) -> Column:
    """array<struct<item, state>>."""
    found = F.zip_with(T.every(text, L.CHECKBOX_RE, 1), T.every(text, L.CHECKBOX_RE, 2), lambda a, b: F.struct(T.clean_item(b).alias("item"), F.when(F.lower(a) == "x", "done").otherwise("open").alias("state")))
    return F.filter(found, lambda x: x["item"] != "")


def deferred_section(text: Column) -> Column:
    """Bullets under a heading of deferred work, up to the next heading of its level or above; a
    deferred heading inside takes over the level."""

    def step(s: Column, x: Column) -> Column:
        level = F.length(F.regexp_extract(x, "(?U)" + L.HEADING_RE, 1))
        starts = (level > 0) & F.regexp_extract(x, "(?U)" + L.HEADING_RE, 2).rlike("(?iU)" + L.DEFERRED_HEADING_RE)
        now = F.when(starts, level).when((level > 0) & (level <= s["level"]), 0).otherwise(s["level"])
        item = T.clean_item(F.regexp_extract(x, "(?U)" + L.BULLET_RE, 1))
        keep = ~starts & (now > 0) & (item != "")
        return F.struct(now.cast("int").alias("level"), F.when(keep, F.concat(s["found"], F.array(item))).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("level"), _no_strings().alias("found"))
    return F.aggregate(T.lines(text), start, step, lambda s: s["found"])


def quoted(text: Column, limit: int = 8) -> Column:
    """Quoted strings, then the single words of comma lists after "add"."""
    marked = F.transform(T.every(text, L.QUOTED_RE, 1), T.strip)
    pieces = F.flatten(F.transform(T.every(text, L.ADD_RE, 1), lambda x: F.split(x, ",")))
    pieces = F.filter(F.transform(pieces, lambda x: T.edges_off(x, "[ .]")), lambda x: (F.length(x) >= 2) & (F.length(x) <= 40) & (F.locate(" ", F.substring(x, 2, 80)) == 0))
    return T.first_distinct(F.filter(F.concat(marked, pieces), lambda x: (F.length(x) >= 2) & (F.length(x) <= 80)), limit=limit)


def open_items(text: Column, limit: int = 16) -> Column:
    """array<struct<item, state, family>> over eight families in order."""

    def family(xs: Column, name: str, state: str = "open") -> Column:
        return F.transform(xs, lambda x: F.struct(T.clean_item(x).alias("item"), F.lit(state).alias("state"), F.lit(name).alias("family")))

    def of_line(x: Column) -> Column:
        bullet = F.regexp_extract(x, "(?U)" + L.BULLET_RE, 1)
        deferred = x.rlike("(?iU)" + L.DEFERRED_HINT_RE) & ((bullet != "") | ~x.rlike(r"(?U)^#{1,6}\s+"))
        numbered = F.regexp_extract(x, "(?U)" + L.NUMBERED_RE, 1)
        one = F.when(deferred, F.array(F.when(bullet != "", bullet).otherwise(x))).otherwise(_no_strings())
        two = F.when((numbered != "") & x.rlike("(?iU)" + L.ACTION_RE), F.array(numbered)).otherwise(_no_strings())
        return F.concat(family(one, "hint", "deferred"), family(two, "numbered"))

    boxes = F.transform(F.filter(checkboxes(text), lambda x: x["state"] == "open"), lambda x: x["item"])
    hinted = F.coalesce(text, F.lit("")).rlike("(?iU)" + L.OPEN_HINT_RE)
    found = F.concat(
        family(boxes, "checkbox"),
        family(T.every(text, L.TODO_LINE_RE, 1), "todo"),
        family(T.every(text, L.NEXT_LINE_RE, 1), "next"),
        family(T.every(text, L.OPEN_LINE_RE, 1), "label"),
        family(deferred_section(text), "section", "deferred"),
        F.flatten(F.transform(T.lines(text), of_line)),
        family(F.when(hinted, quoted(text)).otherwise(_no_strings()), "quoted"),
    )
    return T.first_distinct(F.filter(found, lambda x: F.length(x["item"]) >= 2), lambda x: F.lower(x["item"]), limit)


def done_items(text: Column) -> Column:
    """array<struct<item, family>>: quoted completions, labelled lines, completion verbs, checked boxes."""

    def family(xs: Column, name: str) -> Column:
        return F.transform(xs, lambda x: F.struct(x.alias("item"), F.lit(name).alias("family")))

    one, two, three = (T.every(text, L.QUOTED_DONE_RE, g) for g in (1, 2, 3))
    marked = F.transform(F.zip_with(F.zip_with(one, two, lambda a, b: F.concat(a, b)), three, lambda a, b: F.concat(a, b)), T.strip)  # one group of a match holds text
    lines = F.transform(T.every(text, L.DONE_LINE_RE, 1), T.strip_item)
    verbs = F.filter(F.transform(T.every(text, L.DONE_VERB_RE, 1), lambda x: T.edges_off(T.strip(x), "[ .]")), lambda x: F.length(x) >= 2)
    boxes = F.transform(F.filter(checkboxes(text), lambda x: x["state"] == "done"), lambda x: x["item"])
    found = F.concat(family(marked, "quoted"), family(lines, "line"), family(verbs, "verb"), family(boxes, "checkbox"))
    return T.first_distinct(F.filter(found, lambda x: x["item"] != ""), lambda x: F.lower(x["item"]))


def topic_lines(text: Column) -> Column:
    return _nonempty(F.transform(T.every(text, L.TOPIC_LINE_RE, 1), T.strip_item))


def names(text: Column) -> Column:
    """array<struct<name, n>>: capitalised word groups and how often each occurs."""
    found = _nonempty(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(L.PROPER_RE), F.lit(1)), T.strip), 3)
    return T.let(found, lambda xs: F.transform(F.array_distinct(xs), lambda x: F.struct(x.alias("name"), F.size(F.filter(xs, lambda y: y == x)).alias("n"))))


def reference_terms(text: Column) -> Column:
    """Distinct paths, headings (fences included) and quoted strings of two characters or more."""
    heads = F.transform(T.every(text, L.HEADING_RE, 2), T.strip)
    marked = F.transform(T.every(text, L.QUOTED_RE, 1), T.strip)
    return F.array_distinct(_nonempty(F.concat(T.every(text, L.PATH_RE), heads, marked), 2))


def ranked_terms(text: Column) -> Column:
    """Candidate phrases and tokens of paths, headings, quotes and names: more words first, then
    longer, then in alphabetical order."""
    stop = F.array(*[F.lit(w) for w in L.STOP_WORDS])
    heads = T.every(text, L.HEADING_RE, 2)
    raw = F.concat(T.every(text, L.PATH_RE), heads, T.every(text, L.QUOTED_RE, 1), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(L.PROPER_RE), F.lit(1)))

    def of(x: Column) -> Column:
        phrase = T.edges_off(T.strip(x), "[\"']")
        whole = F.when((F.locate(" ", phrase) > 0) & (F.length(phrase) >= 2) & (F.length(phrase) <= 80), F.array(phrase)).otherwise(_no_strings())
        tokens = _nonempty(F.transform(F.split(x, r"(?U)[^\w./#-]+"), lambda w: T.edges_off(w, "[ .,;:]")), 2)
        return F.filter(F.concat(whole, tokens), lambda w: ~F.array_contains(stop, F.lower(w)))

    found = T.first_distinct(F.flatten(F.transform(raw, of)))
    keyed = F.transform(found, lambda x: F.struct((-F.size(F.split(T.strip(x), r"(?U)\s+"))).alias("w"), (-F.length(x)).alias("l"), F.lower(x).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def gist(text: Column, max_tokens: int = 32) -> Column:
    """The first distinct words of the ranked terms, stop words left out."""
    stop = F.array(*[F.lit(w) for w in L.STOP_WORDS])
    words = F.flatten(F.transform(ranked_terms(text), lambda x: F.split(x, r"(?U)\s+")))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, F.lower(w)))
    return F.array_join(T.first_distinct(kept, limit=max(max_tokens, 0)) if max_tokens > 0 else _no_strings(), " ")


def summary(text: Column) -> Column:
    return T.clip(F.regexp_replace(T.strip(F.coalesce(text, F.lit(""))), "\n", " "), 240)


def features(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """The struct that ``graph.ContextGraph.ingest`` reads."""
    plain = lambda xs, name: F.transform(xs, lambda x: x[name])
    return F.struct(
        summary(text).alias("summary"),
        F.when(F.coalesce(text, F.lit("")) != "", T.keyword_set(text)).alias("words"),
        sentences(text, config.identifiers).alias("sentences"),
        paths(text).alias("paths"),
        headings(text).alias("headings"),
        design_facts(text).alias("designs"),
        outcomes(text).alias("outcomes"),
        topic_lines(text).alias("topics"),
        names(text).alias("names"),
        plain(done_items(text), "item").alias("done"),
        F.transform(open_items(text), lambda x: F.struct(x["item"], x["state"])).alias("open"),
    )


def with_features(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(conv_id, turn, role, features) of each turn."""
    return turns.select("conv_id", "turn", "role", features(F.col("text"), config).alias("features"))
