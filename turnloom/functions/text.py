"""Scalar text functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def estimate_tokens(x: Column) -> Column:
    """Four characters a token, one at least; nothing for an empty or null text."""
    n = F.length(F.coalesce(x, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor((n + 3) / 4)).cast("long")


def ws_tokens(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def line_hash(x: Column) -> Column:
    return F.substring(F.sha1(F.lower(strip(x)).cast("binary")), 1, 16)


def keyword_set(x: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z0-9_./#-]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays: 1 for two empty ones, 0 where only one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def _replaced(needs: str, pattern: str, to: str):
    return lambda y: F.when(y.rlike(needs), F.regexp_replace(y, pattern, to)).otherwise(y)


def redact(x: Column) -> Column:
    """Addresses, keys, credentials and home folders replaced, blanks squeezed. A pattern is tried only
    where a character stands without which it can't match."""
    rules = ((L.EMAIL_RE, "<EMAIL>", "@"), (L.KEY_RE, "<KEY>", None), (L.CREDENTIAL_RE, "<CREDENTIAL>", "[:=]"), (L.HOME_RE, "<HOME>", "/"), (r"[ \t]{2,}", " ", None))
    for pattern, to, needs in rules:
        if needs is None:
            x = F.regexp_replace(x, pattern, to)
        else:
            x = let(x, _replaced(needs, pattern, to))  # worked out once, looked at twice
    return strip(x)


def squash(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def label(x: Column, width: int = 96) -> Column:
    """One line of at most ``width`` characters, cut at a blank where that keeps half of it."""
    x = squash(F.coalesce(x, F.lit("")))
    cut = F.rtrim(F.substring(x, 1, width - 3))
    blank = F.length(cut) - F.locate(" ", F.reverse(cut))
    head = F.when((F.locate(" ", cut) > 0) & (blank >= width // 2), F.substring(cut, F.lit(1), blank.cast("int"))).otherwise(cut)
    return F.when(F.length(x) <= width, x).otherwise(F.concat(F.regexp_replace(head, r"[ ,;:-]+$", ""), F.lit("...")))


def edges_off(x: Column, chars: str) -> Column:
    """``chars`` (a character class) taken off both ends."""
    return F.regexp_replace(x, f"^{chars}+|{chars}+$", "")


def strip_item(x: Column) -> Column:
    return edges_off(strip(x), L.ITEM_EDGE)


def clean_item(x: Column, width: int = 80) -> Column:
    """An item's label: no stars and backticks, single blanks, ``width`` characters at most."""
    return edges_off(clip(F.regexp_replace(strip(F.regexp_replace(x, "[*`]+", "")), r"(?U)\s+", " "), width), "[ .]")


def fragment(x: Column, width: int = 140) -> Column:
    """The first sentence or line, without list marks and quotes around it."""

    def first(y: Column) -> Column:
        return F.split(F.split(y, "\n")[0], r"\. ")[0]

    return label(first(edges_off(squash(first(strip(x))), r"[-*\[\]() \t`\"']")), width)


def lines(x: Column) -> Column:
    """Lines as any line end cuts them."""
    return F.split(F.coalesce(x, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def every(x: Column, pattern: str, group: int = 0) -> Column:
    """All matches, case-insensitive, by Unicode classes, ^ and $ at line feeds."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?imUd)" + pattern), F.lit(group))


def let(x: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def first_distinct(xs: Column, key=F.lower, limit: int | None = None) -> Column:
    """The first of the elements that share a key, in order: sorted by key and place, then by place."""
    placed = F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    heads = let(placed, lambda s: F.filter(s, lambda y, j: (j == 0) | (y["k"] != F.get(s, j - 1)["k"])))
    kept = F.transform(F.array_sort(F.transform(heads, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])
    return kept if limit is None else F.slice(kept, 1, limit)


def query_terms(x: Column) -> Column:
    """Words of three characters or more, cut at slashes, hyphens and dots too."""
    words = F.split(F.lower(F.translate(F.coalesce(x, F.lit("")), "/-.", "   ")), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def alnum_set(x: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def clip(x: Column, width: int) -> Column:
    return F.when(F.length(x) <= width, x).otherwise(F.concat(F.substring(x, 1, width - 3), F.lit("...")))


def sentences(x: Column) -> Column:
    return F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+")


def cue_score(sentence: Column, identifiers: tuple[str, ...] = ()) -> Column:
    """Points for decisions, trade-offs, numbers, names and definitions; less for small talk."""

    def on(pattern: str, points: float) -> Column:
        return F.when(sentence.rlike("(?i)" + pattern), F.lit(points)).otherwise(F.lit(0.0))

    names = F.least(F.size(F.regexp_extract_all(sentence, F.lit("(?i)" + L.identifier_re(identifiers)), F.lit(0))), F.lit(4))
    return on(L.DECISION_RE, 3.0) + on(L.TRADEOFF_RE, 1.5) + on(L.NUMERIC_RE, 1.0) + names * 1.5 + on(L.DEFINE_RE, 2.0) + on(L.PREAMBLE_RE, -3.0)


ECHO, ECHO_POINTS = 0.6, 4.0


def fact_score(sentence: Column, prior_words: Column, identifiers: tuple[str, ...] = ()) -> Column:
    """``cue_score``, less what a sentence loses that repeats the keywords of the last user turn
    (null: there is none)."""
    echo = F.coalesce(jaccard(keyword_set(sentence), prior_words) >= ECHO, F.lit(False))
    return cue_score(sentence, identifiers) - F.when(echo, F.lit(ECHO_POINTS)).otherwise(F.lit(0.0))


def is_preamble(x: Column) -> Column:
    """Whether a line, its kind prefix aside, starts like small talk."""
    plain = F.lower(strip(F.coalesce(x, F.lit(""))))
    head = F.substring(strip(F.regexp_replace(F.regexp_replace(plain, "(?i)" + L.HOT_KIND_RE, ""), "^[: ]+", "")), 1, 40)
    return (plain != "") & F.exists(F.array(*[F.lit(p) for p in L.PREAMBLE_STARTS]), lambda p: F.startswith(head, p))
