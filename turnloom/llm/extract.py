"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by its link
density, its length and the density of stop words, and by the kind of element it stands in; it
leaves short blocks undecided. The second pass gives each undecided block the label of its
nearest decided neighbour inside the same region (the article, or what is outside of it).

Defined cases: null and empty html give an empty text; unclosed, misnested and unknown tags are
accepted; an unclosed comment, script or tag runs to the page's end; character references are decoded
once; all that Unicode or Python calls white space within a block (no-break spaces and the separators
U+001C to U+001F too) becomes one blank; repeated pages and ids are read row by row; ties between two
decided neighbours go to the good one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose content is never read. RAW ones run to the page's end if nothing ends them, as
# browsers have it; of the others an end tag must follow, or they are ordinary blocks.
RAW = frozenset("script style textarea title iframe noscript".split())
SKIPPED = frozenset("template svg math object canvas audio video select button".split())
# What a tag holds after its name: quotes count only behind an equals sign, a lone one is an ordinary character.
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold no main text.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|footer|foot|sidebar|side|aside|ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?"
    r"|alert|warning|disclaimer|copyright|legal|comments?|commentlist|disqus|replies|respond|share|sharing|social|breadcrumbs?|related|recommend\w*|popup|modal|overlay|newsletter"
    r"|subscribe|subscription|signup|login|search|widget|pagination|pager|toolbar|masthead|topbar|skip|tags?|toc|contentinfo|complementary|dialog|form|header|tracking|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
# Names that are as often given to parts of an article: a long block of prose outvotes them.
WEAK_NAME = re.compile(r"^(?:form|side|foot|header|legal|notice|tags?|toc|widget|skip|search|share|alert|warning|disclaimer|copyright)$", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article(?:body|-?content|-?text)?|main|main-?content|post-?(?:content|body|text)|entry-?(?:content|body)|story(?:-?body)?|content-?body)(?:$|[\s_-])", re.I)

_OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|promo|advert\w*)(?:$|[\s_-])", re.I)

STOP_WORDS = frozenset(
    (
        "the of and to in a is that it for on was as with be by at from are this or an not but have had his her they which you were their has will would there been if more when who "
        "le la les de des du un une et en que qui dans pour par sur au aux est pas avec ne se ce il elle sont plus ou mais comme leur son sa ses nous vous "
        "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
        "el los las y del por con una su para como al lo más pero sus este ya o porque cuando muy sin sobre también me hasta hay donde quien desde todo"
    ).split()
)
_WORD = re.compile(r"[^\W\d_]+")


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


@dataclass(frozen=True)
class BlockRules:
    """Thresholds: characters for lengths, shares for densities."""

    max_link_density: float = 0.33
    length_low: int = 70
    length_high: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.25


@dataclass
class Block:
    text: str
    link_chars: int
    region: int  # 0: outside of any main region, else the number of the region
    boiler: bool
    weak: bool = False  # boilerplate by a weak name only

    def label(self, r: BlockRules) -> str:
        """good, bad, or short: undecided until the second pass."""
        n = len(self.text)
        if self.boiler and self.weak and self.region and n >= r.length_high and not self.link_chars and stop_density(self.text) >= r.stop_low:
            return "good"
        if self.boiler or self.link_chars > r.max_link_density * n:
            return "bad"
        if self.region:
            return "good" if n >= r.length_low else "short"
        if n < r.length_low:
            return "bad" if self.link_chars else "short"
        density = stop_density(self.text)
        if density >= r.stop_high or density >= r.stop_low and n >= r.length_high:
            return "good"
        return "short" if density >= r.stop_low else "bad"


def _names(attr: str) -> tuple[str, bool]:
    names, hidden = [], False
    for m in _ATTR.finditer(attr):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            names.append(value)
    return " ".join(names), hidden


def _tokens(page: str) -> Iterator[tuple[str, re.Match | None, bool]]:
    """(text before, tag, whether an unread element stood there) of each piece of markup; comments and
    unread elements come as no tag. Linear: the end of an element that has none is looked for once."""
    low = page.lower()
    if len(low) != len(page):  # a few characters grow when lower-cased
        low = "".join(c.lower() if c.isascii() else c for c in page)
    endless: set[str] = set()
    at = 0
    while (m := _MARKUP.search(page, at)) is not None:
        before, at = page[at : m.start()], m.end()
        tag = (m["tag"] or "").lower()
        if tag in RAW or tag in SKIPPED and tag not in endless:
            if m["end"]:
                yield before, m, False
                continue
            if tag in ("svg", "math") and m["attr"].endswith("/"):
                yield before, None, True
                continue
            stop = re.compile(rf"</{tag}(?![a-z0-9:_-])[^>]*(?:>|\Z)").search(low, at)
            if stop is None and tag in SKIPPED:
                endless.add(tag)
                yield before, m, False
                continue
            at = stop.end() if stop else len(page)
            yield before, None, True
            continue
        yield before, m if tag else None, False
    if at < len(page):
        yield page[at:], None, False


def blocks(page: str) -> list[Block]:
    """The page's blocks in their order; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # open containers: tag, boiler, region, boiler by weak names only
    parts: list[str] = []
    opened: Counter[str] = Counter()  # how often each tag stands in the stack
    links = anchor = regions = 0
    boiler, region, weak = False, 0, False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(links, len(text)), region, boiler, weak))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        parts.append(raw)
        if anchor:
            links += len(" ".join(_html.unescape(raw).split()))

    for before, m, gap in _tokens(page):
        if before:
            add(before)
        if m is None:
            if gap:
                parts.append(" ")
            continue
        tag, end, attr = m["tag"].lower(), bool(m["end"]), m["attr"].strip()
        if tag == "a":
            anchor = 0 if end else 1
        if tag in INLINE:
            if tag == "br" or tag == "img":
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        anchor = 0
        if end:
            while opened[tag]:  # everything inside ends with it
                top = stack.pop()
                opened[top[0]] -= 1
                if top[0] == tag:
                    break
        elif tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "html", "body", "head") or attr:
            names, hidden = _names(attr) if attr else ("", False)
            top = stack[-1] if stack else ("", False, 0, True)
            main = tag in ("article", "main") or bool(names and MAIN_NAME.search(names)) and tag in ("div", "section", "td")
            if tag == "article" and _OTHER_ARTICLE.search(names):
                main, hidden = False, True
            by_name = bool(names and tag not in ("body", "html", "article", "main") and not main and BOILER_NAME.search(names))
            certain = hidden or tag in BOILER_TAGS or tag == "header" and not top[2]
            bad = certain or by_name
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and not bad:
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1  # these close themselves
                top = stack[-1] if stack else ("", False, 0, True)
            if main and not top[2]:
                regions += 1
            mild = not certain and all(WEAK_NAME.match(x) or not BOILER_NAME.search(x) for x in re.split(r"[\s_-]+", names))
            stack.append((tag, top[1] or bad, top[2] or (regions if main else 0), (top[3] or not top[1]) and mild))
            opened[tag] += 1
        elif stack and stack[-1][0] == tag:
            opened[stack.pop()[0]] -= 1
        boiler, region, weak = (stack[-1][1:]) if stack else (False, 0, False)
    flush()
    return out


def classify(found: list[Block], rules: BlockRules = BlockRules()) -> list[bool]:
    """First pass by rules, second pass by the nearest decided neighbour of the same region."""
    first = [b.label(rules) for b in found]
    decided = {}
    for i, b in enumerate(found):
        if first[i] != "short" and not (b.boiler and b.region):
            decided.setdefault(b.region, []).append(i)
    if any(b.region and not b.boiler for b in found):
        # a page with a marked main region has its main text there
        first = ["bad" if not b.region and x == "short" else x for b, x in zip(found, first, strict=True)]
    keep = []
    lone = not any(b.region for b in found)  # a page without a region or a decided block is its short blocks
    for i, b in enumerate(found):
        if first[i] != "short":
            keep.append(first[i] == "good")
            continue
        near = decided.get(b.region, [])
        at = bisect.bisect(near, i)
        both = sorted(near[max(0, at - 1) : at + 1], key=lambda k: (abs(k - i), first[k] != "good"))
        keep.append(first[both[0]] == "good" if both else bool(b.region) or lone)
    if any(k and b.region for k, b in zip(keep, found, strict=True)):
        keep = [k and bool(b.region) for k, b in zip(keep, found, strict=True)]
    return keep


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, k in zip(found, classify(found, rules), strict=True) if k)


def extract_pages(pages: DataFrame, rules: BlockRules = BlockRules(), html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(x, rules) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", html).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
