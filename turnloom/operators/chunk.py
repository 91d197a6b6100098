"""Texts into chunks that keep fences, headings, signatures and paths whole.

A turn's chunks are rows by ``chunks_of`` (an Arrow pass); the fold cuts its window text the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import DEFAULT, EngineConfig
from ..functions import lexicon as L

_FENCE = re.compile(L.FENCE_RE)
_PATH = re.compile(L.PATH_RE, re.I)
_HEADING = re.compile(r"^#{1,6}\s+", re.M)
_SIGNATURE = re.compile(r"^(?:async\s+def|def|class)\s+\S[^\n]*", re.M)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_HELD = re.compile("\ue000([FP])(\\d+)\ue001")  # private-use characters around a held piece's number


def words(text: str) -> int:
    return len(text.split())


def whole_fence(text: str) -> bool:
    n = text.count("```")
    return text.startswith("```") and text.endswith("```") and n >= 2 and n % 2 == 0


class _Held:
    """Pieces that no cut may enter, taken out of the text and put back at the end."""

    def __init__(self) -> None:
        self.kept: dict[str, list[str]] = {"F": [], "P": []}

    def take(self, pattern: re.Pattern, kind: str, around: str, text: str) -> str:
        def put(m: re.Match) -> str:
            self.kept[kind].append(m[0].strip())
            return f"{around}\ue000{kind}{len(self.kept[kind]) - 1}\ue001{around}"

        return pattern.sub(put, text)

    def back(self, text: str) -> str:
        return _HELD.sub(lambda m: self.kept[m[1]][int(m[2])] if int(m[2]) < len(self.kept[m[1]]) else m[0], text)


def _units(section: str) -> Iterator[str]:
    """Signatures as they are, the rest by sentence and line."""
    at = 0
    for m in [*_SIGNATURE.finditer(section), None]:
        end = m.start() if m else len(section)
        yield from (p for p in map(str.strip, _SENTENCE.split(section[at:end].strip())) if p)
        if m:
            yield m[0].strip()
            at = m.end()


def merge(units: list[str], config: EngineConfig = DEFAULT) -> list[str]:
    """Neighbours joined up to the target; long units and fences stay alone."""
    out, held = [], ""
    for unit in units:
        n = words(unit)
        if n >= config.chunk_min or whole_fence(unit.strip()):
            out += [held] * bool(held) + [unit]
            held = ""
        elif held and words(held) + n > config.chunk_max:
            out.append(held)
            held = unit
        else:
            held = f"{held} {unit}".strip()
            if words(held) >= config.chunk_target:
                out.append(held)
                held = ""
    return [x.strip() for x in out + [held] * bool(held)]


def spread(n: int, k: int) -> list[int]:
    """``k`` places spread evenly over 0 .. n - 1, halves to the even one."""
    return sorted({round(i * ((n - 1) / (k - 1))) for i in range(k)}) if k > 1 else [0]


def chunk_text(text: str | None, most: int, config: EngineConfig = DEFAULT) -> list[str]:
    """Headings first, then the bodies in chunks; beyond ``most`` an even choice of these, with a
    fence among them if there is any."""
    raw = text or ""
    if not raw.strip():
        return [""]
    held = _Held()
    plain = held.take(_PATH, "P", " ", held.take(_FENCE, "F", "\n\n", raw))
    starts = [m.start() for m in _HEADING.finditer(plain)]
    sections = [s.strip() for s in (plain[a:b] for a, b in zip([0, *starts], [*starts, len(plain)])) if s.strip()]
    heads, body = [], []
    for section in sections:
        first, *rest = section.splitlines()
        if _HEADING.match(first):
            heads.append(first.strip())
            section = "\n".join(rest).strip()
        body += _units(section)
    heads = [h for h in (held.back(x).strip() for x in heads) if h]
    pool = [c for c in merge([held.back(x) for x in body], config) if c]
    if not heads and not pool:
        return [raw.strip()]
    if len(heads) + len(pool) <= most:
        return heads + pool
    fences = [c for c in pool if whole_fence(c)]
    out, left = heads[:most], most - len(heads)
    if left <= 0:
        return out[: most - 1] + fences[:1] if fences and most else out
    if left == 1:
        return out + (fences or pool)[:1]
    out += [pool[i] for i in (spread(len(pool), left) if len(pool) > left else range(len(pool)))]
    if fences and not any(map(whole_fence, out)):
        out[-1] = fences[0]
    return out[:most]


def chunks_of(turns: DataFrame, most: int = DEFAULT.chunks_per_turn, config: EngineConfig = DEFAULT) -> DataFrame:
    """(conv_id, turn, row, text): the chunks of each turn's text; blank ones have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, k, x) for c, t, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for k, x in enumerate(chunk_text(text, most, config)) if x.strip()]
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "turn", "row", "text"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.selectExpr("conv_id", "CAST(turn AS BIGINT) AS turn", "text").mapInArrow(run, f"conv_id {kind}, turn long, row int, text string")
