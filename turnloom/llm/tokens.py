"""Token counts as the sentencepiece library gives them, for texts of any length.

Two facts about a model are proven when it is loaded, not assumed: its normaliser changes
nothing but blanks to U+2581, and no piece holds a non-blank before a blank. A merge can then
never cross the place where a blank follows a non-blank, so every such place is a *stable
boundary*: the tokens on either side are the same whatever stands on the other.

* A text beyond one chunk is encoded in chunks that overlap, with the library's offsets. Two
  neighbours are spliced at a stable boundary inside their overlap where both have a token border and
  the tokens around it agree. Where the overlap holds none, it is widened twofold and encoded anew.
* A text within one chunk has nothing to splice: it is counted unit by unit between stable
  boundaries, each distinct unit once a worker.

A model without the two facts is given whole texts. Defined cases: null and empty texts have no
tokens; special strings in texts are ordinary text, as the library's default is; repeated rows are
counted row by row; ties don't occur; columns other than the id and the text are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 8_192
OVERLAP = 256
MEMO = 1_000_000
DEFAULT_MODEL = "piece_bpe_32k.model"
LIMIT = 4096

_UNITS = re.compile("[ \u2581]+[^ \u2581]*")
_PLAIN = re.compile("[ \u2581][^ \u2581]+")


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class TokenCounter:
    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}
        self.widened = 0
        self._load()

    def _load(self) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(self.sp.serialized_model_proto())
        n = m.normalizer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
        own = any(p.type == p.USER_DEFINED for p in m.pieces)
        self.stable = bool(plain and not own and m.trainer_spec.byte_fallback and not any("\u2581" in p.piece.lstrip("\u2581") for p in m.pieces))
        # characters of a piece: a byte piece is one where it leads a character, none where it continues one
        self.chars = np.array([int(int(p.piece[3:5], 16) & 0xC0 != 0x80) if p.type == p.BYTE else len(p.piece) for p in m.pieces], np.int64)
        self.leads = np.array([p.piece.startswith("\u2581") for p in m.pieces], bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.sp.encode(text, return_type="numpy"), np.int64)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts of many texts; units that are new to the memo are encoded in one call."""
        if not self.stable:
            return [len(self.sp.encode(t)) if t else 0 for t in texts]
        units = [_UNITS.findall(" " + t) if t and len(t) <= self.chunk else None for t in texts]
        new = set().union(*[u for u in units if u]) - self.memo.keys() if any(units) else set()
        if new:
            if len(self.memo) + len(new) > MEMO:  # memory stays bounded; the rows at hand are looked up from scratch
                self.memo = {}
                new = set().union(*[u for u in units if u])
            self._learn(list(new))
        look = self.memo.__getitem__
        return [sum(map(look, u)) if u is not None else self.count_huge(t) if t else 0 for t, u in zip(texts, units, strict=True)]

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def _learn(self, units: list[str]) -> None:
        plain = [u for u in units if _PLAIN.fullmatch(u)]
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            # the library puts one blank before the text; each plain unit has one piece that leads it
            at = np.flatnonzero(self.leads[ids := self._ids("".join(part)[1:])])
            self.memo.update(zip(part, np.diff(np.append(at, len(ids))).tolist(), strict=True))
        for u in units:
            if u not in self.memo:
                self.memo[u] = len(self.sp.encode(u[1:])) if len(u) > 1 else 1

    def count_huge(self, text: str) -> int:
        """Encode overlapping chunks and splice neighbours where both confirm a stable boundary."""
        total, start, n = 0, 0, len(text)
        end = min(n, self.chunk + self.overlap)
        left = self._borders(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(start + 1, end - overlap)
                stop = min(n, begin + self.chunk + overlap)
                right = self._borders(text, begin, stop)
                at = self._splice(text, left, right, begin, end)
                if at is not None:
                    break
                self.widened += 1
                overlap *= 2
                if end - overlap <= start:  # the overlap fills the left chunk, which therefore grows
                    end = min(n, end + overlap)
                    left = self._borders(text, start, end)
                    if end == n:
                        return total + self._between(left, start, n)
            total += self._between(left, start, at)
            start, end, left = at, stop, right
        return total + self._between(left, start, n)

    def _borders(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where the tokens of text[begin:end] begin, as places in the whole text."""
        skip = 1 if begin and text[begin] in " \u2581" else 0  # the library's own blank stands for it
        ids = self._ids(text[begin + skip : end])
        size = self.chars[ids]
        # every text gets one blank in front, which is no character of it
        return np.maximum(np.cumsum(size) - size - 1 + begin + skip, begin if begin else -1)

    @staticmethod
    def _between(borders: np.ndarray, begin: int, end: int) -> int:
        low = -1 if begin == 0 else begin
        return int(np.searchsorted(borders, end, "left") - np.searchsorted(borders, low, "left"))

    @staticmethod
    def _splice(text: str, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> int | None:
        """The last stable boundary in the overlap that is a border of both encodings, if these
        agree on every border between it and the first such place."""
        inner = left[np.searchsorted(left, begin, "right") :], right[: np.searchsorted(right, end, "left")]
        common = sorted(set(inner[0].tolist()) & set(inner[1].tolist()) - {begin, end})
        blank = " \u2581"
        stable = [i for i in common if text[i] in blank and text[i - 1] not in blank]
        if len(stable) < 2:
            return None
        a, b = stable[0], stable[-1]
        same = np.array_equal(left[(left >= a) & (left < b)], right[(right >= a) & (right < b)])
        return b if same else None


@functools.cache
def counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def token_counts(docs: DataFrame, model_file: str | None = None, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; one pass, no shuffle."""
    path = model_file or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), []
            for a in range(0, len(texts), 500):
                n += c.counts(texts[a : a + 500])
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
