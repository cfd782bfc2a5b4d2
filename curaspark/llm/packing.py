"""Packing token sequences with exact complements.

The number of pieces of each length is all the plan needs: at most `capacity` counts, whatever the corpus. The plan
takes the longest length left and looks its gap up in the index of single lengths, then of sums of two, then of
three; what fills the gap exactly is taken as often as the counts allow. Where nothing does, the largest length that
fits goes in and the smaller gap is looked up again. The plan's slots are ranges of ranks, so pieces find their
sequence by their rank among the pieces of their length, which is counted within the tasks that cut them.

Defined results: a null or empty text is the end-of-text id alone; rows that repeat are packed each; a null doc_id
stays null; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import Store, tidied

CAPACITY = 2048


#: What the tokenizer splits lower-cased text by, for the characters of _PLAIN.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+").findall
#: Stretches of printable ASCII and precomposed Latin letters: composed already and lower-cased letter by letter.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next past 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Recent(dict):
    """A bounded memo of two generations: what was used since the last turn survives the next one."""

    def __init__(self, limit: int):
        self.limit, self.before = limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        if found is None:
            found = self.made(key)
        if len(key) < 64:
            self[key] = found
        return found


class _PartIds(_Recent):
    """Ids of one part of the tokenizer's own split, straight from its merges."""

    def __init__(self, tokenizer, limit: int):
        super().__init__(limit)
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()

    def made(self, part: str) -> bytes:
        form = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        found = self.tokenize(form)
        return pack(f"<{len(found)}I", *[t.id for t in found])


class _WordIds(_Recent):
    """Ids of a white-space-free stretch as little-endian bytes; the tokenizer treats such stretches one by one.

    Plain stretches are split here and only their parts go to the tokenizer's merges; any other goes through it whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(limit)
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parts = tokenizer.encode, _PartIds(tokenizer, limit // 2)

    def made(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN(text) and "<|" not in text:
            return b"".join([self.parts[p] for p in _PARTS(text.lower())])
        return pack(f"<{len(ids := self.encode(text, add_special_tokens=False).ids)}I", *ids)


def token_bytes(words: _WordIds, text: str | None) -> bytes:
    """A document's ids and a closing id 0, four bytes each."""
    return b"".join(map(words.__getitem__, (text or "").encode().split())) + b"\0\0\0\0"


def _cut(tokenizer: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, used, part = _WordIds(tokenizer), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            out = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_bytes(words, text)
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    length = len(own) // 4
                    for col, value in zip(out, (doc_id, piece, a // 4, length, zlib.crc32(own), part, used[length]), strict=True):
                        col.append(value)
                    used[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


class _Index:
    """Which gaps the lengths left can fill exactly, with one, two or three of them."""

    def __init__(self, left: np.ndarray):
        self.left, self.stale = left, True

    def _sums(self) -> np.ndarray:
        if self.stale:
            here = (self.left > 0).astype(np.float64)
            self.pairs, self.stale = np.rint(np.convolve(here, here))[: len(here)] > 0, False
        return self.pairs

    def _pair(self, gap: int, spare: np.ndarray) -> list[int] | None:
        low = np.arange(1, gap // 2 + 1)
        good = np.flatnonzero((spare[low] > 0) & (spare[gap - low] > (gap == 2 * low)))
        return [gap - int(low[good[0]]), int(low[good[0]])] if len(good) else None

    def fill(self, gap: int, spare: np.ndarray) -> list[int] | None:
        """Lengths that sum to `gap` and that `spare` has; the largest first length wins."""
        if spare[gap] > 0:
            return [gap]
        if pair := self._pair(gap, spare):
            return pair
        sums = self._sums()
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if spare[a] > 0 and sums[gap - a]:
                spare[a] -= 1
                pair = self._pair(gap - a, spare)
                spare[a] += 1
                if pair:
                    return [a, *pair]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with how many sequences follow it; uses every piece counted once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index, found = _Index(left), []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return found
        pattern, spare = [top], left.copy()
        spare[top] -= 1
        gap = capacity - top
        while gap:
            if rest := index.fill(gap, spare):
                pattern += rest
                break
            fits = np.flatnonzero(spare[1 : gap + 1])
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            pattern.append(best)
            spare[best] -= 1
            gap -= best
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        index.stale |= bool((left[lengths] == 0).any())
        found.append((pattern, times))


def _slots(patterns: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each slot of each pattern: length and first rank as one key, its first sequence, its place there."""
    taken, base, rows = [0] * (capacity + 1), 0, []
    for pattern, times in patterns:
        place = 0
        for length in pattern:
            rows.append((length << 48 | taken[length], base, place))
            taken[length] += times
            place += length
        base += times
    rows.sort()
    key, base_of, place = np.array(rows, np.int64).reshape(-1, 3).T.copy()
    return key, base_of, place


def _placed(slots: tuple[np.ndarray, ...]):
    key, base, place = slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (batch.column(3).to_numpy() << 48) | batch.column(5).to_numpy()
            at = np.searchsorted(key, own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[at] + (own - key[at])), pa.array(place[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    store = Store(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = store.save(texts.mapInArrow(tidied(_cut(tokenizer, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    sizes = store.save(pieces.groupBy("part", "length").count(), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    patterns = plan(counts, capacity)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    ranked = pieces.join(sizes.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(_placed(_slots(patterns, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
