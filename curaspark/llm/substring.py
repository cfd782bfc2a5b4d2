"""Exact substring deduplication with fixed-block anchors.

A window is `window` consecutive words. A word goes if some window that covers it has a word sequence that also
starts in a document with a smaller doc_id. Every window of W words holds a whole aligned block of (W + 1) // 2
words, so:

1. each text gives its non-overlapping blocks as an index and every rolling window of block length as a probe; both
   meet by hash in buckets. A position is a hit if its words are a block of another document.
2. hits are extended: every full window around a hit is keyed by 96 bits of its words, all equal windows of the
   corpus meet in a bucket, and those whose key starts in a smaller doc_id are marked. Runs of marked windows are the
   maximal exact repeats, without ever comparing documents by pairs.
3. words under marked windows are cut.

Memory: a worker holds one chunk or one bucket, sorts a chunk bucket by bucket, and opens texts and entries a few at a
time, whatever the engine puts in a batch.

Hot passages: a task resolves what its own chunk of texts shares (about `chunk_words` words) and sends one entry a
key, so a passage in a third of all documents costs a bucket one entry a chunk, not one a document. Buckets are sized
by the bytes of all texts, dealt to as many tasks as they need and handled one at a time.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows without a doc_id
neither lose words nor take any; rows that repeat a doc_id do not affect each other. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from curaspark.llm.common import Store, mix64, planes, tidied, unplanes, word_hashes

CHUNK_WORDS = 2_000_000
BUCKET_WORDS, WORD_BYTES = 1_000_000, 6
#: A task resolves about so many buckets, unless the session deals shuffles to more tasks.
TASK_BUCKETS = 4
#: Rows of a batch that are opened at a time: texts, and entries of buckets; entries leave in batches of about so many bytes.
TEXT_ROWS, ENTRY_ROWS, ENTRY_BYTES = 256, 16, 4 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Rolling:
    """Hashes of all windows of a word-hash array in constant time a window (polynomials modulo 2^64)."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = self._powers(base, 1024), self._powers(self.inverse, 1024)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, h: np.ndarray, width: int) -> np.ndarray:
        if len(h) > len(self.up):
            size = 2 * len(h)
            self.up, self.down = self._powers(self.base, size), self._powers(self.inverse, size)
        n = len(h) - width + 1
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=sums[1:])
        return mix64((sums[width:] - sums[:n]) * self.down[:n])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _some(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices, which share its memory: Python values of all its rows would take a multiple of it."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _slices(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(sorted_values)].astype(np.int64)[: len(starts)]


def _by_owner(owner: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, their counts, and positions as steps within an owner; rows come sorted by owner and position."""
    a, b = _slices(owner)
    step = np.diff(pos, prepend=0).astype(np.int64)
    step[a] = pos[a]
    return owner[a], b - a, step.astype(np.uint32)


def _positions(count: np.ndarray, step: np.ndarray) -> np.ndarray:
    total = np.cumsum(step.astype(np.int64))
    ends = np.cumsum(count)
    before = np.r_[0, total[ends[:-1] - 1]] if len(count) else np.zeros(0, np.int64)
    return total - np.repeat(before, count)


_ENTRY = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary()), ("key", pa.binary()), ("key2", pa.binary())])
_ENTRY_DDL = "p int, kind int, docs binary, tags binary, counts binary, steps binary, key binary, key2 binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.binary())])
_FOUND_DDL = "doc_id long, tag long, at binary"
_ASK, _INDEX, _LOCAL = 0, 1, 2


def _entry(p: int, kind: int, docs: np.ndarray, tags: np.ndarray, owner: np.ndarray, pos: np.ndarray, key: np.ndarray, key2: np.ndarray) -> tuple:
    own, count, step = _by_owner(owner, pos)
    return p, kind, planes(np.diff(docs[own], prepend=0)), planes(tags[own]), planes(count.astype(np.uint32)), planes(step), planes(key), planes(key2)


class _Chunk:
    """Texts of one task, up to a number of words; flushes to entries for the buckets."""

    def __init__(self, limit: int, buckets: int, make):
        self.limit, self.bits, self.make = limit, max(1, buckets.bit_length() - 1), make
        self.clear()

    def clear(self) -> None:
        self.docs, self.tags, self.words, self.parts = [], [], 0, []

    def add(self, doc_id: int, tag: int, words: int, *arrays: np.ndarray) -> bool:
        self.docs.append(doc_id)
        self.tags.append(tag)
        self.parts.append(arrays)
        self.words += words
        return self.words >= self.limit

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        order = np.argsort(np.array(self.docs, np.int64), kind="stable")
        docs, tags = np.array(self.docs, np.int64)[order], np.array(self.tags, np.int64)[order]
        parts = [self.parts[i] for i in order]
        self.clear()
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x[0]) for x in parts])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        rows, size = [], 0
        for row in self.make(docs, tags, owner, columns, self.bits):
            rows.append(row)
            size += sum(map(len, row[2:]))
            if len(rows) >= 256 or size >= ENTRY_BYTES:
                yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r, strict=True)) for r in rows], schema=_ENTRY)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r, strict=True)) for r in rows], schema=_ENTRY)


def _dealt(key: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in order; equal keys share a bucket."""
    where = (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(where, kind="stable")
    where = where[order]
    for a, b in zip(*_slices(where), strict=True):
        yield int(where[a]), order[a:b]


def _runs(key: np.ndarray, key2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the starts of their runs in it."""
    order = np.argsort(key)
    k = key[order]
    new = k[1:] != k[:-1]
    if key2 is not None:
        other = key2[order]
        if np.any(~new & (other[1:] != other[:-1])):
            order = np.lexsort((key2, key))
            k, other = key[order], key2[order]
            new = (k[1:] != k[:-1]) | (other[1:] != other[:-1])
    return order, np.flatnonzero(np.r_[True, new]) if len(key) else np.zeros(0, np.int64)


def _probing(block: int):
    def make(docs, tags, owner, columns, bits) -> Iterator[tuple]:
        gram, pos = columns
        shared = np.zeros(len(gram), bool)
        for p, i in _dealt(gram, bits):
            order, starts = _runs(gram[i])
            d = docs[owner[i[order]]]
            many = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
            here = np.repeat(many, np.diff(np.r_[starts, len(order)]))
            shared[i[order[here]]] = True
            firsts = np.zeros(0, np.int64)
            if many.any():
                aligned = np.logical_or.reduceat((pos[i[order]] % block) == 0, starts) & many
                firsts = np.sort(i[order[starts[aligned]]])
            for kind, j in ((_ASK, i[~shared[i]]), (_INDEX, firsts)):
                if len(j):
                    rest = ((gram[j] >> np.uint64(64 - bits - 24)) & np.uint64(0xFFFFFF)).astype(np.uint32)
                    yield _entry(p, kind, docs, tags, owner[j], pos[j], rest, np.zeros(len(j), np.uint8))
        yield from _locals(bits, docs, tags, owner, pos, np.flatnonzero(shared))

    return make


def _locals(bits: int, docs, tags, owner, pos, i) -> Iterator[tuple]:
    """What the chunk has resolved itself rides to any bucket, in pieces."""
    for n, a in enumerate(range(0, len(i), 1 << 14)):
        j = i[a : a + (1 << 14)]
        none = np.zeros(0, np.uint8)
        yield _entry((int(docs[owner[j[0]]]) * 31 + n * 7919) % (1 << bits), _LOCAL, docs, tags, owner[j], pos[j], none, none)


def _extending(docs, tags, owner, columns, bits) -> Iterator[tuple]:
    key, key2, pos = columns
    late = np.zeros(len(key), bool)
    for p, i in _dealt(key, bits):
        doc = docs[owner[i]]
        order, starts = _runs(key[i], key2[i])
        least = np.empty(len(i), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.r_[starts, len(order)]))
        late[i] = doc > least
        j = i[doc == least]
        yield _entry(p, _ASK, docs, tags, owner[j], pos[j], key[j], key2[j])
    yield from _locals(bits, docs, tags, owner, pos, np.flatnonzero(late))


def _probe(window: int, block: int, chunk_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, chunk = _Rolling(_BASES[0]), _Chunk(chunk_words, buckets, _probing(block))
        for some in (x for batch in batches for x in _some(batch, TEXT_ROWS)):
            for doc_id, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                words = _words(text)
                if len(words) >= window:
                    gram = rolling(word_hashes(words), block)
                    if chunk.add(doc_id, 0, len(words), gram, np.arange(len(gram), dtype=np.uint32)):
                        yield from chunk.flush()
        yield from chunk.flush()

    return run


def _merged(found: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([unplanes(x, np.uint32) for x in found]))


def _extend(window: int, block: int, chunk_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, chunk = _Rolling(_BASES[0]), _Rolling(_BASES[1]), _Chunk(chunk_words, buckets, _extending)
        for some in (x for batch in batches for x in _some(batch, TEXT_ROWS)):
            for doc_id, text, tag, found in zip(*(c.to_pylist() for c in some.columns[1:]), strict=True):
                words = _words(text)
                n = len(words) - window + 1
                if n < 1:
                    continue
                hits = unplanes(found, np.uint32).astype(np.int64)
                edge = np.zeros(len(words) + 2, np.int64)
                np.add.at(edge, np.maximum(hits - (window - block), 0), 1)
                np.add.at(edge, np.minimum(hits, len(words)) + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                if len(at):
                    h = word_hashes(words)
                    if chunk.add(doc_id, tag, len(words), one(h, window)[at], (two(h, window)[at] >> np.uint64(32)).astype(np.uint32), at.astype(np.uint32)):
                        yield from chunk.flush()
        yield from chunk.flush()

    return run


class _Found:
    """Positions found in a task's buckets, regrouped by slices of documents before they leave."""

    def __init__(self, bits: int, limit: int = 1_000_000):
        self.bits, self.limit = bits, limit
        self.clear()

    def clear(self) -> None:
        self.size, self.parts = 0, []

    def add(self, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> bool:
        if len(doc):
            self.parts.append((doc, tag, pos))
            self.size += len(doc)
        return self.size >= self.limit

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        doc, tag, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        part = (mix64(doc.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.lexsort((pos, tag, doc, part))
        doc, tag, pos, part = doc[order], tag[order], pos[order], part[order]
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
        none = np.zeros(0, np.uint8)
        rows = [_entry(int(part[x]), _LOCAL, doc[starts], tag[starts], owner[x:y], pos[x:y], none, none) for x, y in zip(*_slices(part), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r, strict=True)) for r in rows], schema=_ENTRY)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from the slices of all tasks; rows come sorted by slice."""

    def merged(held: list) -> pa.RecordBatch:
        doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, tag, doc))
        doc, tag, pos = doc[order], tag[order], pos[order].astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        at = [planes(pos[x:y]) for x, y in zip(starts, np.r_[starts[1:], len(doc)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array(tag[starts]), pa.array(at, pa.binary())], schema=_FOUND)

    part, held = None, []
    for some in (x for batch in batches for x in _some(batch, ENTRY_ROWS)):
        for row in some.to_pylist():
            if row["p"] != part and held:
                yield merged(held)
                held = []
            part = row["p"]
            held.append(_opened(row, np.uint8, np.uint8)[:3])
    if held:
        yield merged(held)


def _opened(row: dict, key_type, key2_type) -> tuple[np.ndarray, ...]:
    docs, count, step = np.cumsum(unplanes(row["docs"], np.int64)), unplanes(row["counts"], np.uint32).astype(np.int64), unplanes(row["steps"], np.uint32)
    return np.repeat(docs, count), np.repeat(unplanes(row["tags"], np.int64), count), _positions(count, step), unplanes(row["key"], key_type), unplanes(row["key2"], key2_type)


def _meeting(resolve, key_type, key2_type, bits: int):
    """Runs `resolve` on each bucket of a task; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bucket, held = _Found(bits), None, []
        for some in (x for batch in batches for x in _some(batch, ENTRY_ROWS)):
            for row in some.to_pylist():
                if row["p"] != bucket:
                    if held and found.add(*resolve(held)):
                        yield from found.flush()
                    bucket, held = row["p"], []
                opened = _opened(row, key_type, key2_type)
                if row["kind"] == _LOCAL:
                    if found.add(*opened[:3]):
                        yield from found.flush()
                else:
                    held.append((row["kind"], *opened))
        if held:
            found.add(*resolve(held))
        yield from found.flush()

    return run


def _hits(block: int):
    def resolve(held: list) -> tuple[np.ndarray, ...]:
        kind = np.repeat(np.array([x[0] for x in held], np.int8), [len(x[1]) for x in held])
        doc, tag, pos, rest = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
        b = np.flatnonzero((kind == _INDEX) | (pos % block == 0))
        if not len(b):
            return doc[:0], tag[:0], pos[:0]
        b = b[np.argsort(rest[b])]
        key = rest[b]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        own, ends = kind[b] == _INDEX, np.iinfo(np.int64)
        key, low, high = key[starts], np.minimum.reduceat(np.where(own, ends.min, doc[b]), starts), np.maximum.reduceat(np.where(own, ends.max, doc[b]), starts)
        at = np.minimum(np.searchsorted(key, rest), len(key) - 1)
        hit = (kind == _ASK) & (key[at] == rest) & ((low[at] != doc) | (high[at] != doc))
        return doc[hit], tag[hit], pos[hit]

    return resolve


def _marked(held: list) -> tuple[np.ndarray, ...]:
    doc, tag, pos, key, key2 = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4, 5))
    order, starts = _runs(key, key2)
    least = np.empty(len(doc), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.r_[starts, len(order)]))
    late = doc > least
    return doc[late], tag[late], pos[late]


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _some(whole, TEXT_ROWS)):
            texts, tags, found = (batch.column(i).to_pylist() for i in (2, 3, 4))
            words_n, gone_n, kept = [], [], []
            for text, tag, marks in zip(texts, tags, found, strict=True):
                words = _words(text)
                gone = 0
                if own := [m["at"] for m in marks or () if m["tag"] == tag]:
                    starts = _merged(own).astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    covered = np.cumsum(edge)[: len(words)] > 0
                    gone = int(covered.sum())
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode())
                else:
                    kept.append(b" ".join(words).decode())
                words_n.append(len(words))
                gone_n.append(gone)
            columns = [batch.column(0), batch.column(1), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)][: 5 + keep_text], names=["row", "doc_id", "n_words", "n_removed", "kept_text", "text"][: 5 + keep_text])

    return run


def _bucket_count(docs: DataFrame) -> int:
    """A power of two: about `BUCKET_WORDS` words a bucket, by the bytes of all texts; bucket numbers are 31 bits."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")).alias("size")).first()["size"] or 0
    return 1 << min(31, max(8, (size // WORD_BYTES // BUCKET_WORDS).bit_length()))


def repeated_substrings_cut(docs: DataFrame, window: int = 50, chunk_words: int = CHUNK_WORDS, keep_text: bool = False) -> DataFrame:
    """A row per document: row (a struct of all its columns but text), doc_id, n_words, n_removed, kept_text.

    kept_text holds the kept words, joined by one space; with `keep_text` the whole text comes too, as text.
    """
    block, buckets = (window + 1) // 2, _bucket_count(docs)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    kinds = dict(docs.dtypes)
    plain = [F.col(c) if kinds[c] == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"))]
    rows = docs.select(rest.alias("row"), *plain, F.xxhash64("text").alias("tag"))
    known = rows.where("doc_id is not null")  # its shuffle by doc_id, all columns, serves both joins
    bits = buckets.bit_length() - 1
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // TASK_BUCKETS)

    def met(entries: DataFrame, resolve, *kinds) -> DataFrame:
        slices = entries.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(tidied(_meeting(resolve, *kinds, bits)), _ENTRY_DDL)
        return slices.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(tidied(_gathered), _FOUND_DDL)

    store = Store(docs.sparkSession, "substring")
    hits = met(known.select("doc_id", "text").mapInArrow(tidied(_probe(window, block, chunk_words, buckets)), _ENTRY_DDL), _hits(block), np.uint32, np.uint8)
    hits = store.save(hits.select("doc_id", "at"), "hits")
    keys = known.join(hits, "doc_id").select("row", "doc_id", "text", "tag", "at").mapInArrow(tidied(_extend(window, block, chunk_words, buckets)), _ENTRY_DDL)
    marks = met(keys, _marked, np.uint64, np.uint32)
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "at")).alias("found"))
    joined = known.join(marks, "doc_id", "left").select("row", "doc_id", "text", "tag", "found")
    loose = rows.where("doc_id is null").select("row", "doc_id", "text", "tag", F.lit(None).cast("array<struct<tag:bigint,at:binary>>").alias("found"))
    schema = StructType([StructField("row", joined.schema["row"].dataType)])
    for name, kind in [("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("text", "string")][: 4 + keep_text]:
        schema = schema.add(name, kind)
    return joined.unionAll(loose).mapInArrow(tidied(_cut(window, keep_text)), schema)
