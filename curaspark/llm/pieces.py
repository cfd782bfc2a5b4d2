"""SentencePiece encoding and decoding with offsets into the original bytes.

A text is first normalised here: at each byte the longest prefix in the model's compiled character map (a double-array
trie) is replaced by its target, and every normalised byte keeps the source byte it came from. The library then merges
pieces over the normalised form, and each piece's span is projected through that alignment to original bytes.

Merging is done a stretch at a time: no piece of such a model holds a word mark after another character, so text
splits before each run of marks, and line feeds stand alone where no longer piece holds one. Stretches repeat a lot and
are remembered up to a bound. Models for which a split would not be safe are merged as a whole.

Defined results: null and empty texts have no ids and decode to the empty text; rows that repeat give repeated rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()


class CharacterMap:
    """The compiled character map of a model: a double-array trie of prefixes and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units, self.pool = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else [], blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        if not self.units:
            return None

        def child(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node, found = child(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= child(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if not found:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]


class Normalizer:
    """Normalised bytes of a text, and for each of them (and for the end) the source byte it stands for."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = MARK if self.escape else b" "
        out = (space if self.prefix else b"") + data.replace(b" ", space)
        width = np.ones(len(data), np.int64)
        width[np.frombuffer(data, np.uint8) == 32] = len(space)
        align = np.concatenate([np.zeros(len(space) if self.prefix else 0, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
        return out, align

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space, units, at = MARK if self.escape else b" ", [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            step, new = found or (_width(data[at]), data[at : at + _width(data[at])])
            units.append((at, new))
            at += step
        first = 0
        while self.squeeze and first < len(units) and units[first][1] == b" ":
            first += 1
        if first == len(units):
            return b"", np.array([len(data)])
        out, align, after_space = bytearray(), [], self.squeeze
        if self.prefix:
            out += space
            align += [units[first][0]] * len(space)
        for source, new in units[first:]:
            if new := new.lstrip(b" ") if after_space else new:
                after_space = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", space)
                out += new
                align += [source] * len(new)
        align.append(len(data))
        while self.squeeze and out.endswith(space):
            del out[-len(space) :], align[len(out) + 1 :]
        return bytes(out), np.array(align)


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class _Stretches(dict):
    """Per stretch of normalised bytes: its ids, the same as decimal text, and the bytes under each piece."""

    def __init__(self, codec: Codec, limit: int = 200_000):
        self.codec, self.limit = codec, limit

    def __missing__(self, stretch: bytes) -> tuple[list[int], bytes, bytes]:
        if len(self) >= self.limit:
            self.clear()
        ids = self.codec.merge(stretch.decode())
        got = ids, b",".join(b"%d" % i for i in ids), np.array([self.codec.widths[i] for i in ids], np.uint32).tobytes()
        if len(stretch) < 96:
            self[stretch] = got
        return got


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        self.normalize = Normalizer(model.normalizer_spec)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        bare = pb.ModelProto()
        bare.CopyFrom(model)
        bare.normalizer_spec.CopyFrom(pb.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=True))
        merger = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.merge = lambda text: merger.encode(text, num_threads=1)
        byte = pb.ModelProto.SentencePiece.BYTE
        self.widths = [1 if p.type == byte else len(p.piece.encode()) for p in model.pieces]
        longer = [p.piece.encode() for p in model.pieces if p.type != byte and len(p.piece) > 1]
        special = any(p.type in (pb.ModelProto.SentencePiece.USER_DEFINED,) for p in model.pieces)
        apart = model.trainer_spec.model_type == pb.TrainerSpec.BPE and model.trainer_spec.byte_fallback and not special and not any(MARK in x.lstrip(MARK) or (MARK in x and x.strip(MARK) and x.rstrip(MARK) != x) for x in longer)
        lines = apart and not any(b"\n" in x for x in longer)
        mark = re.escape(MARK)
        self.split = re.compile(rb"(?:%b)*(?:(?!%b)[^\n])+|(?:%b)+|\n" % (mark, mark, mark)).findall if lines else re.compile(rb"(?:%b)*(?:(?!%b)[\s\S])+|(?:%b)+" % (mark, mark, mark)).findall if apart else lambda x: [x] if x else []
        self.known = _Stretches(self)

    def encode(self, text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, str]:
        """Ids as decimal text joined by commas, first and end source byte of each piece, and what the ids decode to."""
        data = (text or "").encode()
        form, align = self.normalize(data)
        parts = [self.known[x] for x in self.split(form)]
        edges = np.zeros(1, np.int64)
        if parts:
            edges = np.concatenate([edges, np.cumsum(np.frombuffer(b"".join([x[2] for x in parts]), np.uint32), dtype=np.int64)])
        spans = align[edges]
        ids = [i for x in parts for i in x[0]]
        return b",".join([x[1] for x in parts]), spans[:-1], spans[1:], self.library.decode(ids) if ids else ""


@lru_cache(2)
def _codec(path: str) -> Codec:
    return Codec(path)


_ENCODED = "doc_id long, ids array<int>, span_start array<int>, span_end array<int>, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def _encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = [codec.encode(x) for x in batch.column(1).to_pylist()]
            ids = [np.array(x[0].split(b",") if x[0] else [], np.int32) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in (ids, [x[1].astype(np.int32) for x in rows], [x[2].astype(np.int32) for x in rows])), pa.array([x[3] for x in rows], pa.string())], names=["doc_id", "ids", "span_start", "span_end", "decoded"])

    return run


def _digesting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            out = []
            for ids, start, end, decoded in map(codec.encode, batch.column(1).to_pylist()):
                spans = zlib.crc32(np.concatenate([start, end]).astype("<u4").tobytes())
                out.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), spans))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, span_start, span_end (bytes of the original text under each piece) and the decoded text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoding(model), _ENCODED)


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """What `encoded` gives, as one count and digests a document, for checks and for tables kept beside the texts."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digesting(model), _DIGESTS)
