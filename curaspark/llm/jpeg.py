"""Progressive JPEG in numpy: payloads as media, and a decoder from scans to full-resolution RGB tensors.

Decoding accumulates every scan - spectral bands first, then successive-approximation refinements - into coefficient
arrays, dequantises, inverse-transforms all blocks in one product, repeats subsampled chroma to full size and converts
to RGB. Scans whose code table makes every code alike are read in one step; any other goes bit by bit.

A payload is stored losslessly in the format's own unit, the quantised coefficient: the 63 AC coefficients of a block
take a byte each, as the values of magnitude 128 to 255 whose coded bits are that byte. The DC coefficient is 0. Blocks
fill the luma and the two chroma planes of a 4:2:0 image, in two spectral bands at half precision and one refinement.
Images are written to a table in the shared folder; payloads, tensors and digests come from the bytes read back.

Defined results: a null or empty text is one unit of zero bytes; rows that repeat give repeated rows, and equal texts
equal values, since the inverse transform is exact integer arithmetic. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import Store

UNIT = 64
_BATCH_BYTES = 16 << 20
_SCALE = 20


def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Scaled integer weight of each zigzag coefficient in each of a block's 64 samples; products stay exact."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * 2**_SCALE)


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: list[int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(lengths) + symbols)


def _scan(components: list[int], first: int, last: int, high: int, low: int, body: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + body.replace(b"\xff", b"\xff\x00")


def _padded_bits(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


_BANDS = ((1, 5), (6, 63))
_ONE_CODE, _EOB_CODES = [1, *[0] * 15], [0, 0, 0, 15, *[0] * 12]
_LUMA, _BLUE, _RED = 1, 2, 3
_HEAD = b"".join([b"\xff\xd8", _segment(0xDB, bytes(1) + bytes([1]) * 64)])
_TABLES = _table(0x00, _ONE_CODE, b"\x00") + _table(0x10, _ONE_CODE, b"\x07")
_REFINE = _table(0x10, _EOB_CODES, bytes(range(0, 0xF0, 16)))


def _refinement(bits: np.ndarray) -> bytes:
    """Correction bits of blocks whose coefficients are all known to be nonzero, behind end-of-band runs."""
    out = []
    for a in range(0, len(bits), 32767):
        own = bits[a : a + 32767]
        n = len(own).bit_length() - 1
        code = (n << n) | (len(own) - (1 << n))
        out += [np.array([code >> i & 1 for i in range(n + 3, -1, -1)], np.uint8), own.ravel()]
    return _padded_bits(np.concatenate(out))


def from_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose AC coefficients hold the payload."""
    blocks = max(1, -(-len(payload) // 63))
    units = -(-blocks // 6)
    across = max(1, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    if max(across, down) > 4095:
        raise ValueError("payload is larger than an image can be")
    units = across * down
    data = np.zeros(units * 6 * 63, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 63)
    planes = {_LUMA: data[: 4 * units], _BLUE: data[4 * units : 5 * units], _RED: data[5 * units :]}
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([_LUMA, 0x22, 0, _BLUE, 0x11, 0, _RED, 0x11, 0])
    out = [_HEAD, _segment(0xFE, b"payload %d" % len(payload)), _segment(0xC2, frame), _TABLES]
    out.append(_scan([_LUMA, _BLUE, _RED], 0, 0, 0, 0, _padded_bits(np.zeros(6 * units, np.uint8))))
    for name, own in planes.items():
        out += [_scan([name], a, b, 0, 1, (own[:, a - 1 : b] >> 1).tobytes()) for a, b in _BANDS]
    out.append(_REFINE)
    for name, own in planes.items():
        out.append(_scan([name], 1, 63, 1, 0, _refinement((own & 1) ^ (own < 128))))
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> np.ndarray:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("a scan ends too early")
        self.at += n
        return got

    def number(self, n: int) -> int:
        value = 0
        for bit in self.take(n).tolist():
            value = value << 1 | bit
        return value

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


class _Codes:
    def __init__(self, lengths: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for size, n in enumerate(lengths, 1):
            for _ in range(n):
                self.codes[size, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = next(((size, symbol) for (size, _), symbol in self.codes.items()), None) if len(self.codes) == 1 else None

    def read(self, bits: _Bits) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | int(bits.take(1)[0])
            if (size, code) in self.codes:
                return self.codes[size, code]
        raise ValueError("a code is in no table")


class _Component:
    def __init__(self, across: int, down: int, quant: int, width: int, height: int):
        self.across, self.down, self.quant = across, down, quant
        self.width, self.height = width, height  # in blocks that hold samples
        self.stride = 0
        self.values = np.zeros((0, 64), np.int32)
        self.last = 0

    def own(self) -> np.ndarray:
        """Places of the blocks of a scan of this component alone."""
        return (np.arange(self.height)[:, None] * self.stride + np.arange(self.width)).ravel()


class Decoder:
    """Coefficients and samples of a progressive JPEG of 8-bit samples."""

    def __init__(self, data: bytes):
        self.quants, self.codes, self.components, self.comment, self.interval = {}, {}, {}, b"", 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = data[at + 1]
            if kind == 0xD9:
                break
            if kind == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._tables(body)
            elif kind == 0xC2:
                self._frame(body)
            elif kind == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                end = self._end(data, at)
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only progressive Huffman-coded frames are read")

    @staticmethod
    def _end(data: bytes, at: int) -> int:
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return len(data)
            if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                return at
            at += 2

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            self.quants[name] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int64)
            at += 65 + 64 * bool(wide)

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            lengths = body[at + 1 : at + 17]
            n = sum(lengths)
            self.codes[body[at]] = _Codes(lengths, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8:
            raise ValueError("only samples of 8 bits are read")
        parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.most = max(p[1] for p in parts), max(p[2] for p in parts)
        self.units = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        for name, across, down, quant in parts:
            wide, high = -(-self.width * across // self.most[0]), -(-self.height * down // self.most[1])
            c = self.components[name] = _Component(across, down, quant, -(-wide // 8), -(-high // 8))
            c.stride = self.units[0] * across
            c.values = np.zeros((c.stride * self.units[1] * down, 64), np.int32)

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        names = [(head[1 + 2 * i], head[2 + 2 * i]) for i in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        own = [(self.components[c], t) for c, t in names]
        parts = self._restarts(data) if self.interval else [data]
        step, done = self.interval or 1 << 60, 0
        for part in parts:
            bits = _Bits(part.replace(b"\xff\x00", b"\xff"))
            for c, _ in own:
                c.last = 0
            if first == 0:
                done = self._dc(own, bits, high, low, done, step)
            else:
                component, table = own[0]
                places = component.own()[done : done + step]
                (self._refine if high else self._band)(component.values, places, bits, self.codes[0x10 | table & 15], first, last, low)
                done += len(places)

    @staticmethod
    def _restarts(data: bytes) -> list[bytes]:
        out, start, at = [], 0, 0
        while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
            if 0xD0 <= data[at + 1] <= 0xD7:
                out.append(data[start:at])
                start = at + 2
            at += 2
        return [*out, data[start:]]

    def _order(self, own: list) -> Iterator[tuple[_Component, int, int]]:
        if len(own) == 1:
            for place in own[0][0].own().tolist():
                yield own[0][0], place, own[0][1]
            return
        for y in range(self.units[1]):
            for x in range(self.units[0]):
                for c, table in own:
                    for j in range(c.down):
                        for i in range(c.across):
                            yield c, (y * c.down + j) * c.stride + x * c.across + i, table

    def _dc(self, own: list, bits: _Bits, high: int, low: int, done: int, step: int) -> int:
        tables = [self.codes.get(t >> 4) for _, t in own]
        if not high and step == 1 << 60 and all(t and t.only and t.only[1] == 0 for t in tables):
            return done  # all differences are zero
        per = 1 if len(own) == 1 else sum(c.across * c.down for c, _ in own)
        for i, (c, place, table) in enumerate(self._order(own)):
            if not done * per <= i < (done + step) * per:
                continue
            if high:
                c.values[place, 0] |= int(bits.take(1)[0]) << low
            else:
                c.last += bits.signed(self.codes[table >> 4].read(bits))
                c.values[place, 0] = c.last << low
        return done + step

    @staticmethod
    def _band(values: np.ndarray, places: np.ndarray, bits: _Bits, codes: _Codes, first: int, last: int, low: int) -> None:
        wide = last - first + 1
        if codes.only and codes.only[1] >> 4 == 0 and 0 < codes.only[1] < 16:
            size, extra = codes.only
            fields = bits.take(len(places) * wide * (size + extra)).reshape(-1, size + extra)[:, size:]
            number = fields @ (1 << np.arange(extra - 1, -1, -1, dtype=np.int32))
            number = np.where(fields[:, 0] == 1, number, number - (1 << extra) + 1)
            magnitude = np.abs(number) << low
            values[places, first : last + 1] = np.where(number < 0, -magnitude, magnitude).reshape(-1, wide)
            return
        run = 0
        for place in places.tolist():
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                symbol = codes.read(bits)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    k += zeros
                    value = bits.signed(size)
                    values[place, k] = -(-value << low) if value < 0 else value << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + (bits.number(zeros) if zeros else 0)
                    break

    @staticmethod
    def _refine(values: np.ndarray, places: np.ndarray, bits: _Bits, codes: _Codes, first: int, last: int, low: int) -> None:
        one, wide, at = 1 << low, last - first + 1, 0

        def correct(place: int, k: int) -> None:
            if bits.take(1)[0] and not abs(values[place, k]) & one:
                values[place, k] += one if values[place, k] > 0 else -one

        while at < len(places):
            place, k, run = int(places[at]), first, 0
            while k <= last:
                symbol = codes.read(bits)
                zeros, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = one if bits.take(1)[0] else -one
                elif zeros < 15:
                    run = (1 << zeros) + (bits.number(zeros) if zeros else 0)
                    break
                while k <= last:
                    if values[place, k]:
                        correct(place, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if value and k <= last:
                    values[place, k] = value
                k += 1
            if not run:
                at += 1
                continue
            rows = places[at : at + run]
            if k == first and (known := values[rows, first : last + 1]).all():
                new = bits.take(len(rows) * wide).reshape(-1, wide).astype(np.int32) << low
                new &= ~(np.abs(known) & one)
                values[rows, first : last + 1] = known + np.where(known > 0, new, -new)
            else:
                for i, row in enumerate(rows.tolist()):
                    for j in range(k if i == 0 else first, last + 1):
                        if values[row, j]:
                            correct(row, j)
            at += run

    def payload(self) -> bytes:
        """The payload that from_payload() put into the coefficients."""
        size = int(self.comment.removeprefix(b"payload "))
        values = np.concatenate([self.components[c].values[:, 1:] for c in (_LUMA, _BLUE, _RED)])
        return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[:size]

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution."""
        out = []
        for c in self.components.values():
            samples = np.empty(c.values.shape, np.uint8)
            for a in range(0, len(samples), 4096):  # a slice of blocks at a time, for products of bounded size
                exact = (c.values[a : a + 4096] * self.quants[c.quant]).astype(np.float64) @ BASIS
                samples[a : a + 4096] = np.clip(np.floor(exact * 2.0**-_SCALE + 128.5), 0, 255)
            plane = samples.reshape(-1, c.stride, 8, 8).swapaxes(1, 2).reshape(-1, 8 * c.stride)
            if (tall := self.most[1] // c.down) > 1:
                plane = plane.repeat(tall, axis=0)
            if (wide := self.most[0] // c.across) > 1:
                plane = plane.repeat(wide, axis=1)
            out.append(plane[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """A height x width x 3 tensor of bytes."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, b, r = planes[0].astype(np.int32) * 65536 + 32768, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        # 1.402, 0.344136, 0.714136 and 1.772 in units of 2^-16
        parts = (y + 91881 * r, y - 22554 * b - 46802 * r, y + 116130 * b)
        return np.clip(np.stack(parts, axis=2) >> 16, 0, 255).astype(np.uint8)


def feature(rgb: np.ndarray) -> str:
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ":".join(map(str, rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist())) + f":{zlib.crc32(rgb.tobytes()):08x}"


def _stored(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), from_payload(data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)))


_WRITTEN = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_ROWS = pa.schema([*_WRITTEN, ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
_DIGESTS = pa.schema([*_WRITTEN][:2] + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches go out by size, so that images of many long texts are never held at once."""
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, media = _stored(text)
            rows.append({"doc_id": doc_id, "n_bytes": n, "media": media})
            size += len(media)
            if size > _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_WRITTEN)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_WRITTEN)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            image = Decoder(media)
            rgb = image.rgb()
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "n_bytes": n, "media": media, "payload": image.payload(), "height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes()}], schema=_ROWS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            image = Decoder(media)
            back = image.payload()
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(image.rgb())))
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in rows], schema=_DIGESTS)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the JPEG), written to the shared folder and read back."""
    media = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")
    return Store(docs.sparkSession, "media").save(media, "media")


def media_rows(docs: DataFrame) -> DataFrame:
    """`media_table` with what its stored bytes hold: payload, height, width and rgb, row by row of three bytes a pixel."""
    return media_table(docs).mapInArrow(_decoded, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """What `media_rows` gives, as sizes and digests."""
    return media_table(docs).mapInArrow(_digested, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
