"""Media columns: progressive JPEG.

The decoder reads a progressive file's scans into coefficient arrays, whole spectral bands and
single bits of precision at a time, transforms the blocks back in numpy, brings chroma to full
resolution and gives an RGB tensor. The encoder stores bytes losslessly as the format's own units:
each byte is one quantised coefficient, so that 64 bytes fill a block.

A block's first byte is its DC coefficient (0 to 255); each other byte is the 8 magnitude bits of
an AC coefficient of size category 8 (-255 to -128 or 128 to 255). All quantiser steps are 1. The
blocks fill 16 x 16 units of four luma and two chroma blocks. DC goes out bit by bit, AC in two
bands, each with one bit of refinement.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.llm.common import lean, schema, table, text_of

BLOCK = 64
#: Blocks of a unit: four of luma, one each of the chroma components.
UNIT = 6
BANDS = ((1, 5), (6, 63))
DC_BITS = 8
#: Units in a row of the picture, until the format's limit of 65,535 pixels in a column is reached.
ACROSS, MOST = 64, 4095
#: Blocks transformed at once.
AT_ONCE = 1 << 15
#: Fixed-point bits of the transform; all sums are exact in double precision.
FIXED = 13

Batches = Iterator[pa.RecordBatch]


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in order of transmission."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = zigzag()


def payload_of(text: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of 64."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


# --- encoder ---------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, whose code is one 0 bit."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, *[0] * 15, symbol]))


def _scan(components: list[int], band: tuple[int, int], high: int, low: int, coded: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, 0)], *band, high << 4 | low])
    return _segment(0xDA, head) + coded


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones, a zero byte after each FF."""
    if spare := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(spare, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _refinement(value: np.ndarray) -> bytes:
    """Of each block a code without new coefficients, then the last magnitude bit of each; AT_ONCE blocks fill whole bytes."""
    out = []
    for at in range(0, len(value), AT_ONCE):
        part = value[at : at + AT_ONCE]
        bits = np.zeros((len(part), part.shape[1] + 1), np.uint8)
        bits[:, 1:] = (part & 1) ^ (1 - (part >> 7))
        out.append(_stuffed(bits.reshape(-1)))
    return b"".join(out)


def grid(blocks: int) -> tuple[int, int]:
    """Units across and down for so many blocks."""
    units = -(-blocks // UNIT)
    down = max(-(-units // ACROSS), 1) if units <= ACROSS * MOST else MOST
    return -(-units // down), down


def encode_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload; the payload's length goes into a comment."""
    blocks = len(payload) // BLOCK
    across, down = grid(blocks)
    data = np.zeros((across * down * UNIT, BLOCK), np.uint8)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    units = data.reshape(down, across, UNIT, BLOCK)
    luma = units[:, :, :4].reshape(down, across, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    parts = [(1, luma), (2, units[:, :, 4].reshape(-1, BLOCK)), (3, units[:, :, 5].reshape(-1, BLOCK))]
    frame = bytes([8, *(16 * down).to_bytes(2, "big"), *(16 * across).to_bytes(2, "big"), 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, len(payload).to_bytes(8, "big")), _segment(0xDB, bytes([0] + [1] * BLOCK)), _segment(0xC2, frame), _table(0, 0, 0)]
    dc = units[..., 0].reshape(-1)
    del data, units
    out.append(_scan([1, 2, 3], (0, 0), 0, DC_BITS, _stuffed(np.zeros(len(dc), np.uint8))))
    out += [_scan([1, 2, 3], (0, 0), k + 1, k, _stuffed(dc >> k & 1)) for k in range(DC_BITS - 1, -1, -1)]
    # first all but the last magnitude bit of every coefficient, then, in a run of no new ones, that bit
    out.append(_table(1, 0, DC_BITS - 1))
    for c, part in parts:
        for first, last in BANDS:
            # a code of one 0 bit and seven bits: a byte of its own, never FF; a negative value's
            # bits are those of its magnitude inverted, before and after halving
            out.append(_scan([c], (first, last), 0, 1, (part[:, first : last + 1] >> 1).tobytes()))
    out.append(_table(1, 0, 0))
    for c, part in parts:
        for first, last in BANDS:
            out.append(_scan([c], (first, last), 1, 0, _refinement(part[:, first : last + 1])))
    return b"".join([*out, b"\xff\xd9"])


# --- decoder ---------------------------------------------------------------------------------


class Bits:
    """Sequential reading of a scan's bits, for streams that have no fixed token length."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.at = bits.tolist(), 0

    def take(self, n: int) -> int:
        """The next n bits; ones beyond the end, as in a padded last byte."""
        got = self.bits[self.at : self.at + n]
        self.at += n
        value = 0
        for b in got:
            value = value << 1 | b
        return value << n - len(got) | (1 << n - len(got)) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def extended(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> size - 1 else value - (1 << size) + 1


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(code length, code) to symbol: codes of a length count up and double for the next length."""
    table, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for _ in range(k):
            table[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def only_symbol(table: dict[tuple[int, int], int]) -> int | None:
    """The symbol of a table with a single code of one bit: then each token has the same length."""
    return next(iter(table.values())) if list(table) == [(1, 0)] else None


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int) -> None:
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.coef = np.zeros((0, 0, BLOCK), np.int16)  # rows and columns of blocks, coefficients in order of transmission
        self.size = (0, 0)  # blocks down and across that a scan of this component alone has


class Picture:
    """A progressive JPEG's components with their accumulated coefficients."""

    def __init__(self, data: bytes) -> None:
        import re

        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.comment, self.quants, self.restart, self.components = b"", {}, 0, []
        self.orders: dict[tuple[int, ...], list[np.ndarray]] = {}
        tables: dict[int, dict[tuple[int, int], int]] = {}
        at, marker_at = 2, re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quants(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3):
                raise ValueError("not a progressive JPEG")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                end = marker_at.search(data, at).start()
                self._scan(body, data[at:end], tables)
                at = end

    def _quants(self, body: bytes) -> None:
        while body:
            wide = 2 if body[0] >> 4 else 1
            self.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + wide * BLOCK], ">u2" if wide == 2 else np.uint8).astype(np.int64)
            body = body[1 + wide * BLOCK :]

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.coef = np.zeros((self.down * c.v, self.across * c.h, BLOCK), np.int16)
            c.size = (-(-(-(-self.height * c.v // self.v)) // 8), -(-(-(-self.width * c.h // self.h)) // 8))

    def _order(self, chosen: list[Component]) -> list[np.ndarray]:
        """Of each component, flat numbers of its blocks as the scan has them: (units, blocks of a unit)."""
        key = tuple(c.ident for c in chosen)
        if key not in self.orders:
            self.orders[key] = self._new_order(chosen)
        return self.orders[key]

    def _new_order(self, chosen: list[Component]) -> list[np.ndarray]:
        if len(chosen) == 1:
            c = chosen[0]
            return [(np.arange(c.size[0])[:, None] * c.coef.shape[1] + np.arange(c.size[1])).reshape(-1, 1)]
        out = []
        for c in chosen:
            i = np.arange(self.down)[:, None, None, None] * c.v + np.arange(c.v)[:, None]
            j = np.arange(self.across)[:, None, None] * c.h + np.arange(c.h)
            out.append((i * c.coef.shape[1] + j).reshape(-1, c.v * c.h))
        return out

    def _scan(self, head: bytes, coded: bytes, tables: dict) -> None:
        import re

        n = head[0]
        chosen = [next(c for c in self.components if c.ident == head[1 + 2 * k]) for k in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        order = self._order(chosen)
        pieces = re.split(rb"\xff[\xd0-\xd7]", coded) if self.restart else [coded]
        step = self.restart or len(order[0])
        for k, piece in enumerate(pieces):
            raw = np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)
            part = [o[k * step : (k + 1) * step] for o in order]
            if first == 0:
                self._dc(chosen, part, [tables.get(head[2 + 2 * i] >> 4, {}) for i in range(n)], high, low, np.unpackbits(raw))
            elif high:
                self._refine(chosen[0], part[0].ravel(), tables[0x10 | head[2] & 15], first, last, low, raw)
            else:
                self._bands(chosen[0], part[0].ravel(), tables[0x10 | head[2] & 15], first, last, low, raw)

    def _dc(self, chosen: list[Component], order: list[np.ndarray], tables: list[dict], high: int, low: int, bits: np.ndarray) -> None:
        units, widths = len(order[0]), [o.shape[1] for o in order]
        width, symbols = sum(widths), {only_symbol(t) for t in tables}
        if high:
            steps = bits[: units * width].reshape(units, width).astype(np.int32) << low
        elif len(symbols) == 1 and None not in symbols:
            size = symbols.pop()
            steps = _extended(bits[: units * width * (1 + size)].reshape(units, width, 1 + size)[..., 1:])
        else:
            reader, of = Bits(bits), [t for t, n in zip(tables, widths, strict=True) for _ in range(n)]
            steps = np.array([[reader.extended(reader.symbol(t)) for t in of] for _ in range(units)], np.int32)
        begun = 0
        for c, o in zip(chosen, order, strict=True):
            dc, mine = c.coef.reshape(-1, BLOCK)[:, 0], steps[:, begun : begun + o.shape[1]].ravel()
            begun += o.shape[1]
            if high:
                dc[o.ravel()] |= mine
            else:
                dc[o.ravel()] = np.cumsum(mine) << low

    def _bands(self, c: Component, blocks: np.ndarray, table: dict, first: int, last: int, low: int, raw: np.ndarray) -> None:
        flat, width, symbol = c.coef.reshape(-1, BLOCK), last - first + 1, only_symbol(table)
        if symbol is not None and 0 < symbol < 16:  # no runs: every coefficient has a token of the same length
            size = width * (1 + symbol)  # bits of a block
            for at in range(0, len(blocks), AT_ONCE):
                part = blocks[at : at + AT_ONCE]
                bits = np.unpackbits(raw[at * size // 8 : -(-(at + len(part)) * size // 8)])
                flat[part, first : last + 1] = _extended(bits[: len(part) * size].reshape(len(part), width, 1 + symbol)[..., 1:]) << low
            return
        reader, skip = Bits(np.unpackbits(raw)), 0
        for b in blocks.tolist():
            k = first
            if skip:
                skip -= 1
                continue
            while k <= last:
                run, size = divmod(reader.symbol(table), 16)
                if size:
                    k += run
                    flat[b, k] = reader.extended(size) << low
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + (reader.take(run) if run else 0) - 1
                    break

    def _refine(self, c: Component, blocks: np.ndarray, table: dict, first: int, last: int, low: int, raw: np.ndarray) -> None:
        flat = c.coef.reshape(-1, BLOCK)
        if only_symbol(table) == 0:  # no new coefficients: a code for each block, then a bit for each that is there
            begun = 0  # bits read
            for at in range(0, len(blocks), AT_ONCE):
                part = blocks[at : at + AT_ONCE]
                band = flat[part, first : last + 1]
                block, k = np.nonzero(band)
                used = len(block) + len(part)
                bits = np.unpackbits(raw[begun // 8 : -(-(begun + used) // 8)])[begun % 8 :]
                band[block, k] += np.sign(band[block, k]) * (bits[np.arange(len(block)) + block + 1].astype(np.int16) << low)
                flat[part, first : last + 1] = band
                begun += used
            return
        reader, skip, one = Bits(np.unpackbits(raw)), 0, 1 << low

        def correct(b: int, k: int) -> None:
            if reader.take(1) and not abs(int(flat[b, k])) & one:
                flat[b, k] += one if flat[b, k] > 0 else -one

        for b in blocks.tolist():
            k = first
            while k <= last and not skip:
                run, size = divmod(reader.symbol(table), 16)
                if not size and run < 15:
                    skip = (1 << run) + (reader.take(run) if run else 0)
                    break
                value = (one if reader.take(1) else -one) if size else 0
                while k <= last:
                    if flat[b, k]:
                        correct(b, k)
                    elif run:
                        run -= 1
                    else:
                        flat[b, k] = value
                        k += 1
                        break
                    k += 1
            if skip:
                for j in range(k, last + 1):
                    if flat[b, j]:
                        correct(b, j)
                skip -= 1

    def plane(self, c: Component, above: int = 0, below: int | None = None) -> np.ndarray:
        """The component's samples, from one row of blocks to another."""
        coef = c.coef[above:below]
        down, across, _ = coef.shape
        flat, quant = coef.reshape(-1, BLOCK), self.quants[c.quant]
        out = np.empty(flat.shape, np.uint8)
        for at in range(0, len(flat), AT_ONCE):
            raw = (flat[at : at + AT_ONCE] * quant).astype(np.float64) @ INVERSE
            out[at : at + AT_ONCE] = np.clip((raw.astype(np.int64) + (128 << FIXED) + (1 << FIXED - 1)) >> FIXED, 0, 255)
        return out.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)

    def stripes(self) -> Iterator[np.ndarray]:
        """Rows x width x 3, from the top, about AT_ONCE blocks at a time; chroma is brought to full resolution."""
        step = max(1, AT_ONCE // (self.across * sum(c.h * c.v for c in self.components)))
        for at in range(0, self.down, step):
            planes = (self.plane(c, at * c.v, (at + step) * c.v) for c in self.components)
            rows = self.height - at * 8 * self.v
            full = [np.repeat(np.repeat(p, self.v // c.v, axis=0), self.h // c.h, axis=1)[:rows, : self.width].astype(np.int32) for p, c in zip(planes, self.components, strict=True)]
            if len(full) == 1:
                yield np.repeat(full[0].astype(np.uint8)[..., None], 3, axis=2)
                continue
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            half = 1 << 15
            out = np.empty((*y.shape, 3), np.uint8)
            out[..., 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
            out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
            out[..., 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
            yield out

    def rgb(self) -> np.ndarray:
        """Height x width x 3."""
        out, at = np.empty((self.height, self.width, 3), np.uint8), 0
        for part in self.stripes():
            out[at : at + len(part)] = part
            at += len(part)
        return out

    def payload(self) -> bytes:
        """The bytes that encode_jpeg stored."""
        down, across = self.down, self.across
        data = np.empty((down, across, UNIT, BLOCK), np.uint8)
        luma, blue, red = (c.coef for c in self.components)
        step = max(1, AT_ONCE // across)
        for at in range(0, down, step):
            part = data[at : at + step]
            many = len(part)
            units = np.empty(part.shape, np.int16)
            units[:, :, :4] = luma[2 * at : 2 * (at + many)].reshape(many, 2, across, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(many, across, 4, BLOCK)
            units[:, :, 4], units[:, :, 5] = blue[at : at + many], red[at : at + many]
            units[..., 1:] += np.where(units[..., 1:] < 0, np.int16(255), np.int16(0))
            part[...] = units
        return data.reshape(-1)[: int.from_bytes(self.comment, "big")].tobytes()


def _extended(token: np.ndarray) -> np.ndarray:
    """Magnitude bits along the last axis to signed values."""
    size = token.shape[-1]
    if not size:
        return np.zeros(token.shape[:-1], np.int32)
    value = np.zeros(token.shape[:-1], np.int32)
    for part in np.moveaxis(np.packbits(token, axis=-1), -1, 0):
        value = value << 8 | part
    value >>= -size % 8
    return np.where(value >> size - 1 != 0, value, value - (1 << size) + 1)


def inverse_transform() -> np.ndarray:
    """64 coefficients in order of transmission to 64 samples, scaled by 2**FIXED and whole."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.round(np.einsum("ui,vj->uvij", basis, basis).reshape(BLOCK, BLOCK)[ZIGZAG] * 2**FIXED)


INVERSE = inverse_transform()

# --- columns ---------------------------------------------------------------------------------

STORED = "n_bytes long, media binary"
LOADED = "n_bytes long, media binary, payload binary, height int, width int, sums array<long>, rgb_crc32 long"
#: Bytes of payload in an output batch.
BATCH_BYTES = 4 << 20


def _batches(keys: pa.Array, rows: Iterator[tuple], key: str, schema: pa.Schema) -> Batches:
    begun, held, size = 0, [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > BATCH_BYTES:
            yield _batch(keys[begun : begun + len(held)], held, key, schema)
            begun, held, size = begun + len(held), [], 0
    if held:
        yield _batch(keys[begun:], held, key, schema)


def _batch(keys: pa.Array, rows: list[tuple], key: str, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True))], names=[key, *schema.names])


def _store(key: str) -> Callable[[Batches], Batches]:
    out = pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Batches) -> Batches:
        lean()
        for b in batches:
            yield from _batches(b[key], ((len(t), encode_jpeg(payload_of(t))) for t in (x.as_py() for x in b["text"].cast(pa.binary()))), key, out)

    return run


def _load(key: str, tensor: bool) -> Callable[[Batches], Batches]:
    fields = [("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("sums", pa.list_(pa.int64())), ("rgb_crc32", pa.int64())]
    out = pa.schema(fields + [("rgb", pa.binary())] * tensor)

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for n, stored in zip(b["n_bytes"].to_pylist(), b["media"], strict=True):
            media = stored.as_py()
            p = Picture(media)
            sums, crc = np.zeros(3, np.int64), 0
            for part in p.stripes():
                sums += part.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                crc = zlib.crc32(part, crc)
            yield n, media, p.payload(), p.height, p.width, sums.tolist(), crc, *([p.rgb().tobytes()] if tensor else [])

    def run(batches: Batches) -> Batches:
        lean()
        for b in batches:
            yield from _batches(b[key], rows(b), key, out)

    return run


def store(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes of the text, media (a JPEG that holds it).

    A null text is an empty one, stored as 64 zero bytes. Keys may repeat or be null; other columns
    are not read; an empty table gives an empty one. A worker needs some 8 bytes of memory for each
    byte of the longest text (measured: 0.9 GB for 128 MB), so the memory of a worker sets the limit;
    Arrow's binary values end at 2 GB, texts near 1.7 GB in any case.
    """
    df = docs.select(F.col(f"`{key}`"), text_of(text_col).alias("text"))
    return df.mapInArrow(_store(key), schema(df, [key], STORED))


def load(stored: DataFrame, key: str = "doc_id", tensor: bool = True) -> DataFrame:
    """Stored media read back: the payload, the picture's size, its channels' sums and checksum.

    tensor: also the picture itself, in a column rgb (height x width x 3 bytes). Without it no more
    than a stripe of the picture is held at a time.
    """
    df = stored.select(f"`{key}`", "n_bytes", "media")
    return df.mapInArrow(_load(key, tensor), schema(df, [key], LOADED + ", rgb binary" * tensor))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.col("payload")
    feature = F.concat_ws(":", F.concat_ws("x", "height", "width"), F.concat_ws(",", F.col("sums").cast("array<string>")), F.col("rgb_crc32").cast("string"))
    return load(store(table(spark, sf_dir, "documents")), tensor=False).select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, F.octet_length(payload) - BLOCK + 1, F.lit(BLOCK))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
