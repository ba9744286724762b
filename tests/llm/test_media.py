import hashlib
import zlib

import numpy as np
import pytest

from hornpress.llm import media
from tests.llm.conftest import EDGE


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 383, 384, 385, 5000, 24_577, 200_000])
def test_bytes_come_back(size):
    data = media.payload_of(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes())
    jpeg = media.encode_jpeg(data)
    picture = media.Picture(jpeg)
    assert picture.payload() == data and len(data) % 64 == 0
    assert jpeg[:2] == b"\xff\xd8" and jpeg[-2:] == b"\xff\xd9" and b"\xff\xc2" in jpeg
    assert picture.rgb().shape == (picture.height, picture.width, 3)


def test_every_byte_value():
    data = bytes(range(256)) * 6
    assert media.Picture(media.encode_jpeg(data)).payload() == data


def test_zigzag_and_transform():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))
    exact = media.inverse_transform() / 2**media.FIXED
    assert np.allclose(exact @ exact.T, np.eye(64), atol=2e-3)


def emit(bits, table, run, size):
    code = table.index(run << 4 | size)
    bits += [int(b) for b in f"{code:08b}"]


def magnitude(bits, value, size):
    v = value if value > 0 else value + (1 << size) - 1
    bits += [int(b) for b in f"{v:0{size}b}"] if size else []


def general_jpeg(coef, quant):
    """A grey progressive JPEG with runs, end-of-block runs and refinement, its codes all of eight bits."""
    n = len(coef)
    symbols = sorted({0x00, 0x10, 0x20, 0xF0, *(r << 4 | s for r in range(15) for s in range(1, 9))})[:254]
    dht = lambda kind: media._segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))

    def dc(low):
        bits, last = [], 0
        for c in coef:
            d = (c[0] >> low) - last
            last = c[0] >> low
            size = int(abs(d)).bit_length()
            emit(bits, symbols, 0, size)
            magnitude(bits, int(d), size)
        return bits

    shift = lambda v, low: int(np.sign(v)) * (abs(int(v)) >> low)

    def first(low):
        bits, skipped = [], 0

        def flush():
            nonlocal skipped
            while skipped:
                r = min(skipped.bit_length() - 1, 2)
                emit(bits, symbols, r, 0)
                take = min(skipped, (1 << r + 1) - 1)
                bits.extend(int(b) for b in f"{take - (1 << r):0{r}b}") if r else None
                skipped -= take

        for c in coef:
            values = [shift(v, low) for v in c[1:]]
            last = max((k for k, v in enumerate(values) if v), default=-1)
            if last >= 0:
                flush()
            run = 0
            for v in values[: last + 1]:
                if not v:
                    run += 1
                    continue
                while run > 14:
                    emit(bits, symbols, 15, 0)
                    run -= 16
                    run = max(run, 0)
                size = abs(v).bit_length()
                emit(bits, symbols, run, size)
                magnitude(bits, v, size)
                run = 0
            skipped += last < 62
        flush()
        return bits

    def refine(low):
        bits = []
        for c in coef:
            was, now = [shift(v, low + 1) for v in c[1:]], [shift(v, low) for v in c[1:]]
            last = max((k for k in range(63) if now[k] and not was[k]), default=-1)
            run, held = 0, []
            for k in range(last + 1):
                if was[k]:
                    held.append(abs(now[k]) & 1)
                elif now[k]:
                    emit(bits, symbols, run, 1)
                    bits.append(int(now[k] > 0))
                    bits += held
                    run, held = 0, []
                else:
                    run += 1
                    if run == 16:
                        emit(bits, symbols, 15, 0)
                        bits += held
                        run, held = 0, []
            emit(bits, symbols, 0, 0)
            bits += held + [abs(now[k]) & 1 for k in range(last + 1, 63) if was[k]]
        return bits

    def scan(band, high, low, bits):
        return media._scan([1], band, high, low, media._stuffed(np.array(bits, np.uint8)))

    frame = bytes([8, 0, 8, *(8 * n).to_bytes(2, "big"), 1, 1, 0x11, 0])
    parts = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes(quant.tolist())), media._segment(0xC2, frame), dht(0), dht(1), scan((0, 0), 0, 1, dc(1)), scan((0, 0), 1, 0, [int(c[0]) & 1 for c in coef]), scan((1, 63), 0, 1, first(1)), scan((1, 63), 1, 0, refine(0)), b"\xff\xd9"]
    return b"".join(parts)


def test_general_progressive_scans():
    rng = np.random.default_rng(4)
    coef = np.zeros((40, 64), np.int64)
    coef[:, 0] = rng.integers(-200, 200, 40)
    for b in range(0, 40, 3):
        for k in range(1, 63, 5):
            coef[b, k] = rng.integers(-90, 90)
    quant = rng.integers(1, 20, 64)
    picture = media.Picture(general_jpeg(coef, quant))
    assert (picture.components[0].coef.reshape(-1, 64) == coef).all()
    full = np.zeros((40, 64))
    full[:, media.ZIGZAG] = coef * quant
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    want = np.clip(np.round(np.einsum("nuv,ui,vj->nij", full.reshape(-1, 8, 8), basis, basis) + 128), 0, 255)
    got = picture.plane(picture.components[0]).reshape(8, 40, 8).transpose(1, 0, 2)
    assert np.abs(got - want).max() <= 2


@pytest.mark.parametrize("bad", [b"no", b"\xff\xd8\xff\xc0\x00\x04xx\xff\xd9"])
def test_other_files_are_refused(bad):
    with pytest.raises(ValueError):
        media.Picture(bad)


def test_query(spark, sf, texts):
    got = {r.doc_id: r for r in media.op1_media(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        data, r = media.payload_of(t.encode()), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        jpeg = media.encode_jpeg(data)
        assert (r.media_bytes, r.media_sha256) == (len(jpeg), hashlib.sha256(jpeg).hexdigest())


def test_edge_cases(edge, empty):
    stored = media.store(edge)
    back = media.load(stored).collect()
    assert sorted(bytes(r.payload[: r.n_bytes]) for r in back) == sorted((r[1] or "").encode() for r in EDGE)
    assert all(len(r.rgb) == r.height * r.width * 3 and sum(r.sums) == sum(r.rgb) for r in back)
    assert media.load(media.store(empty)).count() == 0


def slow_tensor(text):
    """The picture of a text by the definition, block by block."""
    data = media.payload_of(text)
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)]
    across, down = media.grid(len(blocks))
    blocks += [bytes(64)] * (across * down * 6 - len(blocks))
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    whole = {(u, v): np.round(np.outer(basis[u], basis[v]) * 2**13).astype(int) for u in range(8) for v in range(8)}
    steps = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))

    def samples(block):
        coef = [block[0], *[b if b >= 128 else b - 255 for b in block[1:]]]
        raw = sum(c * whole[uv] for c, uv in zip(coef, steps, strict=True)) + (128 << 13) + (1 << 12)
        return np.clip(raw >> 13, 0, 255)

    out = np.zeros((16 * down, 16 * across, 3), np.uint8)
    for u in range(across * down):
        y0, x0 = 16 * (u // across), 16 * (u % across)
        unit = [samples(b) for b in blocks[6 * u : 6 * u + 6]]
        for i in range(16):
            for j in range(16):
                y, cb, cr = (int(v) for v in (unit[2 * (i // 8) + j // 8][i % 8, j % 8], unit[4][i // 2, j // 2] - 128, unit[5][i // 2, j // 2] - 128))
                rgb = (y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16))
                out[y0 + i, x0 + j] = [min(max(v, 0), 255) for v in rgb]
    return out


def test_features_match_slow_tensors(spark, sf, texts):
    got = {r.doc_id: r.feature for r in media.op1_media(spark, sf).collect()}
    for i, t in texts[:12]:
        rgb = slow_tensor(t.encode())
        sums = ",".join(str(int(rgb[..., c].sum(dtype=np.int64))) for c in range(3))
        assert got[i] == f"{rgb.shape[0]}x{rgb.shape[1]}:{sums}:{zlib.crc32(rgb.tobytes())}"
        assert (media.Picture(media.encode_jpeg(media.payload_of(t.encode()))).rgb() == rgb).all()


def test_memory_for_long_texts():
    """Beyond a small text's, no more than ten bytes for each byte of the text."""
    import subprocess
    import sys

    code = "import resource, sys; from hornpress.llm import media; n = int(sys.argv[1]); d = media.payload_of(bytes(range(1, 129)) * (n // 128)); p = media.Picture(media.encode_jpeg(d)); sum(int(s.sum()) for s in p.stripes()); assert p.payload() == d; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    small, large = (int(subprocess.run([sys.executable, "-c", code, str(n)], capture_output=True, check=True, text=True).stdout) for n in (1 << 10, 48 << 20))
    assert large - small < 10 * (48 << 10)
