"""Image files of each kind, made by hand, against the array they were made of."""

import struct
import zlib

import numpy as np
import pytest

from mosaiq.sources import files, images


def pack_bits(data):
    """Runs of three and more are repeated, the rest is literal."""
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[at]])
            at += run
        else:
            out += bytes([run - 1]) + data[at : at + run]
            at += run
    return bytes(out)


def pack_lzw(data):
    """A writer after the format's description: clear first, codes grow one early, clear when full."""
    bits, table = [], {}

    def put(code):
        size = len(table) + 258
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        bits.append(format(code, f"0{width}b"))

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(word[0] if len(word) == 1 else table[word])
        table[longer] = len(table) + 258
        if len(table) + 258 == 4094:
            put(256)
            table.clear()
        word = data[i : i + 1]
    if word:
        put(word[0] if len(word) == 1 else table[word])
        table[b"last"] = 0
    put(257)
    line = "".join(bits)
    line += "0" * (-len(line) % 8)
    return int(line, 2).to_bytes(len(line) // 8, "big") if line else b""


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32946: zlib.compress, 32773: pack_bits}


def tiff(image, how=1, order="<", rows=None, tile=None, predictor=1, planes=1, more=()):
    """A TIFF of an array of rows, columns, bands (uint8 or uint16)."""
    h, w, bands = image.shape
    blocks = []
    for layer in [image] if planes == 1 else [image[:, :, i : i + 1] for i in range(bands)]:
        if tile:
            for y in range(0, h, tile[0]):
                for x in range(0, w, tile[1]):
                    part = np.zeros((*tile, layer.shape[2]), image.dtype)
                    piece = layer[y : y + tile[0], x : x + tile[1]]
                    part[: piece.shape[0], : piece.shape[1]] = piece
                    blocks.append(part)
        else:
            blocks += [layer[y : y + (rows or h)] for y in range(0, h, rows or h)]
    if predictor == 2:
        blocks = [np.concatenate((b[:, :1], np.diff(b.astype(np.int64), axis=1).astype(image.dtype)), axis=1) for b in blocks]
    packed = [PACK[how](b.astype(b.dtype.newbyteorder(order)).tobytes()) for b in blocks]
    at, starts = 8, []
    for p in packed:
        starts.append(at)
        at += len(p)
    tags = {256: ("H", [w]), 257: ("I", [h]), 258: ("H", [8 * image.itemsize] * bands), 259: ("H", [how]), 262: ("H", [1 if bands == 1 else 2]), 277: ("H", [bands]), 284: ("H", [planes]), 317: ("H", [predictor])}
    if tile:
        tags |= {322: ("H", [tile[1]]), 323: ("H", [tile[0]]), 324: ("I", starts), 325: ("I", [len(p) for p in packed])}
    else:
        tags |= {273: ("I", starts), 278: ("H", [rows or h]), 279: ("I", [len(p) for p in packed])}
    tags |= dict(more)
    body, directory, beyond = b"".join(packed), b"", b""
    place = 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, (form, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack(order + "I", place + len(beyond))
            beyond += raw
        directory += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + field
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body))
    return head + body + struct.pack(order + "H", len(tags)) + directory + b"\0\0\0\0" + beyond


def picture(h, w, bands, deep, seed=0):
    """Noise, flat parts and gradients."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << (8 * deep), (h, w, bands))
    a[: h // 2, : w // 2] = 7
    a[h // 2 :, w // 2 :] = np.arange(w - w // 2)[None, :, None]
    return a.astype(np.uint8 if deep == 1 else np.uint16)


@pytest.mark.parametrize("how", sorted(PACK))
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("deep", [1, 2])
def test_tiff(how, order, deep):
    for n, (bands, kind) in enumerate([(1, {}), (3, {"rows": 5}), (4, {"tile": (16, 32)}), (3, {"tile": (16, 16), "planes": 2}), (3, {"rows": 7, "planes": 2})]):
        image = picture(37, 45, bands, deep, n)
        want = image if deep == 1 else (image >> 8).astype(np.uint8)
        for predictor in (1, 2):
            assert np.array_equal(images.decode(tiff(image, how, order, predictor=predictor, **kind)), want), (bands, kind, predictor)


def test_lzw_over_all_widths():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaa" * 5000, rng.integers(0, 256, 30_000).astype(np.uint8).tobytes(), rng.integers(0, 3, 60_000).astype(np.uint8).tobytes()):
        assert images.unpack_lzw(pack_lzw(data)) == data


def test_other_kinds_of_light():
    grey = picture(9, 10, 1, 1)
    assert np.array_equal(images.decode(tiff(grey, more=[(262, ("H", [0]))])), 255 - grey)
    colours = np.random.default_rng(2).integers(0, 65536, (3, 256))
    got = images.decode(tiff(grey, more=[(262, ("H", [3])), (320, ("H", colours.ravel().tolist()))]))
    assert np.array_equal(got, np.moveaxis((colours >> 8)[:, grey[:, :, 0]], 0, -1))
    line = np.random.default_rng(3).integers(0, 2, (6, 13))
    packed = np.packbits(line, axis=1)
    raw = tiff(packed[:, :, None], more=[(256, ("H", [13])), (258, ("H", [1]))])
    assert np.array_equal(images.decode(raw)[:, :, 0], line * 255)


@pytest.mark.parametrize("what", ["no image", "compression", "float", "predictor", "short"])
def test_what_is_not_read(what):
    image = picture(4, 4, 1, 1)
    data = {"no image": b"GIF89a", "compression": tiff(image, more=[(259, ("H", [7]))]), "float": tiff(image, more=[(339, ("H", [3]))]), "predictor": tiff(image, more=[(317, ("H", [3]))]), "short": tiff(image)[:40]}[what]
    with pytest.raises((ValueError, KeyError, struct.error)):
        images.decode(data)


def png(image, filters):
    h, w, bands = image.shape
    raw = image.astype(image.dtype.newbyteorder(">")).tobytes()
    step = bands * image.itemsize
    line = w * step
    out, above = b"", bytes(line)
    for y in range(h):
        row = raw[y * line : y * line + line]
        how = filters[y % len(filters)]
        coded = bytearray()
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((v - (0, a, b, (a + b) // 2, near)[how]) & 255)
        out += bytes([how]) + bytes(coded)
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8 * image.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    z = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", z[:50]) + chunk(b"IDAT", z[50:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
@pytest.mark.parametrize("deep", [1, 2])
def test_png(bands, deep):
    image = picture(11, 13, bands, deep, bands)
    want = image if deep == 1 else (image >> 8).astype(np.uint8)
    assert np.array_equal(images.decode(png(image, [0, 1, 2, 3, 4])), want)


def test_pnm():
    image = picture(5, 6, 3, 2)
    assert np.array_equal(images.decode(b"P6\n# c\n6 5\n65535\n" + image.astype(">u2").tobytes()), image >> 8)


def test_images_as_rows(spark, tmp_path):
    image = picture(40, 30, 4, 2)
    (tmp_path / "a.tif").write_bytes(tiff(image, 5, ">", tile=(16, 16), predictor=2))
    (tmp_path / "b.tif").write_bytes(tiff(image[:10]))  # nothing is left below the cut
    (tmp_path / "c.tif").write_bytes(b"II nothing")
    rows = files.read_images(spark, str(tmp_path)).collect()
    got = sorted((r for r in rows if r.error is None), key=lambda r: r.y)
    assert np.array_equal(np.array([r.row for r in got]), (image >> 8)[files.CROP_TOP :, :, :3])
    assert sorted(r.path[-5:] for r in rows if r.error) == ["b.tif", "c.tif"]
