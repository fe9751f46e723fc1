"""Image files as arrays: TIFF in strips or tiles, PNG, PGM and PPM; 8 bits a band in the end.

TIFF: no compression, LZW, deflate and PackBits, horizontal predictor, bands interleaved or in
planes, 1, 8 and 16 bits, palettes, either byte order. Sixteen bits are cut to the upper eight.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags of the TIFF format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR = 273, 277, 278, 279, 284, 317
PALETTE, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 320, 322, 323, 324, 325, 339
#: Tag types (letter and bytes).
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count, then so many literal bytes, or one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bits on, 9 to 12 bits, grown one code early."""
    clear, end = 256, 257
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(first), [], b""
    width, bits, have = 9, 0, 0
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == clear:
            table, width, last = list(first), 9, b""
            continue
        if code == end:
            break
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        # the writer's table is one entry ahead of what a reader knows
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _tags(data: bytes, order: str) -> dict[int, tuple]:
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack(order + "HHI", data[entry : entry + 8])
        if kind in TYPES:
            form, size = TYPES[kind]
            place = entry + 8 if n * size <= 4 else struct.unpack(order + "I", data[entry + 8 : entry + 12])[0]
            tags[tag] = struct.unpack(f"{order}{n}{form}", data[place : place + n * size])
    return tags


def _block(raw: bytes, how: int, shape: tuple[int, int, int], bits: int, order: str, predictor: int) -> np.ndarray:
    """A strip or tile as rows x columns x bands; a short last one keeps the rows it has."""
    h, w, bands = shape
    if how == LZW:
        raw = unpack_lzw(raw)
    elif how in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif how == PACKBITS:
        raw = unpack_bits(raw)
    elif how != NONE:
        raise ValueError(f"TIFF compression {how} is not read")
    line = (w * bands * bits + 7) // 8
    rows = min(h, len(raw) // line)
    flat = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
    if bits == 1:
        return np.unpackbits(flat, axis=1)[:, : w * bands].reshape(rows, w, bands)
    values = flat.reshape(-1).view(np.dtype(np.uint16).newbyteorder(order)).astype(np.uint16) if bits == 16 else flat
    values = values.reshape(rows, w, bands)
    # differences along the row wrap around
    return np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values


def decode_tiff(data: bytes) -> np.ndarray:
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF image")
    tags = _tags(data, order)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    bands, planes = tags.get(BANDS, (1,))[0], tags.get(PLANES, (1,))[0]
    depth = set(tags.get(BITS, (1,)))
    if len(depth) != 1 or not depth <= {1, 8, 16} or set(tags.get(SAMPLE_FORMAT, (1,))) != {1}:
        raise ValueError("TIFF images of 1, 8 or 16 bits without sign are read")
    bits = depth.pop()
    how, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    if predictor not in (1, 2):
        raise ValueError(f"TIFF predictor {predictor} is not read")
    tiled = TILE_OFFSETS in tags
    high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(STRIP_ROWS, (height,))[0], height), width)
    starts, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    down, across = -(-height // high), -(-width // wide)
    deep = bands if planes == 1 else 1
    out = np.zeros((height, width, bands), np.uint16 if bits == 16 else np.uint8)
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, place = divmod(i, down * across)
        y, x = place // across * high, place % across * wide
        part = _block(data[start : start + size], how, (high, wide, deep), bits, order, predictor)
        part = part[: height - y, : width - x]
        at = slice(plane, plane + 1) if planes == 2 else slice(None)
        out[y : y + part.shape[0], x : x + part.shape[1], at] = part
    light = tags.get(PHOTOMETRIC, (1,))[0]
    if light == 3:
        colours = (np.array(tags[PALETTE]).reshape(3, -1) >> 8).astype(np.uint8)
        return np.moveaxis(colours[:, out[:, :, 0]], 0, -1)
    out = (out >> 8).astype(np.uint8) if bits == 16 else out * 255 if bits == 1 else out
    return 255 - out if light == 0 else out


def decode_png(data: bytes) -> np.ndarray:
    """A PNG that is not interlaced, 8 or 16 bits a band or a palette of 8."""
    at, body, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            width, height, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if laced or bits not in (8, 16):
        raise ValueError("PNG images of 8 or 16 bits without interlacing are read")
    step = bands * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.uint8)  # a row above and a pixel to the left of zeros
    for y, line in enumerate(lines, 1):
        how, values = int(line[0]), line[1:].reshape(width, step)
        up = out[y - 1]
        if how == 0:
            out[y, 1:] = values
        elif how == 1:
            out[y, 1:] = np.cumsum(values, axis=0, dtype=np.uint8)
        elif how == 2:
            out[y, 1:] = values + up[1:]
        else:
            for x in range(1, width + 1):
                left, above, corner = out[y, x - 1].astype(int), up[x].astype(int), up[x - 1].astype(int)
                guess = (left + above) // 2
                if how == 4:
                    far = np.abs(np.stack((above - corner, left - corner, left + above - 2 * corner)))
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
                out[y, x] = (values[x - 1] + guess) & 255
    image = out[1:, 1:].reshape(height, width, bands, -1)[:, :, :, 0]  # the upper byte of 16 bits
    return palette[image[:, :, 0]] if colour == 3 else np.ascontiguousarray(image)


def decode_pnm(data: bytes) -> np.ndarray:
    """A binary PGM or PPM."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    bands = 1 if data[:2] == b"P5" else 3
    if fields[2] > 255:
        wide = np.frombuffer(data, ">u2", fields[0] * fields[1] * bands, at + 1)
        return (wide >> 8).astype(np.uint8).reshape(fields[1], fields[0], bands)
    return np.frombuffer(data, np.uint8, fields[0] * fields[1] * bands, at + 1).reshape(fields[1], fields[0], bands)


def decode(data: bytes) -> np.ndarray:
    """An image file's rows x columns x bands, 8 bits each; what is not read is a ValueError."""
    if data[:2] in (b"P5", b"P6"):
        return decode_pnm(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] in (b"II", b"MM"):
        return decode_tiff(data)
    raise ValueError("not a TIFF, PNG, PGM or PPM image")
