"""MessagePack (its public specification) for mask files, arrays as maps with nd/type/shape/data."""

from __future__ import annotations

import struct

import numpy as np


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ValueError("the mask file ends early")
        part = self.data[self.at : self.at + n]
        self.at += n
        return part

    def number(self, form: str):
        return struct.unpack(">" + form, self.take(struct.calcsize(form)))[0]

    def value(self):
        b = self.number("B")
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return self.map(b & 15)
        if b < 0xA0:
            return [self.value() for _ in range(b & 15)]
        if b < 0xC0:
            return str(self.take(b & 31), "utf-8", "replace")
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in (0xC4, 0xC5, 0xC6):
            return bytes(self.take(self.number("BHI"[b - 0xC4])))
        if b in (0xCA, 0xCB):
            return self.number("fd"[b - 0xCA])
        if 0xCC <= b <= 0xD3:
            return self.number("BHIQbhiq"[b - 0xCC])
        if b in (0xD9, 0xDA, 0xDB):
            return str(self.take(self.number("BHI"[b - 0xD9])), "utf-8", "replace")
        if b in (0xDC, 0xDD):
            return [self.value() for _ in range(self.number("HI"[b - 0xDC]))]
        if b in (0xDE, 0xDF):
            return self.map(self.number("HI"[b - 0xDE]))
        raise ValueError(f"unsupported code {b:#x}")

    def map(self, n: int):
        out = {}
        for _ in range(n):
            k = self.value()
            out[k.decode() if isinstance(k, bytes) else k] = self.value()
        if out.get("nd") is True and "data" in out:
            kind = out["type"].decode() if isinstance(out["type"], bytes) else out["type"]
            return np.frombuffer(out["data"], np.dtype(kind)).reshape(out["shape"])
        return out


def unpack(data: bytes):
    return _Reader(data).value()


def _head(n: int, small: int, limit: int, codes: str, first: int) -> bytes:
    if n < limit:
        return bytes([small | n])
    for i, form in enumerate(codes):
        if n < 1 << 8 * struct.calcsize(form):
            return bytes([first + i]) + struct.pack(">" + form, n)
    raise ValueError("too long")


def pack(value) -> bytes:
    if value is None or isinstance(value, (bool, np.bool_)):
        return bytes([0xC0 if value is None else 0xC3 if value else 0xC2])
    if isinstance(value, (int, np.integer)):
        v = int(value)
        if -32 <= v < 128:
            return struct.pack(">b", v) if v < 0 else bytes([v])
        return b"\xd3" + struct.pack(">q", v) if v < 1 << 63 else b"\xcf" + struct.pack(">Q", v)
    if isinstance(value, (float, np.floating)):
        return b"\xcb" + struct.pack(">d", float(value))
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 0xA0, 32, "BHI", 0xD9) + raw
    if isinstance(value, (bytes, bytearray, memoryview)):
        return _head(len(value), 0, 0, "BHI", 0xC4) + bytes(value)
    if isinstance(value, np.ndarray):
        return pack({b"nd": True, b"type": value.dtype.str, b"kind": b"", b"shape": list(value.shape), b"data": np.ascontiguousarray(value).tobytes()})
    if isinstance(value, dict):
        return _head(len(value), 0x80, 16, "HI", 0xDE) + b"".join(pack(k) + pack(v) for k, v in value.items())
    return _head(len(value), 0x90, 16, "HI", 0xDC) + b"".join(map(pack, value))
