"""A reader and writer of the compact protocol that parquet footers are kept in.

A struct is a dict of field number to (type, value); lists and sets are
(element type, values); everything that is read is written back alike, so that
fields this code does not know survive a rewrite.
"""

from __future__ import annotations

import struct

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("footer ends early")
        self.at += n
        return out

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return self.take(1)[0] == 1
        if kind == BYTE:
            return self.take(1)[0]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return struct.unpack("<d", self.take(8))[0]
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = head >> 4
            n = self.varint() if n == 15 else n
            return head & 15, [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.take(1)[0] if n else 0
            return kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown type {kind}")

    def struct(self) -> dict[int, tuple]:
        out, field = {}, 0
        while head := self.take(1)[0]:
            kind = head & 15
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            out[field] = (kind, kind == TRUE) if kind in (TRUE, FALSE) else (kind, self.value(kind))
        return out


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> bytes:
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def dump(kind: int, v) -> bytes:
    if kind in (TRUE, FALSE):
        return b"\x01" if v else b"\x02"
    if kind == BYTE:
        return bytes([v])
    if kind in (I16, I32, I64):
        return zigzag(v)
    if kind == DOUBLE:
        return struct.pack("<d", v)
    if kind == BINARY:
        return varint(len(v)) + v
    if kind in (LIST, SET):
        inner, values = v
        head = bytes([len(values) << 4 | inner]) if len(values) < 15 else bytes([0xF0 | inner]) + varint(len(values))
        return head + b"".join(dump(inner, x) for x in values)
    if kind == MAP:
        kinds, values = v
        return varint(len(values)) + (bytes([kinds]) if values else b"") + b"".join(dump(kinds >> 4, a) + dump(kinds & 15, b) for a, b in values)
    return dump_struct(v)


def dump_struct(s: dict[int, tuple]) -> bytes:
    out, last = bytearray(), 0
    for field in sorted(s):
        kind, v = s[field]
        if kind in (TRUE, FALSE):
            kind = TRUE if v else FALSE
        step = field - last
        out += bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + zigzag(field)
        if kind not in (TRUE, FALSE):
            out += dump(kind, v)
        last = field
    return bytes(out + b"\x00")
