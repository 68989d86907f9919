"""Decoding of the parts of containers: variable-length integers, the range-coded block codec, bits."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

_LOW = 1 << 23  # fixed value: a state below it takes another byte
_TOTAL_BITS = 12  # fixed value: frequencies add up to 4096


class Bytes:
    """A stream of bytes that is read from the front."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise IndexError("stream is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def until(self, stop: int) -> bytes:
        end = self.data.index(stop, self.at)
        out, self.at = self.data[self.at : end], end + 1
        return out

    def itf8(self) -> int:
        """A signed number of 32 bits in one to five bytes: leading ones count the bytes that follow."""
        first = self.byte()
        if first < 0x80:
            return first
        if first < 0xC0:
            return (first & 0x3F) << 8 | self.byte()
        if first < 0xE0:
            return (first & 0x1F) << 16 | int.from_bytes(self.take(2), "big")
        if first < 0xF0:
            return (first & 0x0F) << 24 | int.from_bytes(self.take(3), "big")
        rest = self.take(4)
        value = (first & 0x0F) << 28 | int.from_bytes(rest[:3], "big") << 4 | rest[3] & 0x0F
        return value - (1 << 32) if value >> 31 else value

    def ltf8(self) -> int:
        """A signed number of 64 bits in one to nine bytes."""
        first = self.byte()
        more = next((k for k in range(8) if not first & (0x80 >> k)), 8)
        value = (first & (0x7F >> more) if more < 7 else 0) << 8 * more | int.from_bytes(self.take(more), "big")
        return value - (1 << 64) if value >> 63 else value

    def numbers(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


class Bits:
    """A stream of bits, the highest of a byte first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def ones(self) -> int:
        n = 0
        while self.take(1):
            n += 1
        return n

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


@functools.lru_cache(1 << 16)
def itf8(value: int) -> bytes:
    """The shortest form of a number of 32 bits."""
    value &= 0xFFFFFFFF
    for more in range(4):
        if value >> (7 * (more + 1)) == 0:
            return (value | ((0xFF00 >> more) & 0xFF) << 8 * more).to_bytes(more + 1, "big")
    return bytes([0xF0 | value >> 28, value >> 20 & 0xFF, value >> 12 & 0xFF, value >> 4 & 0xFF, value & 0x0F])


def ltf8(value: int) -> bytes:
    """The shortest form of a number of 64 bits."""
    value &= (1 << 64) - 1
    for more in range(8):
        if value >> (7 * (more + 1)) == 0:
            return (value | ((0xFF00 >> more) & 0xFF) << 8 * more).to_bytes(more + 1, "big")
    return b"\xff" + value.to_bytes(8, "big")


def _listed(stream: Bytes) -> Iterator[int]:
    """Symbols in rising order: a symbol behind its neighbour is followed by the length of the run. The
    consumer reads what belongs to a symbol before it asks for the next."""
    symbol, run = stream.byte(), 0
    while True:
        yield symbol
        if run:
            run, symbol = run - 1, symbol + 1
            continue
        following = stream.byte()
        if following == 0:
            return
        if following == symbol + 1:
            run = stream.byte()
        symbol = following


def _frequencies(stream: Bytes) -> tuple[list[int], list[int], bytes]:
    """(frequency, first slot of each symbol, symbol of each slot)."""
    freq, first, slots, total = [0] * 256, [0] * 256, bytearray(1 << _TOTAL_BITS), 0
    for s in _listed(stream):
        f = stream.byte()
        if f >= 0x80:
            f = (f & 0x7F) << 8 | stream.byte()
        f = f or 1 << _TOTAL_BITS
        freq[s], first[s] = f, total
        slots[total : total + f] = bytes([s]) * f
        total += f
    return freq, first, bytes(slots)


def rans(data: bytes) -> bytes:
    """A block of the codec of four interleaved states, with or without the byte before as context."""
    order, _, size = struct.unpack_from("<BII", data)
    stream = Bytes(data, 9)
    if not size:
        return b""
    tables = {c: _frequencies(stream) for c in _listed(stream)} if order else {0: _frequencies(stream)}
    states = list(struct.unpack("<4I", stream.take(16)))
    out, at, mask = bytearray(size), stream.at, (1 << _TOTAL_BITS) - 1
    quarter = size // 4
    places = [(j, j * quarter + i) for i in range(quarter) for j in range(4)] + [(3, k) for k in range(4 * quarter, size)] if order else [(k & 3, k) for k in range(size)]
    contexts = [0] * 4
    for j, k in places:
        freq, first, slots = tables[contexts[j]]
        state = states[j]
        symbol = out[k] = slots[state & mask]
        state = freq[symbol] * (state >> _TOTAL_BITS) + (state & mask) - first[symbol]
        while state < _LOW and at < len(data):
            state = state << 8 | data[at]
            at += 1
        states[j] = state
        if order:
            contexts[j] = symbol
    return bytes(out)
