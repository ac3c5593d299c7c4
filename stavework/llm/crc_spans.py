"""CRC-32 of many spans of a byte array at once, from a table of byte-by-distance contributions.

CRC-32 is affine over XOR: the checksum of a span of L bytes is the XOR of one contribution for each byte, which depends on the
byte and on its distance from the span's end only, and of a constant that depends on L only. Contributions are looked up in
a table of `DEPTH` distances and folded span by span with `bitwise_xor.reduceat`. A span longer than DEPTH is cut into
blocks from its end; the blocks' values are folded pair by pair, the earlier one moved on by the later one's bytes.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Distances from a span's end that the table holds, and bytes whose contributions are looked up together.
DEPTH, STRIP = 64, 1 << 19


def _position_table(depth: int) -> np.ndarray:
    """Contribution of each byte at each distance 0 .. depth - 1 from the end: what the byte's checksum differs by from a zero's."""
    return np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(1 + d)) for b in range(256)] for d in range(depth)], np.uint32)


_TABLE = _position_table(DEPTH)


def _mover(bits: np.ndarray) -> np.ndarray:
    """The four tables by byte of the linear map that sends bit i of a 32-bit value to bits[i]."""
    tables = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for bit in range(8):
            tables[part] ^= np.where(np.arange(256) >> bit & 1, bits[8 * part + bit], 0).astype(np.uint32)
    return tables


def _move(value: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][value & 255] ^ tables[1][value >> 8 & 255] ^ tables[2][value >> 16 & 255] ^ tables[3][value >> 24]


#: Maps that move a value on by 2**i zero bytes.
_movers: list[np.ndarray] = []


def _by_power(i: int) -> np.ndarray:
    while len(_movers) <= i:
        units = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = (units >> np.uint32(1)) ^ np.where(units & 1, np.uint32(0xEDB88320), np.uint32(0))
        if not _movers:
            for _ in range(7):
                one = (one >> np.uint32(1)) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
            _movers.append(_mover(one))
        else:
            _movers.append(_mover(_move(_move(units, _movers[-1]), _movers[-1])))
    return _movers[i]


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """The checksums of as many zero bytes: the start value moved on by each length, bit by bit."""
    value, left, i = np.full(len(lengths), 0xFFFFFFFF, np.uint32), lengths.copy(), 0
    while left.any():
        odd = (left & 1).astype(bool)
        value[odd] = _move(value[odd], _by_power(i))
        left >>= 1
        i += 1
    return value ^ np.uint32(0xFFFFFFFF)


_CONSTANTS = _length_constants(np.arange(DEPTH + 1))


def _contributions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span of 1 .. DEPTH bytes, a strip of spans at a time."""
    out, sizes = np.zeros(len(starts), np.uint32), ends - starts
    done = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff((done - sizes) // STRIP)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(starts)], strict=True):
        if a == b:
            continue
        first = np.cumsum(sizes[a:b]) - sizes[a:b]
        back = np.repeat(first + sizes[a:b] - 1, sizes[a:b]) - np.arange(sizes[a:b].sum())
        at = np.repeat(ends[a:b] - 1, sizes[a:b]) - back
        out[a:b] = np.bitwise_xor.reduceat(_TABLE.ravel()[back << 8 | data[at]], first)
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 (that of zlib) of data[start:end] for every span; spans may overlap, and empty ones have 0."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    out, sizes = np.zeros(len(starts), np.uint32), ends - starts
    short = np.flatnonzero((sizes > 0) & (sizes <= DEPTH))
    out[short] = _contributions(data, starts[short], ends[short]) ^ _CONSTANTS[sizes[short]]
    long = np.flatnonzero(sizes > DEPTH)
    if len(long):
        blocks = -(-sizes[long] // DEPTH)
        span = np.repeat(np.arange(len(long)), blocks)
        back = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))
        until = ends[long][span] - back * DEPTH
        value = _contributions(data, np.maximum(until - DEPTH, starts[long][span]), until)
        level = DEPTH.bit_length() - 1
        while len(span) > len(long):
            odd = (back & 1).astype(bool)
            value[odd] = _move(value[odd], _by_power(level))
            back >>= 1
            fresh = np.flatnonzero(np.diff(span, prepend=-1) | np.diff(back, prepend=-1))
            value, span, back = np.bitwise_xor.reduceat(value, fresh), span[fresh], back[fresh]
            level += 1
        out[long] = value ^ _length_constants(sizes[long])
    return out
