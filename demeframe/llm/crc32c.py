"""CRC-32C of many byte strings at once, in NumPy.

All strings are cut into segments of equal length that advance side by side;
the segments' remainders are then joined, since appending a fixed number of
bytes acts on a remainder as a linear map.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The Castagnoli polynomial (reflected), and the constant of the mask.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
#: Pairs of bytes in one segment.
SEGMENT = 256


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder after one byte, and after two."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1)).astype(np.uint32)
    two = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        two = one[two & 0xFF] ^ (two >> np.uint32(8))
    return one, two


@lru_cache(40)
def _append(power: int) -> np.ndarray:
    """Four tables of 256: a remainder's change when 2**power zero bytes follow."""
    one, _ = _tables()
    out = np.empty((4, 256), np.uint32)
    for k in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        out[k] = one[x & 0xFF] ^ (x >> np.uint32(8)) if power == 0 else _moved(_moved(x, power - 1), power - 1)
    return out


def _moved(crc: np.ndarray, power: int) -> np.ndarray:
    t = _append(power)
    return t[0][crc & 0xFF] ^ t[1][crc >> 8 & 0xFF] ^ t[2][crc >> 16 & 0xFF] ^ t[3][crc >> 24]


def crc32c(strings: list[bytes]) -> np.ndarray:
    """CRC-32C of each string, as uint32."""
    if not strings:
        return np.empty(0, np.uint32)
    _, two = _tables()
    width = 2 * SEGMENT
    sizes = np.array([len(s) for s in strings], np.int64)
    parts = -(-sizes // width)
    # zeros in front leave a remainder of zero as it is, so each string is filled up in front
    data = np.frombuffer(b"".join(x for s, n, p in zip(strings, sizes, parts, strict=True) for x in (bytes(int(p) * width - int(n)), s)), "<u2").reshape(-1, SEGMENT)
    crc = np.zeros(len(data), np.uint32)
    columns = np.ascontiguousarray(data.T)
    for step in columns:
        crc = two[(crc ^ step) & 0xFFFF] ^ (crc >> np.uint32(16))
    first = np.cumsum(parts) - parts
    out = np.zeros(len(strings), np.uint32)
    power = width.bit_length() - 1
    live = np.flatnonzero(parts > 0)
    k = 0
    while len(live):
        out[live] = _moved(out[live], power) ^ crc[first[live] + k]
        k += 1
        live = live[parts[live] > k]
    start = np.full(len(strings), 0xFFFFFFFF, np.uint32)
    for bit in range(int(sizes.max()).bit_length()):
        on = np.flatnonzero(sizes >> bit & 1)
        start[on] = _moved(start[on], bit)
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that a checksum of data with checksums in it stays sound."""
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)
