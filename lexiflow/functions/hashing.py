"""Seeded 32-bit string hashing, identical in Spark and in plain SQL engines.

``h(seed, x)`` is the first 32 bits of ``md5(seed || ':' || x)`` read as an
unsigned integer, so the value lies in ``[0, 2**32)`` and ``h % w`` needs no
sign fix. The same expression is writable in any SQL dialect with ``md5``,
which is what makes sketch and embedding results checkable by an oracle.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 1 << 14            # messages hashed at once
_MD5_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_MD5_TURN = [[np.uint32(x) for x in r] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]


def _seed_col(seed) -> Column:
    return seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))


def hash32(x: Column | str, seed) -> Column:
    """Seeded hash of a string column into ``[0, 2**32)`` as BIGINT."""
    x = F.col(x) if isinstance(x, str) else x
    digest = F.md5(F.concat(_seed_col(seed), F.lit(":"), x))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash32_words(words: list, seeds: list) -> np.ndarray:
    """(seeds, words) matrix of ``hash32``: one digest per seed and word, for the distinct words of an Arrow batch.

    Messages that fit one block of MD5 (at most 55 bytes) are hashed together, column by column; longer ones one by one."""
    out = np.zeros((len(seeds), len(words)), np.int64)
    heads = [np.frombuffer(f"{s}:".encode(), np.uint8) for s in seeds]
    room = 55 - max(map(len, heads), default=0)
    step = max(1, LANES // max(1, len(seeds)))
    for at in range(0, len(words), step):
        part = pa.array(words[at:at + step], pa.large_string())
        _, offsets, data = part.buffers()
        first = np.frombuffer(offsets, np.int64, len(part) + 1)
        size, data = np.diff(first), np.frombuffer(data or b"", np.uint8)
        short = np.flatnonzero(size <= room)
        if len(short) and seeds:
            place = np.arange(size[short].max())
            inside = place < size[short][:, None]
            text = np.where(inside, data[np.where(inside, first[short][:, None] + place, 0)], 0) if len(place) else np.zeros((len(short), 0), np.uint8)
            block = np.zeros((len(seeds), len(short), 64), np.uint8)
            for k, head in enumerate(heads):
                end = len(head) + size[short]
                block[k, :, :len(head)] = head
                block[k, :, len(head):len(head) + len(place)] = text
                block[k, np.arange(len(short)), end] = 0x80
                block[k, :, 56:58] = (8 * end).astype("<u2").view(np.uint8).reshape(-1, 2)
            out[:, at + short] = _md5_32(block.reshape(-1, 64)).reshape(len(seeds), len(short))
        for i in np.flatnonzero(size > room).tolist():
            out[:, at + i] = [int.from_bytes(hashlib.md5(f"{s}:{words[at + i]}".encode()).digest()[:4]) for s in seeds]
    return out


def _md5_32(block: np.ndarray) -> np.ndarray:
    """First 32 bits, big-endian, of the MD5 digests of padded blocks (n, 64): what the digest's first word needs, 61 of 64 steps."""
    m = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
    used = m.any(axis=1)
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f); np.bitwise_and(f, b, out=f); np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f); np.bitwise_and(f, d, out=f); np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f); np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f); np.bitwise_or(f, b, out=f); np.bitwise_xor(f, c, out=f)
        a += f
        a += _MD5_ADD[i]
        if used[g]:
            a += m[g]
        left = _MD5_TURN[i // 16][i % 4]
        np.left_shift(a, left, out=t); np.right_shift(a, np.uint32(32 - int(left)), out=a); np.bitwise_or(a, t, out=a)
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def bucket(x: Column | str, seed, width: int | Column) -> Column:
    """Bucket index ``h(seed, x) mod width``."""
    w = width if isinstance(width, Column) else F.lit(int(width))
    return F.pmod(hash32(x, seed), w.cast("bigint"))


def sign(x: Column | str, seed) -> Column:
    """+1 when the seeded hash is even, -1 otherwise (Count Sketch sign)."""
    return F.when(hash32(x, seed) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def score01(x: Column | str, seed="") -> Column:
    """Deterministic pseudo-random value in ``[0, 1)`` with 1e-3 resolution.

    With ``seed=""`` this is ``(h(x) % 1000) / 1000`` over the bare md5 of
    ``x`` (no seed prefix), the form used for synthetic confidence scores.
    """
    x = F.col(x) if isinstance(x, str) else x
    src = x.cast("string") if seed == "" else F.concat(_seed_col(seed), F.lit(":"), x.cast("string"))
    h = F.conv(F.substring(F.md5(src), 1, 8), 16, 10).cast("bigint")
    return (h % 1000) / F.lit(1000.0)
