"""Token runs of texts as 64-bit hashes, computed on whole Arrow batches.

A batch's string buffer is worked on as one array of bytes: characters are classed by a table, token boundaries are
differences of the classes, a token's bytes are read as three machine words. No text is decoded and no loop runs over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.functions.text import MAX_TOKEN, MIN_TOKEN

LOW = np.zeros(256, dtype=np.uint8)  # lower-case byte of a token character, else 0
for _c in "abcdefghijklmnopqrstuvwxyz0123456789":
    LOW[ord(_c)] = LOW[ord(_c.upper())] = ord(_c)

_WORD_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
ROW_BITS, HASH_BITS = 14, 50


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[3]
    x ^= x >> np.uint64(29)
    x *= _ODD[4]
    x ^= x >> np.uint64(32)
    return x


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every kept token of a string array, in order; nulls have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    # the two other letters whose lower case holds an ASCII letter
    raw = texts.buffers()[2].to_pybytes() if len(texts) and texts.buffers()[2] else b""
    if b"\xe2\x84\xaa" in raw or b"\xc4\xb0" in raw:
        texts = pc.replace_substring(pc.replace_substring(texts, "K", "k"), "İ", "i̇")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    low = np.zeros(size + 32, dtype=np.uint8)
    if size:
        low[:size] = LOW[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    solid = low[: size + 1] != 0
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:]
    stop = solid[:-1] & (~solid[1:] | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(stop) + 1
    length = ends - starts
    kept = (length >= MIN_TOKEN) & (length <= MAX_TOKEN)
    starts, length = starts[kept], length[kept]
    words = np.ndarray(shape=(size + 24,), dtype="<u8", buffer=low.data, strides=(1,))
    h = (words[starts] & _WORD_MASK[np.minimum(length, 8)]) * _ODD[0]
    h ^= mix((words[starts + 8] & _WORD_MASK[np.clip(length - 8, 0, 8)]) * _ODD[1] + length.astype(np.uint64))
    h += (words[starts + 16] & _WORD_MASK[np.clip(length - 16, 0, 8)]) * _ODD[2]
    return np.searchsorted(offsets, starts, side="right") - 1, mix(h)


def run_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct runs of ``width`` successive tokens, sorted by row and hash (50 bits)."""
    most = (1 << ROW_BITS) - 1
    if len(texts) > most:  # row numbers are packed beside the hashes
        done = [(k, run_sets(texts[k : k + most], width)) for k in range(0, len(texts), most)]
        return np.concatenate([r + k for k, (r, _) in done]), np.concatenate([h for _, (_, h) in done])
    row, tok = token_hashes(texts)
    if len(row) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    m = len(row) - width + 1
    h = tok[:m].copy()
    for j in range(1, width):
        h = mix(h) + tok[j : j + m] * _ODD[j % 6]
    h = mix(h)
    whole = row[:m] == row[width - 1 :]
    packed = (row[:m][whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (h[whole] >> np.uint64(64 - HASH_BITS))
    packed.sort()
    if len(packed):
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    return (packed >> np.uint64(HASH_BITS)).astype(np.int64), packed & np.uint64((1 << HASH_BITS) - 1)
