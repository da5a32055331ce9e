"""Vectorised byte and word kernels shared by the text operators.

Everything here works on the raw Arrow buffers of one slice of a column, a few
MB at a time, so a task's memory does not depend on the size of its partition.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first bytes of eight
PIECE = 1 << 16
LANES = 8  # words of more than 8 * LANES bytes are hashed by blake2b


def secret() -> bytes:
    """A key for one run: drawn on the driver, so that no text can be made to collide, and sent with the tasks, so that one that runs again does the same."""
    return secrets.token_bytes(16)


def chains(key: bytes) -> list[np.ndarray]:
    """Two hash functions of a key, independent of each other: odd factors for mix and fuse, and a start."""
    return [np.frombuffer(hashlib.blake2b(key, digest_size=48, salt=bytes([side])).digest(), np.uint64) | np.uint64(1) for side in range(2)]


def mix(h: np.ndarray, chain: np.ndarray | None = None) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    one, two = (np.uint64(0xD6E8FEB86659FD93),) * 2 if chain is None else chain[:2]
    h = h ^ (h >> np.uint64(32))
    h *= one
    h ^= h >> np.uint64(32)
    h *= two
    h ^= h >> np.uint64(32)
    return h


def fuse(a: np.ndarray, b: np.ndarray, chain: np.ndarray | None = None) -> np.ndarray:
    """One value of two in order. Shifts between the products leave no algebra in which unlike runs could cancel."""
    one, two = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)) if chain is None else chain[2:4]
    h = a * one
    h ^= h >> np.uint64(32)
    h += b
    h *= two
    h ^= h >> np.uint64(29)
    return h


def sequences(values: np.ndarray, *sizes: int, step: int = 1, chain: np.ndarray | None = None) -> list[np.ndarray]:
    """64 bits for each run of values that start ``step`` after each other, for each number of values in a run.

    Runs of 2, 4, 8 values are made of two halves each, and a run of any size of those, in about 2 * log2(size)
    passes. Two chains, each over values of its own, give 128 bits.
    """
    level, width = values, 1
    made: list = [None] * len(sizes)  # what each size has of its own so far, and how many values it stands for
    while True:
        for k, size in enumerate(sizes):
            n = len(values) - (size - 1) * step
            if size & width and n > 0:
                own, done = made[k] or (None, 0)
                part = level[done * step : done * step + n]
                made[k] = (part, width) if own is None else (fuse(own, part, chain), done + width)
        if width * 2 > max(sizes) or len(level) <= width * step:
            break
        level, width = fuse(level[: -width * step], level[width * step :], chain), width * 2
    return [mix(own[0], chain) if own else np.zeros(0, np.uint64) for own in made]


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))


def byte_windows(data: np.ndarray, *sizes: int, chain: np.ndarray | None = None) -> list[np.ndarray]:
    """64 bits for each window of bytes, for each size; a piece that the processor's cache holds at a time."""
    step = 8 if all(size % 8 == 0 for size in sizes) else 1  # eights that lie next to each other, or single bytes
    parts: list[list] = [[] for _ in sizes]
    start = np.uint64(0) if chain is None else chain[4]
    for begin in range(0, max(1, len(data)), PIECE):
        piece = data[begin : begin + PIECE + max(sizes) - 1]
        values = lanes(piece)[: max(0, len(piece) - 7)].astype(np.uint64) if step == 8 else piece.astype(np.uint64) + np.uint64(1)
        for own, made in zip(parts, sequences(mix(values ^ start, chain), *(size // step for size in sizes), step=step, chain=chain), strict=True):
            own.append(made[:PIECE])
    return [np.concatenate(own) for own in parts]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``limit`` bytes of text."""
    text = batch.column(column)
    if len(text) == 0:
        return
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1]
    start = 0
    while start < len(text):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(text))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset in them; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if large else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (one more at the end); space: which bytes lie between words."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = ink[edge]
    last[edge - 1] = ink[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, chain: np.ndarray | None = None) -> np.ndarray:
    """64 bits for each word, eight bytes a step; a long word's are a part of its blake2b."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    source = _LOWER[data] if lower else data
    lane, length = lanes(source), ends - starts
    h = mix(length.astype(np.uint64) + (np.uint64(0x9E3779B97F4A7C15) if chain is None else chain[4]), chain)
    live = np.flatnonzero(length <= 8 * LANES)
    for k in range(LANES):
        left = length[live] - 8 * k
        h[live] = mix(h[live] ^ (lane[starts[live] + 8 * k] & _KEEP[np.minimum(left, 8)]), chain)
        live = live[left > 8]
        if not len(live):
            break
    key = b"" if chain is None else chain[5:].tobytes()
    for k in np.flatnonzero(length > 8 * LANES).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(source[starts[k] : ends[k]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values (van Herk and Gil-Werman)."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array by planes, so that high zero bytes compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0
