"""Array helpers for work inside a task: texts of an Arrow batch as one byte array, its words, and hashes of both.

Everything works on pieces of about `PIECE_BYTES`, so a worker's memory doesn't follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
#: Places that sliding_argmin numbers at once (24 bits).
PLACES = 1 << 24
#: ASCII white space, the separators of words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of a public mixing function)."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Bytes of a word beyond which word_hashes takes a cryptographic hash.
LONG_WORD = 64
#: Of an odd base (fixed value), and of its inverse modulo 2**64; a worker keeps the longest powers asked for.
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least `size` powers of the base and of its inverse. Seeds differ in what they make of a byte, not in the base."""
    if not _POWERS or len(_POWERS[0]) <= size:
        n = (size // (1 << 18) + 1) << 18
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: equal bytes, equal hash, wherever they stand.

    A polynomial over the mixed eight bytes at each place of the span. Over single bytes it would be the same for some unlike words of 1,024 letters, whatever
    the seed, since powers of an odd base are close to 1 modulo powers of two; mixed overlapping bytes don't cancel out like that.
    """
    (up, down), eights, size = _powers(len(data)), _eights(data), ends - starts
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(eights, seed + 1) * up[: len(data)], out=sums[1:])
        long = size >= 8
        h = (sums[np.where(long, ends - 7, starts)] - sums[starts]) * down[starts]
        few = np.flatnonzero(~long & (size > 0))
        h[few] = mix(eights[starts[few]] & ((_U(1) << (size[few] * 8).astype(np.uint64)) - _U(1)), seed + 2)
        return mix(h + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15), seed)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """span_hashes for words, which may be of any length: those of over LONG_WORD bytes get a keyed BLAKE2.

    Over thousands of places powers of an odd base repeat modulo 2**64, so that unlike words can be made of a few blocks that hash alike; 57 places are too few for that.
    """
    h = span_hashes(data, starts, ends, seed)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        raw, key = data.tobytes(), seed.to_bytes(8, "little")
        digests = [blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        h[long] = np.frombuffer(b"".join(digests), "<u8")
    return h


def window_hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    starts = np.arange(max(0, len(data) - width + 1))
    return span_hashes(data, starts, starts + width, seed)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about PIECE_BYTES of text; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + PIECE_BYTES, "right")) - 1)
        b = min(b, len(texts))
        yield batch.slice(a, b - a), raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row where its words begin (one more entry at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = IS_SPACE[data]
    after, before = np.empty(n, bool), np.empty(n, bool)
    after[0], after[1:] = True, space[:-1]
    before[-1], before[:-1] = True, space[1:]
    full = off[:-1][off[1:] > off[:-1]]
    after[full] = True
    before[full[1:] - 1] = True
    starts, ends = np.flatnonzero(~space & after), np.flatnonzero(~space & before) + 1
    return starts, ends, np.searchsorted(starts, off)


def chain(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of every k consecutive entries of h."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _U(0xD6E8FEB86659FD93) + h[i : i + n], seed)
    return out


def rows_of(first: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of n entries, given where each row's begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the first smallest one (by the leading 40 bits).

    Places take 24 bits, so longer arrays are taken in slices of fewer than `PLACES`, which overlap by a window.
    """
    n = max(0, len(values) - w + 1)
    step = PLACES - w
    if n <= step:
        return _argmin_slice(values, w)
    out = np.empty(n, np.int64)
    for a in range(0, n, step):
        out[a : a + step] = _argmin_slice(values[a : a + step + w - 1], w) + a
    return out


def _argmin_slice(values: np.ndarray, w: int) -> np.ndarray:
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    low = _U((1 << 24) - 1)
    x = (values & ~low) | np.arange(n, dtype=np.uint64)
    pad = (-n) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)


def anchored_runs(grams: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups the windows of `width` tokens by their anchor, the window's `gram` tokens with the least hash.

    grams: the hash of the `gram` tokens from each place on; first: where each row's tokens begin. Returns for each run of
    consecutive windows of one row with one anchor: row, first window, last window, anchor's place. Windows with the same tokens
    have anchors with the same tokens, wherever they stand.
    """
    total = int(first[-1])
    if total < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = sliding_argmin(grams, width - gram + 1)
    row = rows_of(first, total)[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + width <= first[1:][row])
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    a, r = at[inside], row[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    stop = np.concatenate([start[1:], [len(inside)]]) - 1
    return r[start], inside[start], inside[stop], a[start]


def token_span_hashes(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """span_hashes over an array of token hashes: a polynomial over mixed neighbours."""
    (up, down), size = _powers(len(tokens)), ends - starts
    with np.errstate(over="ignore"):
        mixed = mix(tokens, seed)
        pairs = mix(mixed * _U(0xD6E8FEB86659FD93) + np.concatenate([mixed[1:], np.zeros(1, np.uint64)])[: len(mixed)], seed)
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(pairs * up[: len(tokens)], out=sums[1:])
        long = size >= 2
        h = (sums[np.where(long, ends - 1, starts)] - sums[starts]) * down[starts]
        one = np.flatnonzero(size == 1)
        h[one] = mixed[starts[one]]
        return mix(h + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15), seed)


def pack(x: np.ndarray, delta: bool = False) -> bytes:
    """An array's bytes by planes, so that the shuffle's compression finds the empty ones; delta: of the differences."""
    if delta and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    n = len(data) // width
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)
    return np.cumsum(x, dtype=dtype) if delta else x
