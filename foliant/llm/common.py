"""What the training-data operators share: work tables, byte-level words and hashes."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from ..work import stored, workspace  # noqa: F401

U64 = np.uint64


def release() -> None:
    """Give the memory that this task has freed back to the system: Python workers wait for their next task beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --------------------------------------------------------------------------- bytes of a batch
def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column on end, and where each row begins (one more for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of the contracts: white space, and all of ASCII but digits and lower-case letters.
WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def word_bounds(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row): maximal runs of non-separators; none crosses a row's end."""
    inside = ~separators[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


# --------------------------------------------------------------------------- hashes
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_WEIGHTS: dict[int, np.ndarray] = {}


def weights(n: int, kind: int = 0) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same ones each time; another kind, other numbers."""
    have = _WEIGHTS.get(kind)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = mix(mix(np.arange(max(n, 1 << 12), dtype=np.uint64) + U64(0x632BE59BD9B4E019 * (kind + 1) % 2**64)) ^ U64(0x2545F4914F6CDD1D))
        if n <= 1 << 20:  # longer ones are rare and made anew
            _WEIGHTS[kind] = have
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18, kind: int = 0) -> np.ndarray:
    """64-bit hash of each span of raw (bytes or code points). Spans are sorted and don't overlap; done in blocks to
    stay in cache.

    The hash is multilinear: every place of a span has a random weight of its own, so spans of one length that differ
    share a hash once in 2**56 (2**43 for code points) whatever their contents; powers of one base, as weights modulo
    2**64, would not do that. Where that is not rare enough, kinds are independent of each other."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            s, e = starts[i:j] - a, ends[i:j] - a
            gaps = np.diff(np.append(s, b - a))
            place = np.arange(b - a) - np.repeat(s, gaps)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((raw[a:b].astype(np.uint64) + U64(1)) * weights(int(gaps.max()), kind)[place], out=sums[1:])
            out[i:j] = mix(sums[e] - sums[s] + mix((e - s).astype(np.uint64)))
            i = j
    return out


def gram_hashes(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-word shingle; a row of fewer words, but not none, gives its whole sequence."""
    rows = len(before) - 1
    counts = np.diff(before)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            full = full * U64(0x9FB21C651E98DF25) + words[k : k + len(full)]
        full = mix(full)
    row_of = np.repeat(np.arange(rows), counts)
    keep = row_of[: len(full)] == row_of[n - 1 :] if len(full) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    extra = np.empty(len(short), np.uint64)
    with np.errstate(over="ignore"):
        for at, r in enumerate(short):
            value = U64(counts[r])
            for w in words[before[r] : before[r + 1]]:
                value = value * U64(0xD6E8FEB86659FD93) + w
            extra[at] = value
    extra = mix(extra)
    return np.concatenate([full[keep], extra]), np.concatenate([row_of[: len(full)][keep], short])


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, on end, and where each row begins."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n_rows + 1))


def segment_sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum (modulo 2**64) of values[begins[i]:begins[i+1]]."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[begins[1:]] - sums[begins[:-1]]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in pieces of about that many bytes of text at most, of a row at least."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(size)
    while at < batch.num_rows:
        used = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, used + most, "right")))
        yield batch.slice(at, to - at)
        at = to
