"""Array kernels over Arrow text columns: words, digests and anchors.

All work on parts of a batch of bounded size (``slices``), a text longer than
that by itself.  Three kinds of names are used, each for one purpose:

* ``word_hashes`` and ``shingle_hashes`` chain eight bytes, or one word, at a
  time through a 64-bit mixing step that is not linear.  Words longer than
  ``LONG_WORD`` bytes are named by BLAKE2b.
* ``digests`` are 128 bits of BLAKE2b over the bytes themselves, for what is
  removed because it is equal to something else.
* Anchors (``anchors``) are picked and grouped by polynomial hashes; what shares
  one is still compared by digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd factor of the anchors' polynomial, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(FACTOR, -1, 1 << 64)
#: Start of the chains.
SEED = U64(0x2545F4914F6CDD1D)
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 512 << 10
#: Words above this many bytes are named by BLAKE2b.
LONG_WORD = 64

#: The white space between words: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: A 64-bit symbol for each byte.
BYTE_SYMBOL = scramble(np.arange(1, 257, dtype=U64) * U64(FACTOR))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and where each begins (n + 1
    places).  Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text
    is a part of its own."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    _, at = text_bytes(column)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and the word count before each text
    (n + 1 places)."""
    solid = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[at] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = solid[:-1]
    begins = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return begins, ends, np.searchsorted(begins, at)


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings [begin, end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(raw) + 1,), strides=(1,))
    size = ends - begins
    out = scramble(size.astype(U64) * U64(FACTOR) ^ SEED)
    at, left, rows = begins, size, slice(None)
    for _ in range(LONG_WORD // 8):
        out[rows] = scramble(out[rows] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    data = memoryview(raw)
    for k in rows.tolist():
        out[k] = int.from_bytes(blake2b(data[begins[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text; a text with fewer
    words, but some, has one of all its words.  Returns hashes and the number
    of them before each text (n + 1 places)."""
    counts = np.diff(first)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    base = np.concatenate([[0], np.cumsum(own)])
    text = np.repeat(np.arange(len(own)), own)
    begin = np.arange(base[-1]) - base[text] + first[text]
    held = np.minimum(counts, size)[text]
    out = scramble(held.astype(U64) * U64(FACTOR) ^ SEED)
    for k in range(size):
        some = held > k
        if some.all():
            out = scramble(out ^ words[begin + k])
        else:
            out[some] = scramble(out[some] ^ words[begin[some] + k])
    return out, base


def digests(data: bytes | memoryview, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of the byte strings [begin, end), two numbers a row."""
    view = memoryview(data)
    found = b"".join([blake2b(view[b:e], digest_size=16).digest() for b, e in zip(begins.tolist(), ends.tolist())])
    return np.frombuffer(found, dtype="<i8").reshape(-1, 2)


def spaced(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words one after another with one space after each: bytes, and each
    word's begin and end there.  Equal runs of words are equal strings."""
    size = ends - begins
    after = np.cumsum(size + 1)
    start = after - size - 1
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, dtype=np.uint8)
    shift = np.repeat(start - begins, size)
    source = np.arange(len(shift)) + np.repeat(begins - (np.cumsum(size) - size), size)
    out[source + shift] = raw[source]
    return out.tobytes(), start, start + size


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours; len(x) - width + 1 values."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[:-rest], x[rest:]) if rest else x


#: Windows whose anchors are picked at a time, and the low bits of an order that hold a place.
TILE = 1 << 16
PLACE_BITS = U64(18)
_PLACE = (U64(1) << PLACE_BITS) - U64(1)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    out[1:] = U64(factor)
    return np.multiply.accumulate(out)


#: Enough for the symbols of one tile with windows of up to TILE symbols.
_UP, _DOWN = _powers(FACTOR, 2 * TILE + 1), _powers(_INVERSE, 2 * TILE + 1)


def _picks(symbols: np.ndarray, window: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``symbols`` the place of its anchor, and its hash."""
    sums = np.zeros(len(symbols) + 1, dtype=U64)
    np.cumsum(symbols * _UP[: len(symbols)], out=sums[1:])
    runs = scramble((sums[inner:] - sums[:-inner]) * _DOWN[: len(symbols) - inner + 1])
    order = (scramble(runs) >> PLACE_BITS << PLACE_BITS) | np.arange(len(runs), dtype=U64)
    pick = (sliding_least(order, window - inner + 1) & _PLACE).astype(np.int64)
    return pick, runs[pick]


def anchors(symbols: np.ndarray, at: np.ndarray, window: int, inner: int) -> dict[str, np.ndarray]:
    """The windows of ``window`` symbols of every text, grouped by anchor.

    Every window picks the run of ``inner`` symbols in it whose hash is least
    (the leftmost of equals), which depends on its content alone: equal windows
    pick the same run at the same place.  Neighbouring windows with one pick
    are one row: text (index), start (first window, from the text's begin), n
    (windows), lead (symbols before the run) and name (hash of the run).
    """
    parts = []
    last = len(symbols) - window + 1
    counts = np.maximum(np.diff(at) - window + 1, 0)
    tile = 0
    while tile < last:
        end = min(last, tile + TILE)
        pick, name = _picks(symbols[tile : end + window - 1], window, inner)
        low, high = np.searchsorted(at, [tile, end - 1], side="right") - 1
        text = np.repeat(np.arange(low, high + 1), np.diff(np.clip(at[low : high + 2], tile, end)))
        inside = np.arange(tile, end) - at[text] < counts[text]
        head = inside.copy()
        head[1:] &= (pick[1:] != pick[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
        heads = np.flatnonzero(head)
        # The next tile begins with the last row, which may go on there.
        stop = end - tile
        if end < last and len(heads) > 1:
            stop, heads = int(heads[-1]), heads[:-1]
        if len(heads):
            size = np.diff(np.append(np.cumsum(inside)[heads], inside[:stop].sum() + 1))
            parts.append({"text": text[heads], "start": heads + tile - at[text[heads]], "n": size, "lead": pick[heads] - heads, "name": name[heads]})
        tile += stop
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "lead")} | {"name": np.zeros(0, U64)}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
