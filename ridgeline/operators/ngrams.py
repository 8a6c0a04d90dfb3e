"""Word n-grams of whole texts in Arrow batches, by NumPy over bytes.

Hashes only find candidates: n-grams that pass are given as their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import BLANKS
from ..session import ship_package
from .bloom import Bloom

#: Bytes of text in work at a time; longer texts are read in parts that overlap by n - 1 words.
PART = 1 << 20
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[np.frombuffer(BLANKS.encode(), np.uint8)] = True


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grown(self, size: int) -> _Powers:
        if len(self.up) < size:
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, powers.cumprod(dtype=np.uint64))
        return self


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered bytes, and the hash of the n-gram
    that starts at each word but the last n - 1."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edge[::2], edge[1::2]
    powers = _POWERS.grown(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)]).cumsum(dtype=np.uint64)])
    word = _mixed((sums[ends] - sums[starts]) * powers.down[starts])
    many = max(len(starts) - n + 1, 0)
    h = np.zeros(many, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(_ODD) + word[k : k + many]
    return starts, ends, _mixed(h)


def _parts(texts: list[bytes | None], n: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and bytes of about PART in all; parts of one text overlap by
    n - 1 words."""
    rows: list[int] = []
    data: list[bytes] = []
    size = 0
    blanks = BLANKS.encode()
    for row, text in enumerate(texts):
        begin, reach, text = 0, PART, text or b""
        while begin < len(text):
            end = begin + reach
            while end < len(text) and text[end] not in blanks:
                end += 1
            piece = text[begin:end]
            if end < len(text):
                blank = _BLANK[np.frombuffer(piece, np.uint8)]
                starts = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)) < 0)
                if len(starts) < n:
                    reach *= 2
                    continue
            rows.append(row)
            data.append(piece)
            size += len(piece)
            if size >= PART:
                yield rows, data
                rows, data, size = [], [], 0
            if end >= len(text):
                break
            # The next part starts with the last n - 1 words of this one.
            begin, reach = (begin + int(starts[1 - n]) if n > 1 else end), PART
    if rows:
        yield rows, data


def found_grams(texts: DataFrame, n: int, bloom: Bloom | None = None, hashes: bool = False) -> DataFrame:
    """(id, gram) for each n-gram of the texts of (id, text) that the filter
    lets pass, its words joined by one space, A to Z in lower case; with the
    hash ``h`` if asked.  An n-gram may come more than once."""
    ship_package(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(bloom) if bloom else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data in _parts(batch.column("text").cast(pa.binary()).to_pylist(), n):
                joined = _LOWER[np.frombuffer(b" ".join(data), np.uint8)]
                starts, ends, h = gram_hashes(joined, n)
                limits = np.cumsum([len(d) + 1 for d in data])
                own = np.searchsorted(limits, starts, side="right")
                at = shared.value.holds(h) if shared else np.arange(len(h))
                at = at[own[at] == own[at + n - 1]]
                lowered = joined.tobytes()
                grams = [b" ".join(lowered[s:e] for s, e in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist())) for k in at.tolist()]
                cols = [batch.column("id").take(pa.array(np.asarray(rows)[own[at]] if len(at) else np.zeros(0, np.int64))), pa.array(grams, pa.binary()).cast(pa.string())]
                if hashes:
                    cols.append(pa.array(h[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "gram", "h"][: len(cols)])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, gram string" + (", h long" if hashes else ""))
