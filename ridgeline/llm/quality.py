"""Line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate), failing
lines go, and a document that loses too much of its text is rejected.  Base
statistics reject very short and very repetitive documents first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .batches import map_batches

#: Fixed values of the base statistics.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Phrases of boilerplate and navigation lines in the languages of
#: the corpus (en, de, fr, es), ASCII letters in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "licensed under the", "released under the", "terms of service",
    "terms of use", "privacy policy", "cookie policy", "accept cookies", "subscribe to our newsletter",
    "alle rechte vorbehalten", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "aceptar cookies",
)
NAVIGATION = (
    "back to top", "skip to content", "next page", "previous page", "read more", "sign in", "log in", "main menu",
    "zum seitenanfang", "zum inhalt springen", "mehr lesen", "weiterlesen", "nächste seite", "vorherige seite",
    "haut de page", "aller au contenu", "lire la suite", "page suivante", "se connecter",
    "volver arriba", "saltar al contenido", "leer más", "página siguiente", "iniciar sesión",
)


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules.

    A line fails if: it holds ``noise_marks`` or more of the marks
    ``SYMBOLS + "!"`` and one for every two words at least; or it has under
    ``short_words`` words and does not end in a mark of ``ends``; or it has up
    to ``phrase_words`` words and a boilerplate or navigation phrase.  A
    document is rejected if over ``lost_percent`` of its words are in failing
    lines.
    """

    noise_marks: int = 3
    short_words: int = 4
    phrase_words: int = 20
    lost_percent: int = 50
    ends: str = ".!?:;\"')]"


RULES = LineRules()
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, kept_text string"


def _lut(chars: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[[ord(c) for c in chars]] = True
    return found


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def _named(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each string between neighbouring places; equal strings, and
    only they, have equal numbers."""
    strings = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number below the rows' count for each pair (x, y)."""
    return np.unique(x * (y.max(initial=0) + 1) + y, return_inverse=True)[1]


def document_stats(column: pa.Array, rules: LineRules, keep_text: bool) -> dict[str, np.ndarray | list]:
    """Base statistics and line verdicts of all texts of a column."""
    plain, begin = K.text_bytes(column)
    n = len(column)
    # Every text, and so its last line, ends in a line break of its own: no
    # word, line or phrase reaches into the next text.
    at = begin + np.arange(n + 1)
    raw = np.full(at[-1], 0x0A, dtype=np.uint8)
    raw[np.arange(len(plain)) + np.repeat(np.arange(n), np.diff(begin))] = plain
    begins, ends, first = K.word_bounds(raw, at)
    words = np.diff(first)
    out: dict[str, np.ndarray | list] = {"n_words": words}
    points = _sums((raw & 0xC0) != 0x80)
    in_words = np.concatenate([[0], np.cumsum(points[ends] - points[begins])])
    out["word_chars"] = in_words[first[1:]] - in_words[first[:-1]]
    symbols = _sums(_lut(SYMBOLS)[raw])
    out["n_symbols"] = symbols[at[1:]] - symbols[at[:-1]]

    # Words in 3-word windows that are found again in the same text.
    doc_of_word = np.repeat(np.arange(n), words)
    ids = _named(raw[~K.SPACE[raw]], np.concatenate([[0], np.cumsum(ends - begins)]))
    windows = np.flatnonzero(doc_of_word[2:] == doc_of_word[:-2]) if len(ids) > 2 else np.zeros(0, np.int64)
    keys = _both(_both(_both(ids[windows], ids[windows + 1]), ids[windows + 2]), doc_of_word[windows])
    hit = windows[np.bincount(keys)[keys] > 1]
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    repeat = _sums(covered)
    out["n_repeat_words"] = repeat[first[1:]] - repeat[first[:-1]]

    line_end = np.flatnonzero(raw == 0x0A)
    line_begin = np.concatenate([[0], line_end + 1])[:-1]
    doc_of_line = np.searchsorted(at, line_begin, side="right") - 1
    low, high = np.searchsorted(begins, line_begin), np.searchsorted(begins, line_end)
    line_words = high - low
    held = line_words > 0
    solid = np.flatnonzero(held)
    lines = _both(_named(raw, np.append(line_begin, len(raw)))[solid], doc_of_line[solid])
    before = np.unique(lines, return_index=True)[1][lines] != np.arange(len(lines))
    out["n_dup_lines"] = np.bincount(doc_of_line[solid[before]], minlength=n)

    noise = _sums(_lut(SYMBOLS + "!")[raw])
    marks = noise[line_end] - noise[line_begin]
    fails = held & (marks >= rules.noise_marks) & (2 * marks >= line_words)
    last = raw[ends[np.maximum(high - 1, 0)] - 1] if len(ends) else np.zeros(len(held), np.uint8)
    fails |= held & (line_words < rules.short_words) & ~_lut(rules.ends)[last]
    phrases = re.compile("|".join(map(re.escape, BOILERPLATE + NAVIGATION)).encode())
    said = [m.start() for m in phrases.finditer(K.LOWER[raw].tobytes())]
    named = np.zeros(len(held), dtype=bool)
    named[np.searchsorted(line_begin, said, side="right") - 1] = True
    fails |= held & named & (line_words <= rules.phrase_words)
    out["lost_words"] = np.bincount(doc_of_line[fails], weights=line_words[fails], minlength=n).astype(np.int64)
    if keep_text:
        data, kept = raw.tobytes(), [[] for _ in range(n)]
        for d, b, e in zip(doc_of_line[~fails].tolist(), line_begin[~fails].tolist(), line_end[~fails].tolist()):
            kept[d].append(data[b:e])
        out["kept_text"] = [b"\n".join(x).decode() for x in kept]
    else:
        out["kept_text"] = [None] * n
    return out


def clean_lines(docs: DataFrame, rules: LineRules = RULES, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Statistics, verdict and cleaned text of every row of ``docs``.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lost_words, base_failed, kept and, with ``keep_text``,
    kept_text (the lines that passed).  Null and empty texts have no words and
    so fail the base.  Repeated rows each return a row; rows with a null id
    keep it; an empty table returns none.  A text that meets a bound exactly is
    kept.  Words and lines are compared by their bytes, within a text alone.
    Other columns are ignored.  No shuffle; memory holds half a MB of text, or
    one text where that is longer.
    """
    names = [f.split()[0] for f in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                stats = document_stats(part.column("own_text"), rules, keep_text)
                arrays = [pa.array(stats[k], pa.string() if k == "kept_text" else pa.int64()) for k in names]
                yield pa.RecordBatch.from_arrays([part.column("own_id"), *arrays], names=["own_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text")), run, f"own_id {kind}, {STATS}")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * F.col("lost_words") > rules.lost_percent * F.col("n_words")
    found = found.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~lost)
    return found.select(F.col("own_id").alias(id_col), *names[:-1], "base_failed", "kept", *(["kept_text"] if keep_text else []))


WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = "|".join(re.escape(p).replace(r"\ ", " ").replace("'", "''") for p in BOILERPLATE + NAVIGATION)

#: The same in DuckDB SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (
  SELECT doc_id, t, ws, len(ws) AS n, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(ws[i:i+2], ' ')) AS g FROM d),
again AS (
  SELECT doc_id, g3, list(i) AS places FROM (SELECT doc_id, unnest(g) AS g3, unnest(range(1, len(g) + 1)) AS i FROM w)
  GROUP BY doc_id, g3 HAVING count(*) > 1),
hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, unnest(places) AS i FROM again), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '{WORD}')) AS lw, len(regexp_extract_all(line, '[#*$%&|<>!]')) AS marks
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
judged AS (
  SELECT *, (marks >= {RULES.noise_marks} AND 2 * marks >= lw)
    OR (lw < {RULES.short_words} AND NOT regexp_matches(line, '[.!?:;"'')\]][\x20\x09-\x0D]*$'))
    OR (lw <= {RULES.phrase_words} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}')) AS fails,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup
  FROM lines WHERE lw > 0),
l AS (
  SELECT doc_id, sum(lw) FILTER (fails) AS lost, count(*) FILTER (dup) AS n_dup_lines FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, length(array_to_string(d.ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(hit.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(l.lost, 0)::BIGINT AS lost_words,
  len(d.ws) < {MIN_WORDS} OR 100 * coalesce(hit.n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(d.ws) AS base_failed,
  NOT (len(d.ws) < {MIN_WORDS} OR 100 * coalesce(hit.n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(d.ws)
    OR 100 * coalesce(l.lost, 0) > {RULES.lost_percent} * len(d.ws)) AS kept
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN l USING (doc_id)
"""
