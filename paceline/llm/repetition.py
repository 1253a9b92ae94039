"""Repetition rules: how much of a text lies inside repeated word n-grams and lines.

For several n the hashes of all n-word windows come from one rolling recurrence
over the word hashes of a whole block.  A window that is repeated has repeated
shorter windows, so each n only looks at the places where n-1 found something.
The work is one pass over the rows without a shuffle.

Defined cases: null or empty text has no words and fails the base rule; a text
with fewer than n words has no n-gram; equal rows, ids repeated or null, give
equal results; a share that equals its limit passes; columns other than the text
and the kept ones are not read; an empty table gives an empty table; a very long
text is a block of its own, read whole.  Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B

#: Largest share of a text's word characters inside repeated windows of n words.
NGRAM_LIMITS = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: Largest share inside repeated lines, and of repeated lines among lines.
LINE_CHAR_LIMIT, LINE_LIMIT = 0.40, 0.40
MIN_LINES = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STEP = np.uint64(0xA0761D6478BD642F | 1)
_DOC = np.uint64(0xE7037ED1A0B428DB)


def measure(raw: np.ndarray, off: np.ndarray, ngrams: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Repetition figures of each document of a block."""
    n_docs = len(off) - 1
    starts, ends, wptr = B.words(raw, off)
    hasher = B.Hasher(raw)
    chars = (raw & 0xC0) != 0x80
    char_total = np.concatenate([[0], np.cumsum(chars)])
    word_chars_each = char_total[ends] - char_total[starts]
    n_words = np.diff(wptr)
    out = {"n_words": n_words, "word_chars": B.per_doc(word_chars_each, wptr), "n_symbols": B.per_doc(_SYMBOL[raw], off)}

    breaks = np.flatnonzero(raw == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))  # an empty document has a line of no bytes
    line_end = np.sort(np.concatenate([off[1:], breaks]))
    line_doc = np.searchsorted(off[1:], line_end, "left") if n_docs else np.zeros(0, np.int64)
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    again, later = B.repeated(B.mix(hasher(line_start, line_end) + line_doc.astype(np.uint64) * _DOC))
    lptr = np.searchsorted(line_doc, np.arange(n_docs + 1))
    line_chars = char_total[line_end] - char_total[line_start]
    out["n_lines"] = np.diff(lptr)
    out["n_dup_lines"] = B.per_doc(later, lptr)
    out["dup_line_chars"] = B.per_doc(np.where(later, line_chars, 0), lptr)
    out["line_chars"] = B.per_doc(line_chars, lptr)

    word_hash = hasher(starts, ends)
    doc = np.repeat(np.arange(n_docs), n_words)
    limit = wptr[1:][doc]  # where the document's words end
    place, gram = np.arange(len(starts)), word_hash.copy()
    for n in range(2, max(ngrams) + 1):
        fits = place + n <= limit[place]
        place, gram = place[fits], gram[fits] * _STEP + word_hash[place[fits] + n - 1]
        if n < min(ngrams):
            continue
        found, _ = B.repeated(B.mix(gram + doc[place].astype(np.uint64) * _DOC))
        place, gram = place[found], gram[found]
        inside = B.covered(place, n, len(starts))
        out[f"dup_{n}gram_words"] = B.per_doc(inside, wptr)
        out[f"dup_{n}gram_chars"] = B.per_doc(np.where(inside, word_chars_each, 0), wptr)
    return out


def verdict(m: dict[str, np.ndarray], limits: dict[int, float] = NGRAM_LIMITS) -> np.ndarray:
    """False where the repeated share is above a limit."""
    ok = (m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["line_chars"]) | (m["n_lines"] < MIN_LINES)
    ok &= (m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"]) | (m["n_lines"] < MIN_LINES)
    for n, most in limits.items():
        ok &= m[f"dup_{n}gram_chars"] <= most * m["word_chars"]
    return ok


def repetition_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: dict[int, float] | None = None) -> DataFrame:
    """The `keep` columns, every repetition figure (long) and `repetition_ok` of each row."""
    limits = limits or NGRAM_LIMITS
    ngrams = tuple(sorted({8, *limits}))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "line_chars"]
    names += [f"dup_{n}gram_{x}" for n in range(min(ngrams), max(ngrams) + 1) for x in ("words", "chars")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, off = B.text_bytes(part.column(len(keep)))
            for i, j, data, cuts in B.blocks(raw, off):
                m = measure(data, cuts, ngrams)
                arrays = [part.column(k).slice(i, j - i) for k in range(len(keep))]
                arrays += [pa.array(m[x].astype(np.int64)) for x in names] + [pa.array(verdict(m, limits))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *names, "repetition_ok"])

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, " + ", ".join(f"{x} long" for x in names) + ", repetition_ok boolean")
