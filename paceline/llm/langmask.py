"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit per language in every slot, so that one
lookup of an n-gram (the AND of its slots) returns all languages that hold it.
Fitting counts the n-grams of labelled texts on Spark and puts an n-gram into
the filter of every language in which its rate is not much below its highest
rate.  A text is decided by the number of its n-grams in each language
(popcounts of the masks' bit slices), corrected for the filter's false
positives, which follow from how full each language's slice is.

n-grams are windows of bytes of the lower-cased text, in which everything but
letters is a space, and hold at most one space.

The filter has slots in proportion to the n-grams of the fitted rows and as many
words in each as the languages need, so neither is cut off.

Defined cases: null text, and text without a letter, is `und`; text whose
n-grams no language holds gets the commonest learned language with score 0;
ties go to the language first by code point; equal texts get equal results,
repeated rows and null ids too; extra columns are not read; an empty table gives
an empty table; a very long text is a block of its own, read whole.  Fitting
needs one labelled row, else every prediction is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .sampling import bounded_sample

GRAM = 4
HASHES = 2
#: Slots of the filter for each n-gram of each language; their number is a power of two between these.
SLOTS_PER_GRAM, LEAST_LOG2, MOST_LOG2 = 12, 16, 24
#: Occurrences in the fitted texts from which on an n-gram counts.
LEAST_SEEN = 3
#: Labelled rows to fit on, at most.
FIT_ROWS = 20_000
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate.
RATE_SHARE = 0.2

_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(0xC3, 256)) + list(range(0x80, 0xC0))] = True


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (packed bytes) of each text and n+1 offsets into them."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    pad = pa.scalar(" ", pa.large_string())
    raw, off = B.text_bytes(pc.binary_join_element_wise(pad, lower, pad, pa.scalar("", pa.large_string())))
    letter = _LETTER[raw]
    clean = np.where(letter, raw, 32).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    gram, ink = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for k in range(GRAM):
        gram |= clean[k : k + n] << np.uint64(8 * k)
        ink += letter[k : k + n]
    good = ink >= GRAM - 1
    for k in range(1, GRAM):  # windows over the end of a text
        cut = off[1:] - k
        good[cut[(cut >= 0) & (cut < n)]] = False
    place = np.flatnonzero(good)
    return gram[place], np.searchsorted(place, off)


def _slots(grams: np.ndarray, log2: int) -> list[np.ndarray]:
    h = B.mix(grams + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << log2) - 1)
    return [((h >> np.uint64(24 * k)) & low).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    default: str
    masks: np.ndarray  # slots x words, one bit per language

    def false_rates(self) -> np.ndarray:
        """Chance that a language holds an n-gram that was never put in."""
        full = [np.count_nonzero(self._bit(self.masks, k)) / len(self.masks) for k in range(len(self.languages))]
        return np.array(full) ** HASHES

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        """The bit slice of language k."""
        kind = masks.dtype.type
        return (masks[:, k // 64] >> kind(k % 64)) & kind(1)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Mask of the languages that hold each n-gram."""
        first, *rest = _slots(grams, len(self.masks).bit_length() - 1)
        out = self.masks[first]
        for slot in rest:
            out &= self.masks[slot]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        rates = self.false_rates()
        sizes, cuts = B.text_bytes(column)
        for i, j, _, _ in B.blocks(sizes, cuts):
            part = column.slice(i, j - i)
            grams, ptr = _grams(part)
            masks = self.lookup(grams)
            n = np.maximum(np.diff(ptr), 1)
            hits = np.stack([B.per_doc(self._bit(masks, k), ptr) for k in range(len(self.languages))], 1)
            share = np.clip((hits / n[:, None] - rates) / (1 - rates), 0, 1)
            best = share.argmax(1)
            top = share[np.arange(len(best)), best]
            total = share.sum(1)
            score = np.where(total > 0, top / np.maximum(total, 1e-12), 0.0) * np.sqrt(np.clip(top, 0, 1))
            lettered = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_pylist()
            for k, has in enumerate(lettered):
                names.append(self.languages[best[k]] if has and top[k] > 0 else self.default if has else "und")
                scores.append(float(score[k]) if has else 0.0)
        return names, np.array(scores, float)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> LanguageFilters:
    """Filters from the texts of `labelled`, whose `lang` is not null (`fit_rows` rows at most)."""
    sample = bounded_sample(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang), (key, text, lang), fit_rows)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs = np.array(part.column(1).to_pylist(), object)
            for one in sorted(set(langs)):
                chosen = part.column(0).take(pa.array(np.flatnonzero(langs == one)))
                raw, off = B.text_bytes(chosen)
                for i, j, _, _ in B.blocks(raw, off, 4 * B.BLOCK_BYTES):
                    seen, n = np.unique(_grams(chosen.slice(i, j - i))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(seen), pa.string()), pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.select(text, lang).mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.sum("n").alias("all_"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("all_") >= LEAST_SEEN)
    held = by_gram.select("gram", F.explode("by").alias("x")).select("gram", "x.lang", "x.n")
    total = {r["lang"]: (r["n"], r["grams"]) for r in held.groupBy("lang").agg(F.sum("n").alias("n"), F.count("gram").alias("grams")).collect()}  # one row per language
    languages = sorted(total)
    if not languages:
        return LanguageFilters(["und"], "und", np.zeros((1 << LEAST_LOG2, 1), np.uint8))
    log2 = min(MOST_LOG2, max(LEAST_LOG2, (SLOTS_PER_GRAM * sum(x[1] for x in total.values())).bit_length()))
    index, amount = {x: k for k, x in enumerate(languages)}, np.array([total[x][0] for x in languages], float)

    def members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, word of the mask, bits): what each n-gram puts into the filter."""
        for part in parts:
            size = np.diff(part.column(1).offsets.to_numpy())
            entries = part.column(1).flatten()
            which = np.array([index[x] for x in entries.field(0).to_pylist()], np.int64)
            rate = entries.field(1).to_numpy() / amount[which]
            gram = np.repeat(np.arange(part.num_rows), size)
            top = np.zeros(part.num_rows)
            np.maximum.at(top, gram, rate)
            good = rate >= RATE_SHARE * top[gram]
            grams = part.column(0).to_numpy().astype(np.uint64)[gram[good]]
            word, bits = which[good] // 64, np.uint64(1) << (which[good] % 64).astype(np.uint64)
            for slot in _slots(grams, log2):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["slot", "word", "bits"])

    bits = by_gram.select("gram", "by").mapInArrow(members, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()  # no more rows than slots
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.dtype(t).itemsize * 8 >= len(languages)), np.uint64)
    masks = np.zeros((1 << log2, -(-len(languages) // 64)), kind)
    masks[bits["slot"], bits["word"]] = bits["bits"].to_numpy().astype(np.int64).view(np.uint64).astype(kind)
    return LanguageFilters(languages, max(languages, key=lambda x: (total[x][0], -index[x])), masks)


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, lang_pred and score (0 to 1) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**MOST_LOG2 slots at most

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names, scores = shared.value.predict(part.column(len(keep)))
            arrays = [part.column(k) for k in range(len(keep))] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, lang_pred string, score double")
