"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text is the average of learned vectors of its hashed words, word pairs and
character n-grams (bytes); a softmax over the average gives the class.  A word
that is written twice in a row is hashed as a pair without the word: any word can
stutter, and no sample holds them all.  Training runs on a bounded sample of
labelled rows.  Since the output is linear in the average,
scoring needs one number per vector, and reads whole texts in one pass.

Defined cases: null and empty texts have no features and get the score of the
bias; equal texts get equal scores, repeated rows too; with one class in the
labels that class is predicted; without labels the score is 0.5; labels that occur
twice for a row count twice; a null doc_id is scored and never a label's; a score
of exactly 0.3 counts as good; extra columns are not read; an empty table gives an
empty table.  Whole texts are read, however long: a document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .sampling import bounded_sample

BUCKETS_LOG2 = 16
CHAR_GRAMS = (2, 3, 4)
DIM = 8
#: Labelled rows of each class to train on, at most.
FIT_ROWS = 2_500
EPOCHS = 6
RATE = 0.5
_SPACE = np.uint64((1 << BUCKETS_LOG2) - 1)
_SAME = 0  # the bucket of a pair of equal words


def features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, n+1 offsets of the documents into them) for each kind of n-gram of a block."""
    starts, ends, wptr = B.words(raw, off)
    word = B.Hasher(raw)(starts, ends)
    yield (B.mix(word) & _SPACE).astype(np.int64), wptr
    doc = np.repeat(np.arange(len(off) - 1), np.diff(wptr))
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    first, second = word[inner], word[inner + 1]
    pair = (B.mix(first * np.uint64(3) + second + np.uint64(17)) & _SPACE).astype(np.int64)
    pair[first == second] = _SAME
    yield pair, np.searchsorted(inner, wptr)
    wide = raw.astype(np.uint64)
    for n in CHAR_GRAMS:
        m = max(0, len(raw) - n + 1)
        gram = np.full(m, n, np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(8)) | wide[k : k + m]
        h = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)
        last = np.maximum(off[1:] - n + 1, off[:-1])  # windows inside each document
        ptr = np.stack([off[:-1], last], 1)
        keep = np.zeros(m + 1, np.int8)
        np.add.at(keep, np.minimum(ptr[:, 0], m), 1)
        np.add.at(keep, np.minimum(ptr[:, 1], m), -1)
        place = np.flatnonzero(np.cumsum(keep[:m]) > 0)
        yield h[place].astype(np.int64), np.searchsorted(place, off)


@dataclass
class SubwordModel:
    vectors: np.ndarray  # buckets x DIM
    output: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each document of a block."""
        # whole numbers add up alike wherever a text stands in a block
        each = np.rint((self.vectors @ (self.output[:, 1] - self.output[:, 0])) * 2.0**24).astype(np.int64)
        total, n = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
        for bucket, ptr in features(raw, off):
            total += B.per_doc(each[bucket], ptr)
            n += np.diff(ptr)
        z = total / 2.0**24 / np.maximum(n, 1) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bags(rows: DataFrame, text: str, label: str) -> DataFrame:
    """label, buckets and counts (binary: uint16, and uint16 or uint32 where one is too large) of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, off = B.text_bytes(part.column(0))
            for i, j, data, cuts in B.blocks(raw, off):
                kinds = list(features(data, cuts))
                where, counts = [], []
                for d in range(j - i):
                    seen, n = np.unique(np.concatenate([f[p[d] : p[d + 1]] for f, p in kinds]), return_counts=True)
                    where.append(seen.astype(np.uint16).tobytes())
                    counts.append(n.astype(np.uint16 if n.max(initial=0) < 65536 else np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1).slice(i, j - i), pa.array(where, pa.binary()), pa.array(counts, pa.binary())], ["label", "buckets", "counts"])

    return rows.select(text, F.col(label).cast("int").alias("label")).mapInArrow(run, "label int, buckets binary, counts binary")


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> SubwordModel:
    """Stochastic gradient descent over (label, buckets, weights)."""
    rng = np.random.default_rng(seed)
    model = SubwordModel(rng.normal(0, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2))
    n_of = np.bincount([x[0] for x in examples], minlength=2)
    if not n_of.all():
        model.output[:] = 0
        model.bias = np.array([0.0, 0.0]) if not n_of.any() else np.where(n_of > 0, 4.0, -4.0)
        return model
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(examples)):
            label, where, weight = examples[k]
            if not len(where):
                continue
            v = model.vectors[where]
            mean = weight @ v
            z = mean @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = model.output @ p
            model.output -= step * np.outer(mean, p)
            model.bias -= 0.1 * step * p
            # words of one text share the step; scaled so that a step does not depend on the text's length
            model.vectors[where] = v - (step / max(float(weight @ weight), 1e-4) ** 0.5) * np.outer(weight, back)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> SubwordModel:
    """A model from the rows of `docs` that `labels` (key, label 0/1) marks, about `fit_rows` of each class at most."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label_"))
    chosen = [bounded_sample(marked.where(F.col("label_") == one), key, fit_rows) for one in (0, 1)]
    rows = docs.select(key, text).join(F.broadcast(chosen[0].unionByName(chosen[1])), key)  # bounded by fit_rows
    rows = bounded_sample(rows, (key, text, "label_"), 2 * fit_rows)  # ids may be repeated
    got = bags(rows, text, "label_").toPandas()  # 2 * fit_rows rows at most, of 65,536 buckets at most
    got = got.sort_values(["label", "buckets", "counts"], kind="stable")
    return train([(int(a), *_bag(b, c)) for a, b, c in got.itertuples(index=False)])


def _bag(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights that sum to 1."""
    where = np.frombuffer(buckets, np.uint16)
    n = np.frombuffer(counts, np.uint16 if len(counts) == len(buckets) else np.uint32).astype(np.float32)
    return where, n / max(1.0, float(n.sum()))


def score(docs: DataFrame, model: SubwordModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and the score (0 to 1) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of vectors

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, off = B.text_bytes(part.column(len(keep)))
            got = [shared.value.scores(data, cuts) for _, _, data, cuts in B.blocks(raw, off)]
            got = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(got)], [*keep, "score"])

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, score double")
