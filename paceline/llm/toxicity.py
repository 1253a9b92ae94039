"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer writes a class for every word: insult, threat, target,
negation, reported speech, or other.  Small transducers for negation, reported
speech, target and threat are composed into one machine, which reads the classes
of a clause and gives each insult or threat a weight for the way it is used: a
negated or reported one counts less, one aimed at somebody counts more, and a
threat without a target before or behind it does not count.  A text's score is a logistic function
of the weights of all its matched clauses.

Insult words and stems, with their weights, and the logistic function are
learned on Spark from a bounded sample of labelled rows.  A word must be far
more frequent in marked texts, and in many different contexts there, so the
ordinary words of a text that was copied many times don't count as insults.

Defined cases: null and empty texts match nothing and get the score of zero
weight; equal texts get equal scores, repeated rows too; labels that occur twice
count twice; with no labels the fixed words alone decide; a null doc_id is scored
and never a label's; a score of exactly 0.3 counts as toxic; extra columns are not
read, added ones give way to kept ones of their name; an empty table gives an
empty table.  Whole texts are read, in time in proportion to their length; a
clause ends at . ! ? ; or a line break.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .sampling import bounded_sample

# Function words of English, German, French and Spanish.
TARGETS = "you your yours he she they them him her this that these those du dich dir ihr euch sie er dieser diese tu toi te vous il elle ils ce cet cette ces usted ustedes ella ellos ese esa este esta".split()
NEGATIONS = "not no never nobody without isn't aren't wasn't don't nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTS = "said says saying wrote writes quoted quotes called calls claimed claims alleged according sagte sagt schrieb nannte nennt behauptet zitiert dit disait écrit affirme selon dijo dice escribió afirma según".split()
THREATS = "kill hurt destroy shoot stab beat burn murder töten umbringen schlagen verletzen erschießen tuer frapper détruire brûler matar golpear destruir quemar disparar".split()
INSULTS = "idiot moron stupid scum loser worthless pathetic".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, AIMED = range(7)  # AIMED: a threat with a target behind it
#: Labelled rows of each class to learn from, at most.
FIT_ROWS = 8_000
MIN_MARKED, MIN_CONTEXTS, MIN_LOG_ODDS = 6, 5, 3.2
STEM_LENGTHS = (4, 5, 6)
MIN_STEM_MARKED, MIN_STEM_WORDS = 12, 5

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_CLAUSE_END = re.compile(r"[.!?;\n]")


@dataclass
class Transducer:
    """arcs: (state, class) -> (next state, class out, log weight); a missing arc keeps the class and goes by `other`."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    other: dict[int, int] = field(default_factory=dict)
    final: dict[int, float] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol)) or (self.other.get(state, state), symbol, 0.0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the output of `first` to `second`; its states are numbered as they are reached."""
    numbers: dict[tuple[int, int], int] = {(0, 0): 0}
    todo, out = [(0, 0)], Transducer({})
    while todo:
        pair = todo.pop()
        here = numbers[pair]
        for symbol in range(7):
            a, middle, w = first.step(pair[0], symbol)
            b, end, v = second.step(pair[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                todo.append((a, b))
            out.arcs[here, symbol] = (numbers[a, b], end, w + v)
    return out


# Up to two words after a negation an insult or threat counts a quarter.
_negated = Transducer(
    {(s, NEGATION): (2, OTHER, 0.0) for s in range(3)} | {(s, x): (s - 1, x, math.log(0.25)) for s in (1, 2) for x in (INSULT, THREAT, AIMED)},
    other={2: 1, 1: 0},
)
# From a verb of saying to the end of the clause an insult or threat counts half.
_reported = Transducer({(s, REPORT): (1, OTHER, 0.0) for s in (0, 1)} | {(1, x): (1, x, math.log(0.5)) for x in (INSULT, THREAT, AIMED)})
# Up to four words after a target an insult counts half as much again; a threat needs the target, before or behind it.
_targeted = Transducer(
    {(s, TARGET): (4, TARGET, 0.0) for s in range(5)}
    | {(s, INSULT): (s - 1, INSULT, math.log(1.5)) for s in range(1, 5)}
    | {(s, THREAT): (s - 1, INSULT, 0.0) for s in range(1, 5)}
    | {(0, THREAT): (0, OTHER, 0.0)}
    | {(s, AIMED): (max(s - 1, 0), INSULT, 0.0) for s in range(5)},
    other={4: 3, 3: 2, 2: 1, 1: 0},
)
# Reads the clause from its end: a threat up to four words before a target is aimed.
_followed = Transducer(
    {(s, TARGET): (4, TARGET, 0.0) for s in range(5)} | {(s, THREAT): (s - 1, AIMED, 0.0) for s in range(1, 5)},
    other={4: 3, 3: 2, 2: 1, 1: 0},
)
GRAMMAR = compose(compose(_negated, _reported), _targeted)


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 3.0
    offset: float = -3.0

    def __post_init__(self):
        self._matcher = None
        self._classes = {w: k for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_matcher"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_matcher": None}

    def matcher(self):
        """An Aho-Corasick machine that finds where a word of the grammar's core may begin."""
        if self._matcher is None:
            import ahocorasick

            self._matcher = ahocorasick.Automaton()
            for x in {*self.words, *self.stems, *THREATS}:
                self._matcher.add_word(x, len(x))
            self._matcher.make_automaton()
        return self._matcher

    def lexeme(self, word: str) -> float:
        """Insult weight of a lower-case word, 0 if it is none."""
        got = self.words.get(word)
        if got is None:
            got = max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) > n), default=0.0)
        return got

    def clause(self, text: str) -> float:
        """Weight of the matches of a lower-case clause."""
        words = _WORD.findall(text)
        weights = [self.lexeme(word) for word in words]
        symbols = [INSULT if weight else self._classes.get(word, OTHER) for word, weight in zip(words, weights, strict=True)]
        if THREAT in symbols:
            state = 0
            for k in range(len(symbols) - 1, -1, -1):
                state, symbols[k], _ = _followed.step(state, symbols[k])
        total, state = 0.0, 0
        for symbol, weight in zip(symbols, weights, strict=True):
            state, out, log_weight = GRAMMAR.arcs[state, symbol]
            if out == INSULT:
                total += (weight or 1.0) * math.exp(log_weight)
        return total

    def weight(self, lower: str) -> tuple[float, int]:
        """Weight of all matched clauses of a lower-case text, and their number."""
        total, n, done = 0.0, 0, -1
        ends = None  # places of all clause ends, once a clause is looked at
        for end, size in self.matcher().iter(lower):
            start = end - size + 1
            if start < done or (start and lower[start - 1].isalnum()):
                continue
            if ends is None:
                ends = [-1, *(m.start() for m in _CLAUSE_END.finditer(lower)), len(lower)]
            begin, done = ends[bisect_left(ends, start) - 1] + 1, ends[bisect_left(ends, end)]
            got = self.clause(lower[begin:done])
            total, n = total + got, n + (got > 0)
        return total, n

    def probability(self, weight: float) -> float:
        z = self.slope * math.log1p(weight) + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _texts(column: pa.Array) -> Iterator[str]:
    return (x.as_py() for x in pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, marked, clean): texts with the word by class, and for marked ones the word before it."""
    for part in parts:
        marked, clean, contexts = Counter(), Counter(), set()
        for text, label in zip(_texts(part.column(0)), part.column(1).to_pylist(), strict=True):
            found = _WORD.findall(text)
            (marked if label else clean).update(set(found))
            if label:
                contexts.update(zip(found, ["", *found], strict=False))
        rows = [(w, None, n, 0) for w, n in marked.items()] + [(w, None, 0, n) for w, n in clean.items()] + [(w, c, 0, 0) for w, c in contexts]
        for k in range(0, len(rows), 50_000):
            cut = list(zip(*rows[k : k + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cut[0], pa.string()), pa.array(cut[1], pa.string()), pa.array(cut[2], pa.int64()), pa.array(cut[3], pa.int64())], ["word", "context", "marked", "clean"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """A model from the rows of `docs` that `labels` (key, label 0/1) marks, about `fit_rows` of each class at most."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label_"))
    chosen = [bounded_sample(marked.where(F.col("label_") == one), key, fit_rows) for one in (0, 1)]
    rows = docs.select(key, text).join(F.broadcast(chosen[0].unionByName(chosen[1])), key)  # bounded by fit_rows
    rows = bounded_sample(rows, (key, text, "label_"), 2 * fit_rows)  # ids may be repeated
    n_by = {r[0]: r[1] for r in rows.groupBy("label_").count().collect()}
    n_marked, n_clean = n_by.get(1, 0), n_by.get(0, 0)

    counted = rows.select(text, "label_").mapInArrow(_count, "word string, context string, marked long, clean long")
    by_word = counted.groupBy("word", "context").agg(F.sum("marked").alias("marked"), F.sum("clean").alias("clean")).groupBy("word").agg(
        F.sum("marked").alias("marked"), F.sum("clean").alias("clean"), F.count("context").alias("contexts")
    )
    odds = F.log((F.col("marked") + 0.5) / F.lit(n_marked + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    wide = F.col("contexts") >= F.greatest(F.lit(MIN_CONTEXTS), F.col("marked") / 4)
    strong = by_word.where("marked > 0").withColumn("odds", odds)
    words = strong.where((F.col("marked") >= MIN_MARKED) & wide & (F.col("odds") >= MIN_LOG_ODDS))
    stems = (
        by_word.withColumn("stem", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS])))
        .where("stem is not null")
        .groupBy("stem")
        .agg(F.sum("marked").alias("marked"), F.sum("clean").alias("clean"), F.sum("contexts").alias("contexts"), F.count_if(F.col("marked") > 0).alias("n_words"), F.max("marked").alias("top"))
        .where((F.col("top") <= F.col("marked") / 2) & (F.col("marked") >= MIN_STEM_MARKED) & (F.col("n_words") >= MIN_STEM_WORDS) & (F.col("contexts") >= F.col("marked") / 2))
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_LOG_ODDS + 0.3)
    )
    # some of the words of a sample of bounded size
    known = {r["word"]: min(r["odds"], 6.0) / 4 for r in words.select("word", "odds").collect()}
    roots = {r["stem"]: min(r["odds"], 6.0) / 4 for r in stems.select("stem", "odds").collect()}
    for word in INSULTS:
        known.setdefault(word, 1.0)
    model = ToxicityModel(known, roots)

    seen = weigh(rows, model, text, ("label_",)).groupBy("label_", F.round("weight", 2).alias("weight")).count().toPandas()
    if n_marked and n_clean:
        x, y, n = np.log1p(seen["weight"].to_numpy(float)), seen["label_"].to_numpy(float), seen["count"].to_numpy(float)
        a, b, share = model.slope, model.offset, n / n.sum()
        for _ in range(4000):  # gradient descent on two numbers, with a small pull to the start
            p = 1 / (1 + np.exp(-(a * x + b)))
            a -= 1.0 * (float((share * (p - y) * x).sum()) + 1e-4 * (a - 3.0))
            b -= 1.0 * (float((share * (p - y)).sum()) + 1e-4 * (b + 3.0))
        model.slope, model.offset = max(a, 0.1), b
    return model


def weigh(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, and last weight, n_clauses and score (0 to 1) of each row (with _ behind a name that is taken)."""
    added = B.free_names(keep, ["weight", "n_clauses", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words and stems of a sample of bounded size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            got = [m.weight(x) for x in _texts(part.column(len(keep)))]
            weights = [x[0] for x in got]
            arrays = [pa.array(weights, pa.float64()), pa.array([x[1] for x in got], pa.int64()), pa.array([m.probability(x) for x in weights], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *arrays], [*keep, *added])

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, kept + ", `{}` double, `{}` long, `{}` double".format(*added))
