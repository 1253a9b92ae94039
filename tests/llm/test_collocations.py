"""Phrase mining against brute force, and its defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import collocations
from paceline.llm.packed import squeeze, unsqueeze
from paceline.llm.shared import scratch_folder

WORDS = "The the New new York york CITY city of a é ü\x0b x\x00y".split(" ")


def brute(rows, least, share, top):
    """lang, rank, phrase, a, l, r, n, score by counting everything in Python."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        longer = [b for (g, v), b in found.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= share * a for b in longer):
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("top", [2000, 7])
def test_phrases_equal_brute_force(spark, top):
    rng = random.Random(2)
    rows = [(None, None), ("en", ""), ("en", " \t\n.,;"), ("und", "New York. New York"), ("de at", "a b a b, a b " * 20)]
    for _ in range(250):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None]), text))
    rows += [("en", "new york city " * 3000)] + [("en", "of the city")] * 30
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = collocations.collocations(docs, scratch_folder(spark, "phrases"), 5, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10, 50, top)


def test_one_length_and_four_lengths(spark):
    docs = spark.createDataFrame([("en", "a b c d e. a b c d. b c d")] * 4, "lang string, text string")
    phrases, _ = collocations.mine(docs, scratch_folder(spark, "phrases"), 3, least=4, longest=4)
    got = {r.phrase: r.f for p in phrases for r in p.collect()}
    assert got == {"a": 8, "b": 12, "c": 12, "d": 12, "e": 4, "a b": 8, "b c": 12, "c d": 12, "d e": 4, "a b c": 8, "b c d": 12, "c d e": 4, "a b c d": 8, "b c d e": 4}
    one = {r.phrase: (r.firsts, r.rests) for r in phrases[3].collect()}
    assert one["a b c d"] == ([8, 8, 8], [12, 12, 12]) and one["b c d e"] == ([12, 12, 12], [4, 4, 4])


def test_scores_are_exact_past_64_bits(spark):
    rng = random.Random(4)
    rows = []
    for k in range(50):
        a = rng.randint(10**10, 10**12)
        rows.append((k, "en", "p", a, [a + rng.randint(0, 5), a], [a * rng.randint(1, 9), a + rng.randint(0, 99)]))
    got = collocations.scored(spark.createDataFrame(rows, "id long, lang string, phrase string, f long, firsts array<long>, rests array<long>")).collect()
    for r, (_, _, _, a, ls, rs) in zip(sorted(got, key=lambda r: r.id), rows, strict=True):
        score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(zip(ls, rs, strict=True)))
        assert (r.score, r.l, r.r) == (score, left, right)


def test_empty_tables_and_tables_without_words(spark):
    for rows in ([], [("en", None), (None, " .")]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.collocations(docs, scratch_folder(spark, "phrases"), 2).count() == 0


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.int64), np.array([255]), rng.integers(0, 70000, 500), rng.integers(0, 2**40, 9), np.array([-3, 5])]
    assert all((a == b).all() and b.dtype == np.int64 for a, b in zip(arrays, unsqueeze(squeeze(*arrays)), strict=True))


def test_query_runs_over_the_whole_table(spark):
    from paceline.llm.queries import op13_collocations

    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    got = op13_collocations(spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10, 50, 2000)
