"""The text operators against brute force, and their defined cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import bpe_stream, htmlregion, jaccard, langmask, mixing, quality, repetition, surrogates, syncmers, toxicity
from paceline.llm.queries import tokenizer_path
from paceline.llm.shared import scratch_folder

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, score double, n_words string, weight int, kinds string, component_id string"
EN = "the cat and the dog went to the market with some bread and a little milk for their friends in the old town".split()
DE = "der hund und die katze gingen zum markt mit etwas brot und ein wenig milch für ihre freunde in der alten stadt".split()


def table(spark, texts, sources=None, langs=None):
    rows = [(k, t, langs[k] if langs else "en", sources[k] if sources else "s", 0.5, "x", 1, "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "a b c d", "Ä ö ü ß", "x" * 30_000, "w " * 4000]
    for _ in range(n):
        t = " ".join(rng.choice(EN) for _ in range(rng.randint(5, 60)))
        out += [t, t] if rng.random() < 0.3 else [t]
    out += ["line one here\nline one here\nother # line | x", "the cat sat on the mat again and again " * 5]
    return out


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_repetition_counts(spark):
    texts = corpus()
    got = {r.doc_id: r for r in repetition.repetition_rules(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)} if len(w) < 3000 else set(range(len(w)))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.dup_8gram_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))


def test_surrogates(spark):
    texts = [None, "", "plain words", "mail A.b7@x.org or a.b7@x.org, call +1 (659) 555-3949 or +1 659 555 3949, 10.0.0.5", "card 4111 1111 1111 1111, Mrs. Anna Smith met Mr. John Smith", "mail a.b7@x.org"]
    got = surrogates.anonymize(table(spark, texts), "key").orderBy("doc_id").collect()
    assert got[0].text is None and got[1].text == "" and got[2].text == texts[2]
    assert [r.n_entities for r in got] == [0, 0, 0, 5, 3, 1]
    assert got[0].kinds == "y" and got[3].kinds_ == "email,ip,phone"
    mail = got[5].text.removeprefix("mail ")
    assert got[3].text.count(mail) == 2 and "x.org" not in got[3].text
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[ ()\d-]{10,}", got[3].text)]
    assert len(set(digits)) == 1 and digits[0] != "16595553949"
    card = re.sub(r"\D", "", got[4].text)
    assert surrogates._luhn(card[:-1]) == int(card[-1]) and len(card) == 16
    assert surrogates.collisions(surrogates.entities(table(spark, texts), "key")).count() == 0


@pytest.mark.parametrize("text, kind", [("ask 8.8.8.8 first", "ip"), ("host 10.0.0.1", "ip"), ("5.3.22.1", "ip"), ("ring +45 12 34 now", "phone"), ("pay MT84MALT01100ABCDEFGHIJKLMNOPQR", "iban")])
def test_entities_with_few_digits_are_replaced(text, kind):
    new, pairs = surrogates.replace(text, surrogates.Surrogates(b"key"))
    assert [e.kind for e, _ in pairs] == [kind] and pairs[0][0].value not in new


def test_permutation_is_one_to_one_without_fixed_points():
    p = surrogates.Permutation(b"k")
    for n in (2, 3, 10, 100):
        got = [p(x, n, b"t") for x in range(n)]
        assert sorted(got) == list(range(n)) and all(a != b for a, b in enumerate(got))
    assert p(0, 1, b"t") == 0


def test_language(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(DE if k % 2 else EN) for _ in range(30)) for k in range(200)] + [None, "", "123 !?", "a"]
    langs = ["de" if k % 2 else "en" for k in range(200)] + ["en", None, "en", "de"]
    docs = table(spark, texts, langs=langs)
    model = langmask.fit(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langmask.identify(docs, model).collect()}
    assert np.mean([got[k].lang_pred == langs[k] for k in range(200) if k % 3 == 1]) > 0.97
    assert [got[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and got[203].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = langmask.fit(docs.limit(0))
    assert langmask.identify(docs.limit(1), empty).first().lang_pred == "und"


def test_bpe_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    lib = Tokenizer.from_file(path)
    texts = corpus(n=10) + ["It's I'll we're 12 3!'s <|endoftext|>x", "İΣ ΑΣ é 한 🙂👍🏽 中文\x1c", "ab" * 4000 + "'s"]
    got = {r.doc_id: r for r in bpe_stream.encode_decode(table(spark, texts), path).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want
    merges, cache = bpe_stream.load(path)
    monkeypatch.setattr(bpe_stream, "LONG_WORD", 40)
    rng = random.Random(1)
    for size in (1, 2, 7, 300):
        monkeypatch.setattr(bpe_stream, "SLICE", size)
        for _ in range(20):
            t = "".join(rng.choice(["a", "th", "'", "s", "ll", " ", "9", "é", "é", "!", "<|end", "oftext|>", "x" * 50]) for _ in range(40))
            assert np.frombuffer(b"".join(bpe_stream.encode(t, merges, cache)), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_lookahead_holds():
    """Tokens that end `lookahead` symbols before the end are those of any longer text."""
    merges = [(0, 1, 3), (1, 2, 4), (3, 2, 5), (2, 3, 6), (5, 4, 7)]
    size, far = 8, bpe_stream.lookahead([(a, b, c) for a, b, c in merges], 8)
    rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(merges)}
    length = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 5}

    def run(ids):
        ids = list(ids)
        while True:
            best = min(((rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), default=None)
            if best is None:
                return ids
            k = best[1]
            ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]

    rng = random.Random(5)
    for _ in range(2000):
        head = [rng.randrange(3) for _ in range(far + 6)]
        a, b = run(head), run(head + [rng.randrange(3) for _ in range(6)])
        done = 0
        for x, y in zip(a, b, strict=False):
            done += length[x]
            if done > len(head) - far:
                break
            assert x == y
    assert size == 8


def test_fingerprints(spark):
    texts = [t for t in corpus(n=20)]
    got = {r.doc_id: r for r in syncmers.compare_with_next(table(spark, texts), 3).collect()}
    n = len(texts)
    for k in range(n):
        t, following = texts[k] or "", texts[(k - 1) % n] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(t)
        if t == following:
            assert got[k].near_next == 1.0 and got[k].fingerprint == got[k - 1].fingerprint
    raw = np.frombuffer(b"some text with a few words", np.uint8)
    h = syncmers._smers(raw, 4)
    want = [i for i in range(len(raw) - 11) if min(h[i : i + 9]) in (h[i], h[i + 8])]
    assert syncmers.closed_syncmers(raw, 12, 4).tolist() == want
    assert syncmers.compare_with_next(table(spark, []), 2).count() == 0
    assert [r.near_next for r in syncmers.compare_with_next(table(spark, ["alone here"]), 4).collect()] == [1.0]


def test_likeness_bears_edits_that_change_the_length():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    halves = " ".join(words[:150]), " ".join(words[150:])
    text, longer, turned = " ".join(halves), "{} some more {}".format(*halves), "{1} {0}".format(*halves)
    a, b, c = syncmers.fingerprints([x.encode() for x in (text, longer, turned)])
    assert syncmers.likeness(a, a) == 1.0 and syncmers.likeness(a, b) > 0.9
    assert 0.3 < syncmers.likeness(a, c) < 0.9


def test_mixing_targets_and_rounding(spark):
    rng = random.Random(2)
    sizes = [rng.randint(0, 40) for _ in range(400)]
    sources = [["a", "b", "c", "d", None][min(4, int(rng.random() ** 3 * 6))] for _ in sizes]
    docs = table(spark, ["w " * s if s else None for s in sizes], sources=sources)
    runs = [{(r.doc_id): r for r in mixing.mix(docs, scratch_folder(spark, "t"), bucket_rows=20, fan_in=3).collect()} for _ in range(2)]
    total = {s: sum(x for x, y in zip(sizes, sources, strict=True) if y == s) for s in set(sources)}
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    taken = dict.fromkeys(order, 0)
    for k, r in runs[0].items():
        assert r.target == pytest.approx(target[sources[k]]) and r.size == sizes[k] and 0 <= r.copies <= 3
        assert runs[1][k].copies == r.copies
        taken[sources[k]] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert mixing.mix(table(spark, []), scratch_folder(spark, "t")).count() == 0
    assert {r.copies for r in mixing.mix(table(spark, [None, ""]), scratch_folder(spark, "t")).collect()} == {0}


def test_html(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy <b>now</b></div><article><h1>T &amp; x</h1><p><b>One  two<br><p>three four five six</p></article><footer>f</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "just  text &lt;3", "x"), (5, "u", page, "x"), (6, "u", "<script>var a = '<p>no</p>'</script>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmlregion.extract(pages, htmlregion.learn(pages)).collect()}
    assert got == {1: "T & x\nOne two\nthree four five six", 2: "", 3: "", 4: "just text <3", 5: got[1], 6: ""}
    parts = [3.0, -5.0, 2.0, 2.0, -1.0, 4.0]
    best = max(sum(parts[i:j]) for i in range(6) for j in range(i, 7))
    assert best == 7.0


def labelled(spark, n=400):
    rng = random.Random(4)
    texts, toxic, good = [], [], []
    for k in range(n):
        w = [rng.choice(EN) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 60))]
        bad, low = k % 4 == 0, k % 5 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blorf", "grunx", "zapl" + rng.choice("aeiou") + rng.choice("nmrt")]))
        texts.append(" ".join(x.upper() + "!!" for x in w) if low else " ".join(w))
        toxic.append(int(bad))
        good.append(int(not low))
    labels = spark.createDataFrame([(k, good[k], toxic[k]) for k in range(n)], "doc_id long, quality int, toxic int")
    return table(spark, texts + [None, ""]), labels, toxic, good


def test_toxicity(spark):
    docs, labels, toxic, _ = labelled(spark)
    model = toxicity.learn(docs, labels.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in toxicity.weigh(docs, model).collect()}
    assert np.mean([(got[k].score >= 0.3) == bool(toxic[k]) for k in range(0, 400, 3)]) > 0.97
    assert got[400].score == got[401].score < 0.3
    plain, negated, reported = (model.clause(x) for x in ("such a blorf", "not a blorf", "he said blorf"))
    assert negated < plain and reported != plain
    assert model.clause("i will kill time") == 0 < model.clause("you they kill")
    bare = toxicity.learn(docs, labels.limit(0))
    assert toxicity.weigh(docs, bare).count() == 402


def test_a_threat_counts_with_its_target_behind_it():
    model = toxicity.ToxicityModel({}, {})
    for text in ("i will kill you", "we will destroy them", "ich werde dich töten", "kill one two three you"):
        assert model.clause(text) == 1.0
    assert model.clause("i will kill time") == model.clause("kill one two three four you") == 0
    assert 0 < model.clause("i will not kill you") < model.clause("he said i will kill you") < 1
    assert model.weight("good day. i will kill you! bye") == (1.0, 1)


def test_quality(spark):
    docs, labels, _, good = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[k] >= 0.3) == bool(good[k]) for k in range(0, 400, 3)]) > 0.97
    assert got[400] == got[401] and 0 <= got[400] <= 1
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).first().score == 0.5
    assert quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).first().score > 0.5


def test_jaccard_join(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 80))] for _ in range(25)]
    texts = [None, "", "   ", "one two", "One  two", "a b c d e", "A b c d e"]
    for b in base:
        for _ in range(rng.choice([1, 2, 12])):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    line = " ".join(f"c{k}" for k in range(12))
    texts += [line + " " + " ".join(f"u{k}_{j}" for j in range(k % 6)) for k in range(30)]
    texts += [texts[-1]] * 40
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r for r in jaccard.near_duplicates(table(spark, texts), scratch_folder(spark, "t"), 4).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), find(k)) for k in range(len(texts))}
    assert jaccard.near_duplicates(table(spark, []), scratch_folder(spark, "t"), 4).count() == 0
    twice = table(spark, ["a b c d e f", "q"]).unionByName(table(spark, ["a b c d e f"])).withColumn("doc_id", F.when(F.col("text") != "q", F.col("doc_id")))
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.near_duplicates(twice, scratch_folder(spark, "t"), 4).collect() if r.component_id is not None) == [(2, 0), (2, 0)]


def test_pipeline_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(9)
    texts = [" ".join(rng.choice(EN) + str(k % 7) for k in range(rng.randint(6, 30))) for _ in range(40)]
    texts += [texts[0], None, "", "you idiot moron, you stupid scum", "write to a.b7@x.org now please ok"]
    docs = table(spark, texts, sources=["ab"[k % 2] for k in range(len(texts))])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 43 not in ids and not {0, 40} <= ids
    sizes = {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}
    kept = set(range(len(texts))) - {43, 40}
    assert ids <= kept
    total = sum(sizes[k] for k in kept)
    assert sum(sizes[r.doc_id] for r in out) == pytest.approx(total, abs=2 * max(sizes.values()))
    step = docs
    for _, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    assert all("x.org" not in (r.text or "") for r in step.select("text").collect())
    assert math.isfinite(total)


def test_rows_without_an_id_of_their_own_are_mixed_one_by_one(spark):
    import corpus_pipeline as pipeline

    n = 80
    sources = ["abc"[k % 3] for k in range(3 * n)]
    docs = table(spark, ["two words" if k % 2 else f"word{k} more" for k in range(3 * n)], sources=sources)
    rows = docs.withColumn("doc_id", F.expr("CASE WHEN doc_id % 4 < 2 THEN NULL WHEN doc_id % 4 = 2 THEN 7 ELSE doc_id END"))
    taken = [sorted((r.source, r.doc_id is None, r.doc_id or 0, r.text) for r in pipeline.mixed(spark, x, "").collect()) for x in (rows, rows.repartition(3, "text").orderBy(F.desc("text")))]
    assert taken[0] == taken[1]
    for source, share in (("a", 15 / 8), ("b", 6 / 8), ("c", 3 / 8)):
        assert sum(r[0] == source for r in taken[0]) == pytest.approx(n * share, abs=1)
        assert sum(r[0] == source and r[1] for r in taken[0]) == pytest.approx(n / 2 * share, rel=0.5)


def test_surrogates_of_every_script_and_of_later_mentions():
    own = surrogates.Surrogates(b"key")
    for text, gone in [
        ("Mr. John Smith met Smith and John", ("John", "Smith")), ('password: "日本語パス"', ("日本語パス",)), ("Mr. 王伟 kam", ("王伟",)), ("Dr. Ёлкин, Mrs. Ñuñez", ("Ёлкин", "Ñuñez")),
        ("GB82 WEST 1234 5698 7654 32", ("1234 5698",)), ("2001:db8::1 is up", ("2001:db8::1",)), ("jörg.müller@exämple.org", ("jörg", "exämple")), ('password: "!!!!!"', ("!!!!!",)),
    ]:
        new, pairs = surrogates.replace(text, own)
        assert pairs and not any(x in new for x in gone), new
    for text in ("Don Quixote rode", "secret: everyone knows", "2019 2020 2021 2022", "at 12:30:45", ":: and ::1"):
        assert surrogates.replace(text, own) == (text, [])
    new, _ = surrogates.replace("Mr. Brown saw a brown fox. Brown", own)
    assert new.endswith("a brown fox. Brown")  # also an ordinary word of the text
    account = surrogates.replace("GB82 WEST 1234 5698 7654 32", own)[0].replace(" ", "")
    assert int(account[2:4]) == surrogates._iban_check("GB", account[4:])
    first = {surrogates.replace(f"{t} Anna Smith", own)[0].split(" ")[1] for t in ("Mrs.", "Dr.", "Ms.")}
    assert len(first) == 1


def test_entities_are_found_in_linear_time():
    import time

    own = surrogates.Surrogates(b"key")
    for text in ("a" * 10**6, "a" * 10**6 + "@x.org", "x@" + "a." * 500_000, "1" * 10**6, "+1" * 500_000, "::" * 500_000, "AB12" * 250_000, "Mr. " + "A" * 10**6):
        began = time.time()
        surrogates.replace(text, own)
        assert time.time() - began < 15, text[:10]  # quadratic ones take hours


def test_no_two_values_share_a_surrogate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = surrogates.entities(docs, "key")
    assert found.count() > 0 and surrogates.collisions(found).count() == 0
    assert found.where("lower(value) = lower(surrogate)").count() == 0
    names = spark.createDataFrame([(k, f"Mr. {chr(65 + k % 26)}{chr(97 + k // 26 % 26)}n {chr(65 + k // 676 % 26)}om") for k in range(3000)], "doc_id long, text string")
    assert surrogates.collisions(surrogates.entities(names, "key")).count() == 0


def test_class_words_exclude_no_article(spark):
    body, frame = "<p>One two three four five six seven</p><p>eight nine ten eleven twelve</p>", "<nav><a>Home</a></nav>{}<footer>f</footer>"
    text = "One two three four five six seven\neight nine ten eleven twelve"
    pages = {
        1: ("<body class='page has-sidebar'>" + frame.format(f"<article>{body}</article>") + "</body>", text), 2: (frame.format(f"<article class='post share'>{body}</article>"), text),
        3: (frame.format(f"<article>{body}<p class='related-work'>Related work is text</p></article>"), text + "\nRelated work is text"), 4: (f"<div class='sidebar'><article>{body}</article></div>", text),
        5: (frame.format("<article><p>Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> be given now</p></article>"), "Let x = 1 be given now"), 6: (frame.format("<article><p title=\"5\" tall\">One two three</p><p>say \"hi\" to</p></article>"), 'One two three\nsay "hi" to'),
        7: (f"<div class='share'>{body}</div>", text), 8: (f"<div class='ad'><p>buy buy</p></div><article>{body}<div class='ad'><p>buy now please</p></div><p>last words</p></article>", text + "\nlast words"),
    }
    table = spark.createDataFrame([(k, "u", p) for k, (p, _) in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmlregion.extract(table, htmlregion.learn(table)).collect()}
    assert got == {k: t for k, (_, t) in pages.items()}


def test_region_is_the_best_part():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-2.0, -0.5, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        a, b = htmlregion.RegionModel().region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0.0)
        assert sum(scores[a:b]) == pytest.approx(max(0.0, best))


@pytest.mark.parametrize("page", ["<b>" * 100_000, "<p>" * 100_000, "<div class='x'>a " * 100_000, "<b><p>" * 50_000, '<a x="' * 100_000, "<div><article>" * 50_000])
def test_unclosed_tags_take_linear_time(page):
    import time

    began = time.time()
    htmlregion.RegionModel().extract(page)
    assert time.time() - began < 20


def test_more_than_64_languages(spark):
    rng = random.Random(3)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(70)}
    rows = [(k, " ".join(rng.choice(w) for _ in range(30)), lang) for lang, w in words.items() for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langmask.identify(docs, langmask.fit(docs.where("doc_id > 0")), keep=("lang",)).collect()
    assert len({r.lang for r in got}) == 70 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_samples_bound_rows_of_one_key(spark):
    from paceline.llm.sampling import bounded_sample

    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN id END AS key", "CAST(1 AS INT) AS label")
    for most in (10, 500):
        assert 0 < bounded_sample(rows, "key", most).count() <= most
    assert bounded_sample(rows, "key", 5000).count() == 5000


def test_equal_and_null_ids_are_rows_of_their_own(spark):
    texts = ["one two three four five six"] * 4 + [f"word{k} some more text here now" for k in range(30)]
    docs = spark.createDataFrame([(None if k % 2 else 7, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = syncmers.compare_with_next(docs, 5).collect()
    assert len(rows) == len(texts) and sum(r.near_next == 1.0 for r in rows) == 2
    mixed = mixing.mix(docs, scratch_folder(spark, "t"), bucket_rows=4, fan_in=2).collect()
    assert len(mixed) == len(texts) and all(r.copies == 1 for r in mixed)


def test_dedup_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as pipeline

    a, b, c = "a b c d e f g h i j", "k l m n o p q r s t", " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, c), (7, c + " more"), (None, b), (None, "x"), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in pipeline.without_near_duplicates(spark, docs, "").collect())
    assert [x for x in got if x[0] != 7] == [(0, ""), (0, "x"), (3, a), (5, b)]
    assert len([x for x in got if x[0] == 7]) == 1


def test_candidates_pass_three_orders(spark):
    rng = random.Random(5)
    line = " ".join(f"c{k}" for k in range(24))
    texts = [line + " " + " ".join(f"u{k}_{j}" for j in range(8)) for k in range(20)]
    base = [f"w{k}" for k in range(60)]
    texts += [" ".join(w if j != k else f"x{k}" for j, w in enumerate(base)) for k in rng.sample(range(60), 10)]
    folder = scratch_folder(spark, "t")
    jaccard.near_duplicates(table(spark, texts), folder, 4).count()
    count = lambda name: sum(spark.read.parquet(f"{folder}/{name}_{k}").count() for k in (0, "cross"))
    assert count("pairs") >= count("candidates") >= count("links") > 0


def test_token_names_keep_order_and_fit():
    token = np.sort(np.concatenate([np.random.default_rng(1).integers(0, 2**64, 20000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    for n_buckets in (1, 3, 24, 14001, (1 << 24) - 1):
        bucket, name = jaccard._name(token, n_buckets)
        assert 0 <= bucket.min() and bucket.max() < n_buckets
        assert (name[1:] >= name[:-1]).all() and len(np.unique(name)) == len(token)
        assert (name >> np.uint64(40) == bucket.astype(np.uint64)).all() and not (name & np.uint64(1 << 39)).any()
