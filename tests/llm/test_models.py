"""Trained operators: held-out accuracy, planted cases, odd rows."""

import random

import numpy as np
import pytest

from tessella.llm import decontam, langid, quality, toxicity
from tessella.llm.queries import QUERIES

from .conftest import prose

SF = "/root/testdata/sf0.01"
BAD = ("grumblefish", "slimebucket", "nitwitted", "dunderhead")


def labelled(seed=0, n=120):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_tolerates_inserted_characters(spark, make_docs, odd_rows):
    rows, labels = labelled()
    model = toxicity.train(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rng = random.Random(9)
    probe = [(1000, prose(rng, 40) + " grumblxefish"), (1001, prose(rng, 40) + " s-l-i-m-e-bucket!"), (1002, prose(rng, 200)), (1003, "d u n d e r h e a d"), (1004, None), (1005, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs([*probe, *odd_rows]), model).collect()}
    assert all(got[i] >= 0.5 for i in (1000, 1001, 1003)) and all(got[i] < 0.5 for i in (1002, 1004, 1005))
    assert all(0 <= s <= 1 for s in got.values()) and got[4] == got[5]
    nothing = toxicity.train(make_docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(make_docs(odd_rows), nothing).collect()} == {0.0}
    assert toxicity.score(make_docs([]), model).count() == 0


def test_kernel_equals_a_naive_one():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcde") for _ in range(rng.randrange(3, 16))) for _ in range(25)]

    def parts(w):
        c = [toxicity.MARK, *(x - 96 for x in w)]
        out = {}
        for i in range(min(len(c), toxicity.LOCAL)):
            for k in range(i + 2, min(len(c), i + toxicity.REACH + 1)):
                for j in range(i + 1, k):
                    out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out

    c, word = toxicity.padded(*toxicity.laid(words))
    x = toxicity.fragments(c, np.searchsorted(word, np.arange(25)), np.zeros(25, int))
    land = toxicity.Landmarks.of(x[:10])
    naive = np.array([[sum(v * b.get(k, 0) for k, v in a.items()) for b in map(parts, words[:10])] for a in map(parts, words)])
    assert np.allclose(land.kernel(x), naive, rtol=1e-4)
    alpha = np.linspace(-1, 1, 10).astype(np.float32)
    assert np.allclose(toxicity.Model(land.weights(alpha), 0.5, 1.0).places(c)[np.searchsorted(word, np.arange(25)), 0], naive @ alpha + 0.5, rtol=1e-3, atol=1e-3)


def test_stems_are_learned_where_a_word_list_fails():
    """Insults that are a stem and any ending; none of the probes' words is among the training words."""
    rng = random.Random(5)
    ends = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    texts, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            for at in rng.sample(range(60), 3):
                words[at] = rng.choice(("quiltho", "vazzek")) + rng.choice(ends[:40])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(labels))
    known = {w for t in texts for w in t.split()}
    bad = [s + e for s in ("quiltho", "vazzek") for e in ends[40:]] + ["quilxtho" + e for e in ends[:20]] + ["vazz-ek" + e for e in ends[:20]]
    assert not known & set(bad)
    hit = toxicity.Model.values(model, *toxicity.laid([w.encode() for w in bad])) >= 0
    clean = sorted({w for _ in range(60) for w in prose(rng, 60).split()} | {"quarrel", "vase", "quilted", "zekka"})
    false = toxicity.Model.values(model, *toxicity.laid([w.encode() for w in clean])) >= 0
    assert hit.mean() >= 0.95 and false.mean() <= 0.01


def test_what_an_operator_keeps_in_a_worker_goes_when_another_begins():
    from tessella.llm import _text

    gone = []
    _text.settle("a", lambda: gone.append("a"))
    _text.settle("a", lambda: gone.append("a"))
    assert gone == []
    _text.settle("b")
    _text.settle("a")
    assert gone == ["a"]


def test_spelled_words_end_with_their_text():
    texts = [b"before", b"d u n c e", b"after", b"o n e 1 ", b"t w o 2", b"", b"x"]
    runs, doc = toxicity.spelled(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert (runs, doc.tolist()) == ([b"dunce", b"one1", b"two2"], [1, 3, 4])


def test_quality_grades_are_ordered(spark, make_docs, odd_rows):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(150):
        g = i % 3
        rows.append((i, " ".join([prose(rng, 10 + 15 * g)] + ["JUNK!!"] * (20 - 9 * g))))
        labels.append((i, g))
    model = quality.train(make_docs(rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, grade int"))
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == (0, 1, 2)
    got = {r["doc_id"]: r for r in quality.score(make_docs(rows), model, tail_at=2).collect()}
    mean = [sum(got[i]["expected_grade"] for i, x in labels if x == g) / 50 for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2]
    assert all(0 <= r["tail"] <= 1 for r in got.values())
    assert quality.score(make_docs(odd_rows), model).count() == len(odd_rows)
    one = quality.train(make_docs(rows), spark.createDataFrame([(1, 2)], "doc_id long, grade int"))
    assert {r["expected_grade"] for r in quality.score(make_docs(odd_rows), one).collect()} == {2.0}


def test_language(spark, make_docs, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES["op7_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    model = langid.train(docs, per_lang=50)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(make_docs(odd_rows), model).collect() if r["doc_id"] in (1, 2, 3)}
    assert got == {(i, "und", 0.0) for i in (1, 2, 3)}
    none = langid.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(make_docs(odd_rows), none).collect()} == {"und"}


def test_held_out_quality(spark):
    """Nearly all good held-out rows, and most of the poor ones."""
    out = QUERIES["op3_quality"](spark, "/root/testdata/sf0.1")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    for y, least in ((0, 0.7), (1, 0.98)):
        assert sum(r["predicted"] == y for r in rows if r["quality"] == y) >= least * sum(r["quality"] == y for r in rows)


def test_held_out_toxicity(spark):
    """Of held-out rows of both labels; many clean texts of this table hold the insults' stems."""
    out = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, said = sum(r["toxic"] for r in rows), sum(r["predicted"] for r in rows)
    both = sum(r["toxic"] and r["predicted"] for r in rows)
    assert both >= 0.85 * toxic and both >= 0.75 * said


def test_decontamination(spark, make_docs, odd_rows):
    rng = random.Random(3)
    items = [(i, prose(rng, 15 + 2 * i)) for i in range(20)]
    rows = []
    for i, t in items:
        rows.append((i, prose(rng, 50) + " " + t + " " + prose(rng, 50)))
        w = t.split()
        for j in range(0, len(w), 9):
            w[j] = "other"
        rows.append((100 + i, prose(rng, 33) + " " + " ".join(w) + " " + prose(rng, 20)))
    clean = [(200 + i, prose(rng, 150)) for i in range(40)]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(make_docs([*rows, *clean]), bench).collect()}
    assert got >= {(i, i) for i, _ in items}
    assert len({(100 + i, i) for i, _ in items} - got) <= 2  # paraphrases
    assert not {d for d, _ in got if d >= 200}
    assert decontam.contaminated(make_docs([]), bench).count() == 0
    assert decontam.contaminated(make_docs(odd_rows), bench.limit(0)).count() == 0
    assert decontam.contaminated(make_docs(odd_rows), spark.createDataFrame([(7, odd_rows[4][1][:200])], "item_id long, text string")).select("doc_id").distinct().count() == 3


def test_paraphrases_are_found(spark, make_docs):
    """Items of 24 and 32 words of which three in ten are replaced, anywhere in a text, in words of Zipf's frequencies."""
    rng = np.random.default_rng(12)
    p = 1 / np.arange(1, 20001)
    zipf = lambda n: [f"z{i}" for i in rng.choice(20000, n, p=p / p.sum())]
    items, rows = [], []
    for i in range(200):
        w = zipf((24, 32)[i % 2])
        items.append((i, " ".join(w)))
        for j in rng.choice(len(w), int(0.3 * len(w)), replace=False):
            w[j] = f"new{j}"
        rows.append((i, " ".join([*zipf(rng.integers(20, 150)), *w, *zipf(rng.integers(20, 150))])))
    docs = make_docs([*rows, *((1000 + i, " ".join(zipf(200))) for i in range(600))])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(200)}


def test_bound_of_shares_spares_exact_sums():
    """Candidates are those of the plain rule, and few pairs over the cosine's bar get to the exact sum."""
    rng = np.random.default_rng(5)
    n = 2 * decontam.BLOCK
    draw = lambda k: decontam.once_each(rng.integers(0, 300, (k, n)).astype(np.int16))
    mine, terms = draw(150), draw(600)
    terms[:150, : n // 2] = mine[:, : n // 2]
    terms = decontam.once_each(terms)
    weights = np.zeros((150, decontam.DIM + 1), np.float32)
    np.put_along_axis(weights, mine.astype(np.int64), rng.exponential(1, mine.shape).astype(np.float32), 1)
    weights[:, decontam.DIM] = 0
    weights /= weights.sum(1, keepdims=True)
    x, vectors, bars = rng.standard_normal((600, 8)).astype(np.float32), rng.standard_normal((8, 150)).astype(np.float32), np.zeros(150, np.float32)
    share = np.stack([w[terms].sum(1) for w in weights], 1)
    over, above = x @ vectors >= bars, decontam.bounds(weights)
    i, j, cosine = decontam.candidates(x, terms, vectors, bars, weights, above)
    assert list(zip(i, j, strict=True)) == list(zip(*np.nonzero(over & (share >= decontam.SHARED)), strict=True))
    assert (cosine == (x @ vectors)[i, j]).all()
    bound = decontam.row_sums(above, terms)
    assert (bound >= share * decontam.UNITS - 1e-3).all() and above.astype(int).sum(0).max() < 256
    assert (over & (bound >= decontam.SHARED * decontam.UNITS)).sum() <= 1.5 * len(i) < over.sum() / 2


def test_each_span_is_judged(spark, make_docs):
    """A larger share without the answer doesn't hide a smaller one with it."""
    item = [f"q{i}" for i in range(60)]
    text = " ".join([*item[:36], *(f"f{i}" for i in range(200)), *item[26:]])
    got = decontam.contaminated(make_docs([(1, text)]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["answer"]) for r in got] == [(1, 7, 1.0)]


def test_exact_passages_of_the_benchmark(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    assert want <= got and len(got - want) <= 3
