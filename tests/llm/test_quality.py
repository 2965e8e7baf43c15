import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    docs, labels = [], []
    for k in range(900):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        if kind == "junk":
            body = [w.upper() + "!!" for w in body]
        if kind == "toxic":
            for w in rng.sample(["nastyword", "vileword", "rudeword"], 2):
                body.insert(rng.randrange(len(body)), w)
        text = " ".join(body)
        docs.append((k, text, "en", f"src{k % 5}", len(text)))
        if k < 600:
            labels.append((k, int(kind != "junk"), int(kind == "toxic")))
        else:
            labels.append((-k - 1, int(kind == "good"), 0))
    truth = {-d - 1: q for d, q, _ in labels if d < 0}
    tables = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([x for x in labels if x[0] >= 0], "doc_id long, quality int, toxic int")
    return *tables, truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count()
    right = [(got[k]["quality_score"] >= 0.5) == bool(q) for k, q in truth.items()]
    assert np.mean(right) > 0.95
    assert any(n for pair in model.added for n in pair)  # the views taught each other


def plain_view(view, features, dense):
    """A view's calibrated probability of one document, from its features and measures."""
    weight = dict(zip(view.keys.tolist(), view.weights.tolist()))
    odds = dict(zip(view.evidence.keys.tolist(), view.evidence.odds.tolist()))
    cut = lambda x: max(-30.0, min(30.0, x))
    told = [0.0, 0.0]
    if view.evidence.taught:
        log = [
            sum(-0.5 * ((x - m) ** 2 / v + math.log(v)) for x, m, v in zip(dense, view.evidence.mean[k], view.evidence.variance[k]))
            for k in (0, 1)
        ]
        told = [cut(sum(odds.get(f, 0.0) for f in features)), cut(log[1] - log[0])]
    z = sum(weight.get(f, 0.0) for f in features) + view.bias
    z += sum((x - m) / s * w for x, m, s, w in zip([*dense, *told], view.dense_mean, view.dense_scale, view.dense_weights))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, view.slope * z + view.shift))))


def test_a_round_against_brute_force(corpus):
    docs, labels, _ = corpus
    model = quality.train(docs, labels, rounds=1)
    first = quality.train(docs, labels, rounds=0)
    learned = [defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])]
    taught = [[0, 0, 0], [0, 0, 0]]
    sums = [np.zeros((3, quality.SHAPES)), np.zeros((3, quality.MEASURES))]
    for r in docs.collect():
        text, page = quality.featurise([r["text"]], [r["lang"]], [r["source"]], [r["n_chars"]])
        p = [plain_view(v, set(x.places.tolist()), x.dense[0].astype(np.float32).tolist()) for v, x in ((first.text, text), (first.page, page))]
        for view, (rows, by) in enumerate(((text, p[1]), (page, p[0]))):
            for c, sure in enumerate((by >= 0.98, by <= 1 - 0.98, True)):
                if sure:
                    taught[view][c] += 1
                    sums[view][c] += rows.dense[0]
                    for f in set(rows.places.tolist()):
                        learned[view][f][c] += 1
    assert model.added == [tuple(g + b for g, b, _ in taught)] and all(model.added[0])
    for view, (v, limit) in enumerate(((model.text, 16_384), (model.page, 16_384))):
        e = v.evidence
        x, y = (k if taught[view][k] else 2 for k in (0, 1))  # all documents stand for a class without sure ones
        good, bad = taught[view][x], taught[view][y]
        chi = {}
        for f, counts in learned[view].items():
            g, n, share, seen = counts[x], good + bad, good / (good + bad), counts[x] + counts[y]
            found = (g - seen * share) ** 2 / max(seen * share * (1 - share) * (1 - seen / n), 1e-9)
            if seen >= 4 and found >= 10:
                chi[f] = found
        best = sorted(sorted(sorted(chi), key=lambda f: -chi[f])[:limit])
        assert best == e.keys.tolist()
        odds = [math.log((learned[view][f][x] + 1) / (good + 2)) - math.log((learned[view][f][y] + 1) / (bad + 2)) for f in best]
        assert e.odds.tolist() == pytest.approx(odds)
        assert e.mean[1].tolist() == pytest.approx((sums[view][x] / good).tolist(), rel=1e-4)
        assert e.mean[0].tolist() == pytest.approx((sums[view][y] / bad).tolist(), rel=1e-4)


def test_every_document_counts(corpus):
    docs, labels, _ = corpus
    many = docs
    for k in range(1, 4):
        many = many.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000 * k))
    once, more = (quality.train(d, labels, rounds=1).added[0] for d in (docs, many))
    assert more == tuple(4 * n for n in once) and all(once)


def test_scores_of_one_batch_or_many_agree(corpus):
    docs, labels, _ = corpus
    model = quality.train(docs, labels)
    a, b = ({r["doc_id"]: r["quality_score"] for r in quality.score(d, model, columns=["doc_id"]).collect()} for d in (docs, docs.repartition(7)))
    assert a == pytest.approx(b)


def test_odd_rows(spark, made, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (3, 1, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(made, labels)
    out = quality.score(made.withColumn("quality_score", F.lit("x")), model)
    assert out.columns == [*made.columns, *quality.SCORES]
    assert out.count() == made.count()
    empty = quality.train(nothing, labels.limit(0))
    assert quality.score(nothing, empty).collect() == []
    assert {r["quality_score"] for r in quality.score(made, empty).collect()} == {1.0}


def test_most_frequent_word_of_any_text():
    for others in (10, 51, 400):
        text = " ".join(["buy"] * 600 + [f"w{k}" for k in range(others)])
        assert quality.content_shape(text)[1] == pytest.approx(600 / (600 + others))
