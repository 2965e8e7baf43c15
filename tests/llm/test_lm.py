import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from kestrel.llm import lm, queries
from kestrel.llm.shared import shared_dir


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows, order, discounts):
    train = [tokens(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    grams = lambda t, k: list(zip(*[(["<s>"] * (k - 1) + t)[j : j + len(t)] for j in range(k)]))
    level = {order: Counter(g for t in train for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    followers = {k: defaultdict(list) for k in range(2, order + 1)}
    for k in followers:
        for g, c in level[k].items():
            followers[k][g[:-1]].append(c)
    d = lambda c, k: discounts[k][min(c, 3) - 1] if c else 0
    left = sum(d(c, 1) for c in level[1].values()) / len(level[2])
    out = {}
    for doc, text in rows:
        base = score = known = 0
        for g in grams(tokens(text), order):
            w = g[-1]
            base += math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
            known += counts[w] > 0
            c = level[1][(w,)]
            p = (c - d(c, 1)) / len(level[2]) + left / (v + 1)
            for k in range(2, order + 1):
                some = followers[k][g[-k:-1]]
                if some:
                    c, total = level[k][g[-k:]], sum(some)
                    p = (c - d(c, k)) / total + sum(d(x, k) for x in some) / total * p
            score += math.log10(p)
        out[doc] = (len(tokens(text)), known, base, score)
    return out, n, v, level


@pytest.mark.parametrize("order,bucket_bytes,most_lanes", [(2, 8 << 20, 4096), (2, 2000, 4096), (2, 300, 5), (3, 8 << 20, 4096), (3, 700, 3), (4, 2000, 4)])
def test_against_brute_force(made, order, bucket_bytes, most_lanes, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 60)
    model = lm.train(made.where(~lm.held_out()), order=order, bucket_bytes=bucket_bytes, most_lanes=most_lanes)
    assert model.lanes.lanes <= most_lanes and (model.lanes.subs > 1) == (most_lanes < 10)
    rows = [(r["doc_id"], r["text"]) for r in made.collect()]
    want, n, v, level = brute(rows, order, model.discounts)
    assert (model.tokens, model.distinct) == (n, v)
    assert model.types == {k: len(level[k]) for k in range(2, order + 1)}
    for k in range(1, order + 1):
        classes = Counter(level[k].values())
        assert model.discounts[k] == pytest.approx(lm.discounts(*(classes[j] for j in (1, 2, 3, 4))))
    got = {r["doc_id"]: r for r in lm.score(made, model).collect()}
    for doc, (n_tokens, known, base, score) in want.items():
        r = got[doc]
        assert (r["n_tokens"], r["n_known"]) == (n_tokens, known)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_query_scores_by_three_words(spark, made, tmp_path):
    made.write.parquet(f"{tmp_path}/documents.parquet")
    model = lm.train(made.where(~lm.held_out()), order=3)
    want = brute([(r["doc_id"], r["text"]) for r in made.collect()], 3, model.discounts)[0]
    got = {r["doc_id"]: r["score"] for r in queries.op3_lm_scoring(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: v[3] for k, v in want.items()})


def test_three_words_take_few_bytes(spark):
    def left():
        top = shared_dir(spark).removeprefix("file://")
        return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(top) for f in files)

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = left()
    model = lm.train(docs, order=3)
    assert left() - before < 50 * model.types[3]  # 119 with tables of hashes and of all contexts, 33 with tries


def test_words_hashed_together():
    from kestrel.llm.words import word_hashes

    rng = random.Random(3)
    pool = [bytes(rng.choice(b"ab\x00\x1c\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(300)]
    for text in [b"", b" ", b"a", b" a\t", b"".join(w + rng.choice([b" ", b"\n", b"\x0b \r"]) for w in pool * 3)]:
        start, got = word_hashes(text)
        words = text.split()
        assert all(text[k : k + len(w)] == w for k, w in zip(start, words, strict=True))
        assert len(set(zip(words, got.tolist(), strict=True))) == len(set(words)) == len(set(got.tolist()))


def test_few_files_stay_mapped(made, monkeypatch):
    monkeypatch.setattr(lm, "MOST_MAPPED", 3)
    model = lm.train(made, bucket_bytes=500)
    a = {r["doc_id"]: r["score"] for r in lm.score(made, model).collect()}
    whole = lm.train(made)
    b = {r["doc_id"]: r["score"] for r in lm.score(made, whole).collect()}
    assert model.lanes.lanes > 20 and a == pytest.approx(b)


def test_ids_of_any_kind_repeat_and_may_be_null(spark):
    from decimal import Decimal

    rows = [(Decimal(1), "a b", "x"), (Decimal(1), "a b", "x"), (None, None, "y"), (None, "b", "z")]
    docs = spark.createDataFrame(rows, "id decimal(10,0), text string, score string")
    model = lm.train(docs)
    got = sorted((str(r["id"]), r["n_tokens"], round(r["score"], 9)) for r in lm.score(docs, model, id_col="id").collect())
    assert [g[:2] for g in got] == [("1", 3), ("1", 3), ("None", 1), ("None", 2)] and got[0] == got[1]


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c " * 400), (2, "a b"), (3, "c c c")], "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: r["score"] for r in lm.score(docs, lm.train(docs)).collect()}
    monkeypatch.setattr(lm, "CHUNK_WORDS", 50)
    parts = {r["doc_id"]: r["score"] for r in lm.score(docs, lm.train(docs, bucket_bytes=100, most_lanes=2)).collect()}
    assert parts == pytest.approx(whole)


def test_better_than_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.train(docs.where(~lm.held_out()))
    r = lm.score(docs.where(lm.held_out()), model).groupBy().sum("score", "base_score").first()
    assert r[0] > r[1]


def test_empty_tables(nothing, made):
    model = lm.train(nothing)
    assert lm.score(nothing, model).collect() == []
    assert {r["score"] for r in lm.score(made.limit(3), model).collect()} == {0.0}
