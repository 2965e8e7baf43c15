"""All places of many patterns against plain search."""

import random

import numpy as np
import pytest

from kestrel.operators import match, patterns


def places(text, some):
    return sorted((p, k, k + len(p)) for p in set(some) if p for k in range(len(text or "") - len(p) + 1) if text[k : k + len(p)] == p)


def made():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé漢😀-") for _ in range(n))
    some = ["a", "ab", "abab", "b", "bé", "😀", "aaaa", "a" * 40, "", "zz"] + [word(rng.randrange(1, 6)) for _ in range(300)]
    texts = [None, "", "a", "a" * 100, "abababab", "x", "b😀é漢" * 50] + [word(rng.randrange(0, 200)) for _ in range(60)]
    return texts, some


@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_pieces_of_any_length(monkeypatch, piece):
    monkeypatch.setattr(patterns, "PIECE", piece)
    texts, some = made()
    machine = patterns.build(some)
    for text in texts[1:]:
        pattern, end = machine.find(np.array(list(map(ord, text)), np.uint32))
        got = sorted((machine.patterns[p], e - len(machine.patterns[p]), e) for p, e in zip(pattern.tolist(), end.tolist()))
        assert got == places(text, some)


@pytest.mark.parametrize("most_bytes", [64 << 20, 2000])
def test_against_plain_search(spark, most_bytes):
    texts, some = made()
    assert (len(patterns.automata(some, most_bytes)) > 3) == (most_bytes == 2000)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    spelt = spark.createDataFrame([(p,) for p in some] + [(None,), ("ab",)], "pattern string")
    got = patterns.find_patterns(docs, spelt, id_col="id", text_col="body", most_bytes=most_bytes)
    want = sorted((k, *p) for k, t in enumerate(texts) for p in places(t, some))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10_000


def test_no_patterns_no_texts_and_too_many(spark):
    docs = spark.createDataFrame([(1, "abc")], "id int, body string")
    none = spark.createDataFrame([], "pattern string")
    assert patterns.find_patterns(docs, none, id_col="id", text_col="body").collect() == []
    some = spark.createDataFrame([("abc",)], "pattern string")
    assert patterns.find_patterns(docs.limit(0), some, id_col="id", text_col="body").collect() == []
    with pytest.raises(ValueError):
        patterns.find_patterns(docs, some, id_col="id", text_col="body", most_bytes=0)


def test_brands_in_labels_at_every_place(spark):
    df = spark.createDataFrame([("paypal-paypal",), ("ppaypaypal",), ("x",), (None,)], "label string")
    got = sorted((r["label"], r["core"], r["start"], r["stop"]) for r in match.brand_patterns(df, "label").collect() if r["core"] == "paypal")
    assert got == [("paypal-paypal", "paypal", 0, 6), ("paypal-paypal", "paypal", 7, 13), ("ppaypaypal", "paypal", 4, 10)]
