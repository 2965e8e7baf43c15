import random
import re

import numpy as np
import pytest

from kestrel.llm import minhash
from kestrel.llm.words import WordHashes


def brute_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(docs, percent):
    """doc -> (size of the set, least id reachable), all pairs compared."""
    sets = {d: brute_set(t) for d, t in docs}
    least, ids = {d: d for d in sets}, sorted(sets)
    pairs = []
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {d: (len(sets[d]), least[d]) for d in ids}


def edited_copies(seed=11):
    """Documents in families of copies with more and more words changed, so that many pairs lie about the limit."""
    rng = random.Random(seed)
    out = []
    for family in range(12):
        body = [f"f{family}w{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 150]))]
        for copy in range(rng.choice([2, 5, 30])):
            words = list(body)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            out.append(" ".join(words).upper() if copy == 1 else " ".join(words))
    return list(enumerate(out))


@pytest.mark.parametrize(("region", "shingles", "small"), [(256, 2_000_000, 8), (4, 2_000_000, 8), (256, 300, 2), (3, 100, 0)])
def test_against_brute_force(spark, monkeypatch, region, shingles, small):
    """Whatever the sizes at which regions go deeper, are dealt in blocks, or give pairs: no link is lost."""
    monkeypatch.setattr(minhash, "SMALL", small)
    docs = edited_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(df, percent=85, region=region, region_shingles=shingles).collect()
    want = brute(docs, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert 12 <= len({c for _, c in want.values()}) < len(docs)


def test_nulls_short_and_long_texts_and_copies(made):
    docs = [(r["doc_id"], r["text"]) for r in made.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(made).collect()}
    assert got == brute(docs, 80)
    assert got[0] == (0, 0) and got[3] == (0, 3)


def test_repeated_and_null_ids_and_ids_of_strings(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [("b", text), ("b", text), (None, text), (None, "alone"), ("a", text + " more"), ("c", None), ("c", "x"), (None, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [
        ("b", 36, "a", False), ("b", 36, "a", False), (None, 36, "a", False), (None, 1, None, True),
        ("a", 37, "a", True), ("c", 0, "c", True), ("c", 1, "c", True), (None, 0, None, True),
    ]))


def test_a_text_with_the_key_of_another_is_not_taken_for_it():
    known = WordHashes()
    packed = next(minhash._pack(iter([minhash.pa.RecordBatch.from_arrays([minhash.pa.array([5]), minhash.pa.array([b"a b c"])], ["k", "t"])])))["packed"][0].as_py()
    shingles = minhash.shingle_set(b"a b c", 5, known)
    s1 = int(minhash._digest(shingles)[0])
    assert minhash._set_of(packed, s1, 5, known).tolist() == shingles.tolist()
    assert minhash._set_of(packed, s1 + 1, 5, known) is None


def test_products_count_what_sets_share(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    near = minhash.linked(sets, 50)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert near[a, b] == (100 * both >= 50 * (len(x) + len(y) - both))


def test_empty_table(nothing):
    assert minhash.near_duplicates(nothing).collect() == []
