import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import distance

word = st.text(alphabet="abolg01i-éа", max_size=9)
KINDS = dims.substitution_kinds()
COSTS = {"same": 0.0, "visual": 0.25, "keyboard": 0.6, "different": 1.0}


def kind(p, q):
    return "same" if p == q else KINDS.get(p + q, "different")


def brute(a, b):
    """Distance and edits by the plain table."""
    d = [[float(i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    swaps = lambda i, j: i > 1 and j > 1 and a[i - 1] != b[j - 1] and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + COSTS[kind(a[i - 1], b[j - 1])])
            if swaps(i, j):
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if swaps(i, j) and d[i][j] == d[i - 2][j - 2] + 1:
            out.append(("transpose", a[i - 2 : i], b[j - 2 : j], None))
            i, j = i - 2, j - 2
        elif i and j and d[i][j] == d[i - 1][j - 1] + COSTS[kind(a[i - 1], b[j - 1])]:
            out.append(("match" if a[i - 1] == b[j - 1] else "sub", a[i - 1], b[j - 1], kind(a[i - 1], b[j - 1])))
            i, j = i - 1, j - 1
        elif i and (not j or d[i][j] == d[i - 1][j] + 1):
            out.append(("del", a[i - 1], None, None))
            i -= 1
        else:
            out.append(("ins", None, b[j - 1], None))
            j -= 1
    return d[-1][-1], out[::-1]


def aligned(pairs):
    d, edits = distance.alignments([a for a, _ in pairs], [b for _, b in pairs])
    return [(x, [tuple(e.values()) for e in es]) for x, es in zip(d.tolist(), edits.to_pylist())]


@pytest.mark.parametrize("a,b,want", [("ca", "abc", 3), ("googel", "google", 1), ("g00gle", "google", 0.5), ("paypa1", "paypal", 0.25),
                                      ("v", "u", 0.25), ("q", "w", 0.6), ("q", "z", 1), ("m", "n", 0.25), ("", "abc", 3), ("", "", 0)])
def test_known_distances(a, b, want):
    assert aligned([(a, b)])[0][0] == pytest.approx(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(word, word), min_size=1, max_size=12))
def test_alignments_against_brute_force(pairs):
    got = aligned(pairs)
    for (a, b), (d, edits) in zip(pairs, got):
        assert (d, edits) == brute(a, b)
        assert "".join(e[1] or "" for e in edits) == a and "".join(e[2] or "" for e in edits) == b
        assert d == pytest.approx(brute(b, a)[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(word, min_size=1, max_size=20), st.lists(word.filter(bool), min_size=1, max_size=8))
def test_nearest_against_brute_force(words, cores):
    found = distance.nearest(words, cores)
    for k, w in enumerate(words):
        sims = [max(0.0, 1 - brute(w, c)[0] / max(len(w), len(c))) for c in cores]
        best = sims.index(max(sims))
        assert found["similarity"][k] == max(sims)
        assert found["ord"][k] == (best if max(sims) > 0 else -1)
        if max(sims) > 0:
            d, edits = brute(w, cores[best])
            assert found["distance"][k] == d
            assert found["visual"][k] == any(e[3] == "visual" for e in edits)
            assert found["swapped"][k] == any(e[0] == "transpose" for e in edits)
        else:
            assert np.isnan(found["distance"][k])


def test_runs_of_any_size_agree(monkeypatch):
    words = ["googel", "", "paypa1", "x" * 40, "zzz", "amaz0n", "goog1e", "paypal", "аmazon"] * 7
    cores = ["google", "paypal", "amazon"]
    want = distance.nearest(words, cores)
    monkeypatch.setattr(distance, "CELLS", 50)
    got = distance.nearest(words, cores)
    assert all((want[k][w] == got[k][w]) or k == "distance" for k in want for w in range(len(words)))


def test_columns(spark):
    rows = [("googel", "google", ["githubs", "googels"]), (None, "x", None), ("zz", None, []), ("", "ab", ["abcd"]), ("googel", "google", ["googel"])]
    df = spark.createDataFrame(rows, "a string, b string, c array<string>").coalesce(1)
    got = df.select(distance.align(F.col("a"), F.col("b")).alias("x"), distance.nearest_learned(F.col("a"), F.col("c")).alias("n")).collect()
    assert [r["x"]["distance"] for r in got] == [1.0, None, None, 2.0, 1.0]
    assert [e["type"] for e in got[0]["x"]["trace"]] == ["match"] * 4 + ["transpose"]
    assert (got[0]["x"]["trace"][-1]["a"], got[0]["x"]["trace"][-1]["b"]) == ("el", "le")
    assert [r["n"]["ord"] for r in got] == [1, -1, -1, -1, 0]
