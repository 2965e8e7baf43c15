import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.llm import vectorcode

SCHEMA = "vec_id long, embedding array<float>, label int, code int, l string"


def brute(rows, parts, entries, rounds, scale):
    """Codes and errors by plain loops, and the codebooks."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.floor(np.float64(np.float32(x)) * scale)) for x in r[1]] for r in rows]
    w = len(whole[0]) // parts
    cut = [[tuple(v[k * w : k * w + w]) for k in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(v[p], books[p])[1] for v in cut]
            books[p] = [
                tuple(sum(c) // len(c) for c in zip(*[cut[i][p] for i in range(len(cut)) if at[i] == k])) if k in at else y
                for k, y in enumerate(books[p])
            ]
    best = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in b) for b in best]
    of_label = {r[2]: sum(e for e, o in zip(errors, rows) if o[2] == r[2]) for r in rows}
    out = [(r[0], bytes(k for _, k in b), e, of_label[r[2]]) for r, b, e in zip(rows, best, errors)]
    return out, hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()


def vectors(n, width, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = np.round(rng.normal(size=width), 1 if k % 2 else 3).astype(np.float32).tolist()
        out.append((k * 7 % n, v, [1, 1, 1, None, k % 4][k % 5], 1, "x"))
    out[3] = (out[3][0], None, 1, 1, "x")
    out[4] = (out[4][0], [None, *out[4][1][1:]], 1, 1, "x")
    out[5] = (out[5][0], [float("nan"), *out[5][1][1:]], 1, 1, "x")
    out[6] = (out[6][0], [*out[6][1][1:], float("-inf")], 1, 1, "x")
    out[7] = (None, out[8][1], None, 1, "x")
    out[9] = out[10]
    return out


@pytest.mark.parametrize(("parts", "entries", "width"), [(4, 16, 8), (2, 64, 16), (8, 3, 8)])
def test_against_plain_loops(spark, parts, entries, width):
    rows = vectors(150, width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    books = vectorcode.train(df, parts=parts, entries=entries)
    got = vectorcode.with_label_errors(vectorcode.encode(df, books)).select("vec_id", "code", "error", "label_error").collect()
    want, digest = brute(rows, parts, entries, 2, 256)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r[0], bytes(r[1]), r[2], r[3]) for r in got), key=key) == sorted(want, key=key)
    assert books.sha256() == digest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=64), st.lists(st.tuples(*[st.integers(-4, 4)] * 3), min_size=1, max_size=40))
def test_nearest_keeps_the_lower_index_of_ties(book, rows):
    book, x = np.array(book), np.array(rows)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    index, best = vectorcode.nearest(vectorcode.build_tree(book), book, x)
    assert index.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()


def test_decoded_vectors_lie_near(spark):
    rows = vectors(200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    books = vectorcode.train(df, parts=8, entries=64, rounds=4)
    coded = {r["vec_id"]: r["code"] for r in vectorcode.encode(df, books).collect()}
    kept = [r for r in rows if r[0] in coded and r[1]]
    back = books.decode(np.array([list(coded[r[0]]) for r in kept]))
    assert np.abs(back - np.array([r[1] for r in kept], float)).mean() < 0.05


def test_other_lengths_huge_values_and_bad_shapes(spark):
    rows = [(1, [0.0, 1.0], None), (2, [3e38, -3e38], None), (3, [1.0, 2.0, 3.0], 1), (4, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = vectorcode.train(df, parts=2, entries=64)
    got = {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in vectorcode.encode(df, books).collect()}
    assert got == {1: (b"\0\0", 0), 2: (b"\1\1", 0)}
    with pytest.raises(ValueError):
        vectorcode.train(df, parts=3)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    assert vectorcode.train(df) is None
    books = vectorcode.Codebooks(np.zeros((2, 1, 1), np.int64), 256)
    assert vectorcode.with_label_errors(vectorcode.encode(df, books)).collect() == []
