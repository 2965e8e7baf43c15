import random
import re

import pytest
import xxhash

from kestrel.llm import simhash
from kestrel.llm.graph import components


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def brute_components(prints):
    parent = {k: k for k in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {k: root(k) for k in ids}


def test_against_brute_force(made):
    want = {r["doc_id"]: brute_print(r["text"]) for r in made.collect()}
    got = simhash.near_duplicates(made).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == want
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(want)


@pytest.mark.parametrize("small_cell", [64, 3])
def test_links_of_clustered_prints(spark, small_cell):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = {k: p for k, p in enumerate(sorted(prints))}
    want = brute_components(prints)
    signed = {p - 2**64 if p >= 2**63 else p: k for k, p in prints.items()}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df, small_cell=small_cell, block=16)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    groups, expected = {}, {}
    for p, k in signed.items():
        groups.setdefault(roots.get(p, p), set()).add(k)
        expected.setdefault(want[k], set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(1, 1), (339, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(300, 340)]}


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
