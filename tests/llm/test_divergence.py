import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kestrel.llm import divergence


def brute(docs, least_docs, top):
    """Rows of the audit by plain loops over whole numbers of any size."""
    counts, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        langs[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + 10**9 * (n + 2) // (all_ + 2 * len(kept))
        p = {(s, t): share(counts[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s, t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s, t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(rows)]
    return sorted(out)


@pytest.fixture(scope="module")
def worded(spark):
    """Documents of few words, some in capitals or beyond ASCII, of sources that prefer words; with nulls and copies."""
    rng = random.Random(4)
    words = [a + b for a in ("ka", "Lo", "mü", "漢") for b in ("", "n", "R", "tt", "é", "zz")]
    rows = [("en", None, None, 1, "k"), (None, "a", "x-x--y", 1, "k"), ("en", "", "1 2 3", 1, "k")]
    for k in range(160):
        source = [None, "a", "b", "ä", "Z"][k % 5]
        some = words[k % 5 : k % 5 + 9] if k % 3 else words
        text = rng.choice([" ", ", ", "3"]).join(rng.choice(some) for _ in range(rng.randrange(1, 60)))
        rows += [(["en", "de", None][k % 3], source, text, k, "k")] * (1 + (k % 20 == 0))
    return spark.createDataFrame(rows, "lang string, source string, text string, n long, term string").repartition(3)


def audited(docs, **how):
    return sorted(map(tuple, divergence.audit(docs, **how).collect()))


@pytest.mark.parametrize("least_docs", [1, 3, 10])
def test_against_plain_loops(worded, least_docs):
    want = brute([(r["lang"], r["source"], r["text"]) for r in worded.collect()], least_docs, 4)
    assert audited(worded, least_docs=least_docs, top=4) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_salts_blocks_and_slices(worded, monkeypatch):
    """Every bound made small: the results stay."""
    want = brute([(r["lang"], r["source"], r["text"]) for r in worded.collect()], 2, 10)
    for name, value in (("BLOCK", 2), ("SLICE", 20), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    terms = divergence.count_vectors(worded, 2)
    groups = divergence.source_groups(worded, terms)
    pairs = divergence.pair_divergences(terms, groups, entries=30).collect()
    assert sorted(map(tuple, pairs)) == sorted((r[0], r[1], r[3], r[4]) for r in want if r[2] == "pair")
    assert list(divergence.terms_of(("Ab" * 40 + " ÄB c-d").encode())) == [[b"ab" * 40], ["Äb".encode(), b"c", b"d"]]


def test_equal_vectors_are_worked_out_once(spark):
    docs = spark.createDataFrame([("en", s, "ab cd ef") for s in "xy"] + [("en", "x", "gh")], "lang string, source string, text string")
    terms = divergence.count_vectors(docs, 1)
    assert terms.select("vector").distinct().count() == 2 and terms.count() == 4
    assert audited(docs, least_docs=1) == brute([tuple(r) for r in docs.collect()], 1, 10)


def test_a_language_without_kept_terms_and_one_with_one_source(spark):
    rows = [("xx", "a", "one"), ("xx", "b", None), ("yy", "a", "two two")] + [(None, None, "x")] * 12
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(docs) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)] == brute(rows, 10, 10)


def test_shares_are_exact_beyond_64_bits():
    n, total = np.array([3 * 10**14, 0, 7]), np.array([8 * 10**14, 9, 10**15])
    want = [1 + 10**9 * (int(a) + 2) // (int(b) + 2 * 12345) for a, b in zip(n, total)]
    assert divergence.shares(n, total, 12345).tolist() == want


def test_long_texts_and_texts_without_terms(made):
    assert audited(made, least_docs=1) == brute([(r["lang"], r["source"], r["text"]) for r in made.collect()], 1, 10)


def test_empty_table(nothing):
    assert divergence.audit(nothing).collect() == []
