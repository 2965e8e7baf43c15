import base64
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from kestrel.llm import mixing
from tests.llm.test_simhash import brute_components, brute_print


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, budget = set(), sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        target = {s: left * weight[s] / total for s in rest} | {s: most * sizes[s] for s in full}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def brute_mix(docs):
    """{doc_id: taken} of rows (doc_id, text, source)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes = Counter()
    for d, _, s in docs:
        sizes[s] += size[d]
    out = {}
    for s, target in brute_targets(sizes).items():
        mine = sorted((d for d, _, x in docs if x == s), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
        epochs = int(target // sizes[s]) if sizes[s] else 0
        rest = int(target) - epochs * sizes[s]
        for d in mine:
            part = max(0, min(size[d], rest))
            rest -= size[d]
            out[d] = epochs * size[d] + part
    return out, size


def test_mix_against_brute_force(made, nothing):
    want, size = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in made.collect()])
    got = mixing.mix_sources(made, slice_rows=3).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == want
    assert {r["doc_id"]: r["size"] for r in got} == size
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(taken[s] == int(target[s]) for s in target)
    assert mixing.mix_sources(nothing).collect() == []


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == docs.columns
        kept[name] = [tuple(r) for r in step.select("doc_id", "text", "source").collect()]
        step = spark.createDataFrame(step.collect(), docs.schema)
    good, first, one, mixed = kept.values()
    assert 0.5 * docs.count() < len(good) < docs.count()

    groups = {}
    for d, t, _ in sorted(good):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    assert sorted(d for d, *_ in first) == sorted(groups.values())
    near = brute_components({d: brute_print(t) for d, t, _ in first})
    assert sorted(d for d, *_ in one) == sorted(d for d, c in near.items() if c == d)
    taken, size = brute_mix(one)
    assert Counter(d for d, *_ in mixed) == {d: -(-n // size[d]) for d, n in taken.items() if n}

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = Counter((d, len(ids := library.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(t.encode()).hexdigest()) for d, t, _ in mixed)
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want


ODD = [
    (1, "red green blue", "en", "a", 14), (1, "red green blue", "en", "a", 14), (1, "one two three four five", "en", "a", 23),
    (None, "red green blue", "en", "b", 14), (None, "grey skies over the sea", "en", "a", 23), (None, "grey skies over the sea", "en", "b", 23),
    (None, None, "en", "a", 0), (2, "one two three four five", "en", "b", 23), (3, "", "en", "b", 0),
]


def test_stages_on_repeated_rows_and_null_ids(spark, sf_dir):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    rows = lambda df: Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    given = rows(docs)
    good = rows(stages[0](spark, docs, sf_dir))
    assert all(n == given[row] for row, n in good.items())  # equal rows fare alike
    one = Counter([(1, "red green blue"), (1, "one two three four five"), (None, "grey skies over the sea"), (3, "")])
    assert rows(stages[1](spark, docs, sf_dir)) == one
    assert rows(stages[2](spark, docs, sf_dir)) == one
    mix = mixing.mix_sources(docs).collect()
    want = Counter()
    for r in mix:
        want[r["doc_id"], r["size"]] += -(-r["taken"] // r["size"]) if r["taken"] else 0
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in stages[3](spark, docs, sf_dir).collect())
    assert got == +want
    assert stages[4](spark, docs, sf_dir).count() == len(ODD)
