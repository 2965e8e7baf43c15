import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.llm import chat, exact, sharding


@pytest.mark.parametrize("n", [1, 4, 40, 500])
def test_shards(made, n):
    got = sharding.assign_shards(made, n).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in made.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {
        d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()
    }
    got.sort(key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)  # contiguous
    start, by_shard = 0, defaultdict(list)
    total = sum(r["size"] for r in got)
    for r in got:
        assert r["start_byte"] == start
        assert r["shard"] == (2 * start + r["size"]) * n // (2 * total) < n
        start += r["size"]
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_shards_of_repeated_and_null_ids(spark, nothing):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = sharding.assign_shards(docs, 2).collect()
    assert len(got) == 5 and [r["size"] for r in got if r["doc_id"] == 2] == [16]
    assert [r["start_byte"] for r in got if r["doc_id"] is None] == [0]
    assert sharding.assign_shards(nothing, 3).collect() == []


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "there"), (1, 3, "assistant", "a<|im_end|>\nb"), (1, 4, "assistant", None),
    (2, 5, "assistant", "<|im_sep|><\\|x|> <\\\\|im_start|>"), (2, 5, "assistant", "same turn"), (2, None, None, "\n\n"),
    (3, 0, "us\ner", "x"), (3, 1, "us\\ner", "y"), (3, 2, "<|im_end|>", "z"), (3, 3, "a\\\\n", ""),
    (None, 0, "user", "<|im_end|><|im_start|>assistant ok"), (4, 0, "user", "é" * 5000), (4, 0, "user", "é" * 5000),
]


def test_conversations_round_trip(spark):
    df = spark.createDataFrame([(*t, 9, "x") for t in TURNS], "conv_id long, turn long, role string, text string, turns int, formatted string")
    got = {r["conv_id"]: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    want = defaultdict(list)
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    one = got[1]["formatted"]
    assert one.count("<|im_start|>") == one.count("<|im_end|>\n") == 3 and one.count("<|im_sep|>") == 2
    assert one.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_sep|>there<|im_end|>\n")
    loss = {r[0]: r[1] for r in chat.parse_conversations(chat.format_conversations(df)).select("conv_id", chat.loss_texts(F.col("turns"))).collect()}
    assert loss[1] == ["a<|im_end|>\nb", ""]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse_conversations(chat.format_conversations(df)).collect() == []


@pytest.mark.parametrize("capacity", [50_000, 2])
def test_exact_duplicates(made, capacity):
    groups = defaultdict(list)
    for r in made.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    got = {r["doc_id"]: r for r in exact.exact_duplicates(made, capacity=capacity).collect()}
    assert len(got) == sum(map(len, groups.values()))
    for text, ids in groups.items():
        for d in ids:
            r = got[d]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), d == min(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = exact.first_copies(made, exact.exact_duplicates(made, capacity=capacity))
    assert kept.columns == made.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(map(min, groups.values()))


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"), F.lit(1).cast("long").alias("n"))
    buckets = exact.build_directory(keys, 100).collect()
    assert sum(b["n"] for b in buckets) == 2000 and all(b["n"] <= 100 for b in buckets)
    assert len({b["depth"] for b in buckets}) > 1
    spans = sorted((b["bucket"] << (64 - b["depth"]), (b["bucket"] + 1) << (64 - b["depth"])) for b in buckets)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # no key belongs to two
    one = spark.createDataFrame([(5, 1000)], "key long, n long")
    assert [(b["depth"], b["n"]) for b in exact.build_directory(one, 100).collect()] == [(0, 1000)]


def test_repeated_rows_keep_one(spark, nothing):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None), (4, "")], "doc_id long, text string")
    got = exact.exact_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter(
        [(1, True), (1, False), (2, False), (None, True), (None, False), (3, True), (4, False)]
    )
    assert exact.exact_duplicates(nothing).collect() == []


def test_buckets_decide_copies(made, monkeypatch):
    written, build = [], exact.build_directory

    def late(keys, capacity):
        assert not any({"keep_id", "group_size"} & set(c) for c in written)  # nothing is decided before the directory
        buckets = build(keys, capacity)
        return buckets.where(F.col("bucket") % 2 == 0)

    store = exact.keep
    monkeypatch.setattr(exact, "keep", lambda df, name: (written.append(df.columns), store(df, name))[1])
    whole = {r["doc_id"] for r in exact.exact_duplicates(made, capacity=4).collect()}
    written.clear()
    monkeypatch.setattr(exact, "build_directory", late)
    assert 0 < exact.exact_duplicates(made, capacity=4).count() < len(whole)


def few_keys(norm):
    return F.shiftleft((F.length(norm) % 3).cast("long"), 62)


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_texts_of_one_hash_value_are_chained(made, monkeypatch, hot):
    want = Counter(map(tuple, exact.exact_duplicates(made, capacity=4).collect()))
    monkeypatch.setattr(exact, "hashed", few_keys)
    _, _, index = exact.build_index(made, capacity=4, hot=hot)
    assert max(r["chain"] for r in index.collect()) > 10
    assert Counter(map(tuple, exact.exact_duplicates(made, capacity=4, hot=hot).collect())) == want


def test_owners_compare_texts(made, monkeypatch):
    """The key decides nothing: owners that take a key's texts for one give fewer, larger groups."""
    monkeypatch.setattr(exact, "hashed", few_keys)
    whole = exact.build_index(made, capacity=4)[2].count()
    rank = Window.partitionBy("owner", "key").orderBy(F.lit(1))
    monkeypatch.setattr(exact, "chain_of", lambda: F.dense_rank().over(rank))
    assert exact.build_index(made, capacity=4)[2].count() == 3 < whole


def test_hot_texts_reach_their_owner_combined(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same  text").otherwise(F.col("id").cast("string")).alias("text"))
    keyed = docs.repartition(40).select(F.col("doc_id").alias("id"), exact.hashed(F.col("text")).alias("key"), F.col("text").alias("norm"))
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = exact.owned_texts(keyed, keys, 8, 100)
    assert sorted(r["group_size"] for r in got.collect()) == [1] * 1000 + [2000]
    assert [r["keep_id"] for r in got.where("group_size > 1").collect()] == [1]

