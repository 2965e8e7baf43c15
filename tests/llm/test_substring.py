import re

from pyspark.sql import functions as F

from kestrel.llm.substring import remove_repeats


def brute(docs, width):
    seen, flagged, words = {}, {}, {}
    for doc, text in sorted(docs):
        words[doc] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        flagged[doc] = set()
        for i in range(len(words[doc]) - width + 1):
            window = tuple(words[doc][i : i + width])
            if window in seen:
                flagged[doc].update(range(i, i + width))
            else:
                seen[window] = doc
    return {
        doc: (len(w), len(flagged[doc]), " ".join(x for k, x in enumerate(w) if k not in flagged[doc]))
        for doc, w in words.items()
    }


def spans_cover(row):
    return sum(s["end"] - s["start"] for s in row["spans"]) == row["n_removed"]


def test_against_brute_force(made):
    want = brute([(r["doc_id"], r["text"]) for r in made.collect()], 20)
    for bucket_bytes, most_lanes in ((8 << 20, 4096), (1000, 4096), (300, 3)):
        got = remove_repeats(made, 20, bucket_bytes=bucket_bytes, most_lanes=most_lanes).collect()
        assert all(map(spans_cover, got))
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 1000


def test_intervals_are_maximal(made):
    for row in remove_repeats(made, 20).collect():
        ends = [(s["start"], s["end"]) for s in row["spans"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_repeated_rows_keep_each_other(spark):
    text = " ".join(f"t{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(False, 1, 40), (False, 1, 40), (False, 2, 40), (True, 0, 0)]


def test_an_id_with_different_texts_loses_no_text_that_never_repeats(spark):
    w, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "wz")
    docs = spark.createDataFrame([(1, w), (2, w), (2, z), (None, z[:20]), (None, "n " * 30)], "doc_id int, text string")
    got = remove_repeats(docs)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    rows = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()}
    short = " ".join(z[:20].split())
    want = brute([(0, "n " * 30), (1, short), (2, w), (3, w), (4, z)], 20)
    assert rows == {(i, *want[k]) for i, k in ((None, 0), (None, 1), (1, 2), (2, 3), (2, 4))}


def test_ids_of_strings(spark, made):
    docs = made.select(F.format_string("d%06d", "doc_id").alias("doc_id"), "text")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 20)
    for most_lanes in (4096, 3):
        got = remove_repeats(docs, 20, bucket_bytes=300, most_lanes=most_lanes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    from kestrel.llm import substring

    monkeypatch.setattr(substring, "CHUNK_WORDS", 30)
    texts = {1: " ".join(f"t{k % 70}" for k in range(400)), 2: " ".join(f"t{k}" for k in range(50)), 3: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    want = brute(texts.items(), 20)
    for most_lanes in (4096, 2):
        got = remove_repeats(docs, 20, bucket_bytes=200, most_lanes=most_lanes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_empty_table(nothing):
    assert remove_repeats(nothing).collect() == []
