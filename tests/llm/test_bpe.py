import base64
import random

import public_tokenizers
import pytest
import tiktoken

from kestrel.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_documents_against_the_library(spark, made, ranks, library):
    read = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert read == ranks
    encoded = bpe.encode(made, read, public_tokenizers.PATTERN, round_trip=True)
    got = {r["doc_id"]: r for r in encoded.collect()}
    again = bpe.decode(encoded.select("doc_id", "ids").repartition(2), read).collect()
    assert {r["doc_id"]: r["decoded"] for r in again} == {k: r["decoded"] for k, r in got.items()}
    for row in made.collect():
        text = row["text"] or ""
        assert got[row["doc_id"]]["ids"] == library.encode_ordinary(text)
        assert bytes(got[row["doc_id"]]["decoded"]).decode() == text


def test_pieces_against_the_library(ranks, library):
    rng = random.Random(1)
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most)))
              for alphabet, most in (("ab", 40), ("thequickr", 60), ("éßü漢字🙂", 30), ("0123", 20), ("aeiout", 1500))
              for _ in range(60)]
    pieces += ["a" * 3000, "ab" * 1500, "x", "\x00" * 70, " the"]
    got = bpe.Vocabulary(ranks).encode([p.encode() for p in pieces])
    for piece, ids in zip(pieces, got, strict=True):
        assert list(ids) == library._encode_single_piece(piece), piece


def test_long_and_short_paths_agree(ranks, monkeypatch):
    vocabulary = bpe.Vocabulary(ranks)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("etaoins") for _ in range(rng.randrange(2, 300))).encode() for _ in range(50)]
    wide = vocabulary.encode(pieces)
    monkeypatch.setattr(bpe, "LONG", 1)
    assert vocabulary.encode(pieces) == wide


def test_empty_table(nothing, ranks):
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).collect() == []
