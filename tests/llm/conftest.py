import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id long, part int"


def made_texts() -> list[str | None]:
    rng = random.Random(7)
    words = [f"w{rng.randrange(400)}" for _ in range(4000)]
    passage = " ".join(words[:30])
    long_passage = " ".join(words[100:170])
    out: list[str | None] = [None, "", "   ", "\t\n", "one", "One two", "a\tb  c", "a b c", "é ß 漢字 é", " x y"]
    for k in range(40):
        body = [words[rng.randrange(4000)] for _ in range(rng.randrange(5, 90))]
        if k % 4 == 0:
            body[2:2] = [passage]
        if k % 5 == 0:
            body[1:1] = [long_passage]
        out.append(" ".join(body))
    out.append(" ".join(words))
    out += [out[15]] * 5 + [out[16] + " x", out[16].upper(), "ab " * 300, "ab " * 300]
    return out


@pytest.fixture(scope="session")
def made(spark):
    """Documents with nulls, empty texts, copies, one long text, and extra columns of clashing names."""
    rows = [
        (k * 3, text, "en" if k % 3 else None, [None, "a", "b", "ä", "Z"][k % 5], 1, 99, "k", -k, 5)
        for k, text in enumerate(made_texts())
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
