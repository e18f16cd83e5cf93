import random

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, near copies and clashing columns."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(45), text(9)
    base = text(150).split()
    rows = [(i, text(rng.randint(0, 60)), f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, f"{text(5)}\n{line}\n{text(12)} {passage} {text(3)}", f"s{i % 13}") for i in range(30)]
    for i in range(20):
        own = list(base)
        own[rng.randrange(len(own))] = "changed"
        rows.append((200 + i, " ".join(own), f"s{i % 3}"))
    rows += [(300, " ".join(base), None), (301, " ".join(base), None), (301, " ".join(base), None)]
    rows += [(400, None, "s1"), (401, "", "s1"), (402, " \t\n ", None), (None, text(30), "s2"), (None, None, None), (403, text(6000), "s4"), (404, ("la " * 90).strip(), "s5"), (405, "x", "s6"), (406, "ÄÖ\u3000ß é\u0301 İ Σς <|endoftext|> a\x1cb", "s7")]
    shape = "doc_id long, text string, source string"
    return spark.createDataFrame(rows, shape).selectExpr("*", "'en' as lang", "length(text) as n_chars", "1 as score", "2 as size", "3 as n", "4 as copies", "5 as start")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)
