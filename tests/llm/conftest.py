import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Null and empty texts, blanks, long and short ones, ties, repeated rows, null ids, shared lines."""
    rng = random.Random(3)
    words = ["the", "of", "and", "straße", "naïve", "Été", "alpha", "beta", "gamma", "delta", "x1", "don't", "漢字", "😀"]
    text = lambda n: " ".join(rng.choice(words) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))
    shared = "A line of more than forty code points that many documents share."
    long = text(6000)
    base = text(80)
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \t\n\x0b\x0c\r ", None, None, 7), (3, "one", "en", "b", 3), (4, long, "en", "a", len(long)),
        (5, base, "en", "a", 1), (6, base, "fr", "b", 1), (7, base + " tail", None, "c", 1), (7, base + " tail", None, "c", 1), (None, text(50), "en", None, None),
        (None, None, None, None, None), (9, "12345 !!! ...", "en", "c", 5), (10, "ÀÉ\n>\n\n", "fr", "c", 4),
    ]
    rows += [(20 + i, f"{text(40)}\n  {shared.upper() if i % 2 else shared}\t\n{text(5)}\n{shared}", "en" if i % 2 else "fr", "abc"[i % 3], 9) for i in range(7)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names clash with the operators' own."""
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ["id", "k", "size", "n_lines", "target", "score", "component_id", "length", "u", "h", "at", "n_words", "fingerprint", "part", "start"]
    return df.selectExpr("*", *[f"'x' as {n}" for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
