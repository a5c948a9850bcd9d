"""Shared by the tests of the llm subpackage."""

import random

import pytest

ALPHABET = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def sentence(rng, n):
    return " ".join(rng.choice(ALPHABET) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture()
def docs(spark):
    """Copies, near copies, shared passages, short, blank, null, long and repeated rows, with extra columns of clashing names."""
    rng = random.Random(5)
    base = [sentence(rng, 80) for _ in range(6)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(base)]
    rows += [(10, base[0], "s0"), (11, base[1] + " tail", "s1"), (12, base[2][:-4] + "zz", None), (13, base[3] + "\n" + base[4], "s0")]
    words = base[5].split()
    for i in range(20, 30):
        words = [*words]
        words[rng.randrange(80)] = f"new{i}"
        rows.append((i, " ".join(words), "s1"))
    rows += [(40, None, "s0"), (41, "", "s0"), (42, " \n\t ", "s1"), (43, "two words", "s1"), (44, "Two  WORDS", None), (45, "élève 中文 \U0001f600 fin", "s0"), (46, sentence(rng, 3000), "s0"), (46, sentence(rng, 30), "s0"), (43, "two words", "s1"), (None, base[0], "s1")]
    return spark.createDataFrame([(a, b, "x", c, 7, None, "y") for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long, component long, words string")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
