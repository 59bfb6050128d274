import random

import pytest

WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho Été école straße 漢字 x1 y2".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "q", "z", "w"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empties, copies, near copies, a passage that many share, one long text, repeated and null ids."""
    rng = random.Random(11)
    base = [sentence(rng, n) for n in (3, 8, 40, 60, 120, 200)]
    passage = sentence(rng, 90)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base[0]), (5, base[0]), (6, "one"), (7, base[2]), (8, base[2]), (9, base[2].upper())]
    for i in range(10, 24):  # near copies of one text
        words = base[4].split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(i, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 30)) for i in range(30, 45)]
    rows += [(50, sentence(rng, 4000)), (51, "Wher. " * 300), (52, passage), (7, base[2]), (7, base[3]), (None, base[5]), (None, None), (60, base[1] + "\n" + base[1] + "\n\n" + base[1])]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with further columns, one of which has a name that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0" if (i or 0) % 3 else None, len(t or ""), 7, "row") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, n int, row_key string")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
