"""Small awkward tables that every operator must take."""

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id string, key string, node string, rank string, score string, __id string, __text string, size string, host string")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that do not repeat in the same order."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2 ** 31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 97))
    return " ".join(out)


def rows():
    long = prose(5, 30_000)
    texts = [
        (0, prose(1, 120)), (1, prose(1, 120)), (2, prose(1, 119) + " changed"), (3, prose(2, 90) + "\n" + prose(3, 40)),
        (4, ""), (5, None), (6, " \n\t "), (7, "One two"), (8, "one TWO"), (9, long), (10, long), (11, "x" + long),
        (12, "Licensed under CC BY-NC 4.0.\nAll rights  reserved. Größe Übung 東京 🙂"), (None, prose(4, 60)), (None, None),
        (7, "One two"), (13, prose(3, 40)), (14, "a" * 3000), (15, "he " * 600), (16, "\n".join(["same line", prose(8, 30), "same line"])),
    ]
    texts += [(20 + i, f"boilerplate here\n{prose(50 + i, 30)}") for i in range(6)]
    return [(i, t, None if i == 3 else "en", [None, "b", "a", "ü"][(i or 0) % 4], None if t is None else len(t),
             "c", None, "c", "c", "c", "c", "c", "c", "c") for i, t in texts]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
