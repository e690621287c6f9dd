import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is with for was stone river light house morning paper garden window letter summer winter market bridge forest".split()
GERMAN = "der die und das nicht ein eine mit auf für von sich auch werden haus strasse wasser morgen abend fenster garten winter schule".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.choice(["", "s", "ed", "ing"])) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and clashing ids."""
    long = prose(99, 6000)
    near = long.split()
    near[17] = "otherwise"
    out = [(i, prose(i, 20 + 7 * i), "en", f"s{i % 3}", None) for i in range(30)]
    out += [(100 + i, prose(50 + i, 25 + 5 * i, GERMAN), "de", "s1", 3) for i in range(20)]
    out += [(200, long, "en", "s0", 1), (201, " ".join(near), "en", "s0", 1), (202, long.upper(), "en", None, 1)]
    out += [(210 + i, out[5][1], "en", "s2", 1) for i in range(40)]
    out += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \n\t", "de", "s0", 3), (303, "12 34 ... !!", "en", "s0", 3)]
    out += [(None, "null id and a text", "en", "s0", 1), out[3], out[3]]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
