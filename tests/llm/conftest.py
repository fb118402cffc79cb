import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, n long, path string"


def prose(seed, n, words=("the", "of", "and", "tion", "er", "Haus", "été", "niño", "lantern", "river", "quartz", "meadow", "copper", "signal", "harbor", "velvet")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 2))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def rows():
    """Documents with all that is awkward: nulls, empties, copies, near copies, repeated rows, one very long text."""
    out = [(i, prose(i, 60 + i), "en" if i % 2 else "fr", f"src{i % 3}", 0) for i in range(40)]
    base = out[3][1].split()
    out += [(100 + i, " ".join([*base[:20], f"edit{i}", *base[21:]]), "en", "src0", 0) for i in range(12)]
    out += [(200 + i, out[5][1], "en", "src0", 0) for i in range(6)]
    out += [(300, None, "en", "src1", 0), (301, "", None, None, None), (302, " \n\t ", "en", "src1", 3), (303, "two words", "en", "src1", 9), (304, "!!! ??? ...", "de", "src1", 3)]
    out += [(305, prose(305, 9000), "en", "src2", 0), (306, "one two three four five six seven eight nine ten " * 30, "en", "src2", 0)]
    out += [(307, "don't <|endoftext|> Áccents é   nbsp ΣΑΣ 東京 🙂 x​y 12345 a,b.c ...", "en", "src2", 0), (7, out[7][1], "en", "src1", 0), (7, out[7][1], "en", "src1", 0), (8, prose(999, 30), "en", "src1", 0), (None, prose(998, 30), "en", "src1", 0)]
    return [(*r, "clash", "clash", 5, None) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs():
    """(doc_id, text) of all rows."""
    return [(r[0], r[1]) for r in rows()]
