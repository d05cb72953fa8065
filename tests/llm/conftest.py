import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, size int, fp string"


def make_rows(seed=1):
    """Documents with every awkward case: null and empty texts, white space only, a very long
    text, copies, near copies, repeated rows, a repeated id with another text, a null id, null
    sources; three extra columns have names that the operators use themselves."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = text(50), text(12)
    base = [text(r.randint(1, 120)) for _ in range(40)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k % 3]) for k in range(9)]
    out += [(120 + k, " " + base[5].replace(" ", "\t", k) + "\n") for k in range(4)]
    out += [(140 + k, base[7] + " " + passage + " " + text(5)) for k in range(4)]
    out += [(160 + k, text(20) + "\n  " + line.upper() + " \n" + text(3)) for k in range(7)]
    near = text(150).split()
    out += [(180 + k, " ".join([*near[:k], "zz", *near[k + 1 :]])) for k in (3, 60, 149)]
    out += [(200, None), (201, ""), (202, " \t\r\n\x0b\x0c"), (203, "a"), (204, "ÀÉ ñ 日本 🙂"), (205, text(9000)), (207, "x <|endoftext|> y"), (208, "<|endoftext|>" * 3), (206, passage + " " + passage)]
    out += [(210, base[9]), (210, base[9]), (211, text(60)), (211, text(61)), (None, text(70)), (None, None), (None, base[2])]
    rows = [(i, t, r.choice(["en", None]), r.choice(["s1", "s1", "s1", "s2", "s3", None]), 0 if t is None else len(t), "x", 1, "y") for i, t in out]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def awkward():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(0, 200, 2)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
