"""Small documents with every odd case: nulls, blanks, copies, ties, long and clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(words))


def rows():
    a, b = prose(1, 80), prose(2, 400)
    near = a.replace(a.split()[40], "changed", 1)
    passage = prose(3, 60)
    texts = {
        1: a, 2: a, 3: near, 4: b, 5: "", 6: None, 7: " \n\t ", 8: "one two", 9: "ONE two", 10: "ünï " + prose(4, 50),
        11: prose(5, 40) + "\n" + passage, 12: passage + "\n" + prose(6, 45), 13: "ab " * 300, 14: prose(7, 6000),
        15: "same line here again and again\n" * 6 + prose(8, 30), 16: b + " tail", 17: prose(9, 12) + "\nx\n\ny",
    }
    out = [(k, t, "en", f"src{k % 3}" if k != 4 else None, len(t or "")) for k, t in texts.items()]
    out.append(out[3])  # a fully repeated row
    out.append((None, prose(10, 50), None, "src0", None))
    out.append((None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "h", "key", "row", "quality", "component", "sid", "n", "regs", "chunk", "kept", "removed", "copies", "raw")
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
