import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra
    columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997}" for i in range(40_000))
    rows = [(1, "Same line here and there\nsecond"), (2, None), (3, ""), (4, "Same line here and there\nthird"), (4, "Same line here and there\nthird"),
            (None, "Same line here and there"), (6, long), (7, long), (8, "  \n\t\n "), (9, "ok"), (10, "12 34 !!"), (11, "été où ça\r\nnaïve"), (None, None),
            (13, "x <|endoftext|> y"), (14, "Σίσυφος ΟΔΟΣ İstanbul 中文 ½")]
    schema = ("doc_id long, text string, size int, shard string, fp long, `rng` int, kind int, block string, key string, word string, gone string, "
              "k1 int, score string, lang string, source string, n_chars long, n long, `a.b` int")
    return spark.createDataFrame([(i, t, None, "s", None, 1, 2, "b", None, "w", None, 3, None, "en" if i else None, None, None, 4, 5) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = 12345")
