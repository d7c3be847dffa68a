import pandas as pd
import pytest

SMOKE = "/root/testdata/sf0.001"

LONG = "word " * 30_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the old red barn tonight"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from the old red barn tonight"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one two"),
    (7, "ONE two"),
    (8, LONG),
    (None, "a text without an id"),
    (None, None),
    (9, "é è Àb ñandú 東京 tower"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from the old red barn tonight"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls, empty, very long, repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if n % 3 else "en", None if n % 2 else f"src{n % 4}", len(t or ""), 7, 0.5, "x", 1, 2, 3)
            for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, "
                                       "score double, id string, bucket int, size int, key int").repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")


@pytest.fixture(scope="session")
def pdocs():
    return pd.read_parquet(f"{SMOKE}/documents.parquet")
