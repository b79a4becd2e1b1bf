import pytest
from odd_rows import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, one row twice, over several partitions, with columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"src{i % 3}", len(t or ""), i, "r", i) for i, t in [*ODD, ODD[11]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank long, h string, n_lines long").repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id < 0")
