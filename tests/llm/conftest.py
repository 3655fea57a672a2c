import pytest

LETTERS = str.maketrans("0123456789", "aeioubdkmr")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, label int, tile long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""
    def make(rows):
        full = [(i, t, g, s, len(t or ""), "extra", 1, 7) for i, t, g, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Deterministic prose of n words."""
    def make(n, seed=0):
        return " ".join("w" + str((i * i * 31 + seed * 977 + i * 7) % 9973).translate(LETTERS) for i in range(n))

    return make
