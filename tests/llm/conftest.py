import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "key string, size string, row string, score double, component string, shard int, digest string")


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents from (doc_id, text, source), with extra columns whose names operators use."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]),
                 "k", "s", "r", 9.0, "c", 7, "d") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
