import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame of documents (doc_id, text) with columns of clashing names."""

    def make(rows, kind="bigint"):
        return spark.createDataFrame([(i, t, "x", 7, "y", 0.5, 3) for i, t in rows], f"doc_id {kind}, text string, score string, size int, lang_pred string, n_removed double, shard int")

    return make


SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (6, "word " * 30000), (7, "é ß ñ 漢字 😀"), (8, "\x00\x01"), (9, "a")]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd():
    return ODD
