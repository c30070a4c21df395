"""Fixtures of the tests in this folder (imported by name: a second conftest would hide the first)."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, doc string, shard string"

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old grey wall near the river and sing their morning song to nobody at all"


@pytest.fixture(scope="session")
def spark(spark):
    from eviflow.llm.common import session

    return session(spark)


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; the last three columns clash with outputs."""
    texts = [
        None, "", "   \n\t ", "one", "1 2 3 !!", PROSE, PROSE, PROSE + ".", PROSE.upper(), "Straße ÉTÉ naïve 漢字 😀 ﬁ " * 9, "x" * 70_000, ("word " * 30_000).strip(),
        "\n".join(["same line here"] * 12), "# * $ % & | < >" * 5, "a\x1cb\x0bc\x85d e f", "<|endoftext|> it's we'll I'd 12 3.5 o'clock", "▁ ▁▁x", "é İIΣ Σ",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], None if i % 4 else i, "s", "d", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, PROSE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (-7, PROSE + " again", "en", "a", 1, "", "", "")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "work")
