"""Topic tags, titles and deks come from whole texts."""

import pytest

from quillmesh.plans import registry
from quillmesh.sources.fixtures import articles


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    late = "x" * 8 + " " + "filler " * 300 + "from the end"
    blank = " \n" * 900 + "one two three with"
    rows = [(1, late, "en", "src0", len(late)), (2, blank, "en", "src1", len(blank))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_title_after_white_space(spark, tables):
    assert {r.id: r.title for r in articles(spark, tables).collect()}[2] == "one two three with"


def test_late_keywords_give_topics(spark, tables):
    assert {r.id: list(r.topics) for r in articles(spark, tables).collect()} == {1: ["politics"], 2: ["economy"]}
    got = {r.topic: r.n for r in registry.QUERIES["t03_top_topics"](spark, tables).collect()}
    assert got == {"politics": 1, "economy": 1}
