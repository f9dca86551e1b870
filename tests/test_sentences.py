"""Sentences keep their digits and lose their outer blanks."""

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import reading as R


def test_sentences_keep_digits_at_their_ends(spark):
    rows = [(" 0. 169.1.2!! Call 2. 33. 555-7634", ["0.", "169.1.2!!", "Call 2.", "33.", "555-7634"]), ("", []), ("a.b", ["a.b"]), (" x .  ", ["x ."])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert [r.got for r in df.select(T.sentences(F.col("t")).alias("got")).collect()] == [w for _, w in rows]


def test_a_line_that_is_its_own_number_is_a_paragraph(spark):
    df = spark.createDataFrame([("0\n1\n 2 \n\nend. 4",)], "t string")
    assert df.select(R.paragraphs(F.col("t")).alias("got")).first().got == [["0"], ["1"], ["2"], ["end.", "4"]]
