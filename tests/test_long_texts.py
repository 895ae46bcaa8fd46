"""Patterns over very long texts: none may recurse by character, as that ends the executor."""
import pytest
from pyspark.sql import functions as F

from syllabase.functions import titles as T
from syllabase.functions import values as V

MB = 1 << 20


@pytest.mark.parametrize("body", ["x" * MB, "a\\n" * (MB // 3), "\\\\" * (MB // 2), "слово и " * (MB // 16)])
def test_model_output_with_a_long_string(spark, body):
    df = spark.createDataFrame([('{"summary":["' + body + '"]}',)], "text string")
    got = df.select(F.size(F.regexp_extract_all("text", F.lit(V.JSON_STRING), F.lit(1))).alias("n"), F.regexp_extract("text", r'\[' + V.JSON_STRING, 1).alias("s")).first()
    assert got["n"] == 2 and got["s"] == body


def test_json_strings_end_at_the_first_open_quote(spark):
    df = spark.createDataFrame([(r'{"k": ["a\"b", "c\\"], "z": "d"}',)], "text string")
    tail = V.JSON_STRING + r"(?!\s*:)(?=\s*[,\]}])"
    assert df.select(F.regexp_extract_all("text", F.lit(tail), F.lit(1)).alias("x")).first()["x"] == [r'a\"b', r"c\\", "d"]


def test_russian_run_over_a_long_title(spark):
    text = "Информационные системы и сети " * (MB // 30)
    df = spark.createDataFrame([(text,), ("abc Право и закон 12 def",)], "t string")
    got = [r["x"] for r in df.select(F.regexp_extract_all("t", F.lit("(?U)" + T.RUSSIAN_RUN), F.lit(0)).alias("x")).collect()]
    assert got[0] == [text.strip()] and got[1] == ["Право и закон 12"]
