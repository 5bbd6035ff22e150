import pytest
from pyspark.sql import functions as F

from leafwise.functions.text import extract_tag, replace_literal, strip_suffix, unicode_strip


def py_extract(text, tag):
    """The rule in plain Python: what follows the last opening mark, up to the next closing mark, if any."""
    if text is None:
        return "n/a"
    opening, closing = f"<{tag}>", f"</{tag}>"
    at = text.rfind(opening)
    start = 0 if at < 0 else at + len(opening)
    end = text.find(closing, start)
    return (text[start:] if end < 0 else text[start:end]).strip().lower()


CASES = [
    "a<l>x<l> y </l>z</l>",
    "none",
    "q</l>r",
    None,
    "\t\n  \u001c padded \u001c  \n\t",
    "<l>　Mixed CASE </l>",
    "",
    "<l></l>",
    "x</l>y<l>z",
]


def test_extract_matches_python_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string")
    got = dict(df.select("id", extract_tag("text", "l").alias("v")).collect())
    for i, t in enumerate(CASES):
        assert got[i] == py_extract(t, "l"), (t, got[i])


def test_named_fixtures(spark):
    df = spark.createDataFrame([("a<l>x<l> y </l>z</l>",), ("none",), ("q</l>r",), (None,)], "t string")
    assert [r[0] for r in df.select(extract_tag("t", "l")).collect()] == ["y", "none", "q", "n/a"]


def test_unicode_strip_all_python_whitespace(spark):
    ws = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    df = spark.createDataFrame([(ws + "a b" + ws,)], "t string")
    assert df.select(unicode_strip("t")).first()[0] == "a b"


def test_suffix_and_literal(spark):
    df = spark.createDataFrame([("knn_test",), ("svm_val",), ("x_external",), ("a_test_val",)], "m string")
    rows = df.select(strip_suffix("m", "(_test|_val)$"), strip_suffix("m", "(_external)$"), replace_literal("m", "_test", "_val")).collect()
    assert [tuple(r) for r in rows] == [
        ("knn", "knn_test", "knn"), ("svm", "svm_val", "svm"), ("x_external", "x", "x_external"), ("a_test", "a_test_val", "a"),
    ]
