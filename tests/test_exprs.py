"""Scalar functions against plain Python."""

import hashlib
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from tesserine.functions import exprs

TEXTS = ["", "   ", "One. Two.", "No stop\nnext.", "  lead. x", "a\r\nb.", "Ünï cöde. x", ".", "x" * 5000, "tab\there. y", "v1.2 thing"]


def one(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def sentence(t):
    t = t.strip()
    if not t:
        return ""
    t = t.splitlines()[0]
    return t.split(".", 1)[0] + "." if "." in t else t


def test_first_sentence(spark):
    assert one(spark, [*TEXTS, None], exprs.first_sentence("x")) == [*map(sentence, TEXTS), ""]


def test_slug_and_key(spark):
    paths = ["src/a b.py", "A--b/__init__.py", "x", ".hidden", "dir.d/file", "a/b.tar.gz", "ünï/x.go", "a-b.py", "a/b.py"]
    assert one(spark, paths, exprs.slug("x"))[0] == "src-a-b-py"
    assert one(spark, paths, exprs.path_key("x")) == [str(PurePosixPath(p).with_suffix("")) for p in paths]
    assert one(spark, paths, exprs.path_stem("x")) == [PurePosixPath(p).stem for p in paths]
    a, b = one(spark, paths, exprs.slug("x"))[-2:]
    assert a == b  # not injective


def test_tokens_and_hash(spark):
    assert one(spark, TEXTS, exprs.estimate_tokens("x")) == [max(1, len(t) // 4) for t in TEXTS]
    assert one(spark, TEXTS, exprs.sha256("x")) == [hashlib.sha256(t.encode()).hexdigest() for t in TEXTS]


def test_clean_comment(spark):
    cases = {"/** A.\n * B.\n */": "A.\nB.", "// x\n// y": "x\ny", "/// a": "a", "# r": "r", "/* c */": "c", "": "", "plain": "plain", "** x": "x"}
    assert one(spark, list(cases), exprs.clean_comment("x")) == list(cases.values())


def test_language(spark):
    assert one(spark, ["a.PY", "b/c.tsx", "x.unknown", "noext", "k.kts"], exprs.detect_language("x")) == ["python", "typescript", None, None, "kotlin"]


def test_json_list(spark):
    out = spark.range(1).select(exprs.json_list(F.array(F.lit("a"), F.lit('q"x'))).alias("j")).first().j
    assert out == '["a", "q\\"x"]'


@pytest.mark.parametrize("raw,expected", [("/** a\n * b */", "a\nb"), ("# x", "x")])
def test_python_twin(raw, expected):
    from tesserine.parse.common import clean_comment

    assert clean_comment(raw) == expected
