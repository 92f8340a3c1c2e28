"""Types of JSON fields, conflicts told."""

from cohortry.sources import files as S


def test_types_and_conflicts(spark):
    texts = ['{"a": 1, "b": "x", "c": null}', '{"a": 1.5, "b": 2, "c": null, "d": [1]}', '{"a": 1e300, "b": {"y": 1}}', "[1]", "7", "no", None, "{}", '{"d": []}']
    got = {tuple(r) for r in S.field_types(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {
        ("a", "integer", 1, "number"), ("a", "number", 2, "number"), ("b", "text", 1, "conflict"), ("b", "integer", 1, "conflict"),
        ("b", "object", 1, "conflict"), ("c", "null", 2, "null"), ("d", "array", 2, "array"),
    }
    assert S.field_types(spark.createDataFrame([], "t string"), "t").count() == 0
