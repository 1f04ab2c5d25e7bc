import pytest
from pyspark.sql import functions as F

from docflow.operators import rules as R

SPANS = "map<string,array<struct<start:bigint,end:bigint,value:double>>>"


def verdict(spark, rule, attributes):
    rows = spark.createDataFrame([({k: [(s, e, None if v is None else float(v)) for s, e, v in spans] for k, spans in attributes.items()},)], f"attributes {SPANS}")
    return rows.select(R.compile_rule(rule, F.col("attributes")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("rule", "attributes", "expected"),
    [
        ("a:any", {"a": [(0, 1, False), (1, 2, True)]}, True),
        ("a:all", {"a": [(0, 1, True), (1, 2, None)]}, True),
        ("a:all", {"a": [(0, 1, None)]}, False),
        ("a:any", {}, False),
        ("not a:any", {}, True),
        ("a:avg>0.3", {"a": [(0, 1, 0.2), (1, 2, 0.5)]}, True),
        ("a:avg==1", {"a": [(0, 1, True)]}, True),
        ("a:avg>=0.35", {"a": [(0, 1, 0.25), (1, 2, 0.5)]}, True),
        ("a:avg<=0.3", {"a": [(0, 1, 0.25), (1, 2, 0.5)]}, False),
        ("(a:any or b:any) and not c:all", {"a": [(0, 1, False)], "b": [(0, 1, True)]}, True),
        ("a:any or b:any and c:any", {"a": [(0, 1, True)], "b": [(0, 1, False)], "c": [(0, 1, False)]}, True),
        ("NOT a:any AND NOT b:any", {}, True),
    ],
)
def test_verdicts(spark, rule, attributes, expected):
    assert verdict(spark, rule, attributes) is expected


@pytest.mark.parametrize("rule", ["", "a", "a:some", "a:any and", "(a:any", "a:any)", "a:any b:any", "a:avg>x"])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        R.parse(rule)


def test_canonical_text():
    assert str(R.parse("not a:any or b:all and c:avg > 0.5")) == "(not a:any or (b:all and c:avg>0.5))"
