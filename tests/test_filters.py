import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, EngineError, FilterSyntaxError
from tessera.functions.filters import equalities, parse_assignments, parse_filter
from tessera.operators.scan import project, scan
from tessera.types import parse_schema

ABC = parse_schema("a int32, b int32, c int32, d int32, e string")
PEOPLE = parse_schema("id int32, name string, age int32, score float32, is_active bool, tags list[string]")


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("c>7", "c > 7"),
        ("((b <> 3))", "b != 3"),
        ("d<=0 Or c < -4 and not e lIKE '_z%'", "(d <= 0 OR (c < -4 AND NOT e LIKE '_z%'))"),
        ("NOT NOT (a IS NULL)", "NOT NOT a IS NULL"),
        ("e IN('x',  'y z') and ( d not in (5) or a is not null )", "(e IN ['x', 'y z'] AND (d NOT IN [5] OR a IS NOT NULL))"),
        ("a = 1 or (b = 2 or (c = 3 and (d = 4)))", None),
    ],
)
def test_canonical(text, canonical):
    tree = parse_filter(text, ABC)
    canonical = canonical or str(tree)
    assert str(tree) == canonical
    assert str(parse_filter(canonical.replace("[", "(").replace("]", ")"), ABC)) == canonical


@pytest.mark.parametrize(
    "text",
    ["a = 1 b", "a = 1 AND", "(a = 1", "a = 1)", "a", "a =", "e = abc", "a LIKE 'x'", "e LIKE abc", "a = x", "a IN 1", "a IN (1", "a IN ()", "a IS 1", "a NOT 1", "e = 'open", "= 1", "a == 1", "a = 99999999999", "1 = a", "a = b", "AND", "a IN (1 2)", "a = 1 OR OR b = 2"],
)
def test_errors(text):
    with pytest.raises((FilterSyntaxError, ColumnNotFound)):
        parse_filter(text, ABC)


def test_lists_and_case():
    with pytest.raises(FilterSyntaxError):
        parse_filter("tags = 'x'", PEOPLE)
    with pytest.raises(ColumnNotFound):
        parse_filter("ID = 1", PEOPLE)
    assert parse_filter("  ", PEOPLE) is None
    assert parse_filter("is_active = TRUE and score < 1e3", PEOPLE).columns() == ["is_active", "score"]


LIKE_YES = ["John Doe", "%", "J%", "%e", "John%", "%Doe", "%n D%", "J%e", "_ohn Doe", "John Do_", "John_Doe", "____ ___", "%o%o%", "J_hn%", "%_", "_%", "John Doe%", "%John Doe"]
LIKE_NO = ["john doe", "j%", "John", "Doe", "", "_", "%x%", "John  Doe", "_John Doe", "John Doe_", "John%x", "________ ", "Jo_n_Doe_", "%d", "ohn%"]


def test_like(spark):
    df = spark.createDataFrame([("John Doe",)], "name string")
    for p in LIKE_YES:
        assert scan(df, "*", f"name LIKE '{p}'").count() == 1, p
    for p in LIKE_NO:
        assert scan(df, "*", f"name LIKE '{p}'").count() == 0, p
        assert scan(df, "*", f"name NOT LIKE '{p}'").count() == 1, p
    odd = spark.createDataFrame([("a\\b",), ("50%",), ("x",)], "name string")
    assert scan(odd, "*", "name LIKE 'a\\b'").count() == 1
    assert scan(odd, "*", "name LIKE '50\\%'").count() == 1


def test_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (None, 5)], "a int, b int")
    rows = lambda f: sorted((r.a or 0, r.b or 0) for r in scan(df, "*", f).collect())
    assert rows("b IN (5)") == [(0, 5), (2, 5)]
    assert rows("b NOT IN (5)") == [(1, 0), (3, 7)]
    assert rows("b IN (5, null)") == [(0, 5), (1, 0), (2, 5)]
    assert rows("b NOT IN (5, null)") == [(3, 7)]
    assert rows("a = 1 OR b = 5") == [(0, 5), (1, 0), (2, 5)]
    assert rows("NOT (a = 1 AND b = 5)") == [(2, 5), (3, 7)]
    assert rows("b IS NULL") == [(1, 0)]
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert scan(nan, "*", "x IS NULL").count() == 1


def test_in_strings_with_odd_characters(spark):
    values = ["a,b", 'say "x"', "tab\t", "line\n", "back\\slash", "null", "(", "é"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "s string")
    for v in values:
        assert [r.s for r in scan(df, "*", f"s IN ('{v}')").collect()] == [v]
        assert [r.s for r in scan(df, "*", f"s = '{v}'").collect()] == [v]


@settings(max_examples=15, deadline=None)
@given(st.recursive(st.sampled_from(["a = 1", "b != 2", "a IN (1, 3)", "b IS NULL", "a > 2"]), lambda x: st.one_of(st.tuples(x, st.sampled_from(["AND", "OR"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), x.map(lambda t: f"NOT {t}")), max_leaves=6))
def test_rows_are_conserved(spark, text):
    """A filter, its negation and the rest add up."""
    df = spark.createDataFrame([(a, b) for a in (None, 1, 2, 3) for b in (None, 1, 2)], "a int, b int")
    tree = parse_filter(text, df.schema)
    yes, no, unknown = (df.where(c).count() for c in (tree.column(), ~tree.column(), tree.column().isNull()))
    assert yes + no + unknown == 12
    assert df.where(parse_filter(str(tree).replace("[", "(").replace("]", ")"), df.schema).column()).count() == yes


def test_projection():
    assert project(" b ,a,, ", ["a", "b"]) == ["b", "a"]
    assert project("*", ["a", "__deleted_flag"]) == ["a"]
    for bad in ("", " , ", "x", "__deleted_flag"):
        with pytest.raises(EngineError):
            project(bad, ["a", "__deleted_flag"])


def test_equalities():
    assert equalities(parse_filter("a = 1 AND b IN (1, 2) AND c > 3", ABC)) == {"a": [1], "b": [1, 2]}
    assert equalities(parse_filter("a = 1 AND a IN (2, 1)", ABC)) == {"a": [1]}
    assert equalities(parse_filter("a = 1 OR b = 2", ABC)) == {}


def test_assignments():
    schema = parse_schema("a int32, s string, v fixed_size_list[2, float32], l list[string], f list[bool], u uint8")
    got = parse_assignments("a = 1, s = 'x, y = [z]', v = [1, -2.5], l = ['p, q', 'r'], f = [True, 0]", schema)
    assert {k: v for k, (v, _) in got.items()} == {"a": 1, "s": "x, y = [z]", "v": [1.0, -2.5], "l": ["p, q", "r"], "f": [True, False]}
    for bad in ("", "a", "a = ", "x = 1", "a = 'x'", "s = x", "v = [1]", "u = 256", "a = 1, a = 2", "__deleted_flag = true"):
        with pytest.raises(EngineError):
            parse_assignments(bad, schema)


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, str(i), float(i)) for i in range(10)], "a int, b string, c double").write.parquet(path)
    plan = scan(spark.read.parquet(path), "b", "a > 3 AND b != '5'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,3)" in plan and "ReadSchema: struct<a:int,b:string>" in plan


def test_schema_text():
    schema = parse_schema("ID uint32 not null, Name String, Attributes List[ String ], Feature Fixed_Size_List[ 1024, Float32 ]")
    assert schema.names == ["id", "name", "attributes", "feature"]
    assert [f.nullable for f in schema] == [False, True, True, True]
    assert schema["feature"].dataType == T.ArrayType(T.FloatType()) and schema["feature"].metadata == {"list_size": 1024}
    for bad in ("id", "id map", "id list[list[int32]]", "id fixed_size_list[float32]", "id list[int32"):
        with pytest.raises(EngineError):
            parse_schema(bad)
