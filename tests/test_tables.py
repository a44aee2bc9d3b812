"""Table analysis on the three-row fixtures, and the rules that reject a request."""

import pytest
from pyspark.sql import functions as F

from ledgerlab.errors import EmptyDataset, ExportTooLarge, InvalidSpec
from ledgerlab.operators import pivot as P
from ledgerlab.operators import tables as T
from ledgerlab.plans.expressions import col, expression_column, fn
from ledgerlab.plans.filters import filter_column
from ledgerlab.plans.pivots import Measure, PivotSpec
from ledgerlab.sinks import writers


def leaf(column, operator, value=None):
    return {"type": "condition", "column": column, "operator": operator, "value": value}


def group(combinator, *children):
    return {"type": "group", "combinator": combinator, "children": list(children)}


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("B001", 69.05), ("B002", 20.12), ("B001", 69.05)], "serie STRING, igv DOUBLE")


def test_filter_and_count(spark):
    df = spark.createDataFrame([("B001", 69.05), ("B002", 20.12), ("B001", 10.00)], "serie STRING, igv DOUBLE")
    assert T.where(df, group("and", leaf("serie", "eq", "B001"))).count() == 2
    assert T.count_matches(df, group("or", leaf("igv", "lt", 15), leaf("serie", "in", ["B002"]))).first().total == 2
    assert T.where(df, group("and", group("or"))).count() == 3
    assert T.where(df, group("and", leaf("serie", "in", []))).count() == 0
    assert T.where(df, group("and", leaf("serie", "not_in", []))).count() == 3


@pytest.mark.parametrize("bad", [
    leaf("nada", "eq", 1), leaf("serie", "like", "x"), leaf("serie", "eq", None), leaf("serie", "eq", ["a"]),
    leaf("igv", "between", [1]), leaf("igv", "in", 3), group("xor", leaf("igv", "gt", 1))])
def test_bad_filters(small, bad):
    with pytest.raises(InvalidSpec):
        filter_column(small, bad)


def test_filter_limits(small):
    deep = leaf("igv", "gt", 1)
    for _ in range(6):
        deep = group("and", deep)
    with pytest.raises(InvalidSpec):
        filter_column(small, deep)
    with pytest.raises(InvalidSpec):
        filter_column(small, group("or", *[leaf("igv", "gt", 1)] * 200))


def test_nulls_and_wildcards(spark):
    df = spark.createDataFrame([("50%_off",), ("500 off",), (None,)], "t STRING")
    assert T.where(df, group("and", leaf("t", "contains", "%_"))).count() == 1
    assert T.where(df, group("and", leaf("t", "ne", "x"))).count() == 2
    assert T.where(df, group("and", leaf("t", "not_contains", "50"))).count() == 0
    assert T.where(df, search="%_OFF").count() == 1
    assert T.where(df, search="  ").count() == 3
    assert [r.t for r in T.order_by(df, [("t", "asc")]).collect()][-1] is None
    assert [r.t for r in T.order_by(df, [("t", "desc")]).collect()][-1] is None


def test_pages_do_not_overlap(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    seen = [r.id for start in range(0, 100, 10) for r in T.page(df, 10, start, [("k", "asc")]).collect()]
    assert sorted(seen) == list(range(100))
    with pytest.raises(InvalidSpec):
        T.page(df, 1001)


def test_distinct_truncation(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("v"))
    values, more = T.distinct_list(df, "v", limit=5)
    assert len(values) == 5 and more
    assert T.distinct_list(df, "v", "1_")[0] == [str(i) for i in range(10, 20)]


def test_computed(small):
    out = T.with_computed(small, [("igv_doble", fn("mul", col("igv"), 2))])
    assert out.columns == ["serie", "igv", "igv_doble"] and out.count() == 3
    for name in ("igv", " ", "igv "):
        with pytest.raises(InvalidSpec):
            T.with_computed(small, [(name, col("igv"))])
    with pytest.raises(InvalidSpec):
        expression_column(small, fn("concat", col("serie")))


def test_expression_traps(spark):
    df = spark.createDataFrame([("abcdef", None, 0.285, "2024", "2024-03-05", 12345678.9)], "a STRING, b STRING, x DOUBLE, y STRING, d STRING, big DOUBLE")
    trees = {
        "joined": fn("concat", col("a"), col("b")), "sub0": fn("substr", col("a"), 0, 3), "tail": fn("substr", col("a"), -2),
        "r": fn("round", col("x"), 2), "no": fn("year", col("y")), "mon": fn("month", col("d")),
        "days": fn("datediff_days", "2024-03-01", col("d")), "zero": fn("div", col("x"), 0), "txt": fn("concat", col("big"), "!")}
    row = T.with_computed(df, list(trees.items())).first()
    assert (row.joined, row.sub0, row.tail, row.r, row.no, row.mon, row.days, row.zero, row.txt) == (
        "abcdef", "ab", "ef", 0.28, None, 3, 4, None, "12345678.9!")


def test_replace(small):
    out = T.replace_values(small, [{"column": "serie", "search": "B002", "replace": "B777"}])
    assert out.filter("serie = 'B777'").count() == 1 and out.schema["igv"].dataType.typeName() == "double"
    both = T.replace_values(small, [
        {"column": "serie", "mode": "contains", "search": "B", "replace": "Z"},
        {"column": "serie", "search": "b001", "replace": "BB", "case_sensitive": False}])
    assert {r.serie for r in both.collect()} == {"ZZ", "Z002"}


def test_dedupe_and_stats(small):
    assert T.drop_duplicate_rows(small).count() == 2
    assert T.drop_duplicate_keys(small, ["serie"]).count() == 2
    counts = T.dedupe_counts(small).first()
    assert (counts.antes, counts.despues) == (3, 2)
    stats = T.column_stats(small, "igv").first()
    assert (stats.total, stats.non_null, stats.distinct_count) == (3, 3, 2)
    assert [(r.value, r.freq) for r in T.top_values(small, "serie").collect()] == [("B001", 2), ("B002", 1)]


def test_pivot(small, tmp_path):
    spec = PivotSpec.from_dict({"group_by": ["serie"], "measures": [{"column": "igv", "aggregation": "sum"}]})
    assert {r.serie: r.suma_igv for r in P.pivot(small, spec).collect()} == {"B001": 138.1, "B002": 20.12}
    assert P.pivot_totals(small, spec).first().suma_igv == 158.22
    assert P.pivot_count(small, spec).first().grupos == 2
    _, rows = writers.materialize(P.pivot(small, spec), str(tmp_path / "p"))
    assert rows == 2


@pytest.mark.parametrize("spec", [
    PivotSpec(["serie"], [Measure("sum", "serie")]), PivotSpec(["serie"], [Measure("sum")]), PivotSpec([], [Measure("count")]),
    PivotSpec(["serie"], [Measure("avg", "igv")], percent_of_total=True), PivotSpec(["serie"], [Measure("count")], pivot_column="serie"),
    PivotSpec(["serie"], [Measure("count")], sort_measure=4), PivotSpec(["serie"], [Measure("count")], sort_column="igv")])
def test_bad_pivots(small, spec):
    with pytest.raises(InvalidSpec):
        P.pivot(small, spec)


def test_crosstab_totals_include_null_values(spark):
    df = spark.createDataFrame([("a", "PEN", 1), ("a", None, 2), ("b", "USD", 4)], "g STRING, m STRING, v INT")
    rows = {r.g: r for r in P.pivot(df, PivotSpec(["g"], [Measure("sum", "v")], pivot_column="m")).collect()}
    assert (rows["a"].PEN, rows["a"].USD, rows["a"].Total, rows["b"].PEN, rows["b"].Total) == (1, 0, 3, 0, 4)
    share = P.pivot(df, PivotSpec(["g"], [Measure("sum", "v")], percent_of_total=True)).collect()
    assert sum(r.suma_v for r in share) == pytest.approx(100, abs=0.02)


def test_percent_plan_has_no_window_or_cross_join(small):
    spec = PivotSpec(["serie"], [Measure("sum", "igv")], percent_of_total=True)
    plan = P.pivot(small, spec)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_crosstab_limit(spark):
    df = spark.range(60).select(F.lit("a").alias("g"), F.col("id").cast("string").alias("m"))
    with pytest.raises(InvalidSpec):
        P.pivot(df, PivotSpec(["g"], [Measure("count")], pivot_column="m"))


def test_export_bounds(spark, tmp_path):
    df = spark.range(11)
    assert writers.export_guard(df, cap=11) == 11
    with pytest.raises(ExportTooLarge):
        writers.export_guard(df, cap=10)
    with pytest.raises(EmptyDataset):
        writers.materialize(df.filter("id < 0"), str(tmp_path / "none"))
    writers.write_txt(df, str(tmp_path / "t"), "pipe")
    assert spark.read.option("header", True).option("sep", "|").csv(str(tmp_path / "t")).count() == 11


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) AS t", "timestamp_seconds(id * 86400) AS ts").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = T.select_columns(T.where(df, group("and", leaf("ts", "gte", "1970-02-01"), leaf("id", "in", [40, 50]))), ["id"])
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "t:string" not in plan
    assert out.count() == 2


def test_crosstab_value_named_like_the_total(spark):
    from ledgerlab.operators import pivot

    df = spark.createDataFrame([("a", "Total", 1), ("a", "x", 2)], "g STRING, v STRING, n INT")
    spec = PivotSpec(["g"], [Measure("sum", "n")], pivot_column="v")
    with pytest.raises(InvalidSpec):
        pivot.pivot(df, spec)
    assert sorted(map(tuple, pivot.pivot_long(df, spec).collect())) == [("a", "Total", 1), ("a", "x", 2)]


def test_arithmetic_without_overflow(spark):
    df = spark.createDataFrame([(2**62, 4)], "a BIGINT, b BIGINT")
    out = T.with_computed(df, [("c", {"kind": "function", "fn": "mul", "args": [{"kind": "column", "name": "a"}, {"kind": "column", "name": "b"}]})])
    assert out.first().c is None


def test_pages_by_key(spark):
    df = spark.createDataFrame([(k % 3 or None, k) for k in range(20)], "a INT, b INT")
    sort = [("a", "desc")]
    whole, last, got = [tuple(r) for r in T.page(df, 100, 0, sort).collect()], None, []
    while rows := T.page_after(df, sort, last, 7).collect():
        got += [tuple(r) for r in rows]
        last = rows[-1].asDict()
    assert got == whole


def test_distinct_counts_of_a_crosstab_expand_no_row(spark):
    rows = [(g, v, x, y) for g in ("a", None) for v in ("p", "q", None) for x, y in ((1, 1), (1, 2), (2, None), (None, 3))]
    df = spark.createDataFrame(rows, "g STRING, v STRING, x INT, y INT")
    spec = PivotSpec(["g"], [Measure("count_distinct", "x"), Measure("count_distinct", "y"), Measure("count")], pivot_column="v")
    out = P.pivot(df, spec)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("a", 2, 3, 4, 2, 3, 4, 2, 3, 12), (None, 2, 3, 4, 2, 3, 4, 2, 3, 12)]
    totals = P.pivot_totals(df, spec)
    assert [tuple(r) for r in totals.collect()] == [(2, 3, 8, 2, 3, 8, 2, 3, 24)]
    assert [tuple(r) for r in P.pivot_totals(df.limit(0), spec, values=["p"]).collect()] == [(0, 0, 0, 0, 0, 0)]
    assert [tuple(r) for r in P.pivot(df.select("g", "x", "y"), PivotSpec(["g"], spec.measures[:2])).collect()] == [("a", 2, 3), (None, 2, 3)]
