"""Sources, column helpers, filters, joins, reports: NULLs, duplicates and malformed values."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from basketry.functions import (
    cast_columns,
    columns_like,
    decay_weight,
    format_report,
    parse_date_columns,
    resolve_parent,
    split_group,
    zero_fill,
)
from basketry.operators.filters import filter_category, filter_orders, null_rows, restrict_to_keys
from basketry.operators.joins import (
    attach_ids,
    audit_pairs,
    dense_grid,
    exclude_seen,
    join_keys,
    lookup_cells,
    merge_counts,
    merge_with_indicator,
    missing_keys,
)
from basketry.operators.stats import (
    basket_long,
    basket_matrix,
    describe,
    distinct_values,
    duplicate_keys,
    fd_violations,
    heaviest_users,
    interaction_counts,
    null_profile,
    sparsity,
    top_customers,
    value_counts,
)
from basketry.plans.training import preferences
from basketry.session import scratch_path
from basketry.sources import concat_frames, query_view, read_orders, read_text_table, register, write_frame


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_group_without_second_part_is_null(spark):
    df = spark.createDataFrame([("a:b",), ("plain",), (None,), ("x:y:z",)], "PROD_GRP string")
    assert rows(split_group(df).select("PGG_PROD_GRP", "PGG", "PROD_GRP")) == [
        ("a:b", "a", "b"), ("plain", "plain", None), ("x:y:z", "x", "y"), (None, None, None)
    ]


def test_parent_title_follows_the_id(spark):
    df = spark.createDataFrame(
        [(1, "own", None, "ignored"), (2, "own", 9, None)],
        "PROD_ID long, PROD_TITLE string, PROD_TITLE_PARENT_PROD_ID long, PROD_TITLE_PARENT_TITLE string",
    )
    got = rows(resolve_parent(df).select("PROD_ID", "PROD_TITLE_PARENT_PROD_ID", "PROD_TITLE_PARENT_TITLE"))
    assert got == [(1, 1, "own"), (2, 9, None)]


def test_zero_fill_leaves_text(spark):
    df = spark.createDataFrame([(None, None, None)], "a int, b double, c string")
    assert rows(zero_fill(df)) == [(0, 0.0, None)]


def test_decay_halves_after_half_life(spark):
    df = spark.createDataFrame(
        [(8.0, datetime(2021, 1, 1)), (8.0, datetime(2020, 7, 5)), (None, datetime(2021, 1, 1))],
        "PROD_QTY double, ORDER_DT timestamp",
    )
    got = [r.Timedecay for r in decay_weight(df).orderBy("ORDER_DT", "PROD_QTY").collect()]
    assert got == [4.0, None, 8.0]
    fixed = decay_weight(df, t_ref=F.lit("2021-06-30").cast("timestamp"))
    assert sorted(r.Timedecay for r in fixed.collect() if r.Timedecay) == [2.0, 4.0]


def test_report_format(spark):
    df = spark.createDataFrame([(1234567, 99.456)], "n long, share double")
    assert rows(format_report(df, ["n"], ["share"])) == [("1,234,567", "99.46%")]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame(
        [("2021-02-03 04:05:06", "03/02/2021", "x"), ("03/02/2021", "2021-02-03", "x"), (None, "31/02/2021", "x")],
        "ORDER_DT string, SHIP_DT string, note string",
    )
    assert [tuple(r) for r in parse_date_columns(df).collect()] == [
        (datetime(2021, 2, 3, 4, 5, 6), datetime(2021, 2, 3), "x"), (None, None, "x"), (None, None, "x")
    ]


def test_columns_by_type_and_name(spark):
    df = spark.createDataFrame([(1, 2.0, "z")], "a_DT int, b double, c_DT string")
    assert cast_columns(df, ["int"]).dtypes == [("a_DT", "string"), ("b", "double"), ("c_DT", "string")]
    assert columns_like(df, "_DT$").columns == ["a_DT", "c_DT"]


def test_market_filter_drops_nulls(spark):
    schema = "SITE string, BRAND string, SHIP_TO_COUNTRY string, PROD_REV_USD double"
    data = [("S", "B", "US", 1.0), ("S", "Gift", "US", 1.0), ("S", None, "US", 1.0), ("S", "B", None, 1.0),
            ("S", "B", "US", 0.0), ("S", "B", "US", None), ("T", "B", "US", 1.0)]
    df = spark.createDataFrame(data, schema)
    assert rows(filter_orders(df, "S", "US", ["Gift"])) == [("S", "B", "US", 1.0)]
    assert filter_orders(df, "S").count() == 4


def test_small_filters(spark):
    df = spark.createDataFrame([("a Beauty b", 1), ("beauty", None)], "PGG_PROD_GRP string, k int")
    assert filter_category(df, "%Beauty%").count() == 1
    assert null_rows(df, "k").first().PGG_PROD_GRP == "beauty"
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert restrict_to_keys(df, keys, "k").count() == 1


def test_parquet_sink_refuses_to_overwrite(spark):
    path = scratch_path(spark, "frames")
    df = spark.range(3)
    write_frame(df, path)
    assert read_orders(spark, path).count() == 3
    with pytest.raises(AnalysisException):
        write_frame(df, path)


def test_text_table_keeps_text(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("007", 1.5)], "id string, x double").write.csv(path, header=True)
    got = read_text_table(spark, path)
    assert got.dtypes == [("id", "string"), ("x", "string")] and rows(got) == [("007", "1.5")]


def test_concat_aligns_names_and_numbers_rows(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 0)], "b string, k int")
    got = concat_frames(a, b, row_id="row", order=[F.col("k").asc()])
    assert rows(got.select("row", "k", "a", "b")) == [(0, 0, None, "y"), (1, 1, "x", None)]


def test_view_and_sql_preferences(spark):
    data = [(1, 5, 2.0, datetime(2021, 1, 1), 1.0, "g Beauty"), (1, 5, 1.0, datetime(2021, 2, 1), 0.5, "g Beauty"),
            (2, 5, 2.0, datetime(2021, 1, 1), 1.0, "g Beauty"), (1, 6, 9.0, datetime(2021, 1, 1), 1.0, "g Tools")]
    df = spark.createDataFrame(
        data,
        "CUST_ID int, PROD_TITLE_PARENT_PROD_ID int, PROD_QTY double, ORDER_DT timestamp, Timedecay double, PGG_PROD_GRP string",
    )
    want = [(1, 5, 3.0, datetime(2021, 2, 1), 1.5)]
    assert rows(preferences(filter_category(df, "%Beauty%"))) == want
    text = "SELECT sum(PROD_QTY) AS q FROM lines_for_test WHERE PGG_PROD_GRP LIKE :category"
    assert rows(query_view(df, "lines_for_test", text, category="%Tools%")) == [(9.0,)]
    assert register(df, "again") is df and spark.table("again").count() == 4


def test_seen_means_positive_weight(spark):
    preds = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (1, 3, 0.3)], "user int, item int, prediction double")
    train = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0)], "user int, item int, w double")
    assert [r.item for r in exclude_seen(preds, train, weight="w").orderBy("item").collect()] == [2, 3]
    assert [r.item for r in exclude_seen(preds, train).collect()] == [3]


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    assert join_keys(a, a.select("k"), "k").count() == 1
    assert rows(attach_ids(a, spark.createDataFrame([(None, 7), (1, 8)], "k int, id int"), "k")) == [(1, 2, 8), (None, 1, None)]
    assert rows(missing_keys(a, a, "k")) == [(None,)]
    merged = merge_with_indicator(a, a, "k", "outer")
    assert {r["_merge"]: r["count"] for r in merge_counts(merged).collect()} == {"both": 1, "left_only": 1, "right_only": 1}


def test_merge_suffixes_and_left(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(2, 21), (3, 31)], "k int, v int")
    assert rows(merge_with_indicator(a, b, "k", "left")) == [(1, 10, None, "left_only"), (2, 20, 21, "both")]
    assert rows(merge_with_indicator(a, b, ["k"], "outer")) == [
        (1, 10, None, "left_only"), (2, 20, 21, "both"), (3, None, 31, "right_only")
    ]
    with pytest.raises(ValueError):
        merge_with_indicator(a, b, "k", "inner")


def test_audit_is_limited_to_chosen_users(spark):
    preds = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.9)], "user int, item int, prediction double")
    actual = spark.createDataFrame([(1, 2, 3), (2, 2, 4)], "user int, item int, qty int")
    users = spark.createDataFrame([(1,)], "user int")
    assert rows(audit_pairs(preds, actual, users)) == [(1, 1, 0.5, None, "left_only"), (1, 2, None, 3, "right_only")]
    assert audit_pairs(preds, actual, users, predicate="prediction > 0").count() == 1


def test_grid_has_every_cell_once(spark):
    facts = spark.createDataFrame(
        [(1, "a", 2, 1.0), (1, "a", 3, 1.0), (2, "b", 4, None), (3, None, 5, 1.0), (None, "a", 1, 1.0)],
        "u int, i string, q int, x double",
    )
    got = dense_grid(facts, "u", "i", ["q", "x"], ["a", "b", None])
    assert rows(got) == [
        (1, "a", 5, 2.0), (1, "b", 0, 0.0), (2, "a", 0, 0.0), (2, "b", 4, 0.0),
        (3, "a", 0, 0.0), (3, "b", 0, 0.0),
    ]
    pairs = spark.createDataFrame([(1, "b"), (1, "a")], "u int, i string")
    assert rows(lookup_cells(pairs, facts, "u", "i", ["q"])) == [(1, "a", 5), (1, "b", 0)]
    assert rows(dense_grid(facts, "u", "i", ["q"], ["b"])) == [(1, "b", 0), (2, "b", 4), (3, "b", 0)]
    assert dense_grid(facts, "u", "i", ["q"], []).count() == 0


def test_counts_and_sparsity(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 1)], "u int, i int")
    assert tuple(interaction_counts(df, "u", "i").first()) == (5, 3, 2, 2)
    assert sparsity(df, "u", "i").first().empty_percent == pytest.approx(25.0)
    assert sparsity(df, "u", "i", "rows").first().empty_percent == pytest.approx(-25.0)
    assert tuple(sparsity(df, "u", "i", formatted=True).first()) == ("2", "2", "3", "4", "25.00%")
    assert sparsity(df.limit(0), "u", "i").first().empty_percent is None


def test_reports(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "u int, i int")
    assert [tuple(r) for r in top_customers(df, "u", "i").collect()] == [(1, 3, 2), (2, 1, 1)]
    assert [tuple(r) for r in value_counts(df, ["u", "i"]).collect()] == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    assert rows(distinct_values(df, ["u"])) == [(1,), (2,)]
    assert rows(duplicate_keys(df, ["u", "i"])) == [(1, 1, 2)]
    assert rows(fd_violations(df, "u", "i")) == [(1, 2)]
    nulls = spark.createDataFrame([(None, 1), (None, None)], "a int, b int")
    assert rows(null_profile(nulls)) == [("a", 2, 2), ("b", 1, 2)]
    weights = spark.createDataFrame([(1, 1, 9.0), (1, 2, 8.0), (2, 1, 8.0)], "user int, item int, weight double")
    assert rows(heaviest_users(weights, 2)) == [(1,)]


def test_describe_matches_pandas(spark):
    df = spark.createDataFrame([(1, 2.5), (2, None), (4, 1.0), (4, 7.0)], "a int, b double")
    want = df.toPandas().describe()
    for r in describe(df, ["a", "b"]).collect():
        w = want[r["column"]]
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert got == pytest.approx(w.tolist())


def test_basket_matrix_and_long_form(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 5), (None, "a", 1)], "BE_ORDER_ID int, SKU string, PROD_QTY int")
    assert rows(basket_long(df)) == [(1, "a", 3), (2, "b", 5)]
    assert rows(basket_matrix(df, ["a", "b"])) == [(1, 3, 0), (2, 0, 5)]
    assert rows(basket_matrix(df, ["b"])) == [(1, 0), (2, 5)]
    wide = spark.createDataFrame([(i % 3, i, 1) for i in range(1500)] + [(7, None, 2)], "BE_ORDER_ID int, SKU int, PROD_QTY int")
    full = basket_matrix(wide, range(1500))
    assert len(full.columns) == 1501
    assert sorted(sum(r[1:]) for r in full.collect()) == [0, 500, 500, 500]


def test_schemas_are_checked_when_reading(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(path)
    assert read_orders(spark, path, "y string").columns == ["y"]
    with pytest.raises(ValueError, match="x is int, not bigint; z is missing"):
        read_orders(spark, path, "x long, z string")
    text = str(tmp_path / "c")
    spark.createDataFrame([("1", "a")], "x string, y string").write.option("header", True).csv(text)
    assert read_text_table(spark, text, ["y"]).columns == ["y"]
    with pytest.raises(ValueError):
        read_text_table(spark, text, ["z"])
