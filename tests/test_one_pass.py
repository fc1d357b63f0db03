"""Queries that pass over joined rows several times join them once; what is costly is made once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vouchlens.operators import nested, outliers
from vouchlens.plans import lookup as lk
from vouchlens.plans import ordered, quantiles
from vouchlens.roles import PaymentRoles
from vouchlens.suite import providers

DAY = "DATE'2024-01-01'"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Some lines, orders, parts and more of our own."""
    made = tmp_path_factory.mktemp("tables")
    date = f"date_add({DAY}, cast(id % 300 as int))"
    tables = {
        "orders": f"id as o_orderkey, id % 40 as o_custkey, 'F' as o_orderstatus, 10.0d * id as o_totalprice, "
        f"cast({date} as timestamp) as o_orderdate, '1-URGENT' as o_orderpriority",
        "lineitem": f"id div 3 as l_orderkey, id % 50 as l_partkey, id % 7 as l_suppkey, cast(id % 3 as int) as l_linenumber, "
        f"cast(1 + id % 9 as double) as l_quantity, 3.0d * id as l_extendedprice, 0.01d * (id % 10) as l_discount, "
        f"0.01d * (id % 8) as l_tax, 'A' as l_returnflag, 'F' as l_linestatus, cast({date} as timestamp) as l_shipdate",
        "part": "id as p_partkey, 'ECONOMY' as p_type",
    }
    for name, columns in tables.items():
        rows = {"orders": 200, "lineitem": 600, "part": 50}[name]
        spark.range(rows).selectExpr(*split_columns(columns)).write.parquet(f"{made}/{name}.parquet")
    return str(made)


def split_columns(text):
    """The columns of a list, at commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@pytest.mark.parametrize(
    "name",
    ["D1_duplicate_rows", "D14_atypical_amounts", "F9_features_and_split", "F7_temporal_split", "L2_filled", "L4_valid_categories", "L5_outliers"]
    + ["L5_outlier_details", "L6_valid_ranges"],
)
def test_joined_rows_are_written_before_the_passes(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    assert "l_orderkey" not in plan(found)
    assert found.count() > 0


def test_scores_of_a_provider_are_computed_once(spark, folder, monkeypatch):
    calls, real = [], providers.op.provider_scores
    monkeypatch.setattr(providers.op, "provider_scores", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert providers.QUERIES["R12_provider_detail"](spark, folder).count() == 1
    assert len(calls) == 1


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame(
        [
            (1, '{"payment_policies": {}, "transactions": [{"transaction_id": "x", "amount": 1}, null, {"transaction_id": 2, "amount": "y"}]}'),
            (2, '{"payment_policies": {}, "transactions": []}'),
            (3, '{"payment_policies": {}, "transactions": null}'),
        ],
        "doc_id long, doc string",
    ).repartition(2)
    raw = nested.raw_transactions(docs)
    assert "parse_json" not in plan(nested.type_warnings(nested.type_errors(raw)))  # errors are written, not made twice
    want = docs.select("doc_id", F.explode(F.from_json("doc", nested.RAW_SCHEMA).getField("transactions")).alias("transaction"))
    assert sorted(raw.collect(), key=str) == sorted(want.collect(), key=str)
    assert [r.message for r in nested.type_errors(raw).where("message like '%x%'").collect()] == ["transaction_id inválido: x"]


def test_hot_keys_are_counted_on_the_stored_rows(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 5, id) as k")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    counted = []
    real = lk.hot_keys
    monkeypatch.setattr(lk, "hot_keys", lambda df, key: counted.append(df.columns) or real(df, key))
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 10)
    wide = rows.withColumn("more", F.lit(1))
    found = lk.lookup(wide, table, "k", rows)
    assert counted == [["id", "k"]]
    assert sorted(found.collect()) == sorted(wide.join(table, "k", "left").collect())


def test_modes_and_quantiles_explode_cells_only(spark):
    df = spark.range(20_000).selectExpr("id % 3 as a", "id % 2 as b", "cast(id % 1000 as double) as v")
    modes = spark.range(1).select(ordered.column_modes(df.selectExpr("cast(a as string) a", "cast(b as string) b"), ["a", "b"]).alias("m"))
    assert modes.first().m == ("0", "0")
    found = quantiles.selected(df, {"q": F.col("v")}, {"m": 0.5})
    assert "_b0" in plan(found).split("Generate")[1].split("\n")[0]  # what is taken apart has been counted
    assert found.first().q.m == df.agg(F.percentile("v", F.lit(0.5)).alias("m")).first().m


def test_z_scores_are_of_the_given_rows(spark):
    df = spark.range(50).selectExpr("id % 5 as supplier", "id % 4 as approver", "cast(id * id as double) as amount")
    r = PaymentRoles(supplier="supplier", approver="approver", amount="amount")
    got = outliers.with_z_scores(df, r).select(outliers.GLOBAL).agg(F.avg(outliers.GLOBAL), F.stddev_samp(outliers.GLOBAL)).first()
    assert abs(got[0]) < 1e-9 and abs(got[1] - 1) < 1e-9
