"""Merge laws, conformance and key rules."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from amperoute.operators import conform, filters, merge
from amperoute.plans.maintenance import fold_small
from amperoute.sources.tables import read_seed, replace_table, touched_rows, upsert_partitions, upsert_table

SCHEMA = "k1 int, k2 date, a double, b int"
D = date(2024, 1, 1)
OLD = [(1, D, 1.0, 10), (2, D, 2.0, None), (3, D, None, 30), (None, D, 5.0, 50)]
NEW = [(1, D, 1.0, 10), (2, D, None, 20), (3, D, 3.0, 31), (4, D, 4.0, 40), (None, D, 6.0, 60)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)


def result(df):
    return sorted(((r.k1, r.a, r.b, r.merge_action) for r in df.collect()), key=str)


def test_policies(tables):
    old, new = tables
    keys = ["k1", "k2"]
    absent = result(merge.merge_into(old, new, keys, policy="insert_absent"))
    assert (2, 2.0, None, "unchanged") in absent and (4, 4.0, 40, "inserted") in absent
    over = result(merge.merge_into(old, new, keys))
    assert (1, 1.0, 10, "unchanged") in over and (2, None, 20, "updated") in over and (3, 3.0, 31, "updated") in over
    fill = result(merge.merge_into(old, new, keys, policy="fill_nulls"))
    assert (2, 2.0, 20, "updated") in fill and (3, 3.0, 30, "updated") in fill
    part = result(merge.merge_into(old, new, keys, columns=["b"]))
    assert (2, 2.0, 20, "updated") in part and (3, None, 31, "updated") in part


def test_null_keys(tables):
    old, new = tables
    loose = result(merge.merge_into(old, new, ["k1", "k2"]))
    assert sum(r[0] is None for r in loose) == 2
    safe = result(merge.merge_into(old, new, ["k1", "k2"], null_safe_keys=True))
    assert [r for r in safe if r[0] is None] == [(None, 6.0, 60, "updated")]


@pytest.mark.parametrize("policy", merge.POLICIES)
def test_second_run_changes_nothing(tables, policy):
    old, new = (t.where("k1 is not null") for t in tables)
    once = merge.merge_into(old, new, ["k1", "k2"], policy=policy).drop("merge_action")
    again = merge.merge_into(once, new, ["k1", "k2"], policy=policy)
    assert again.where("merge_action in ('inserted', 'updated')").isEmpty()
    assert sorted(map(tuple, again.drop("merge_action").collect())) == sorted(map(tuple, once.collect()))


def test_insert_distinct_is_null_safe(tables):
    old, new = tables
    fresh = merge.insert_distinct(old, new.unionByName(new), ["k1", "a", "b"])
    assert sorted(map(tuple, fresh.collect()), key=str) == sorted([(2, None, 20), (3, 3.0, 31), (4, 4.0, 40), (None, 6.0, 60)], key=str)


def test_overlap_counts(tables):
    old, new = tables
    counts = merge.overlap_counts(new, old, ["k1", "k2"], {"a": 6}).first()
    assert tuple(counts) == (5, 3, 2, 2, 1)


def test_upsert_table_counts_while_writing(tables, tmp_path):
    old, new = tables
    replace_table(old, str(tmp_path / "t"))
    counts = upsert_table(new, str(tmp_path / "t"), str(tmp_path / "u"), ["k1", "k2"])
    assert counts == {"inserted": 2, "updated": 2, "unchanged": 1, "kept": 1}
    assert old.sparkSession.read.parquet(str(tmp_path / "u")).count() == 6


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, date(2024, 1, 1), 1.0), (1, date(2024, 1, 2), 2.0), (2, date(2024, 1, 2), 5.0)]
    replace_table(spark.createDataFrame(rows, "k int, date date, a double"), path, ["date"])
    before = {f.path for f in spark.read.format("binaryFile").load(f"{path}/date=2024-01-01").select("path").collect()}
    upsert_partitions(spark.createDataFrame([(1, date(2024, 1, 2), 9.0), (3, date(2024, 1, 3), 7.0)], "k int, date date, a double"), path, ["k", "date"])
    got = sorted((r.k, r.date.day, r.a) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, 1.0), (1, 2, 9.0), (2, 2, 5.0), (3, 3, 7.0)]
    assert before == {f.path for f in spark.read.format("binaryFile").load(f"{path}/date=2024-01-01").select("path").collect()}


def test_key_policies(spark):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "fleet int, code string")
    dim = spark.createDataFrame([(10, 1, "a")], "id int, fleet_id int, name string")
    on = {"fleet": "fleet_id", "code": "name"}
    assert conform.resolve_key(facts, dim, on, "id", "key").where("key is null").count() == 2
    assert conform.resolve_key(facts, dim, on, "id", "key", unmapped="drop").count() == 1
    with pytest.raises(PySparkException, match="unmapped key"):
        conform.resolve_key(facts, dim, on, "id", "key", unmapped="fail").collect()


def test_rekey_only_touches_text(spark):
    dim = spark.createDataFrame([(10, "a")], "id int, code string")
    assert conform.rekey(spark.createDataFrame([("a", 1)], "veh_id string, x int"), dim, "veh_id", "code").first() == (10, 1)
    same = spark.createDataFrame([(3,)], "veh_id int")
    assert conform.rekey(same, dim, "veh_id", "code") is same


def test_headers_and_columns(spark):
    df = spark.createDataFrame([("1", "2", "3")], "` Speed\n (mph) ` string, `Time(EST)` string, `Long  name of Parts cost ($)` string")
    clean = conform.normalize_headers(df)
    assert clean.columns[0] == "Speed (mph)"
    wanted = {"speed": {"exact": ["speed (MPH)"]}, "time": {"prefix": "time("}, "parts": {"parts": ["parts", "cost"]}}
    assert conform.resolve(clean, wanted).columns == ["speed", "time", "parts"]
    with pytest.raises(conform.MissingColumns):
        conform.resolve(clean, {"x": {"exact": ["nope"]}})
    with pytest.raises(conform.MissingColumns):
        conform.require(clean, ["nope"])


def test_dimension_fill_keeps_known_attributes(spark):
    have = spark.createDataFrame([(1, "a", "Make", None)], "fleet_id int, code string, make string, model string")
    seeds = spark.createDataFrame([(1, "a", "Other", "M"), (1, "b", "New", "N")], "fleet_id int, code string, make string, model string")
    got = sorted(map(tuple, conform.fill_dimension(have, seeds, ["fleet_id", "code"]).collect()))
    assert got == [(1, "a", "Make", "M"), (1, "b", "New", "N")]


def test_small_shares_fold_but_exactly_the_threshold_stays(spark):
    counts = spark.createDataFrame([("big", 980), ("edge", 10), ("x", 5), ("y", 5)], "label string, n long")
    assert {r.label: r.n for r in fold_small(counts, "label", "n").collect()} == {"big": 980, "edge": 10, "Other": 10}
    empty = spark.createDataFrame([("a", 0)], "label string, n long")
    assert [tuple(r) for r in fold_small(empty, "label", "n").collect()] == [("a", 0)]


def test_asset_filter_counts_station_rows(spark):
    events = spark.createDataFrame([(1, 5, None, 1), (2, None, 7, 2), (3, None, None, 2), (4, None, None, None)], "id int, veh_id int, charger_id int, maint_ob int")
    assert [r.id for r in filters.assets(events, "charger").orderBy("id").collect()] == [2, 3]
    assert [r.id for r in filters.assets(events, "charger", [7]).collect()] == [2]
    assert [r.id for r in filters.assets(events, "vehicle").collect()] == [1]


def test_data_rows(spark):
    df = spark.createDataFrame([("Grand Total", "1", 1), (None, None, 2), (None, "x", 3), ("d", None, 4)], "Day string, `a.` string, row_no int")
    assert sorted(r.row_no for r in filters.data_rows(df, F.col("Day")).collect()) == [3, 4]


def test_seed_rows(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\tDepot A\tt\t\\N\n2\t\\N\tf\t1.5\n")
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("id int, name string, flag boolean, x double")
    got = read_seed(spark, str(tmp_path / "s.tsv"), schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "Depot A", True, None), (2, None, False, 1.5)]


def test_null_partition_and_null_keys_survive_a_partitioned_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "k int, date date, a double"
    replace_table(spark.createDataFrame([(1, date(2024, 1, 1), 1.0), (2, None, 2.0), (None, None, 3.0)], kind), path, ["date"])
    batch = spark.createDataFrame([(7, None, 7.0), (1, date(2024, 1, 1), 4.0), (8, date(2024, 1, 1), 8.0)], kind)
    counts = upsert_partitions(batch, path, ["k", "date"])
    assert counts == {"inserted": 2, "updated": 1, "unchanged": 0, "kept": 2}
    got = sorted(((r.k, r.date, r.a) for r in spark.read.parquet(path).collect()), key=str)
    want = [(1, date(2024, 1, 1), 4.0), (8, date(2024, 1, 1), 8.0), (2, None, 2.0), (7, None, 7.0), (None, None, 3.0)]
    assert got == sorted(want, key=str)


def test_touched_partitions_are_bounded_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.createDataFrame([(k, date(2024, 1, k), 1.0) for k in range(1, 9)], "k int, date date, a double"), path, ["date"])
    batch = spark.createDataFrame([(3, date(2024, 1, 3), 2.0)], "k int, date date, a double")
    text = touched_rows(spark.read.parquet(path), batch, "date")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "subquery" in text.split("PartitionFilters: [")[1].split("]")[0].lower()


def test_duplicate_source_keys_fail_whatever_is_read(tables):
    old, new = tables
    twice = new.unionByName(new.where("k1 = 3"))
    with pytest.raises(PySparkException, match="not unique"):
        merge.merge_into(old, twice, ["k1", "k2"]).select("merge_action").collect()
    assert merge.merge_into(old, merge.unique_source(twice, ["k1", "k2"], F.col("a")), ["k1", "k2"]).count() > 0


def test_unique_source_keeps_rows_without_a_full_key(spark):
    rows = [(1, "a", 1), (1, "a", 2), (None, "a", 3), (None, "a", 4), (2, None, 5)]
    got = merge.unique_source(spark.createDataFrame(rows, "k int, c string, x int"), ["k", "c"], F.col("x").desc())
    assert sorted(r.x for r in got.collect()) == [2, 3, 4, 5]


def test_unmapped_keys_fail_also_where_the_key_is_not_read(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")
    dim = spark.createDataFrame([(7, "a")], "id int, code string")
    with pytest.raises(PySparkException, match="unmapped key"):
        conform.resolve_key(facts, dim, {"code": "code"}, "id", "key", unmapped="fail").select("n").collect()
