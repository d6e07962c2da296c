import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from histories import CFG
from spellframe.plans import inventory as I
from spellframe.plans import provenance as P
from spellframe.session import shared_folder, stage
from spellframe.sources import catalog as C
from spellframe.sources import export as X
from spellframe.sources import manifests as M
from spellframe.sources import tables as T


def test_write_and_read(spark, table, tmp_path):
    root = str(tmp_path)
    df = table([(i, i % 3) for i in range(10)], "a int, b int")
    assert T.write_table(df, f"{root}/flat/nested/deep") == 10
    assert T.read_table(spark, root, "flat", ["a"]).count() == 10
    assert T.write_table(df, f"{root}/parts", ["b"]) == 10
    assert T.read_partition(spark, f"{root}/parts", "b", 1).count() == 3
    empty = T.read_partition(spark, f"{root}/parts", "b", 9)
    assert empty.count() == 0 and set(empty.columns) == {"a", "b"}
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, root, "absent")


def test_reports_and_records(spark, table, tmp_path):
    df = table([("1", None, dt.date(2020, 1, 2), [1, 2], "a\r\n\tb, \"q\"")], "id string, n int, d date, l array<int>, t string")
    T.write_csv(df, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert back["l"] == "[1,2]" and back["t"].replace("\r\n", "\n") == "a\n\tb, \"q\""
    T.write_json_records(T.nest_record(df, ["d", "l"]).coalesce(1), f"{tmp_path}/json")
    line = json.loads(next((tmp_path / "json").glob("part-*")).read_text())
    assert line == {"id": "1", "n": None, "t": "a\r\n\tb, \"q\"", "posting": {"d": "2020-01-02", "l": [1, 2]}}
    with pytest.raises(ValueError):
        T.nest_record(df.withColumnRenamed("t", "posting"), ["d"])


def test_extract_query(spark, table, tmp_path):
    table([(1, "x"), (2, "y"), (3, "x")], "i int, c string").createOrReplaceTempView("src_rows")
    got = T.extract_query(spark, "SELECT * FROM src_rows WHERE c = :c", {"c": "x"}, f"{tmp_path}/x").first()
    assert (got["status"], got["rows"]) == ("complete", 2)


def test_manifests(spark, table, tmp_path):
    a = tmp_path / "t" / "one"
    T.write_table(table([(i,) for i in range(6)], "i int").repartition(2), str(a))
    before = stage(M.file_manifest(spark, str(tmp_path / "t"), content_hash=True), "before")
    assert M.manifest_diff(before, M.file_manifest(spark, str(tmp_path / "t"), content_hash=True)).count() == 0
    (a / "extra.parquet").write_bytes(next(a.glob("*.parquet")).read_bytes())
    assert rows(M.manifest_diff(before, M.file_manifest(spark, str(tmp_path / "t"), content_hash=True)).select("status")) == [("added",)]
    assert M.schema_signatures(spark, str(tmp_path / "t"), "one").count() == 1
    T.write_table(table([("x",)], "j string"), str(a), mode="append")
    assert M.schema_signatures(spark, str(tmp_path / "t"), "one").count() == 2
    measured = M.measure_tables(spark, str(tmp_path / "t"), ["one"]).first()
    assert measured["parts"] == len(list(a.rglob("*.parquet"))) and measured["bytes"] > 0


def test_reconcile(table):
    manifest = table([("a", "complete", 5, 5, 1, 10), ("b", "running", 3, None, 1, 10), ("c", "complete", 2, None, 1, 1)],
                     "table string, status string, rows bigint, expected_rows bigint, parts bigint, bytes bigint")
    measured = table([("a", 4, 1, 10), ("b", 3, 1, 10), ("d", 1, 1, 1)], "table string, rows bigint, parts bigint, bytes bigint")
    got = {r["table"]: r["problems"] for r in M.reconcile(manifest, measured).collect()}
    assert got == {"a": ["row count differs"], "b": ["table is not complete"], "c": ["manifest rows but no parts"], "d": ["on disk but not in the manifest"]}


def test_row_addresses(spark, table, tmp_path):
    T.write_table(table([(i,) for i in range(20)], "i int").repartition(3), str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    p = M.parquet_row_positions(df)
    assert sorted(r["ordinal"] for r in p.collect()) == list(range(20))
    want = {r["i"] for r in p.where("ordinal IN (0, 7, 19)").collect()}
    assert {r["i"] for r in M.rows_at(df, table([(0,), (7,), (19,), (7,)], "ordinal bigint")).collect()} == want


def test_types(table):
    assert C.target_type("job_id", "bigint") == "string" and C.target_type("pay", "numeric", 19, 2) == "decimal(19,2)"
    for bad in (("pay", "numeric"), ("x", "json")):
        with pytest.raises(ValueError):
            C.target_type(*bad)
    out = C.coerce_schema(table([(2 ** 62, 1.5)], "rcid bigint, pay double"), {"pay": ("numeric", 9, 1)})
    assert tuple(out.first()) == (str(2 ** 62), Decimal("1.5"))


def test_catalogue(spark, table):
    table([(1,)], "user_id int").createOrReplaceTempView("fallback_people")
    found, columns, missing = C.catalog(spark, {"people": ["preferred_people", "fallback_people"], "gone": ["nothing_here"]})
    assert found == {"people": "fallback_people"} and missing == ["gone"] and rows(columns.select("column")) == [("user_id",)]
    cols = C.columns_of({"t": table([(1, 1, 1)], "average_pay int, age_group int, last_seen_at int")})
    got = {r["field"]: (r["matching_columns"], r["status"]) for r in C.search_columns(cols, {"Age": ["age"], "Seen": ["last_seen"], "Birth": ["birth", "dob"]}).collect()}
    assert got["Age"][0] == ["t.age_group"] and got["Seen"][0] == ["t.last_seen_at"] and got["Birth"] == ([], "absent")
    m = C.field_mapping_check([{"field": "Pay", "table": "t", "columns": ["average_pay", "bonus"], "lookups": ["bands"]}], cols)
    assert rows(m.select("column", "present", "missing_lookups")) == [("average_pay", True, ["bands"]), ("bonus", False, ["bands"])]


def test_inventory(table):
    tables = {"pos": table([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), "look": table([("a",), ("a",)], "v string")}
    inv = I.inventory(tables, {"pos": ["k"], "look": None}, [{"name": "pos_look", "left": "pos", "right": "look", "left_on": ["v"], "right_on": ["v"]},
                                                            {"name": "gone", "left": "pos", "right": "none", "left_on": ["v"], "right_on": ["v"]}],
                      ["k"], absent_fields={"Age": ["age"]}, mapping=[{"field": "Key", "table": "pos", "columns": ["k"]}])
    joins = {r["name"]: r for r in inv.joins.collect()}
    assert joins["pos_look"]["row_multiplication_if_naive"] == 2 and joins["gone"]["status"] == "table_missing"
    assert {r["table"]: r["exact_duplicate_rows"] for r in inv.keys.collect()} == {"pos": 1, "look": 1}
    assert inv.absent.first()["status"] == "absent" and inv.mapping.first()["present"]


def test_guarded_export(table):
    df = table([(1, True, None, "x", Decimal("1.5")), (2, None, 3, None, None)], "a bigint, b boolean, c int, s string, d decimal(5,2)")
    out = X.stata_safe(df, 2)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "double", "s": "string", "d": "double"}
    assert rows(out.select("s")) == [("",), ("x",)]
    for bad in (dict(max_rows=1), dict(max_rows=5, status="incomplete")):
        with pytest.raises(ValueError):
            X.stata_safe(df, **bad)
    with pytest.raises(ValueError, match="precision"):
        X.stata_safe(table([(2 ** 53 + 1,)], "rcid bigint"), 5)
    assert X.stata_safe(table([(2 ** 53,)], "rcid bigint"), 5).count() == 1


def test_provenance(spark, table, tmp_path):
    src = tmp_path / "src"
    T.write_table(table([(1,)], "i int"), str(src))
    before = P.run_fingerprint(spark, CFG, str(src))
    done = P.run_record("clean", before, "complete")
    P.require_upstream(done, "clean", P.run_fingerprint(spark, CFG, str(src)))
    (src / "more.parquet").write_bytes(next(src.glob("*.parquet")).read_bytes())
    with pytest.raises(RuntimeError, match="input_listing"):
        P.require_upstream(done, "clean", P.run_fingerprint(spark, CFG, str(src)))
    with pytest.raises(RuntimeError, match="is failed"):
        P.require_upstream(P.run_record("clean", before, "failed"), "clean", before)
    with pytest.raises(RuntimeError, match="not been run"):
        P.require_upstream(None, "clean", before)


class _Session:
    """Just enough of a session to ask where staged tables go."""

    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, type("C", (), {"master": master, "applicationId": "app"})


def test_stage_folder(spark, table):
    assert shared_folder(_Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session("yarn"))
    assert shared_folder(_Session("local[2]")) == shared_folder(_Session("local[2]"))
    assert stage(table([(1, None)], "a int, b string")).where(F.col("b").isNull()).count() == 1


def test_refusals_of_products_beyond_64_bits(spark, table, tmp_path):
    from workload import reports
    for n, keys in enumerate(([2_000_000, -2_000_000, None], [100], [101])):
        table([(i, k, 1.0) for i, k in enumerate(keys)], "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
    beyond = [("lineitem", "l_partkey: integers beyond exact precision, keep as text")]
    assert [rows(reports.export_refusals(spark, f"{tmp_path}/{n}")) for n in range(3)] == [beyond, [], beyond]
