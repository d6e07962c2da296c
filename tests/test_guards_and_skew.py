"""Checks that no plan drops, joins that spread hot keys, and de-duplication by digest."""

import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from spellframe.operators import joins as J
from spellframe.operators import quality as Q
from spellframe.operators import skew


@pytest.fixture
def repeated(table):
    return table([(1, "x"), (5, "y")], "k int, a string"), table([(1, "r"), (1, "s"), (2, "t")], "k int, b string")


@pytest.mark.parametrize("job", [lambda d: d.count(), lambda d: d.select("a").collect(), lambda d: d.select("k").distinct().collect(), lambda d: d.agg(F.max("a")).collect(),
                                 lambda d: d.where("a = 'y'").collect()])
@pytest.mark.parametrize("join", [J.checked_left_join, J.validated_merge, lambda a, b, on: J.validated_merge(a, b, on, "inner"), lambda a, b, on: J.validated_merge(a, b, on, validate="one_to_one")])
def test_a_repeated_right_key_fails_every_job(repeated, join, job):
    with pytest.raises(PySparkException, match="not unique"):
        job(join(*repeated, ["k"]))


def test_a_repeated_key_fails_also_where_no_row_meets_it(table):
    left, right = table([(7, "x")], "k int, a string"), table([(1, "r"), (1, "r")], "k int, b string")
    with pytest.raises(PySparkException, match="not unique"):
        J.checked_left_join(left, right, ["k"]).select("a").collect()
    with pytest.raises(PySparkException, match="not unique"):
        J.unique_or_fail(right, ["k"]).count()
    assert rows(J.key_violations(right, ["k"])) == [(1, 2)]
    assert J.checked_left_join(left, right.limit(1), ["k"]).count() == 1


def test_one_to_one_checks_the_left_side_too(table):
    left, right = table([(1, "x"), (1, "y"), (None, "z")], "k int, a string"), table([(1, "r")], "k int, b string")
    with pytest.raises(PySparkException, match="left side"):
        J.validated_merge(left, right, ["k"], validate="one_to_one").count()


@pytest.mark.parametrize("kind", ["semi", "anti", "guarded", "left"])
def test_a_key_of_ninety_percent_is_spread(spark, monkeypatch, kind):
    monkeypatch.setattr(skew, "HOT_ROWS", 5_000)
    monkeypatch.setattr(skew, "SALT_ROWS", 50)
    monkeypatch.setattr(skew, "LOOK", 1.0)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        k = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.when(F.col("id") % 2 == 0, -1))
        left = spark.range(120_000).select((k if kind == "semi" else F.coalesce(k, F.lit(-1).cast("long"))).alias("k"), (F.col("id") % 3).alias("p"), "id")
        right = spark.range(0, 200_000, 20).select(F.col("id").alias("k"), (F.col("id") % 3).alias("p"))
        if kind != "anti":  # NULL is a value of k in the semi-join: two hot keys then
            right = right.unionByName(spark.createDataFrame([(-1, 0), (-1, 1), (-1, 2), (None, 0), (None, 1), (None, 2)], "k long, p long"))
        if kind == "semi":
            out, want = J.semi_match(left, right, ["k", "p"], ["k"]), left.join(right, left.k.eqNullSafe(right.k) & (left.p == right.p), "left_semi")
        elif kind == "anti":
            out, want = J.unmatched(left, right, ["k", "p"]), left.join(right, ["k", "p"], "left_anti").select(*left.columns)
        elif kind == "guarded":
            side = right.where("p = 0 AND k IS NOT NULL")
            out, want = J.guarded_key_join(left.drop("p"), side, "k"), left.drop("p").join(side, "k", "left")
        else:
            side = right.where("p = 0 AND k IS NOT NULL")
            out, want = J.checked_left_join(left.drop("p"), side, ["k"]), left.drop("p").join(side, "k", "left")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(sizes) == 12 and max(sizes) < 2 * statistics.median(sizes)
        assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_long_list_of_hot_keys_is_written(spark, monkeypatch):
    monkeypatch.setattr(skew, "LISTED", 3)
    left = spark.range(200).select((F.col("id") % 10).alias("k"), "id")
    hot = skew.find_sized(left, ["k"], min_rows=10, look=1)
    assert hot.count() == 10 and "Parquet" in hot._jdf.queryExecution().toString()
    right = spark.range(0, 10, 2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    assert rows(skew.salted_join(left, right, ["k"], hot=hot)) == rows(left.join(right, "k", "left"))


def test_dedupe_tells_null_from_values_and_counts_null_keys(table):
    data = [(1, None, 1), (1, None, 1), (2, None, 1), (2, 1, None), (3, "", 1), (3, None, 1), (None, "a", 1), (None, "a", 1), (4, "x", 0)]
    d = Q.dedupe_quarantine(table(data, "k int, a string, b int"), ["k"], ["a", "b"])
    assert rows(d.kept) == [(1, None, 1), (4, "x", 0)]
    assert rows(d.counts) == [(9, 4, 1, 2, 4, 2, 2)]
    assert d.counts.columns == ["rows_in", "distinct_keys", "exact_duplicate_rows_collapsed", "conflicting_keys", "rows_in_conflicting_keys", "rows_kept", "null_key_rows"]
    assert sorted(r.quarantine_reason for r in d.quarantine.collect()) == ["conflicting_duplicate_key"] * 4 + ["missing_key"] * 2


def test_quantiles_of_numbers_and_dates(spark, monkeypatch):
    import datetime
    import math
    import random
    from spellframe.operators import ranks
    monkeypatch.setattr(ranks, "BINS", 4)  # several rounds
    rng = random.Random(5)
    cases = {"v double": [rng.uniform(-1e300, 1e300) for _ in range(200)] + [float("inf"), -float("inf"), 0.0, 5e-324, None, float("nan")], "v bigint": [2**63 - 1, -2**63, 0, 1, 2, 3, 3, 3, None],
             "v decimal(9,2)": [__import__("decimal").Decimal(rng.randrange(-10**6, 10**6)).scaleb(-2) for _ in range(50)], "v date": [datetime.date(1960, 1, 1) + datetime.timedelta(rng.randrange(30_000)) for _ in range(300)],
             "v int": [7], "v float": [0.5, 0.25, 0.25]}
    levels = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for schema, data in cases.items():
        kept = sorted(x for x in data if x is not None and x == x)
        got = ranks.discrete_quantiles(spark.createDataFrame([(x,) for x in data], schema), "v", levels).collect()
        want = [kept[max(1, len(kept) - math.floor(len(kept) - p * len(kept))) - 1] for p in levels]
        assert [r.quantile for r in got] == want, schema
    assert [r.quantile for r in ranks.discrete_quantiles(spark.createDataFrame([(None,)], "v int"), "v", (0.5,)).collect()] == [None]
    with pytest.raises(ValueError, match="no quantiles"):
        ranks.discrete_quantiles(spark.createDataFrame([("a",)], "v string"), "v")


def test_positions_over_many_files(spark, tmp_path):
    from spellframe.sources import manifests as M
    spark.range(1_000).repartition(23).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = M.parquet_row_positions(table).orderBy("part", "row").collect()
    assert [r.ordinal for r in got] == list(range(1_000)) and len({r.part for r in got}) == 23
    assert {r.id for r in M.rows_at(table, spark.createDataFrame([(3,), (700,)], "ordinal long")).collect()} == {got[3].id, got[700].id}


def test_required_literals():
    import re
    from spellframe.functions import fixed_values as V
    from spellframe.functions import required_literals
    assert required_literals(r"\bnonexecutive\b|\bned\b") == {"nonexecutive", "ned"}
    assert required_literals(r"a?b*[xyz]") is None and required_literals(r"(ab|c)+de") == {"de"} and required_literals(r"(abc|abd)") is not None
    texts = ["chair of the board", "board of advisers", "startup advisor", "ned", "interns", "co-op student", "co-opted governor", "summer placements", "part-time", "trustee", "member, of the board"]
    for name in V.TITLE_TAXONOMY["order"]:
        for _, pattern in V.TITLE_TAXONOMY["categories"][name]["include"]:
            needed = required_literals(pattern)
            assert needed and all(any(x in t for x in needed) for t in texts if re.search(pattern, t))


def test_passages_end_at_sentences_or_white_space(table):
    from spellframe.operators import language as G
    word = "wörter"
    long = " ".join([word] * 200)
    texts = [long + ". Next one! And\nmore", "x" * 5_000 + " y", "short", "", "?!", "a" * 399 + "bc d", long.replace(" ", "\t")]
    got = {}
    for r in G.passages(table(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.passage)
    assert {i: "".join(p) for i, p in got.items()} == {i: t for i, t in enumerate(texts) if t}
    for i, pieces in got.items():
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert not (a[-1].isalnum() and b[0].isalnum()), (i, a[-9:], b[:9])
    assert max(map(len, got[0])) <= 400 + len(word) + 1 and got[1][0] == "x" * 5_000 + " "


def test_a_large_model_is_joined_with_salts(spark, monkeypatch, table):
    from spellframe.operators import language as G
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "SALT_ROWS", 1)
    monkeypatch.setattr(skew, "LOOK", 1.0)
    data = table([(i, ["the river and the stone. the end", "der fluss und der stein. das ende", None, ""][i % 4], ["en", "de"][i % 2]) for i in range(12)], "id int, t string, l string")
    model = G.language_profiles(data, "t", "l", ["en", "de"]).cache()
    small = rows(G.score_passages(data, "id", "t", model, ["en", "de"], ("rs", "zt")).drop("confidence", "second"))
    monkeypatch.setattr(G, "MODEL_BYTES", 0)
    assert rows(G.score_passages(data, "id", "t", model, ["en", "de"], ("rs", "zt")).drop("confidence", "second")) == small and len(small) == 12


def test_script_from_chinese_passages(table):
    from spellframe.operators import language as G
    spans = table([(1, 0, 50, "Chinese", 50, 0.9, 0.1, "ab", ""), (1, 50, 90, "Chinese", 30, 0.9, 0.1, "c", ""), (2, 0, 50, "Chinese", 50, 0.9, 0.1, "a", ""), (3, 0, 60, "Chinese", 60, 0.9, 0.1, "ab", "x"),
                   (4, 0, 60, "Chinese", 60, 0.9, 0.1, "", "xy"), (5, 0, 30, "Chinese", 30, 0.9, 0.1, "ab", ""), (6, 0, 60, "English", 60, 0.9, 0.1, "ab", "")],
                  "id int, start int, end int, language string, letters int, confidence double, second double, simplified string, traditional string")
    merged = G.merge_spans(spans, "id")
    assert [tuple(r) for r in merged.where("id = 1").select("start", "end", "letters", "simplified").collect()] == [(0, 90, 80, "abc")]
    got = G.classify_language(merged, table([(i, [80, 50, 60, 60, 30, 60][i - 1]) for i in range(1, 7)], "id int, letters int"), "id")
    assert {r.id: (r.language_group, r.chinese_script) for r in got.collect()} == {
        1: ("Chinese", "simplified"), 2: (None, None), 3: (None, None), 4: ("Chinese", "traditional"), 5: (None, None), 6: ("English", None)}


def test_a_bucket_is_read_by_its_folder(spark, tmp_path):
    from spellframe.sources.tables import read_partition, write_table
    path = str(tmp_path / "t")
    assert write_table(spark.range(100).withColumn("bucket", F.col("id") % 5), path, ["bucket"]) == 100
    one, none = read_partition(spark, path, "bucket", 3), read_partition(spark, path, "bucket", 77)
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString() and len(one.inputFiles()) >= 1
    assert sorted(r.id for r in one.collect()) == list(range(3, 100, 5))
    assert none.count() == 0 and none.columns == ["id", "bucket"]


def test_distinct_values_of_all_columns_in_one_pass(table):
    data = [(0.0, "a", b"x"), (-0.0, "a", b"x"), (1.5, None, b"y"), (float("nan"), "b", None), (float("nan"), "", None)]
    got = {r.column: r.distinct_values for r in Q.profile_columns(table(data, "d double, s string, b binary"), ["d", "s", "b", "gone"]).collect()}
    assert got == {"d": 3, "s": 3, "b": 2}
    assert {r.distinct_values for r in Q.profile_columns(table([(None,)], "n int"), ["n"]).collect()} == {0}


def test_inventory_of_the_job(spark, tmp_path):
    from spellframe.plans.config import HistoryConfig
    from spellframe.plans.history_job import HistoryJob
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("u1", "p1", "HK"), ("u1", "p2", None), (None, "p3", "HK"), ("u9", "p3", "HK")], "user_id string, position_id string, country string").write.parquet(f"{src}/spells")
    spark.createDataFrame([("u1", "HK")], "user_id string, user_country string").write.parquet(f"{src}/people")
    cfg = HistoryConfig(cutoff="2026-08-31", last_complete_quarter="2026Q2", partial_quarter="2026Q3", home="HK", windows={"primary": ("2019Q4", "2023Q3")})
    tables = {"positions": "spells", "users": "people", "cohort": "people"}
    HistoryJob(spark, src, out, cfg, tables=tables, wanted_fields={"age": ["age"], "country": ["country"]},
               mapping=[{"field": "home", "table": "people", "columns": ["user_country", "missing"]}]).run(["inventory"])
    report = lambda name: spark.read.option("header", True).option("escape", '"').csv(f"{out}/reports/{name}")
    assert {(r.table, r.column): r.distinct_values for r in report("columns").collect()} == {
        ("spells", "user_id"): "2", ("spells", "position_id"): "3", ("spells", "country"): None, ("people", "user_id"): "1", ("people", "user_country"): None}
    keys = {r.table: r for r in report("keys").collect()}
    assert (keys["spells"].declared_key, keys["spells"].conflicting_keys, keys["people"].conflicting_keys) == ("position_id", "1", "0")
    joins = {r.name: (r.matched_rows, r.unmatched_rows, r.left_null_key_rows) for r in report("joins").collect()}
    assert joins == {"positions_to_users": ("2", "1", "1"), "positions_to_cohort": ("2", "1", "1")}
    assert {r.table: r.files for r in report("part_schemas").groupBy("table").agg(F.sum("files").cast("int").alias("files")).collect()}.keys() == {"spells", "people"}
    assert {r.field: r.status[:6] for r in report("absent_fields").collect()} == {"age": "absent", "country": "review"}
    assert {r.column: r.present for r in report("field_mapping").collect()} == {"user_country": "true", "missing": "false"}
