"""Keyed tables: merges by bucket, versions, writers side by side, failures between steps."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.facts import round_exact
from corpusloom.operators import keyed, language, metrics, stages
from corpusloom.operators.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def files(table):
    return {str(p.relative_to(table.path)) for p in Path(table.path).rglob("part-*")}


def test_merges_rewrite_the_buckets_they_touch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=8)
    assert table.version() == 0 and held(table) == []
    assert table.merge(rows(spark, [(f"k{i}", i) for i in range(100)])) == 1
    before = files(table)
    assert table.merge(rows(spark, [("k7", 70), ("new", 1), (None, 5)])) == 2
    table.merge(rows(spark, [(None, 6)]))
    assert held(table) == sorted([*[(f"k{i}", i) for i in range(100) if i != 7], ("k7", 70), ("new", 1), (None, 6)], key=str)
    named = {p.split("/part-")[0] for p in files(table)}
    touched = {r[0] for r in rows(spark, [("k7", 0), ("new", 0), (None, 0)]).select(table._bucket()).collect()}
    now = table._places(3)
    assert {b for b, v in now.items() if not v.startswith("1-")} == touched and before <= files(table)
    assert held(table) != [] and len(table.read(1).collect()) == 100  # an older version can be read
    table.vacuum()
    assert {p.split("/part-")[0] for p in files(table)} < named and len(held(table)) == 102
    assert table.merge(rows(spark, [])) == 3


def test_a_failure_between_the_steps_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=4)
    table.merge(rows(spark, [("a", 1), ("b", 2)]))

    def fails(*_):
        raise OSError("no more space")

    with monkeypatch.context() as m:
        m.setattr(keyed, "_create", fails)
        with pytest.raises(OSError, match="space"):
            table.merge(rows(spark, [("a", 9)]))
    assert table.version() == 1 and held(table) == [("a", 1), ("b", 2)]
    table.merge(rows(spark, [("a", 3)]))
    assert held(table) == [("a", 3), ("b", 2)]


def test_a_writer_that_comes_second_merges_over_the_first(spark, tmp_path, monkeypatch):
    table, real = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=4), keyed._create
    table.merge(rows(spark, [("a", 1), ("b", 2)]))
    calls = []

    def beaten(spark_, path, text):
        calls.append(path)
        if len(calls) == 1:  # another writer finishes first
            monkeypatch.setattr(keyed, "_create", real)
            table.merge(rows(spark, [("a", 5), ("c", 3)]))
            monkeypatch.setattr(keyed, "_create", beaten)
        return real(spark_, path, text)

    monkeypatch.setattr(keyed, "_create", beaten)
    assert table.merge(rows(spark, [("b", 7), ("c", 8)]), keep_old=True) == 3
    assert held(table) == [("a", 5), ("b", 2), ("c", 3)]


def test_unfinished_versions_are_not_read(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=4)
    table.merge(rows(spark, [("a", 1)]))
    (Path(table.path) / "versions" / "2").write_text('{"0": ')
    assert table.version() == 1 and held(table) == [("a", 1)]
    monkeypatch.setattr(keyed, "PENDING_S", 0)
    with pytest.raises(keyed.Conflict, match="unfinished"):
        table.merge(rows(spark, [("a", 2)]))


def test_two_runs_side_by_side_keep_one_record_a_key(spark, tmp_path):
    path, todo = str(tmp_path / "t"), spark.range(6).select(F.col("id").cast("string").alias("k"))
    by = lambda name: lambda df: df.withColumn("by", F.lit(name))

    def slow(df):
        made = by("slow")(df)
        stages.resume(todo.filter("k < '4'"), path, "k", by("fast"))  # finishes while this one computes
        return made

    out = {r["k"]: r["by"] for r in stages.resume(todo, path, "k", slow).collect()}
    assert out == {"0": "fast", "1": "fast", "2": "fast", "3": "fast", "4": "slow", "5": "slow"}

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stages.resume(spark.range(9).select(F.col("id").cast("string").alias("k")), path, "k", dies)
    assert stages.resume(todo, path, "k", by("late")).count() == 6


def test_rounding_is_that_of_the_exact_value(spark):
    r = random.Random(1)
    values = [a / b for a in range(0, 60) for b in range(1, 400)] + [r.randrange(10**6) / r.choice((8, 16, 1000, 2000, 20000)) for _ in range(5000)] + [-x / 16 for x in range(40)] + [0.0, 0.0005, 0.0015, 2.675, 1e17, 2.0**52, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[round_exact(F.col("x"), n).alias(f"r{n}") for n in (1, 3)])
    assert not [tuple(g) for g in got.collect() if g["r3"] != round(g["x"], 3) or g["r1"] != round(g["x"], 1)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_longest_common_subsequence_against_the_table():
    def by_table(a, b):
        rows_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows_[i + 1][j + 1] = rows_[i][j] + 1 if x == y else max(rows_[i][j + 1], rows_[i + 1][j])
        return rows_[-1][-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdefg"[: r.randrange(1, 8)]) for _ in range(r.randrange(0, 30))] for _ in range(2))
        assert metrics.lcs_length(a, b) == by_table(a, b)
    import time

    began, long = time.time(), [[str(r.randrange(500)) for _ in range(10_000)] for _ in range(2)]
    assert metrics.lcs_length(*long) > 500 and time.time() - began < 1


def test_languages_of_rows_that_nobody_has_seen(spark):
    de, en = "der die und ist nicht eine schule garten wetter", "the and was with house garden weather school"
    r = random.Random(3)
    made = [(lang, " ".join(r.choice(words.split()) for _ in range(20))) for lang, words in (("de", de), ("en", en)) for _ in range(20)]
    model = language.train(spark.createDataFrame([*made, (None, "x y z"), ("de", None)], "lang string, text string"), lengths=(1, 2, 3))
    asked = [(0, "Der Garten ist eine Schule"), (1, "The GARDEN was with weather"), (2, None), (3, ""), (4, "12 34"), (5, "漢字漢字漢字")]
    got = {x["more"]: x["language"] for x in language.classify(spark.createDataFrame(asked, "more int, text string"), model).collect()}
    assert got == {0: "de", 1: "en", 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(ValueError, match="no row"):
        language.train(spark.createDataFrame([(None, "x")], "lang string, text string"))


def test_figures_of_a_known_job(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    _, told = stages.measured(spark, "job", lambda: read.repartition(6, "id").selectExpr("sum(crc32(cast(id as string))) as x").collect(), str(tmp_path / "told"))
    assert told["jobs"] >= 1 and told["tasks"] >= 2 and told["failed_tasks"] == 0
    assert 200_000 < told["shuffle_write_bytes"] < 10_000_000 and told["shuffle_read_bytes"] == told["shuffle_write_bytes"]
    assert told["input_bytes"] > 1_000 and 0 < told["executor_cpu_ms"] < 60_000 and told["disk_spill_bytes"] == 0
    assert f"tasks: {told['tasks']}" in {r[0] for r in spark.read.text(str(tmp_path / "told")).collect()}
