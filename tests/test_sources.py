"""File scans, list text, stage tables."""

import csv
import random

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mirrorset.sources import csvblocks, examples, stages


def test_csv_dialect_roles_and_order(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text(
        'Label,id,example\njoy,7,"he said ""hi"", twice"\nNone,8,"two\nlines"\n,9,\nnone,10,plain\n', "utf-8"
    )
    df = examples.read_examples(spark, str(path), "id", "example", "Label")
    rows = [tuple(r) for r in df.orderBy("ord").collect()]
    assert rows == [
        ("7", 'he said "hi", twice', "joy", 0),
        ("8", "two\nlines", None, 1),
        ("9", None, None, 2),
        ("10", "plain", "none", 3),
    ]
    with pytest.raises(ValueError, match="wording"):
        examples.read_examples(spark, str(path), "id", "wording", "Label")


def test_order_runs_on_over_many_files(spark, tmp_path):
    for name, start in (("b", 100), ("a", 0)):
        lines = "\n".join(f"{i},t{i},x" for i in range(start, start + 100))
        (tmp_path / f"{name}.csv").write_text("id,text,label\n" + lines + "\n")
    df = spark.read.options(**examples.CSV_OPTIONS).csv(f"{tmp_path}/*.csv")
    rows = examples.number_rows(df, by_index=False).select("id", "_ord").collect()
    assert sorted((int(r["id"]), r["_ord"]) for r in rows) == [(i, i) for i in range(200)]


def test_parquet_row_index(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(1000).select(
        F.col("id"), F.lit("t").alias("text"), F.lit("l").alias("label")
    ).repartition(5).write.parquet(path)
    df = examples.read_examples(spark, path, "id", "text", "label")
    assert sorted(r["ord"] for r in df.collect()) == list(range(1000))


def test_list_text(evaluate):
    long = "it's " * 5000
    lists = [
        ["seafood", "delicious food"], ["it's"], ["a'b \"c\""], ["back\\slash", "tab\t", "line\n"], [], [long, "é"],
    ]
    texts = [str([[[p]] for p in items]) for items in lists] + ["no list", None]
    assert evaluate(examples.parse_repr_list, texts) == [*lists, None, None]


def test_unparsed_pattern_rows_are_skipped(spark):
    df = spark.createDataFrame(
        [("1", "t", "l", "a, b", "[[['a']], [['b']]]"), ("2", "t", "l", "a", "broken")],
        "id string, ori_text string, ori_label string, pattern string, highlight string",
    )
    rows = examples.import_patterns(df).collect()
    assert [(r["id"], r["phrases"]) for r in rows] == [("1", ["a", "b"])]


def test_stage_runs_stay_apart(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    stages.write_stage(one, root, "s", 42, "qwen:7b", "d.csv")
    stages.write_stage(one.withColumn("n", F.lit(2)), root, "s", 1, "qwen:7b", "d.csv")
    stages.write_stage(one.withColumn("n", F.lit(3)), root, "s", 42, "qwen:7b", "d.csv")
    assert [tuple(r) for r in stages.read_stage(spark, root, "s", 42, "qwen:7b", "d.csv").collect()] == [("a", 3)]
    assert [tuple(r) for r in stages.read_stage(spark, root, "s", 1, "qwen:7b", "d.csv").collect()] == [("a", 2)]
    assert stages.has_stage(spark, root, "s", 42, "qwen:7b", "d.csv")
    assert not stages.has_stage(spark, root, "s", 9, "qwen:7b", "d.csv")
    assert not stages.has_stage(spark, root, "missing", 42, "qwen:7b", "d.csv")
    runs = stages.read_runs(spark, root, "s")
    assert sorted((r["run_seed"], r["run_model"], r["n"]) for r in runs.collect()) == [(1, "qwen_7b", 2), (42, "qwen_7b", 3)]
    plan = runs.filter("run_seed = 42")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_seed" in plan
    with pytest.raises(AnalysisException):
        stages.read_stage(spark, root, "s", 9, "qwen:7b", "d.csv")


def test_empty_stage_keeps_its_schema_and_drops_old_rows(spark, tmp_path):
    key = (str(tmp_path), "s", 42, "m", "d")
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    stages.write_stage(one, *key)
    stages.write_stage(one.filter("n > 1"), *key)
    df = stages.read_stage(spark, *key)
    assert df.columns == ["id", "n"] and df.count() == 0
    assert stages.has_stage(spark, *key)


def test_answers_are_merged_by_request(spark, tmp_path):
    schema = "request_id string, text string, error string"
    first = spark.createDataFrame([("a", "x", None), ("b", None, "boom"), ("c", None, "boom")], schema)
    again = spark.createDataFrame([("a", "y", None), ("b", "z", None)], schema)
    stages.append_results(first, str(tmp_path), "log", 0)
    stages.append_results(again, str(tmp_path), "log", 1)
    rows = sorted(map(tuple, stages.read_results(spark, str(tmp_path), "log").collect()))
    assert rows == [("a", "x", None), ("b", "z", None), ("c", None, "boom")]


def test_candidate_lists_that_do_not_parse_stay_one_phrase(spark):
    from mirrorset.sources.examples import import_candidates

    rows = spark.createDataFrame([(1, "['a', \"it's\"]"), (2, "plain words"), (3, None)], "i int, candidate_phrases string")
    got = {r["i"]: r["candidate_phrases"] for r in import_candidates(rows).collect()}
    assert got == {1: ["a", "it's"], 2: ["plain words"], 3: None}


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_csv_fields_across_block_ends(spark, tmp_path, small_blocks, monkeypatch, line_break):
    """Blocks of 300 bytes, fields of up to several blocks: the rows are those of Spark's scan of whole files."""
    rng = random.Random(2)

    def field():
        bits = ["a", "b c", line_break, '"', ",", line_break * 2, "é", "word " * 5]
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, rng.choice([3, 60]))))

    rows = [(f"{f}-{i}", field(), rng.choice(["", "p", field()])) for f in range(2) for i in range(60)]
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            made = csv.writer(out, lineterminator=line_break)
            made.writerows([["id", 'x"y', "z"], *rows[f * 60 : f * 60 + 60]])
            out.write(line_break * 2 if f else "")
    whole = spark.read.options(**csvblocks.CSV_OPTIONS, multiLine=True).csv(str(tmp_path))
    want = sorted(map(str, whole.collect()))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
    for few in (csvblocks.local_rows, lambda df: None):
        monkeypatch.setattr(csvblocks, "local_rows", few)
        got = sorted(csvblocks.read_csv(spark, str(tmp_path)).collect(), key=lambda r: r["_ord"])
        assert [r["_ord"] for r in got] == list(range(120)) and [r["id"] for r in got] == [r[0] for r in rows]
        assert sorted(str(r) for r in spark.createDataFrame([tuple(r)[:-1] for r in got], whole.schema).collect()) == want


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('\nid,text\n"1",\n2,"no break at the end"')
    got = csvblocks.read_csv(spark, str(tmp_path)).orderBy("_ord").collect()
    assert [tuple(r) for r in got] == [("1", None, 0), ("2", "no break at the end", 1)]


def test_files_of_a_run_are_packed_tightly(spark, tmp_path):
    """Stages and answers, new and merged, are written with the codec that takes least disk."""
    rows = spark.range(50).selectExpr("CAST(id AS STRING) AS request_id", "repeat('text ', 9) AS text", "CAST(NULL AS STRING) AS error")
    stages.write_stage(rows, str(tmp_path / "runs"), "said", 42, "m", "d")
    store = stages.answer_store(spark, str(tmp_path / "kept"), "answers")
    for run in (0, 1):
        store.append(rows, run)
    for merge in (False, True):
        assert not merge or store.compact(pile=2)
        files = [f for f in tmp_path.rglob("*.parquet") if f.name.startswith("part-")]
        codecs = {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups}
        assert files and codecs == {"ZSTD"}
    assert store.read().count() == 50
