"""Preprocessing, encoding, validation, sources and commands on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lagweave import cli
from lagweave.operators import encoding, preprocess, validation
from lagweave.sources import tables


def test_enrichment(spark):
    tx = spark.createDataFrame([(7, dt.date(2023, 5, 9), 71, "bar"), (4, dt.date(2023, 5, 8), 70, "inn"), (4, dt.date(2023, 5, 3), None, None), (9, dt.date(2023, 5, 1), 79, None)],
                               "merchant_id long, created_at date, card_token_id long, merchant_category_code string")
    cards = spark.createDataFrame([(70, "blue"), (71, "green")], "id long, card_brand string")
    merchants = spark.createDataFrame([(4, "firm", "bar"), (7, "person", "inn")], "id long, document_type string, merchant_category_code string")
    done = preprocess.transaction_layout(preprocess.enrich(tx, cards, merchants), 1)
    assert [tuple(r) for r in done.select("merchant_id", "card_token_id", "card_brand", "document_type", "merchant_category_code").collect()] == [
        (4, 0, "0", "firm", "bar"), (4, 70, "blue", "firm", "inn"), (7, 71, "green", "person", "bar"), (9, 79, "0", "0", "0")]
    again = preprocess.enrich(done, cards, merchants)
    assert sorted(again.columns) == sorted(done.columns)
    with pytest.raises(ValueError, match="created_at"):
        preprocess.enrich(tx.drop("created_at"))


def test_zero_fill_keeps_types(spark):
    df = spark.createDataFrame([(None,) * 6], "a string, b boolean, c date, d timestamp, e decimal(9,2), f timestamp_ntz")
    row = preprocess.zero_fill(df)
    assert row.dtypes == df.dtypes
    assert row.select(F.col("a"), F.col("b"), F.col("c").cast("string"), F.unix_micros("d"), F.col("e").cast("double"), F.col("f").cast("string")).first() == ("0", False, "1970-01-01", 0, 0.0, "1970-01-01 00:00:00")


def test_encoding(spark):
    tx = spark.createDataFrame([(10, "b"), (10, "a'"), (20, "z"), (30, None)], "merchant_id long, status string")
    data = spark.createDataFrame([(10, "train"), (20, "test")], "merchant_id long, split string")
    mapping = encoding.fit_mapping(tx, data, ["status"])
    assert mapping == {"status": {"a'": 0, "b": 1}}
    assert [r.status for r in encoding.encode(tx, mapping).collect()] == [1, 0, 2, 2]
    assert encoding.encode(tx, {"status": {}}).select("status").distinct().collect()[0][0] == 0
    assert encoding.code_lists(mapping, ["status"]) == [[0, 1]]
    with pytest.raises(ValueError):
        encoding.code_lists(mapping, ["status", "card_brand"])


def test_code_mismatches(spark):
    tx = spark.createDataFrame([(1, "A"), (1, "B"), (1, None), (2, "C"), (2, "C"), (3, "D")], "merchant_id long, merchant_category_code string")
    merchants = spark.createDataFrame([(1, "A"), (2, None), (3, "D")], "id long, merchant_category_code string")
    detail = {tuple(r) for r in validation.code_mismatches(tx, merchants).collect()}
    assert detail == {(1, "B", "A", 1), (1, None, "A", 1), (2, "C", None, 2)}
    summary = {tuple(r) for r in validation.code_mismatch_summary(tx, merchants).collect()}
    assert summary == {(1, "A", "NULL, B", 2, 1), (2, None, "C", 2, 0)}


def test_sort_violation(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, None, 1), (4, 1, 9)], "position long, merchant_id long, created_at long")
    assert tuple(validation.first_sort_violation(df, "position").first()) == (4, None, 1, 1, 9)
    assert validation.first_sort_violation(df.filter("position < 4"), "position").count() == 0
    same = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 1, None), (4, 1, 2)], "position long, merchant_id long, created_at long")
    assert validation.first_sort_violation(same, "position").first().position == 4


def test_stored_positions_over_several_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(str(tmp_path / "t.parquet"))
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    got = validation.stored_positions(df).collect()
    assert sorted(r.position for r in got) == list(range(1, 1001))
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == [r.id for r in df.collect()]


def test_storage_form_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", dt.datetime(2024, 1, 1, 12), dt.date(1970, 1, 3), None)], "a int, b string, c timestamp_ntz, d date, e decimal(5,2)")
    assert [tuple(r) for r in tables.numeric_projection(df).collect()] == [(1, 1704110400000000, 2, 0.0)]
    manifest = tables.materialize(df, tmp_path / "m")
    assert manifest["rows"] == 1 and set(manifest["columns"]) == {"a", "c", "d", "e"}
    assert tables.load_columns(spark, tmp_path / "m", ["a"]).columns == ["a"]
    with pytest.raises(ValueError, match="zzz"):
        tables.load_columns(spark, tmp_path / "m", ["zzz"])
    with pytest.raises(FileExistsError):
        tables.materialize(df, tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        tables.read_parquet(spark, tmp_path / "none")
    with pytest.raises(ValueError):
        tables.write_parquet(df, tmp_path / "x", inputs=[tmp_path / "x"])


def test_rewrite_in_place(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    tables.rewrite_parquet(spark.read.parquet(path).filter("id > 2"), path)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_interrupted_rewrite_is_put_back(spark, tmp_path):
    path = tmp_path / "t.parquet"
    spark.range(5).write.parquet(str(path))
    path.rename(tmp_path / "t.parquet.abc.old")  # as if the program had ended between the renames
    assert tables.read_parquet(spark, path).count() == 5 and path.exists()
    tables.rewrite_parquet(spark.range(3).toDF("id"), path)
    assert tables.read_parquet(spark, path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    assert not tables.recover_rewrite(spark, tmp_path / "other.parquet")
    with pytest.raises(FileExistsError):
        tables.write_parquet(spark.range(1).toDF("id"), f"file://{path}")
    with pytest.raises(ValueError):
        tables.write_parquet(spark.range(1).toDF("id"), path, True, [f"file://{path}"])


def test_text_is_coerced(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("inf",), (None,), ("-2",)], "a string")
    assert [r.a for r in tables.as_numbers(df, ["a"]).collect()] == [1.5, None, None, None, None, -2.0]


def test_commands(spark, tmp_path, capsys):
    n = 40
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)
    tx = [(i % 4, day(i), float(i), "paid" if i % 3 else None, 100 + i % 2) for i in range(n)]
    spark.createDataFrame(tx, "merchant_id long, created_at timestamp_ntz, amount double, status string, card_token_id long").coalesce(1).write.parquet(f"{tmp_path}/tx.parquet")
    spark.createDataFrame([(i % 4, day(i), i % 2, "train" if i < 30 else "test") for i in range(n)], "merchant_id long, event_timestamp timestamp_ntz, label int, split string").write.parquet(f"{tmp_path}/ev.parquet")
    spark.createDataFrame([(100, "visa")], "id long, card_brand string").write.parquet(f"{tmp_path}/cards.parquet")
    out = f"{tmp_path}/out"
    assert cli.run(spark, ["preprocess", "--transactions", f"{tmp_path}/tx.parquet", "--dataset", f"{tmp_path}/ev.parquet", "--cards", f"{tmp_path}/cards.parquet", "--output", out]) == 0
    assert json.load(open(f"{out}/mapping.json"))["status"] == {"0": 0, "paid": 1}
    assert cli.run(spark, ["validate", "transactions-sorted", "--input", f"{tmp_path}/tx.parquet"]) == 1
    assert "First violation at row 5:" in capsys.readouterr().out
    assert cli.run(spark, ["validate", "column-lengths", "--input", f"{out}/transactions.parquet", "--columns", f"{out}/columns"]) == 0
    capsys.readouterr()
    cli.run(spark, ["validate", "nulls-transactions", "--transactions", f"{tmp_path}/tx.parquet", "--transformed", f"{out}/transactions.parquet"])
    text = capsys.readouterr().out.splitlines()
    assert text[0].startswith("column\toriginal_rows") and "status\t40\t14\t35.000000%\t40\t0\t0.000000%" in text
    assert "card_brand\tN/A\tN/A\tN/A\t40\t0\t0.000000%" in text
    args = ["--input", out, "--output", f"{tmp_path}/runs", "--catalog", f"{tmp_path}/catalog"]
    assert cli.run(spark, ["search", *args, "--strategy", "enumerative", "--size", "4", "--generations", "1"]) == 0
    run_id = capsys.readouterr().out.strip().splitlines()[-1]
    assert cli.run(spark, ["report", "--output", f"{tmp_path}/runs", "--run", run_id]) == 0
    assert cli.run(spark, ["analyze", *args, "--run", run_id, "--trees", "3"]) == 0
    with pytest.raises(ValueError, match="complete"):  # its analysis is done
        cli.run(spark, ["analyze", *args, "--run", run_id, "--trees", "3"])
    assert cli.run(spark, ["report", "--output", f"{tmp_path}/runs", "--run", run_id, "--catalog", f"{tmp_path}/catalog"]) == 0
    assert (tmp_path / "runs" / run_id / "evaluation" / "metrics.json").exists() and (tmp_path / "runs" / run_id / "snapshots").exists()
    assert cli.run(spark, ["search", *args, "--strategy", "enumerative_without_archive", "--size", "3", "--cache", f"{tmp_path}/cache"]) == 0
    capsys.readouterr()
    cli.run(spark, ["runs", "--catalog", f"{tmp_path}/catalog"])
    assert f"{run_id}\tenumerative\tcomplete\t42" in capsys.readouterr().out
