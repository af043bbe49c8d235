import pytest

from tickflow.operators import labels, regimes
from tickflow.sources import files


def write_files(folder):
    for name, rows, base in (("ft_2020-06-01.csv", 4000, 0), ("ft_2020-06-02.csv", 3, 10000), ("other.csv", 5, 0)):
        (folder / name).write_text("date_trd,f_imp_c_0.8,n\n" + "".join(
            f"{name[3:13]},{'NaN' if i == 1 else i / 2},{base + i}\n" for i in range(rows)))


def test_scan_matches_names_and_numbers_rows_of_split_files(spark, tmp_path):
    write_files(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8kb")
    try:
        df = files.read_trades(spark, str(tmp_path), "ft_2020", "date_trd date, `f_imp_c_0.8` double, n long")
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4003
    assert all(r["trd_id"] == (r["n"] if r["n"] < 10000 else r["n"] - 10000) for r in rows)
    assert "f_imp_c_0p8" in df.columns
    assert sorted(r["n"] for r in rows if r["f_imp_c_0p8"] is None) == [1, 10001]     # NaN became NULL


def test_unnamed_index_is_dropped(spark, tmp_path):
    (tmp_path / "all.csv").write_text("Unnamed: 0,a\n0,5\n1,6\n")
    assert files.read_table_csv(spark, str(tmp_path / "all.csv")).columns == ["a"]


def test_regime_tables_and_append(spark, tmp_path):
    (tmp_path / "mup.csv").write_text("a,b\n1,2\n")
    (tmp_path / "mdown.csv").write_text("a\n3\n")
    out = files.read_regime_tables(spark, {"mup": str(tmp_path / "mup.csv"), "mdown": str(tmp_path / "mdown.csv")})
    assert sorted((r["model"], r["a"], r["b"]) for r in out.collect()) == [("mdown", 3, None), ("mup", 1, 2)]


def test_missing_stage_is_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="X_samples_ft_"):
        files.load_saved(spark, str(tmp_path), "X_samples_ft_")


def test_csv_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "result")
    one = spark.createDataFrame([(1, 0.5)], "a int, b double")
    files.write_csv(one, path)
    files.write_csv(one, path)
    assert files.read_table_csv(spark, path).count() == 1
    runs = str(tmp_path / "runs")
    for _ in range(3):
        files.write_csv(one, runs, "append", header=False)
    assert spark.read.csv(runs).count() == 3


def test_a_rewritten_source_is_read_again(spark, tmp_path):
    from tickflow.plans.ticks import ticks
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events.parquet")
    events.limit(100).write.parquet(path)
    first = ticks(spark, str(tmp_path)).count()
    events.limit(150).write.mode("overwrite").parquet(path)
    assert (first, ticks(spark, str(tmp_path)).count()) == (100, 150)


def test_broadcast_is_decided_by_bytes_too(spark):
    from tickflow.runtime import sized, stored_bytes
    table = spark.range(1000)
    stored, small = sized(table)
    assert small and 0 < stored_bytes(stored) < 1 << 20
    assert not sized(table, max_bytes=10)[1] and not sized(table, max_rows=10)[1]
