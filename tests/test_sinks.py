"""File sources and sinks: version registry, processed data sets, predictions."""

import pytest

from panelstack.sources import files


def test_version_registry_keeps_order_and_skips_duplicates(spark, tmp_path):
    root = str(tmp_path / "data")
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    for label in ("v1", "v2", "v1", "v3"):
        files.write_dataset(spark, root, label, df)
    names = [r.name for r in files.read_versions(spark, root).orderBy("seq").collect()]
    assert names == ["v1", "v2", "v3"]
    assert files.read_processed(spark, root, None, default="v2").count() == 1
    with pytest.raises(FileNotFoundError, match="v3"):
        files.read_processed(spark, root, "missing")


def test_version_label():
    assert files.version_label("pipeline", 100, 0.4, ["out=3vars"], include_date=False) == \
        "pipeline-min100-comp0.4-out=3vars"


def test_predictions_round_trip_by_run(spark, tmp_path):
    path = str(tmp_path / "preds")
    a = spark.createDataFrame([("m", "s", "r", 1, 2.0)], "model string, scenario string, region string, year int, p double")
    files.write_predictions(a, path, "run-a")
    files.write_predictions(a.withColumn("p", a.p * 2), path, "run-b")
    assert [r.p for r in files.load_predictions(spark, path, "run-b").collect()] == [4.0]


def test_read_dimension_trims_header_and_checks_columns(spark, tmp_path):
    path = str(tmp_path / "dim")
    spark.createDataFrame([("a", "C1")], "` scenario ` string, `scenario_category ` string") \
         .coalesce(1).write.option("header", True).csv(path)
    dim = files.read_dimension(spark, path, ["scenario", "scenario_category"])
    assert dim.columns == ["scenario", "scenario_category"]
    with pytest.raises(KeyError):
        files.read_dimension(spark, path, ["model"])


def test_raw_wide_builds_its_panel_once(spark, monkeypatch):
    from panelstack.sources import panels

    rows = [("m", "s", "World", v, "u", y, float(y)) for v in ("LARGE", "SMALL") for y in (1995, 1996, 1997)]
    made = spark.sparkContext.accumulator(0)

    def counted(part):
        for r in part:
            made.add(1)
            yield r

    long = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(counted),
                                 "model string, scenario string, region string, variable string, unit string, year int, value double")
    monkeypatch.setattr(panels, "panel_yearly", lambda *_: long)
    raw = panels.raw_wide_yearly(spark, "")
    assert raw.columns[5:] == ["1995", "1996", "1997"]
    assert [raw.count(), len(raw.collect()), raw.select("model").distinct().count()] == [2, 2, 1]
    assert made.value == len(rows)  # years, values and each reader take them from the stored panel
