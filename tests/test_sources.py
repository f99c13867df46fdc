"""Readers, sinks, provenance and the incremental refresh on real files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from zonemill.operators import geometry as GE
from zonemill.operators import quality as QU
from zonemill.model import Grid
from zonemill.session import checkpointed
from zonemill.sources import provenance as PR
from zonemill.sources import readers as RD
from zonemill.sources import sinks as SK
from zonemill.streaming.refresh import refresh_stats


def feature(i, kind="Polygon"):
    ring = [[0, 0], [i, 0], [i, i], [0, i], [0, 0]]
    return {"type": "Feature", "properties": {"CD_sector": str(i), "name": f"n{i}"}, "geometry": {"type": kind, "coordinates": [ring] if kind == "Polygon" else [[ring]]}}


def test_feature_readers(spark, tmp_path):
    lines = tmp_path / "lines.geojson"
    lines.write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(json.dumps(feature(i, "MultiPolygon" if i % 2 else "Polygon")) for i in range(1, 6)) + "\n]}\n")
    wanted = spark.createDataFrame([("2",), ("5",)], "feature_id string")
    out = {r["feature_id"]: r for r in RD.read_features(spark, str(lines), "cd_sector", wanted).withColumn("a", GE.polygon_area(F.col("geom"))).collect()}
    assert {k: (v["kind"], v["a"]) for k, v in out.items()} == {"2": ("Polygon", 4.0), "5": ("MultiPolygon", 25.0)}
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i) for i in range(1, 4)]}, indent=1))
    assert {r["feature_id"] for r in RD.read_feature_collection(spark, str(whole), "CD_SECTOR").collect()} == {"1", "2", "3"}


def test_fiscal_and_catalogue(spark, tmp_path):
    (tmp_path / "f.txt").write_text("CD_YEAR|X|CD_SECTOR|MEDIAN\n2019|a|S1|100.5\n2019|a|S2|C\n2018|a|S1|5\n2020|a|S9|7\n")
    zones = spark.createDataFrame([("S1",), ("S2",)], "CD_SECTOR string")
    out = RD.read_fiscal(spark, str(tmp_path / "f.txt"), ["CD_YEAR", "X", "CD_SECTOR", "MEDIAN"], [2019, 2020], zones, "CD_YEAR", "CD_SECTOR").collect()
    assert {(r["CD_YEAR"], r["CD_SECTOR"], r["MEDIAN"]) for r in out} == {(2019, "S1", "100.5"), (2019, "S2", "C")}
    (tmp_path / "c.csv").write_bytes("\ufeffid;name\n1;TCD_S2018_R10m_E39\n2;TCD_S2021_R10m_E39\n3;TCD_S2018_R10m_E39\n4;other\n".encode())
    got = {r["catalogue_year"]: r["id"] for r in RD.read_catalogue(spark, str(tmp_path / "c.csv"), ["id", "name"], r"TCD_S(20\d{2})_R10m").collect()}
    assert got == {2018: "3", 2021: "2"}


def test_observation_files(spark, tmp_path):
    for day in ("2023-06-24", "2023-07-04"):
        spark.createDataFrame([(0, 0, .5)], "row_i int, col_i int, ndvi double").coalesce(1).write.parquet(str(tmp_path / day))
        part = next((tmp_path / day).glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"ndvi-{day}-10m.parquet").write_bytes(part.read_bytes())
    px = RD.read_observations(spark, str(tmp_path / "all"), "row_i int, col_i int, ndvi double")
    assert {r["obs_date"] for r in px.collect()} == {dt.date(2023, 6, 24), dt.date(2023, 7, 4)}
    files = RD.list_files(spark, str(tmp_path / "all"), "*.parquet").select("path", "length")
    sidecars = files.where("path LIKE '%06-24%'").select("path", F.lit(1.5).alias("cloud"))
    selection = spark.createDataFrame([(2023, dt.date(2023, 6, 24))], "year int, selected_date date")
    every = RD.observation_inventory(files, sidecars, selection, selected_only=False).collect()
    assert [r["date"].day for r in every] == [24, 4] and [r["selected"] for r in every] == [True, False] and every[1]["cloud"] is None
    assert RD.observation_inventory(files, sidecars, selection).count() == 1


def test_statistics_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "stats")
    def stats(rows):
        return spark.createDataFrame(rows, "dataset string, year int, sector_id string, area double")
    SK.write_stats(stats([("a", 2019, "S", 1.0), ("a", 2020, "S", 2.0)]), path)
    SK.write_stats(stats([("a", 2020, "S", 3.0)]), path)
    assert {(r["year"], r["area"]) for r in spark.read.parquet(path).collect()} == {(2019, 1.0), (2020, 3.0)}
    stored = spark.read.parquet(path).groupBy("dataset", "year").agg(F.count("*").alias("n_records")).withColumn("source_hash", F.lit("h"))
    wanted = spark.createDataFrame([("a", 2019, "h", 1), ("a", 2020, "new", 1), ("a", 2021, "h", 1), ("a", 2019, "h", 2)], "dataset string, year int, source_hash string, n_expected long")
    assert {(r["year"], r["n_expected"]) for r in PR.pending_partitions(wanted, stored).collect()} == {(2020, 1), (2021, 1), (2019, 2)}


def test_feature_sink(spark, tmp_path):
    from zonemill.model import MULTIPOLYGON
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    df = spark.createDataFrame([(1, float("nan"), " ", "secret", [[ring]]), (2, 12.5, "x", "secret", [[ring]])], "id int, v double, label string, owner string, geom " + MULTIPOLYGON.simpleString())
    assert SK.write_features(df, str(tmp_path / "f"), "id", ["v", "label"]) == 2
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert {d["id"]: d["properties"] for d in docs} == {"1": {}, "2": {"v": 12.5, "label": "x"}}


def test_manifest_and_index(spark):
    df = spark.createDataFrame([("d", "b", 1.0), ("d", "a", float("inf"))], "dataset string, sector_id string, area double")
    doc = json.loads(SK.to_manifest(df, ["dataset"], "sector_id", ["area"]).collect()[0]["manifest"])
    assert doc == {"a": {}, "b": {"area": 1.0}} and list(doc) == ["a", "b"]
    index = SK.dataset_index([spark.createDataFrame([("a", 1)], "id string, year int"), spark.createDataFrame([("b", "yes")], "id string, density string")], ["id", "year", "density"])
    assert {tuple(r) for r in index.collect()} == {("a", 1, None), ("b", None, "yes")}


def test_pins_and_budgets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"other")
    hashed = PR.read_hashed(spark, str(tmp_path))
    pins = spark.createDataFrame([(3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), (9, "x")], "n_bytes long, sha256 string")
    assert [r["path"].rsplit("/", 1)[1] for r in PR.check_pins(hashed, pins).collect()] == ["b.bin"]
    files = RD.list_files(spark, str(tmp_path)).withColumn("grp", F.lit("all"))
    assert PR.over_budget(files, "grp", {"all": 7}).collect()[0]["n_bytes"] == 8 and PR.over_budget(files, "grp", {}, 8).count() == 0


def test_quality_contracts(spark):
    good = Grid(0, 10, 1, -1, 5, 5, "EPSG:32631")
    assert QU.grid_violations(good, good, ["a", "b"], ["a"]) == []
    assert QU.grid_violations(Grid(0, 10, 2, -2, 5, 4, "EPSG:3035"), good, ["a"], ["b"]) == ["crs", "cell", "shape", "bands"]
    bad = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(QU.ContractError, match="broken"):
        QU.require(bad, "broken")
    QU.require(bad.where("k > 1"), "fine")


def test_checkpoint_cuts_the_lineage(spark):
    df = checkpointed(spark.range(10).withColumn("v", F.col("id") * 2))
    assert df.count() == 10 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_incremental_refresh(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    schema = "sector_id string, code int, dataset string, year int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").partitionBy("dataset", "year").parquet(source)

    computed = []

    def compute(px):
        computed.append(sorted((r["dataset"], r["year"]) for r in px.select("dataset", "year").distinct().collect()))
        return px.groupBy("dataset", "year", "sector_id").agg(F.count("*").alias("n"))

    arrive([("S", 1, "a", 2019), ("S", 1, "a", 2020)])
    refresh_stats(spark, source, schema, target, checkpoint, compute).awaitTermination()
    arrive([("S", 2, "a", 2020), ("T", 2, "b", 2020)])
    refresh_stats(spark, source, schema, target, checkpoint, compute).awaitTermination()
    refresh_stats(spark, source, schema, target, checkpoint, compute).awaitTermination()
    assert computed == [[("a", 2019), ("a", 2020)], [("a", 2020), ("b", 2020)]]
    got = {(r["dataset"], r["year"], r["sector_id"]): r["n"] for r in spark.read.parquet(target).collect()}
    assert got == {("a", 2019, "S"): 1, ("a", 2020, "S"): 2, ("b", 2020, "T"): 1}


def test_large_manifest_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(200_000).select(F.lit("a").alias("k"), F.col("id"), (F.col("id") % 7).alias("n"), F.concat(F.lit('q"{},'), F.col("id")).alias("s"))
    rows = rows.unionByName(spark.createDataFrame([("b", 5, 1, "x")], "k string, id long, n long, s string"))
    SK.write_manifests(rows, ["k"], "id", ["n", "s"], f"{tmp_path}/m", parts=4)
    files = sorted(p for p in (tmp_path / "m" / "k=a").iterdir() if p.suffix == ".txt")
    assert len(files) >= 3 and max(p.stat().st_size for p in files) < 0.5 * sum(p.stat().st_size for p in files)
    document = json.loads("".join(p.read_text() for p in files))
    assert list(document) == sorted(map(str, range(200_000))) and document["77777"] == {"n": 77777 % 7, "s": 'q"{},77777'}
    assert json.loads("".join(p.read_text() for p in (tmp_path / "m" / "k=b").iterdir() if p.suffix == ".txt")) == {"5": {"n": 1, "s": "x"}}
    back = SK.read_manifests(spark, f"{tmp_path}/m", "bigint", "struct<n: bigint, s: string>").select("k", "id", "record.*")
    assert back.exceptAll(rows).count() == 0 and back.count() == 200_001
