import json

import pytest
from pyspark.sql import functions as F

from medloom.sources import readers, schemas, writers


def test_schemas(spark):
    for name in schemas.names():
        assert schemas.empty(spark, name).count() == 0
    df = spark.createDataFrame([("p", "08:00"), ("p", "08:00")], "plan_id string, time string")
    assert schemas.duplicates(df, "prescription_plan_slots").count() == 1


def test_catalogues(spark, tmp_path):
    drugs = [{"soDangKy": "1", "tenThuoc": "Cozaar", "hoatChat": [{"tenHoatChat": "Losartan", "nongDo": "50mg"}, {"tenHoatChat": "cozaar"}]}, {"tenThuoc": None, "hoatChat": None}]
    (tmp_path / "a.json").write_text(json.dumps({"drugs": drugs}))
    (tmp_path / "b.json").write_text(json.dumps(drugs))
    (tmp_path / "c.csv").write_text("brand_name,generic_name,dosage,category\ntanakan,ginkgo biloba,40mg,x\n,no brand,1mg,y\n")
    for name in ("a", "b"):
        assert sorted(r.search_key for r in readers.catalogue(spark, str(tmp_path / f"{name}.json"), "").collect()) == ["cozaar", "losartan"]
    assert sorted(r.search_key for r in readers.catalogue(spark, "missing.json", str(tmp_path / "c.csv")).collect()) == ["ginkgo biloba", "tanakan"]


def test_small_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"A": {"id": 1}, "B": {"id": 2}}))
    assert readers.map_of_objects(spark, str(tmp_path / "m.json"), "struct<id:int>").count() == 2
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "p1.json").write_text(json.dumps([{"text": "1) Para", "label": "drugname", "box": [1, 2, 3, 4]}]))
    assert readers.label_pages(spark, str(tmp_path / "l")).first().page == "p1"
    (tmp_path / "s.xml").write_text("<loc> a </loc><loc>b</loc>")
    assert [r.url for r in readers.site_map(spark, str(tmp_path / "s.xml")).collect()] == ["a", "b"]
    (tmp_path / "q.json").write_text('{"occurrence_id":"o","queued_at":"1"}\n{bad\n{"occurrence_id":" "}\n')
    assert readers.offline_queue(spark, str(tmp_path / "q.json")).count() == 1
    (tmp_path / "i" / "red").mkdir(parents=True)
    (tmp_path / "i" / "a.png").write_bytes(b"x")
    (tmp_path / "i" / "red" / "b.jpg").write_bytes(b"y")
    assert [r.label for r in readers.images(spark, str(tmp_path / "i")).collect()] == ["a", "red"]


def test_paged_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"n": n}, {"n": n * 10}]))
    spark.dataSource.register(readers.PagedSource)
    rows = spark.read.format("paged").option("path", str(tmp_path)).option("pages", "2").load().orderBy("page", "ordinal").collect()
    assert [(r.page, r.ordinal, json.loads(r.row)["n"]) for r in rows] == [(1, 0, 1), (1, 1, 10), (2, 0, 2), (2, 1, 20)]
    landed = spark.read.format("paged").option("path", str(tmp_path)).option("pages", "2").load()
    assert readers.pages_done(landed) == "1,2"
    rest = spark.read.format("paged").option("path", str(tmp_path)).option("pages", "2").option("done", "1").load()
    assert [r.page for r in rest.select("page").distinct().collect()] == [2]
    named = spark.read.format("paged").option("path", "x").option("pages", "1").option("fetch", "operator:concat_page").load()
    with pytest.raises(Exception, match="concat_page"):
        named.collect()
    with pytest.raises(Exception, match="3.json"):  # a missing page is an error, not an empty one
        spark.read.format("paged").option("path", str(tmp_path)).option("pages", "3").option("pause", "0.01").load().collect()


def test_lookups_and_pages(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"name":"a","at":"1","answer":{"n":1}}\n{"name":"a","at":"2","answer":{"n":2}}\n{"name":"b","answer":"broken"}\n{"x":1}\n')
    got = {r.name: r.answer.n if r.answer else None for r in readers.lookups(spark, str(tmp_path / "l.json"), "name", "struct<n:int>").collect()}
    assert got == {"a": 2, "b": None}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<title>T</title>\n<p>")
    row = readers.html_pages(spark, str(tmp_path / "p")).first()
    assert row.url.endswith("x.html") and row.html.startswith("<title>")


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("k", 1, "a")], "k string, n int, v string")
    two = spark.createDataFrame([("k", 2, "b"), ("l", 1, "c")], "k string, n int, v string")
    for change in (one, two, two, one):
        writers.upsert(spark, change, path, ["k"], "n")
    assert sorted(tuple(r) for r in writers.current(spark, path).collect()) == [("k", 2, "b"), ("l", 1, "c")]
    writers.replace_of_parents(spark, one, path, "k")
    assert sorted(r.v for r in writers.current(spark, path).collect()) == ["a", "c"]
    folder = str(tmp_path / "many")
    assert writers.current(spark, folder, "y") is None
    for tables in ({"x": one, "y": two}, {"x": two, "y": one}, {"x": one, "y": two}):
        writers.reload(spark, tables, folder)
    assert writers.current(spark, folder, "y").count() == 2 and writers.current(spark, folder, "x").count() == 1
    assert len([p for p in (tmp_path / "many").iterdir() if p.name.startswith("v-")]) == 2


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("k", 1)], "k string, n int")
    writers.swap(good, path)
    bad = good.withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        writers.reload(spark, {"data": bad}, path)
    assert [tuple(r) for r in writers.current(spark, path).collect()] == [("k", 1)]


def test_flags(spark):
    df = spark.createDataFrame([("1", "s", False), ("2", "s", True), ("3", "t", True)], "id string, reference_set_id string, confirmed_by_user boolean")
    flags = lambda d: [r.confirmed_by_user for r in d.orderBy("id").collect()]
    assert flags(writers.finalize(df, "s", ["1"])) == [True, False, True]
    assert flags(writers.finalize(df, "s")) == [True, True, True]
    cat = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("", 3, "z"), (None, 4, "w")], "soDangKy string, ordinal int, v string")
    assert sorted(r.v for r in writers.catalogue_rows(cat).collect()) == ["w", "y", "z"]
    assert writers.with_ttl(df, "2026-01-01", 7).select(F.datediff("expires_at", "cached_at")).first()[0] == 7
