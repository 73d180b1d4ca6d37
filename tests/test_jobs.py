"""The jobs on small input: what they write, reruns, growing input, and their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, product_catalogue, scene_plumes

ROOT = Path(__file__).parents[1]
SF = "/root/testdata/sf0.001"


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def pages(spark):
    rad, obs = "/d/EMIT_L1B_RAD_001.nc", "/d/EMIT_L1B_OBS_001.nc"
    rows = [
        (1, "https://A.org/list/index.html?utm=1", f'<a href="{rad}">x</a><a  class="k" href="../x.nc#top">y</a><a href="{obs}?v=2">z</a><a href="{obs}">z</a>'),
        (2, "http://a.org/list/index.html", '<a href="mailto:me@a.org">m</a><a href="#top">t</a><a href="?page=2">p</a><a href="">e</a><a href="javascript:x()">j</a><A href="/UP">no</A>'),
        (3, "http://b.org", '<a href="//a.org/d/EMIT_L1B_RAD_002.nc">other</a><a href="HTTP://B.ORG/">self</a><link href="/style.css">'),
        (3, "http://b.org", '<a href="//a.org/d/EMIT_L1B_RAD_002.nc">other</a>'),
        (4, "no address", '<a href="/lost">x</a>'),
        (5, None, '<a href="http://a.org/lost">x</a>'),
        (None, "http://c.org/p", None),
        (6, "http://c.org/p", ""),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("x"))


def test_catalogue_of_pages(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "out")
    pages(spark).write.parquet(source)
    product_catalogue.run(spark, source, out)
    got = {(r.host, r.path): r for r in product_catalogue.read(spark, out).collect()}
    assert set(got) == {("a.org", p) for p in ("/list/index.html", "/d/EMIT_L1B_RAD_001.nc", "/d/EMIT_L1B_OBS_001.nc", "/d/EMIT_L1B_RAD_002.nc", "/list/../x.nc")} | {("b.org", "/"), ("c.org", "/p")}
    rad, obs, alone = (got["a.org", f"/d/EMIT_L1B_{k}.nc"] for k in ("RAD_001", "OBS_001", "RAD_002"))
    assert (rad.name, rad.kind, rad.partner, rad.paired) == ("EMIT_L1B_RAD_001", "radiance", obs.path, True)
    assert (obs.kind, obs.partner, obs.paired, obs.n_links, obs.n_pages) == ("observation", rad.path, True, 2, 1)
    assert (alone.paired, alone.n_links, alone.n_pages, alone.first_page, alone.last_page) == (False, 2, 1, 3, 3)
    index, plain = got["a.org", "/list/index.html"], got["c.org", "/p"]
    assert (index.n_listed, index.n_links, index.kind, index.partner) == (2, 0, "other", None)
    assert (plain.n_listed, plain.first_page, plain.last_page) == (2, 6, 6)
    before = sorted(product_catalogue.read(spark, out).collect())
    product_catalogue.run(spark, source, out)
    assert sorted(product_catalogue.read(spark, out).collect()) == before
    product_catalogue.run(spark, source, out, {**common.settings("product_catalogue"), "shards": 1, "splits": 1})
    assert sorted(product_catalogue.read(spark, out).drop("shard").collect()) == sorted(spark.createDataFrame(before).drop("shard").collect())
    assert len(list(Path(out).glob("shard=*"))) == 1


def test_catalogue_of_no_pages(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "out")
    spark.createDataFrame([], pages(spark).schema).write.parquet(source)
    product_catalogue.run(spark, source, out)
    assert product_catalogue.read(spark, out).count() == 0


#: Scenes of 10 x 10 pixels, two a swath.
SMALL = {"width": 10, "height": 10, "scenes_a_swath": 2, "threshold": 400, "least": 2, "files_a_batch": 2}


@pytest.fixture
def readings(spark):
    return spark.read.parquet(f"{SF}/events.parquet").drop("props").filter("event_id < 1000").cache()


def plumes_of(spark, folder):
    return sorted(map(str, scene_plumes.read(spark, f"{folder}/out").collect()))


def test_only_new_readings_are_taken(spark, tmp_path, readings):
    source, one, two = str(tmp_path / "in"), tmp_path / "one", tmp_path / "two"
    early, late = readings.filter("event_id < 560 AND event_id % 7 > 0"), readings.filter("event_id >= 560")
    early.repartition(5).write.parquet(source)
    work = lambda at: scene_plumes.run(spark, source, f"{at}/out", f"{at}/checkpoint", SMALL)
    work(one)
    first = files_of(one / "out")
    assert {p.split("/")[1] for p in first if p.startswith("plumes")} == {"swath=0", "swath=1", "swath=2"}
    assert len({p.split("/")[2] for p in first if p.startswith("pixels")}) == 3  # 5 files, 2 a batch
    assert scene_plumes.read(spark, f"{one}/out").filter("label = 0").agg(F.sum("n_pixels")).first()[0] == early.count()
    work(one)
    assert files_of(one / "out") == first
    # new scenes, and a later reading of a pixel of swath 0, which ends a plume or begins one
    again = readings.filter("event_id = 12").withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "event_type": F.lit("error"), "value": F.lit(7.0)})
    late.unionByName(again).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(None, None, None, None, None)], readings.schema).coalesce(1).write.mode("append").parquet(source)
    work(one)
    after = files_of(one / "out")
    same = [p for p in first if p in after and after[p] == first[p]]
    assert [p for p in first if p.startswith("pixels")] == [p for p in same if p.startswith("pixels")]
    assert {p.split("/")[1] for p in same if p.startswith("plumes")} == {"swath=1"}  # untouched by what came
    work(two)
    assert plumes_of(spark, one) == plumes_of(spark, two)
    cell = scene_plumes.read(spark, f"{one}/out").filter("granule_id = 0 AND label = 0").first()
    assert cell.n_pixels == early.filter("event_id < 100").count() and cell.swath == 0


def test_batches_that_are_run_again_change_nothing(spark, tmp_path, readings):
    source = str(tmp_path / "in")
    readings.repartition(3).write.parquet(source)
    scene_plumes.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/c1", SMALL)
    before = plumes_of(spark, tmp_path)
    scene_plumes.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/c2", SMALL)  # as if nothing were known
    assert plumes_of(spark, tmp_path) == before
    assert scene_plumes.read(spark, f"{tmp_path}/out").filter("label = 0").agg(F.sum("n_pixels")).first()[0] == readings.count()


def test_plumes_that_have_gone_leave_the_table(spark, tmp_path, readings):
    source = str(tmp_path / "in")
    readings.filter("event_id < 200").coalesce(1).write.parquet(source)
    work = lambda: scene_plumes.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/c", SMALL)
    work()
    assert scene_plumes.read(spark, f"{tmp_path}/out").filter("label > 0").count() > 0
    readings.filter("event_id < 200").withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "event_type": F.lit("error")}).coalesce(1).write.mode("append").parquet(source)
    work()
    assert scene_plumes.read(spark, f"{tmp_path}/out").groupBy("label").count().collect() == [(0, 2)]


def test_command_lines(spark, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"shards": 2}))
    env = {**os.environ, "PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path)}
    (tmp_path / "spark-defaults.conf").write_text(f"spark.master local[2]\nspark.checkpoint.dir {tmp_path}/shared\nspark.ui.enabled false\n")
    runs = [["jobs.product_catalogue", "--pages", f"{SF}/pages.parquet", "--out", f"{tmp_path}/a", "--config", str(config)], ["jobs.scene_plumes", "--readings", f"{SF}/events.parquet", "--out", f"{tmp_path}/b", "--checkpoint", f"{tmp_path}/c"]]
    for args in runs:
        done = subprocess.run([sys.executable, "-m", *args], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read" in done.stderr and "wrote" in done.stderr
    assert len(list((tmp_path / "a").glob("shard=*"))) == 2
    assert scene_plumes.read(spark, f"{tmp_path}/b").count() > 1


def test_unknown_settings_are_refused(spark, tmp_path):
    (tmp_path / "own.json").write_text('{"no such": 1}')
    with pytest.raises(ValueError, match="no such"):
        common.settings("scene_plumes", spark, str(tmp_path / "own.json"))


def test_registered_and_equal_to_their_sql(spark):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in ("events", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("job1_product_catalogue", "job2_scene_plumes"):
        got = __spark_entry__.queries()[name](spark, SF)
        names = sorted(got.columns)
        want = con.sql(__spark_entry__.oracle_sql()[name]).select(*[f'"{n}"' for n in names]).fetchall()
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))
