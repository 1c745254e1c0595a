"""File sources and sinks as round trips; streams against their batch twins."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdigris.operators import timeline
from verdigris.sources import files
from verdigris.streaming import events as ev


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{broken\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path), "a int").collect()


def test_json_array_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert files.json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    (tmp_path / "m.csv").write_bytes("﻿id,name\n1,Đơn\n".encode())
    df = files.csv(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["id", "name"] and df.first().name == "Đơn"
    files.write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "out"))
    assert files.csv(spark, str(tmp_path / "out")).first().a == "'=1+1"


def test_text_files_and_magic(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("Điều 1".encode())
    (tmp_path / "v.txt").write_bytes("Ði".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text) for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got["u.txt"] == ("UTF-8", "Điều 1") and got["v.txt"][0] != "UTF-8"
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.x for r in raw.select(files.verified(raw).alias("x")).collect()} == {"too_small"}


def test_html(spark):
    page = '<html><p>Một</p><p>Một</p><div>Hai &amp; ba</div><script>x</script><a href="/v?ItemID=7&x=1"><b>Luật</b></a><a href="?ItemID=7">Khác</a></html>'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert [r.line for r in files.html_lines(df, "id", "html").orderBy("pos").collect()] == ["Một", "Hai & ba", "LuậtKhác"]
    assert [(r.item_id, r.title) for r in files.mined_links(df, "html").collect()] == [("7", "Luật")]


def test_versions_and_checksum(spark, tmp_path):
    a, b = spark.range(5), spark.range(7)
    files.publish(a, str(tmp_path / "t"), "1")
    files.publish(b, str(tmp_path / "t"), "2")
    assert files.published(spark, str(tmp_path / "t")).count() == 7
    assert files.checksum(b) == files.checksum(b.orderBy(F.desc("id"))) != files.checksum(a)


@pytest.fixture()
def stream_folder(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    for part in range(3):
        rows = [(part * 20 + i, t0 + timedelta(minutes=part * 400 + i * 17), i % 3, "k" if i % 2 else "j", str(i)) for i in range(20)]
        rows += rows[:2]
        spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, fact string, said string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), tmp_path


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_windows_match_batch(spark, stream_folder):
    folder, tmp = stream_folder
    batch = spark.read.parquet(folder)
    out = run(ev.windowed(ev.read_stream(spark, folder, batch.schema), "ts", "1 hour", ["user_id"]), "w1", tmp, "complete")
    want = timeline.tumbling(batch.withColumn("v", F.lit(1)), "ts", "1 hour", ["user_id"], "v")
    assert sorted((r.start, r.user_id, r.n) for r in out.collect()) == sorted((r.start, r.user_id, r.n) for r in want.collect())


def test_dedup_and_state(spark, stream_folder):
    folder, tmp = stream_folder
    schema = spark.read.parquet(folder).schema
    assert run(ev.deduplicated(ev.read_stream(spark, folder, schema), "ts", ["event_id"], "7 days"), "d1", tmp).count() == 60
    out = run(ev.running_facts(ev.read_stream(spark, folder, schema), "user_id", "fact", "said"), "f1", tmp, "update")
    assert {k for r in out.collect() for k in r.facts} == {"k", "j"}


def test_upsert_sink(spark, stream_folder):
    folder, tmp = stream_folder
    schema = spark.read.parquet(folder).schema
    path = str(tmp / "table")
    q = ev.read_stream(spark, folder, schema).writeStream.foreachBatch(ev.upsert_sink(path, ["user_id"], ["ts", "event_id"])).option("checkpointLocation", str(tmp / "cp_u")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.event_id for r in ev.current(spark, path).collect()}
    want = {r.user_id: r.e for r in spark.read.parquet(folder).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
