import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence, objects, quality, trajectory
from palimpsest.operators.evidence import Scan
from palimpsest.plans import timetravel
from palimpsest.sources import sinks, tables
from palimpsest.streaming import incremental, object_state


def test_changes_and_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("node_id,merged_id,first_absent,last_absent,first_persistent,last_persistent\n1,0,5,0,0,9\n")
    assert tuple(tables.read_changes(spark, str(tmp_path / "c.csv")).first()) == (1, None, 5, None, None, 9)
    (tmp_path / "d.csv").write_text("node,merged_id,first_absent,last_absent,first_persistent,last_persistent\n1,0,5,0,0,9\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_changes(spark, str(tmp_path / "d.csv")).collect()
    (tmp_path / "k.json").write_text(json.dumps({"entities": [{"physical_instance_id": 7, "semantic_id": 3, "name": "x"}]}))
    assert tuple(tables.read_catalog(spark, str(tmp_path / "k.json")).first()) == (7, 3, "x")
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "objects": [{"object_id": 4, "semantic_label": 2, "bbox_center": [1, 2, 3]}]}))
    row = tables.read_memory(spark, str(tmp_path / "m.json")).first()
    assert (row.object_id, row.stationarity_alpha, row.stationarity_beta) == (4, 2.0, 1.0)
    (tmp_path / "p.txt").write_text(" ".join(map(str, [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1])))
    pose = tables.read_pose(spark, str(tmp_path / "p.txt")).first().pose
    assert pose[3] == 5 and len(pose) == 16


def test_sinks_keep_their_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    sinks.append_csv(df, str(tmp_path / "t"))
    sinks.append_csv(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.append_csv(df.withColumnRenamed("v", "w"), str(tmp_path / "t"))
    broken = quality.gates(df, {"never": F.lit(False)})
    with pytest.raises(ValueError, match="never"):
        sinks.publish(df, str(tmp_path / "p"), broken)
    sinks.publish(df, str(tmp_path / "p"), quality.gates(df, {"always": F.lit(True)}))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(FileExistsError):
        sinks.publish(df, str(tmp_path / "p"))


def test_scratch_tables_can_be_cleared(spark):
    from pathlib import Path

    from palimpsest.plans import scratch

    scratch.clear(spark)
    path = scratch.scratch(spark, "t")
    spark.range(3).write.parquet(path)
    assert Path(path.removeprefix("file://")).exists()
    assert scratch.clear(spark) == 1 and not Path(path.removeprefix("file://")).exists()


def test_ply_and_intrinsics(spark, tmp_path):
    import numpy as np

    from palimpsest.sources import ply

    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty double z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "1 2 3 255\n4 5 6 0\n3 0 1 1\n")
    body = np.array([(1, 2, 3, 255), (4, 5, 6, 0)], np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f8"), ("red", "u1")])).tobytes()
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + body + b"\x03\0\0\0\0")
    got = ply.read_points(spark, str(tmp_path / "*.ply")).collect()
    assert sorted((r.vid, r.x, r.y, r.z) for r in got) == [(0, 1, 2, 3)] * 2 + [(1, 4, 5, 6)] * 2
    out = ply.ascii_ply(spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "vid long, x double, y double, z double"), 1).orderBy("ord")
    assert [r.value for r in out.collect()][-2:] == ["end_header", "1.0 2.0 3.0"]
    (tmp_path / "i.txt").write_text("Res_x: 960\nf_x: 481.5\n")
    assert ply.read_intrinsics(spark, str(tmp_path / "i.txt")).first()["values"] == {"Res_x": 960.0, "f_x": 481.5}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_binary_clouds_of_any_number_of_partitions(spark, tmp_path, parts):
    from palimpsest.sources import ply

    path, r = str(tmp_path / "cloud.ply"), random.Random(parts)
    rows = [(3 * k, r.random(), -r.random(), None if k == 5 else float(k), k % 7) for k in range(500)]
    cloud = spark.createDataFrame(r.sample(rows, len(rows)), "vid long, x double, y double, z double, c int").withColumn("x", F.col("x").cast("float")).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert ply.write_binary(cloud, path, columns=["x", "y", "z", "c"]) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [p.name for p in tmp_path.iterdir()] == ["cloud.ply"]
    raw = ply.vertices((tmp_path / "cloud.ply").read_bytes())
    assert raw["c"].tolist() == [k % 7 for k in range(500)]
    got = sorted((x.vid, x.y, x.z) for x in ply.read_points(spark, path).collect())
    assert [(a, b) for a, b, _ in got] == [(k, v[2]) for k, v in enumerate(rows)] and got[5][2] != got[5][2] and got[6][2] == 6.0
    with pytest.raises(FileExistsError):
        ply.write_binary(cloud, path)
    assert ply.write_binary(cloud.limit(0), path + "2") == 0 and len(ply.vertices((tmp_path / "cloud.ply2").read_bytes())["x"]) == 0
    with pytest.raises(Exception, match="is null"):
        ply.write_binary(cloud.withColumn("c", F.lit(None).cast("int")), path + "3", columns=["x", "c"])


def test_manifest_does_not_depend_on_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 7 % 13).alias("v"))
    a, b = (sinks.manifest(x, ["v"]).first() for x in (df, df.orderBy(F.rand(3)).repartition(7)))
    assert a == b and a.digest != sinks.manifest(df.withColumn("v", F.col("v") + 1), ["v"]).first().digest


def test_incremental_equals_fresh(spark):
    r = random.Random(9)
    data = [(k, r.randint(0, 300), r.choice(["present", "present", "absent", "inconclusive"])) for k in range(15) for _ in range(20)]
    rule = Scan(20, 2, 0.4, 0.5)
    state = incremental.ChangeState(["k"], "t", "v", rule)
    for epoch, start in enumerate(range(0, len(data), 90)):
        state.update(spark.createDataFrame(data[start : start + 90], "k long, t long, v string"), epoch)
        fresh = evidence.scan(spark.createDataFrame(data[: start + 90], "k long, t long, v string"), ["k"], "t", "v", rule)
        assert {tuple(x) for x in state.result.collect()} == {tuple(x) for x in fresh.collect()}
    before = {tuple(x) for x in state.result.collect()}
    state.update(spark.createDataFrame(data[:90], "k long, t long, v string"), 0)  # an epoch again
    assert {tuple(x) for x in state.result.collect()} == before


def test_object_state_stream_equals_batch(spark, tmp_path):
    r = random.Random(11)
    data = sorted((t, k, r.uniform(0, 4)) for k in range(6) for t in r.sample(range(1000), 40))
    for n, start in enumerate(range(0, len(data), 80)):
        spark.createDataFrame([(k, t, x, 0.0, 0.0) for t, k, x in data[start : start + 80]], "key long, ts long, x double, y double, z double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    source = spark.readStream.schema("key long, ts long, x double, y double, z double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    seen = {}

    def keep(batch, epoch):
        for x in batch.collect():
            if seen.get((x.key, x.fragment), (None, -1, None, 0))[3] <= x.n:
                seen[x.key, x.fragment] = (x.birth, x.last_support, x.death, x.n)

    q = object_state.fragments(source, 1.5).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = objects.fragments(spark.createDataFrame([(k, t, x) for t, k, x in data], "key long, ts long, x double"), "key", "ts", ["x"], 1.5)
    assert {k: v[:2] + v[3:] for k, v in seen.items()} == {(x.key, x.fragment): (x.birth, x.last_support, x.n) for x in want.collect()}


def test_throttle_and_densify(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in (0, 1, 3, 4, 9)], "k long, t long, v double")
    assert sorted(x.t for x in trajectory.throttle(df, "k", "t", 3).collect()) == [0, 3, 9]
    got = {x.t: x.v for x in trajectory.densify(df, "k", "t", ["v"], 1).collect()}
    assert got == {t: float(t) for t in range(10)}


def test_timeline(spark):
    line = spark.createDataFrame([(10, "a"), (20, "b")], "stamp long, v string")
    times = spark.createDataFrame([(5,), (10,), (11,), (99,)], "t long")
    pick = lambda **k: {x.t: x.stamp for x in timetravel.snapshot_stamp(line, times, "stamp", "t", **k).collect()}
    assert pick() == {5: 10, 10: 10, 11: 20, 99: 20}
    assert pick(later=False) == {5: 10, 10: 10, 11: 10, 99: 20}
    new = timetravel.append_snapshot(line, spark.createDataFrame([(20, "c")], "stamp long, v string"), "stamp")
    assert {tuple(x) for x in new.collect()} == {(10, "a"), (20, "c")}
    with pytest.raises(ValueError):
        timetravel.append_snapshot(line, spark.createDataFrame([(15, "c")], "stamp long, v string"), "stamp")


def test_override_rejects_unknown_keys(spark):
    df = spark.createDataFrame([(0, 5), (1, 5)], "k long, v int")
    catalog = spark.createDataFrame([(1, 9)], "k long, v int")
    assert sorted(x.v for x in quality.override(df, catalog, "k", "v").collect()) == [5, 9]
    with pytest.raises(Exception, match="catalog"):
        quality.override(df, catalog.limit(0), "k", "v").collect()
