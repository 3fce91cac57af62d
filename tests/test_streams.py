"""Streams against their batch forms, over shuffled files, after restarts, with late rows and with seeds."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import active_window as batch_window
from palimpsest.operators import frame_buffer as frames
from palimpsest.operators import objects
from palimpsest.operators.active_window import Rule
from palimpsest.streaming import active_window, frame_buffer, persistent_states
from palimpsest.streaming.epochs import EpochTable, LateRows

SIGHTS = "key long, ts timestamp, ord long, x double, y double, z double"
SECOND = 1_000_000


def _sights(n, seed):
    r = random.Random(seed)
    return [(r.randrange(4), r.randrange(600) * SECOND // 2, k, r.choice([0.0, 0.3, 5.0, 5.4, 9.0]), 0.0, 0.0) for k in range(n)]


def _brute(rows, rule, until):
    """One row after the other; tracks are lists of their rows."""
    out = []
    for key in sorted({r[0] for r in rows}):
        tracks = []
        for _, t, _, *p in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            live = [x for x in tracks if x[-1][0] >= t - rule.window and (rule.reach is None or x[-1][0] < t)]
            far = lambda x: abs(x[-1][1][0] - p[0])  # noqa: B023, E731
            near = min(live, key=lambda x: (far(x) if rule.reach else 0, tracks.index(x)), default=None)
            if near is None or (rule.reach is not None and far(near) > rule.reach):
                tracks.append([(t, p)])
            else:
                near.append((t, p))
        for k, x in enumerate(tracks):
            if x[-1][0] < until - rule.window:
                d = max(abs(q[0] - x[0][1][0]) for _, q in x)
                out.append((key, k, x[0][0], x[-1][0], len(x), min(len(x) / (2 * rule.least), 1.0), d, d >= rule.move))
    return sorted(out)


def _write(spark, rows, path, schema=SIGHTS):
    import datetime as dt

    when = lambda t: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=t)
    spark.createDataFrame([(r[0], when(r[1]), *r[2:]) if schema is SIGHTS else r for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("reach", [None, 1.0])
def test_the_window_in_batch_equals_brute_force(spark, reach):
    rows, rule = _sights(400, 3), Rule(20 * SECOND, reach, 2, 0.35)
    df = spark.createDataFrame(rows, "key long, t long, ord long, x double, y double, z double")
    got = batch_window.window_tracks(df, "key", "t", "ord", ["x", "y", "z"], rule, 300 * SECOND)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, rule, 300 * SECOND)


@pytest.mark.parametrize("reach", [None, 1.0])
def test_the_window_as_a_stream_on_shuffled_files_and_after_restarts(spark, tmp_path, reach):
    """Each start of the stream takes up what it left; rows are in no order of time, within the watermark's delay."""
    rows, rule = _sights(400, 4), Rule((20 if reach else 2) * SECOND, reach, 2, 0.35)
    early, late = [r for r in rows if r[1] < 150 * SECOND], [r for r in rows if r[1] >= 150 * SECOND]
    sink = EpochTable(str(tmp_path / "out"))
    for n, part in enumerate((early, late, [(0, 900 * SECOND, 1000, 0.0, 0.0, 0.0)])):
        random.Random(n).shuffle(part)
        for k in range(0, len(part), 80):
            _write(spark, part[k : k + 80], str(tmp_path / "in"))
        source = spark.readStream.schema(SIGHTS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        stream = active_window.window_tracks(source, rule, late="400 seconds")
        stream.writeStream.foreachBatch(sink.write).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    got = sorted(tuple(r)[:8] for r in sink.read(spark).drop("epoch").collect())
    want = _brute(rows, rule, 500 * SECOND)  # the watermark: 900 seconds less the delay
    assert got == want and len(want) > 20 and len(set(got)) == len(got)


EVENTS = "key long, kind string, first long, last long, order long, cells array<long>, moved boolean"


def _events(n, seed, start=0, keys=5):
    r = random.Random(seed)
    out = []
    for k in range(n):
        t = start + r.randrange(500)
        kind = r.choice([objects.OBSERVED, objects.OBSERVED, objects.OBSERVED, objects.SUPPORTED, objects.CONTRADICTED])
        out.append((r.randrange(keys), kind, t, t + r.randrange(3), k, [r.randrange(6) for _ in range(r.randrange(3))], r.random() < 0.1))
    return sorted(out, key=lambda e: e[2])


def _drain(spark, tmp_path, parts, seeds=None):
    sink = EpochTable(str(tmp_path / "out"))
    for part in parts:
        _write(spark, part, str(tmp_path / "in"), EVENTS)
        source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        persistent_states.persistent_states(source, seeds).writeStream.foreachBatch(sink.write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    return sink


def _states(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_states_as_a_stream_equal_the_batch_fold_after_restarts(spark, tmp_path):
    events = _events(240, 8)
    cuts = [events[i].__getitem__(2) for i in (80, 160)]
    parts = [[e for e in events if e[2] < cuts[0]], [e for e in events if cuts[0] <= e[2] < cuts[1]], [e for e in events if e[2] >= cuts[1]]]
    for p in parts:
        random.Random(1).shuffle(p)
    sink = _drain(spark, tmp_path, parts)
    want = objects.persistent_states(spark.createDataFrame(events, EVENTS), "key")
    assert _states(persistent_states.last_states(sink.read(spark))) == _states(want)


def test_a_session_begins_with_the_seeds_of_the_one_before(spark, tmp_path):
    seeds = [(k, 10 * k, 10 * k + 5, [k, k + 1]) for k in range(4)] + [(99, 1, 2, [7])]  # 99 is not seen again
    later = _events(120, 9, start=1000)
    table = spark.createDataFrame(seeds, "key long, first long, last long, cells array<long>")
    cut = later[60][2]
    sink = _drain(spark, tmp_path, [[e for e in later if e[2] < cut], [e for e in later if e[2] >= cut]], table)
    whole = [(k, objects.SEED, a, b, 0, c, False) for k, a, b, c in seeds] + later
    want = objects.persistent_states(spark.createDataFrame(whole, EVENTS), "key")
    assert _states(persistent_states.last_states(sink.read(spark), table)) == _states(want)


def test_an_older_event_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="older than"):
        _drain(spark, tmp_path, [[(1, objects.OBSERVED, 100, 100, 0, [1], False)], [(1, objects.OBSERVED, 50, 50, 1, [1], False)]])


def test_epochs_replay_and_refuse_late_rows(spark, tmp_path):
    sink = EpochTable(str(tmp_path / "t"), "t")
    rows = lambda *t: spark.createDataFrame([(x, f"v{x}") for x in t], "t long, v string")
    assert sink.read(spark) is None and sink.mark(spark) is None
    sink.write(rows(1, 5, 3), 0)
    sink.write(rows(5, 9), 1)
    sink.write(rows(1, 5, 3), 0)  # a replay is no late row, and counts once
    assert sink.mark(spark) == 9 and sink.read(spark).count() == 5
    with pytest.raises(LateRows, match="8"):
        sink.write(rows(10, 8), 2)
    assert sink.epochs(spark) == [0, 1] and sink.read(spark).count() == 5
    sink.write(rows(), 2)  # nothing has no stamp, and keeps the mark
    sink.write(rows(9), 3)
    assert sink.mark(spark) == 9
    again = EpochTable(str(tmp_path / "t"), "t", strict=True)  # another process
    with pytest.raises(LateRows):
        again.write(rows(9), 4)
    again.write(rows(11), 4)
    assert sorted(r.epoch for r in again.read(spark).collect()) == [0, 0, 0, 1, 1, 3, 4]


def test_a_crash_before_the_rename_leaves_no_epoch(spark, tmp_path, monkeypatch):
    sink = EpochTable(str(tmp_path / "t"), "t")
    sink.write(spark.createDataFrame([(1,)], "t long"), 0)
    monkeypatch.setattr(EpochTable, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sink.write(spark.createDataFrame([(2,)], "t long"), 1)
    monkeypatch.undo()
    assert sink.epochs(spark) == [0] and sink.read(spark).count() == 1
    sink.write(spark.createDataFrame([(2,)], "t long"), 1)
    assert sink.read(spark).agg(F.sum("t")).first()[0] == 3


ROWS = "key long, ts long, kind string, track string"


def _buffer_rows(n, seed, start=0):
    r = random.Random(seed)
    out = []
    for t in range(start, start + n):
        for key in range(3):
            out += [(key, t, frames.SIGHT, r.choice("abc")) for _ in range(r.choice([0, 0, 1, 2]))]
            out += [(key, t, frames.FRAME, None)] if r.random() < 0.8 else []
    return out


def _buffers_by_hand(rows, rule):
    out, most = [], 0
    for key in sorted({r[0] for r in rows}):
        buffer, k, sights = [], 0, []
        for _, t, kind, track in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3] or "")):
            if kind == frames.SIGHT:
                sights.append((track, t))
                continue
            live = {x for x, _ in sights if max(u for y, u in sights if y == x) >= t - rule.window}
            # a track that has left begins anew when it is seen again
            sights = [s for s in sights if s[0] in live]
            used = {u for _, u in sights}
            out += [(key, f, t, "unreferenced") for f in buffer if f not in used]
            buffer = [f for f in buffer if f in used]
            if k and buffer:
                out.append((key, buffer.pop(), t, "replaced"))
            buffer.append(t)
            if len(buffer) > rule.size:
                out.append((key, buffer.pop(0), t, "oldest"))
            k, most = (k + 1) % rule.every, max(most, len(buffer))
        out += [(key, f, None, "held") for f in buffer]
    return sorted(out, key=repr), most


@pytest.mark.parametrize("rule", [frames.Rule(5, 1, 40), frames.Rule(4, 3, 6)])
def test_buffers_in_batch_and_as_a_stream(spark, tmp_path, rule):
    rows = _buffer_rows(120, 5)
    want, most = _buffers_by_hand(rows, rule)
    got = frames.buffered(spark.createDataFrame(rows, ROWS), "key", rule)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and most <= rule.size
    assert {"unreferenced", "held"} <= {w[3] for w in want} and {w[3] for w in want} & {"oldest", "replaced"}
    sink = EpochTable(str(tmp_path / "out"))
    for low, high in ((0, 50), (50, 90), (90, 120)):
        part = [r for r in rows if low <= r[1] < high]
        random.Random(low).shuffle(part)
        _write(spark, part, str(tmp_path / "in"), ROWS)
        stream = frame_buffer.buffered(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), rule)
        stream.writeStream.foreachBatch(sink.write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    assert sorted((tuple(r) for r in frame_buffer.last_buffers(sink.read(spark)).collect()), key=repr) == want


def test_buffer_state_is_bounded():
    rule, now, r = frames.Rule(4, 2, 10), frames.start(), random.Random(1)
    for t in range(5000):
        frames.buffer_step(now, frames.SIGHT, t, f"track {t // 50 if r.random() < 0.5 else t}", rule)
        frames.buffer_step(now, frames.FRAME, t, None, rule)
        assert len(now["frames"]) <= 4 and len(now["tracks"]) <= 12 and all(len(seen) <= 4 for _, seen in now["tracks"].values())


def test_buffer_state_expires(spark, tmp_path):
    """A sensor that is silent for long begins anew; in between its state is gone."""
    import time

    sink, rule = EpochTable(str(tmp_path / "out")), frames.Rule(4, 1, 1000)
    for t, wait in ((1, 0), (2, 3)):
        time.sleep(wait)
        _write(spark, [(1, t, frames.SIGHT, "a"), (1, t, frames.FRAME, None)], str(tmp_path / "in"), ROWS)
        stream = frame_buffer.buffered(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), rule, expire=1000)
        stream.writeStream.foreachBatch(sink.write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(200)
    assert [r.frame for r in frame_buffer.last_buffers(sink.read(spark)).collect()] == [2]
