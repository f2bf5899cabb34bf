"""Pushes as keyed state: any order of files, restarts, changes only."""

import json
import random

from dayroll.operators.state import last_write
from dayroll.plans.push import route
from dayroll.sources.store import Store
from dayroll.streaming.keyed import LastRow, placed_points, stream_changes


def line(r):
    on = lambda f: {"date": f"2026-0{r.randrange(5, 7)}-0{r.randrange(1, 5)} 08:00:00 -0700", "source": r.choice("ab"), **f}
    steps = [on({"qty": r.randrange(9)}) for _ in range(r.randrange(4))]
    night = [on({"totalSleep": r.randrange(9), "deep": 1})]
    return json.dumps({"data": {"metrics": [{"name": "step_count", "units": "count", "data": steps}, {"name": "sleep_analysis", "units": "hr", "data": night}, {"name": "step_count", "units": "count", "data": steps[:1]}]}})


def test_files_in_any_order_and_a_restart(spark, tmp_path):
    r = random.Random(2)
    bodies = {f"{i:02d}.json": "\n".join(line(r) for _ in range(3)) for i in range(8)}
    (tmp_path / "in").mkdir()
    store, changes = Store(spark, f"{tmp_path}/store"), []
    names = sorted(bodies, key=lambda n: r.random())
    for some in (names[:3], names[3:4], names[4:], []):  # each time the query is started anew from its checkpoint
        for n in some:
            (tmp_path / "in" / n).write_text(bodies[n])
        stream_changes(spark, f"{tmp_path}/in", store, f"{tmp_path}/checkpoint", "2026-08-01 00:00:00", lambda n, c: changes.append(c)).awaitTermination()
    rows = [(b, i, x) for n, b in enumerate(sorted(bodies)) for i, x in enumerate(bodies[b].split("\n"))]
    want = last_write(route(spark.createDataFrame([(json.dumps([b, i]), x) for b, i, x in rows], "at string, value string"), "value", "at").stored, ("kind", "day"), "pos")
    cols = ["kind", "day", "value", "min", "max", "source"]
    got = store.read("daily_metric").select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want.select(cols).collect())) and len(got) > 10
    assert changes[0] > 0 and sum(changes) < sum(len(json.loads(x)["data"]["metrics"]) * 4 for _, _, x in rows)
    # files that come late and are older than what is held change nothing
    before = store.version()
    (tmp_path / "in" / "00a.json").write_text(bodies["00.json"].replace("2026-0", "2026-0"))
    (tmp_path / "in" / "!.json").write_text(bodies["07.json"])
    changes.clear()
    stream_changes(spark, f"{tmp_path}/in", store, f"{tmp_path}/checkpoint", "2026-08-02 00:00:00", lambda n, c: changes.append(c)).awaitTermination()
    assert sorted(map(str, store.read("daily_metric").select("kind", "day").collect())) == sorted(str(x) for x in store.read("daily_metric", before).select("kind", "day").collect())


def test_a_row_counts_if_its_place_is_later():
    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Handle:
        def getValueState(self, *_):
            return State()

    from pyspark.sql import Row

    p = LastRow()
    p.init(Handle())
    row = lambda f, n, v: Row(file=f, line=n, metric=0, point=0, stage=0, value=v, min=None, max=None, source="s")
    tell = lambda *rows: [r.value for r in p.handleInputRows(("steps", None), iter(rows), None)]
    assert tell(row("b", 1, 1.0), row("b", 0, 9.0)) == [1.0] and tell(row("a", 5, 2.0)) == [] and tell(row("b", 1, 3.0)) == []
    assert tell(row("b", 2, 1.0)) == [] and p.last.get()[1] == 2 and tell(row("c", 0, 1.5), row("b", 9, 8.0)) == [1.5]


def test_a_file_is_read_in_splits_and_its_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    metric = lambda i: {"name": "step_count", "units": "count", "data": [{"date": "2026-05-01 08:00:00 -0700", "qty": i}]}
    (tmp_path / "in" / "a.json").write_text("\n".join([*[""] * 50, *[json.dumps({"data": {"metrics": [metric(i)]}}) for i in range(400)]]))
    own, seen = spark.newSession(), []
    own.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    points = placed_points(own, f"{tmp_path}/in")
    points.writeStream.foreachBatch(lambda b, n: seen.append((b.rdd.getNumPartitions(), b.select("line", "value").collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    (tasks, rows), *_ = seen
    assert tasks > 4 and len({r.line for r in rows}) == 400
    assert [r.value for r in sorted(rows)] == [float(i) for i in range(400)]
