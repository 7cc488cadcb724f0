"""Result stores: whole runs only, each once, whoever appends and however often."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

from verdict.sources import runlog
from verdict.sources.runlog import append_run, manifests, read_runs

SCHEMA = "model string, value double"


def rows(spark, *values):
    return spark.createDataFrame([("m", v) for v in values], SCHEMA)


def values(spark, path, **kw):
    return sorted((r.run, r.value) for r in read_runs(spark, path, "t", SCHEMA, **kw).collect())


def test_runs_count_once_and_whole(spark, scratch):
    path = os.path.join(scratch, "store")
    assert values(spark, path) == [] and manifests(spark, path).count() == 0
    assert append_run(path, "a", {"t": rows(spark, 1.0, 2.0), "u": rows(spark, 9.0)})
    assert not append_run(path, "a", {"t": rows(spark, 3.0), "u": rows(spark, 9.0)})   # repeated
    assert append_run(path, "b", {"t": rows(spark, 4.0)}) and append_run(path, "empty", {"t": rows(spark, 0.0).limit(0)})
    assert values(spark, path) == [("a", 1.0), ("a", 2.0), ("b", 4.0)]
    assert values(spark, path, until=1) == [("a", 1.0), ("a", 2.0)]
    assert {(r.run, r.version) for r in manifests(spark, path).collect()} == {("a", 1), ("b", 2), ("empty", 3)}
    assert [r.value for r in read_runs(spark, path, "u", SCHEMA).collect()] == [9.0]


def test_unfinished_runs_are_not_read(spark, scratch):
    path = os.path.join(scratch, "store")
    append_run(path, "a", {"t": rows(spark, 1.0)})
    rows(spark, 7.0).write.parquet(f"{path}/data/t/attempt=adead")   # rows, but no manifest
    for number, body in ((2, ""), (3, '{"run": "c", "att')):         # a writer ended while it wrote
        with open(f"{path}/log/{number:020d}.json", "w") as f:
            f.write(body)
    assert values(spark, path) == [("a", 1.0)]
    assert append_run(path, "c", {"t": rows(spark, 5.0)})            # takes the next free number
    assert values(spark, path) == [("a", 1.0), ("c", 5.0)]
    assert os.path.exists(f"{path}/log/{4:020d}.json")


def test_the_lower_manifest_of_a_run_counts(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "store")
    append_run(path, "a", {"t": rows(spark, 1.0)})
    take = runlog._take_number

    def overtaken(spark, path, number, body):   # another writer commits the same run just before
        if number == 2:
            rows(spark, 8.0).write.parquet(f"{path}/data/t/attempt=aother")
            take(spark, path, 2, json.dumps({"run": "b", "attempt": "aother", "run_ts": "2024-01-01T00:00:00Z"}))
        return take(spark, path, number, body)

    monkeypatch.setattr(runlog, "_take_number", overtaken)
    assert not append_run(path, "b", {"t": rows(spark, 9.0)})
    assert values(spark, path) == [("a", 1.0), ("b", 8.0)]
    assert sum(d.startswith("attempt=") for d in os.listdir(f"{path}/data/t")) == 2


def test_writers_at_once(spark, scratch):
    path = os.path.join(scratch, "store")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: append_run(path, f"run{i % 3}", {"t": rows(spark, float(i))}), range(6)))
    got = values(spark, path)
    assert sum(done) == 3 and [r for r, _ in got] == ["run0", "run1", "run2"]
    assert all(int(r[-1]) == int(v) % 3 for r, v in got)
