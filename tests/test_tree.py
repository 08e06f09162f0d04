"""Watching with state: changes, deletions, and a restart."""

import time

import pytest

from loomgraph.streaming import tree


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def wait(seen, n, seconds=90):
    until = time.monotonic() + seconds
    while len({f for _, fs in seen for f in fs}) < n and time.monotonic() < until:
        time.sleep(0.2)


def test_a_restart_hands_on_what_changed_meanwhile(spark, tmp_path, two_partitions):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "node_modules").mkdir()
    for name in ("a", "b", "pkg/c", "pkg/same"):
        (src / f"{name}.py").write_text(f"def {name[-1]}(): pass\n")
    seen, last = [], []
    start = lambda: tree.watch_tree(spark, f"file://{src}", f"file://{tmp_path}/cp", lambda s, f, n: last.append(n) or seen.append((sorted(r["name"] for r in s.collect()), f)), "gen_*", debounce=1, gone=6, every="500 milliseconds")
    query = start()
    try:
        until = time.monotonic() + 90
        while not query.recentProgress and time.monotonic() < until:
            time.sleep(0.2)
        time.sleep(3)
        assert not seen and query.isActive, query.exception()
        (src / "a.py").write_text("def a(): pass\ndef more(): pass\n")
        (src / "pkg/new.py").write_text("def new(): pass\n")
        (src / "gen_x.py").write_text("def x(): pass\n")
        (src / "node_modules/y.py").write_text("def y(): pass\n")
        wait(seen, 2)
        until = time.monotonic() + 60  # a batch that isn't over when the query stops comes again
        while (not last or query.lastProgress["batchId"] <= last[-1]) and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert {f for _, fs in seen for f in fs} == {"a.py", "pkg/new.py"} and {n for ns, _ in seen for n in ns} == {"a", "more", "new"}
    seen.clear()
    (src / "b.py").write_text("def b2(): pass\n")  # while it is down
    (src / "pkg/c.py").unlink()
    (src / "late.go").write_text("package p\nfunc Late() {}\n")
    query = start()
    try:
        wait(seen, 3)
        time.sleep(2)
    finally:
        query.stop()
    assert {f for _, fs in seen for f in fs} == {"b.py", "pkg/c.py", "late.go"} and {n for ns, _ in seen for n in ns} == {"b2", "Late"}


class Handle:
    """Timers and state of one file, in place of a session's."""

    def __init__(self):
        self.timers, self.held = set(), None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    def clear(self):
        self.held = None

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def run(ticks, debounce=2000, gone=5000):
    """What is told at which time, of ticks (time, (modified, size) or None); the very first tick is known."""
    import pandas as pd

    h, out = Handle(), []
    p = tree.Quiet(debounce, gone)
    p.init(h)
    for k, (now, row) in enumerate(ticks):
        if row:
            list(p.handleInputRows(("f",), iter([pd.DataFrame({"modified": [row[0]], "size": [row[1]], "known": [k == 0 and row[0] == 0]})]), Clock(now)))
        for at in sorted(h.timers):
            if at <= now:
                h.timers.discard(at)
                out += [(now, op) for df in p.handleExpiredTimer(("f",), Clock(now), None) for op in df["op"]]
        assert len(h.timers) == (h.held is not None)  # one timer a file
    return out


def test_events_start_the_timer_anew():
    every = range(0, 20000, 500)
    assert run([(t, (0, 1)) for t in every]) == []
    assert run([(t, (0, 1) if t < 3000 else (1, 1)) for t in every]) == [(5000, "changed")]
    # written until 6.5 s: quiet from then on
    assert run([(t, (0, 1) if t < 3000 else (min(t, 6500), 1)) for t in every]) == [(8500, "changed")]
    assert run([(t, None if t < 2000 else (9, 1)) for t in every]) == [(4000, "added")]
    assert run([(t, (0, 1) if t < 3000 else None) for t in every]) == [(7500, "deleted")]
    # gone before it was told: nothing; back after it has gone: new
    assert run([(t, (9, 1) if t == 2000 else None) for t in every], debounce=8000) == []
    assert run([(t, (0, 1) if t < 1000 or t > 12000 else None) for t in every])[0][1] == "deleted"
    # changed and changed back within the wait: nothing to tell
    assert run([(t, (5, 5) if t == 3000 else (0, 1)) for t in every]) == []
