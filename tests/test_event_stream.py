import json

import pytest

from builders import rows
from wearline.sources.keyed_store import KeyedStore
from wearline.streaming import event_stream, flows


def line(flow, *rules, kind="flow_progress", **extra):
    counts = [{"name": n, "dataset": "d", "passed_records": p, "failed_records": f} for n, p, f in rules]
    details = {"flow_progress": {"status": "COMPLETED", "data_quality": {"expectations": counts}}}
    return json.dumps({"event_type": kind, "timestamp": "2024-01-01T00:00:00.000Z", "flow_name": flow,
                       "details": json.dumps(details), **extra})


@pytest.fixture
def log(spark, tmp_path):
    class Log:
        folder = tmp_path / "lines"
        store = KeyedStore(spark, str(tmp_path / "rollup"), event_stream.ROLLUP_KEYS, event_stream.ROLLUP_ORDER, buckets=4)
        files = 0

        def land(self, *lines):
            self.folder.mkdir(exist_ok=True)
            (self.folder / f"part-{self.files}.json").write_text("\n".join(lines) + "\n")
            self.files += 1

        def roll(self, files_per_trigger=None):
            lines = event_stream.read_event_lines(spark, str(self.folder), files_per_trigger)
            flows.run_available(spark, event_stream.dq_rollup_stream(lines, self.store, str(tmp_path / "cp")))
            return rows(self.store.read(), "flow_name", "expectation", "passed", "failed")

    return Log()


def test_totals_go_on_over_restarts_and_only_changed_rows_are_handed_over(spark, log):
    log.land(line("a", ("r1", 3, 1), ("r2", 5, 0)), line("b", ("r1", 7, 2)))
    assert log.roll() == [("a", "r1", 3, 1), ("a", "r2", 5, 0), ("b", "r1", 7, 2)]
    before = log.store.held(log.store.versions()[-1])
    log.land(line("b", ("r1", 1, 1)))
    assert log.roll() == [("a", "r1", 3, 1), ("a", "r2", 5, 0), ("b", "r1", 8, 3)]
    after = log.store.held(log.store.versions()[-1])
    assert sum(before[b] != after[b] for b in after) == 1
    assert log.roll() == [("a", "r1", 3, 1), ("a", "r2", 5, 0), ("b", "r1", 8, 3)]  # nothing new


def test_broken_lines_are_counted_and_harm_no_other(spark, log):
    whole = line("a", ("r", 1, 0))
    log.land(whole, whole[: len(whole) // 2], "no json", line("a", ("r", 10, 0), timestamp="yesterday"), "", line("a", ("r", 100, 5), more=[1]))
    log.land('{"event_type": "flow_progress"}', line("a", ("r", 7, 7), kind="other"), line(None, ("r", 2, 0)),
             json.dumps({"event_type": "flow_progress", "flow_name": "a", "details": "{torn"}))
    assert sorted(log.roll(files_per_trigger=1), key=str) == sorted(
        [("(unreadable)", "readable_line", 0, 3), ("a", "r", 101, 5), (None, "r", 2, 0)], key=str)
