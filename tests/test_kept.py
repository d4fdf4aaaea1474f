"""Conversations as state with list, map and timers."""

import datetime as dt
import os

from pyspark.sql import Row

from docloom.streaming.kept import ROCKS, TURNS, Conversation, kept_conversations, last_states, title_of
from docloom.tables import Workspace

SCHEMA = "conv_id bigint, op string, text string, ts timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1, 12, minute)


def test_idle_conversations_end_and_begin_anew(spark, tmp_path):
    batches = [
        [(1, "submit", "  hello   there ", at(0)), (1, "finish", "hi", at(1)), (2, "submit", "x" * 50, at(0)), (None, "new", None, at(0)), (3, "submit", "gone", at(0)), (3, "delete", None, at(1))],
        [(2, "odd", None, at(4)), (4, "submit", None, None)],
        [(5, "submit", "late", at(20))],
        [(1, "submit", "again", at(21))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    seen = []
    stream = own.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("b")
    kept = kept_conversations(stream, 5 * 60_000)
    query = kept.writeStream.foreachBatch(lambda df, i: seen.append([tuple(r) for r in df.collect()])).outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [r for batch in seen for r in batch]
    assert (1, "hello there", 2, 3, 2, False) in rows and (1, "hello there", 2, 3, 2, True) in rows
    assert (2, "x" * 38 + "…", 1, 1, 2, True) in rows  # its second operation moved the timer
    assert (3, "", 0, 0, 0, False) in rows and not any(r[0] == 3 and r[5] for r in rows)
    assert any(r[0] is None and r[4] == 1 and r[5] for r in rows) and any(r[0] == 4 and r[5] for r in rows)
    assert rows.index((1, "again", 1, 1, 1, False)) > rows.index((1, "hello there", 2, 3, 2, True))  # nothing was left of the old state
    assert not any(r[0] == 5 and r[5] for r in rows)


def test_titles():
    assert title_of(" a  b ") == "a b" and title_of("y" * 38) == "y" * 38 and title_of("y" * 39) == "y" * 38 + "…"


class Handle:
    """State of one conversation in memory; ``calls`` counts the messages that Spark would get."""

    def __init__(self):
        self.value, self.list, self.map, self.timers, self.calls = None, [], {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return Part(self, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def getListState(self, name, schema):  # noqa: N802
        return Part(self, appendList=self.list.extend, clear=self.list.clear)

    def getMapState(self, name, key, value):  # noqa: N802
        return Part(self, containsKey=self.map.__contains__, getValue=self.map.get, updateValue=self.map.__setitem__, clear=self.map.clear)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class Part:
    def __init__(self, handle, **methods):
        for name, f in methods.items():
            setattr(self, name, lambda *a, f=f: (setattr(handle, "calls", handle.calls + 1), f(*a))[1])


def fed(processor, mark, *rows):
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: mark})()
    return [tuple(r) for r in processor.handleInputRows((7,), iter([Row(op=op, text=text, at=ms) for op, text, ms in rows]), clock)]


def test_calls_to_the_state_do_not_grow_with_the_turns():
    handle, kept = Handle(), Conversation(1000)
    kept.init(handle)
    talk = [(op, f"{op} {i}", i) for i in range(200) for op in ("submit", "finish")]
    assert fed(kept, 0, *talk) == [(7, "submit 0", 400, 800, 400, False)]
    assert handle.calls <= 7 and len(handle.list) == 400 and handle.map == {("submit",): (200,), ("finish",): (200,)} and handle.timers == {1199}
    handle.calls = 0
    assert fed(kept, 0, *talk) == [(7, "submit 0", 800, 1600, 800, False)]
    assert handle.calls <= 10 and len(handle.list) == 800 and handle.map[("submit",)] == (400,) and handle.timers == {1199}
    handle.calls = 0
    assert [tuple(r) for r in kept.handleExpiredTimer((7,), None, None)] == [(7, "submit 0", 800, 1600, 800, True)]
    assert handle.calls <= 4 and handle.value is None and not handle.list and not handle.map


def test_deleted_and_due_conversations_begin_anew_within_a_batch():
    handle, kept = Handle(), Conversation(1000)
    kept.init(handle)
    fed(kept, 0, ("submit", "old words", 10), ("odd", None, 20))
    assert fed(kept, 0, ("finish", "gone", 30), ("delete", None, 40), ("submit", "new", None)) == [(7, "new", 1, 1, 1, False)]
    assert handle.list == [("submit", "new")] and handle.map == {("submit",): (1,)} and handle.timers == {1030}
    assert fed(kept, 1030, ("finish", "b c", 1040)) == [(7, "new", 1, 1, 1, True), (7, "", 1, 2, 1, False)]
    assert handle.list == [("finish", "b c")] and handle.map == {("finish",): (1,)} and handle.timers == {2040}
    assert fed(kept, 1040, ("delete", None, 1050)) == [(7, "", 0, 0, 0, False)]
    assert handle.value is None and not handle.list and not handle.map and not handle.timers


def test_long_batches_go_to_the_state_in_pieces():
    handle, kept = Handle(), Conversation(1000)
    kept.init(handle)
    assert fed(kept, 0, *[("submit", "x", i) for i in range(TURNS + 5)], ("delete", None, 5), *[("finish", "y", i) for i in range(TURNS + 1)]) == [(7, "", TURNS + 1, TURNS + 1, TURNS + 1, False)]
    assert handle.list == [("finish", "y")] * (TURNS + 1) and handle.map == {("finish",): (TURNS + 1,)}


def test_state_has_the_partitions_of_the_session_and_no_space_set_aside(spark, tmp_path):
    spark.createDataFrame([(1, "submit", "a", at(0)), (2, "submit", "b", at(1))], SCHEMA).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    seen = []

    def stream(own):
        seen.append(own.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate"))
        return own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))

    try:
        work = Workspace(spark, "kept")
        assert last_states(spark, stream, 1000, work).count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = os.listdir(f"{work.root.removeprefix('file://')}/kept-checkpoint/state/0")
    assert sorted(s for s in stores if s.isdigit()) == ["0", "1", "2"] and seen == ["false"]
