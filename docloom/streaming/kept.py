"""Conversations kept as state that ends: title, turns and counts, with a timer for those that have gone idle.

Each conversation has its title and totals as a value, its turns as a list and its operations' counts as a map, so that a
new turn appends to the state and rewrites no other turn. Every operation moves the conversation's timer; once the watermark passes
it, the conversation is passed on as expired and its state is removed. An operation after that begins it anew.

Rows of a batch come in any order, so the title is that of the earliest submission with text.

Edge cases: an unknown operation is counted and does nothing else; a null text is empty; a null time is taken for the
watermark; deleted conversations are passed on once, without turns, and their state goes at once; operations later than the
watermark allows are kept, since only the timer ends a conversation; rows without a conv_id are one conversation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.tables import ship

TITLE = 38
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "conv_id bigint, title string, n_messages bigint, n_words bigint, n_operations bigint, expired boolean"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
OUT = Row(*NAMES)
EMPTY = (None, None, 0, 0, 0, None)
#: Turns, or characters of turns, that go to the state in one message.
TURNS, CHARS = 1000, 1 << 20


def title_of(text: str) -> str:
    """One line of at most ``TITLE`` characters."""
    line = " ".join(text.split())
    return line if len(line) <= TITLE else line[:TITLE].rstrip() + "…"


class Conversation(StatefulProcessor):
    """``idle``: milliseconds after its last operation at which a conversation ends.

    Every call to the state is a message to Spark and back, which costs far more than the work on a row. So the totals and
    the timer's time are read and written once a batch with the title, and turns and counts are only added to.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "title string, at bigint, n_messages bigint, n_words bigint, n_operations bigint, ends bigint")
        self.turns = handle.getListState("turns", "op string, text string")
        self.counts = handle.getMapState("counts", "op string", "n bigint")

    def _clear(self) -> None:
        self.head.clear()
        self.turns.clear()
        self.counts.clear()

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, deleted, stored = mark, False, self.head.get()
        if stored and stored[5] <= mark:  # due, and only not fired yet: rows come before timers
            yield OUT(key[0], stored[0] or "", *stored[2:5], True)
            self.handle.deleteTimer(stored[5])
            self._clear()
            stored = None
        kept = stored is not None  # whether the state has anything of this conversation
        title, title_at, n_messages, n_words, n_operations, ends = stored or EMPTY
        turns, size, counts = [], 0, Counter()
        for row in rows:
            op, text, at = row["op"], row["text"] or "", mark if row["at"] is None else row["at"]
            if op == "delete":
                if kept:
                    self._clear()
                if ends is not None:
                    self.handle.deleteTimer(ends)
                title, title_at, n_messages, n_words, n_operations, ends = EMPTY
                turns, size, counts, kept, deleted = [], 0, Counter(), False, True
                continue
            deleted = False
            counts[op] += 1
            n_operations += 1
            if op in ("submit", "finish"):
                n_messages += 1
                n_words += len(text.split())
                turns.append((op, text))
                size += len(text)
                if len(turns) >= TURNS or size >= CHARS:
                    self.turns.appendList(turns)
                    turns, size, kept = [], 0, True
                if op == "submit" and text.strip() and (title_at is None or at < title_at):
                    title, title_at = title_of(text), at
            last = max(last, at)
        if not deleted:
            if ends is not None:
                last = max(last, ends - self.idle)
            if ends != last + self.idle:
                if ends is not None:
                    self.handle.deleteTimer(ends)
                self.handle.registerTimer(last + self.idle)
            if turns:
                self.turns.appendList(turns)
            for op, n in counts.items():
                seen = self.counts.getValue((op,)) if stored and kept and self.counts.containsKey((op,)) else None
                self.counts.updateValue((op,), (n + (seen[0] if seen else 0),))
            self.head.update((title, title_at, n_messages, n_words, n_operations, last + self.idle))
        yield OUT(key[0], title or "", n_messages, n_words, n_operations, False)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self.head.get()
        yield OUT(key[0], stored[0] or "", *stored[2:5], True)
        self._clear()

    def close(self) -> None:
        pass


def last_states(spark, stream_of, idle_ms: int, work, name: str = "kept") -> DataFrame:
    """Run ``kept_conversations`` over what a stream has now: the last state of each conversation.

    ``stream_of`` makes the stream of operations from a session, which is a new one: the state store is set for it alone,
    with as many partitions as ``spark`` has now, and no space on disk set aside for each (4 MB otherwise). Each batch is written to ``work``, under its number, so that a batch that runs twice counts once.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    out, marks = f"{work.root}/{name}", f"{work.root}/{name}-checkpoint"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    kept = kept_conversations(stream_of(own), idle_ms)
    kept.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(COLUMNS + ", batch int").parquet(out)
    # in one batch, a conversation that ends is only followed by its own new beginning
    last = F.max_by(F.struct(*NAMES), F.struct("batch", ~F.col("expired")))
    return rows.groupBy("conv_id").agg(last.alias("s")).select("s.*")


def kept_conversations(operations: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream of operations (conv_id, op: new, submit, finish, delete; text; ts) to the state of each conversation after each batch.

    The session's state store has to be the one on disk (``ROCKS``), which list and map state need.
    """
    ship(operations.sparkSession)
    timed = operations.withWatermark("ts", late).withColumn("at", F.unix_millis("ts")).groupBy("conv_id")
    return timed.transformWithState(statefulProcessor=Conversation(idle_ms), outputStructType=COLUMNS, outputMode="Update", timeMode="EventTime")
