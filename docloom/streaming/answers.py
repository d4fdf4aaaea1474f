"""Streams: answers that grow piece by piece, conversation stores, event windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.context import citation_owners, is_refusal, repair_citations


def grow(text: str) -> tuple[str, bool]:
    """What of a reply so far may be shown: thoughts cut, and nothing while one is open."""
    if "<think>" in text:
        head, _, rest = text.partition("<think>")
        if "</think>" not in rest:
            return head.lstrip(), False
        return grow(head + rest.split("</think>", 1)[1])
    return text.lstrip(), True


def _accumulate(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    so_far, shown = state.get if state.exists else ("", "")
    pieces = pd.concat(list(frames)).sort_values("seq", kind="stable")
    out = []
    for seq, piece in zip(pieces["seq"], pieces["piece"], strict=True):
        so_far += piece or ""
        text, open_ = grow(so_far)
        if open_:
            shown = text
            out.append((key[0], int(seq), text))
    state.update((so_far, shown))
    yield pd.DataFrame(out, columns=["conv_id", "seq", "answer"])


def accumulate(pieces: DataFrame) -> DataFrame:
    """A stream (conv_id, seq, piece) to (conv_id, seq, answer): the answer so far after each piece."""
    return pieces.groupBy("conv_id").applyInPandasWithState(_accumulate, "conv_id bigint, seq bigint, answer string", "text string, shown string", "update", GroupStateTimeout.NoTimeout)


def accumulate_repaired(pieces: DataFrame, contexts: DataFrame) -> DataFrame:
    """The same with citations put right at each emission; ``contexts`` (conv_id, context) is a table, one row a conversation.

    Also refuses: whether the answer so far is a refusal, which shows no sources. A mention is read once its title is
    complete, so one that is still being written stays as it is.
    """
    # the projection makes rows of the state operator's column batches, which an exchange cannot take
    grown = accumulate(pieces).withColumn("answer", F.coalesce("answer", F.lit("")))
    owned = grown.join(contexts.select("conv_id", citation_owners(F.coalesce("context", F.lit(""))).alias("_owners")), "conv_id", "left")
    owners = F.coalesce("_owners", F.expr("cast(map() as map<string, array<string>>)"))
    shown = owned.withColumn("_owners", owners).withColumn("answer", repair_citations(F.col("answer"), F.col("_owners")))
    return shown.select("conv_id", "seq", "answer", is_refusal(F.col("answer"), F.col("_owners")).alias("refuses"))


def accumulate_batch(pieces: DataFrame) -> DataFrame:
    """The same over a table, without state: the last answer of each conversation."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: F.coalesce(x["piece"], F.lit(""))), "")
    shown = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")
    return pieces.groupBy("conv_id").agg(F.ltrim(shown).alias("answer"))


def _apply(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    title, turns, deleted = state.get if state.exists else ("", 0, False)
    for f in frames:
        for op, text in zip(f["op"], f["text"], strict=True):
            if op == "delete":
                title, turns, deleted = "", 0, True
            elif op == "submit":
                deleted = False
                turns += 1
                if not title and (text or "").strip():
                    t = " ".join(text.split())
                    title = t if len(t) <= 38 else t[:38].rstrip() + "…"
            elif op == "finish":
                turns += 1
    state.update((title, turns, deleted))
    yield pd.DataFrame([(key[0], title, turns, deleted)], columns=["conv_id", "title", "n_messages", "deleted"])


def conversation_store(operations: DataFrame) -> DataFrame:
    """A stream of operations (conv_id, op: new, submit, finish, delete; text) to the state of each conversation."""
    return operations.groupBy("conv_id").applyInPandasWithState(
        _apply, "conv_id bigint, title string, n_messages bigint, deleted boolean", "title string, turns bigint, deleted boolean", "update", GroupStateTimeout.NoTimeout
    )


def normalise_store(stores: DataFrame) -> DataFrame:
    """Conversations without an id go; the active one is the first where it is missing. ``stores``: convos (id, title, messages), active."""
    convos = F.filter("convos", lambda c: c["id"].isNotNull() & (c["id"] != ""))
    ids = F.transform(convos, lambda c: c["id"])
    active = F.when(F.array_contains(ids, F.col("active")), F.col("active")).otherwise(F.get(ids, 0))
    return stores.select(convos.alias("convos"), active.alias("active"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None, by: str = "event_type") -> DataFrame:
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, by: str = "user_id") -> DataFrame:
    df = events.withWatermark("ts", late) if late else events
    got = df.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
