"""Stream forms of the stateful steps. Marks, seen urls, watches and chunks live in Spark's keyed state, under the query's
own checkpoint: a batch that is run again sees the state it saw first, and a restart goes on where the last batch ended.

The functions take and return streaming DataFrames; the caller starts them with a sink and a checkpoint. Arbitrary state needs
the RocksDB state store (``with_state_store``). One micro-batch is one poll: results depend on the batches as those of the batch
forms depend on the polls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leadspan.functions.normalize import hash_url, text
from leadspan.operators.chunks import chunk_documents
from leadspan.operators.signals import HIRING_DELTA, KEY, STATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def known(value):
    """A value out of pandas, None for its missing ones."""
    return None if value is None or value is pd.NaT or value != value else value


class NewerThanMark(StatefulProcessor):
    """Items of one source that are undated or newer than the source's mark, which then moves to the newest date polled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "micros long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.mark.update((int(initialState["micros"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        newest = None
        for pdf in rows:
            dated = pdf["published_micros"]
            if dated.notna().any():
                newest = max(int(dated.max()), newest or int(dated.max()))
            yield pdf if mark is None else pdf[dated.isna() | (dated > mark)]
        if newest is not None:  # the newest date of this poll, even if the mark was later
            self.mark.update((newest,))

    def close(self) -> None:
        pass


class FirstFeedOfUrl(StatefulProcessor):
    """The items of a url in the first feed of the poll that has it new; none once it was given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        kept: list[pd.DataFrame] = []
        for pdf in rows:
            first = pdf["feed_order"].min()
            if kept and kept[0]["feed_order"].iloc[0] > first:
                kept = []
            if not kept or kept[0]["feed_order"].iloc[0] == first:
                kept.append(pdf[pdf["feed_order"] == first])
        yield from kept

    def close(self) -> None:
        pass


ITEM = "item_no long, source_key string, link string, feed_order int, url_hash string, published_micros long"


def fresh_items_stream(stream: DataFrame, seen: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Items (item_no, source_key, link) that are new against seen urls and per-source marks.

    A url that was given out earlier hides an item but still counts for its source's mark, and only items that pass their mark
    count as given out. Items without a link are never repeats.
    """
    items = stream.select(
        "item_no", "source_key", "link", F.col("feed_order").cast("int").alias("feed_order"),
        F.when(text(F.col("link")) != "", hash_url(F.col("link"))).alias("url_hash"), F.unix_micros("published_at").alias("published_micros"),
    )
    marks = watermarks.filter("last_published_at IS NOT NULL").select("source_key", F.unix_micros("last_published_at").alias("micros"))
    newer = items.groupBy("source_key").transformWithStateInPandas(NewerThanMark(), ITEM, "append", "none", marks.groupBy("source_key"))
    # items without a url have a key of their own
    keyed = newer.withColumn("url_key", F.coalesce("url_hash", F.concat(F.lit("item:"), F.col("item_no").cast("string"))))
    given = seen.select(F.col("url_hash").alias("url_key"), F.lit(True).alias("seen")).distinct()
    fresh = keyed.groupBy("url_key").transformWithStateInPandas(FirstFeedOfUrl(), f"{ITEM}, url_key string", "append", "none", given.groupBy("url_key"))
    return fresh.select("item_no", "source_key", "link")


BASE = "amount long, round_name string, title string, company string, checked_micros long"


class ChangeOfWatch(StatefulProcessor):
    """The signal of one watch, if its newest observation after the last check is a change; the watch then takes its state."""

    def __init__(self, hiring_delta: int) -> None:
        self.hiring_delta = hiring_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", BASE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        amount = known(row["amount"])
        self.base.update((None if amount is None else int(amount), *(known(row[c]) for c in STATE[1:]), int(row["checked_micros"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.base.exists():
            return
        base = tuple(self.base.get())
        newest, count = None, 0
        for pdf in rows:
            later = pdf[pdf["observed_micros"] > base[-1]]
            count += len(later)
            if len(later):
                row = later.sort_values(["observed_micros", "obs_id"]).iloc[-1]
                if newest is None or (row["observed_micros"], row["obs_id"]) > (newest["observed_micros"], newest["obs_id"]):
                    newest = row
        if newest is None:
            return
        amount = known(newest["amount"])
        now = (None if amount is None else int(amount), *(known(newest[c]) for c in STATE[1:]))
        detail = self.detail(key[1], base, now)
        if detail:
            at = int(newest["observed_micros"])
            self.base.update((*now, at))
            yield pd.DataFrame({"entity_id": [key[0]], "signal_type": [key[1]], "detail": [detail], "new_items": [count], "detected_micros": [at]})

    def detail(self, kind: str, base: tuple, now: tuple) -> str | None:
        grown = None if base[0] is None or now[0] is None else now[0] - base[0]
        if kind == "funding":
            return "funding_total" if grown is not None and grown > 0 else "new_round" if now[1] != base[1] else None
        if kind == "hiring-surge":
            return "surge" if grown is not None and grown >= self.hiring_delta else None
        if kind == "job-change":
            moved, renamed = now[3] != base[3], now[2] != base[2]
            return "both" if moved and renamed else "company" if moved else "title" if renamed else None
        return "items" if kind == "news" else None

    def close(self) -> None:
        pass


def signals_stream(stream: DataFrame, watches: DataFrame, hiring_delta: int = HIRING_DELTA) -> DataFrame:
    """Signals (entity_id, signal_type, detail, new_items, detected_at) against the watches as the batches before left them."""
    seen = stream.select(*KEY, "obs_id", *STATE, F.unix_micros("observed_at").alias("observed_micros"))
    base = watches.select(*KEY, *[F.col(f"base_{c}").alias(c) for c in STATE], F.unix_micros("last_checked_at").alias("checked_micros"))
    out = "entity_id long, signal_type string, detail string, new_items long, detected_micros long"
    fired = seen.groupBy(*KEY).transformWithStateInPandas(ChangeOfWatch(hiring_delta), out, "append", "none", base.groupBy(*KEY))
    return fired.select(*KEY, "detail", "new_items", F.timestamp_micros("detected_micros").alias("detected_at"))


def dedup_signals_stream(stream: DataFrame) -> DataFrame:
    """At most one signal per tenant, entity, type and UTC day, however late it comes.

    One small key per signal kept stays in the state store; no watermark drops any.
    """
    day = stream.withColumn("signal_day", F.date_trunc("day", "detected_at"))
    return day.dropDuplicates(["tenant_id", "entity_id", "signal_type", "signal_day"])


def sync_source_stream(files: DataFrame, stored: DataFrame, tenant: str = "default") -> DataFrame:
    """Text files (path, text) to chunks; only chunks whose content is not stored yet are added, each content once."""
    chunks = chunk_documents(files, "path", "text").withColumn("tenant_id", F.lit(tenant))
    slim = chunks.select("tenant_id", "source_hash", "path", "chunk_no", "content")
    return slim.join(stored.select("tenant_id", "source_hash").distinct(), ["tenant_id", "source_hash"], "left_anti").dropDuplicates(["tenant_id", "source_hash"])
