"""Exports: files, sequencer layouts, CRM fields, result sets, batched hand-over to a caller's function."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leadspan.functions.normalize import text
from leadspan.operators.ranking import ordinals
from leadspan.operators.reports import with_variant

# Header and source fields, best first, per sequencer.
SEQUENCER_LAYOUTS = {
    "lemlist": {
        "first_name": ["first_name", "firstName", "first"], "last_name": ["last_name", "lastName", "last"], "email": ["email", "work_email", "personal_email"],
        "companyName": ["companyName", "company", "organization", "company_name"], "linkedinUrl": ["linkedinUrl", "linkedin_url", "linkedin", "profile_url"],
        "icebreaker": ["icebreaker", "snippet", "personalization", "hook"],
    },
    "apollo": {
        "first_name": ["first_name", "firstName", "first"], "last_name": ["last_name", "lastName", "last"], "email": ["email", "work_email", "personal_email"],
        "organization_name": ["organization_name", "company", "companyName", "company_name", "organization"], "title": ["title", "job_title", "headline", "position"],
        "linkedin_url": ["linkedin_url", "linkedinUrl", "linkedin", "profile_url"],
    },
    "woodpecker": {
        "first_name": ["first_name", "firstName", "first"], "last_name": ["last_name", "lastName", "last"], "email": ["email", "work_email", "personal_email"],
        "company": ["company", "companyName", "company_name", "organization", "organization_name"], "website": ["website", "company_website", "domain", "url"],
        "snippet": ["snippet", "icebreaker", "personalization", "hook"],
    },
}


def select_fields(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """Chosen fields in order; one that does not exist is empty."""
    names = list(fields or df.columns)
    return df.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n in df.columns else F.lit("").alias(n) for n in names])


def export_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    select_fields(df, fields).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def export_json(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    (select_fields(df, fields) if fields else df).write.mode(mode).json(path)


def to_sequencer(df: DataFrame, layout: str) -> DataFrame:
    """Exact columns of a sequencer: per header the first non-empty source field."""
    spec = SEQUENCER_LAYOUTS[layout.lower()]

    def pick(sources: Sequence[str]) -> Column:
        found = [F.when(F.col(s).cast("string") != "", F.col(s).cast("string")) for s in sources if s in df.columns]
        return F.coalesce(*found, F.lit(""))

    return df.select(*[pick(sources).alias(header) for header, sources in spec.items()])


def campaign_leads_export(leads: DataFrame, variants: DataFrame) -> DataFrame:
    """The twelve columns of a campaign's lead file, newest change first."""
    j = with_variant(leads, variants)
    ts = lambda c: text(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return j.orderBy(F.col("updated_at").desc(), "lead_id").select(
        F.concat_ws(" ", F.when(F.col("first_name") != "", F.col("first_name")), F.when(F.col("last_name") != "", F.col("last_name"))).alias("Name"),
        text(F.col("company")).alias("Company"), text(F.col("headline")).alias("Headline"), text(F.col("linkedin_url")).alias("LinkedIn URL"),
        text(F.col("variant_name")).alias("Variant"), F.col("lifecycle_status").alias("Lifecycle Status"), text(F.col("qualification_score").cast("string")).alias("Score"),
        ts("connect_sent_at").alias("Connect Sent"), ts("connected_at").alias("Connected"), ts("dm1_sent_at").alias("DM1 Sent"), ts("dm2_sent_at").alias("DM2 Sent"), ts("replied_at").alias("Replied"),
    )


def to_crm(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(field).alias(crm) for field, crm in mapping.items() if field in df.columns])


def column_labels(df: DataFrame) -> list[dict[str, str]]:
    """Key, label (words capitalised) and type of each column."""
    return [{"key": c, "label": re.sub(r"\b\w", lambda m: m[0].upper(), c.replace("_", " ")), "type": "text"} for c in df.columns]


def result_rows(df: DataFrame, result_set_id: str, order: Sequence[str]) -> DataFrame:
    """Rows of a result set: position by ``order`` and the record as JSON."""
    numbered = ordinals(df.withColumn("_set", F.lit(result_set_id)), ["_set"], order, "row_index")
    return numbered.select(F.col("_set").alias("result_set_id"), "row_index", F.to_json(F.struct(*df.columns)).alias("data"))


def write_result_set(df: DataFrame, result_set_id: str, path: str, order: Sequence[str]) -> None:
    result_rows(df, result_set_id, order).write.mode("append").partitionBy("result_set_id").parquet(path)


class Transport(Protocol):
    """Two-step delivery: batches are put up under the attempt they came from, and given out or dropped as a whole."""

    def stage(self, attempt: str, number: int, batch: list[dict]) -> None: ...

    def publish(self, attempts: Sequence[str]) -> None: ...

    def discard(self, attempts: Sequence[str]) -> None: ...


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    batches: int


class BatchWriter(DataSourceWriter):
    """Tasks stage their batches. Spark commits one attempt of every partition, so what a failed or doubled attempt staged is
    never published, and nothing is if the job fails. The driver sees the names of attempts only."""

    def __init__(self, transport: Transport, size: int) -> None:
        self.transport, self.size = transport, size

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        attempt, batch, number = uuid.uuid4().hex, [], 0
        for row in iterator:
            batch.append(row.asDict(recursive=True))
            if len(batch) == self.size:
                self.transport.stage(attempt, number, batch)
                batch, number = [], number + 1
        if batch:
            self.transport.stage(attempt, number, batch)
            number += 1
        return Staged(attempt, number)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.transport.publish([m.attempt for m in messages if m is not None and m.batches])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.transport.discard([m.attempt for m in messages if m is not None])


def write_batches(df: DataFrame, transport: Transport, size: int = 25) -> None:
    """Hands all rows to ``transport`` in batches, each row once however often tasks are run again."""
    format_name = f"batches_{uuid.uuid4().hex}"

    class BatchSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return BatchWriter(transport, size)

    df.sparkSession.dataSource.register(BatchSink)
    df.write.format(format_name).mode("append").save()


def foreach_batch_sink(df: DataFrame, send: Callable[[list[dict]], None], size: int = 25, attempts: int = 3, pause: float = 0.5) -> None:
    """Hands the rows to ``send`` in batches, inside the tasks; a failed batch is tried again before the task fails.

    A task that is run again sends its batches again, so ``send`` must accept repeats (key its records); see ``write_batches``.
    """

    def deliver(batch: list[dict]) -> None:
        for attempt in range(attempts):
            try:
                return send(batch)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * 2**attempt)

    def run(rows) -> None:
        batch: list[dict] = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                deliver(batch)
                batch = []
        if batch:
            deliver(batch)

    df.foreachPartition(run)
