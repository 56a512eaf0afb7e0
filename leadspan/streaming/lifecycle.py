"""The lead lifecycle as a stream: state and timers per lead, the outcome of tracking runs at a fixed interval.

Events (accepted invitations, replies, granted invitations, email statuses) take effect in the first run at or after them, as
when a tracker polls. A lead is only looked at in runs in which something can happen to it: those with events, and those that
its delays, its staleness or a pending acceptance or reply fall due in. These wait as event-time timers; a run is worked through
once the watermark has passed it, so events may come in any order and any cut into batches up to then.

What needs other leads is input: whether a lead may be contacted at all, whether its messages are fit to send, and
invitations granted out of a budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leadspan.streaming.jobs import known

DAY = 86_400_000
STALE = {"Connect_Sent": ("connect_sent_at", 30, "Expired"), "DM2_Sent": ("dm2_sent_at", 14, "No_Reply")}
STAMPS = ("connect_sent_at", "connected_at", "dm1_sent_at", "dm2_sent_at", "replied_at", "email_replied_at", "email_opened_at", "email_sent_at", "email_bounced_at")
CAMPAIGN = ("delay_mode", "active_days", "timezone", "window_start", "window_end")
SETTLED = ("blocked", "dm1_fit", "dm2_fit", "has_email")
# all times are milliseconds since 1970
LEAD = (
    "lead_id long, lifecycle_status string, email_status string, " + ", ".join(f"{c} long" for c in STAMPS)
    + ", delay_mode string, active_days string, timezone string, window_start string, window_end string, " + ", ".join(f"{c} boolean" for c in SETTLED)
    + ", related boolean, answered boolean"
)
EVENT = "lead_id long, kind string, at timestamp, event_no long, status string, bounced_at timestamp, replied_at timestamp, opened_at timestamp"
CHANGE = "lead_id long, run_ms long, action string, lifecycle_status string, email_status string, email_changed boolean"


def local(ms: int, zone: str) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).astimezone(ZoneInfo(zone))


def due_at(since: int | None, days: int, mode: str, active_days: list[int], zone: str) -> int | None:
    """When a delay ends: after so many days, or on the so manyth following day that is active in the campaign's zone."""
    if since is None:
        return None
    if mode != "business" or not days:
        return since + days * DAY if mode != "business" or active_days else None
    counted = [i for i in range(1, 7 * days + 1) if local(since + i * DAY, zone).isoweekday() in active_days]
    return since + counted[days - 1] * DAY if len(counted) >= days else None


class Lifecycle(StatefulProcessor):
    def __init__(self, first_ms: int, interval_ms: int, dm1_days: int, dm2_days: int) -> None:
        self.first, self.interval, self.delays = first_ms, interval_ms, {"Connected": ("connected_at", dm1_days, "dm1"), "DM1_Sent": ("dm1_sent_at", dm2_days, "dm2")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lead = handle.getValueState("lead", LEAD)
        self.events = handle.getListState("events", "run long, kind string, event_no long, status string, bounced long, replied long, opened long")

    def run_of(self, ms: int) -> int:
        """The first run at or after a time."""
        return self.first - (self.first - ms) // self.interval * self.interval

    def next_due(self, lead: dict, after: int) -> int | None:
        """The next run after ``after`` that changes the lead without new events."""
        status, due = lead["lifecycle_status"], []
        zone = (lead["delay_mode"], lead["days"], lead["timezone"])
        if status in STALE and lead[STALE[status][0]] is not None:
            due.append(lead[STALE[status][0]] + STALE[status][1] * DAY)
        if status in self.delays:
            stamp, days, action = self.delays[status]
            if not lead["blocked"] and lead[f"{action}_fit"]:
                due.append(due_at(lead[stamp], days, *zone))
        if (status == "Connect_Sent" and lead["related"]) or (status in ("DM1_Sent", "DM2_Sent") and lead["answered"] and lead["replied_at"] is None):
            due.append(after + 1)
        due = [self.run_of(max(d, after + 1)) for d in due if d is not None]
        return min(due) if due and lead["days"] else None

    def is_open(self, lead: dict, run: int) -> bool:
        now = local(run, lead["timezone"])
        return now.isoweekday() in lead["days"] and lead["window_start"] <= f"{now:%H:%M}" < lead["window_end"]

    def lifecycle(self, lead: dict, run: int, kinds: set[str]) -> str | None:
        """One run over the lead as it was before it; the action taken. Staleness overrides what else was found."""
        status, action, nxt = lead["lifecycle_status"], None, None
        if status == "Connect_Sent" and lead["related"]:
            action, nxt = "accepted", ("connected_at", "Connected")
        elif status in ("DM1_Sent", "DM2_Sent") and lead["answered"] and lead["replied_at"] is None:
            action, nxt = "replied", ("replied_at", "Replied")
        answering = action == "replied"
        if status in self.delays:
            stamp, days, send = self.delays[status]
            due = due_at(lead[stamp], days, lead["delay_mode"], lead["days"], lead["timezone"])
            if due is not None and due <= run:
                if lead["blocked"] or answering:
                    action = "skipped_blocked"
                elif not lead[f"{send}_fit"]:
                    action = "skipped_message"
                else:
                    action, nxt = send, (f"{send}_sent_at", {"dm1": "DM1_Sent", "dm2": "DM2_Sent"}[send])
        elif status == "Queued" and "granted" in kinds:
            action, nxt = ("skipped_blocked", None) if lead["blocked"] else ("connect", ("connect_sent_at", "Connect_Sent"))
        if nxt:
            lead["lifecycle_status"] = nxt[1]
            if action != "skipped_blocked":
                lead[nxt[0]] = run
        if status in STALE:
            stamp, days, end = STALE[status]
            if lead[stamp] is not None and run - lead[stamp] >= days * DAY:
                lead["lifecycle_status"], action = end, action or "expired"
                # what happened in the same run keeps its time
        return action

    def email(self, lead: dict, run: int, events: list[dict]) -> bool:
        """The last email status of the run; whether it changed the lead."""
        last = max((e for e in events if e["kind"] == "email"), key=lambda e: e["event_no"], default=None)
        if last is None or not lead["has_email"]:
            return False
        bounce = last["status"] == "bounced" and lead["email_bounced_at"] is None
        reply = last["replied"] is not None and lead["email_replied_at"] is None
        opened = not reply and last["opened"] is not None and lead["email_opened_at"] is None
        sent = not reply and not opened and last["status"] == "active" and lead["email_status"] != "sent"
        if bounce:
            lead["email_bounced_at"], lead["email_status"] = last["bounced"] if last["bounced"] is not None else run, "bounced"
        if reply:
            lead.update(email_replied_at=last["replied"], replied_at=last["replied"], lifecycle_status="Replied", email_status="replied")
        elif opened:
            lead.update(email_opened_at=last["opened"], email_status="opened")
        elif sent:
            lead.update(email_sent_at=lead["email_sent_at"] if lead["email_sent_at"] is not None else run, email_status="sent")
        return bounce or reply or opened or sent

    def work(self, until: int) -> list[tuple]:
        """All runs up to ``until``, in order."""
        lead = dict(zip(LEAD_NAMES, self.lead.get()))
        lead["days"] = [int(d) for d in (lead["active_days"] or "").split(",") if d]
        events = [dict(zip(("run", "kind", "event_no", "status", "bounced", "replied", "opened"), e)) for e in self.events.get()] if self.events.exists() else []
        out, at = [], lead["worked_until"] or 0
        while True:
            runs = [r for r in (min((e["run"] for e in events), default=None), self.next_due(lead, at)) if r is not None]
            if not runs or min(runs) > until:
                break
            run = max(min(runs), at + 1)
            at = run
            now = [e for e in events if e["run"] <= run]
            events = [e for e in events if e["run"] > run]
            kinds = {e["kind"] for e in now}
            before = lead["lifecycle_status"], lead["email_status"]
            lead["related"] |= "accepted" in kinds
            lead["answered"] |= "replied" in kinds
            action = self.lifecycle(lead, run, kinds) if self.is_open(lead, run) else None
            changed = self.email(lead, run, now)
            if changed or (lead["lifecycle_status"], lead["email_status"]) != before:
                out.append((lead["lead_id"], run, action, lead["lifecycle_status"], lead["email_status"], changed))
        lead["worked_until"] = at
        self.lead.update(tuple(lead[n] for n in LEAD_NAMES))
        if events:
            self.events.put([tuple(e.values()) for e in events])
        else:
            self.events.clear()
        self.wake(lead, events, at)
        return out

    def wake(self, lead: dict, events: list[dict], after: int) -> None:
        runs = [r for r in (min((e["run"] for e in events), default=None), self.next_due(lead, after)) if r is not None]
        if runs:
            self.handle.registerTimer(min(runs))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        values = [known(row[n]) if n in row else None for n in LEAD_NAMES]
        values = [int(v) if v is not None and n in WHOLE else bool(v) if n in FLAGS else v for n, v in zip(LEAD_NAMES, values)]
        self.lead.update(tuple(values))
        lead = dict(zip(LEAD_NAMES, values))
        lead["days"] = [int(d) for d in (lead["active_days"] or "").split(",") if d]
        self.wake(lead, [], lead["worked_until"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.lead.exists():
            return
        found = []
        for pdf in rows:
            for e in pdf.itertuples(index=False):
                times = [None if known(t) is None else int(t.timestamp() * 1000) for t in (e.bounced_at, e.replied_at, e.opened_at)]
                found.append((self.run_of(int(e.at.timestamp() * 1000)), e.kind, int(e.event_no), known(e.status), *times))
        self.events.appendList(found)
        for run in {f[0] for f in found}:
            self.handle.registerTimer(run)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = self.work(timerValues.getCurrentWatermarkInMs())
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


LEAD += ", worked_until long"
LEAD_NAMES = [c.split()[0] for c in LEAD.split(", ")]
FLAGS = {c.split()[0] for c in LEAD.split(", ") if c.endswith("boolean")}
WHOLE = {c.split()[0] for c in LEAD.split(", ") if c.endswith("long")}


def lead_states(leads: DataFrame, started_at) -> DataFrame:
    """Initial state of leads joined with their campaign (CAMPAIGN columns) and what is settled beforehand (SETTLED columns)."""
    stamps = [F.unix_millis(c).alias(c) for c in STAMPS]
    days = F.array_join(F.transform("active_days", lambda d: d.cast("string")), ",").alias("active_days")
    rest = [F.col(c) for c in ("delay_mode", "timezone", "window_start", "window_end", *SETTLED)]
    start = F.unix_millis(started_at).alias("worked_until")
    return leads.select("lead_id", "lifecycle_status", "email_status", *stamps, days, *rest, F.lit(False).alias("related"), F.lit(False).alias("answered"), start)


def lifecycle_stream(events: DataFrame, states: DataFrame, first_run: datetime, interval: timedelta = timedelta(days=1), dm1_days: int = 2, dm2_days: int = 3) -> DataFrame:
    """Changes (lead_id, run_at, action, lifecycle_status, email_status, email_changed) of leads, from events as in ``EVENT``
    with a watermark on ``at``; runs are ``interval`` apart, one of them at ``first_run`` (UTC)."""
    first = int(first_run.replace(tzinfo=timezone.utc).timestamp() * 1000)
    processor = Lifecycle(first, int(interval.total_seconds() * 1000), dm1_days, dm2_days)
    changes = events.groupBy("lead_id").transformWithStateInPandas(processor, CHANGE, "append", "eventtime", states.groupBy("lead_id"))
    return changes.select("lead_id", F.timestamp_millis("run_ms").alias("run_at"), "action", "lifecycle_status", "email_status", "email_changed")
