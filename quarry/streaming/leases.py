"""ST04: queues of leased jobs as a keyed state machine over a stream of commands.

A queue holds jobs in the order they came in. Workers claim the oldest job that may be worked on, up to a
capacity each; a lease ends unless a heartbeat renews it; a job whose worker failed waits for twice as
long each time; one that has used up its attempts has failed for good. Commands act in the order of their
time and number, whatever order and how often they arrive: a queue keeps what is ahead of the watermark, and a
timer hands it on once nothing earlier can come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Of a command: queue, number, time in microseconds, kind (enqueue, claim, heartbeat, done, fail), worker. A job has the number of the command that queued it.
COMMANDS = "queue long, id long, at long, kind string, worker long"
TRANSITIONS = "queue long, job long, at long, place int, status string, attempts int, until long, worker long"
_JOB = "job long, status string, attempts int, until long, worker long"

#: Keyed state needs a store that keeps several states for each key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Rules:
    """Times in seconds."""

    lease: int = 86_400
    retry: int = 21_600
    longest_retry: int = 172_800
    attempts: int = 3
    capacity: int = 1


@dataclass
class Queue:
    """Jobs of one queue in the order they came in: [job, status, attempts, until, worker]."""

    rules: Rules
    jobs: list[list] = field(default_factory=list)

    def _set(self, job: list, at: int, status: str, until: int | None = None, worker: int | None = None) -> tuple:
        job[1], job[3], job[4] = status, until, worker
        return job[0], at, status, job[2], until, worker

    def expire(self, at: int) -> Iterator[tuple]:
        """Leases that have ended by ``at`` are given up; the job is free again, or has failed if that was its last attempt."""
        for job in self.jobs:
            if job[1] == "RUNNING" and job[3] <= at:
                yield self._set(job, job[3], "STALE" if job[2] < self.rules.attempts else "FAILED")

    def apply(self, number: int, at: int, kind: str, worker: int) -> Iterator[tuple]:
        yield from self.expire(at)
        held = [job for job in self.jobs if job[1] == "RUNNING" and job[4] == worker]
        second = 1_000_000
        if kind == "enqueue":
            self.jobs.append([number, None, 0, None, None])
            yield self._set(self.jobs[-1], at, "PENDING")
        elif kind == "claim" and len(held) < self.rules.capacity:
            free = (job for job in self.jobs if job[1] in ("PENDING", "STALE") or job[1] == "RETRY_WAIT" and job[3] <= at)
            if job := next(free, None):
                job[2] += 1
                yield self._set(job, at, "RUNNING", at + self.rules.lease * second, worker)
        elif kind == "heartbeat" and held:
            yield self._set(held[0], at, "RUNNING", at + self.rules.lease * second, worker)
        elif kind == "done" and held:
            yield self._set(held[0], at, "DONE")
        elif kind == "fail" and held:
            wait = min(self.rules.longest_retry, self.rules.retry * 2 ** (held[0][2] - 1))
            failed = held[0][2] >= self.rules.attempts
            yield self._set(held[0], at, "FAILED" if failed else "RETRY_WAIT", None if failed else at + wait * second)

    def next_end(self) -> int | None:
        """When the first lease ends."""
        return min((job[3] for job in self.jobs if job[1] == "RUNNING"), default=None)


class Leases(StatefulProcessor):
    """Keeps, for each queue, its jobs, the commands ahead of the watermark, and the last command that has acted."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", _JOB)
        self.ahead = handle.getListState("ahead", "id long, at long, kind string, worker long")
        self.last = handle.getValueState("last", "at long, id long")

    def _wake(self, waiting: Iterable[tuple], queue: Queue) -> None:
        """One timer for each queue, at what comes next: a command's turn or the end of a lease."""
        times = [c[1] for c in waiting] + ([queue.next_end()] if queue.next_end() is not None else [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def _queue(self) -> Queue:
        return Queue(self.rules, [list(j) for j in self.jobs.get()] if self.jobs.exists() else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done = tuple(self.last.get()) if self.last.exists() else (-1, -1)
        known = [tuple(c) for c in self.ahead.get()] if self.ahead.exists() else []
        new = {(r.at, r.id): (r.id, r.at, r.kind, r.worker) for r in rows}
        # What has acted, or waits already, is a repetition.
        for c in known:
            new.pop((c[1], c[0]), None)
        added = [c for place, c in new.items() if place > done]
        if added:
            self.ahead.appendList(added)
            self._wake(known + added, self._queue())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(c) for c in self.ahead.get()), key=lambda c: (c[1], c[0])) if self.ahead.exists() else []
        queue, out = self._queue(), []
        due = [c for c in waiting if c[1] < now]
        for number, at, kind, worker in due:
            out += queue.apply(number, at, kind, worker)
        out += queue.expire(now - 1)
        if due:
            self.last.update((due[-1][1], due[-1][0]))
        waiting = waiting[len(due) :]
        self.ahead.clear()
        if waiting:
            self.ahead.put(waiting)
        # What is over is told once and forgotten.
        queue.jobs = [job for job in queue.jobs if job[1] not in ("DONE", "FAILED")]
        self.jobs.clear()
        if queue.jobs:
            self.jobs.put([tuple(j) for j in queue.jobs])
        self._wake(waiting, queue)
        return iter([Row(queue=key[0], job=t[0], at=t[1], place=i, status=t[2], attempts=t[3], until=t[4], worker=t[5]) for i, t in enumerate(out)])

    def close(self) -> None:
        pass


def lease_transitions(commands: DataFrame, rules: Rules | None = None, late: str = "1 hour") -> DataFrame:
    """The status changes of all jobs, from a stream of ``COMMANDS``; commands later than ``late`` are lost."""
    timed = commands.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", late)
    return timed.groupBy("queue").transformWithState(Leases(rules or Rules()), TRANSITIONS, "update", "EventTime")


def run_leases(commands: DataFrame, folder: str, checkpoint: str, rules: Rules | None = None, late: str = "1 hour") -> None:
    """Runs all that is there now; each batch's transitions lie in a folder of its own, which a repeated batch overwrites."""
    conf = commands.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        lease_transitions(commands, rules, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            conf.unset(STORE[0])
        else:
            conf.set(STORE[0], before)


def final_states(transitions: DataFrame) -> DataFrame:
    """(queue, job, status, attempts, until, worker): the last status of each job."""
    last = F.max(F.struct("batch", "place", "status", "attempts", "until", "worker")).alias("last")
    return transitions.groupBy("queue", "job").agg(last).select("queue", "job", "last.status", "last.attempts", "last.until", "last.worker")
