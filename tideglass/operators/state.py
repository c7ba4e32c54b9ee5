"""Rules in which what happens depends on what was let through before: a sliding-window limiter, and leases on jobs.

Such a rule is a fold over a key's rows in order, and no window frame can say it. In batch, rows are shuffled by key and
sorted, and stream through a fold whose state is bounded (the limiter's by its limit, a lease's by one lease), so no
key's rows are held at once. A key's rows are first cut where its state is certain to be empty, so a busy key with pauses
is folded in many tasks; rows between two pauses depend on each other and stay together. In streams, the same folds run
over keyed state with event time (`applyInPandasWithState`); both give the same rows.

Rows of one key with equal times are taken in order of their ids. Null keys are one key; rows without a time are left out.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = 100
WINDOW = 60.0
BURST = 1.5


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds of a time with or without zone; a zone of the session has no say in the latter."""
    if rows.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def _time(rows: DataFrame, column: str, us: str) -> Column:
    """The time of the kind of the column that is so many microseconds."""
    if rows.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampadd(MICROSECOND, `{us}`, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return F.timestamp_micros(us)


class Limiter:
    """Times that were let through within the window, the oldest first; at most as many as the highest limit."""

    def __init__(self, window: float, held: tuple[float, ...] = ()):
        self.window, self.held = window, deque(held)

    def step(self, at: float, limit: int, burst: int) -> tuple[int, str]:
        """Requests in the window before this one, and what becomes of it; a rejected one leaves no trace."""
        while self.held and self.held[0] <= at - self.window:
            self.held.popleft()
        n = len(self.held)
        if n >= burst:
            return n, "rejected"
        self.held.append(at)
        return n, "allowed" if n < limit else "burst"


def with_limits(requests: DataFrame, limits: DataFrame, default: int = DEFAULT, burst: float = BURST) -> DataFrame:
    """requests (path, ...) with the columns allowance (of the longest prefix of its path in limits (prefix, allowance);
    the default if none fits) and burst_limit. Prefixes meet paths by equality, once for each of their lengths."""
    named = limits.where("prefix IS NOT NULL").groupBy("prefix").agg(F.max("allowance").cast("long").alias("allowance"))
    sizes = sorted(r[0] for r in named.select(F.length("prefix")).distinct().collect())  # lengths of configured paths
    out = requests
    found = []
    for n in sizes:
        part = named.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("allowance").alias(f"_a{n}"))
        out = out.join(part, F.substring("path", 1, n) == F.col(f"_p{n}"), "left")
        found.insert(0, F.col(f"_a{n}"))
    allowance = F.coalesce(*found, F.lit(default).cast("long"))
    out = out.withColumn("allowance", allowance).drop(*[f"_{x}{n}" for n in sizes for x in "pa"])
    return out.withColumn("burst_limit", F.floor(F.col("allowance") * burst + 1e-9).cast("long"))


def _cut(rows: DataFrame, keys: list[str], pause: float) -> DataFrame:
    """rows (at in seconds) with the column stretch: a number that rises where the key pauses for at least `pause`.

    Times fall into buckets of that length; a bucket after an empty one starts a stretch. Only counts of buckets are put
    in order, one row a bucket, however many requests it has.
    """
    bucket = F.floor(F.col("at") / pause).cast("long")
    order = Window.partitionBy(*keys).orderBy("bucket")
    dealt = rows.withColumn("bucket", bucket)
    seen = dealt.select(*keys, "bucket").distinct()
    fresh = F.when(F.col("bucket") - F.lag("bucket").over(order) == 1, 0).otherwise(1)
    stretches = seen.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(order))
    named = stretches.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_bucket"), "stretch")
    same = (F.col("bucket") == F.col("_bucket"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.join(named, same).drop("bucket", "_bucket", *[f"_{k}" for k in keys])


def _fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str, names: list[str]) -> DataFrame:
    """Rows of each key in order through a fold that `start` makes; it yields output rows for each input row, and for
    None at the end of a key."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    met = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        step = start()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    if key is not None:
                        out.extend(step(None))
                    key, step = own, start()
                out.extend(step(row))
            cols = list(zip(*out, strict=True)) or [[]] * len(arrow)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
        out = list(step(None)) if key is not None else []
        cols = list(zip(*out, strict=True)) or [[]] * len(arrow)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return met.mapInArrow(run, kind).select(*names)


def rate_limit(requests: DataFrame, window: float = WINDOW) -> DataFrame:
    """What becomes of each request (client, request_id, ts, allowance, burst_limit): request_id, before (requests let
    through in the window before it), verdict (allowed, burst, rejected). The window is open at its start."""
    rows = requests.where("ts IS NOT NULL").select("client", "request_id", micros(requests, "ts").alias("us"), "allowance", "burst_limit").withColumn("at", F.col("us") / 1e6)
    rows = _cut(rows, ["client"], window)

    def start():
        held = Limiter(window)

        def step(row):
            if row is not None:
                yield row["request_id"], *held.step(row["at"], row["allowance"], row["burst_limit"])

        return step

    kind = requests.schema["request_id"].dataType.simpleString()
    return _fold(rows, ["client", "stretch"], ["us", "request_id"], start, f"request_id {kind}, before bigint, verdict string", ["request_id", "before", "verdict"])


def stream_rate_limit(requests: DataFrame, window: float = WINDOW, late: str = "2 hours") -> DataFrame:
    """rate_limit over a stream. Requests of a client wait until the watermark has passed them, so they are taken in
    order of time whatever batch they come in; state is what waits and what the window holds, and goes when both are
    empty."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = requests.schema["request_id"].dataType.simpleString()
    state = f"held array<double>, waiting array<struct<us:bigint,id:{kind},allowance:bigint,burst:bigint>>"

    def run(key, frames, held):
        past, waiting = held.get if held.exists else ([], [])
        waiting = [tuple(w) for w in waiting]
        for pdf in frames:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            waiting += list(zip(us.tolist(), pdf["request_id"].tolist(), pdf["allowance"].tolist(), pdf["burst_limit"].tolist(), strict=True))
        mark = held.getCurrentWatermarkMs() * 1000
        due = sorted(w for w in waiting if w[0] <= mark)
        waiting = [w for w in waiting if w[0] > mark]
        limiter, out = Limiter(window, tuple(past)), []
        for us, i, allowance, burst in due:
            out.append((i, *limiter.step(us / 1e6, allowance, burst)))
        live = [t for t in limiter.held if t > mark / 1e6 - window]
        if waiting or live:
            held.update((live, waiting))
            # To be called when the next waiting request, or else the end of the window, has passed.
            after = min((w[0] for w in waiting), default=int((live[-1] + window) * 1e6) if live else 0)
            held.setTimeoutTimestamp(max(after // 1000 + 1, mark // 1000 + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=["request_id", "before", "verdict"])

    timed = requests.where("ts IS NOT NULL").withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(run, f"request_id {kind}, before bigint, verdict string", state, "append", GroupStateTimeout.EventTimeTimeout)


def leases(events: DataFrame, ttl: float = 60.0) -> DataFrame:
    """Leases on jobs from the events (job, event_id, ts, worker, kind: claim, heartbeat, complete or fail): job, lease
    (from 1), worker, claimed, last_beat, ended, outcome (completed, failed, abandoned, or open at the end).

    A job is claimed if it is free: never claimed, or abandoned, that is without a heartbeat of its holder for more than
    twice the ttl. Other claims, and heartbeats and ends by others than the holder, leave no trace. A completed or failed
    job is not claimed again.
    """
    rows = events.where("ts IS NOT NULL").select("job", "event_id", micros(events, "ts").alias("us"), "worker", "kind")
    patience = math.floor(2 * ttl * 1e6)

    def start():
        job = {"n": 0, "worker": None, "claimed": 0, "beat": 0, "done": False, "id": None}

        def end(outcome: str, at: int | None) -> tuple:
            worker, job["worker"] = job["worker"], None
            return job["id"], job["n"], worker, job["claimed"], job["beat"], at, outcome

        def step(row):
            if row is None:
                if job["worker"] is not None:
                    yield end("open", None)
                return
            job["id"] = row["job"]
            if job["worker"] is not None and row["us"] - job["beat"] > patience:
                yield end("abandoned", job["beat"] + patience)
            if row["kind"] == "claim":
                if job["worker"] is None and not job["done"] and row["worker"] is not None:
                    job.update(n=job["n"] + 1, worker=row["worker"], claimed=row["us"], beat=row["us"])
            elif job["worker"] is not None and row["worker"] == job["worker"]:
                job["beat"] = row["us"]
                if row["kind"] in ("complete", "fail"):
                    job["done"] = True
                    yield end("completed" if row["kind"] == "complete" else "failed", row["us"])

        return step

    job, worker = (events.schema[c].dataType.simpleString() for c in ("job", "worker"))
    found = _fold(rows, ["job"], ["us", "event_id"], start, f"job {job}, lease bigint, worker {worker}, claimed bigint, last_beat bigint, ended bigint, outcome string", ["*"])
    return found.select("job", "lease", "worker", *[_time(events, "ts", c).alias(c) for c in ("claimed", "last_beat", "ended")], "outcome")


_LIMITED = """WITH RECURSIVE l AS (SELECT r.*, coalesce(arg_max(allowance, length(prefix)), 100) AS allowance FROM requests AS r LEFT JOIN endpoint_limits ON starts_with(path, prefix) GROUP BY ALL),
  e AS (SELECT *, floor(allowance * 1.5)::BIGINT AS burst, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS rn FROM l),
  f AS (SELECT client, rn, request_id, 0::BIGINT AS before, CASE WHEN allowance > 0 THEN 'allowed' WHEN burst > 0 THEN 'burst' ELSE 'rejected' END AS verdict, CASE WHEN burst > 0 THEN [us] ELSE [] END AS held FROM e WHERE rn = 1
    UNION ALL SELECT client, rn, request_id, len(h), CASE WHEN len(h) >= burst THEN 'rejected' WHEN len(h) < allowance THEN 'allowed' ELSE 'burst' END, CASE WHEN len(h) >= burst THEN h ELSE list_append(h, us) END
      FROM (SELECT e.*, list_filter(f.held, lambda x: x > e.us - 21600000000) AS h FROM f JOIN e ON e.client = f.client AND e.rn = f.rn + 1))
  SELECT request_id, before, verdict FROM f"""
_LEASES = """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS rn FROM job_events),
  s AS (SELECT job, 0::BIGINT AS rn, 0::BIGINT AS n, NULL::VARCHAR AS holder, 0::BIGINT AS beat, FALSE AS done, NULL::BIGINT AS gone, NULL::VARCHAR AS how, NULL::BIGINT AS gone_at, 0::BIGINT AS us, FALSE AS took FROM (SELECT DISTINCT job FROM e)
    UNION ALL SELECT job, rn, n + took::INT, CASE WHEN took THEN worker WHEN over THEN NULL ELSE h END, CASE WHEN took OR mine THEN us ELSE beat END, done OR over, CASE WHEN late OR over THEN n END, CASE WHEN late THEN 'abandoned' WHEN over AND kind = 'complete' THEN 'completed' WHEN over THEN 'failed' END, CASE WHEN late THEN beat + 86400000000 WHEN over THEN us END, us, took
      FROM (SELECT *, kind = 'claim' AND h IS NULL AND NOT done AS took, kind <> 'claim' AND h IS NOT NULL AND h = worker AS mine, kind IN ('complete', 'fail') AND h IS NOT NULL AND h = worker AS over FROM
        (SELECT e.job, e.rn, e.worker, e.kind, e.us, s.n, s.done, s.beat, s.holder IS NOT NULL AND e.us - s.beat > 86400000000 AS late, CASE WHEN s.holder IS NOT NULL AND e.us - s.beat > 86400000000 THEN NULL ELSE s.holder END AS h FROM s JOIN e ON e.job = s.job AND e.rn = s.rn + 1))),
  c AS (SELECT job, n, holder AS worker, us AS claimed FROM s WHERE took), b AS (SELECT job, n, max(beat) AS beat FROM s GROUP BY job, n), x AS (SELECT job, gone AS n, how, gone_at FROM s WHERE gone IS NOT NULL)
  SELECT c.job, c.n AS lease, c.worker, make_timestamp(claimed) AS claimed, make_timestamp(beat) AS last_beat, make_timestamp(gone_at) AS ended, coalesce(how, 'open') AS outcome FROM c JOIN b USING (job, n) LEFT JOIN x USING (job, n)"""
FUNCTIONS = {
    "k14_rate_limit": (lambda r, limits: rate_limit(with_limits(r, limits), 21600.0), ["requests", "endpoint_limits"], _LIMITED),
    "n02_leases": (lambda e: leases(e, 43200.0), ["job_events"], _LEASES),
}
