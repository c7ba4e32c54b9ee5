"""The limiter and the leases: batch equals stream equals plain Python."""

import datetime
import random
import uuid

import pytest

from tideglass.functions.scratch import new_path
from tideglass.operators import state

START = datetime.datetime(2024, 1, 1)


def requests(seed, n=400):
    rng = random.Random(seed)
    rows, at = [], {c: 0.0 for c in (None, "a", "b", "busy")}
    for i in range(n):
        c = rng.choice([None, "a", "b", "busy", "busy", "busy"])
        at[c] += rng.choice([0, 0.5, 3, 7, 20, 61, 200] if c != "busy" else [0, 0.2, 1])
        rows.append((c, i, START + datetime.timedelta(seconds=at[c]), *rng.choice([(2, 3), (4, 6), (1, 1)])))
    rng.shuffle(rows)
    return rows


SCHEMA = "client string, request_id long, ts timestamp, allowance long, burst_limit long"


def limited(rows, window):
    out, held = {}, {}
    for c, i, ts, allowance, burst in sorted(rows, key=lambda r: (r[2], r[1])):
        past = held.setdefault(c, [])
        live = [t for t in past if t > ts - datetime.timedelta(seconds=window)]
        out[i] = (len(live), "rejected" if len(live) >= burst else "allowed" if len(live) < allowance else "burst")
        if len(live) < burst:
            past.append(ts)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_limiter_equals_brute_force(spark, seed):
    rows = requests(seed)
    got = {r["request_id"]: (r["before"], r["verdict"]) for r in state.rate_limit(spark.createDataFrame(rows, SCHEMA), 30.0).collect()}
    want = limited(rows, 30.0)
    assert got == want and {v for _, v in want.values()} == {"allowed", "burst", "rejected"}


def test_rejected_requests_leave_no_trace(spark):
    """Three an hour, one request each ten minutes: the seventh is let in again."""
    rows = [("u", i, START + datetime.timedelta(minutes=10 * i), 3, 3) for i in range(14)]
    got = [r["verdict"] for r in state.rate_limit(spark.createDataFrame(rows, SCHEMA), 3600.0).orderBy("request_id").collect()]
    assert got == ["allowed"] * 3 + ["rejected"] * 3 + ["allowed"] * 3 + ["rejected"] * 3 + ["allowed"] * 2


def test_stream_equals_batch(spark):
    rows = [r for r in requests(4, 300) if r[0] is not None]
    path = new_path(spark, "requests")
    ordered = sorted(rows, key=lambda r: r[2])
    # Files arrive with their rows out of order, within what the watermark waits for; the last one drives it past all.
    for i in range(0, len(ordered), 60):
        spark.createDataFrame(ordered[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", -1, START + datetime.timedelta(days=3), 1, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    name = f"limited_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    state.stream_rate_limit(stream, 30.0, "1 hour").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", new_path(spark, "limiter")).trigger(availableNow=True).start().awaitTermination()
    got = {r["request_id"]: (r["before"], r["verdict"]) for r in spark.table(name).collect()}
    want = limited(rows, 30.0)
    assert {i: got[i] for i in got if i >= 0} == want


def test_longest_prefix_gives_the_limit(spark):
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(["/v1/search/x", "/v1/search", "/v1/other", "/x", None, "/v1/reports/jobs/7"])], "request_id long, path string")
    limits = spark.createDataFrame([("/v1/", 7), ("/v1/search", 50), ("/v1/reports/", 200), ("/v1/reports/jobs", 3), (None, 1)], "prefix string, allowance int")
    got = {r["request_id"]: (r["allowance"], r["burst_limit"]) for r in state.with_limits(paths, limits).collect()}
    assert got == {0: (50, 75), 1: (50, 75), 2: (7, 10), 3: (100, 150), 4: (100, 150), 5: (3, 4)}


def held(rows, patience):
    out, jobs = [], {}
    for job, _, us, worker, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        j = jobs.setdefault(job, {"n": 0, "w": None, "done": False})
        if j["w"] and us - j["beat"] > patience:
            out.append((job, j["n"], j["w"], j["from"], j["beat"], j["beat"] + patience, "abandoned"))
            j["w"] = None
        if kind == "claim":
            if j["w"] is None and not j["done"]:
                j.update({"n": j["n"] + 1, "w": worker, "from": us, "beat": us})
        elif j["w"] == worker:
            j["beat"] = us
            if kind in ("complete", "fail"):
                out.append((job, j["n"], worker, j["from"], us, us, {"complete": "completed", "fail": "failed"}[kind]))
                j.update({"w": None, "done": True})
    return sorted(out + [(k, j["n"], j["w"], j["from"], j["beat"], None, "open") for k, j in jobs.items() if j["w"]])


def test_leases_equal_brute_force(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([1, 5, 20, 90])
        rows.append((f"j{rng.randrange(30)}", i, at, rng.choice("xyz"), rng.choice(["claim", "claim", "heartbeat", "heartbeat", "heartbeat", "complete" if rng.random() < 0.1 else "heartbeat", "fail" if rng.random() < 0.2 else "claim"])))
    frame = spark.createDataFrame([(j, i, START + datetime.timedelta(seconds=s), w, k) for j, i, s, w, k in rows], "job string, event_id long, ts timestamp, worker string, kind string")
    seconds = lambda t: None if t is None else round((t - START).total_seconds())
    got = sorted((r["job"], r["lease"], r["worker"], *(seconds(r[c]) for c in ("claimed", "last_beat", "ended")), r["outcome"]) for r in state.leases(frame, 60.0).collect())
    want = held(rows, 120)
    assert got == want and {r[-1] for r in want} == {"abandoned", "completed", "failed", "open"}


def test_no_requests(spark):
    assert state.rate_limit(spark.createDataFrame([], SCHEMA)).collect() == []
    assert state.leases(spark.createDataFrame([("j", 1, None, "w", "claim")], "job string, event_id long, ts timestamp, worker string, kind string")).collect() == []
