import datetime as dt, random
from ratlas.operators import artifacts
from ratlas.sources.keyed import KeyedTable
from ratlas.streaming import job_states


def test_states_follow_events(spark, tmp_path):
    rnd, day = random.Random(3), dt.datetime(2024, 5, 1)
    events = [(f"j{rnd.randrange(12)}", day + dt.timedelta(minutes=rnd.randrange(600)), rnd.choice(["queued", "running", "done", "error"]), rnd.choice([None, "", "x"])) for _ in range(90)]
    events.sort(key=lambda e: e[1] + dt.timedelta(minutes=rnd.randrange(25)))  # out of order by less than is allowed for
    events += [events[-1], (None, day, "done", ""), ("j1", None, "done", "")]
    land, target, check = (f"file://{tmp_path}/{x}" for x in ("land", "states", "check"))
    seen = []
    for start in range(0, len(events), 31):  # the stream is stopped and started again between the parts
        part = events[start : start + 31]
        seen += part
        spark.createDataFrame(part, job_states.EVENTS).coalesce(1).write.mode("append").parquet(land)
        job_states.follow(spark, land, target, check, silence="2 hours", late="30 minutes").awaitTermination()
        got = {r.job_id: (r.at, r.status, r.error_message) for r in KeyedTable(spark, target, job_states.STATES, "job_id").read().collect()}
        known = spark.createDataFrame(seen, job_states.EVENTS).where("job_id IS NOT NULL AND at IS NOT NULL")
        assert got == {r.job_id: (r.at, r.status, r.error_message) for r in artifacts.current_states(known).collect()}
    latest = max(e[1] for e in events if e[1])
    late = spark.createDataFrame([("other", latest + dt.timedelta(hours=5), "done", "")], job_states.EVENTS)
    late.coalesce(1).write.mode("append").parquet(land)
    job_states.follow(spark, land, target, check, silence="2 hours", late="30 minutes").awaitTermination()
    out = KeyedTable(spark, target, job_states.STATES, "job_id").read().collect()
    assert {r.job_id for r in out if r.stalled} == {r.job_id for r in out if r.status in job_states.ACTIVE} and any(r.stalled for r in out)
