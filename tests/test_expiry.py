from datetime import datetime, timedelta

from evitrace.streaming import expiry
from evitrace.streaming.numbering import keyed_state

RECORDS = "org_key string, identity string, at timestamp, expires_at timestamp, max_age_days double"
CHANGES = "org_key string, identity string, observed_at timestamp, step int, status string, expires_at timestamp"
DAY0 = datetime(2024, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def seen(key, identity, at, until=None):
    return (key, identity, day(at), None if until is None else day(until), None)


def rule(at, age):
    return (None, None, day(at), None, float(age))


class Stream:
    """Waves of records through one stream that goes on from its checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, str(folder), options

    def send(self, *rows):
        self.spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        with keyed_state(self.spark):
            changes = expiry.expiry_stream(self.spark.readStream.schema(RECORDS).parquet(f"{self.folder}/in"), parts=4, **self.options)
            query = changes.writeStream.format("parquet").option("path", f"{self.folder}/out").option(
                "checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        self.held = query.lastProgress.stateOperators[0].numRowsTotal
        return self

    def changes(self):
        return self.spark.read.schema(CHANGES).parquet(f"{self.folder}/out")

    def now(self):
        return {(r.org_key, r.identity): (r.status.removeprefix("org-"), r.expires_at) for r in expiry.current_blocks(self.changes()).collect()}


def test_timers_policies_and_renewals(spark, tmp_path):
    stream = Stream(spark, tmp_path, max_age_days=10)
    stream.send(seen("a", "x", 0, 3), seen("a", "y", 0, 30), seen("b", "x", 1), seen(None, None, 1, 6))
    assert stream.now() == {("a", "x"): ("fresh", day(3)), ("a", "y"): ("fresh", day(10)), ("b", "x"): ("fresh", day(11)), (None, None): ("fresh", day(6))}
    # Another block moves the clock to the very instant at which a:x ends.
    stream.send(seen("c", "z", 3))
    assert stream.now()["a", "x"] == ("expired", day(3)) and stream.now()["c", "z"] == ("fresh", day(13))
    # A tighter policy ends what was observed long ago at once and brings the rest forward.
    stream.send(rule(4, 3.5))
    assert stream.now() == {("a", "x"): ("expired", day(3)), ("a", "y"): ("expired", day(3.5)), ("b", "x"): ("fresh", day(4.5)),
                            (None, None): ("fresh", day(4.5)), ("c", "z"): ("fresh", day(6.5))}
    # Renewed before its end, the other two run out by their timers; a looser policy puts ends back.
    stream.send(seen("b", "x", 4.25), seen("c", "z", 4.25, 5), seen("d", "w", 4.75))
    assert stream.now()["b", "x"] == ("fresh", day(7.75)) and stream.now()[None, None] == ("expired", day(4.5))
    stream.send(rule(5.5, 6))
    assert stream.now() == {("a", "x"): ("expired", day(3)), ("a", "y"): ("fresh", day(6)), ("b", "x"): ("fresh", day(10.25)),
                            (None, None): ("fresh", day(6)), ("c", "z"): ("expired", day(5)), ("d", "w"): ("fresh", day(10.75))}
    rows = [tuple(r) for r in stream.changes().collect()]
    assert len({r[:4] for r in rows}) == len(rows)  # every step is said once


def test_forgotten_blocks_leave_the_state(spark, tmp_path):
    stream = Stream(spark, tmp_path, max_age_days=1, forget=True)
    stream.send(*[seen("a", f"n{i}", 0) for i in range(200)])
    before = stream.held
    stream.send(seen("a", "late", 3), seen("a", "late", 3), seen("a", "n7", 3))
    assert before >= 200 and stream.held < 20
    now = stream.now()
    assert len(now) == 201 and sorted(k[1] for k, v in now.items() if v[0] == "fresh") == ["late", "n7"]


def test_no_records_ties_and_null_instants(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.send()
    assert stream.now() == {}
    stream.send(("a", "x", None, day(3), None), seen("a", "y", 1, 4), seen("a", "y", 1, 6), rule(1, 9), rule(1, 2))
    assert stream.now() == {("a", "y"): ("fresh", day(3))}
