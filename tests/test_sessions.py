"""Sessions of polls from a stream: repeated, delayed and late polls."""
from datetime import datetime, timedelta

from chatterlens.session import scratch_path
from chatterlens.streaming import fronts as Z

KIND = "post_id long, ts timestamp, score double"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def drive(spark, arrivals):
    """Arrivals one after another, each a list of (post, minute, score)."""
    source, run, late = scratch_path(spark, "polls"), None, {}
    for rows in arrivals:
        spark.createDataFrame([(p, at(m), s) for p, m, s in rows], KIND).write.mode("append").parquet(source)
        run = Z.run_available_now(Z.session_stream(spark.readStream.schema(KIND).parquet(source)), "sessions", run, "append", late)
    kind = "post_id long, first_score double, last_score double, first_ts timestamp, last_ts timestamp, polls long"
    out = spark.read.schema(kind).parquet(run[0]).collect()
    return sorted(((r.post_id, (r.first_ts - T0).seconds // 60, (r.last_ts - T0).seconds // 60, r.first_score, r.last_score, r.polls)
                   for r in out)), late


END = [(None, 1400, None)]


def test_sessions_repeated_and_delayed_polls(spark):
    first = [(1, 0, 5.0), (1, 60, 6.0), (2, 10, 1.0), (1, 60, 6.0)]
    # sent again, delayed by less than three hours, and a gap of 66 minutes
    second = [(1, 60, 6.0), (1, 120, 9.0), (2, 5, 0.0), (2, 76, 2.0)]
    third = [(1, 400, 1.0), (1, 120, 9.0)]
    rows, late = drive(spark, [first, second, third, END])
    assert rows == [(1, 0, 120, 5.0, 9.0, 3), (1, 400, 400, 1.0, 1.0, 1), (2, 5, 10, 0.0, 1.0, 2), (2, 76, 76, 2.0, 2.0, 1)]


def test_a_poll_at_the_end_of_the_gap_goes_on_with_the_session(spark):
    rows, _ = drive(spark, [[(1, 0, 1.0), (1, 65, 2.0), (2, 0, 1.0), (2, 66, 2.0)], END])
    assert [r[-1] for r in rows] == [2, 1, 1]


def test_late_polls_are_left_out_and_counted(spark):
    rows, late = drive(spark, [[(1, 0, 1.0), (1, 600, 2.0)], [(1, 700, 3.0)], [(1, 10, 4.0), (1, 20, 5.0), (1, 0, 1.0), (1, 690, 7.0)], END])
    assert rows == [(1, 0, 0, 1.0, 1.0, 1), (1, 600, 600, 2.0, 2.0, 1), (1, 690, 700, 7.0, 3.0, 2)]
    assert sum(late.values()) == 3


def test_two_scores_at_one_time_and_null_posts(spark):
    rows, _ = drive(spark, [[(1, 0, 2.0), (1, 0, 1.0), (None, 3, 1.0)], END])
    assert rows == [(1, 0, 0, 1.0, 2.0, 2)]
