from datetime import datetime, timedelta

import pytest

from pulsegrid.operators import sessions

T0 = datetime(2024, 1, 1, 9)


def at(spark, minutes, **extra):
    rows = [("u", T0 + timedelta(minutes=m), 1000 * (i + 1)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "user_id string, timestamp timestamp, duration_ms int")


def test_gap_splits_and_equal_gap_joins(spark):
    assert sessions.session_metrics(at(spark, [0, 10, 20, 55, 60])).count() == 2
    assert sessions.session_metrics(at(spark, [0, 30])).count() == 1
    assert sessions.session_metrics(at(spark, [0, 30.02])).count() == 2


def test_bounce_lasts_its_action(spark):
    r = sessions.session_metrics(at(spark, [0])).head()
    assert (r.session_id, r.session_duration_ms, r.is_bounce, r.action_count) == ("u_20240101090000", 1000, True, 1)
    assert r.session_end_time == T0 + timedelta(minutes=30) and r.last_event_time == T0


def test_duration_adds_last_action(spark):
    r = sessions.session_metrics(at(spark, [0, 5])).head()
    assert r.session_duration_ms == 5 * 60_000 + 2000 and r.session_duration_seconds == 302.0


def test_incoming_session_id_is_replaced_and_extras_kept(spark):
    rows = [("u", T0, 1, "old", "x"), ("u", T0 + timedelta(minutes=1), 1, "old", "y"), ("u", None, 1, "old", "z")]
    out = sessions.session_metrics(spark.createDataFrame(rows, "user_id string, timestamp timestamp, duration_ms int, session_id string, device_type string"))
    assert out.columns.count("session_id") == 1
    assert [(r.device_type, r.action_count) for r in out.collect()] == [("x", 2)]


@pytest.mark.parametrize("bad", ["30 minutes", "", 0, -5, "0 seconds", None, True])
def test_bad_timeouts(bad):
    with pytest.raises(ValueError):
        sessions.timeout_seconds(bad)


def test_good_timeouts():
    assert [sessions.timeout_seconds(x) for x in (5, "1 second", " 600  SECONDS ")] == [5, 1, 600]


def test_frequency_and_bounce(spark):
    s = sessions.session_metrics(at(spark, [0, 60, 120, 121, 60 * 24]))
    f = sessions.session_frequency(s).head()
    assert (f.total_sessions, f.active_days, f.avg_sessions_per_day) == (4, 2, 2.0)
    b = sessions.bounce_rate(s).head()
    assert (b.total_sessions, b.bounced_sessions, b.bounce_rate) == (4, 3, 75.0)
    none = sessions.bounce_rate(s.limit(0)).head()
    assert (none.total_sessions, none.bounced_sessions, none.bounce_rate) == (0, None, 0.0)
