"""Sessions against a plain per-user loop, plus the edge rows."""

import random
from collections import defaultdict

import pytest

from tests.conftest import plan_of, rows
from tributary.operators.analytics import session_input
from tributary.operators.sessions import native_sessions, sessionize
from tributary.sources.local import local_frame

SCHEMA = (
    "tenant_slug string, source_platform string, user_pseudo_id string, user_id string, event_name string,"
    " event_timestamp bigint, traffic_source string, traffic_medium string, traffic_campaign string,"
    " geo_country string, device_category string, transaction_id string, purchase_revenue double, session_id string"
)
MINUTE = 60_000_000


def event(user, ts, name="view_item", source="google", transaction="N/A", revenue=0.0, tenant="t0", session=None):
    return (
        tenant, "google_analytics", user, None if user is None else f"id_{user}", name, ts, source, "cpc", "c", "US",
        "mobile", transaction, revenue, session,
    )


def ga(spark, events, conversions=("purchase",), gap_seconds=1800):
    return sessionize(
        local_frame(spark, events, SCHEMA), session_input("google_analytics", gap_seconds), list(conversions)
    )


def expected_bounds(events, gap):
    """(tenant, user, number) -> (start, end, count) by walking each user's events in order."""
    users = defaultdict(list)
    for e in events:
        users[(e[0], e[2])].append(e[5])
    result = {}
    for (tenant, user), stamps in users.items():
        known = sorted(t for t in stamps if t is not None)
        missing = len(stamps) - len(known)
        number, previous, sessions = 0, None, defaultdict(list)
        for t in known:
            if previous is None or t - previous > gap:
                number += 1
            sessions[number].append(t)
            previous = t
        if missing:
            number += missing - (1 if known else 0)
            sessions[number] += [None] * missing
        for n, ts in sessions.items():
            seen = [t for t in ts if t is not None]
            result[(tenant, user, n)] = (min(seen, default=None), max(seen, default=None), len(ts))
    return result


@pytest.mark.parametrize("seed", range(4))
def test_matches_a_per_user_walk(spark, seed):
    rng = random.Random(seed)
    gap = 1800 * 1_000_000
    events = []
    for _ in range(400):
        user = rng.choice(["a", "a", "a", "b", "c", None])
        base = rng.choice([0, gap, 3 * gap, -2 * gap, 10 * gap])
        ts = None if rng.random() < 0.02 else base + rng.choice([0, 1, gap - 1, gap, gap + 1, rng.randrange(gap)])
        events.append(event(user, ts, tenant=rng.choice(["t0", "t1"])))
    got = {
        (r.tenant_slug, r.user_pseudo_id, int(r.session_id.rsplit("-", 1)[1])): (
            r.session_start_ts, r.session_end_ts, r.events_in_session,
        )
        for r in ga(spark, events).collect()
        if r.session_id is not None
    }
    want = {k: v for k, v in expected_bounds(events, gap).items() if k[1] is not None}
    assert got == want
    anonymous = [v for k, v in expected_bounds(events, gap).items() if k[1] is None]
    nameless = ga(spark, events).filter("user_pseudo_id IS NULL")
    assert rows(nameless, "session_start_ts", "session_end_ts", "events_in_session") == sorted(anonymous, key=repr)


def test_gap_is_strict(spark):
    exact = [event("u", 0), event("u", 30 * MINUTE)]
    assert ga(spark, exact).count() == 1
    assert ga(spark, [*exact, event("u", 60 * MINUTE + 1)]).count() == 2


def test_first_touch_skips_missing_values(spark):
    events = [event("u", 0, source=None), event("u", 5, source="email"), event("u", 9, source="direct")]
    assert rows(ga(spark, events), "traffic_source") == [("email",)]


def test_ties_are_deterministic(spark):
    events = [event("u", 0, source="b"), event("u", 0, source="a")]
    assert rows(ga(spark, events), "traffic_source", "events_in_session") == [("a", 2)]
    assert rows(ga(spark, events[::-1]), "traffic_source") == [("a",)]


def test_funnel_conversion_and_revenue(spark):
    events = [
        event("u", 0, "session_start"),
        event("u", 1, "exception"),
        event("u", 2, "purchase", transaction="7", revenue=12.5),
        event("v", 0, "exception"),
    ]
    got = rows(
        ga(spark, events), "user_pseudo_id", "funnel_max_step", "funnel_step_6_purchase", "funnel_conversion_count",
        "is_conversion_session", "session_revenue", "transaction_id",
    )
    assert got == [("u", 6, 1, 1, True, 12.5, "7"), ("v", 0, 0, 0, False, 0.0, None)]
    assert not any(r[0] for r in rows(ga(spark, events, conversions=()), "is_conversion_session"))


def test_step_counts_agree_with_the_deepest_step(spark, sf):
    from validation.star_cases import ga_sessions

    df = ga_sessions(spark, sf, 86_400)
    steps = " + ".join(c for c in df.columns if c.startswith("funnel_step_"))
    assert df.filter(f"(funnel_max_step > 0) <> ({steps} > 0)").count() == 0
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert df.selectExpr("sum(events_in_session)").first()[0] == events


def test_independent_of_partitioning(spark, sf):
    from validation.inputs import ga_events

    source = session_input("google_analytics", 86_400)
    base = rows(sessionize(ga_events(spark, sf), source, ["purchase"]).drop("session_revenue"))
    for parts in (1, 7):
        again = sessionize(ga_events(spark, sf).repartition(parts), source, ["purchase"])
        assert rows(again.drop("session_revenue")) == base


def test_busy_user_is_aggregated_before_the_user_window(spark):
    """The per-user window reads slot summaries: one row per gap length, not per event."""
    busy = [event("hot", i) for i in range(2_000)]
    df = ga(spark, busy)
    assert rows(df, "events_in_session") == [(2_000,)]
    plan = plan_of(df)
    window, partial = plan.index("Window"), plan.rindex("partial_count")
    assert window < partial  # the printed tree is top-down: aggregation happens below the window


def test_native_sessions_drop_events_without_id(spark):
    events = [event("u", 0, session="s1"), event("u", 4_000, session="s1"), event("u", 9, session=None)]
    df = native_sessions(local_frame(spark, events, SCHEMA), session_input("amplitude"), ["purchase"])
    assert rows(df, "session_id", "events_in_session", "session_duration_seconds", "session_revenue") == [
        ("s1", 2, 4.0, 0.0)
    ]
