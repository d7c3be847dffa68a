"""Significance of experiment metrics: tails against closed forms, tests against plain Python, sequential tests by property."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from souq.functions.stats import gamma_ratio_half, student_two_sided_p
from souq.operators import significance as SG
from souq.operators.experiments import ab_metric_table

DAY = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, rows):
    """rows: (day offset, user, type, value)"""
    return spark.createDataFrame([(i, DAY + dt.timedelta(days=d, milliseconds=i), u, t, v, None) for i, (d, u, t, v) in enumerate(rows)], EVENTS)


def test_student_tail_against_closed_forms(spark):
    cases = []
    for t in (0.0, 0.1, 0.5, 1.0, 1.96, 3.0, 7.5, 25.0, 200.0):
        cases += [(t, 1.0, 1 - 2 / math.pi * math.atan(t)), (t, 2.0, 1 - t / math.sqrt(2 + t * t)),
                  (t, 4.0, 1 - t * (t * t + 6) / (t * t + 4) ** 1.5),
                  (t, 1e9, math.erfc(t / math.sqrt(2)))]
    # tables: P(|T| > 2.228139) = 0.05 at 10, 2.042272 at 30, 1.983971 at 100 degrees of freedom
    cases += [(2.2281388520, 10.0, 0.05), (2.0422724563, 30.0, 0.05), (1.9839715185, 100.0, 0.05), (-2.0422724563, 30.0, 0.05)]
    df = spark.createDataFrame(cases, "t double, dof double, want double")
    for r in df.withColumn("p", student_two_sided_p(F.col("t"), F.col("dof"))).collect():
        assert r.p == pytest.approx(r.want, abs=2e-7), r
    none = spark.createDataFrame([(None, 3.0), (1.0, None)], "t double, dof double")
    assert [r.p for r in none.select(student_two_sided_p(F.col("t"), F.col("dof")).alias("p")).collect()] == [None, None]


def test_gamma_ratio(spark):
    zs = [0.05, 0.5, 1.0, 2.5, 10.0, 123.4, 1e4]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(gamma_ratio_half(F.col("z")).alias("g")).collect()
    for z, r in zip(zs, got):
        assert r.g == pytest.approx(math.exp(math.lgamma(z + 0.5) - math.lgamma(z)), rel=1e-9)


def rows_for(seed, users=60, days=9, lift=0.0):
    g = random.Random(seed)
    out = []
    for u in range(users):
        taste = g.random()  # clicks of a user are alike
        for _ in range(g.randrange(1, 12)):
            kind = "view" if g.random() < 0.5 else "click" if g.random() < taste else "error"
            if g.random() < 0.1 + (lift if u % 2 else 0):
                kind = "purchase"
            out.append((g.randrange(days), u, kind, round(g.random() * 100, 2)))
    return out


def plain(rows, metric):
    """(ratio, variance, n) per variant from the linearised values of every user."""
    out = []
    for v in (0, 1):
        users = sorted({u for _, u, _, _ in rows if u % 2 == v})
        y, x = [], []
        for u in users:
            mine = [(t, val) for _, w, t, val in rows if w == u]
            if metric == "CTR":
                y.append(sum(t == "click" for t, _ in mine))
                x.append(sum(t == "view" for t, _ in mine))
            else:
                y.append(sum(val for t, val in mine if t == "purchase"))
                x.append(sum(t == "purchase" for t, _ in mine))
        ratio, mean = sum(y) / sum(x), sum(x) / len(x)
        e = [(b - ratio * a) / mean for a, b in zip(x, y)]
        out.append((ratio, statistics.variance(e) / len(e), len(e)))
    return out


def test_ratio_metrics_take_users_not_events_as_independent(spark):
    rows = rows_for(1)
    ledger = {r.metric: r for r in SG.ab_significance(events(spark, rows)).collect()}
    assert tuple(ledger) == SG.LEDGER
    for metric in ("CTR", "AOV"):
        (rc, vc, nc), (rt, vt, nt) = plain(rows, metric)
        r = ledger[metric]
        assert (r.control, r.treatment) == (pytest.approx(rc, abs=1e-6), pytest.approx(rt, abs=1e-6))
        assert r.std_error == pytest.approx(math.sqrt(vc + vt), abs=1e-6)
        assert r.statistic == pytest.approx((rt - rc) / math.sqrt(vc + vt), abs=1e-5)
        assert r.dof == pytest.approx((vc + vt) ** 2 / (vc ** 2 / (nc - 1) + vt ** 2 / (nt - 1)), abs=1e-4)
        assert r.ci_low < r.abs_uplift < r.ci_high and 0 <= r.p_value <= 1
        assert (r.p_value < 0.05) == (not r.ci_low <= 0 <= r.ci_high)
    assert all(ledger[m].p_value is not None for m in SG.LEDGER)
    table = {r.metric: r for r in ab_metric_table(events(spark, rows)).collect()}
    assert {m: r.p_value for m, r in table.items()} == {m: r.p_value for m, r in ledger.items()}


def test_repeating_every_event_does_not_make_a_ratio_more_certain(spark):
    """The same events twice are no new users: the ratio, its error and its p-value stay."""
    rows = rows_for(5)
    once = {r.metric: r for r in SG.ab_significance(events(spark, rows)).collect()}
    twice = {r.metric: r for r in SG.ab_significance(events(spark, rows + rows)).collect()}
    for m in ("CTR", "AOV"):
        assert once[m].p_value == pytest.approx(twice[m].p_value, abs=2e-6)
        assert once[m].std_error == pytest.approx(twice[m].std_error, abs=2e-6)


def test_ledger_without_enough_data(spark):
    for rows in ([], [(0, 1, "view", 1.0)], [(0, 1, "purchase", 5.0), (0, 2, "purchase", 5.0)]):
        ledger = SG.ab_significance(events(spark, rows)).collect()
        assert [r.metric for r in ledger] == list(SG.LEDGER)
        assert all(r.p_value is None for r in ledger if r.method != "two-proportion")


def by_day(rows, until):
    return [r for r in rows if r[0] <= until]


def test_sequential_tests_day_by_day(spark):
    rows = [r for r in rows_for(8, users=300, days=12, lift=0.3) if r[0] not in (4, 5)]  # two days without events
    cvr = SG.ab_sequential_cvr(events(spark, rows)).orderBy("day").collect()
    rev = SG.ab_sequential_revenue(events(spark, rows)).orderBy("day").collect()
    assert len(cvr) == len(rev) == max(r[0] for r in rows) - min(r[0] for r in rows) + 1
    low = 1.0
    for r in cvr:
        d = (r.day - DAY.date()).days
        n, k = [0, 0], [0, 0]
        for v in (0, 1):
            seen = {u for _, u, _, _ in by_day(rows, d) if u % 2 == v}
            n[v], k[v] = len(seen), len({u for _, u, t, _ in by_day(rows, d) if u % 2 == v and t == "purchase"})
        assert (r.users_c, r.users_t, r.buyers_c, r.buyers_t) == (n[0], n[1], k[0], k[1])
        p = [k[v] / n[v] for v in (0, 1)]
        var, tau2 = sum(p[v] * (1 - p[v]) / n[v] for v in (0, 1)), 0.05 ** 2
        ratio = math.sqrt(var / (var + tau2)) * math.exp(tau2 * (p[1] - p[0]) ** 2 / (2 * var * (var + tau2)))
        low = min(low, 1 / ratio)
        assert r.p_value == pytest.approx(low, abs=2e-6) and r.significant == (low <= 0.05)
        assert r.ci_low < r.abs_uplift < r.ci_high
    assert cvr[-1].significant
    for r in rev:
        d = (r.day - DAY.date()).days
        for v, n, total, mean in ((0, r.users_c, r.revenue_c, r.arpu_c), (1, r.users_t, r.revenue_t, r.arpu_t)):
            users = {u: 0.0 for _, u, _, _ in by_day(rows, d) if u % 2 == v}
            for _, u, t, x in by_day(rows, d):
                if u in users and t == "purchase":
                    users[u] += x
            assert n == len(users) and float(total) == pytest.approx(sum(users.values()))
            assert mean == pytest.approx(statistics.mean(users.values()), abs=1e-6)
    ps = [r.p_value for r in rev]
    assert ps == sorted(ps, reverse=True) and ps[0] <= 1
    last = rev[-1]
    users = {u: 0.0 for _, u, _, _ in rows}
    for _, u, t, x in rows:
        users[u] += x if t == "purchase" else 0
    var = sum(statistics.variance([x for u, x in users.items() if u % 2 == v]) / sum(u % 2 == v for u in users) for v in (0, 1))
    want = 0.5 * math.log(var / (var + 2500)) + 2500 * last.abs_uplift ** 2 / (2 * var * (var + 2500))
    assert last.log_likelihood_ratio == pytest.approx(want, abs=1e-5)


def test_sequential_p_value_keeps_its_level_under_daily_looks(spark):
    """Without an effect, reading the p-value every day gives few false alarms (a fixed-size test gives many)."""
    false = 0
    for seed in range(12):
        rows = rows_for(100 + seed, users=120, days=10)
        false += any(r.significant for r in SG.ab_sequential_cvr(events(spark, rows)).collect())
    assert false <= 2


def test_sequential_edge_cases(spark):
    assert SG.ab_sequential_cvr(events(spark, [])).count() == 0
    assert SG.ab_sequential_revenue(events(spark, [])).count() == 0
    one = SG.ab_sequential_cvr(events(spark, [(0, 2, "view", 1.0), (2, 2, "purchase", 1.0)])).orderBy("day").collect()
    assert [(r.users_c, r.users_t, r.buyers_c, r.p_value, r.significant) for r in one] == [
        (1, 0, 0, 1.0, False), (1, 0, 0, 1.0, False), (1, 0, 1, 1.0, False)]
    null = spark.createDataFrame([(1, None, 2, "purchase", 1.0, None), (2, DAY, 3, "purchase", None, None)], EVENTS)
    assert [(r.users_c, r.users_t, r.revenue_t) for r in SG.ab_sequential_revenue(null).collect()] == [(0, 1, 0)]
