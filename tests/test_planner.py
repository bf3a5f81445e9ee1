"""Schedule planning against plain loops over random fleets."""

from __future__ import annotations

import random

import pytest

from harvestry.operators import planner
from harvestry.operators.helpers import DAY, IST_MS

GAP = 90_000


def loop_pack(wishes):
    placed = []
    for wish, _ in sorted((w, i) for i, w in wishes):
        at = wish
        while near := [p for p in placed if abs(p - at) < GAP]:
            at = max(at + GAP, max(near) + GAP)
        placed.append(at)
    return sorted(placed)


@pytest.mark.parametrize(("n", "span"), [(60, 3_600_000), (300, 7 * 3_600_000), (200, 200 * 3_600_000), (40, 1), (1, 1)])
def test_packing_against_a_loop(spark, n, span):
    rng = random.Random(n)
    wishes = [(i, 1_700_000_000_000 + rng.randrange(span)) for i in range(n)]
    got = planner.packed(spark.createDataFrame([*wishes, (999, None)], "id long, preferred long")).collect()
    assert sorted(r.placed for r in got) == loop_pack(wishes)
    assert {r.id: r.preferred for r in got} == dict(wishes)


@pytest.mark.parametrize(("n", "span"), [(13_000, 400_000), (13_000, 13_000 * 90_000), (13_000, 13_000 * 130_000)])
def test_packing_of_a_large_fleet(spark, n, span):
    rng = random.Random(span)
    wishes = [(i, 1_700_000_000_000 + rng.randrange(span)) for i in range(n)]
    want, last = {}, None
    for wish, i in sorted((w, i) for i, w in wishes):
        want[i] = last = wish if last is None or wish - last >= GAP else max(wish, last) + GAP
    assert {r.id: r.placed for r in planner.packed(spark.createDataFrame(wishes, "id long, preferred long")).collect()} == want


def loop_plan(daily, fixed, now):
    counts, taken = [0] * 24, [[] for _ in range(24)]
    for hour, offset in fixed:
        counts[hour % 24] += 1
        taken[hour % 24].append(offset)
    chosen = []
    for i, hour in sorted(daily, key=lambda r: (99 if r[1] is None else r[1], r[0])):
        least = [h for h in range(24) if counts[h] == min(counts)]
        pick = hour if hour in least else least[0]
        counts[pick] += 1
        chosen.append((i, pick))
    out = {}
    for hour in range(24):
        for i in [i for i, h in chosen if h == hour]:
            free = [t for t in [*range(0, 3600, 90), *range(3600)] if all(abs(o - t) >= 90 for o in taken[hour])]
            t = free[0] if free else 3510
            taken[hour].append(t)
            at = (now + IST_MS) // DAY * DAY - IST_MS + hour * 3_600_000 + t * 1000
            out[i] = (hour, t, at if at > now else at + DAY)
    return out, counts


@pytest.mark.parametrize(("n", "m", "spread"), [(100, 10, 24), (500, 200, 3), (1500, 60, 24), (0, 5, 24), (7, 0, 24)])
def test_daily_plan_against_a_loop(spark, n, m, spread):
    rng = random.Random(n)
    daily = [(i, rng.choice([None, *range(24)])) for i in range(n)]
    fixed = [(rng.randrange(spread), rng.randrange(3600)) for _ in range(m)]
    now = 1_700_000_000_000
    got = planner.daily_plan(spark.createDataFrame(daily, "id long, current_hour int"), spark.createDataFrame(fixed, "hour int, offset int"), now).collect()
    want, counts = loop_plan(daily, fixed, now)
    assert {r.id: (r.hour, r.offset, r.next_ms) for r in got} == want
    level = max([counts[h] for h in range(24) if any(w[0] == h for w in want.values())], default=0)
    assert all(level - c <= 1 for c in counts)  # no hour is left more than one behind: the rule's second step finds nothing to move
