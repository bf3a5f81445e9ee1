"""Conditions against a plain evaluator over random states, and what is refused."""

from __future__ import annotations

import io
import random
import re
from contextlib import redirect_stdout

import pytest

from harvestry.operators import workflow

URLS, NAMES, TAGS, ACTIONS = ["http://a/1", "http://a/2x", "http://b/1", "", None], ["s", "t"], ["p", "li", "h1"], ["goto", "click", "scroll"]


def meets(value, held) -> bool:
    return bool(held) and (re.search(value["$regex"], held) is not None if isinstance(value, dict) else held == value)


def holds(where, state, used=()) -> bool:
    """A condition looked at part by part, as it is defined."""
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = value if isinstance(value, list) else [{k: v} for k, v in value.items()]
            ok = (all if key == "$and" else any)(holds(p, state) for p in parts)
        elif key == "$not":
            ok = not holds(value, state)
        elif key in ("$before", "$after"):
            ok = any(meets(value, a) for a in used) == (key == "$after")
        elif key == "url":
            ok = meets(value, state["url"])
        elif key == "cookies":
            ok = state["cookies"] is not None and all(meets(v, state["cookies"].get(k)) for k, v in value.items())
        else:
            ok = state["selectors"] is not None and (any(s in state["selectors"] for s in value) if value else not state["selectors"])
        if not ok:
            return False
    return True


def some_text(rng, known):
    return rng.choice([rng.choice([k for k in known if k]), {"$regex": rng.choice(["^h", "1$", "x", "[a-c]", "l"])}])


def some_condition(rng, depth=0):
    out = {}
    for key in rng.sample(["url", "cookies", "selectors", "$before", "$after", "$and", "$or", "$not"], rng.randrange(4 if depth else 5)):
        if key[1:] in ("and", "or"):
            if depth < 2:
                out[key] = [some_condition(rng, depth + 1) for _ in range(rng.randrange(4))] if rng.random() < 0.8 else some_condition(rng, depth + 1)
        elif key == "$not":
            if depth < 2:
                out[key] = some_condition(rng, depth + 1)
        elif key == "url":
            out[key] = some_text(rng, URLS)
        elif key == "cookies":
            out[key] = {n: some_text(rng, ["1", "lx", "abc"]) for n in rng.sample(NAMES, rng.randrange(3))}
        elif key == "selectors":
            out[key] = rng.sample(TAGS, rng.randrange(3))
        else:
            out[key] = some_text(rng, ACTIONS)
    return out


def test_random_conditions(spark):
    rng = random.Random(4)
    states = [{"url": rng.choice(URLS), "cookies": rng.choice([None, {}, {"s": rng.choice(["1", "lx", "", None])}, {"s": "abc", "t": "1"}]), "selectors": rng.choice([None, [], *[rng.sample(TAGS, k) for k in (1, 2, 3)]]), "used": rng.choice([[], *[rng.sample(ACTIONS, k) for k in (1, 2)]])} for _ in range(60)]
    frame = spark.createDataFrame([(i, s["url"], s["cookies"], s["selectors"], s["used"]) for i, s in enumerate(states)], "i int, url string, cookies map<string,string>, selectors array<string>, used array<string>").cache()
    conditions = [some_condition(rng) for _ in range(120)]
    got = frame.select("i", *[workflow.condition(w).alias(f"c{k}") for k, w in enumerate(conditions)]).collect()
    seen = set()
    for r in got:
        for k, w in enumerate(conditions):
            want = holds(w, states[r.i], states[r.i]["used"])
            assert r[f"c{k}"] == want, (w, states[r.i])
            seen.add(want)
    assert seen == {True, False}


def test_a_plain_url_reaches_the_scan(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = io.StringIO()
    with redirect_stdout(out):
        workflow.selected(pages, {"url": "http://a", "$before": "x"}, used=None).select("page_id").explain()
    assert re.search(r"PushedFilters: \[.*EqualTo\(url,http://a\)", out.getvalue())


@pytest.mark.parametrize("where", [{"$nor": []}, {"uri": "x"}, {"url": 5}, {"url": {"$regex": "a", "b": 1}}])
def test_what_is_refused(spark, where):
    with pytest.raises(ValueError):
        workflow.condition(where)


def test_parameters_must_match():
    steps = [{"where": {"url": {"$param": "u"}}, "what": [{"action": "goto", "args": [{"$param": "n"}, 1]}]}]
    assert workflow.parameters(steps) == ["u", "n"]
    assert workflow.bound(steps, {"u": {"$regex": "x"}, "n": 7}) == [{"where": {"url": {"$regex": "x"}}, "what": [{"action": "goto", "args": [7, 1]}]}]
    for given in ({"u": 1}, {"u": 1, "n": 2, "m": 3}, {}):
        with pytest.raises(ValueError, match="not those"):
            workflow.bound(steps, given)
