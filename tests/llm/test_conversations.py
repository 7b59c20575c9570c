"""Repairs against a plain search over all edits, whole and in chunks of a few rows."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from heapq import heappop, heappush
from zlib import crc32

import duckdb
import pytest
from oracle import assert_same

from lanternlog.llm import conversations
from lanternlog.llm.conversations import Repair, damaged

ROWS = "conv_id long, turn long, role string, text string"


def search(initials, faults):
    """(cost, audit, roles) of the cheapest, then ASCII-least edits: every sequence in that order until one ends well."""
    waiting, done = [(0, "", 0, ())], set()
    while waiting:
        cost, audit, k, left = heappop(waiting)
        state = left[-1] if left else None
        if k == len(initials) and (not left or left[-1] == "a") and re.fullmatch("(s?(ua)+)?", "".join(left)):
            return cost, audit, left
        if (k, state, audit) in done or cost > 5 * len(initials) + 8:
            continue
        done.add((k, state, audit))
        may = lambda x: x == "u" and state != "u" or x == "a" and state == "u" or x == "s" and state is None  # noqa: B023, E731
        for x in "ua":
            if may(x):
                heappush(waiting, (cost + 2, audit + "I", k, (*left, x)))
        if k < len(initials):
            heappush(waiting, (cost + 3, audit + "D", k + 1, left))
            if faults[k] in ("", "truncated"):
                cut = faults[k] == "truncated"
                if may(initials[k]):
                    heappush(waiting, (cost + cut, audit + "K", k + 1, (*left, initials[k])))
                for x in "ua":
                    if may(x):
                        heappush(waiting, (cost + 2 + cut, audit + "R", k + 1, (*left, x)))
    raise AssertionError


def suffixes(initials, faults):
    """The same by the best suffix from every row and state, for longer conversations."""
    best = {None: (0, "", ()), "s": (4, "II", ("u", "a")), "u": (2, "I", ("a",)), "a": (0, "", ())}
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after, best = best, {}

        def may(state, x):
            return x == "u" and state != "u" or x == "a" and state == "u" or x == "s" and state is None

        for state in (None, "s", "u", "a"):
            options = []
            for chain in ((), ("u",), ("a",), ("u", "a"), ("a", "u")):
                now, fits = state, True
                for x in chain:
                    fits = fits and may(now, x)
                    now = x
                if not fits:
                    continue
                add = lambda cost, letter, x: options.append((2 * len(chain) + cost + after[x][0], "I" * len(chain) + letter + after[x][1], (*chain, *((x,) if letter != "D" else ()), *after[x][2])))  # noqa: B023, E731
                add(3, "D", now)
                if fault in ("", "truncated"):
                    if may(now, initial):
                        add(fault == "truncated", "K", initial)
                    for x in "ua":
                        if may(now, x):
                            add(2 + (fault == "truncated"), "R", x)
            best[state] = min(options)
    return best[None]


def plain(rows, find=suffixes):
    out, by = {}, defaultdict(list)
    for c, turn, role, text in rows:
        by[c]
        code = crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        by[c] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit, _ = find(initials, faults)
        left, k = [], 0
        for letter in audit:
            state = left[-1][0] if left else None
            own_role = "user" if state is None or state[:1] != "u" else "assistant"
            if letter == "I":
                left.append((own_role, ""))
                continue
            if letter == "K":
                left.append((own[k][1], own[k][2]))
            elif letter == "R":
                left.append((own_role, own[k][2]))
            k += 1
        turns = [t for t, *_ in own if t is not None]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        )
    return out


def conversation(rng, c, n):
    texts = ["Yes.", "No!", "and then", "", " \n", "What?", "Well. ", "one. two", None]
    roles = ["user", "assistant", "system", "tool", None, "", "ubuntu"]
    turns = [None if rng.random() < 0.05 else k * rng.choice([1, 1, 2]) for k in range(n)]
    return [(c, t, rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles), f"{rng.choice(['Text', 'Said', 'Asks'])} {k}." if rng.random() < 0.6 else rng.choice(texts)) for k, t in enumerate(turns)]


def many(seed=5):
    rng = random.Random(seed)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randint(1, 9))]
    rows += conversation(rng, None, 5) + conversation(rng, 100, 700) + [rows[3]] * 3 + [(101, 4, "user", "Same.")] * 50
    rng.shuffle(rows)
    return rows


def untied(rows):
    """Rows of one turn of a conversation have one result only if they agree in role and text's head."""
    return list({(c, t, *r): (c, t, *r) for c, t, *r in rows}.values())


def results(df, **sizes):
    return {r.conv_id: tuple(r)[1:] for r in Repair(damaged(df), **sizes).report().collect()}


def test_the_search_and_the_suffixes_agree():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 5)
        initials, faults = [rng.choice("suaut ") for _ in range(n)], [rng.choice(["", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert search(initials, faults) == suffixes(initials, faults)


def test_crossings_are_the_least_cheapest_edits():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 60)
        initials, faults = [rng.choice("suau ") for _ in range(n)], [rng.choice(["", "", "", "truncated", "blank"]) for _ in range(n)]
        step = conversations.through([conversations.row_step(i, f) for i, f in zip(initials, faults, strict=True)])
        state, cost = conversations.last_state(step)
        audit, _ = conversations.edited(initials, faults, [""] * n, conversations.START, state, True)
        assert (cost, audit) == suffixes(initials, faults)[:2]
        cut = rng.randint(0, n)  # two parts as one
        parts = [conversations.through([conversations.row_step(i, f) for i, f in zip(initials[a:b], faults[a:b], strict=True)]) for a, b in ((0, cut), (cut, n))]
        reached = lambda x: [([c for c, _ in row], sorted((r, b) for b, (c, r) in enumerate(row) if c < float("inf"))) for row in x]
        order = lambda x: [(costs, [b for _, b in ranks]) for costs, ranks in reached(x)]  # noqa: E731, B023
        assert order(conversations.through(parts)) == order(step)


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 4, "group_bits": 4}, {"chunk_bytes": 60, "group_bits": 34}])
def test_repairs_equal_a_plain_search(spark, sizes):
    rows = many()
    got = results(spark.createDataFrame(rows, ROWS).repartition(6), **sizes)
    assert got == plain(rows) and len(got) == 63


def test_messages_are_what_the_digest_says(spark):
    rows = many(6)
    repair = Repair(damaged(spark.createDataFrame(rows, ROWS)), chunk_rows=8)
    by = defaultdict(list)
    for r in repair.messages().collect():
        by[r.conv_id].append((tuple(r.place), r.role, r.text))
    want = {r.conv_id: r.repaired_sha256 for r in repair.report().collect()}
    assert {c: sha256("\n".join(f"{r}:{t}" for _, r, t in sorted(by[c])).encode()).hexdigest() for c in want} == want
    for own in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in sorted(own)))


def test_nulls_empty_long_and_clashing(spark):
    assert Repair(damaged(spark.createDataFrame([], ROWS))).report().collect() == []
    rows = [(None, None, None, None), (1, None, "user", "Long. " * 300_000), (1, 3, "assistant", "x" * 2_000_000), (2, 1, "", ""), (3, 5, "system", "Only.")]
    df = spark.createDataFrame(rows, ROWS)
    assert results(df) == plain(rows)
    clashing = df
    for c in ("key", "row", "at", "uid", "first", "last", "h1", "h2", "head", "step", "code", "copy", "n", "part", "is_repeat", "entry", "is_dropped"):
        clashing = clashing.selectExpr("*", f"1 AS `{c}`")
    assert results(clashing) == plain(rows)


def test_sql_states_the_same(spark):
    rows = untied(many(7))
    con = duckdb.connect()
    df = spark.createDataFrame(rows, ROWS)
    con.register("conversations", df.filter("conv_id IS NULL OR conv_id < 60").toArrow())
    assert_same(Repair(damaged(df.filter("conv_id IS NULL OR conv_id < 60"))).report(), conversations.ORACLE, con)


def test_results_of_one_turn_do_not_hang_on_order(spark):
    rows = many(8)
    other = rows[::-1]
    assert Counter(results(spark.createDataFrame(rows, ROWS)).items()) == Counter(results(spark.createDataFrame(other, ROWS).repartition(3), chunk_rows=16).items())
