"""Conversation repair against a search over all edits, a chart with all cuts, SQL, and odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from pixelmill.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, initial string, _h int, audit string"
SOUND = re.compile(r"(s?(ua)+)?\Z")


def search(turns):
    """Cheapest (cost, audit, roles) over all edits: uniform cost search over (turn, initials so far), which knows no grammar but the pattern."""
    n = len(turns)
    limit = 3 * n + 4
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, initials, out = heapq.heappop(heap)
        if k == n and SOUND.match(initials):
            return cost, audit, out
        if (k, initials, audit) in seen or cost > limit or not any(SOUND.match(initials + more) for more in ("", "ua", "a")):
            continue
        seen.add((k, initials, audit))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", k, initials + role[0], (*out, (role, ""))))
        if k < n:
            role, text, status = turns[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, initials, out))
            if status != repair.GONE:
                more = status == repair.CUT_OFF
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, initials + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, initials + new[0], (*out, (new, text))))


def kinds(turns):
    return "".join(repair.KIND[r[0] if r[0] in "sua" else "?", status] for r, _, status in turns)


def chart_cell(letters):
    chart = repair.Chart()
    for x in letters:
        chart.add(x)
    return chart.cell()


def every_cut(letters):
    """The chart over all spans and all cuts."""
    n, cells = len(letters), {}
    for i, x in enumerate(letters):
        cells[i, i + 1] = repair.turn_cell(x)
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            ways = [repair.joined(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            cells[i, i + length] = tuple(min((w[s] for w in ways if w[s] is not None), default=None) for s in range(repair.STATES**2))
    return cells[0, n]


def some_turns(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool"]), f"t{k}", rng.choice([0, 0, 0, 1, 2])) for k in range(n)]


def test_against_search():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5] * 25:
        turns = some_turns(rng, n)
        cost, audit, out = search(turns)
        assert repair.best(chart_cell(kinds(turns))) == (cost, audit)
        assert [(r, t) for _, r, t in repair.edited(audit, [(r, t) for r, t, _ in turns])] == list(out)


def test_any_cut_gives_the_same_cell():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 15, 16, 17, 33, 41):
        letters = kinds(some_turns(rng, n))
        assert chart_cell(letters) == every_cut(letters)


def test_equal_costs_take_least_audit():
    for letters in itertools.product("ABDGHJ", repeat=3):
        cell = chart_cell(letters)
        assert cell == every_cut(letters)


def plain(rows, ids):
    out = []
    for c in ids:
        own = sorted((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for i, t, r, x in rows if i == c)
        seen, turns, counts = set(), [], [0, 0, 0]
        for *_, role, text, _ in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role, text, repair.OK if fault is None else repair.CUT_OFF if fault == 2 else repair.GONE))
        numbers = [t for *_, t in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = repair.best(every_cut(kinds([(r or "?", t, s) for r, t, s in turns]))) if turns else (0, "")
        text = "\n".join(f"{r}:{t}" for _, r, t in repair.edited(audit, [(r, t) for r, t, _ in turns]))
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "K") for r in rows], TURNS)


def check(spark, rows, ids=None):
    got = repair.repair(frame(spark, rows), frame(spark, [(i, 0, None, None) for i in ids]) if ids else None)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows, ids or {r[0] for r in rows})))


def made(rng, n_convs, longest):
    rows = []
    for c in [None, *range(n_convs)]:
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([None, t, t, t + 1]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice([None, "", " \n", "same.", "no end", f"own {t}.", f"é {t}! \x0b", "x" * 80 + str(t) + "?"])))
    return rows + rows[::9]


def test_odd_rows(spark):
    check(spark, made(random.Random(3), 30, 6), [None, *range(40)])


def test_conversation_over_many_partitions(spark):
    """Most rows are one conversation, so every partition holds a part of it."""
    rng = random.Random(4)
    rows = made(rng, 6, 4) + [(c, t, rng.choice(["user", "assistant"]), rng.choice(["again.", f"{t}."])) for c in (5, 9) for t in range(100, 160)] + [(77, t, rng.choice(["user", "assistant"]), rng.choice(["again.", f"{t}."])) for t in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_conversation_and_text(spark):
    """Alternating turns stay; one of a thousand is lost and put in again."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(20_000) if t % 1000 != 501] + [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "b.")]
    got = {r.conv_id: r for r in repair.repair(frame(spark, rows)).collect()}
    assert (got[1].gaps, got[1].illegal, got[1].cost, len(got[1].audit), got[1].audit.count("I")) == (20, 20, 40, 20_000, 20)
    assert got[2].audit == "KK" and got[2].cost == 0


def test_no_rows(spark):
    assert repair.repair(frame(spark, [])).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 2, "user", "b"), (1, 3, "user", "a."), (2, 0, "tool", "x."), (None, 5, "assistant", "z.")]
    given = frame(spark, rows)
    got = sorted(map(tuple, repair.repaired(given, repair.parsed(given)).collect()))
    assert got == [("", 0, "I", "user", ""), ("", 1, "K", "assistant", "z."), ("/1", 0, "K", "user", "a."), ("/1", 1, "R", "assistant", "b")]


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(60)] for t, r, x in ((0, "system", "A. b!"), (1, None, None), (None, "assistant", "c?"))]
    got = sorted(map(repr, map(tuple, repair.damaged(frame(spark, rows)).collect())))
    want = []
    for c, t, r, x in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if draw == 1 else re.sub("[.!?]", "", x) if draw == 2 else x
        want += [(c, t, "user" if draw == 4 else r, x)] * {0: 0, 3: 2}.get(draw, 1)
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equals_sql(spark, sf):
    import duckdb

    from pixelmill.llm.oracles import REPAIR

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    given = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    got = repair.repair(repair.damaged(given), given)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(REPAIR).fetchall()))
