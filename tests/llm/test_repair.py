import hashlib
import itertools
import random
import re
import zlib

import pytest

from fleetlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, `key` int, g string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_edits(rows):
    """rows: (role, text, fault) -> (cost, audit, repaired rows) by the cheapest suffix of every (row, state)."""
    names = {"u": "user", "a": "assistant"}
    after = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        here = dict(after) if i == len(rows) else {}
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 5 if fault == "truncated" else 0
            for state in ("", "s", "u", "a"):
                ways = []
                if state in after:
                    c, a, out = after[state]
                    ways.append((c + 2, "D" + a, out))
                if fault not in ("blank", "duplicate"):
                    for new, cost, letter in [(role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")]:
                        to = STEP.get((state, new[:1]))
                        if to in after and to is not None:
                            c, a, out = after[to]
                            ways.append((c + cost + extra, letter + a, ((new, text), *out)))
                if ways:
                    here[state] = min(ways)
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                for new in ("u", "a"):
                    to = STEP.get((state, new))
                    if to in here and to is not None:
                        c, a, out = here[to]
                        way = (c + 5, "I" + a, ((names[new], ""), *out))
                        here[state] = min(here.get(state, way), way)
        after = here
    return after[""]


def brute(rows):
    """conv_id -> the report of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked = set(), []
        for _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = ("blank" if not words else "duplicate" if (role, text) in seen
                     else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, kept = brute_edits(marked)
        turns = [t for t, _, _ in own if t is not None]
        pairs = zip(own, own[1:])
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                        *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")],
                        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def brute_damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            yield from [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def check(spark, rows):
    got = repair.report(frame(spark, rows)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows)
    assert len(got) == len({r[0] for r in rows})


def test_damaged_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    want = {r[0]: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for r in rows} | brute(list(brute_damage(rows)))
    assert {r.conv_id: tuple(r)[1:] for r in repair.damaged_report(table).collect()} == want


def test_every_short_conversation(spark):
    """All sequences of up to four rows over the roles, whole and truncated and blank."""
    kinds = [("system", "Go."), ("user", "a."), ("user", "b"), ("assistant", "c."), ("assistant", "d"), ("tool", "e."), ("user", "")]
    rows, conv = [], 0
    for n in range(1, 5):
        for combo in itertools.product(kinds, repeat=n):
            if n < 4 or conv % 7 == 0 or len(set(combo)) < 3:
                rows += [(conv, t, role, text + str(t) * (text != "" and role == "tool")) for t, (role, text) in enumerate(combo)]
            conv += 1
    check(spark, rows)


def test_long_conversations_over_levels(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    rows = []
    for conv, n in ((1, 3000), (2, 17), (3, 40), (4, 1100)):
        for t in range(n):
            role = roles[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, t, role, f"text {rng.random()}" + rng.choice([".", ".", "!", ""]) if rng.random() < 0.9 else " "))
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (1, None, "system", "S."),
            (2, 5, "user", "same."), (2, 5, "user", "same."), (2, 9, "assistant", "x" * 100_000 + "."), (3, None, "user", ""),
            (4, 1, "", "no role."), (5, 0, "user", "é…"), (5, 1, "assistant", "日本。"), (5, -3, "s", "\t\x0b.\r")]
    check(spark, rows)
    assert repair.damaged_report(frame(spark, rows)).count() == len({r[0] for r in rows})


def test_rows_of_one_turn_stay_in_order(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "assistant", "Yes."), (1, 0, "user", "b."), (1, 0, "assistant", "a"),
            (2, None, "system", "z."), (2, None, "assistant", "Hi."), (2, 3, "user", "c."), (2, 3, "assistant", "d.")]
    check(spark, rows)


def test_blocks_over_two_ordered_ranges(spark):
    """The ordered rows lie in several ranges and the blocks in one: a block's rows need not have adjacent ids."""
    rng, rows = random.Random(3), []
    for conv in range(40):
        rows += [(conv, t, rng.choice(["user", "assistant"]), f"{rng.random()}.") for t in range(25)]
    ordered = repair.ordered

    def ranges(conversations):
        conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}
        old = {k: spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            return ordered(conversations)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)

    repair.ordered = ranges
    try:
        check(spark, rows)
    finally:
        repair.ordered = ordered


def test_repaired_turns_are_the_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "there."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Alone.")]
    ordered, _, _, edits = repair.repair(frame(spark, rows))
    got = [(r.key, r.role, r.text) for r in repair.repaired_turns(ordered, edits).orderBy("g", "place").collect()]
    want = [(str(c), *t) for c in (1, 2) for t in brute_edits([(r, x, None) for k, _, r, x in rows if k == c])[2]]
    assert got == want


def test_empty(spark):
    assert repair.damaged_report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("classes", ["uau", "xxAoS", "aaaa", "sUauAuo"])
def test_prices_are_dual_feasible(classes):
    arcs, end = repair.lattice(classes, repair.END, True), 4 * len(classes) + 4
    price = [0] * (end + 1)
    cost = repair.auction(arcs, 0, end, price)
    assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for c, j, _ in out)
    assert cost == price[0] - price[end] == brute_edits([
        ({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "t",
         "blank" if c == "x" else "truncated" if c.isupper() else None) for c in classes])[0]
