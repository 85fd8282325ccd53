"""Conversation structure repair by an auction shortest-path algorithm.

A conversation's rows are the layers of a lattice whose nodes are (row, state);
the states are those of the role grammar ``(s?(ua)+)?``.  Arcs are the edits
with whole costs.  The auction keeps a path from the origin and a price per
node: where the last node's price is below the best of arc cost plus head
price, the price is raised to it and the path contracts; otherwise it is
extended along that arc.  At the end every cheapest path consists of tight arcs
(price = cost + head price), and the first one in letter order is traced
through them.

Long conversations are cut into blocks of ``BLOCK`` rows.  Each block gives the
cheapest cost between each two of its boundary states (auctions inside the
block); ``FAN`` blocks are joined to one node of the next level until a
conversation is one node.  Then boundary prices go down the levels, the blocks'
entry states follow, and each block is traced by itself.  No task or driver
holds the rows of a conversation; the repaired text's digest streams over them.

Defined cases: a null in any column counts as one space, so a null text is
blank, a null role can only be rerolled or deleted, and the rows of a null
conversation are one conversation; rows are ordered by turn (nulls first),
those of one turn stay as the table is read; repeated rows are duplicates
after the first; an empty table gives an empty result; further columns are
ignored.  Texts are told apart by 128 hash bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import map_rows, materialise

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by state.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that an inserted or rerolled row must have, by state.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
BIG = 1 << 60
#: Cost of ending a conversation, by state.
END = (0, BIG, BIG, 0)
BLOCK, FAN_BITS = 16, 6

Arcs = list[list[tuple[int, int, str]]]


def auction(arcs: Arcs, origin: int, end: int, price: list[int]) -> int:
    """Cheapest cost from ``origin`` to ``end``; ``price`` (feasible, 0 at the end) is raised in place."""
    path = [origin]
    while path[-1] != end:
        node = path[-1]
        best, head = min(((cost + price[to], to) for cost, to, _ in arcs[node]), default=(BIG, end))
        if best >= BIG or price[node] < best:
            price[node] = min(best, BIG)
            if len(path) > 1:
                path.pop()
            elif best >= BIG:
                return BIG
        else:
            path.append(head)
    return price[origin]


def live(arcs: Arcs, end: int) -> Arcs:
    """``arcs`` without those to nodes that cannot reach ``end``: prices would rise around a cycle of them for ever."""
    into: list[list[int]] = [[] for _ in range(end + 1)]
    for node, out in enumerate(arcs):
        for _, to, _ in out:
            into[to].append(node)
    seen, todo = {end}, [end]
    while todo:
        new = [n for n in into[todo.pop()] if n not in seen]
        seen.update(new)
        todo += new
    return [[a for a in out if a[1] in seen] for out in arcs]


def lattice(classes: str, exits: tuple[int, ...], last: bool) -> Arcs:
    """Arcs of a block: one letter per row, ``exits`` the cost from each state at its end on.

    Letters: x must be deleted; s, u, a, o: the role's initial; upper case: truncated.
    Rows are inserted before a row, and after the last one where ``last``.
    """
    n = len(classes)
    arcs: Arcs = [[] for _ in range(4 * n + 4)]
    for i in range(n + 1):
        for state, after in FOLLOWS.items():
            out, want = arcs[4 * i + state], WANTED[state]
            if i == n and exits[state] < BIG:
                out.append((exits[state], 4 * n + 4, ""))
            if i < n:
                out.append((DELETE, 4 * i + 4 + state, "D"))
            if i < n or last:
                out.append((INSERT, 4 * i + after[want], "I"))
            if i < n and classes[i] != "x":
                role, fault = classes[i].lower(), TRUNCATED if classes[i].isupper() else 0
                if role in after:
                    out.append((fault, 4 * i + 4 + after[role], "K"))
                out.append((REROLE + fault, 4 * i + 4 + after[want], "R"))
    return live(arcs, 4 * n + 4)


def trace(arcs: Arcs, origin: int, end: int, price: list[int]) -> list[tuple[int, str]]:
    """(node, letter) per arc of the tight path that comes first in letter order."""
    path, dead = [(origin, "")], set()
    while path[-1][0] != end:
        node = path[-1][0]
        # An arc list is in letter order, and no two of its arcs have one letter.
        step = next(((to, letter) for cost, to, letter in arcs[node]
                     if to not in dead and price[node] == cost + price[to]), None)
        if step:
            path.append(step)
        else:
            dead.add(path.pop()[0])
    return [(node, letter) for (node, _), (_, letter) in zip(path, path[1:])]


@lru_cache(100_000)
def solve(classes: str, entry: int, exits: tuple[int, ...], last: bool) -> tuple[int, tuple[str, ...], int]:
    """(cost, edits, state at the end) of a block; an edit is the letters at one row, with the role given."""
    arcs, end = lattice(classes, exits, last), 4 * len(classes) + 4
    price = [0] * (end + 1)
    cost = auction(arcs, entry, end, price)
    if cost >= BIG:
        return BIG, (), -1
    edits, open_, state = [], "", entry
    for node, letter in trace(arcs, entry, end, price):
        state = node % 4
        open_ += letter + (WANTED[state] if letter in ("I", "R") else "")
        if letter in ("D", "K", "R"):
            edits.append(open_)
            open_ = ""
    edits[-1] += open_
    return cost, tuple(edits), state


@lru_cache(100_000)
def costs(classes: str, last: bool) -> tuple[int, ...]:
    """Cheapest cost of a block from each state to each state, row by row."""
    table = [[0] * 4 for _ in range(4)]
    for to in range(4):
        exits = tuple(0 if s == to else BIG for s in range(4))
        arcs, end = lattice(classes, exits, last), 4 * len(classes) + 4
        price = [0] * (end + 1)
        for state in range(4):  # prices stay feasible from one origin to the next
            table[state][to] = auction(arcs, state, end, price)
    return tuple(x for row in table for x in row)


def boundary_prices(tables: list, exits: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost to go at each boundary of consecutive blocks, by the auction over their cost tables."""
    n = len(tables)
    end = 4 * n + 4
    arcs: Arcs = [[(int(t[4 * s + to]), 4 * i + 4 + to, "") for to in range(4) if t[4 * s + to] < BIG]
                  for i, t in enumerate(tables) for s in range(4)]
    arcs += [[(int(exits[s]), end, "")] if exits[s] < BIG else [] for s in range(4)]
    arcs = live(arcs, end)
    price = [0] * (end + 1)
    for node in reversed(range(end)):
        price[node] = auction(arcs, node, end, price)
    return [tuple(price[4 * i:4 * i + 4]) for i in range(n + 1)]


def joined_costs(tables: list) -> list[int]:
    columns = [boundary_prices(tables, tuple(0 if s == to else BIG for s in range(4)))[0] for to in range(4)]
    return [columns[to][s] for s in range(4) for to in range(4)]


def joined_moves(moves: list) -> list[int]:
    """State after consecutive blocks by state before them (-1: impossible)."""
    now = [0, 1, 2, 3]
    for m in moves:
        now = [int(m[s]) if s >= 0 else -1 for s in now]
    return now


# Levels of nodes (key, idx, value): FAN consecutive nodes of a conversation are one node of the next level.

def _groups(df: DataFrame):
    return df.groupBy("key", F.shiftright("idx", FAN_BITS).alias("up"))


def climb(leaves: DataFrame, join: Callable[[list], list[int]]) -> list[DataFrame]:
    """Levels from the leaves to one node a conversation; ``join`` makes a node's value of its children's."""
    def node(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        return pd.DataFrame({"key": group["key"][:1], "idx": [int(group["idx"].iloc[0]) >> FAN_BITS],
                             "value": [join(list(group["value"]))]})

    levels = [leaves]
    while not levels[-1].filter("idx > 0").isEmpty():
        levels.append(materialise(_groups(levels[-1]).applyInPandas(node, "key string, idx long, value array<long>"),
                                  "level"))
    return levels


def descend(levels: list[DataFrame], top: tuple[int, ...], hand: Callable[[list, list], list]) -> DataFrame:
    """(key, idx, given) of the leaves: ``hand`` makes of a node's children and what it is given what they are given."""
    def children(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        given = hand(list(group["value"]), list(group["given"].iloc[0]))
        return pd.DataFrame({"key": group["key"], "idx": group["idx"],
                             "given": pd.Series([[int(x) for x in g] for g in given], index=group.index)})

    given = levels[-1].select("key", "idx", F.array(*[F.lit(x).cast("long") for x in top]).alias("given"))
    for level in reversed(levels[:-1]):
        above = given.select("key", F.col("idx").alias("up"), "given")
        below = level.withColumn("up", F.shiftright("idx", FAN_BITS)).join(above, ["key", "up"])
        given = materialise(below.groupBy("key", "up").applyInPandas(children, "key string, idx long, given array<long>"),
                            "given")
    return given


# Rows to blocks.

def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def ordered(conversations: DataFrame) -> DataFrame:
    """Written table (key, conv_id, turn, role, text, g): g rises in the order of conversations and their rows."""
    rows = conversations.select(_text(F.col("conv_id")).alias("key"), "conv_id", "turn", _text(F.col("role")).alias("role"),
                                _text(F.col("text")).alias("text"))
    order = ["key", F.col("turn").asc_nulls_first(), "_at"]
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("2"), "text"),
                             "_at": F.monotonically_increasing_id()})
    # Sorted ranges, and ids that rise inside a range and from one to the next.
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .drop("_at").withColumn("g", F.monotonically_increasing_id()), "ordered")


def faults(rows: DataFrame) -> DataFrame:
    """(g, key, fault, initial) per row: the first of blank, duplicate and truncated that holds."""
    # The first row of each role and text is found by an aggregation and met by its unique g, so no hot text is joined.
    first = rows.groupBy("key", "role", "h1", "h2").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = rows.select("g", "key", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"),
                       blank.alias("blank"), truncated.alias("truncated"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(F.col("truncated"), "truncated"))
    return slim.join(first, "g", "left").select("g", "key", "conv_id", "turn", "initial", fault.alias("fault"))


def blocks(rows: DataFrame) -> DataFrame:
    """Written table of blocks in order: (part, n, key, g, classes, illegal, first, last); g: of each of its rows."""
    initial, fault = F.col("initial"), F.col("fault")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = (F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(letter)).otherwise(letter))

    def cut(stream) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, n, own = TaskContext.get().partitionId(), 0, []

        def done():
            initials = [r[3] for r in own]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            return part, n, own[0][0], [r[1] for r in own], "".join(r[2] for r in own), illegal, initials[0], initials[-1]

        for row in stream:
            if own and (row[0] != own[0][0] or len(own) == BLOCK):
                yield done()
                n, own = n + 1, []
            own.append(row)
        if own:
            yield done()

    sorted_rows = (rows.select("key", "g", letter.alias("letter"), "initial")
                   .repartitionByRange("g").sortWithinPartitions("g"))
    return materialise(map_rows(sorted_rows, cut, "part int, n long, key string, g array<long>, classes string, illegal long, "
                                                  "first string, last string"), "blocks")


def numbered(found: DataFrame) -> DataFrame:
    """Adds idx (the block's number in its conversation) and size (the conversation's number of blocks)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = found.groupBy("part").agg(F.count("*").alias("c")).select(
        "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    placed = found.join(parts, "part").withColumn("at", F.col("n") + F.col("before")).drop("n", "before")
    whole = placed.groupBy("key").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    return materialise(placed.join(whole, "key").withColumn("idx", F.col("at") - F.col("start")), "numbered")


def edits(found: DataFrame) -> DataFrame:
    """Written table (key, idx, g, cost, edits): the edits of every block's rows on its conversation's cheapest path."""
    many = found.filter("size > 1").withColumn("is_last", F.col("idx") + 1 == F.col("size"))

    def tables(stream):
        for key, idx, classes, last in stream:
            yield key, idx, list(costs(classes, last))

    shape = "key string, idx long, value array<long>"
    levels = climb(materialise(map_rows(many.select("key", "idx", "classes", "is_last"), tables, shape), "tables"),
                   joined_costs)
    exits = descend(levels, END, lambda below, given: boundary_prices(below, tuple(given))[1:])
    many = materialise(many.join(exits.withColumnRenamed("given", "exits"), ["key", "idx"]), "exits")

    def moves(stream):
        for key, idx, classes, last, out in stream:
            yield key, idx, [solve(classes, s, tuple(out), last)[2] for s in range(4)]

    levels = climb(materialise(map_rows(many.select("key", "idx", "classes", "is_last", "exits"), moves, shape), "moves"),
                   joined_moves)

    def entries(below, given):
        states = [given[0]]
        for m in below[:-1]:
            states.append(int(m[states[-1]]))
        return [[s] for s in states]

    entry = descend(levels, (START,), entries)
    columns = ["key", "idx", "g", "classes", "is_last", "exits", "entry"]
    many = many.join(entry, ["key", "idx"]).withColumn("entry", F.col("given")[0]).select(columns)
    alone = found.filter("size = 1").select(
        "key", "idx", "g", "classes", F.lit(True).alias("is_last"),
        F.array(*[F.lit(x).cast("long") for x in END]).alias("exits"), F.lit(START).cast("long").alias("entry"))

    def solved(stream):
        for key, idx, g, classes, last, out, state in stream:
            cost, own, after = solve(classes, state, tuple(out), last)
            yield key, idx, g, cost - out[after], list(own)

    return materialise(map_rows(alone.select(columns).unionByName(many), solved,
                                "key string, idx long, g array<long>, cost long, edits array<string>"), "edits")


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows and their edits, whole conversations to a task and in order: (key, g, edit, role, text)."""
    # A block can hold rows of two of the ordered ranges, between which g jumps: every edit goes by its own row's g.
    edit = found.select("key", F.inline(F.arrays_zip("g", "edits"))).select(
        "key", "g", F.col("edits").alias("edit"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"))
    text = rows.select("key", "g", F.lit(None).cast("string").alias("edit"), "role", "text")
    return (edit.unionByName(text).repartition("key")
            .sortWithinPartitions("key", "g", F.col("edit").asc_nulls_last()))


def _turns(stream) -> Iterator[tuple]:
    """(key, g, place among the row's, role, text) of the repaired rows; role None: the row is deleted."""
    edit = ""
    for key, g, own, role, text in stream:
        if own is not None:
            edit = own
            continue
        letters = iter(edit)
        for place, letter in enumerate(letters):
            if letter == "D":
                yield key, g, place, None, None
            elif letter == "K":
                yield key, g, place, role, text
            else:
                yield key, g, place, ROLES[next(letters)], text if letter == "R" else ""


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (key, g, place, role, text) in the order of g and place."""
    return map_rows(_stream(rows, found), lambda s: (t for t in _turns(s) if t[3] is not None),
                    "key string, g long, place int, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the repaired ``role:text`` lines, streamed."""
    def run(stream):
        now, sha, empty = None, None, True
        for key, _, _, role, text in _turns(stream):
            if key != now:
                if sha:
                    yield now, sha.hexdigest()
                now, sha, empty = key, hashlib.sha256(), True
            if role is not None:
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if sha:
            yield now, sha.hexdigest()

    return map_rows(_stream(rows, found), run, "key string, sha string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, their faults, blocks, edits) of ``conversations`` (conv_id, turn, role, text): written tables."""
    rows = ordered(conversations)
    marked = materialise(faults(rows), "faults")
    found = numbered(blocks(marked))
    return rows, marked, found, edits(found)


def report(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest per conversation that has rows."""
    rows, marked, found, repaired = repair(conversations)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faulty = marked.groupBy("key").agg(
        F.first("conv_id", ignorenulls=True).alias("conv_id"), F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # Pairs of rows across two blocks: blocks meet by their number, which is unique.
    nxt = found.filter("size > 1").select((F.col("at") - 1).alias("at"), F.col("key").alias("_k"), F.col("first").alias("_f"))
    across = F.coalesce((F.col("key") == F.col("_k")) & ~F.concat("last", "_f").isin("su", "ua", "au"), F.lit(False))
    illegal = (found.join(nxt, "at", "left").groupBy("key")
               .agg(F.sum(F.col("illegal") + across.cast("long")).alias("illegal")))
    pieces = repaired.select("key", "cost", F.struct("idx", F.translate(F.concat_ws("", "edits"), "ua", "")).alias("p"))
    audit = pieces.groupBy("key").agg(
        F.sum("cost").alias("cost"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list("p")), lambda x: x["col2"])).alias("audit"))
    out = faulty.join(illegal, "key").join(audit, "key").join(digests(rows, repaired), "key")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.col("sha").alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults set by crc32 of ``conv_id:turn``: see the cases below."""
    c = conversations.select("conv_id", "turn", *[_text(F.col(x)).alias(x) for x in ("role", "text")])
    kind = F.crc32(F.concat_ws(":", _text(F.col("conv_id")), _text(F.col("turn"))).cast("binary")) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (c.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_i"))
            .drop("_i"))


def damaged_report(conversations: DataFrame) -> DataFrame:
    """``report`` of the damaged conversations, with a row for each one that lost all its rows."""
    found = report(damage(conversations))
    ids = conversations.select("conv_id").distinct()
    names = found.columns[1:]
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = ids.join(found.withColumnRenamed("conv_id", "_id").withColumn("_there", F.lit(True)),
                      F.col("conv_id").eqNullSafe(F.col("_id")) & F.col("_there"), "left")
    return joined.select("conv_id", *[F.coalesce(F.col(n), nothing.get(n, F.lit(0).cast("long"))).alias(n) for n in names])
