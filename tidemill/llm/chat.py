"""Chat formatting by minimum-cost repair of turn sequences.

A conversation is legal if it is an optional system turn followed by user and
assistant turns in alternation, beginning with the user. A repair chooses for
each given turn whether it keeps its role, takes another, or is merged into
the turn before it, and may put an empty turn before it; every choice has a
cost. Dynamic programming over the automaton of legal sequences finds the
cheapest repair.

Turns are dealt by range of (conversation, turn), so a conversation of any
length is spread over as many tasks as its rows need. A task passes on only
the cost of crossing its part of a conversation from each state to each state;
these small tables are combined in order, after which each task knows in which
states its part begins and ends and repairs it on its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import store

#: Costs of a change of role, of an inserted empty turn and of a merge; a turn whose role isn't known changes it for less.
RELABEL, INSERT, MERGE, RELABEL_UNKNOWN = 3, 2, 1, 1
ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the turn that was written last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Turns that may be written in each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPENED, CLOSED = "<|{role}|>\n", "<|end|>\n"
JOINED = "\n\n"
#: What begins a mark within a text gets one more backslash, so that no text can open or end a turn; ``unescaped`` takes it away.
_MARK, _ESCAPED = r"<(\\*)\|", r"<\\$1|"
_FAR = 1 << 60

#: Other names of the roles.
NAMES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}


def _role(name: str | None) -> int:
    """State of a role's name, 0 if it isn't known."""
    name = (name or "").strip().lower()
    name = NAMES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _options(role: int) -> list[tuple[int, int, int, str, int]]:
    """All ways to take a turn: (state before, state after, cost, action, state of an inserted turn or 0)."""
    out = []
    change = lambda to: 0 if to == role else RELABEL_UNKNOWN if role == 0 else RELABEL
    for s in range(STATES):
        for t in LEGAL[s]:
            out.append((s, t, change(t), "keep" if t == role else "relabel", 0))
            for u in LEGAL[t]:  # an empty turn t, then this one as u
                if t != SYSTEM:
                    out.append((s, u, INSERT + change(u), "insert" if u == role else "insert,relabel", t))
        if s != START:
            out.append((s, s, MERGE + (0 if s == role else change(s)), "merge" if s == role else "merge,relabel", 0))
    return out


_WAYS = [_options(r) for r in range(STATES)]


def _crossing(roles: list[int]) -> np.ndarray:
    """Least cost of taking the turns from each state to each state."""
    cost = np.full((STATES, STATES), _FAR)
    np.fill_diagonal(cost, 0)
    step = {}
    for r in set(roles):
        m = np.full((STATES, STATES), _FAR)
        for s, t, c, _, _ in _WAYS[r]:
            m[s, t] = min(m[s, t], c)
        step[r] = m
    for r in roles:
        cost = np.minimum((cost[:, :, None] + step[r][None, :, :]).min(axis=1), _FAR)
    return cost


def repair(roles: list[int], enter: int = START, leave: int | None = None) -> list[tuple[int, str, int]]:
    """(state, action, state of an inserted turn before it or 0) for each turn, of least total cost.

    The sequence begins in the state ``enter`` and ends in ``leave``, or in
    any. Of equally cheap repairs the one whose choices come first in the
    table of ways, read from the last turn back, is taken.
    """
    cost, back = [_FAR] * STATES, []
    cost[enter] = 0
    for r in roles:
        new, way = [_FAR] * STATES, [None] * STATES
        for w in _WAYS[r]:
            c = cost[w[0]] + w[2]
            if c < new[w[1]]:
                new[w[1]], way[w[1]] = c, w
        cost = new
        back.append(way)
    state = leave if leave is not None else min(range(STATES), key=lambda s: (cost[s], s))
    out = []
    for way in reversed(back):
        w = way[state]
        out.append((state, w[3], w[4]))
        state = w[0]
    return out[::-1]


def _costs(batches):
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x["conv_id"] for x in rows], pa.int64()), pa.array([x["part"] for x in rows], pa.int32()), pa.array([_crossing(list(x["roles"])).ravel().tolist() for x in rows], pa.list_(pa.int64()))],
            names=["conv_id", "part", "cost"],
        )


def _fragments(batches):
    """One row per given turn, with what it adds to the rendered conversation."""
    for batch in batches:
        out = {k: [] for k in ("conv_id", "place", "role", "action", "inserted", "opens", "ends")}
        for x in batch.to_pylist():
            steps = repair(list(x["roles"]), x["enter"], x["leave"])
            for k, (state, action, inserted) in enumerate(steps):
                out["conv_id"].append(x["conv_id"])
                out["place"].append(x["first"] + k)
                out["role"].append(ROLES[state - 1])
                out["action"].append(action)
                out["inserted"].append(ROLES[inserted - 1] if inserted else None)
                out["opens"].append(not action.startswith("merge"))
                out["ends"].append(x["final"] and k == len(steps) - 1)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


#: Turns of a conversation in one part. The parts' cost tables, 16 numbers each, of one conversation meet in one row.
PART = 16384


def repaired(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), repaired and rendered.

    conv_id, place (from 0, gapless within the conversation), turn, role (after
    repair), action (keep, relabel, merge, insert, or two of them), inserted
    (role of an empty turn put before it) and fragment: what the turn adds to
    the rendered conversation, which is its fragments in order of place.

    Turns stand in order of turn (nulls first), then role and text. Marks within
    texts are escaped, so that only real turns open and end. Null texts count as
    empty, texts of any length stay whole; turns without conv_id form one conversation of their own.
    Repeated rows are turns like any other and get merged or parted as is
    cheapest. An empty table gives an empty result.
    """
    base = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    known = F.coalesce(F.lower(F.trim("role")), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    known = F.coalesce(names[known], known)
    code = F.when(known == "system", SYSTEM).when(known == "user", USER).when(known == "assistant", ASSISTANT).otherwise(0).cast("int")
    order = ["conv_id", "turn", "role", "text"]
    # places without gathering a conversation in one task: counts per range partition, then places within it
    parts = 2 * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(base.withColumn("code", code).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")) - 1
    same = dealt.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r"))).drop("_c", "_r")
    placed = store(same.withColumn("place", (F.col("before") + inside).cast("long")).drop("before", "range"), "placed")
    part = (F.col("place") / PART).cast("int")
    runs = placed.groupBy("conv_id", part.alias("part")).agg(F.min("place").alias("first"), F.sort_array(F.collect_list(F.struct("place", "code"))).alias("x"))
    runs = store(runs.select("conv_id", "part", "first", F.col("x.code").alias("roles")), "runs")
    costs = runs.mapInArrow(_costs, "conv_id long, part int, cost array<long>")
    # the least cost of reaching each state before a part, folded over the tables of the parts before it
    far = F.lit(_FAR)
    step = lambda at, cost: F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda t: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.least(far, F.get(at, s) + F.get(cost, s * STATES + t)))))
    begin = F.array(*[F.lit(0 if s == START else _FAR).cast("long") for s in range(STATES)])
    tables = costs.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "cost"))), lambda x: x["cost"]).alias("tables"))
    ends = tables.select("conv_id", F.size("tables").alias("parts"), F.posexplode(_states(step, begin)).alias("part", "s"))
    both = runs.join(ends.withColumnRenamed("conv_id", "_c").withColumnRenamed("part", "_p"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    steps = both.select("conv_id", "first", "roles", F.col("s.enter").alias("enter"), F.col("s.leave").alias("leave"), (F.col("part") == F.col("parts") - 1).alias("final")).mapInArrow(
        _fragments, "conv_id long, place long, role string, action string, inserted string, opens boolean, ends boolean"
    )
    steps = steps.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), F.col("role").alias("new_role"), "action", "inserted", "opens", "ends")
    whole = placed.join(steps, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")))
    opened = lambda c: F.concat(F.lit(OPENED.split("{role}")[0]), c, F.lit(OPENED.split("{role}")[1]))
    closes = F.when(F.col("opens") & (F.col("place") > 0), F.lit(CLOSED)).otherwise("")
    empty = F.when(F.col("inserted").isNotNull(), F.concat(opened(F.col("inserted")), F.lit(CLOSED))).otherwise("")
    fragment = F.concat(closes, empty, F.when(F.col("opens"), opened(F.col("new_role"))).otherwise(F.lit(JOINED)), F.regexp_replace("text", _MARK, _ESCAPED), F.when(F.col("ends"), F.lit(CLOSED)).otherwise(""))
    return whole.select("conv_id", "place", "turn", F.col("new_role").alias("role"), "action", "inserted", fragment.alias("fragment"))


def unescaped(text: str) -> str:
    """A turn's text as it was given."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _states(step, begin):
    """Column: for each table in ``tables`` the state before and after it on the cheapest way through all of them."""
    # forward: costs before each part; backward: the chosen states
    forward = F.aggregate("tables", F.array(begin), lambda acc, c: F.concat(acc, F.array(step(F.element_at(acc, -1), c))))
    n = F.size("tables")
    least = lambda xs: (F.array_position(xs, F.array_min(xs)) - 1).cast("int")

    def walk(f):
        last = least(F.element_at(f, -1))
        first = F.array(F.struct(last.alias("enter"), last.alias("leave")))

        def back(acc, k):  # k counts parts from the last
            leave = F.get(acc, 0)["enter"]
            at = F.get(f, n - 1 - k)
            cost = F.get(F.col("tables"), n - 1 - k)
            enter = least(F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.get(at, s) + F.get(cost, s * STATES + leave)))
            return F.concat(F.array(F.struct(enter.alias("enter"), leave.alias("leave"))), acc)

        return F.slice(F.aggregate(F.sequence(F.lit(0), n - 1), first, back), 1, n)

    return F.get(F.transform(F.array(forward), walk), 0)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
