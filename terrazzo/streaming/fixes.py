"""Position fixes as a state machine: a batch fold, and the same fold as a stateful stream.

The state of a user is the last point they clearly moved to, the last heading, the state, and whether a fix is
known. A fix has (x, y) in meters in a local frame, an optional device heading and speed, and an accuracy. Errors
come as rows with a code: 1 is a refusal, which ends the fix; any other counts only while there is no fix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOVED, SLOW, FAR, SNAP, LEAST_SNAP = 4.0, 0.3, 400.0, 25.0, 8.0
#: Columns of a fix; code is null for a position, ord orders a user's rows.
FIX = "user_id long, ord long, x double, y double, heading double, speed double, code int"
STATE = "px double, py double, heading double, fix boolean, state string"
OUT = "user_id long, ord long, heading double, state string, moved boolean"


def state_of(x: Column, y: Column, box: tuple[float, float, float, float], indoors: Column) -> Column:
    """Offcampus beyond FAR meters outside the box, else indoors where a building holds the point, else on."""
    w, s, e, n = map(F.lit, box)
    dx = F.greatest(w - x, F.lit(0.0), x - e)
    dy = F.greatest(s - y, F.lit(0.0), y - n)
    return F.when(F.sqrt(dx * dx + dy * dy) > FAR, "offcampus").when(F.coalesce(indoors, F.lit(False)), "indoors").otherwise("on")


def snaps(distance: Column, accuracy: Column, state: Column) -> Column:
    """A fix outdoors snaps to a path within its accuracy, 8 meters at least and 25 at most."""
    a = F.when(F.coalesce(accuracy, F.lit(0.0)) == 0, 50.0).otherwise(accuracy)
    return (state == "on") & F.coalesce(distance <= F.least(F.lit(SNAP), F.greatest(F.lit(LEAST_SNAP), a)), F.lit(False))


def fold(fixes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """A row for each row of `fixes` (FIX): (user_id, ord, heading, state, moved).

    Rows without a finite position and without a code change nothing and keep the state before. One shuffle by
    user; a user's rows are folded in order in one row's array, so a user is the unit of work as in a stream.
    """
    one = F.struct("ord", "x", "y", "heading", "speed", "code", state_of(F.col("x"), F.col("y"), box, F.lit(False)).alias("s"))
    users = fixes.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("fs"))
    start = F.struct(
        F.lit(None).cast("double").alias("px"),
        F.lit(None).cast("double").alias("py"),
        F.lit(None).cast("double").alias("heading"),
        F.lit(False).alias("fix"),
        F.lit("locating").alias("state"),
        F.array().cast("array<struct<ord:bigint,heading:double,state:string,moved:boolean>>").alias("out"),
    )
    kind = "struct<px:double,py:double,heading:double,fix:boolean,state:string,out:array<struct<ord:bigint,heading:double,state:string,moved:boolean>>>"

    def step(a: Column, f: Column) -> Column:
        position = f["code"].isNull() & f["x"].isNotNull() & f["y"].isNotNull() & ~F.isnan(f["x"]) & ~F.isnan(f["y"])
        far = a["px"].isNull() | (F.hypot(f["x"] - a["px"], f["y"] - a["py"]) > MOVED)
        device = F.when(f["heading"].isNotNull() & (f["speed"].isNull() | (f["speed"] > SLOW)), f["heading"])
        course = F.when(a["px"].isNotNull() & far, F.pmod(F.degrees(F.atan2(f["x"] - a["px"], f["y"] - a["py"])), F.lit(360.0)))
        heading = F.coalesce(device, course, a["heading"])
        refused, failed = F.coalesce(f["code"] == 1, F.lit(False)), f["code"].isNotNull() & ~a["fix"]
        moved = position & far
        state = F.when(position, f["s"]).when(refused, "denied").when(failed, "unavailable").otherwise(a["state"])
        new = F.when(position, heading).when(refused, F.lit(None).cast("double")).otherwise(a["heading"])
        return F.struct(
            F.when(moved, f["x"]).otherwise(a["px"]).alias("px"),
            F.when(moved, f["y"]).otherwise(a["py"]).alias("py"),
            new.alias("heading"),
            (position | (a["fix"] & ~refused)).alias("fix"),
            state.alias("state"),
            F.array_append(a["out"], F.struct(f["ord"].alias("ord"), new.alias("heading"), state.alias("state"), moved.alias("moved"))).alias("out"),
        ).cast(kind)

    done = users.select("user_id", F.explode(F.aggregate("fs", start.cast(kind), step)["out"]).alias("o"))
    return done.select("user_id", "o.ord", "o.heading", "o.state", "o.moved")


def _number(v) -> float | None:
    return None if v is None or pd.isna(v) else float(v)


def stream(fixes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """E01, E03 over a stream of FIX rows: the rows that fold gives, as long as a user's rows arrive in order.

    A micro-batch's rows of a user are put in order first. The state is one small row a user, whatever the
    length of the stream.
    """
    west, south, east, north = box

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        px, py, heading, fix, state = group.get if group.exists else (None, None, None, False, "locating")
        rows = pd.concat(list(frames)).sort_values("ord")
        out = []
        for r in rows.itertuples():
            x, y, own, speed, code = _number(r.x), _number(r.y), _number(r.heading), _number(r.speed), _number(r.code)
            moved = False
            if code is None and x is not None and y is not None:
                moved = px is None or math.hypot(x - px, y - py) > MOVED
                if own is not None and (speed is None or speed > SLOW):
                    heading = own
                elif moved and px is not None:
                    heading = math.degrees(math.atan2(x - px, y - py)) % 360
                if moved:
                    px, py = x, y
                fix = True
                away = math.hypot(max(west - x, 0, x - east), max(south - y, 0, y - north))
                state = "offcampus" if away > FAR else "on"
            elif code == 1:
                heading, fix, state = None, False, "denied"
            elif code is not None and not fix:
                state = "unavailable"
            out.append((int(key[0]), int(r.ord), heading, state, moved))
        group.update((px, py, heading, fix, state))
        yield pd.DataFrame(out, columns=["user_id", "ord", "heading", "state", "moved"]).astype({"heading": "float64"})

    return fixes.groupBy("user_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def off_route(fixes: DataFrame, away: float = 15.0) -> DataFrame:
    """`reroute` where a fix (user_id, ord, distance to the route) is off it and the one before was not."""
    from pyspark.sql import Window as W

    off = F.coalesce(F.col("distance") > away, F.lit(False))
    before = F.coalesce(F.lag(off).over(W.partitionBy("user_id").orderBy("ord")), F.lit(False))
    return fixes.withColumn("reroute", off & ~before)


def queued(events: DataFrame, ready: Column, allowed: tuple[str, ...], most: int = 50) -> DataFrame:
    """(user_id, ord) of the events that are sent: those of allowed names, and of the ones before `ready`
    holds for the first time only the first `most` of each user."""
    from pyspark.sql import Window as W

    e = events.where(F.col("name").isin(*allowed))
    w = W.partitionBy("user_id").orderBy("ord")
    since = F.max(F.coalesce(ready, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    e = e.withColumn("__ready", since)
    place = F.row_number().over(W.partitionBy("user_id", "__ready").orderBy("ord"))
    return e.withColumn("__n", place).where(F.col("__ready") | (F.col("__n") <= most)).drop("__ready", "__n")


def coalesced_runs(edits: DataFrame, seconds: float, by: str, at: str) -> DataFrame:
    """The runs (by, at, n) that a worker makes which takes `seconds` a run, edits waiting meanwhile as one rerun.

    The first edit starts a run at once; edits during it share one that starts when it ends. A group's edits are
    folded in one array in order.
    """
    runs = "array<struct<at:double,n:bigint>>"
    times = edits.groupBy(by).agg(F.array_sort(F.collect_list(F.col(at).cast("double"))).alias("ts"))

    def step(a: Column, t: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        waiting = (F.size(a) > 0) & (t <= last["at"])
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["at"].alias("at"), (last["n"] + 1).alias("n"))))
        start = F.when(F.size(a) == 0, t).otherwise(F.greatest(t, last["at"] + seconds))
        return F.when(waiting, joined).otherwise(F.array_append(a, F.struct(start.alias("at"), F.lit(1).cast("long").alias("n")))).cast(runs)

    done = times.select(by, F.explode(F.aggregate("ts", F.array().cast(runs), step)).alias("r"))
    return done.select(by, "r.at", "r.n")


def dispatched(messages: DataFrame, kinds: tuple[str, ...]) -> dict[str, DataFrame]:
    """The messages of each known kind, and under 'unknown' the rest, null kinds included."""
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    return {k: messages.where(F.col("kind") == k) for k in kinds} | {"unknown": messages.where(~known)}


def deep_link(params: Column) -> Column:
    """What a link's parameters ask for, by precedence: a payload, a place, a room; struct(action, value, schedule)."""
    get = lambda k: F.nullif(F.try_element_at(params, F.lit(k)), F.lit(""))
    action = F.when(get("qr").isNotNull(), "payload").when(get("loc").isNotNull(), "place").when(get("room").isNotNull(), "room")
    return F.struct(action.alias("action"), F.coalesce(get("qr"), get("loc"), get("room")).alias("value"), get("sched").alias("schedule"))


# What the chip says in each state; {0} is the building's name.
MESSAGES = {
    "locating": "Finding your location…",
    "denied": "Location is off for this site. You can still search for a starting room or building, or scan a campus QR code.",
    "unavailable": "Your location is not available right now. Search for a starting room or building, or scan a campus QR code.",
    "indoors": "You seem to be inside {0}. GPS is not precise indoors: scan a nearby campus QR code to set where you are.",
    "offcampus": "You are not on campus yet.",
}


def message(state: Column, building: Column) -> Column:
    """What a state's chip says, a null building as empty; null when nothing needs saying."""
    texts = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    return F.replace(F.try_element_at(texts, F.coalesce(state, F.lit(""))), F.lit("{0}"), F.coalesce(building, F.lit("")))


def campus_box(west: Column, south: Column, east: Column, north: Column, default: tuple[float, float, float, float]) -> Column:
    """struct(west, south, east, north) of the loaded map, or the default box where any bound is missing."""
    own = F.struct(*(c.cast("double").alias(n) for c, n in zip((west, south, east, north), ("west", "south", "east", "north"), strict=True)))
    fixed = F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(default, ("west", "south", "east", "north"), strict=True)))
    return F.when(west.isNull() | south.isNull() | east.isNull() | north.isNull(), fixed).otherwise(own)
