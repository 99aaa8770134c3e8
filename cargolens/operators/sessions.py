"""Conversation state in batch: bounded tails, history texts, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import questions as q
from ..sources.tables import scratch

MAX_TURNS = 20
#: Turn numbers of a segment.
SEGMENT = 4096
# What a follow-up takes from the turns before it.
STICKY = (
    "customername", "customercode", "orderstatus", "currencycode", "companycode", "pickup_location", "delivery_location", "pin",
    "state", "city", "address", "location", "location_side", "salesmanname", "commodityname",
)
CARRIED = (*STICKY, "order_token")


def session_tail(turns: DataFrame, n: int = MAX_TURNS) -> DataFrame:
    """The last n turns of each session."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_n", last).filter(F.col("_n") <= n).drop("_n")


def session_history(turns: DataFrame, n: int = 6, chars: int = 500) -> DataFrame:
    """(conv_id, history): ``ROLE: text`` lines of the last n turns, empty ones skipped."""
    tail = session_tail(turns, n)
    line = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(chars))))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    lines = F.filter(F.transform(ordered, lambda x: x["line"]), lambda x: x.isNotNull())
    text = F.when(F.size(lines) == 0, F.lit("(no prior turns)")).otherwise(F.array_join(lines, "\n"))
    return tail.groupBy("conv_id").agg(text.alias("history"))


def session_append(sessions: DataFrame, new_turns: DataFrame, now: Column, n: int = MAX_TURNS) -> DataFrame:
    """Sessions (conv_id, turns, created_at, updated_at) with the turns of a batch added.

    ``created_at`` is set once, ``updated_at`` with each batch; turns are cut to the last n.
    """
    # the last turns of the batch are enough; their ranks are limited inside tasks
    added = session_tail(new_turns, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("added"))
    both = sessions.join(added, "conv_id", "full_outer")
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    all_turns = F.concat(F.coalesce("turns", empty), F.coalesce("added", empty))
    return both.select(
        "conv_id",
        F.slice(all_turns, F.greatest(F.lit(1), F.size(all_turns) - n + 1), n).alias("turns"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("added").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def with_entities(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) with what each turn names: filters, ``location_side``, ``order_token``, ``follow_up``, ``about_last_order``."""
    d = F.col("_d")
    named = q.filter_columns(d)
    located = F.coalesce(*(named[n] for n in ("pin", "state", "city", "address", "location")), q.country(d)).isNotNull()
    named |= {"location_side": F.when(located, q.side(d)), "order_token": q.order_token(d), "follow_up": q.follow_up(d), "about_last_order": q.about_last_order(d)}
    return turns.withColumn("_d", q.read(F.col("text"))).withColumns(named).drop("_d")


def carry(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, text) with ``<name>_in_force`` for all that is carried on.

    What the turns name is worked out once and written to the checkpoint folder, as it is read
    more than once.
    """
    named, path = with_entities(turns), scratch(turns.sparkSession)
    named.write.option("compression", "zstd").parquet(path)
    kept = turns.sparkSession.read.schema(named.schema).parquet(path)
    return sticky(kept, dict.fromkeys(STICKY, F.col("follow_up")) | {"order_token": F.col("about_last_order")})


def sticky(annotated: DataFrame, columns: list[str] | dict[str, Column], follow_up: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """Each column's value in force: the turn's own, or the session's last one on a follow-up.

    ``columns`` may name a follow-up of their own for each column. A session is cut into segments
    of turn numbers. Each segment is summed up by the last value of every column, added up inside
    tasks; what comes into a segment follows from the summaries before it, and segments then go
    on by themselves, so that a session of any length is no task. Where no session has a second
    segment nothing is summed up.
    """
    follow = columns if isinstance(columns, dict) else dict.fromkeys(columns, follow_up)
    taken = {c: f"_in_{i}" for i, c in enumerate(follow)}
    asks = {c: f"_follows_{i}" for i, c in enumerate(follow)}
    # rows without a turn number come first
    part = F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 60)))
    rows = annotated.withColumns({"_part": part} | {asks[c]: f for c, f in follow.items()})
    if rows.groupBy("conv_id").agg((F.min("_part") < F.max("_part")).alias("more")).filter("more").isEmpty():
        both = rows.withColumns({t: F.lit(None).cast(rows.schema[c].dataType) for c, t in taken.items()})
    else:
        last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.coalesce("turn", F.lit(-(1 << 60))))))
        sums = rows.groupBy("conv_id", "_part").agg(*(last(c).alias(t) for c, t in taken.items()))
        earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        comes = sums.select("conv_id", "_part", *(F.last(t, ignorenulls=True).over(earlier).alias(t) for t in taken.values()))
        both = rows.alias("r").join(comes.alias("c"), F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r._part") == F.col("c._part")))
        both = both.select("r.*", *(F.col(f"c.{t}") for t in taken.values()))
    past = Window.partitionBy("conv_id", "_part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        f"{c}_in_force": F.coalesce(F.col(c), F.when(F.col(asks[c]), F.coalesce(F.last(c, ignorenulls=True).over(past), F.col(t)))) for c, t in taken.items()
    }
    return both.withColumns(carried).drop("_part", *asks.values(), *taken.values())
