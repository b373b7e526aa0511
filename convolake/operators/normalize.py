"""Order within conversations: runs of roles, places, attachments between turns, the best of several readings, and version graphs.

Operators take messages with a conversation_id, a place and what else they name; where the input knows its own keys, they are parameters, names or Column expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.text import strip
from convolake.operators.base import over, sql_operator

consecutive_roles = sql_operator("SELECT conversation_id, count(CASE WHEN role = before THEN 1 END) AS n FROM (SELECT conversation_id, role, lag(role) OVER (PARTITION BY conversation_id ORDER BY pos) AS before FROM {messages}) t GROUP BY conversation_id", "messages")
message_index = sql_operator("SELECT platform, conversation_id, msg_seq, row_number() OVER (PARTITION BY platform, conversation_id ORDER BY msg_seq) AS message_index FROM {messages}", "messages")
first_message = sql_operator("SELECT conversation_id, CAST(min(ts) AS VARCHAR(40)) AS first_ts, min(CASE WHEN role = 'assistant' THEN msg_seq END) AS first_answer FROM {messages} GROUP BY conversation_id", "messages")
#: Runs of one role as one message each.
_RUNS = "SELECT *, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conversation_id ORDER BY pos) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conversation_id ORDER BY pos) AS before FROM {messages}) t"
role_runs = sql_operator(f"SELECT conversation_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS n, min(pos) AS first_pos FROM ({_RUNS}) r GROUP BY conversation_id, run", "messages")


def _by(*order: Column | str) -> Window:
    return Window.partitionBy("conversation_id").orderBy(*order)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nth_message(messages: DataFrame, n: int, order: str = "msg_seq") -> DataFrame:
    """The n-th message of each conversation, counted from 1; conversations with fewer have no row."""
    return messages.withColumn("__k", F.row_number().over(_by(order))).where(F.col("__k") == n).drop("__k")


def first_n(messages: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first n messages of each conversation, and whether it has more."""
    rows = messages.withColumns({"__k": F.row_number().over(_by(order)), "truncated": F.count(F.lit(1)).over(Window.partitionBy("conversation_id")) > n})
    return rows.where(F.col("__k") <= n).drop("__k")


def attach_pending(messages: DataFrame, visible: Column | str, order: str = "pos") -> DataFrame:
    """What stands between turns goes to the next visible message: messages with owner, its message_id, null after the last one; a visible message owns itself."""
    ahead = _by(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return messages.withColumn("owner", F.first(F.when(_col(visible), F.col("message_id")), ignorenulls=True).over(ahead))


def fill_times(messages: DataFrame, time: Column | str = "ts", order: str = "pos") -> DataFrame:
    """Times that are missing, from the nearest message before or else after, then in order of time: messages with filled, origin (own, before, after, none) and place from 1."""
    before = F.last(_col(time), ignorenulls=True).over(_by(order).rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(_col(time), ignorenulls=True).over(_by(order).rowsBetween(1, Window.unboundedFollowing))
    told = messages.withColumns({"__own": _col(time), "__before": before, "__after": after})
    origin = F.when(F.col("__own").isNotNull(), "own").when(F.col("__before").isNotNull(), "before").when(F.col("__after").isNotNull(), "after").otherwise("none")
    told = told.select(*messages.columns, F.coalesce("__own", "__before", "__after").alias("filled"), origin.alias("origin"))
    return told.withColumn("place", F.row_number().over(_by(F.col("filled").asc_nulls_last(), order)))


def best_of(messages: DataFrame, key: Column | str, *order: Column) -> DataFrame:
    """Of the messages of a conversation that share a key the first in the given order, with the key."""
    keyed = messages.withColumn("key", _col(key))
    return keyed.withColumn("__k", F.row_number().over(Window.partitionBy("conversation_id", "key").orderBy(*order))).where("__k = 1").drop("__k")


def longest_row(messages: DataFrame, key: Column | str) -> DataFrame:
    """Of the renderings of one row the longest, the first of equally long ones."""
    return best_of(messages, key, F.length("texte").desc_nulls_last(), F.col("pos"))


def best_turn(messages: DataFrame, key: Column | str, answered: Column | str) -> DataFrame:
    """Of the readings of a turn one with an answer, later ones before earlier; turns in the order in which they were first seen (place, from 1)."""
    seen = messages.withColumns({"__key": _col(key), "__first": F.min("pos").over(Window.partitionBy("conversation_id", _col(key)))})
    best = best_of(seen, "__key", F.when(_col(answered), 0).otherwise(1), F.col("pos").desc())
    return best.withColumn("place", F.row_number().over(_by("__first"))).drop("__first", "__key")


def last_per_key(messages: DataFrame, key: Column | str) -> DataFrame:
    """The last message of each key, by place and key (place, from 1)."""
    return best_of(messages, key, F.col("pos").desc()).withColumn("place", F.row_number().over(_by("pos", "key")))


def nearest_heading(messages: DataFrame, heading: Column | str, order: str = "pos") -> DataFrame:
    """messages with heading: the value of the nearest one at or before each, where heading isn't null."""
    return messages.withColumn("heading", F.last(_col(heading), ignorenulls=True).over(_by(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def dedupe_keep_first(messages: DataFrame, key: Column | str, order: str = "msg_seq") -> DataFrame:
    """The first message of each key, numbered anew (place, from 1); messages without a key all stay."""
    keyed = messages.withColumn("key", _col(key))
    first = F.row_number().over(Window.partitionBy("conversation_id", "key").orderBy(order))
    return keyed.withColumn("__k", first).where("__k = 1 OR key IS NULL").drop("__k").withColumn("place", F.row_number().over(_by(order)))


def siblings(messages: DataFrame, group: list[str], order: str = "msg_seq") -> DataFrame:
    """Versions of one message: messages with the same values of group, as parent and role; with n of them, version from 0 and whether it is the active (last) one."""
    same = Window.partitionBy("conversation_id", *group)
    at = F.row_number().over(same.orderBy(order))
    return messages.withColumns({"n": F.count(F.lit(1)).over(same), "version": at - 1, "active": at == F.count(F.lit(1)).over(same)})


def suite_answer(messages: DataFrame, asked: Column | str, order: str = "pos") -> DataFrame:
    """The answer that follows the first message that asks: conversation_id, asked_seq, answer_seq; only messages of users ask, and only an assistant's next message answers."""
    at = _by(order)
    told = messages.withColumns({"__role": F.lead("role").over(at), "__seq": F.lead("msg_seq").over(at)})
    found = told.where(_col(asked) & (F.col("role") == "user") & (F.col("__role") == "assistant"))
    return found.groupBy("conversation_id").agg(F.min_by("msg_seq", order).alias("asked_seq"), F.min_by("__seq", order).alias("answer_seq"))


def follow(steps: DataFrame, node: str) -> DataFrame:
    """Whole walks from the nodes that start one: (conversation_id, node, depth), from steps (conversation_id, node, next, start). A walk ends where there is no row for the next node, or one that it has met. The nodes of a conversation are one group."""

    def run(table: pa.Table) -> pa.Table:
        own, to, starts = (table.column(c).to_pylist() for c in (node, "next", "start"))
        after, met, depths = dict(zip(own, to, strict=True)), [], []
        for at in dict.fromkeys(n for n, s in zip(own, starts, strict=True) if s):
            seen = set()
            while at is not None and at in after and at not in seen:
                met.append(at)
                depths.append(len(seen))
                seen.add(at)
                at = after[at]
        key = table.column("conversation_id")[0].as_py()
        return pa.table({"conversation_id": pa.array([key] * len(met), table.schema.field("conversation_id").type), node: pa.array(met, table.schema.field(node).type), "depth": pa.array(depths, pa.int32())})

    kinds = dict(steps.dtypes)
    return steps.select("conversation_id", node, "next", "start").groupBy("conversation_id").applyInArrow(run, f"conversation_id {kinds['conversation_id']}, {node} {kinds[node]}, depth int")


def active_branch(messages: DataFrame, node: str = "pos", parent: str = "parent", leaf: Column | str = "leaf") -> DataFrame:
    """Path from the leaf of each conversation to its root, along parent: (conversation_id, node, depth). leaf says which messages are one."""
    return follow(messages.select("conversation_id", node, F.col(parent).alias("next"), _col(leaf).alias("start")), node)


def chain(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Order of keys from edges between them: (conversation_id, key, place).

    keys: conversation_id, key, seen (its place in the order of discovery). edges: conversation_id, key, next, seen; edges to or from a key that isn't there, or to itself, don't count. From each key
    that none precedes, and then from those left over, by the order of discovery, the first successor that has not been placed is followed. The keys of a conversation are one group.
    """

    def run(keys_of: pa.Table, edges_of: pa.Table) -> pa.Table:
        order = sorted(zip(keys_of.column("seen").to_pylist(), keys_of.column("key").to_pylist(), strict=True), key=lambda x: x[0])
        known = dict.fromkeys(k for _, k in order)
        after: dict = {}
        preceded = set()
        for _, a, b in sorted(zip(*(edges_of.column(c).to_pylist() for c in ("seen", "key", "next")), strict=True), key=lambda x: x[0]):
            if a in known and b in known and a != b:
                after.setdefault(a, {})[b] = None
                preceded.add(b)
        placed: dict = {}
        for start in [*(k for k in known if k not in preceded), *known]:
            at = start
            while at is not None and at not in placed:
                placed[at] = len(placed)
                at = next((n for n in after.get(at, ()) if n not in placed), None)
        of = keys_of.column("conversation_id")[:1].to_pylist()
        return pa.table({"conversation_id": pa.array(of * len(placed), keys_of.schema.field("conversation_id").type), "key": pa.array(list(placed), keys_of.schema.field("key").type), "place": pa.array(list(placed.values()), pa.int32())})

    kinds = dict(keys.dtypes)
    rows = keys.select("conversation_id", "key", "seen").groupBy("conversation_id").cogroup(edges.select("conversation_id", "key", "next", "seen").groupBy("conversation_id"))
    return rows.applyInArrow(run, f"conversation_id {kinds['conversation_id']}, key {kinds['key']}, place int")


def window_chain(windows: DataFrame) -> DataFrame:
    """Order of keys from overlapping windows (conversation_id, window, pos, key), of which each shows some keys in order: chain() over the pairs of neighbours; keys and edges count from the first window that has them."""
    seen = F.struct("window", "pos")
    told = windows.withColumn("next", F.lead("key").over(Window.partitionBy("conversation_id", "window").orderBy("pos")))
    keys = windows.groupBy("conversation_id", "key").agg(F.min(seen).alias("at"))
    keys = keys.select("conversation_id", "key", F.row_number().over(_by("at")).alias("seen"))
    edges = told.where("next IS NOT NULL").select("conversation_id", "key", "next", F.row_number().over(_by("window", "pos")).alias("seen"))
    return chain(keys, edges)


def fold_runs(messages: DataFrame) -> DataFrame:
    """Messages with alternating roles. In a run a text that the one so far holds is dropped, one that holds it replaces it, and others follow after a blank line; the first message_id, model and time that aren't empty stay."""
    runs = over(_RUNS, messages=messages)
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", "texte"))), lambda x: F.coalesce(x["texte"], F.lit("")))

    def step(so_far, new):
        a, b = strip(so_far), strip(new)
        return F.when((b == "") | F.contains(a, b), so_far).when((a != "") & F.contains(b, a), new).otherwise(strip(F.concat(so_far, F.lit("\n\n"), new)))

    first = lambda c: F.min_by(F.nullif(F.col(c).cast("string"), F.lit("")), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col("pos"))).alias(c)
    out = runs.groupBy("platform", "conversation_id", "run").agg(F.min("role").alias("role"), said.alias("said"), first("message_id"), first("model"), first("ts"))
    return out.withColumn("texte", F.aggregate(F.slice("said", 2, F.size("said")), F.get("said", 0), step)).drop("said").withColumn("run", F.col("run").cast("long"))
