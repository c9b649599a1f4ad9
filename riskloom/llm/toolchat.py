"""Chat formatting with tool calls: calls and results are joined by their
identifier, ordered so that a call follows what it depends on, checked
against the tools' schemas, and written as canonical JSON.

Messages are rows (conversation, turn, role, text). An assistant's text that
is a JSON object with ``tool_calls`` holds calls (id, function name and
arguments, and optionally ``after``: ids it depends on); a ``tool`` message is
a JSON object with ``tool_call_id`` and ``content``. Every other row is a
plain message. The result has a row for each plain message, each call (with
its result) and each result that no call takes; sorted by ``order_at`` the
rows of a conversation are its formatted chat.

Calls lie in the order of their turns; where that contradicts a dependency,
a call moves behind the latest one that it needs. Moves spread to the calls
that need a moved one, in rounds of joins on the dependency key; calls that
end at one place are peeled in rounds (first those that need no other there),
and lie by round and turn. The rounds are as many as the longest chain of moved
calls. Calls on or behind a cycle come last; of each cycle the earliest call is
freed and marked. Only ids and places move; places come from a distributed
rank, so a conversation that holds a third of all rows is spread like any
other. Join keys that are hot meet a bounded broadcast.

Cases: a null id or conversation never links; an id used again marks the
later calls as ``duplicate``; further results of a call and results without
one are rows of their own (``extra``, ``orphan``); a result at or before its
call's turn is ``early``; the earliest call of a dependency cycle (or of cycles
that hang together, until all are cut) is marked; broken JSON is a plain message, broken arguments an error;
null texts are empty messages. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T
from riskloom.llm.graph import components, spread_join
from riskloom.operators.prefix import global_rank
from riskloom.session import cut_lineage

CALLS = ("tool_calls array<struct<id:string, function:struct<name:string, arguments:string>, "
         "after:array<string>>>")
RESULT = "tool_call_id string, content string"
SLOTS = 1 << 20            # calls of a message in order: turn * SLOTS + place
LAST = 1 << 62             # the place of calls on or behind a cycle
LOT = 4_096                # copies of a result that are written out at once

# Schemas of the tools of the derived trace (see ``trace``).
SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "words"], "additionalProperties": False,
            "properties": {"text": {"type": "string", "minLength": 1},
                           "words": {"type": "integer", "minimum": 1, "maximum": 60}}},
    "follow_up": {"type": "object", "required": ["text", "words"], "additionalProperties": False,
                  "properties": {"text": {"type": "string", "minLength": 1},
                                 "words": {"type": "integer", "minimum": 1, "maximum": 40}}},
}

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


# -------------------------------------------------------------- small parts

def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no escapes of letters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """How a value breaks a schema (type, enum, required, properties,
    additionalProperties, items, bounds of numbers, lengths and sizes)."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{path}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not in enum")
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            found.append(f"{path}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{path}: above maximum")
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            if len(value) < schema.get(low, 0):
                found.append(f"{path}: shorter than {low}")
            if len(value) > schema.get(high, len(value)):
                found.append(f"{path}: longer than {high}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{path}.{k}: unknown")
    return found


def check_arguments(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, list[str]]:
    """The parsed arguments (the raw string when broken) and all errors."""
    try:
        value = json.loads(arguments if arguments is not None else "null")
        canonical(value)
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]
    if name not in schemas:
        return value, ["$: unknown tool"]
    return value, violations(value, schemas[name])


# ----------------------------------------------------------------- the job

def _key(conv: Column, call: Column) -> Column:
    return F.concat_ws("\x1f", conv.cast("string"), F.when(conv.isNotNull(), call))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.when(F.col("call_id").isNotNull() & F.col("conv").isNotNull(),
                                       _key(F.col("conv"), F.col("call_id"))))


def split_messages(messages: DataFrame, conv: str, turn: str, role: str, text: str
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, plain messages)."""
    rows = messages.select(F.col(conv).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"),
                           F.col(role).alias("role"), F.col(text).alias("text"))
    looks = F.ltrim(F.coalesce("text", F.lit(""))).startswith("{")
    parsed = rows.withColumns({
        "_calls": F.when((F.col("role") == "assistant") & looks, F.from_json("text", CALLS)["tool_calls"]),
        "_result": F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT))})
    has_calls = F.coalesce(F.size("_calls") > 0, F.lit(False))
    has_result = F.coalesce(F.col("_result.tool_call_id").isNotNull() | F.col("_result.content").isNotNull(),
                            F.lit(False))
    calls = (parsed.filter(has_calls).select("conv", "turn", F.posexplode("_calls").alias("_pos", "_c"))
             .select("conv", "turn", (F.col("turn") * SLOTS + F.col("_pos")).alias("at"),
                     F.col("_c.id").alias("call_id"), F.col("_c.function.name").alias("name"),
                     F.col("_c.function.arguments").alias("arguments"), F.col("_c.after").alias("after")))
    results = parsed.filter(has_result).select("conv", "turn", F.col("_result.tool_call_id").alias("call_id"),
                                               F.col("_result.content").alias("content"))
    plain = parsed.filter(~has_calls & ~has_result).select("conv", "turn", "role", "text")
    return _keyed(calls), _keyed(results), plain


def _delays(edges: DataFrame, state: DataFrame, moved: DataFrame) -> DataFrame:
    """(key, place) of every call that its needs move: ``state`` spread from
    the calls ``moved`` to those that need them, until nothing moves."""
    while True:
        pushed = (edges.join(moved.select(F.col("key").alias("need"), F.col("place").alias("_to")), "need")
                  .filter("_to >= at").groupBy("key").agg(F.max("_to").alias("_to")))
        moved = cut_lineage(pushed.join(state, "key", "left").filter("place IS NULL OR _to > place")
                            .select("key", F.col("_to").alias("place")))
        if not moved.take(1):
            return state
        state = cut_lineage(state.unionByName(moved).groupBy("key").agg(F.max("place").alias("place")))


def _ties(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(key, need) of the calls that end at the place of a call they need."""
    of_need = state.select(F.col("key").alias("need"), F.col("place").alias("_there"))
    return cut_lineage(edges.join(state, "key").join(of_need, "need", "left")
                       .filter(F.col("place") == F.coalesce("_there", "need_at")).select("key", "need"))


def _freed(ties: DataFrame, edges: DataFrame) -> DataFrame:
    """(key) of the earliest call of each group of cycles. Calls that no other
    needs are behind the cycles and go first, in rounds."""
    core, n = ties, ties.count()
    while True:
        core = cut_lineage(core.join(core.select(F.col("need").alias("key")).distinct(), "key", "left_semi"))
        size = core.count()
        if size == n:
            break
        n = size
    roots = components(core, "key", "need").withColumnRenamed("node", "key")
    return cut_lineage(core.select("key").distinct().join(roots, "key", "left")
                       .join(edges.select("key", "at").distinct(), "key")
                       .groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("at", "key")).alias("_f"))
                       .select(F.col("_f.key").alias("key")))


def _peel(ties: DataFrame, edges: DataFrame, free: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """(key, round, cycle) of the calls that wait at their place, and the
    calls that cycles hold up; with ``free`` the cycles are cut."""
    blocked = cut_lineage(ties.select("key").distinct())
    n, turn, done = blocked.count(), 0, None
    while n:
        turn += 1
        ties = cut_lineage(ties.join(blocked.select(F.col("key").alias("need")), "need", "left_semi"))
        still = cut_lineage(ties.select("key").distinct())
        left, first = still.count(), None
        if left == n:
            if not free:
                return done, blocked
            first = _freed(ties, edges)
            ties = cut_lineage(ties.join(first, "key", "left_anti"))
            still = cut_lineage(ties.select("key").distinct())
            left = still.count()
        out = blocked.join(still, "key", "left_anti").select("key", F.lit(turn).alias("round"),
                                                             F.lit(first is not None).alias("cycle"))
        done = out if done is None else cut_lineage(done.unionByName(out))
        blocked, n = still, left
    return done, None


def _order(calls: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key -> order_at, cycle) of the calls of conversations whose turns
    contradict a dependency, and (key, n) of calls that depend on an unknown id."""
    wants = (calls.filter("_first").select("conv", "key", "at", F.explode("after").alias("need"))
             .filter(F.col("need").isNotNull())
             .withColumn("_need", _key(F.col("conv"), F.col("need"))))
    known = firsts.select(F.col("key").alias("_need"), F.col("first_at").alias("_need_at"))
    met = cut_lineage(wants.join(known, "_need", "left"))
    unknown = (met.filter(F.col("_need_at").isNull()).select("key", "_need").distinct()
               .groupBy("key").agg(F.count(F.lit(1)).alias("_unknown")))
    edges = cut_lineage(met.filter(F.col("_need_at").isNotNull())
                        .select("conv", "key", "at", F.col("_need").alias("need"), F.col("_need_at").alias("need_at")).distinct())
    start = cut_lineage(edges.filter("need_at >= at").groupBy("key").agg(F.max("need_at").alias("place")))
    if not start.take(1):
        return firsts.select("key", F.col("first_at").alias("order_at"), F.lit(False).alias("cycle")).limit(0), unknown
    state = _delays(edges, start, start)
    waits, held = _peel(_ties(edges, state), edges, free=False)
    if held is not None:
        last = held.select("key", F.lit(LAST).cast("long").alias("place"))
        state = cut_lineage(state.unionByName(last).groupBy("key").agg(F.max("place").alias("place")))
        state = _delays(edges, state, last)
        waits, _ = _peel(_ties(edges, state), edges, free=True)
    convs = edges.join(state, "key", "left_semi").select("conv").distinct()
    rows = cut_lineage(calls.filter("_first").join(convs, "conv", "left_semi").select("conv", "key", "at").distinct()
                       .join(state, "key", "left").join(waits, "key", "left")
                       .select("conv", "key", "at", F.coalesce("place", "at").alias("place"),
                               F.coalesce("round", F.lit(0)).alias("round"), F.coalesce("cycle", F.lit(False)).alias("cycle")))
    order = global_rank(rows, "place", by=["conv"], tiebreak=["round", "at", "key"], out="_nth")
    places = global_rank(rows.select("conv", "key", "at"), "at", by=["conv"], tiebreak=["key"], out="_nth")
    return (order.select("conv", "_nth", "key", "cycle")
            .join(places.select("conv", "_nth", F.col("at").alias("order_at")), ["conv", "_nth"])
            .select("key", "order_at", "cycle")), unknown


def format_chat(messages: DataFrame, schemas: dict | None = None, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """(conv, order_at, kind, call_id, name, status, valid, errors, json)."""
    schemas = SCHEMAS if schemas is None else schemas
    conv_type = messages.schema[conv].dataType.simpleString()
    calls, results, plain = split_messages(messages, conv, turn, role, text)
    calls, results = cut_lineage(calls), cut_lineage(results)
    firsts = cut_lineage(calls.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("at").alias("first_at")))
    marked = cut_lineage(spread_join(calls, firsts, "key", "left")
                         .withColumn("_first", F.coalesce(F.col("at") == F.col("first_at"), F.lit(False))))
    # the first result answers; the others stay rows of their own
    answers = cut_lineage(results.filter(F.col("key").isNotNull()).groupBy("key")
                          .agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results"))
                          .select("key", F.col("_r.turn").alias("result_turn"), F.col("_r.content").alias("content"),
                                  "n_results"))
    moved, unknown = _order(marked, firsts)
    side = cut_lineage(firsts.select("key").join(answers, "key", "left").join(moved, "key", "left")
                       .join(unknown, "key", "left"))
    joined = spread_join(marked, side, "key", "left")
    status = (F.when(~F.col("_first") & F.col("key").isNotNull(), "duplicate")
              .when(F.col("n_results").isNull(), "unanswered")
              .when(F.col("result_turn") <= F.col("turn"), "early").otherwise("linked"))
    ready = joined.select("conv", F.when(F.col("_first"), F.coalesce("order_at", "at")).otherwise(F.col("at"))
                          .alias("order_at"), "call_id", "name", status.alias("status"), "arguments",
                          F.when(F.col("_first"), F.col("content")).alias("content"),
                          F.coalesce("cycle", F.lit(False)).alias("cycle"),
                          F.coalesce("_unknown", F.lit(0)).alias("unknown"))
    names = ["conv", "order_at", "kind", "call_id", "name", "status", "valid", "errors", "json"]
    schema = (f"conv {conv_type}, order_at long, kind string, call_id string, name string, status string, "
              "valid boolean, errors string, json string")

    def write(batches):
        for batch in batches:
            valid, errors, out = [], [], []
            for row in batch.select(["call_id", "name", "status", "arguments", "content", "cycle",
                                     "unknown"]).to_pylist():
                value, found = check_arguments(row["name"], row["arguments"], schemas)
                found = found + ["dependency: cycle"] * row["cycle"] + ["dependency: unknown id"] * row["unknown"]
                valid.append(not found)
                errors.append("; ".join(found))
                out.append(canonical({"arguments": value, "id": row["call_id"], "name": row["name"],
                                      "result": row["content"], "status": row["status"]}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), T.string_column(["call"] * batch.num_rows), batch.column(2),
                 batch.column(3), batch.column(4), pa.array(valid, pa.bool_()), T.string_column(errors),
                 T.string_column(out)], names)

    done = ready.mapInArrow(write, schema)

    def say(kind: str) -> object:
        def run(batches):
            for batch in batches:
                out = [canonical({k: v for k, v in row.items()})
                       for row in batch.select(["a", "b"]).rename_columns(
                           ["content", "role"] if kind == "message" else ["id", "result"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], T.string_column(out)], names)

        return run

    none = F.lit(None).cast("string")
    message = plain.select(
        "conv", (F.col("turn") * SLOTS).alias("order_at"), F.lit("message").alias("kind"), none.alias("call_id"),
        none.alias("name"), F.lit("message").alias("status"), F.lit(True).alias("valid"), F.lit("").alias("errors"),
        F.coalesce("text", F.lit("")).alias("a"), F.col("role").alias("b")).mapInArrow(say("message"), schema)
    # results beside the one that answers: of its equal copies all but one are left
    takers = cut_lineage(answers.join(firsts, "key", "left"))
    numbered = spread_join(results, takers.select("key", "first_at", F.col("result_turn").alias("_t"),
                                                  F.col("content").alias("_content")), "key", "left")
    taken = F.coalesce(F.col("first_at").isNotNull() & (F.col("turn") == F.col("_t"))
                       & F.col("content").eqNullSafe(F.col("_content")), F.lit(False))
    fields = ["conv", "call_id", "turn", "content", "first_at"]
    over = F.col("_copies") - 1 - F.col("_lot") * LOT
    copies = (numbered.filter(taken).groupBy(*fields).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
              .withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 2) / LOT))))
              .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(over, F.lit(LOT).cast("long"))))))
    left = numbered.filter(~taken).select(*fields).unionByName(copies.select(*fields)).select(
        "conv", (F.col("turn") * SLOTS).alias("order_at"), F.lit("result").alias("kind"), "call_id",
        none.alias("name"), F.when(F.col("first_at").isNull(), "orphan").otherwise("extra").alias("status"),
        F.lit(False).alias("valid"), F.lit("").alias("errors"), F.col("call_id").alias("a"),
        F.col("content").alias("b")).mapInArrow(say("result"), schema)
    return (done.unionByName(message).unionByName(left)).withColumnRenamed("conv", conv)


# ------------------------------------------------------------------- trace

def trace(conversations: DataFrame) -> DataFrame:
    """Tool traffic derived from plain conversations, in the message format
    above: a user turn becomes a call (``ask`` at first, ``follow_up`` later),
    the assistant turn after it the call's result. Other turns stay as they are.

    Calls form topics of four places, two turns apart: the first depends on
    none, the second on the third, which comes later, the third on the first,
    the fourth on the third. In every eighth conversation the third depends on
    the second, so that these two are a cycle."""
    ident = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(text.alias("text"), words.alias("words")))
    topic = F.pmod(F.floor(F.col("turn") / 2), F.lit(4))
    step = F.when(topic == 1, 2).when((topic == 3) | (F.col("conv_id") % 8 == 0), -2).otherwise(-4)
    call = F.to_json(F.struct(F.array(F.struct(
        ident(F.col("turn")).alias("id"),
        F.struct(F.when(F.col("turn") < 2, "ask").otherwise("follow_up").alias("name"),
                 arguments.alias("arguments")).alias("function"),
        F.when(topic == 0, F.array().cast("array<string>"))
        .otherwise(F.array(ident(F.col("turn") + step))).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(ident(F.col("turn") - 1).alias("tool_call_id"), text.alias("content")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn",
        F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"))
