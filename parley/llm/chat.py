"""Chat formatting with DataFrame functions only: tool calls and results are linked, ordered, validated and serialised.

A turn's text is plain, or a JSON object. An object may hold `content`, `tool_calls` (a list of id, name, arguments)
and `tool_call_id` (then the turn is the result of that call). Calls and results meet in a hash join by conversation
and identifier. Messages are put in topological order, level by level: a result that stands before its call is moved
behind it, the results of its own calls behind that, and so on; arguments are checked against the schema of
the called tool; each message becomes one line of canonical JSON (keys sorted, no blanks, arguments as objects with
sorted keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, stored

#: Tools that may be called, with the types of their arguments; ? marks those that may be missing. A type
#: is a name, {"enum": texts}, {"items": type} or {"fields": {name: type}}; the latter may be missing if "optional".
SCHEMAS = {
    "calendar": {"title": "string", "kind": {"enum": ["call", "meeting"]}, "guests": {"items": "string", "optional": True}, "place": {"fields": {"city": "string", "room": "integer?"}, "optional": True}},
    "calculator": {"expression": "string"},
    "search": {"query": "string", "limit": "integer?"},
    "weather": {"city": "string", "days": "integer?", "metric": "boolean?"},
}
#: The names of JSON types among Spark's variant types.
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}

_CALLS = "array<struct<id:string,name:string,arguments:variant>>"


def _fits(value: Column, kind: str | dict) -> Column:
    """Whether a variant that is not null has a type."""

    def is_a(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(value).rlike(_TYPES[name]), F.lit(False))

    if isinstance(kind, str):
        return is_a(kind.rstrip("?"))
    if "enum" in kind:
        return is_a("string") & F.coalesce(F.try_variant_get(value, "$", "string").isin(kind["enum"]), F.lit(False))
    if "items" in kind:
        return is_a("array") & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_fits(x, kind["items"]), F.lit(False))), F.lit(False))
    return _fields_fit(value, kind["fields"])


def _fields_fit(value: Column, fields: dict[str, str | dict]) -> Column:
    """Whether an object has all that it needs, of the right types, and nothing else."""
    fits = F.coalesce(F.schema_of_variant(value).rlike(_TYPES["object"]), F.lit(False))
    for field, kind in sorted(fields.items()):
        own = F.try_variant_get(value, f"$.{field}", "variant")
        optional = kind.endswith("?") if isinstance(kind, str) else kind.get("optional", False)
        right = F.coalesce(_fits(own, kind), F.lit(False))
        fits = fits & ((own.isNull() | right) if optional else (own.isNotNull() & right))
    names = F.json_object_keys(F.to_json(value))
    known = F.array(*(F.lit(x) for x in sorted(fields))) if fields else F.array().cast("array<string>")
    return fits & F.coalesce(F.size(F.array_except(names, known)) == 0, F.lit(False))


def _valid(call: Column, schemas: dict[str, dict]) -> Column:
    """Whether a call fits the schema of its tool."""
    verdict = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        verdict = F.when(call["name"] == tool, _fields_fit(call["arguments"], fields)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def _places(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, h, place, depth) of the results that are linked with a call: the turn they stand at, and their
    level behind the message that stands there by its own turn."""
    # Identifiers only, written once and then asked: a condition on what is parsed would parse all texts for itself.
    ids = stored(parsed.select("conv_id", "turn", "h", "answers", F.col("calls.id").alias("ids")))
    calls = ids.select("conv_id", "turn", "h", F.explode("ids").alias("answers")).where("answers is not null")
    first = calls.groupBy("conv_id", "answers").agg(F.min(F.struct("turn", "h")).alias("call"))
    links = ids.where("answers is not null").select("conv_id", "turn", "h", "answers", (F.size("ids") > 0).alias("calls")).join(first, ["conv_id", "answers"])
    links = cut(links.select("conv_id", "turn", "h", "calls", F.col("call.turn").alias("call_turn"), F.col("call.h").alias("call_h")))
    caller = [F.col("l.conv_id") == F.col("c.conv_id"), F.col("l.call_turn") == F.col("c.turn"), F.col("l.call_h") == F.col("c.h")]

    def placed(rows: DataFrame, place: Column, depth: Column) -> DataFrame:
        at = F.greatest(F.col("l.turn"), place)
        return rows.select("l.conv_id", "l.turn", "l.h", at.alias("place"), F.when(F.col("l.turn") > place, 0).otherwise(depth + 1).alias("depth"))

    # Calls of messages that are no linked results stand where they are; level by level the others follow.
    callers = links.where("calls")
    if callers.isEmpty():
        return placed(links.alias("l"), F.col("l.call_turn"), F.lit(0))
    waits = links.alias("l").join(callers.alias("c"), caller, "left_semi")
    done = placed(links.alias("l").join(callers.alias("c"), caller, "left_anti"), F.col("l.call_turn"), F.lit(0))
    last, open_ = done, cut(waits)
    while left := open_.count():
        done, last = cut(done), cut(last)
        new = cut(placed(open_.alias("l").join(last.alias("c"), caller), F.col("c.place"), F.col("c.depth")))
        done, last = done.union(new), new
        open_ = cut(open_.join(new.select("conv_id", "turn", "h"), ["conv_id", "turn", "h"], "left_anti"))
        if open_.count() == left:
            # Calls in a circle, and what follows from them, stay at their own turns.
            return done.union(open_.select("conv_id", "turn", "h", F.col("turn").alias("place"), F.lit(0).alias("depth")))
    return done


def chat_messages(turns: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> one row per message: conv_id, turn, place (the turn it comes after or
    at), depth (its level behind the message of that turn), moved, role, n_calls, n_invalid, is_result, linked, json.

    A message is one distinct (conv_id, turn, role, text); repeated rows are one message. Rows without conv_id or turn
    are left out, a null role is "unknown", a null text an empty one. Text that is no JSON object is plain content. A
    call without id or name is invalid; of calls that share an id in a conversation the first (by turn, then a hash of
    role and text) takes the results; results that share an id are all linked; a result without such a call stays where
    it is, not linked; messages that wait for each other's calls in a circle stay where they are, linked. Numbers keep their JSON form. Further columns are ignored; an empty table gives no row.
    """
    rows = turns.where("conv_id is not null and turn is not null").select(
        "conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).distinct()
    object_ = F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    parsed = rows.withColumn("v", object_).withColumn("v", F.when(F.schema_of_variant("v").rlike("^OBJECT"), F.col("v")))
    parsed = parsed.select(
        "conv_id", "turn", "role", F.xxhash64("role", "text").alias("h"),
        F.when(F.col("v").isNull(), F.col("text")).otherwise(F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit(""))).alias("content"),
        F.coalesce(F.try_variant_get("v", "$.tool_calls", _CALLS), F.array().cast(_CALLS)).alias("calls"),
        F.try_variant_get("v", "$.tool_call_id", "string").alias("answers"),
    )
    joined = parsed.join(_places(parsed), ["conv_id", "turn", "h"], "left")
    checked = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    sound = F.transform("calls", lambda c: c["id"].isNotNull() & F.coalesce(_valid(c, schemas), F.lit(False)))
    out = joined.withColumn("sound", sound).withColumn("calls", checked)
    message = F.to_json(
        F.struct(
            F.col("content"),
            F.col("role"),
            F.col("answers").alias("tool_call_id"),
            F.when(F.size("calls") > 0, F.col("calls")).alias("tool_calls"),
        )
    )
    return out.select(
        "conv_id",
        "turn",
        F.coalesce("place", "turn").alias("place"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce(F.col("place") > F.col("turn"), F.lit(False)).alias("moved"),
        "role",
        F.size("calls").cast("long").alias("n_calls"),
        F.size(F.filter("sound", lambda x: ~x)).cast("long").alias("n_invalid"),
        F.col("answers").isNotNull().alias("is_result"),
        F.col("place").isNotNull().alias("linked"),
        message.alias("json"),
    )


def format_chats(turns: DataFrame, schemas: dict[str, dict] = SCHEMAS, part_turns: int = 1000) -> DataFrame:
    """turns -> one row per conversation and part: conv_id, part, n_messages, n_calls, n_results, n_linked, n_moved,
    n_invalid, messages (a JSON list of the messages in order).

    Messages are ordered by place, then level (a moved result comes after all of its call's turn), turn, role and text. A part is
    the stretch of part_turns turn numbers that holds a message's place, so that a conversation of any length is never
    one row or one task's list; short ones have part 0 only. Edge cases are those of chat_messages().
    """
    messages = chat_messages(turns, schemas)
    part = F.floor(F.col("place") / part_turns).cast("long")
    one = F.struct("place", "depth", "turn", "role", "json")
    grouped = messages.groupBy("conv_id", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum("n_calls").alias("n_calls"),
        F.sum(F.col("is_result").cast("long")).alias("n_results"),
        F.sum((F.col("linked") & F.col("is_result")).cast("long")).alias("n_linked"),
        F.sum(F.col("moved").cast("long")).alias("n_moved"),
        F.sum("n_invalid").alias("n_invalid"),
        F.array_sort(F.collect_list(one)).alias("m"),
    )
    return grouped.select("conv_id", "part", "n_messages", "n_calls", "n_results", "n_linked", "n_moved", "n_invalid", F.concat(F.lit("["), F.array_join("m.json", ","), F.lit("]")).alias("messages"))
