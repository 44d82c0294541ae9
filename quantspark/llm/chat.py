"""Chat formatting with tool-call linking, in DataFrame functions alone.

Turns are rows (conv_id, turn, role, text). A text that is a JSON object may declare tools, make calls or give a
result:

* ``{"tools": [{"name": n, "parameters": {"required": [...], "properties": {p: {"type": t}}}}]}`` in any turn,
* ``{"tool_calls": [{"id": i, "name": n, "arguments": {...}}], "content": c}``,
* ``{"tool_call_id": i, "content": c}``.

Calls and results are joined by (conv_id, id) with a hash join; the first call of an id has it, and its first later
result answers it. A call depends on calls whose ids its arguments name as ``{"$ref": id}``; its level is one more
than the highest level among them (calls on a cycle, or after one, have none), and (level, turn, nth) is a topological
order. Arguments are checked against the tool's schema: all required keys, known types. Each message and call becomes
one canonical JSON text: keys in order, no spaces.

All rows stay rows: a conversation of any length is never gathered in one task, and joins have a shuffle on either
side, so a very long conversation is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.store import cut

_BODY = "tools array<struct<name string, parameters string>>, tool_calls array<struct<id string, name string, arguments string>>, tool_call_id string, content string"
_SCHEMA = "required array<string>, properties map<string, struct<type string>>"
#: Types of JSON schema by the name that a variant's own type begins with (fixed values).
_TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def canonical(json: Column) -> Column:
    """A JSON text with keys in order and no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def parsed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, body: the fields of a turn whose text is a JSON object, else null."""
    text = F.col("text")
    body = F.when(text.rlike(r"^\s*\{"), F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), _BODY))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.cast("string").alias("text"), body.alias("body"))


def tool_schemas(body: DataFrame) -> DataFrame:
    """(conv_id, name, schema): the first declaration of each tool of a conversation."""
    tools = body.where(F.size("body.tools") > 0).select("conv_id", "turn", F.posexplode("body.tools").alias("nth", "tool"))
    first = tools.where("tool.name IS NOT NULL").groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min_by("tool.parameters", F.struct("turn", "nth")).alias("parameters"))
    return first.select("conv_id", "name", F.from_json("parameters", _SCHEMA).alias("schema"))


def calls_of(body: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, id, name, arguments): each call made."""
    made = body.where(F.size("body.tool_calls") > 0).select("conv_id", "turn", F.posexplode("body.tool_calls").alias("nth", "call"))
    return made.select("conv_id", "turn", "nth", "call.id", "call.name", "call.arguments")


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` with ``result_turn`` and ``result``: the first later result of the first call of an id."""
    # Both kept: the join then has a shuffle on either side, and results of one id are combined before theirs.
    first = cut(calls.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "nth")).alias("first")))
    answered = cut(results.join(first, ["conv_id", "id"]).where("result_turn > first.turn"))
    answered = answered.groupBy("conv_id", "id", "first").agg(F.min(F.struct("result_turn", "result")).alias("answer"))
    answered = answered.select("conv_id", F.col("first.turn").alias("turn"), F.col("first.nth").alias("nth"), "answer.result_turn", "answer.result")
    return calls.join(answered, ["conv_id", "turn", "nth"], "left")


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, id, to, far, stuck) of calls with one dependency (conv_id, id, to): the first call along the chain that has none or several.

    Each round doubles the way that a call has gone, so rounds grow with the logarithm of the longest chain. Calls on a
    cycle, or after one, never arrive: they are ``stuck``. As all others arrive in order of their distance, they alone
    are left once as many went on as in the round before.
    """
    chains, before = single.select("conv_id", "id", "to", F.lit(1).cast("long").alias("far")), None
    while True:
        onward = chains.select("conv_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        step = chains.join(onward, ["conv_id", "to"], "left")
        chains = cut(step.select("conv_id", "id", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("stuck")))
        going = chains.where("stuck").count()
        if going in (0, before):
            return chains
        before = going


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of calls with dependencies on calls of their conversation; null on or after a cycle.

    Chains of calls with one dependency each are shortened to their ends first. What is left are calls with several; a
    round settles all whose dependencies are settled, so rounds are as many as such calls follow one another.
    """
    key = ["conv_id", "id"]
    named = F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), F.lit(1))
    known = calls.where("id IS NOT NULL").select(*key).distinct()
    needs = calls.where("id IS NOT NULL").select(*key, F.explode(named).alias("to")).distinct()
    needs = cut(needs.join(known.withColumnRenamed("id", "to"), ["conv_id", "to"]))
    if needs.isEmpty():
        return needs.select(*key, F.lit(None).cast("long").alias("level"))
    count = cut(needs.groupBy(*key).agg(F.count("*").alias("n"), F.min("to").alias("to")))
    chains = _chains(count.where("n = 1"))
    ends = chains.select("conv_id", F.col("id").alias("to"), F.when(~F.col("stuck"), F.col("to")).alias("end"), "far")
    several = needs.join(count.where("n > 1").select(*key), key, "left_semi").join(ends, ["conv_id", "to"], "left")
    # A stuck call stands for itself: it is never settled, and neither is what needs it.
    several = cut(several.select(*key, F.coalesce("end", "to").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    free = known.join(count.select(*key), key, "left_anti").select("conv_id", F.col("id").alias("to"), F.lit(0).cast("long").alias("level"))
    settled = cut(free.join(several.select("conv_id", "to").union(chains.select("conv_id", "to")).distinct(), ["conv_id", "to"], "left_semi"))
    done, n_done = settled.limit(0), 0
    while not several.isEmpty():
        reached = several.join(settled.unionByName(done), ["conv_id", "to"], "left")
        state = reached.groupBy(*key).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("waits"))
        now = cut(state.where("waits = 0").select("conv_id", F.col("id").alias("to"), "level"))
        done, before, n_done = now, n_done, now.count()
        if n_done == before:
            break
    along = chains.where("NOT stuck").join(settled.unionByName(done), ["conv_id", "to"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return count.select(*key).join(along.unionByName(done.withColumnRenamed("to", "id")), key, "left")


def valid_arguments(arguments: Column, schema: Column) -> Column:
    """Whether a JSON object has all required keys and only values of the types that its schema names.

    Null without a schema; false for what isn't a JSON object.
    """
    values = F.from_json(arguments, "map<string, variant>")
    required = F.coalesce(schema["required"], F.array().cast("array<string>"))
    complete = F.forall(required, lambda k: F.map_contains_key(values, k))

    def fits(entry: Column) -> Column:
        wanted = F.try_element_at(schema["properties"], entry["key"])["type"]
        kind = F.schema_of_variant(entry["value"])
        known = F.lit(True)
        for name, pattern in _TYPES.items():
            known = F.when(wanted == name, F.coalesce(kind, F.lit("VOID")).rlike(pattern)).otherwise(known)
        return F.coalesce(known, F.lit(True))

    typed = F.when(schema["properties"].isNull(), F.lit(True)).otherwise(F.forall(F.map_entries(values), fits))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).rlike("^OBJECT"), F.lit(False))
    return F.when(schema.isNull(), F.lit(None).cast("boolean")).otherwise(F.when(is_object, complete & typed).otherwise(F.lit(False)))


def formatted(turns: DataFrame) -> DataFrame:
    """One row for each message and each call: conv_id, turn, nth, kind, role, call_id, level, result_turn, valid, json.

    ``kind`` is ``message`` (nth -1), ``call``, or ``result`` for a result turn (nth -1); a result that answers no
    call is ``orphan``. Null roles and texts stay null in the JSON text (and are left out of it); turns with equal
    numbers are rows of their own; texts that aren't JSON objects are plain messages; an empty table gives an empty
    result. Other columns are ignored.
    """
    body = cut(parsed(turns))
    calls = calls_of(body)
    results = body.where("body.tool_call_id IS NOT NULL").select("conv_id", F.col("body.tool_call_id").alias("id"), F.col("turn").alias("result_turn"), F.coalesce("body.content", F.lit("")).alias("result"))
    answered = cut(linked(calls, results))
    # Kept, so that the joins below have a shuffle of their own on this side too, and a long conversation is split.
    deep = cut(levels(calls))
    schemas = cut(tool_schemas(body))
    checked = answered.join(schemas, ["conv_id", "name"], "left").withColumn("valid", valid_arguments(F.col("arguments"), F.col("schema")))
    order = checked.join(deep.withColumn("deep", F.lit(True)), ["conv_id", "id"], "left")
    level = F.when(F.col("deep"), F.col("level")).otherwise(F.lit(0))
    call_json = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "id", "name", "result"))
    call_rows = order.select("conv_id", "turn", F.col("nth").cast("int").alias("nth"), F.lit("call").alias("kind"), F.lit("assistant").alias("role"), F.col("id").alias("call_id"), level.cast("int").alias("level"), "result_turn", "valid", call_json.alias("json"))
    used = answered.where("result_turn IS NOT NULL").select("conv_id", F.col("id").alias("__id"), F.col("result_turn").alias("turn")).distinct().withColumn("used", F.lit(True))
    used = cut(used)
    is_call = F.size("body.tool_calls") > 0
    content = F.when(F.col("body.tool_call_id").isNotNull() | is_call, F.col("body.content")).otherwise(F.col("text"))
    rows = body.withColumn("__id", F.col("body.tool_call_id"))
    plain = rows.where("__id IS NULL").withColumn("used", F.lit(None).cast("boolean"))
    answers = rows.where("__id IS NOT NULL").join(used, ["conv_id", "__id", "turn"], "left").select(*plain.columns)
    messages = plain.unionByName(answers)
    kind = F.when(F.col("__id").isNull(), "message").when(F.coalesce("used", F.lit(False)), "result").otherwise("orphan")
    message_json = F.to_json(F.struct(content.alias("content"), "role", F.col("__id").alias("tool_call_id")))
    message_rows = messages.select("conv_id", "turn", F.lit(-1).alias("nth"), kind.alias("kind"), "role", F.col("__id").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("boolean").alias("valid"), message_json.alias("json"))
    return message_rows.unionByName(call_rows)
