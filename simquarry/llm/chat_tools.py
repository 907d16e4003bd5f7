"""Chat formatting: tool-call linking, with DataFrame functions only.

Calls and results are hash-joined on (conversation, identifier), calls are put in topological
order of their references, arguments are validated against schemas, and each linked call is
written as canonical JSON: UTF-8, keys sorted by code point, no spaces, a number as Spark's variant
writes it (integers without exponent, 1.50 as 1.5). Arguments that aren't JSON, or repeat a key,
are written as one string.

No step gathers a conversation: joins go by conversation and identifier, depths come from path
doubling over references, and places within a conversation from prefix sums over blocks of turns.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise

#: Turns of a block whose calls are numbered together.
TURNS = 256
#: Tool -> argument -> (kind, required). A kind is a JSON type ("string", "integer", "number",
#: "boolean", "object", "array", "null"), "array<type>" of one of these (but array), a list of the
#: values allowed, or the fields of a nested object.
Schema = Mapping[str, Mapping[str, tuple]]
REPLY: Schema = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
#: How Spark names the types of JSON values.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}
_ENVELOPE = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>, tool_call_id: string, content: string>"


def quoted(text: Column) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a message table (conv_id, turn, role, text).

    A text that is a JSON object with `tool_calls` holds calls, one with `tool_call_id` a result.
    In plain conversations a user turn calls the tool `reply` with its text, under the id
    "conversation-turn"; the assistant's turn right after it is the result, and a user turn refers
    to the call two turns before it. Other plain turns (system, null role) are neither. Null turns
    count as turn -1, null texts as empty; repeated rows count once."""
    rows = messages.select(
        F.col("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Calls and results both read these rows.
    rows = materialise(rows.distinct(), "chat-messages")
    rows = rows.withColumn("e", F.when(F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", _ENVELOPE)))
    has_calls, is_result = F.coalesce(F.size("e.tool_calls") > 0, F.lit(False)), F.col("e.tool_call_id").isNotNull()
    made = rows.where(has_calls).select("conv_id", "turn", F.posexplode("e.tool_calls").alias("idx", "c"))
    made = made.select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"))
    refs = F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), F.lit(1)))
    made = made.withColumn("after", refs)
    plain = rows.where(~has_calls & ~is_result)
    name_of = lambda turn: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), turn.cast("string"))
    arguments = F.concat(F.lit('{"prompt":'), quoted(F.col("text")), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}"))
    asked = plain.where("role = 'user'").select("conv_id", "turn", F.lit(0).cast("long").alias("idx"), name_of(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(name_of(F.col("turn") - 2)).alias("after"))
    told = rows.where(is_result).select("conv_id", "turn", F.col("e.tool_call_id").alias("call_id"), F.coalesce("e.content", F.lit("")).alias("content"))
    answered = plain.where("role = 'assistant'").select("conv_id", "turn", name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return made.unionByName(asked), told.unionByName(answered)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def _is(shown: Column, kind: str) -> Column:
    out = F.lit(False)
    for t in _TYPES[kind]:
        out = out | F.startswith(shown, F.lit(t))
    return F.coalesce(out, F.lit(False))


def _fits(value: Column, kind) -> tuple[Column, str]:
    """Whether a JSON value (a variant) is of a kind that isn't an object's fields, and how the
    kind is named."""
    shown = F.schema_of_variant(value)
    if isinstance(kind, str) and kind.startswith("array<"):
        one = kind[len("array<") : -1]
        items = F.from_json(F.to_json(value), "array<variant>")
        return _is(shown, "array") & F.coalesce(F.forall(items, lambda x: _is(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), one)), F.lit(False)), kind
    if not isinstance(kind, str):
        allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in kind]
        return F.coalesce(F.to_json(value).isin(*allowed), F.lit(False)), f"one of {', '.join(allowed)}"
    return _is(shown, kind), kind


def _broken(value: Column, fields: Mapping, lead: str) -> Column:
    """An array of the ways in which an object (a variant) breaks its fields, null-free."""
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    none, found = F.array().cast("array<string>"), []
    for field, (kind, required) in sorted(fields.items()):
        inner, name = F.try_variant_get(value, f"$['{field}']", "variant"), lead + field
        missing = F.array(F.lit(f"missing {name}")) if required else none
        if isinstance(kind, Mapping):
            own = F.when(_is(F.schema_of_variant(inner), "object"), _broken(inner, kind, f"{name}.")).otherwise(F.array(F.lit(f"{name} is not object")))
        else:
            fits, called = _fits(inner, kind)
            own = F.when(fits, none).otherwise(F.array(F.lit(f"{name} is not {called}")))
        found.append(F.when(F.array_contains(keys, field), own).otherwise(missing))
    known = F.array(*(F.lit(f) for f in fields)).cast("array<string>")
    return F.concat(*found, F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit(f"unexpected {lead}"), k)))


def problems(schemas: Schema) -> Column:
    """The ways in which `arguments` (JSON) of the tool `name` break its schema, sorted. An
    argument that is null is there, of type null; JSON with a repeated key isn't an object."""
    args = F.try_parse_json("arguments")
    out = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        out = F.when(F.col("name") == tool, _broken(args, fields, "")).otherwise(out)
    broken = args.isNull() | ~F.startswith(F.coalesce(F.schema_of_variant(args), F.lit("")), F.lit("OBJECT"))
    return F.array_sort(F.when(broken, F.array(F.lit("arguments are not a JSON object"))).otherwise(out))


def _on(a: str, x: str, b: str, y: str) -> Column:
    return _same(a, b) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))


def _anchored(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, anchor, dist, open): for each call, the first call below it, itself
    included, that has no reference or several, and how many references lead to it; open where a
    cycle of single references never gets to one. Path doubling: a round for each doubling of
    the longest chain."""
    count = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    state = nodes.alias("n").join(count.alias("e"), _on("n", "call_id", "e", "call_id"), "left")
    single = F.coalesce(F.col("e.n") == 1, F.lit(False))
    state = state.select("n.conv_id", "n.call_id", F.when(single, F.col("e.parent")).otherwise(F.col("n.call_id")).alias("anchor"), single.cast("long").alias("dist"), single.alias("open"))
    state = scratch.table(state, "chat-anchor")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("open").isEmpty():
            break
        p = state.select("conv_id", F.col("call_id").alias("id"), F.col("anchor").alias("next"), F.col("dist").alias("more"), F.col("open").alias("still")).alias("p")
        moved = state.where("open").alias("s").join(p, _on("s", "anchor", "p", "id"))
        moved = moved.select("s.conv_id", "s.call_id", F.col("p.next").alias("anchor"), (F.col("s.dist") + F.col("p.more")).alias("dist"), F.col("p.still").alias("open"))
        state = scratch.table(state.where("not open").unionByName(moved), "chat-anchor")
    return state


def _depths(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, depth): the longest chain of references below a call; calls on or
    after a cycle have a null depth. `edges`: conv_id, call_id, parent, both known calls.

    Chains of single references are shortened to their anchors by path doubling, everywhere. Only
    calls with several references are then taken level by level, as many levels as the longest
    chain of such calls has; calls without any are never in these rounds."""
    state = _anchored(calls.select("conv_id", "call_id"), edges, scratch)
    many = scratch.table(edges.groupBy("conv_id", "call_id").count().where("count > 1").select("conv_id", "call_id"), "chat-many")
    single = state.where("not open").select("conv_id", "call_id", F.col("anchor"), "dist")
    if many.isEmpty():
        return state.select("conv_id", "call_id", F.when(~F.col("open"), F.col("dist")).alias("depth"))
    # The references of such calls, from anchor to anchor; those into a cycle never resolve.
    own = edges.alias("e").join(many.alias("m"), _on("e", "call_id", "m", "call_id"), "left_semi")
    own = own.alias("e").join(state.alias("s"), _on("e", "parent", "s", "call_id"))
    open_ = own.select("e.conv_id", "e.call_id", F.when(~F.col("s.open"), F.col("s.anchor")).alias("anchor"), (F.col("s.dist") + 1).alias("dist"))
    open_ = scratch.table(open_, "chat-edges")
    # Depths that are known: first the anchors without references, then level by level.
    ends = single.where("anchor = call_id").select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("depth")).alias("k")
    fresh = scratch.table(ends.join(many.alias("m"), _on("k", "anchor", "m", "call_id"), "left_anti"), "chat-known")
    known, best = fresh, None
    while not open_.isEmpty():
        met = open_.alias("e").join(fresh.alias("k"), _on("e", "anchor", "k", "anchor"))
        met = met.select("e.conv_id", "e.call_id", (F.col("k.depth") + F.col("e.dist")).alias("depth"))
        best = scratch.table((met if best is None else best.unionByName(met)).groupBy("conv_id", "call_id").agg(F.max("depth").alias("depth")), "chat-best")
        open_ = scratch.table(open_.alias("e").join(fresh.alias("k"), _on("e", "anchor", "k", "anchor"), "left_anti"), "chat-edges")
        waits = open_.select("conv_id", "call_id").distinct().alias("w")
        fresh = best.alias("b").join(waits, _on("b", "call_id", "w", "call_id"), "left_anti").select("conv_id", F.col("call_id").alias("anchor"), "depth")
        fresh = scratch.table(fresh, "chat-known")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        best = best.alias("b").join(fresh.alias("k"), _on("b", "call_id", "k", "anchor"), "left_anti")
    out = state.alias("s").join(known.alias("k"), _on("s", "anchor", "k", "anchor"), "left")
    return out.select("s.conv_id", "s.call_id", F.when(~F.col("s.open"), F.col("k.depth") + F.col("s.dist")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schema = REPLY) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, call_id, name, turn,
    place (long, the topological place in the conversation, from 0), depth, status, n_results,
    valid, problems and record (canonical JSON).

    status: "answered", "unanswered", "duplicate" (the id was taken by an earlier call),
    "cyclic" (on or after a cycle of references; placed last) or "orphan" (a result without a
    call; no place). Of several results the first counts. References to unknown calls are ignored
    for the order; identical calls of one turn count once. Null ids never join: such calls are unanswered, such results orphans. Calls at
    the same depth go by turn, index and id."""
    # Texts stay with `full`; order, duplicates and places are worked out on keys alone.
    full = calls.withColumn("tie", F.xxhash64("name", "arguments")).dropDuplicates(["conv_id", "call_id", "turn", "idx", "tie"])
    when = F.struct("turn", "idx", "tie")
    keys = materialise(full.select("conv_id", "call_id", "turn", "idx", "tie", "after"), "chat-keys")
    first = keys.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(when).alias("first"))
    answers = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min(F.struct("turn", "content")).alias("a"))
    answers = materialise(answers.select("conv_id", "call_id", "n", F.col("a.content").alias("content")), "chat-answers")
    own = keys.alias("k").join(first.alias("f"), _same("k", "f") & (F.col("k.call_id") == F.col("f.call_id")) & (F.struct("k.turn", "k.idx", "k.tie") == F.col("f.first")), "left_semi")
    wanted = own.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("parent"))
    edges = wanted.alias("w").join(own.select("conv_id", "call_id").alias("o"), _same("w", "o") & (F.col("w.parent") == F.col("o.call_id")), "left_semi")
    scratch = Scratch(calls.sparkSession)
    depth = _depths(own, edges, scratch)
    k = keys.alias("c").join(first.alias("f"), _same("c", "f") & (F.col("c.call_id") == F.col("f.call_id")), "left").join(depth.alias("d"), _same("c", "d") & (F.col("c.call_id") == F.col("d.call_id")), "left")
    is_own = F.coalesce(F.struct("c.turn", "c.idx", "c.tie") == F.col("f.first"), F.lit(False))
    k = k.select("c.conv_id", "c.call_id", "c.turn", "c.idx", "c.tie", is_own.alias("own"), F.when(is_own, F.col("d.depth")).alias("depth"))
    # Places: calls sort by (depth, turn block, turn, ...); a block starts after all before it.
    k = materialise(k.withColumns({"lv": F.coalesce("depth", F.lit(1 << 60)), "bk": F.floor(F.col("turn") / TURNS)}), "chat-places")
    scratch.clear()
    sizes = k.groupBy("conv_id", "lv", "bk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("lv", "bk")
    starts = sizes.select("conv_id", "lv", "bk", (F.sum("n").over(before) - F.col("n")).alias("start"))
    inside = Window.partitionBy("conv_id", "lv", "bk").orderBy("turn", "idx", "call_id", "tie")
    placed = k.withColumn("i", F.row_number().over(inside)).alias("k").join(starts.alias("s"), _same("k", "s") & (F.col("k.lv") == F.col("s.lv")) & (F.col("k.bk") == F.col("s.bk")))
    placed = placed.select("k.conv_id", "k.call_id", "k.turn", "k.idx", "k.tie", "k.own", "k.depth", (F.col("s.start") + F.col("k.i") - 1).alias("place"))
    on = _same("c", "p") & F.col("c.call_id").eqNullSafe(F.col("p.call_id")) & (F.col("c.turn") == F.col("p.turn")) & (F.col("c.idx") == F.col("p.idx")) & (F.col("c.tie") == F.col("p.tie"))
    linked = full.alias("c").join(placed.alias("p"), on).join(answers.alias("r"), _same("c", "r") & (F.col("c.call_id") == F.col("r.call_id")) & F.col("p.own"), "left")
    status = F.when(~F.col("p.own") & F.col("c.call_id").isNotNull(), "duplicate").when(F.col("p.own") & F.col("p.depth").isNull(), "cyclic").when(F.col("r.n").isNotNull(), "answered").otherwise("unanswered")
    linked = linked.select("c.conv_id", "c.call_id", "c.name", "c.turn", "c.arguments", "p.place", "p.depth", status.alias("status"), F.coalesce("r.n", F.lit(0)).cast("long").alias("n_results"), "r.content")
    linked = linked.withColumn("problems", problems(schemas))
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), quoted(F.col("arguments")))
    record = F.concat(
        F.lit('{"arguments":'), args, F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.when(F.col("content").isNull(), "null").otherwise(quoted(F.col("content"))), F.lit("}"))
    out = linked.select("conv_id", "call_id", "name", "turn", "place", "depth", "status", "n_results", (F.size("problems") == 0).alias("valid"), "problems", record.alias("record"))
    lost = results.alias("r").join(own.select("conv_id", "call_id").alias("o"), _same("r", "o") & (F.col("r.call_id") == F.col("o.call_id")), "left_anti")
    lost = lost.select(
        "conv_id", "call_id", F.lit(None).cast("string").alias("name"), "turn", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("depth"), F.lit("orphan").alias("status"), F.lit(1).cast("long").alias("n_results"),
        F.lit(False).alias("valid"), F.array(F.lit("no such call")).alias("problems"), F.concat(F.lit('{"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}")).alias("record"))
    return out.unionByName(lost)
