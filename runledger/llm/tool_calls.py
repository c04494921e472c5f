"""Linking of tool calls to their results, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, so one very long conversation is dealt to
many tasks. A call may name calls it depends on, wherever they stand. A dependency on a call that is missing or has
no result is cut, and of each cycle the dependencies on the same or a later call of the transcript; all others are
kept. Without those of a cycle no cycle is left, for the rest of a cycle would only lead back. `order_key` sorts a
conversation's calls topologically, near the transcript: a call stands at its own place (turn, place), or behind the
last of what it depends on, directly or not, with the length of the way there appended. Cycles and places are
found by rounds of joins, each written, over conversations that depend on a later call; the others need none.
Arguments are JSON texts. They are validated against a JSON Schema per tool (type, enum, required, properties,
additionalProperties, items, minimum, maximum, minLength, maxLength; nested as deep as the schema) and written as
canonical JSON: keys of every object in order, no white space.

Defined cases: rows repeated whole are one call or result, n_rows tells how often it came; a null conversation, turn
or identifier links with nothing (status "unlinked"); of calls that share an identifier the first in the transcript
owns it, the others are "duplicate"; of several results the first after the call counts, the others come out as
rows "repeated"; a result before its call or without one comes out as "orphan"; a call without a result is "pending";
null or ill-formed arguments (double keys too) are invalid and written as null, as are those of an unknown tool, which
are written all the same; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: What schema_of_variant says of a value of each JSON type.
TYPES = {
    "object": "^OBJECT<",
    "array": "^ARRAY<",
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "null": "^VOID$",
}


def json_string(col):
    """A text as a JSON string, null as null; slashes and characters beyond ASCII stay as they are."""
    return F.expr("if({1} is null, null, substring({0}, 6, length({0}) - 6))".format(f"to_json(named_struct('s', {col}))", col))


def canonical(text):
    """A JSON text in canonical form; null if it is ill-formed."""
    return F.to_json(F.try_parse_json(text))


def _at(value, name: str):
    if "'" in name:
        raise ValueError(f"a property name with a quotation mark: {name}")
    return F.try_variant_get(value, f"$['{name}']", "variant")


def valid(value, schema: dict):
    """Whether a variant follows a JSON Schema: true or false, never null."""
    known = {"type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength"}
    if schema.keys() - known:
        raise ValueError(f"not supported in a schema: {sorted(schema.keys() - known)}")
    kind, rules = F.schema_of_variant(value), [value.isNotNull()]
    is_a = lambda name: kind.rlike(TYPES[name])
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rules.append(reduce(Column.__or__, map(is_a, names)))
    if "enum" in schema:
        rules.append(F.to_json(value).isin([json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]))
    fields = schema.get("properties", {})
    for name in dict.fromkeys([*fields, *schema.get("required", [])]):
        there = _at(value, name)
        holds = valid(there, fields[name]) if name in fields else F.lit(True)
        rules.append(~is_a("object") | F.when(there.isNull(), F.lit(name not in schema.get("required", []))).otherwise(holds))
    if schema.get("additionalProperties", True) is False:
        keys = F.json_object_keys(F.to_json(value))
        rules.append(~is_a("object") | (F.size(F.array_except(keys, F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"))) == 0))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        rules.append(~is_a("array") | F.forall(items, lambda x: valid(x, schema["items"])))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    for name, of, what, holds in (
        ("minimum", "number", number, lambda x, y: x >= y),
        ("maximum", "number", number, lambda x, y: x <= y),
        ("minLength", "string", F.length(text), lambda x, y: x >= y),
        ("maxLength", "string", F.length(text), lambda x, y: x <= y),
    ):
        if name in schema:
            rules.append(~is_a(of) | holds(what, F.lit(schema[name])))
    return F.coalesce(reduce(Column.__and__, rules), F.lit(False))


def valid_arguments(tool, arguments, schemas: dict[str, dict]):
    """Whether a JSON text follows the schema of its tool; false for unknown tools."""
    ok = F.lit(False)
    for name, schema in schemas.items():
        ok = F.when(tool == name, valid(F.try_parse_json(arguments), schema)).otherwise(ok)
    return ok


def _rounds(state: DataFrame, step, measure, label: str) -> DataFrame:
    """state after as many steps as change the measure (aggregates over state); each is written."""
    state = materialise(state, label)
    seen = state.agg(*measure).first()
    while True:
        state = materialise(step(state), label)
        now = state.agg(*measure).first()
        if now == seen:
            return state
        seen = now


def _cycle_cuts(edges: DataFrame) -> DataFrame:
    """edges: conv_id, u, u_at, v, v_at; call u at u_at depends on v. The distinct conv_id, u, v to cut.

    Calls on no way between cycles go first. Each call then takes as colour the last call it leads to; a call of its own
    colour and those of the colour it leads to are one strongly connected part, which is taken out, until none is left.
    """
    found, count = None, [F.count("conv_id")]
    rest = edges
    while True:
        has = lambda e, mine, other: e.join(e.select("conv_id", F.col(other).alias(mine)).distinct(), ["conv_id", mine], "left_semi")
        rest = _rounds(rest, lambda e: has(has(e, "v", "u"), "u", "v").select(*edges.columns), count, "cycle-edges")
        if rest.isEmpty():
            return found
        nodes = rest.select("conv_id", F.col("u").alias("x"), F.struct(F.col("u_at").alias("at"), F.col("u").alias("x")).alias("own")).distinct().withColumn("colour", F.col("own"))

        def spread(state, rest=rest):
            ahead = rest.select("conv_id", F.col("u").alias("by"), F.col("v").alias("x")).join(state.select("conv_id", "x", "colour"), ["conv_id", "x"])
            ahead = ahead.groupBy("conv_id", F.col("by").alias("x")).agg(F.max("colour").alias("ahead"))
            return state.join(ahead, ["conv_id", "x"], "left").select("conv_id", "x", "own", F.greatest("colour", "ahead").alias("colour"))

        coloured = _rounds(nodes, spread, [F.sum(F.xxhash64("conv_id", "x", "colour").cast("decimal(38,0)"))], "colours")
        of = coloured.select("conv_id", "x", "colour")
        same = rest.join(of.withColumnsRenamed({"x": "u", "colour": "cu"}), ["conv_id", "u"]).join(of.withColumnsRenamed({"x": "v", "colour": "cv"}), ["conv_id", "v"])
        same = materialise(same.where("cu = cv").select("conv_id", "u", "u_at", "v", "v_at"), "one-colour")

        def reach(state, same=same):
            return state.unionByName(same.join(state.withColumnRenamed("x", "u"), ["conv_id", "u"], "left_semi").select("conv_id", F.col("v").alias("x"))).distinct()

        part = _rounds(coloured.where("own = colour").select("conv_id", "x"), reach, count, "parts")
        inside = lambda e, c, how: e.join(part.withColumnRenamed("x", c), ["conv_id", c], how)
        cut = materialise(inside(inside(same, "u", "left_semi"), "v", "left_semi").where("v_at >= u_at").select("conv_id", "u", "v"), "cycle-cuts")
        found = cut if found is None else found.unionByName(cut)
        rest = inside(inside(rest, "u", "left_anti"), "v", "left_anti").select(*edges.columns)


def _places(edges: DataFrame) -> DataFrame:
    """edges as above, without cycles. conv_id, call_id, spot (turn, place, level) of the calls in them."""
    spot = lambda at: F.struct(F.col(f"{at}.turn").cast("long").alias("turn"), F.col(f"{at}.place").cast("long").alias("place"), F.lit(0).cast("long").alias("level"))
    nodes = edges.select("conv_id", F.col("u").alias("call_id"), spot("u_at").alias("own")).unionByName(edges.select("conv_id", F.col("v").alias("call_id"), spot("v_at").alias("own"))).distinct()

    def step(state):
        ahead = edges.select("conv_id", "u", F.col("v").alias("call_id")).join(state, ["conv_id", "call_id"]).groupBy("conv_id", F.col("u").alias("call_id")).agg(F.max(_behind("spot")).alias("behind"))
        return state.join(ahead, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("spot", "behind").alias("spot"))

    return _rounds(nodes.withColumnRenamed("own", "spot"), step, [F.sum(F.xxhash64("conv_id", "call_id", "spot").cast("decimal(38,0)"))], "places")


def _behind(spot: str):
    return F.struct(F.col(f"{spot}.turn").alias("turn"), F.col(f"{spot}.place").alias("place"), (F.col(f"{spot}.level") + 1).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call, and one per result that no call takes (kind "call" or "result").

    calls: conv_id, turn, place, call_id, tool, arguments (JSON text), needs (array of call ids). results: conv_id,
    turn, call_id, content. Returns kind, conv_id, call_id, turn, place, order_key, result_turn, status, args_valid,
    n_needs_kept, n_needs_cut, n_rows, message (canonical JSON).
    """
    key, count = ["conv_id", "call_id"], F.count(F.lit(1)).alias("n_rows")
    long = [F.col(c).cast("long").alias(c) for c in ("turn", "place")]
    calls = calls.select("conv_id", *long, "call_id", "tool", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    calls = materialise(calls.groupBy("conv_id", "turn", "place", "call_id", "tool", "arguments", "needs").agg(count), "calls")
    results = materialise(results.groupBy("conv_id", long[0], "call_id", "content").agg(count), "results")
    whole = F.struct("turn", "place", "tool", "arguments", "needs")
    owner = calls.where("conv_id is not null and call_id is not null and turn is not null").groupBy(*key).agg(F.min(whole).alias("whole"))
    owner = owner.select(*key, "whole", F.struct("whole.turn", "whole.place").alias("own"))
    after = results.join(owner, key).where("turn > own.turn")
    answer = after.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"))
    facts = materialise(owner.join(answer, key, "left").withColumnsRenamed({"own": "o", "answer": "a"}), "owners")
    at = F.struct("turn", "place")
    needs = calls.where("conv_id is not null and turn is not null").select("conv_id", F.col("call_id").alias("by"), "turn", "place", F.explode("needs").alias("call_id")).distinct()
    owned = facts.select(*key, F.col("o").alias("own"), F.col("a").isNotNull().alias("kept"))
    needs = needs.join(owned, key, "left").withColumns({"at": at, "kept": F.coalesce("kept", F.lit(False)), "spot": F.lit(None).cast("struct<turn:bigint,place:bigint,level:bigint>")})
    needs = materialise(needs, "needs")
    later = needs.where("kept and own >= at").select("conv_id").distinct()
    if not later.isEmpty():
        by_own = owned.select("conv_id", F.col("call_id").alias("by"), F.col("own").alias("by_own"))
        edges = needs.where("kept").join(later, "conv_id", "left_semi").join(by_own, ["conv_id", "by"]).where("at = by_own")
        edges = materialise(edges.select("conv_id", F.col("by").alias("u"), F.col("at").alias("u_at"), F.col("call_id").alias("v"), F.col("own").alias("v_at")).distinct(), "edges")
        cuts = _cycle_cuts(edges)
        if cuts is not None:
            cuts = materialise(cuts.distinct(), "cuts")
            edges = materialise(edges.join(cuts, ["conv_id", "u", "v"], "left_anti"), "edges")
            mark = by_own.withColumnRenamed("by_own", "at").join(cuts.select("conv_id", F.col("u").alias("by"), F.col("v").alias("call_id"), F.lit(True).alias("cut")), ["conv_id", "by"])
            needs = needs.join(mark, ["conv_id", "by", "at", "call_id"], "left").withColumn("kept", F.col("kept") & F.col("cut").isNull())
        needs = needs.drop("spot").join(_places(edges), key, "left")
    behind = F.when(F.col("kept"), _behind("spot"))
    kept = needs.groupBy("conv_id", F.col("by").alias("call_id"), "turn", "place").agg(
        F.sum(F.col("kept").cast("long")).alias("n_needs_kept"), F.sum((~F.col("kept")).cast("long")).alias("n_needs_cut"), F.max(F.when(F.col("spot").isNotNull(), behind)).alias("behind")
    )
    c, f, k = calls.alias("c"), facts.alias("f"), kept.alias("k")
    joined = c.join(f, F.expr("c.conv_id = f.conv_id and c.call_id = f.call_id"), "left")
    joined = joined.join(k, F.expr("c.conv_id = k.conv_id and c.call_id <=> k.call_id and c.turn = k.turn and c.place <=> k.place"), "left")
    first = F.expr("struct(c.turn, c.place, c.tool, c.arguments, c.needs) <=> f.whole")
    status = F.when(F.col("f.o").isNull(), "unlinked").when(~first, "duplicate").when(F.col("f.a").isNull(), "pending").otherwise("linked")
    moved = F.col("k.behind") > F.struct(F.col("c.turn").alias("turn"), F.col("c.place").alias("place"), F.lit(0).cast("long").alias("level"))
    order_key = F.when(moved, F.format_string("%012d.%06d.%06d", "k.behind.turn", "k.behind.place", "k.behind.level"))
    order_key = F.coalesce(order_key, F.format_string("%012d.%06d", "c.turn", "c.place"))
    no = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = joined.select(
        "c.conv_id", "c.call_id", "c.turn", "c.place", "c.tool", "c.arguments", "c.n_rows", order_key.alias("order_key"),
        status.alias("status"), F.col("f.a").alias("a"), no("k.n_needs_kept").alias("n_needs_kept"), no("k.n_needs_cut").alias("n_needs_cut"),
    )
    linked = F.col("status") == "linked"
    rows = rows.withColumn("args", F.coalesce(canonical(F.col("arguments")), F.lit("null"))).withColumn("content", F.when(linked, F.col("a.content")))
    text = lambda c: F.coalesce(json_string(c), F.lit("null"))
    result = F.when(F.col("content").isNull(), "null").otherwise(json_string("content"))
    message = F.concat(F.lit('{"arguments":'), "args", F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("tool"), F.lit(',"result":'), result, F.lit("}"))
    linked_rows = rows.select(
        F.lit("call").alias("kind"), "conv_id", "call_id", "turn", "place", "order_key", F.when(linked, F.col("a.turn")).alias("result_turn"), "status",
        valid_arguments(F.col("tool"), F.col("arguments"), schemas).alias("args_valid"), "n_needs_kept", "n_needs_cut", "n_rows", message.alias("message"),
    )
    r, g = results.alias("r"), facts.alias("g")
    rest = r.join(g, F.expr("r.conv_id = g.conv_id and r.call_id = g.call_id"), "left").where("not coalesce(struct(r.turn, r.content) <=> g.a, false)")
    status = F.when(F.expr("r.conv_id is null or r.call_id is null or r.turn is null"), "unlinked").when(F.expr("r.turn > g.o.turn"), "repeated").otherwise("orphan")
    rest = rest.select("r.conv_id", "r.call_id", "r.turn", "r.content", "r.n_rows", status.alias("status"))
    message = F.concat(F.lit('{"id":'), text("call_id"), F.lit(',"result":'), result, F.lit("}"))
    none = F.lit(None).cast("long")
    return linked_rows.unionByName(rest.select(
        F.lit("result").alias("kind"), "conv_id", "call_id", "turn", none.alias("place"), F.lit(None).cast("string").alias("order_key"), F.col("turn").alias("result_turn"),
        "status", F.lit(None).cast("boolean").alias("args_valid"), none.alias("n_needs_kept"), none.alias("n_needs_cut"), "n_rows", message.alias("message"),
    ))


# Turns of a conversation as calls: what a user says asks the tool "reply", every other turn answers the call of the
# turn before it. The tool takes no text beyond MOST_LETTERS and none that is missing or empty.
MOST_LETTERS = 200
REPLY = {
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": MOST_LETTERS}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def turns_as_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the rows of conversations (conv_id, turn, role, text).

    A conversation has no identifiers of its own, so a turn's number is its call's. The calls of turns 0, 4, 8 ... need
    the call two turns later, those of turns 2, 10, 18 ... the one two turns before, which closes a cycle.
    """
    turn = F.col("turn").cast("long")
    call = lambda n: F.concat(F.lit("call-"), n.cast("string"))
    said = rows.select("conv_id", turn.alias("turn"), "role", "text")
    calls = said.where("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("place"), call(turn).alias("call_id"), F.lit("reply").alias("tool"), F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.when(turn % 4 == 0, F.array(call(turn + 2))).when(turn % 8 == 2, F.array(call(turn - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = said.where("role <> 'user' or role is null").select("conv_id", "turn", call(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
