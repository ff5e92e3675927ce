"""Tool-call linking for chat data; DataFrame and SQL functions only.

Calls and results are separate event streams.  A result finds its call by (conversation, identifier)
in a hash join; a call may name the call whose result it needs.  Each event thus has at most one
parent, and the order is topological: an event sorts by the largest position on its path from the root,
then by depth (0 throughout where positions decide).  Only where some parent stands later than its child does that differ from the log's own
order, and only those conversations go through pointer doubling: log2(depth) joins, none that
gathers a conversation in one task.  Arguments are checked as VARIANT values against the tool's schema, one row a call
that a hash join by tool brings, and every event is written as canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch

#: JSON type name -> type names of VARIANT values.
TYPES = {
    "string": "STRING", "integer": r"(BIGINT|DECIMAL\(\d+,0\))", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN",
    "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID",
}

#: A tool's parameters are rows of (tool, key, type, required); a row with a null key says that the tool takes no parameters, or
#: stands for it alone. Tools without a row take anything.
SCHEMA_DDL = "tool string, key string, type string, required boolean"
#: What a schema may add: the objects that the key lies in, the values that it may have (as canonical JSON), its least and greatest number,
#: and, on any row of the tool, whether keys that aren't listed are allowed.
SCHEMA_MORE = "under array<string>, allowed array<string>, least double, most double, open boolean"

_OBJECT = T.MapType(T.StringType(), T.VariantType())


def canonical_json(value: Column) -> Column:
    """JSON text of a VARIANT: object keys sorted, no white space."""
    return F.to_json(value)


def _first_by_id(events: DataFrame, id_col: str) -> DataFrame:
    """Marks the first event of each (conversation, id); later ones with the same id are duplicates."""
    keyed = events.where(F.col(id_col).isNotNull())
    least = keyed.groupBy(F.col("conv_id").alias("c"), F.col(id_col).alias("i")).agg(F.min("uid").alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(id_col) == F.col("i"))
    return events.join(least, on, "left").withColumn("duplicate", F.col("first").isNotNull() & (F.col("first") != F.col("uid"))).drop("c", "i", "first")


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls(tool, arguments string, ...) with args (variant) and errors (array<string>, sorted); schemas as SCHEMA_DDL, with any of SCHEMA_MORE.

    Errors: 'not an object' (null and broken JSON, and repeated keys, too), or for the dotted name of a key 'unknown:', 'missing:', 'type:', 'allowed:'
    (not one of the values) and 'range:'.  A null type takes any value.
    """
    more = {f.name: f.dataType for f in T.StructType.fromDDL(SCHEMA_MORE)}
    rows = schemas.select("tool", "key", "type", "required", *[F.col(n) if n in schemas.columns else F.lit(None).cast(t).alias(n) for n, t in more.items()])
    rows = rows.withColumn("under", F.coalesce("under", F.array().cast("array<string>"))).where("tool is not null")
    parameter = F.struct("under", "key", "type", "required", "allowed", "least", "most")
    spec = rows.groupBy("tool").agg(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), parameter))).alias("spec"), F.coalesce(F.max("open"), F.lit(False)).alias("open"))
    parsed = calls.withColumn("args", F.try_parse_json("arguments")).join(spec.withColumnRenamed("tool", "spec_tool"), F.col("tool") == F.col("spec_tool"), "left")
    whole = F.col("args").try_cast(_OBJECT)

    def inside(under: Column) -> Column:
        """The object that the names lead to, as a map; null if there's none."""
        return F.when(F.size(under) == 0, whole).otherwise(F.aggregate(under, F.col("args"), lambda v, name: F.try_element_at(v.try_cast(_OBJECT), name)).try_cast(_OBJECT))

    named = lambda p: F.array_join(F.concat(p["under"], F.array(p["key"])), ".")
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def judged(p: Column) -> Column:
        value = F.try_element_at(inside(p["under"]), p["key"])
        kind = F.schema_of_variant(value)
        number = F.to_json(value).try_cast("double")
        wrong = F.when(value.isNull(), F.when(F.coalesce(p["required"], F.lit(False)) & inside(p["under"]).isNotNull(), "missing:"))
        wrong = wrong.when(~F.regexp_like(kind, F.concat(F.lit("^"), F.coalesce(F.try_element_at(pattern, p["type"]), F.lit(".*")), F.lit("$"))), "type:")
        wrong = wrong.when(p["allowed"].isNotNull() & ~F.array_contains(p["allowed"], F.to_json(value)), "allowed:")
        wrong = wrong.when(F.coalesce((number < p["least"]) | (number > p["most"]), F.lit(False)), "range:")
        return F.when(wrong.isNotNull(), F.concat(wrong, named(p)))

    def unknown(under: Column) -> Column:
        listed = F.transform(F.filter("spec", lambda p: p["under"] == under), lambda p: p["key"])
        extra = F.array_except(F.coalesce(F.map_keys(inside(under)), F.array().cast("array<string>")), listed)
        return F.transform(extra, lambda k: F.concat(F.lit("unknown:"), F.array_join(F.concat(under, F.array(k)), ".")))

    levels = F.array_distinct(F.concat(F.array(F.array().cast("array<string>")), F.transform("spec", lambda p: p["under"])))
    found = F.concat(F.filter(F.transform("spec", judged), lambda e: e.isNotNull()), F.when(F.col("open"), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(levels, unknown))))
    errors = F.when(whole.isNull(), F.array(F.lit("not an object"))).otherwise(F.coalesce(F.array_sort(found), F.array().cast("array<string>")))
    return parsed.withColumn("errors", errors).drop("spec", "spec_tool", "open")


def _ordered(events: DataFrame, scratch: Scratch) -> DataFrame:
    """events(uid, conv_id, pos, parent) with (order_pos, depth, cyclic); parent is a uid of the conversation or null."""
    ends = events.select(F.col("uid").alias("puid"), F.col("pos").alias("ppos"))
    back = events.where("parent is not null").join(ends, F.col("parent") == F.col("puid")).where(F.coalesce(F.col("ppos") >= F.col("pos"), F.lit(True)))
    late = scratch.keep(back.select(F.struct("conv_id").alias("conv")).distinct(), "late")
    plain = events.withColumns({"order_pos": F.col("pos"), "depth": F.lit(0).cast("long"), "cyclic": F.lit(False)})
    if late.isEmpty():
        return plain
    with_key = events.withColumn("conv", F.struct("conv_id"))
    edge = F.col("parent").isNotNull().cast("long")
    state = with_key.join(late, "conv", "left_semi").select("uid", F.col("parent").alias("up"), F.col("pos").alias("top"), edge.alias("steps"))
    state, k = scratch.keep(state.dropDuplicates(["uid"]), "jump0"), 0
    limit = max(1, state.count()).bit_length() + 1  # a path that is longer goes in a circle
    while k < limit and not state.where("up is not null").isEmpty():
        k += 1
        above = state.select(F.col("uid").alias("a"), F.col("up").alias("a_up"), F.col("top").alias("a_top"), F.col("steps").alias("a_steps"))
        joined = state.join(above, F.col("up") == F.col("a"), "left")
        after = joined.select("uid", F.col("a_up").alias("up"), F.greatest("top", "a_top").alias("top"), (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"))
        state = scratch.keep(after, f"jump{k}")
        scratch.drop(f"jump{k - 1}")
    fixed = state.select("uid", F.col("top"), "steps", F.col("up").isNotNull().alias("circle"))
    out = plain.drop("order_pos", "depth", "cyclic").join(fixed, "uid", "left")
    return out.select(
        "*", F.when(F.col("circle").isNull() | F.col("circle"), F.col("pos")).otherwise(F.col("top")).alias("order_pos"),
        F.when(F.coalesce("circle", F.lit(True)), F.lit(0)).otherwise(F.col("steps")).cast("long").alias("depth"),
        F.coalesce("circle", F.lit(False)).alias("cyclic"),
    ).drop("top", "steps", "circle")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result, linked, validated, ordered and serialised.

    calls(conv_id, pos long, call_id string, tool string, arguments string, after string or null: the call_id
    whose result it needs), results(conv_id, pos, call_id, content string); other columns are left out.  Returns
    (conv_id, kind, call_id, pos, order_pos, depth, status, errors array<string>, json); within a conversation
    sorting by (order_pos, depth, pos, kind, call_id) puts every event after its parent.

    status: 'linked' (a call with a result, a result with a call), 'no result', 'no call', 'no id' (null
    call_id), 'duplicate' (not the first event of its conversation, kind and id, by pos, then content; it links
    with nothing), 'cycle' (on or below a circle of `after`; keeps its own pos).  Of events that are equal in
    every column, each is kept; all count as the first.  errors of a call as in validate().  Arguments that are JSON are written canonically,
    with errors or not, others as a string of what they are; what is null is written as null.  A null conv_id is a conversation of its own.
    A null pos sorts first.
    """
    scratch = Scratch(calls.sparkSession, "tool-calls")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def uid(kind: str, *cols: str) -> Column:
        return F.struct(F.col("conv_id").alias("conv"), F.lit(kind).alias("kind"), F.col("pos").alias("at"), F.col("call_id").alias("id"), F.xxhash64(*cols).alias("h"))

    c = calls.select("conv_id", F.col("pos").cast("long").alias("pos"), "call_id", "tool", "arguments", "after")
    r = results.select("conv_id", F.col("pos").cast("long").alias("pos"), "call_id", "content")
    c = _first_by_id(c.withColumn("uid", uid("call", "tool", "arguments", "after")), "call_id")
    r = _first_by_id(r.withColumn("uid", uid("result", "content")), "call_id")
    c, r = scratch.keep(c, "calls"), scratch.keep(r, "results")
    first = lambda df, name: df.where("call_id is not null and not duplicate").select(F.struct("conv_id", "call_id").alias(f"{name}_key"), F.col("uid").alias(name)).distinct()
    key = F.struct("conv_id", "call_id")
    with_call = r.withColumn("k", key).join(first(c, "owner"), F.col("k") == F.col("owner_key"), "left")
    result_events = with_call.select(
        "uid", "conv_id", "pos", "call_id", F.lit("result").alias("kind"), F.when(~F.col("duplicate"), F.col("owner")).alias("parent"), "duplicate",
        F.when(~F.col("duplicate"), F.col("owner")).isNotNull().alias("has"), F.col("content").alias("body"),
    )
    answered = first(r, "answer")
    needs = F.struct("conv_id", F.col("after").alias("call_id"))
    c2 = c.withColumn("k", key).join(answered, F.col("k") == F.col("answer_key"), "left").drop("answer_key")
    c2 = c2.withColumnRenamed("answer", "own").withColumn("n", needs).join(answered, (F.col("n") == F.col("answer_key")) & F.col("after").isNotNull(), "left")
    call_events = c2.select(
        "uid", "conv_id", "pos", "call_id", F.lit("call").alias("kind"), F.when(~F.col("duplicate"), F.col("answer")).alias("parent"), "duplicate",
        (F.col("own").isNotNull() & ~F.col("duplicate")).alias("has"), F.lit(None).cast("string").alias("body"),
    )
    events = scratch.keep(call_events.unionByName(result_events), "events")
    ordered = _ordered(events.select("uid", "conv_id", "pos", "parent", "kind", "call_id", "duplicate", "has", "body"), scratch)
    checked = validate(c.select("uid", "tool", "arguments").distinct(), schemas)
    out = ordered.join(checked, "uid", "left")
    status = (
        F.when(F.col("call_id").isNull(), "no id").when(F.col("duplicate"), "duplicate").when(F.col("cyclic"), "cycle")
        .when(F.col("has"), "linked").otherwise(F.when(F.col("kind") == "call", "no result").otherwise("no call"))
    )
    quoted = lambda col: F.coalesce(F.regexp_extract(F.to_json(F.struct(col.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit(""))
    or_null = lambda col: F.when(col.isNull(), "null").otherwise(quoted(col))
    arguments = F.coalesce(canonical_json(F.col("args")), or_null(F.col("arguments")))
    call_json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), or_null(F.col("call_id")), F.lit(',"name":'), or_null(F.col("tool")), F.lit(',"type":"call"}'))
    result_json = F.concat(F.lit('{"content":'), or_null(F.col("body")), F.lit(',"id":'), or_null(F.col("call_id")), F.lit(',"type":"result"}'))
    return out.select(
        "conv_id", "kind", "call_id", "pos", "order_pos", "depth", status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        F.when(F.col("kind") == "call", call_json).otherwise(result_json).alias("json"),
    )
