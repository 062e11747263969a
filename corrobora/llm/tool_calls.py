"""Chat formatting: tool calls are linked to results, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, identifier). Events are ordered topologically: a result
comes after its call, and a call after the results it depends on. Where the stored order of a conversation is
topological already, it stays, at any length and in one pass. Only conversations with a link against the stored
order are layered: one of up to ``together`` events in its own row, a longer one over many tasks, in rounds that each
settle the events whose needs are all settled. Arguments are checked against a table of fields, and events become canonical JSON: keys in order, no
blanks, numbers in one form.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import written
from corrobora.operators.ranking import distributed_rank
from corrobora.session import broadcast_checked, cut_lineage

# JSON types by what a variant calls them, up to its bracket.
TYPES = {
    "BIGINT": "integer", "DOUBLE": "number", "DECIMAL": "number", "STRING": "string", "BOOLEAN": "boolean",
    "ARRAY": "array", "OBJECT": "object", "VOID": "null",
}


def _number(token: Column) -> Column:
    """One form for a JSON number by its value, whatever its digits: 1, 1.0 and 1e0 are 1.

    Digits and exponent are read as text, so nothing is rounded. Up to 38 digits of a whole number and 21 before a point, or 6 zeros behind
    it, are written out; other numbers get an exponent.
    """
    shape = r"^(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d{1,9}))?$"
    part = lambda i: F.regexp_extract(token, shape, i)
    all_digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    digits = F.regexp_replace(all_digits, "0+$", "")
    power = F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0)) - F.length(part(3)) + F.length(all_digits) - F.length(digits)
    n = F.length(digits)
    point = n + power  # digits before the decimal point
    whole = F.concat(digits, F.repeat(F.lit("0"), F.greatest(power, F.lit(0))))
    inside = F.concat(F.left(digits, point), F.lit("."), F.right(digits, n - point))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)
    science = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.right(digits, n - 1))).otherwise(""),
                       F.lit("e"), (point - 1).cast("string"))
    value = (
        F.when((power >= 0) & (point <= 38), whole).when((power < 0) & (point > 0) & (point <= 21), inside)
        .when((point <= 0) & (point > -6), small).otherwise(science)
    )
    return F.when(~token.rlike(shape), token).when(digits == "", "0").otherwise(F.concat(part(1), value))


def canonical_numbers(json: Column) -> Column:
    """JSON text with its numbers in one form; what stands in strings stays as it is."""
    # Escaped backslashes and quotes step aside, so that every quote left begins or ends a string.
    held = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    outside = lambda p: F.array_join(
        F.transform(F.regexp_extract_all(p, F.lit(r"-?[0-9][0-9.eE+-]*|[^0-9-]+|-"), 0), _number), "")
    parts = F.transform(F.split(held, '"', -1), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))


def _type_of(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    told = F.schema_of_variant(value)
    return F.when(told.rlike(r"^DECIMAL\(\d+,\s*0\)"), "integer").otherwise(F.coalesce(names[F.regexp_extract(told, "^[A-Z]+", 0)], F.lit("other")))


def problems(arguments: Column, fields: Column) -> Column:
    """What is wrong with JSON ``arguments`` under ``fields`` (field -> struct of type and required), in order.

    A number may be an integer where a number is asked for, and one of integral value is an integer however it is
    written (up to 38 digits). A null value counts as missing. Text that repeats a key within an object is not an object.
    """
    given = F.try_variant_get(F.try_parse_json(canonical_numbers(arguments)), "$", "map<string,variant>")
    kinds = F.map_filter(F.transform_values(given, lambda _, v: _type_of(v)), lambda _, t: t != "null")
    wrong = F.filter(F.map_keys(kinds), lambda k: F.map_contains_key(fields, k) & ~(
        (kinds[k] == fields[k]["type"]) | ((kinds[k] == "integer") & (fields[k]["type"] == "number"))
    ))
    found = F.concat(
        F.transform(F.filter(F.map_keys(fields), lambda k: fields[k]["required"] & ~F.map_contains_key(kinds, k)),
                    lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(wrong, lambda k: F.concat(F.lit("type:"), k)),
        F.transform(F.filter(F.map_keys(given), lambda k: ~F.map_contains_key(fields, k)), lambda k: F.concat(F.lit("unknown:"), k)),
    )
    return (
        F.when(fields.isNull(), F.array(F.lit("no schema")))
        .when(given.isNull(), F.array(F.lit("not an object")))
        .otherwise(F.array_sort(found))
    )


def _layers_within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of whole conversations (conv_id, node) in one row each, by relaxing all layers until none grows.

    After as many steps as there are events only events in a circle, or behind one, have grown that far.
    """
    needs = edges.groupBy("node").agg(F.collect_list("needs").alias("needs"))
    packed = nodes.join(needs, "node", "left").groupBy("conv_id").agg(
        F.collect_list(F.struct("node", F.coalesce("needs", F.array().cast("array<bigint>")).alias("needs"))).alias("events")
    )
    packed = packed.select(F.transform("events", lambda e: e["node"]).alias("nodes"), "events").select(
        "nodes",
        F.transform("events", lambda e: F.transform(e["needs"], lambda n: (F.array_position("nodes", n) - 1).cast("int"))).alias("places"),
    )
    start = F.struct(F.transform("nodes", lambda n: F.lit(0)).alias("layers"), F.lit(True).alias("grew"))

    def step(acc: Column, _: Column) -> Column:
        old = acc["layers"]
        new = F.transform("places", lambda ps: F.aggregate(ps, F.lit(0), lambda most, p: F.greatest(most, F.get(old, p) + 1)))
        return F.when(acc["grew"], F.struct(new.alias("layers"), (new != old).alias("grew"))).otherwise(acc)

    size = F.size("nodes")
    layers = F.aggregate(F.sequence(F.lit(1), size), start, step, lambda acc: acc["layers"])
    return packed.select(F.explode(F.arrays_zip("nodes", layers.alias("layers"))).alias("e"), size.alias("size")).select(
        F.col("e.nodes").alias("node"), F.when(F.col("e.layers") < F.col("size"), F.col("e.layers")).alias("layer")
    )


def _layers_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of conversations of any size: a round for each layer.

    A round drops the needs that the last one settled; what has none left is settled next. Rounds join by sorting:
    each broadcast would stay on the driver for a while, however small.
    """
    needs = cut_lineage(edges)
    waiting = needs.select("node").distinct()
    done = nodes.select("node").join(waiting.hint("merge"), "node", "left_anti").withColumn("layer", F.lit(0))
    ready, layer = done.select("node"), 0
    while not needs.isEmpty():
        layer += 1
        rest = cut_lineage(needs.join(ready.withColumnRenamed("node", "needs").hint("merge"), "needs", "left_anti").select("node", "needs"))
        still = rest.select("node").distinct()
        ready = cut_lineage(waiting.join(still.hint("merge"), "node", "left_anti"))
        if ready.isEmpty():
            return done.union(still.withColumn("layer", F.lit(None).cast("int")))
        done = done.union(ready.withColumn("layer", F.lit(layer)))
        needs, waiting = rest, still
    return done


def _layers(events: DataFrame, edges: DataFrame, together: int) -> DataFrame:
    """(node, layer) of the events of conversations whose stored order is not topological.

    ``events`` are (conv_id, node, position), ``edges`` (node, needs). An event in a circle, or behind one, has no
    layer. Conversations of at most ``together`` events are layered in a row each, so their depth takes no rounds.
    """
    places = events.select("node", "position")
    before = places.select(F.col("node").alias("needs"), F.col("position").alias("before"))
    against = edges.join(before, "needs").join(places, "node").where(F.col("before") >= F.col("position")).select("node")
    astray = events.join(against, "node", "left_semi").select("conv_id").distinct()
    sizes = events.groupBy("conv_id").agg(F.count("*").alias("size"))
    nodes = cut_lineage(events.join(astray, "conv_id", "left_semi").join(sizes, "conv_id").select("conv_id", "node", "size"))
    small, large = nodes.where(F.col("size") <= together), nodes.where(F.col("size") > together)
    found = _layers_within(small, edges.join(small.select("node"), "node", "left_semi"))
    return found if large.isEmpty() else found.union(_layers_by_rounds(large, edges.join(large.select("node"), "node", "left_semi")))


def link(calls: DataFrame, results: DataFrame, fields: DataFrame, together: int = 2000) -> DataFrame:
    """One row per call and per result: conv_id, position, kind, call_id, name, ordinal, status, problems, json.

    ``calls`` are (conv_id, position, call_id, name, arguments, depends), ``arguments`` being JSON and ``depends``
    an array of the calls whose results are needed; ``results`` are (conv_id, position, call_id, content); ``fields``
    are (name, field, type, required). Further columns are ignored. Arguments that are no JSON, or that repeat a key
    within an object, are "not an object" and do not show in ``json``.

    Of calls or results with one identifier the first is taken and the others are "duplicate". A call is "linked"
    or "unanswered", a result "linked" or "orphan"; null identifiers link with nothing. Events in or behind a circle
    of needs are "circular" and come last. A need of a call that does not exist is ignored. ``ordinal`` numbers the
    events of a conversation; ties go by position, call before result, identifier and text. Null conversations are
    one conversation. Empty tables give an empty table.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    calls = calls.select(
        F.col("conv_id"), F.col("position").cast("long"), F.lit("call").alias("kind"), F.col("call_id").cast("string"),
        F.col("name").cast("string"), F.col("arguments").cast("string").alias("body"), F.col("depends"),
    )
    results = results.select(
        F.col("conv_id"), F.col("position").cast("long"), F.lit("result").alias("kind"), F.col("call_id").cast("string"),
        F.lit(None).cast("string").alias("name"), F.col("content").cast("string").alias("body"),
        F.lit(None).cast("array<string>").alias("depends"),
    )
    # The row number is stored, so that it names the row whenever it is read.
    events = written(calls.union(results).withColumn("row", F.monotonically_increasing_id()), "events")
    order = F.struct("position", text("body"), "row")
    first = events.where("call_id is not null").groupBy("conv_id", "kind", "call_id").agg(F.min(order).getField("row").alias("row"))
    firsts = first.groupBy("conv_id", "call_id").agg(
        F.max(F.when(F.col("kind") == "call", F.col("row"))).alias("call_row"),
        F.max(F.when(F.col("kind") == "result", F.col("row"))).alias("result_row"),
    ).withColumnRenamed("conv_id", "of").withColumnRenamed("call_id", "id")
    e = events.join(firsts, events.conv_id.eqNullSafe(firsts.of) & (events.call_id == firsts.id), "left").drop("of", "id")
    mine, others = F.when(F.col("kind") == "call", F.col("call_row")).otherwise(F.col("result_row")), F.when(
        F.col("kind") == "call", F.col("result_row")).otherwise(F.col("call_row"))
    status = (
        F.when((F.col("row") != mine), "duplicate").when(others.isNotNull(), "linked")
        .otherwise(F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
    )
    schema = fields.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_set(
        F.struct("field", F.struct("type", "required"))))).alias("fields"))
    e = e.withColumn("status", status).join(broadcast_checked(schema), "name", "left")
    e = written(e.withColumn("problems", F.when(F.col("kind") == "call", problems(F.col("body"), F.col("fields")))).drop("fields"), "linked")

    # Nodes are rows; a struct around a conversation's id stands in for a null one, which joins would drop.
    keyed = e.select(F.struct("conv_id").alias("conv_id"), F.col("row").alias("node"), "position", "kind", "call_id", "status",
                     "call_row", "depends")
    answered = keyed.where("kind = 'result' and status = 'linked'")
    of_result = answered.select("node", F.col("call_row").alias("needs"))
    wanted = keyed.where("kind = 'call' and status != 'duplicate'").select("conv_id", "node", F.explode("depends").alias("call_id"))
    of_call = wanted.join(answered.select("conv_id", "call_id", F.col("node").alias("needs")), ["conv_id", "call_id"])
    edges = cut_lineage(of_result.union(of_call.select("node", "needs")).distinct())
    layers = _layers(keyed.select("conv_id", "node", "position"), edges, together).select(
        F.col("node").alias("row"), "layer", F.lit(True).alias("layered")
    )
    placed = e.join(layers, "row", "left").withColumn("circular", F.col("layered").isNotNull() & F.col("layer").isNull())
    placed = placed.withColumn("status", F.when(F.col("circular"), "circular").otherwise(F.col("status")))
    ranked = distributed_rank(
        placed.withColumn("conv_key", F.struct("conv_id")), ["conv_key"],
        [F.col("circular").asc(), F.col("layer").asc(), F.col("position").asc(), F.col("kind").asc(),
         F.col("call_id").asc(), F.coalesce("body", F.lit("")).asc(), F.col("row").asc()], "ordinal",
    )
    shown = {
        "arguments": F.when(F.col("kind") == "call", F.try_parse_json(canonical_numbers(F.col("body")))),
        "content": F.when(F.col("kind") == "result", F.col("body")),
        "id": F.col("call_id"), "kind": F.col("kind"), "name": F.col("name"), "status": F.col("status"),
    }
    json = canonical_numbers(F.to_json(F.struct(*[c.alias(k) for k, c in shown.items()])))
    return ranked.select("conv_id", "position", "kind", "call_id", "name", F.col("ordinal").cast("long"), "status",
                         F.array_join("problems", ",").alias("problems"), json.alias("json"))
