"""Tool calls and results of conversations: linked, ordered, validated and serialised.

Inputs are three tables: calls(conv_id, turn, call_id, parent_id, name, arguments), results(conv_id, turn,
call_id, content) and schemas(name, parameter, kind, required), where kind is one of `KINDS`. Results meet
their call by conversation and identifier in a hash join. Calls form chains by `parent_id`, the call whose
result they use; a call's depth is found by pointer doubling, so the rounds grow with the logarithm of the
longest chain. Ordered by depth, calls before their results, every row follows what it depends on; its
`position` in the conversation says where. Arguments are JSON objects whose members are compared with the
tool's schema. Messages are canonical JSON: members in the order of their names, no white space.

Everything is DataFrame functions. Positions are counted in two steps: rows are range-partitioned by all that
orders them, so a conversation, a rank of it or one of its turns may hold any share of all rows; each task
counts its own range, and a table with one row for each conversation and range says where that starts.

Nulls, empty and repeated rows: rows whose conversation or identifier is null link with nothing. Of calls
that repeat an identifier in a conversation the first one (least turn, then arguments and name) is linked
and has a depth; the others have the status `repeated`. A parent that isn't there makes a call a root; calls
on a cycle, or behind one, have the status `cycle`, no depth, and come last, as do results without a call
(`orphan`). Rows alike throughout take neighbouring positions. Null texts are JSON nulls. Empty tables
give no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.frames import stored

#: Schema kinds, and the types of JSON values they accept.
KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*$",
    "array": "^ARRAY.*$",
}
#: Characters of a message that tell ranges apart. Only different messages alike in all of them, and in all
#: that goes before them in the order, share a task.
HEAD = 256
LAST = 1 << 40


def json(value: Column) -> Column:
    """A value as JSON, null as null."""
    row = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(row, F.lit(6), F.length(row) - 6))


def member_json(members: dict[str, Column]) -> Column:
    """A JSON object of members that are JSON already, in the order of their names."""
    parts = []
    for number, name in enumerate(sorted(members)):
        parts += [F.lit(("," if number else "{") + f'"{name}":'), members[name]]
    return F.concat(*parts, F.lit("}"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls(row, name, arguments) with canonical (the arguments, null unless an object) and status."""
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("canonical", F.when(is_object, F.to_json("parsed")))
    accepts = F.lit(None).cast("string")
    for kind, pattern in KINDS.items():
        accepts = F.when(F.col("kind") == kind, F.lit(pattern)).otherwise(accepts)
    rules = schemas.select(
        F.col("name").alias("_name"), F.col("parameter").alias("key"), accepts.alias("accepts"), F.col("required").alias("required")
    )
    needs = rules.groupBy("_name").agg(F.sum(F.col("required").cast("int")).alias("needed"))
    members = calls.sparkSession.sql(
        "SELECT row, name, m.key, schema_of_variant(m.value) AS type FROM {parsed}, LATERAL variant_explode(parsed) m "
        "WHERE canonical IS NOT NULL",
        parsed=parsed,
    )
    checked = members.join(rules.withColumnRenamed("key", "_key"), (F.col("name") == F.col("_name")) & (F.col("key") == F.col("_key")), "left")
    known = F.col("_key").isNotNull()
    fits = F.coalesce(F.regexp_like("type", F.col("accepts")), F.lit(False))
    found = checked.groupBy("row").agg(
        F.sum((known & F.col("required")).cast("int")).alias("given"),
        F.sum((known & ~fits).cast("int")).alias("wrong"),
        F.sum((~known).cast("int")).alias("unknown"),
    )
    at_least = F.coalesce(F.col("given"), F.lit(0))
    status = (
        F.when(F.col("needed").isNull(), "unknown_tool")
        .when(F.col("canonical").isNull(), "malformed")
        .when(at_least < F.col("needed"), "missing")
        .when(F.col("wrong") > 0, "wrong_type")
        .when(F.col("unknown") > 0, "unknown_argument")
        .otherwise("ok")
    )
    return (
        parsed.drop("parsed")
        .join(found, "row", "left")
        .join(needs, F.col("name") == F.col("_name"), "left")
        .withColumn("status", status)
        .drop("given", "wrong", "unknown", "needed", "_name")
    )


def depths(calls: DataFrame) -> DataFrame:
    """calls(conv_id, call_id, parent_id), identifiers unique, with depth; null on and behind a cycle."""
    ids = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    start = calls.join(ids, (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("i")), "left")
    start = start.select("conv_id", "call_id", F.col("i").alias("up"), F.col("i").isNotNull().cast("long").alias("depth"))
    state = stored(start, "chains")
    rounds = max(1, calls.count()).bit_length() + 1
    while rounds and not state.where("up is not null").isEmpty():
        rounds -= 1
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("u"), F.col("depth").alias("d"))
        both = state.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("i")), "left")
        state = stored(
            both.select("conv_id", "call_id", F.col("u").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")), "chains"
        )
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds position, from 0, of rows within their conversation by rank and `order`, which ends in message."""
    head = F.substring(F.coalesce("message", F.lit("")), 1, HEAD)
    whole = F.length(F.coalesce("message", F.lit(""))) <= HEAD
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "unplaced")
    # rows alike throughout may stand in any order, so their number can part them; longer messages come after
    bounds = ["conv_id", "rank", *order[:-1], head, F.when(whole, F.col("row")).otherwise(F.lit(1 << 62))]
    ranged = stored(rows.repartitionByRange(*bounds).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    met = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part"))
    own = Window.partitionBy("conv_id", "part").orderBy("rank", *order)
    return (
        ranged.join(counts, met)
        .withColumn("position", F.col("before") + F.row_number().over(own) - 1)
        .drop("before", "part", "row", "_conv_id", "_part")
    )


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, kind (call or result), call_id, name, status, depth, n_results, position and message."""
    calls = calls.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        *(F.col(c).cast("string") for c in ("call_id", "parent_id", "name", "arguments")),
    )
    calls = stored(calls.withColumn("row", F.monotonically_increasing_id()), "calls")
    first = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "arguments", "name", "row")).getField("row").alias("row")
    )
    first = first.where("conv_id is not null and call_id is not null").select("row")
    own = stored(calls.join(first, "row"), "linked-calls")
    deep = depths(own.select("conv_id", "call_id", "parent_id"))

    results = results.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.col(c).cast("string") for c in ("call_id", "content"))
    )
    answers = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"))
    facts = own.select("row", "conv_id", "call_id").join(deep, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    facts = facts.select("row", "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.lit(True).alias("is_linked"))
    whole = validated(calls, schemas).join(facts, "row", "left")
    status = (
        F.when(F.col("is_linked").isNull(), "repeated").when(F.col("depth").isNull(), "cycle").otherwise(F.col("status"))
    )
    whole = stored(
        whole.withColumn("status", status).withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long"))), "validated"
    )
    told = member_json(
        {
            "arguments": F.coalesce(F.col("canonical"), F.lit("null")),
            "id": json(F.col("call_id")),
            "name": json(F.col("name")),
            "role": F.lit('"assistant"'),
            "status": json(F.col("status")),
        }
    )
    asked = whole.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", "status", "depth", "n_results", told.alias("message"),
        F.coalesce(F.col("depth") * 2, F.lit(LAST)).alias("rank"),
    )
    target = whole.where("is_linked").select(
        F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("name").alias("name"), F.col("depth").alias("depth")
    )
    met = results.join(target, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    is_linked = F.col("i").isNotNull()
    said = member_json(
        {"content": json(F.col("content")), "name": json(F.col("name")), "role": F.lit('"tool"'), "tool_call_id": json(F.col("call_id"))}
    )
    given = met.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", "name",
        F.when(is_linked, "linked").otherwise("orphan").alias("status"), "depth", F.lit(0).cast("long").alias("n_results"),
        said.alias("message"), F.coalesce(F.col("depth") * 2 + 1, F.lit(LAST + 1)).alias("rank"),
    )
    rows = asked.unionByName(given)
    return placed(rows, ["turn", "call_id", "kind", "message"]).drop("rank")
