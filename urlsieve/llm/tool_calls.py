"""Tool-call linking for chats: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import new_folder, written

# Parameters of the known tools; `type` is a JSON type, limits and choices are optional.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 60}},
               "required": ["query", "limit"]},
    "translate": {"properties": {"text": {"type": "string"}, "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}},
                  "required": ["text", "target"]},
    "calculate": {"properties": {"expression": {"type": "string"}, "precision": {"type": "integer", "minimum": 0, "maximum": 12},
                                 "exact": {"type": "boolean"}}, "required": ["expression"]},
    "lookup": {"properties": {"key": {"type": "string"}, "fields": {"type": "array"}}, "required": ["key", "fields"]},
}
CALLS = "array<struct<id:string,name:string,arguments:string,needs:array<string>>>"


def written_calls(chats: DataFrame) -> DataFrame:
    """Calls that assistant turns write as JSON: {"tool_calls": [{"id", "name", "arguments", "needs"}]}.

    Of an entry without id, arguments that are themselves a JSON text are taken as that text.
    """
    d = chats.filter("role = 'assistant' AND ltrim(text) LIKE '{%'")
    d = d.select("conv_id", "turn", F.explode_outer(F.from_json("text", f"tool_calls {CALLS}")["tool_calls"]).alias("c"))
    packed = F.when(F.ltrim("c.arguments").startswith('"'), F.try_variant_get(F.try_parse_json("c.arguments"), "$", "string"))
    return d.filter("c is not null").select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
                                            F.coalesce(packed, F.col("c.arguments")).alias("arguments"),
                                            F.coalesce("c.needs", F.array().cast("array<string>")).alias("needs"))


def written_results(chats: DataFrame) -> DataFrame:
    """Results of `tool` turns: {"tool_call_id", "content"}."""
    d = chats.filter("role = 'tool'").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return d.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def derived_calls(chats: DataFrame) -> DataFrame:
    """A call for every user turn of plain chats: tool, arguments and needs follow from the turn and its text."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    d = chats.filter("role = 'user'").select("conv_id", "turn", text.alias("text"), F.md5(F.concat_ws(
        ":", F.col("conv_id").cast("string"), turn.cast("string"), text)).alias("h"))
    digit = lambda i: F.conv(F.substring("h", i, 1), 16, 10).cast("int")
    kind = digit(1) % 4
    arguments = F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("query"), (digit(2) * 5).alias("limit")))) \
        .when(kind == 1, F.to_json(F.struct(F.col("text").alias("text"), F.element_at(
            F.array(*map(F.lit, ("de", "en", "es", "fr", "xx"))), digit(2) % 5 + 1).alias("target")))) \
        .when(kind == 2, F.to_json(F.struct(F.when(digit(2) > 0, digit(3)).alias("precision"), (digit(4) > 7).alias("exact"),
                                            F.col("text").alias("expression"), F.when(digit(5) == 0, 1).alias("unit")))) \
        .otherwise(F.to_json(F.struct(F.substring("h", 1, 8).alias("key"), F.when(digit(2) > 1, F.array(F.lit("name"))).alias("fields"))))
    needs = F.filter(F.array(F.when((digit(6) < 8) & (turn >= 2), _call_id("conv_id", turn - 2)),
                             F.when((digit(6) < 4) & (turn >= 4), _call_id("conv_id", turn - 4))), lambda x: x.isNotNull())
    return d.select("conv_id", "turn", _call_id("conv_id", turn).alias("call_id"), F.element_at(
        F.array(*map(F.lit, SCHEMAS)), kind + 1).alias("name"), arguments.alias("arguments"), needs.alias("needs"))


def derived_results(chats: DataFrame) -> DataFrame:
    """The assistant's turn as the result of the call of the turn before it."""
    return chats.filter("role = 'assistant' AND (text IS NULL OR ltrim(text) NOT LIKE '{%')").select(
        "conv_id", "turn", _call_id("conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def _call_id(conv: str, turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("/", F.col(conv).cast("string"), turn.cast("string"))), 1, 16))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments, needs) hash-joined with results (conv_id, turn, call_id, content).

    One row for every (conv_id, call_id) of either side: turn, name, n_calls, n_results, linked, level, valid, errors
    and json. Where an identifier repeats, the earliest call and the earliest result count (by turn, then by
    content) and the numbers tell. A result without call has no name, level or json. `level` is the length of the
    longest chain of needs before a call, so (level, turn, call_id) is a topological order; it is null for calls
    in or behind a cycle. Needs that name no call of the conversation are errors and hold nothing up. `json` is
    canonical: keys sorted, no blanks, numbers normalised, absent parts left out. Null conv_id is a conversation
    of its own; rows without call_id are told by number only, on one row. Empty tables give an empty one.

    Repeats are combined in the map tasks and nothing gathers a conversation, so one that holds a third of all
    turns is divided by call. Levels take one join a round, and as many rounds as the longest chain.
    """
    first = lambda turn, *c: F.min(F.struct(turn, *c)).alias("f")
    c = calls.groupBy("conv_id", "call_id").agg(first("turn", "name", "arguments", "needs"), F.count("*").alias("n_calls")) \
        .select("conv_id", "call_id", "f.*", "n_calls")
    c = written(c, "calls")
    r = results.groupBy("conv_id", "call_id").agg(first("turn", "content"), F.count("*").alias("n_results")).select(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("f.turn").alias("r_turn"),
        F.col("f.content").alias("content"), "n_results")
    levels, unknown = _levels(c)
    c = _joined(_joined(c, levels, "left"), unknown, "left")
    d = c.join(r.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("r_conv")) & F.col("call_id").eqNullSafe(F.col("r_call")), "full")
    is_call, has_result = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    value = F.try_parse_json("arguments")
    problems = F.when(is_call, F.concat(
        _problems(value, schemas), F.transform(F.coalesce("unknown", F.array().cast("array<string>")),
                                               lambda x: F.concat(F.lit("unknown need "), x)),
        F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
        F.when(has_result, F.array().cast("array<string>")).otherwise(F.array(F.lit("no result"))))) \
        .otherwise(F.array(F.lit("no call")))
    json = F.to_json(F.struct(value.alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"),
                              F.sort_array("needs").alias("needs"), F.col("content").alias("result")))
    return d.select(F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"),
                    F.coalesce("turn", "r_turn").alias("turn"), "name",
                    F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
                    (is_call & has_result).alias("linked"), "level", (F.size(problems) == 0).alias("valid"),
                    F.array_join(problems, "; ").alias("errors"), F.when(is_call, json).alias("json"))


def in_order(linked: DataFrame, partitions: int) -> DataFrame:
    """Rows of `link` in range partitions, sorted by conversation and topological order."""
    keys = ["conv_id", F.col("level").asc_nulls_last(), "turn", "call_id"]
    return linked.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def _joined(calls: DataFrame, other: DataFrame, how: str) -> DataFrame:
    o = other.withColumnsRenamed({"conv_id": "o_conv", "call_id": "o_call"})
    return calls.join(o, F.col("conv_id").eqNullSafe(F.col("o_conv")) & F.col("call_id").eqNullSafe(F.col("o_call")), how) \
        .drop("o_conv", "o_call")


def _levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, level) of the calls that no cycle holds up, and (conv_id, call_id, unknown needs).

    A round places the calls whose last need the round before placed; only the calls placed last are looked for among the
    needs, and only calls that still wait go on. The rounds are folders of one table, read once at the end.
    """
    wanted = calls.select("conv_id", "call_id", F.explode_outer(F.array_distinct("needs")).alias("need")).filter("need is not null")
    named = calls.select(F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_call"))
    found = wanted.join(named, F.col("conv_id").eqNullSafe(F.col("n_conv")) & (F.col("need") == F.col("n_call")), "left")
    unknown = found.filter("n_call is null").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("need")).alias("unknown"))
    edges = written(found.filter("n_call is not null").select("conv_id", "call_id", "need"), "needs")
    many = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("many"))
    rows = _joined(calls.select("conv_id", "call_id"), many, "left").select(
        "conv_id", "call_id", F.coalesce("many", F.lit(0)).cast("long").alias("missing"))
    folder, schema, level = new_folder(calls.sparkSession, "levels"), rows.schema, 0
    while True:
        rows.write.parquet(f"{folder}/level={level}")
        rows = calls.sparkSession.read.schema(schema).parquet(f"{folder}/level={level}")
        placed, waiting = rows.filter("missing = 0"), rows.filter("missing > 0")
        if placed.isEmpty():
            every = calls.sparkSession.read.schema(StructType([*schema, StructField("level", IntegerType())])).parquet(folder)
            return every.filter("missing = 0").drop("missing"), unknown
        ready = edges.join(placed.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call")),
                           F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("need") == F.col("l_call"))) \
            .groupBy("conv_id", "call_id").agg(F.count("*").alias("many"))
        rows = _joined(waiting, ready, "left").select(
            "conv_id", "call_id", (F.col("missing") - F.coalesce("many", F.lit(0))).alias("missing"))
        level += 1


def _problems(value: Column, schemas: dict) -> Column:
    """What is wrong with the arguments of a call, in the order of its tool's schema."""
    none = F.array().cast("array<string>")
    is_object = F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT<")
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        checks = [_check(value, p, rule, p in schema.get("required", ())) for p, rule in schema["properties"].items()]
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys("arguments"), F.array(*map(F.lit, schema["properties"])))),
                            lambda k: F.concat(F.lit("unknown "), k))
        out = F.when(F.col("name") == tool, F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), extra)).otherwise(out)
    return F.when(~is_object & F.col("name").isin(*schemas), F.array(F.lit("arguments are not an object"))).otherwise(F.coalesce(out, none))


def _check(value: Column, name: str, rule: dict, required: bool) -> Column:
    at = f"$['{name}']"
    kind = F.schema_of_variant(F.try_variant_get(value, at, "variant"))
    whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    fits = {"string": kind == "STRING", "integer": whole, "number": whole | kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL)"),
            "boolean": kind == "BOOLEAN", "array": kind.startswith("ARRAY<"), "object": kind.startswith("OBJECT<")}[rule["type"]]
    wrong = F.when(kind.isNull(), F.lit(f"missing {name}") if required else F.lit(None).cast("string")) \
        .when(~fits, F.lit(f"type of {name}"))
    number = F.try_variant_get(value, at, "double")
    if "minimum" in rule:
        wrong = wrong.when(number < rule["minimum"], F.lit(f"{name} too small"))
    if "maximum" in rule:
        wrong = wrong.when(number > rule["maximum"], F.lit(f"{name} too large"))
    if "enum" in rule:
        wrong = wrong.when(~F.try_variant_get(value, at, "string").isin(*rule["enum"]), F.lit(f"{name} not a choice"))
    return wrong
