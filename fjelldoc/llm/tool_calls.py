"""Tool-call linking (operator 8).

Calls and results meet by a join on the call's identifier. A call may name one call it depends on; its level
in the topological order is found by pointer doubling, so a chain of n calls takes log2(n) joins.
Arguments are checked against schemas, and each link is written as canonical JSON: keys in order, no white space.

Defined cases: of calls (or results) that repeat an identifier the least row counts, and the number of
rows is kept; null identifiers link with nothing and are reported as invalid; a dependency on an
unknown call is none; calls on a cycle, or behind one, have level null; arguments that are no JSON object
are an error; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.llm.common import written


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level: 0 for a call that depends on none; each state row doubles the distance to its ancestor."""
    known = calls.select(F.col("call_id").alias("depends_on"), F.lit(True).alias("_known"))
    state = calls.join(known, "depends_on", "left").select("call_id", F.when(F.col("_known"), F.col("depends_on")).alias("up"), F.when(F.col("_known"), 1).otherwise(0).cast("bigint").alias("level"))
    state = written(state)
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if not state.where("up is not null").limit(1).count():
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = written(state.join(above, "up", "left").select("call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def argument_errors(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted error texts. schemas: by tool, by argument, its type as `schema_of_variant` names it and whether it must be there."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    per_tool = F.array(F.concat(F.lit("unknown tool "), F.coalesce(tool, F.lit("null"))))
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            own = F.schema_of_variant(value)
            missing = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
            checks.append(F.when(value.isNull(), missing).when(own != kind, F.lit(f"{field} is not {kind}")))
        extra = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unexpected "), k))
        per_tool = F.when(tool == name, F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>")))).otherwise(per_tool)
    return F.sort_array(F.when(~is_object, F.array(F.lit("arguments are no JSON object"))).otherwise(per_tool))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per identifier: call_id, level, status, n_calls, n_results, errors, message.

    calls: call_id, depends_on, tool, arguments; results: call_id, content. status: answered, unanswered,
    orphan (a result without its call) or invalid (null identifier).
    """
    own = calls.groupBy("call_id").agg(F.min(F.struct("tool", "arguments", "depends_on")).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls")
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    own = written(own)
    at = levels(own.where("call_id is not null").select("call_id", "depends_on"))
    joined = own.join(answers, "call_id", "full_outer").join(at, "call_id", "left")
    n_calls, n_results = F.coalesce("n_calls", F.lit(0)), F.coalesce("n_results", F.lit(0))
    status = F.when(F.col("call_id").isNull(), "invalid").when(n_calls == 0, "orphan").when(n_results == 0, "unanswered").otherwise("answered")
    errors = F.when(n_calls > 0, argument_errors(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    message = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("call_id"), F.col("content").alias("content"), F.col("tool").alias("name")))
    return joined.select("call_id", "level", status.alias("status"), n_calls.alias("n_calls"), n_results.alias("n_results"), errors.alias("errors"), message.alias("message"))


# -- calls and results that stand in the conversations ----------------------------

SCHEMAS = {"reply": {"prompt": ("STRING", True), "turn": ("BIGINT", True), "system": ("BOOLEAN", False)}}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user's turn calls the tool `reply`, the next turn of the assistant is its result, and a call depends on that two turns before."""
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn").cast("bigint")
    calls = conversations.where("role = 'user'").select(
        ident(turn).alias("call_id"), ident(turn - 2).alias("depends_on"), F.lit("reply").alias("tool"), F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"))).alias("arguments")
    )
    results = conversations.where("role = 'assistant'").select(ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
