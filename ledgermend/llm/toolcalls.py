"""Chat formatting with tool-call linking.

Method: calls and results are hash-joined by identifier, ordered topologically,
their arguments validated against schemas, and every message serialised as one
line of canonical JSON (keys sorted at every depth, no spaces).  Only DataFrame
functions are used.

Scale: joins are by (conversation, identifier), so a conversation that holds a
large part of all rows spreads over tasks; nothing is gathered by
conversation.  The topological order is a pair of sort columns.  Each round resolves
calls whose needs are placed and lets every dependency jump over a call with a single
need, so a chain of n calls takes about log2(n) rounds; one written table a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.workspace import discard, stored

#: tool -> parameter -> (type, required); types are string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]

CONVERSATION_TOOLS: Schemas = {
    "answer": {"text": ("string", True), "turn": ("integer", True)},
    "follow_up": {"after": ("array", True), "text": ("string", True), "turn": ("integer", True)},
}


def canonical(json: F.Column) -> F.Column:
    """JSON text with sorted keys and no spaces; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(json))


def _has_type(value: F.Column, kind: str) -> F.Column:
    name = F.schema_of_variant(value)
    starts = {
        "string": ["STRING"], "integer": ["BIGINT", "INT", "SMALLINT", "TINYINT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"],
        "number": ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"],
    }[kind]
    test = F.lit(False)
    for s in starts:
        test = test | name.startswith(s)
    return F.coalesce(test, F.lit(False))


def arguments_valid(name: F.Column, arguments: F.Column, schemas: Schemas) -> F.Column:
    """False for an unknown tool, unparsable or non-object arguments, a missing, mistyped or undeclared parameter."""
    parsed = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool in sorted(schemas):
        good = _has_type(parsed, "object")
        known = F.array(*[F.lit(p) for p in sorted(schemas[tool])]).cast("array<string>")
        good = good & (F.size(F.array_except(F.json_object_keys(arguments), known)) == 0)
        for parameter, (kind, required) in sorted(schemas[tool].items()):
            value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
            good = good & ((_has_type(value, kind)) if required else (value.isNull() | _has_type(value, kind)))
        out = F.when(name == tool, F.coalesce(good, F.lit(False))).otherwise(out)
    return out


def quoted(text: F.Column) -> F.Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(text.alias("x")))  # {"x":...}
    return F.when(text.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def place(turn, step) -> F.Column:
    """A place in the order: a turn, and a step within it."""
    return F.struct(turn.cast("long").alias("turn"), step.cast("long").alias("step"))


def order_calls(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id, call_id, at``: where each call stands, after all that it needs.

    ``calls`` has conv_id, call_id, at (its own place) and answered (its first result's
    place, or null), ``needs`` has conv_id, call_id and needed.  A call stands at the
    latest of its own place and a step after whatever it needs and that one's result.  A
    call is unresolved if it is in a cycle or needs an unresolved one; needs of unresolved
    calls don't count, and neither do unknown identifiers.
    """
    calls = stored(calls, "tool-calls")
    key = ["conv_id", "call_id"]
    after_result = F.when(F.col("answered").isNotNull(), place(F.col("answered.turn"), F.lit(1)))
    asked = calls.select("conv_id", F.col("call_id").alias("needed"), F.when(F.col("answered").isNotNull(), 2).otherwise(1).cast("long").alias("gap"), after_result.alias("earliest"))
    limits = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("limit"))
    first = needs.join(calls.select(key), key, "left_semi").distinct().join(asked, ["conv_id", "needed"])
    first = stored(first, "tool-needs")
    floor = first.groupBy(key).agg(F.max("earliest").alias("earliest"))
    state = stored(calls.join(floor, key, "left").select(*key, F.greatest("at", "earliest").alias("at")), "tool-order")
    # next is the call that a dependency waits for, null if it leads into a cycle.
    edges = stored(first.join(limits, "conv_id").select(*key, F.col("needed").alias("next"), "gap", F.lit(1).cast("long").alias("hops"), "limit"), "tool-edges")
    while not edges.where("next is not null").isEmpty():
        heads = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("next", "gap", "hops")).alias("only"))
        # Only what is still waited for takes part: most calls are placed after a round or two.
        waited = edges.where("next is not null").select("conv_id", F.col("next").alias("call_id")).distinct()
        ahead = state.join(waited, key, "left_semi").join(heads, key, "left").select("conv_id", F.col("call_id").alias("next"), F.col("at").alias("there"), F.coalesce("n", F.lit(0)).alias("n"), "only")
        met = edges.join(ahead, ["conv_id", "next"], "left")
        jumps = F.coalesce(F.col("n") == 1, F.lit(False))
        hops = F.when(jumps, F.col("hops") + F.col("only.hops")).otherwise(F.col("hops"))
        moved = met.select(
            *key, F.when(F.col("n") <= 1, place(F.col("there.turn"), F.col("there.step") + F.col("gap"))).alias("ready"),
            F.coalesce(F.col("n") == 0, F.lit(False)).alias("placed"), F.coalesce(F.col("n") <= 1, F.lit(False)).alias("changed"),
            F.when(hops <= F.col("limit"), F.when(jumps, F.col("only.next")).otherwise(F.col("next"))).alias("next"),
            F.when(jumps, F.col("gap") + F.col("only.gap")).otherwise(F.col("gap")).alias("gap"), hops.alias("hops"), "limit",
        )
        moved = stored(moved, "tool-edges")
        discard(edges)
        if moved.where("changed").isEmpty():
            edges = moved
            break
        later = moved.groupBy(key).agg(F.max("ready").alias("ready"))
        raised = state.join(later, key).select(*key, F.greatest("at", "ready").alias("at"))
        raised = stored(raised.unionByName(state.join(later, key, "left_anti")), "tool-order")
        discard(state)
        state = raised
        edges = stored(moved.where(~F.col("placed")).select(*key, "next", "gap", "hops", "limit"), "tool-edges")
        discard(moved)
    if edges.isEmpty():
        return state
    stuck = edges.select(key).distinct()
    good = state.join(stuck, key, "left_anti")
    reach = first.join(stuck, key, "left_semi").join(good.select("conv_id", F.col("call_id").alias("needed"), F.col("at").alias("there")), ["conv_id", "needed"])
    reach = reach.groupBy(key).agg(F.max(F.greatest(place(F.col("there.turn"), F.col("there.step") + F.col("gap")), "earliest")).alias("ready"))
    held = calls.join(stuck, key, "left_semi").join(reach, key, "left").select(*key, F.greatest("at", "ready").alias("at"))
    return good.unionByName(held)


def link(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Messages linked, ordered, validated and serialised, one row each.

    ``messages`` has conv_id, turn, role, text, call_id, name, arguments (JSON
    text) and depends_on (identifiers of calls whose results a call needs).  A
    row with a name is a call, one with a call_id alone is a result, any other a
    plain message.  Repeated identifiers and rows: the call with the least turn counts
    for its identifier, and every row stays.  A call or result with a null or unknown
    identifier stays, unlinked.  Calls in a dependency cycle, and those that need one,
    keep their place but for needs that can be ordered.

    Returns conv_id, turn, role, kind, call_id, linked, valid (null but for calls),
    sort_turn and sort_step (sorting by them puts results after their calls and
    calls after what they depend on), and json.  Null text is JSON null; an empty
    table gives no rows; further columns are ignored.
    """
    m = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "call_id", "name", "arguments", "depends_on",
        F.when(F.col("name").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("message").alias("kind"),
    )
    own = place(F.col("turn"), F.lit(0))
    calls = m.where("kind = 'call' and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(own).alias("at"))
    answers = m.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min(own).alias("answered"))
    calls = calls.join(answers, ["conv_id", "call_id"], "left")
    needs = m.where("kind = 'call' and size(depends_on) > 0").select("conv_id", "call_id", F.explode("depends_on").alias("needed"))

    found = order_calls(calls, needs).withColumn("known", F.lit(True))
    j = m.join(found, ["conv_id", "call_id"], "left")
    linked = F.when(F.col("kind") == "message", F.lit(None)).otherwise(F.coalesce("known", F.lit(False)))
    earliest = F.when(F.col("at").isNull(), F.lit(None)).when(F.col("kind") == "result", place(F.col("at.turn"), F.col("at.step") + 1)).when(F.col("kind") == "call", F.col("at"))
    sort_key = F.greatest(own, earliest)
    valid = F.when(F.col("kind") == "call", arguments_valid(F.col("name"), F.col("arguments"), schemas))
    body = F.when(F.col("kind") == "call", F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
    body = body.when(F.col("kind") == "result", F.concat(F.lit('{"call_id":'), quoted(F.col("call_id")), F.lit(',"content":'), quoted(F.col("text")), F.lit(',"role":"tool"}')))
    body = body.otherwise(F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
    return j.select("conv_id", "turn", "role", "kind", "call_id", linked.alias("linked"), valid.alias("valid"), sort_key["turn"].alias("sort_turn"), sort_key["step"].cast("int").alias("sort_step"), body.alias("json"))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: a user turn calls, the assistant turn after it is the result.

    The call of turn t needs that of turn t + 2, as if an agent had noted its plan before
    the steps it rests on: calls of a conversation move behind later ones.  Its
    name is ``answer`` if the next user turn isn't there and ``follow_up`` else.  A text of a length
    divisible by 5 passes its turn as a string, against the schema.  Where a conversation
    and turn stand several times, only the rows' own columns tell them apart.
    """
    own = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    turn = F.col("turn")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    later = conversations.where(user).select("conv_id", (turn - 2).alias("turn"), F.lit(True).alias("more")).distinct()
    m = conversations.select("conv_id", "turn", "role", "text").join(later, ["conv_id", "turn"], "left")
    more = user & F.coalesce("more", F.lit(False))
    after = F.when(more, F.array(own(turn + 2)))
    loose = F.coalesce(F.length("text") % 5 == 0, F.lit(False))
    fields = lambda t: F.to_json(F.struct(t.alias("turn"), F.col("text").alias("text"), after.alias("after")))
    return m.select(
        "conv_id", "turn", "role", "text",
        F.when(user, own(turn)).when(assistant, own(turn - 1)).alias("call_id"),
        F.when(user, F.when(more, "follow_up").otherwise("answer")).alias("name"),
        F.when(user, F.when(loose, fields(turn.cast("string"))).otherwise(fields(turn))).alias("arguments"),
        F.coalesce(after, F.array().cast("array<string>")).alias("depends_on"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link(conversation_messages(conversations), CONVERSATION_TOOLS)


#: Calls of one conversation whose turns follow by 2 make a run, placed from its last call back:
#: each earlier call comes a step after the result (or call) of the next.
ORACLE = """
WITH m AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM conversations),
k AS (SELECT DISTINCT conv_id, turn, call_id FROM m WHERE kind = 'call'),
a AS (SELECT DISTINCT conv_id, call_id FROM m WHERE kind = 'result'),
r AS (SELECT k.*, CASE WHEN a.call_id IS NULL THEN 1 ELSE 2 END AS gap,
      turn - 2 * ROW_NUMBER() OVER (PARTITION BY k.conv_id, turn % 2 ORDER BY turn) AS run FROM k LEFT JOIN a ON a.conv_id = k.conv_id AND a.call_id = k.call_id),
o AS (SELECT *, ROW_NUMBER() OVER back AS place, FIRST_VALUE(turn + gap - 1) OVER back AS done,
      COALESCE(SUM(CASE WHEN nth > 1 THEN gap ELSE 0 END) OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gaps
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn DESC) AS nth FROM r)
      WINDOW back AS (PARTITION BY conv_id, turn % 2, run ORDER BY turn DESC)),
c AS (SELECT conv_id, call_id, place > 1 AS more, CASE WHEN place = 1 THEN turn ELSE done END AS at_turn, CASE WHEN place = 1 THEN 0 ELSE 1 + gaps END AS at_step FROM o)
SELECT m.conv_id, m.turn, m.role, m.kind, m.call_id,
  CASE WHEN m.kind <> 'message' THEN c.call_id IS NOT NULL END AS linked,
  CASE WHEN m.kind = 'call' THEN text IS NOT NULL AND LENGTH(text) % 5 <> 0 END AS valid,
  CASE WHEN c.call_id IS NULL OR m.turn > at_turn THEN m.turn ELSE at_turn END AS sort_turn,
  CAST(CASE WHEN c.call_id IS NULL OR m.turn > at_turn THEN 0 WHEN m.kind = 'result' THEN at_step + 1 ELSE at_step END AS INT) AS sort_step,
  CASE m.kind
    WHEN 'call' THEN '{"arguments":{' || CASE WHEN more THEN '"after":["' || m.conv_id || ':' || (turn + 2) || '"],' ELSE '' END || CASE WHEN text IS NULL THEN '' ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || ',' END
      || '"turn":' || CASE WHEN LENGTH(text) % 5 = 0 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END
      || '},"id":"' || m.call_id || '","name":"' || CASE WHEN more THEN 'follow_up' ELSE 'answer' END || '","role":"user"}'
    WHEN 'result' THEN '{"call_id":"' || m.call_id || '","content":' || COALESCE(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"tool"}'
    ELSE '{"content":' || COALESCE(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || COALESCE(CAST(to_json(role) AS VARCHAR), 'null') || '}' END AS json
FROM m LEFT JOIN c ON m.conv_id = c.conv_id AND m.call_id = c.call_id"""

QUERIES = {"op9_tool_calls": op9}
ORACLES = {"op9_tool_calls": ORACLE}
