"""Chat formatting: tool calls linked to their results, ordered, checked and serialised.

Calls are rows (conv_id, turn, call_id, name, arguments JSON); results are rows (conv_id, turn, call_id,
content). `messages` takes them from conversation turns: a text that is a JSON object with `tool_calls`
(a list of {id, name, arguments}) makes calls, and a plain message too if it has `content` that is not empty; one
with `tool_call_id` and `content` makes a result, any other text a plain message. Arguments may refer to results: a value {"$ref": call_id} makes a call depend on that call.

Calls and results meet in a shuffled hash join on (conv_id, call_id), as identifiers and turns alone; their JSON is
written once and meets its position at the end. A call's level is 0, or one more than the deepest call it depends
on; its adjusted turn is the latest of its own and those of the calls it depends on and their results. Both come
from rounds over the dependencies still open, as many as the longest chain, with lineage cut between rounds; calls
in a cycle, or that wait for one, or for a call that is not there, never become ready: they get status `unresolved`,
level 0 and their own turn. Messages are ordered by conversation, adjusted turn, level, kind, identifier, turn and
MD5 of the JSON; a result's adjusted turn is no earlier than its call's. So no call stands before a call it depends on
or that one's result, no result before its call, and what depends on nothing stays in order of turn. Positions come
from a range exchange, so a conversation may hold any share of the rows.

Arguments are checked against schemas {tool: {parameter: (type, required)}}: an unknown tool, a missing
required parameter, a wrong type and arguments that are no JSON object make a call invalid. JSON is written
canonically: keys in order, no white space, by way of the variant type.

Edge cases: a null text is an empty message; null conv_id, turn and role are kept and written as null (a null turn
comes first); of several calls (results) with one identifier in a conversation the first by turn counts, the others
are `duplicate`; a call without an identifier is `open` and a result without one an `orphan`, however many there
are; a result without a call is an `orphan`, a call without a result `open`; repeated rows are messages of their own;
empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, ranked, saved

#: How schemas' types show in a variant; one more type is `reference`, {"$ref": call_id}.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",)}
REFERENCE = r'^\{"\$ref":"[^"\\]+"\}$'
#: The tool that plain exchanges stand for: a user's turn asks, the assistant's next turn replies.
REPLY = {"reply": {"prompt": ("string", True), "max_chars": ("integer", False), "after": ("reference", False)}}
#: Prompts of more characters than this state max_chars as text, which is no integer.
LONG_PROMPT = 300


def canonical(json: Column) -> Column:
    """Keys in order, no white space; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def problem(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments; null if nothing is."""
    v = F.try_parse_json(arguments)
    no_object = v.isNull() | ~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")
    found = F.when(no_object, F.lit("arguments are not an object"))
    known = F.lit(False)
    for tool, params in schemas.items():
        mine = name == F.lit(tool)
        known = known | F.coalesce(mine, F.lit(False))
        for param, (kind, required) in sorted(params.items()):
            raw = F.try_variant_get(v, f"$['{param}']", "variant")
            there = raw.isNotNull() & (F.schema_of_variant(raw) != "VOID")
            fits = F.to_json(raw).rlike(REFERENCE) if kind == "reference" else F.regexp_extract(F.schema_of_variant(raw), "^[A-Z]+", 0).isin(*KINDS[kind])
            if required:
                found = found.when(mine & ~there, F.lit(f"{param} is missing"))
            found = found.when(mine & there & ~fits, F.lit(f"{param} is not of type {kind}"))
    return F.when(name.isNull() | ~known, F.lit("unknown tool")).otherwise(found)


def messages(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain, calls, results) of turns(conv_id, turn, role, text)."""
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    maybe = t.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    maybe = maybe.withColumn("listed", F.try_variant_get("v", "$.tool_calls", "array<struct<id:string,name:string,arguments:variant>>")).withColumn("of", F.try_variant_get("v", "$.tool_call_id", "string"))
    calls = maybe.where(F.size("listed") > 0).select("conv_id", "turn", F.inline("listed")).select("conv_id", "turn", F.col("id").alias("call_id"), "name", F.to_json("arguments").alias("arguments"))
    results = maybe.where(F.col("of").isNotNull()).select("conv_id", "turn", F.col("of").alias("call_id"), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit("")).alias("content"))
    lists = F.coalesce(F.size("listed"), F.lit(0)) > 0
    part = F.try_variant_get("v", "$.content", "variant")
    said = F.when(F.schema_of_variant(part) != "VOID", F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(part)))
    plain = maybe.where(F.col("of").isNull()).select("conv_id", "turn", "role", F.when(lists, F.nullif(said, F.lit(""))).otherwise(F.col("text")).alias("text")).where("text is not null")
    return plain, calls, results


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As messages(), and each user's turn as a call of `reply` that the assistant's next turn answers.

    The call states the prompt, its length as max_chars (as text for prompts over LONG_PROMPT, so that a check
    fails), and in every second exchange a reference to the call two turns before.
    """
    plain, calls, results = messages(turns)
    ident = lambda back: F.concat(F.lit("turn-"), (F.col("turn") - back).cast("string"))
    size = F.length("text")
    after = F.when(F.col("turn") % 4 >= 2, F.struct(ident(2).alias("$ref")))
    prompt = F.col("text").alias("prompt")
    long_, short = (F.to_json(F.struct(after.alias("after"), n.alias("max_chars"), prompt)) for n in (size.cast("string"), size))
    asked = plain.where("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), F.lit("reply").alias("name"), F.when(size > LONG_PROMPT, long_).otherwise(short).alias("arguments"))
    told = plain.where("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    rest = plain.where("role is null or role not in ('user', 'assistant')")
    return rest, calls.unionByName(asked), results.unionByName(told)


def heads(rows: DataFrame) -> DataFrame:
    """conv_id, call_id, uid and turn of the first row (by turn, then MD5) of each identifier; an identifier's rows never meet in one task."""
    key = ["conv_id", "call_id"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"), F.min("turn").alias("turn"))
    counted = cut(counted)
    often = counted.where("n > 1").select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oi"))
    again = rows.join(often.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("oi")), "left_semi")
    first = again.groupBy(*key).agg(F.min(F.struct("turn", "tie", "uid")).alias("h")).select(*key, "h.uid", "h.turn")
    return counted.where("n = 1").select(*key, "uid", "turn").unionByName(first)


def settled(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level and at (adjusted turn) of calls(conv_id, call_id, refs, turn, answered) that depend on others; null where unresolved.

    A round settles the calls whose references are all settled, and lets every reference to a waiting call that has a single reference
    itself skip it, so that a chain of n calls takes about log n rounds. What skips keeps `steps` and the latest turn on its way.
    """
    key = ["conv_id", "call_id"]
    on = F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("ref") == F.col("fi"))
    done = lambda df, at: df.select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "level", F.greatest(at, "answered").alias("done"))
    free = done(calls.where(F.size("refs") <= 0).withColumn("level", F.lit(0)), F.col("turn"))
    refs = F.array_distinct("refs")
    waiting = calls.where(F.size("refs") > 0).select(*key, "answered", F.size(refs).alias("need"), F.explode(refs).alias("ref"), F.lit(1).alias("steps"), F.col("turn").alias("least"))
    # what waits, with level and last turn of what is known of its references
    seen = cut(waiting.join(free.hint("shuffle_hash"), on, "left").drop("fc", "fi"))
    all_ = seen.select(*key).distinct()
    found = None
    while True:
        now = seen.groupBy(*key).agg(F.count("level").alias("have"), F.max("need").alias("need"), F.max(F.col("level") + F.col("steps")).alias("level"), F.greatest(F.max("least"), F.max("done")).alias("at"), F.max("answered").alias("answered"))
        now = cut(now.where("have = need").select(*key, "level", "at", "answered"))
        if now.isEmpty():
            break
        found = now if found is None else found.unionByName(now)
        rest = seen.join(now.select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi")), F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi")), "left_anti")
        new = done(now, F.col("at")).withColumnsRenamed({"level": "new", "done": "then"})
        rest = cut(rest.join(new.hint("shuffle_hash"), on, "left").select(*key, "answered", "need", "ref", "steps", "least", F.coalesce("level", "new").alias("level"), F.coalesce("done", "then").alias("done")))
        if rest.isEmpty():
            break
        over = rest.where("level IS NULL AND need = 1").select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), F.col("ref").alias("next"), F.col("steps").alias("more"), F.greatest("least", "answered").alias("late"))
        jumped = rest.join(over.hint("shuffle_hash"), on & F.col("level").isNull(), "left")
        # a jump may land on what was settled long ago; so it looks there, too
        jumped = jumped.select(*key, "answered", "need", F.coalesce("next", "ref").alias("ref"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("least", "late").alias("least"), F.col("level").alias("had"), F.col("done").alias("was"), F.col("next").isNotNull().alias("far"))
        known = free.unionByName(done(found, F.col("at")))
        seen = cut(jumped.join(known.hint("shuffle_hash"), on & F.col("far"), "left").select(*key, "answered", "need", "ref", "steps", "least", F.coalesce("had", "level").alias("level"), F.coalesce("was", "done").alias("done")))
    if found is None:
        return all_.withColumns({"level": F.lit(None).cast("int"), "at": F.lit(None).cast("bigint")})
    f = found.select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "level", "at")
    return all_.join(f.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi")), "left").drop("fc", "fi")


def linked(plain: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """conv_id, position, turn, kind, call_id, status, problem and json, one row for each message, call and result."""
    none = F.lit(None).cast("string")
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'\{"\$ref":"([^"\\]+)"\}'), 1)))
    c = calls.select("conv_id", "turn", "call_id", "name", F.coalesce(canonical(F.col("arguments")), F.col("arguments")).alias("arguments"))
    call_json = F.to_json(F.struct(F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.lit("call").alias("type")))
    result_json = F.to_json(F.struct(F.col("content").alias("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")))
    text_json = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"), F.lit("message").alias("type")), {"ignoreNullFields": "false"})
    rows = c.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", problem(F.col("name"), F.col("arguments"), schemas).alias("problem"), refs.alias("refs"), call_json.alias("json"))
    rows = rows.unionByName(results.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", none.alias("problem"), F.lit(None).cast("array<string>").alias("refs"), result_json.alias("json")))
    rows = rows.unionByName(plain.select("conv_id", "turn", F.lit("message").alias("kind"), none.alias("call_id"), none.alias("problem"), F.lit(None).cast("array<string>").alias("refs"), text_json.alias("json")))
    rows = saved(rows.withColumns({"uid": F.monotonically_increasing_id(), "tie": F.md5("json")}), "messages")
    slim = rows.select("uid", "conv_id", "turn", "kind", "call_id", "tie")
    named = slim.where("call_id is not null")
    answers = heads(named.where("kind = 'result'")).select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("uid").alias("r_uid"), F.col("turn").alias("answered"))
    asked = heads(named.where("kind = 'call'"))
    same = F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri"))
    met = asked.join(answers.hint("shuffle_hash"), same, "full_outer")
    met = cut(met.select(F.when(F.col("uid").isNotNull(), F.col("conv_id")).otherwise(F.col("rc")).alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"), "uid", "turn", "r_uid", "answered"))
    needs = rows.where(F.size("refs") > 0).select(F.col("uid").alias("n_uid"), "refs")
    if needs.isEmpty():
        met = met.withColumns({"level": F.lit(0), "at": F.col("turn"), "lost": F.lit(False)})
    else:
        with_refs = cut(met.where("uid is not null").join(needs.hint("shuffle_hash"), F.col("uid") == F.col("n_uid"), "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>"))))
        s = settled(with_refs).select(F.col("conv_id").alias("sc"), F.col("call_id").alias("si"), "level", F.col("at").alias("later"), F.col("level").isNull().alias("lost"))
        met = met.join(s.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("call_id") == F.col("si")), "left")
        met = met.withColumns({"level": F.coalesce("level", F.lit(0)), "at": F.coalesce("later", "turn"), "lost": F.coalesce("lost", F.lit(False))})
    of_call = F.when(F.col("lost"), "unresolved").when(F.col("r_uid").isNull(), "open").otherwise("linked")
    of_result = F.when(F.col("uid").isNull(), "orphan").otherwise("linked")
    two = F.array(F.struct(F.col("uid").alias("s_uid"), of_call.alias("status"), F.col("at"), F.col("level")), F.struct(F.col("r_uid").alias("s_uid"), of_result.alias("status"), F.greatest("answered", "at").alias("at"), F.col("level")))
    state = met.select(F.inline(two)).where("s_uid is not null")
    other = F.when(F.col("kind") == "message", "plain").when(F.col("call_id").isNotNull(), "duplicate").when(F.col("kind") == "call", "open").otherwise("orphan")
    placed = slim.join(state.hint("shuffle_hash"), F.col("uid") == F.col("s_uid"), "left")
    placed = placed.select("uid", "conv_id", "turn", "kind", "call_id", "tie", F.coalesce("status", other).alias("status"), F.when(F.col("s_uid").isNull(), F.col("turn")).otherwise(F.col("at")).alias("at"), F.coalesce("level", F.lit(0)).alias("level"))
    # bodies stay where they are until positions are known
    at = ranked(placed, ["conv_id"], ["at", "level", "kind", "call_id", "turn", "tie"], "position", few=False).select(F.col("uid").alias("p_uid"), "position", "status")
    out = rows.join(at, F.col("uid") == F.col("p_uid"))
    return out.select("conv_id", F.col("position").cast("long").alias("position"), "turn", "kind", "call_id", "status", "problem", "json")


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, turn, 'turn-' || turn AS call_id, text, CASE WHEN turn % 4 >= 2 THEN 'turn-' || (turn - 2) END AS ref FROM t WHERE role = 'user'),
r AS (SELECT conv_id, turn, 'turn-' || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant'),
d AS (SELECT c.*, r.turn AS answered, c.ref IS NOT NULL AND b.call_id IS NULL AS lost, CASE WHEN b.call_id IS NULL THEN 0 ELSE 1 END AS level,
    greatest(c.turn, b.turn, q.turn) AS adj
  FROM c LEFT JOIN r USING (conv_id, call_id) LEFT JOIN c b ON b.conv_id = c.conv_id AND b.call_id = c.ref LEFT JOIN r q ON q.conv_id = c.conv_id AND q.call_id = b.call_id),
rows AS (
  SELECT conv_id, turn, adj, level, 'call' AS kind, call_id, CASE WHEN lost THEN 'unresolved' WHEN answered IS NULL THEN 'open' ELSE 'linked' END AS status,
    CASE WHEN length(text) > {LONG_PROMPT} THEN 'max_chars is not of type integer' END AS problem,
    '{{"arguments":{{' || CASE WHEN ref IS NULL THEN '' ELSE '"after":{{"$ref":"' || ref || '"}},' END
    || '"max_chars":' || CASE WHEN length(text) > {LONG_PROMPT} THEN '"' || length(text) || '"' ELSE CAST(length(text) AS VARCHAR) END
    || ',"prompt":' || CAST(to_json(text) AS VARCHAR) || '}},"id":"' || call_id || '","name":"reply","type":"call"}}' AS json FROM d
  UNION ALL
  SELECT r.conv_id, r.turn, greatest(r.turn, d.adj), coalesce(d.level, 0), 'result', r.call_id, CASE WHEN d.call_id IS NULL THEN 'orphan' ELSE 'linked' END, NULL,
    '{{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":"' || r.call_id || '","type":"result"}}'
  FROM r LEFT JOIN d USING (conv_id, call_id)
  UNION ALL
  SELECT conv_id, turn, turn, 0, 'message', NULL, 'plain', NULL, '{{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"type":"message"}}'
  FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY adj NULLS FIRST, level, kind, call_id NULLS FIRST, turn NULLS FIRST, md5(json)) - 1 AS BIGINT) AS position,
  turn, kind, call_id, status, problem, json FROM rows
"""
