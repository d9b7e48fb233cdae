import json

from tessera.llm import chat

SCHEMA = {"find": {"q": ("string", True), "n": ("integer", False)}}


def test_links_order_and_checks(spark):
    calls = [{"id": "a", "name": "find", "arguments": {"q": {"$ref": "b"}}}, {"id": "b", "name": "find", "arguments": {"q": "x", "n": 3}}]
    turns = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", json.dumps({"tool_calls": calls})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "found"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zzz", "content": "?"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "find", "arguments": {"q": {"$ref": "r"}}}, {"id": "r", "name": "find", "arguments": {"q": {"$ref": "p"}}}]})),
        (2, 1, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "none", "arguments": {}}, {"id": "y", "name": "find", "arguments": {"n": "3"}}, {"id": "y", "name": "find", "arguments": [1]}]})),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.linked(*chat.messages(df), SCHEMA).collect()
    at = {(r["conv_id"], r["kind"], r["call_id"], r["status"]): r for r in rows}
    assert at[1, "call", "b", "linked"]["position"] < at[1, "result", "b", "linked"]["position"] < at[1, "call", "a", "open"]["position"]
    assert at[1, "call", "b", "linked"]["problem"] is None and at[1, "call", "a", "open"]["problem"] == "q is not of type string"
    assert at[1, "call", "b", "linked"]["json"] == '{"arguments":{"n":3,"q":"x"},"id":"b","name":"find","type":"call"}'
    assert (1, "result", "zzz", "orphan") in at and (2, "call", "p", "unresolved") in at and (2, "call", "r", "unresolved") in at
    assert at[2, "call", "x", "open"]["problem"] == "unknown tool"
    y = {at[2, "call", "y", s]["problem"] for s in ("open", "duplicate")}
    assert y <= {"q is missing", "arguments are not an object", "n is not of type integer"} and len(y) == 2
    assert json.loads(at[None, "message", None, "plain"]["json"]) == {"content": "", "role": None, "type": "message"}
    for c in (1, 2):
        own = sorted(r["position"] for r in rows if r["conv_id"] == c)
        assert own == list(range(len(own)))


def test_long_chain(spark):
    n = 6
    calls = [{"id": f"c{k}", "name": "find", "arguments": {"q": {"$ref": f"c{k + 1}"}} if k < n - 1 else {"q": "end"}} for k in range(n)]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id bigint, turn bigint, role string, text string")
    rows = sorted(chat.linked(*chat.messages(df), SCHEMA).collect(), key=lambda r: r["position"])
    assert [r["call_id"] for r in rows] == [f"c{k}" for k in reversed(range(n))]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.linked(*chat.exchanges(df), chat.REPLY).count() == 0


def test_turn_that_speaks_and_calls(spark):
    call = [{"id": "a", "name": "find", "arguments": {"q": "x"}}]
    said = ["let me look", "", None, [{"type": "text", "text": "in parts"}]]
    turns = [(k, 0, "assistant", json.dumps({"content": s, "tool_calls": call})) for k, s in enumerate(said)]
    turns += [(9, 0, "user", "where?"), (9, 1, "assistant", json.dumps({"content": "a moment", "tool_calls": call})), (10, 0, "assistant", json.dumps({"tool_calls": call}))]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.linked(*chat.messages(df), SCHEMA).collect()
    got = {r["conv_id"]: json.loads(r["json"]) for r in rows if r["kind"] == "message" and r["conv_id"] < 9}
    assert {k: m["role"] for k, m in got.items()} == {0: "assistant", 3: "assistant"}
    assert got[0]["content"] == said[0] and json.loads(got[3]["content"]) == said[3]
    assert sorted(r["conv_id"] for r in rows if r["kind"] == "call") == [0, 1, 2, 3, 9, 10]
    rows = chat.linked(*chat.exchanges(df), chat.REPLY).collect()
    assert {(r["call_id"], r["status"]) for r in rows if r["conv_id"] == 9} == {("turn-0", "linked"), ("a", "open")}
    assert any(json.loads(r["json"]).get("content") == "a moment" for r in rows)


def talk(spark, turns):
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    return sorted(chat.linked(*chat.messages(df), SCHEMA).collect(), key=lambda r: (r["conv_id"] or -1, r["position"]))


def called(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": "find", "arguments": a} for i, a in calls]})


def test_what_depends_on_nothing_stays_in_order(spark):
    told = lambda i: json.dumps({"tool_call_id": i, "content": "ok"})
    turns = [(1, 0, "assistant", called(("a", {"q": "x"}))), (1, 1, "tool", told("a")), (1, 2, "assistant", called(("b", {"q": {"$ref": "a"}}))), (1, 3, "tool", told("b")), (1, 4, "user", "thanks"), (1, 5, "assistant", "bye")]
    assert [r["turn"] for r in talk(spark, turns)] == [0, 1, 2, 3, 4, 5]
    # a call that stands before what it refers to comes behind that one's result
    turns = [(1, 0, "assistant", called(("b", {"q": {"$ref": "a"}}))), (1, 1, "assistant", called(("a", {"q": "x"}))), (1, 2, "tool", told("a")), (1, 3, "tool", told("b")), (1, 4, "user", "thanks")]
    assert [(r["kind"], r["call_id"]) for r in talk(spark, turns)] == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("message", None)]


def test_odd_calls(spark, docs):
    """Null identifiers, repeated rows, very long texts and columns of clashing names."""
    none = json.dumps({"tool_calls": [{"name": "find", "arguments": {"q": "x"}}, {"name": "find", "arguments": {"q": "y"}}]})
    turns = [(1, 0, "assistant", none), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "1"})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "2"}))]
    turns += [(2, 0, "user", "word " * 60000)] * 2 + [(2, None, "user", "no turn"), (None, 3, None, None)]
    kind = "conv_id bigint, turn bigint, role string, text string, uid int, status string, at double, level int, position string, json string, kind string, tie int"
    df = spark.createDataFrame([(*t, 1, "x", 0.5, 3, "y", "{}", "z", 4) for t in turns], kind)
    rows = chat.linked(*chat.messages(df), SCHEMA).collect()
    assert sorted(r["status"] for r in rows if r["kind"] == "call") == ["open", "open"]
    assert [r["status"] for r in sorted((r for r in rows if r["kind"] == "result"), key=lambda r: r["turn"])] == ["orphan", "duplicate"]
    two = sorted((r for r in rows if r["conv_id"] == 2), key=lambda r: r["position"])
    assert [r["turn"] for r in two] == [None, 0, 0] and [r["position"] for r in two] == [0, 1, 2] and len(two[1]["json"]) > 300000
    assert len(rows) == 8


def test_links_are_hash_joined_and_nothing_grows_in_a_broadcast(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = chat.linked(*chat.exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet")), chat.REPLY)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_settled_against_a_walk(spark, monkeypatch):
    """Chains of 70, random references to one to three calls, missing ones and rings, with turns and answers in any order."""
    rng = __import__("random").Random(5)
    calls = {}
    for k in range(70):
        calls[1, f"c{k}"] = ([f"c{k + 1}"] if k < 69 else [], rng.randrange(99), rng.choice([None, rng.randrange(99)]))
    for k in range(120):
        n = rng.choice([0, 1, 1, 1, 2, 3])
        calls[2, f"d{k}"] = ([f"d{rng.randrange(k)}" for _ in range(n)] if k else [], rng.randrange(99), rng.choice([None, rng.randrange(99)]))
    calls[2, "lost"] = (["nobody", "d0"], 1, None)
    calls[2, "after"] = (["lost"], 1, None)
    calls |= {(None, "x"): (["y"], 1, 1), (None, "y"): (["z"], 2, 2), (None, "z"): (["x"], 3, 3), (None, "w"): (["x"], 4, 4)}
    want = {}

    def walk(c, way=()):
        if c not in calls or c in way:
            return None
        if c not in want:
            refs, turn, _ = calls[c]
            got = [walk((c[0], r), (*way, c)) for r in refs]
            if None in got:
                want[c] = None
            else:
                want[c] = (max([v[0] + 1 for v in got], default=0), max([turn, *(v[1] if (a := calls[c[0], r][2]) is None else max(v[1], a) for v, r in zip(got, refs))]))
        return want[c]

    __import__("sys").setrecursionlimit(5000)
    for c in calls:
        walk(c)
    rounds, cut = [], chat.cut
    monkeypatch.setattr(chat, "cut", lambda df: (rounds.append(1), cut(df))[1])
    df = spark.createDataFrame([(*c, refs, turn, answered) for c, (refs, turn, answered) in calls.items()], "conv_id bigint, call_id string, refs array<string>, turn bigint, answered bigint")
    got = {(r["conv_id"], r["call_id"]): None if r["level"] is None else (r["level"], r["at"]) for r in chat.settled(df).collect()}
    assert got == {c: v for c, v in want.items() if calls[c][0]}
    assert want[1, "c0"][0] == 69 and len(rounds) < 40
