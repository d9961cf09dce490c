import json

from pagetext.llm import toolcalls as tc

MESSAGES = "conv_id long, turn long, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def one(i, name="search", args=None, after=()):
    return {"id": i, "name": name, "arguments": {"query": "x"} if args is None else args, "after": list(after)}


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def linked(spark, rows, **kw):
    df = spark.createDataFrame([(c, t, "", x) for c, t, x in rows], MESSAGES)
    return {(r["conv_id"], r["call_id"], r["turn"], r["place"]): r for r in tc.link_calls(df, **kw).collect()}


def test_links_orders_and_validates(spark):
    rows = [(1, 1, call(one("b", after=["a", "gone"]), one("a"))), (1, 2, result("a", {"z": 1, "y": [1.50, 2.0, "é"]})), (1, 3, result("b", "B")),
            (1, 4, result("a", "again")), (1, 5, call(one("c", after=["b", "a"]))), (1, 6, call(one("a", "measure", {"length": 2}))),
            (2, 1, call(one("a", "nope"), one("b", args={"limit": 1}), one("c", args={"query": "q", "limit": "3"}), one("d", args='{"query":"s"}'))),
            (3, 1, call(one("x", after=["y"]), one("y", after=["x"]), one("z", after=["x"]))), (3, 2, result("lost", None)),
            (None, None, call(one("n"))), (4, 1, None), (4, 2, ""), (4, 3, "{broken"), (4, 4, "[1]"), (4, 5, '{"tool_calls": 7}'), (4, 6, "[" * 100_000)]
    got = linked(spark, rows)
    status = {k: r["status"] for k, r in got.items()}
    assert status == {(1, "a", 1, 1): "ok", (1, "b", 1, 0): "ok", (1, "c", 5, 0): "no_result", (1, "a", 6, 0): "duplicate_call",
                      (2, "a", 1, 0): "unknown_tool", (2, "b", 1, 1): "invalid_arguments", (2, "c", 1, 2): "invalid_arguments", (2, "d", 1, 3): "no_result",
                      (3, "x", 1, 0): "cycle", (3, "y", 1, 1): "cycle", (3, "z", 1, 2): "cycle", (3, "lost", 2, 0): "orphan_result",
                      (None, "n", None, 0): "no_result"}
    assert [got[1, i, t, p]["level"] for i, t, p in (("a", 1, 1), ("b", 1, 0), ("c", 5, 0))] == [0, 1, 2]
    assert got[1, "b", 1, 0]["n_missing"] == 1 and got[1, "a", 1, 1]["n_results"] == 2
    assert got[1, "a", 1, 1]["json"] == '{"arguments":{"query":"x"},"id":"a","name":"search","result":{"y":[1.5,2,"é"],"z":1}}'
    assert got[2, "c", 1, 2]["problem"] == "$.limit: not of type integer" and got[2, "b", 1, 1]["problem"] == "$.query: missing"


def test_levels_equal_longest_paths(spark):
    import random
    rng = random.Random(8)
    deps = {i: sorted(rng.sample(range(i), min(i, rng.randint(0, 3)))) for i in range(60)}
    order = list(deps)
    rng.shuffle(order)
    rows = [(1, t, call(one(f"c{i}", after=[f"c{d}" for d in deps[i]]))) for t, i in enumerate(order)]
    level = {}
    for i in deps:
        level[i] = max((level[d] + 1 for d in deps[i]), default=0)
    got = linked(spark, rows)
    assert {k[1]: r["level"] for k, r in got.items()} == {f"c{i}": v for i, v in level.items()}


def test_canonical_json():
    assert tc.canonical(tc.parsed('{"b": 1.0, "a": [true, null, 1e3, 0.10, "\\u00e9"], "": {}}')) == '{"":{},"a":[true,null,1000,0.1,"é"],"b":1}'
    assert tc.canonical(tc.parsed(tc.canonical(tc.parsed('{"x": 12345678901234567890.5}')))) == '{"x":12345678901234567890.5}'


def test_derived_messages_cover_the_table(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}" if t else None) for t in range(12)] + [(2, 0, "system", "s"), (2, 1, "assistant", "a"), (None, 0, "user", "u")]
    conv = spark.createDataFrame(rows, MESSAGES)
    got = tc.link_calls(tc.derived_messages(conv)).collect()
    assert sum(r["call_id"] is not None for r in got) == 6 + 1 + 1
    assert {r["level"] for r in got if r["conv_id"] == 1} == {0, 1, 2}
    assert [r["status"] for r in got if r["conv_id"] == 2] == ["orphan_result"]


def test_empty_table(spark):
    assert linked(spark, []) == {}


def test_both_parsers_agree():
    good = ['{"a": [1, -2.50, 1e3, {"b": null, "": "x\\u00e9\\n"}], "a2": true}', "[]", "{}", '[[], {}, [{}], ""]', ' [0, -0.0, 1E400] ', '"s"', "12", '{"a":1,"a":2}']
    for text in good:
        assert tc.parsed_deep(text) == tc.parsed(text), text
    bad = ["", "[", "[1,]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1]]", "nul", "01", '"\n"', "[}", '{"a":1]', "NaN", "[Infinity]", ",", ":"]
    for text in bad:
        assert tc.parsed(text) is None
        try:
            tc.parsed_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_numbers_keep_every_digit():
    for text, want in (("0.1234567890123456789012345678901", None), ("1234567890123456789012345678901234567890", None), ("1.50", "1.5"),
                       ("-0.0", "0"), ("0E5", "0"), ("25e-1", "2.5"), ("9" * 5000, None), ("12000e-3", "12")):
        assert tc.canonical(tc.parsed(text)) == (want or text)
    assert tc.parsed('{"a": 1e9999999999999999999}') is None
    assert tc.problem(tc.parsed("9" * 5000), {"type": "integer", "minimum": 1}) is None
    assert tc.problem(tc.parsed("1.5"), {"type": "integer"}) == "$: not of type integer"


def test_deep_odd_and_large_values(spark):
    deep = "[" * 10_000 + "]" * 10_000
    big = 2 ** 60 + 1
    rows = [(big, 1, call(one("a"))), (None, None, call(one("a"))), (big, 2, '{"tool_call_id": "a", "content": %s}' % deep),
            (5, 1, '{"tool_calls": [{"id": "\\ud800", "name": "\\udfff", "arguments": {"\\ud800": 1}}, {"id": "s", "name": "search", "arguments": {"query": "q", "\\ud800": 1}}]}'),
            (6, 1, '{"tool_call_id": %d, "content": "%s"}' % (big, "long " * 400_000))]
    got = linked(spark, rows)
    assert set(got) == {(big, "a", 1, 0), (None, "a", None, 0), (5, '"\\ud800"', 1, 0), (5, "s", 1, 1), (6, str(big), 1, 0)}
    assert got[big, "a", 1, 0]["json"] == '{"arguments":{"query":"x"},"id":"a","name":"search","result":' + deep + "}"
    assert got[5, '"\\ud800"', 1, 0]["json"] == '{"arguments":{"\\ud800":1},"id":"\\ud800","name":"\\udfff"}'
    assert got[5, "s", 1, 1]["problem"] == "$.\\ud800: not expected"
    assert len(got[6, str(big), 1, 0]["json"]) > 2_000_000


def test_a_long_chain_is_ordered_in_one_pass_and_in_rounds_alike(spark):
    rows = [(c, t, call(one(f"c{t}", after=[f"c{t - 1}"] if t else []))) for c in (1, None) for t in range(200)]
    got = linked(spark, rows)
    assert all(r["level"] == r["turn"] for r in got.values()) and len(got) == 400
    calls = spark.createDataFrame([(c, i) for c in (1, 2, None) for i in "abcdef"], "conv_id long, call_id string")
    edges = [(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "e", "f"), (1, "f", "e"), (1, "d", "f"), (None, "a", "b"), (2, "a", "a")]
    edges = spark.createDataFrame(edges, "conv_id long, call_id string, needs string")
    plain = sorted(map(repr, tc.call_levels(edges, calls).collect()))
    assert plain == sorted(map(repr, tc.call_levels(edges, calls, local_rows=7).collect())) == sorted(map(repr, tc.levels(edges, calls).collect()))


def test_extra_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, 1, "", call(one("a")), "x", 7)], MESSAGES + ", label string, level long").withColumnRenamed("role", "json")
    assert [r["status"] for r in tc.link_calls(df).collect()] == ["no_result"]
