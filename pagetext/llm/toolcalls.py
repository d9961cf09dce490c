"""Chat formatting: tool-call linking.

A message whose text is a JSON object with ``tool_calls`` (a list of objects
``id, name, arguments, after``) makes calls; one with ``tool_call_id`` is the
result of that call. Calls and results meet in a hash join on conversation and
identifier; ``after`` names calls that must come first. Calls are ordered
topologically: their level is one more than the highest level they wait for,
and within a level they go by turn and place in the message. Arguments are
validated against the tool's schema; call, arguments and result come out as one
canonical JSON object (keys sorted, no blanks, UTF-8, numbers by value).

Status of a call: ``ok``, ``no_result``, ``unknown_tool``, ``invalid_arguments``,
``cycle`` (it waits, through others, for itself; level null); the first that
applies in the order unknown_tool, invalid_arguments, cycle, no_result. A result
without call has status ``orphan_result``. Of several calls with one identifier
the first by turn and place is the call, the rest are ``duplicate_call``; of
several results the first counts, and n_results tells how many there were. A
name in ``after`` that no call has is counted in n_missing and not waited for.

Null or empty text, text that is no JSON object, and ``tool_calls`` that are no
list make no call. Of equal keys in one object the last counts. Nesting may be of
any depth. A lone surrogate stays an escape in the JSON; an identifier that holds one, or is
no string, goes by its canonical JSON. A number whose exponent has more than 18 digits is no
JSON. A null conversation is a conversation like any other; a null turn sorts first. Columns
beside conv_id, turn and text are not read. Linking joins on (conversation, identifier);
ordering takes conversations of at most ``LOCAL_ROWS`` calls and edges in one pass each, larger
ones on edges in rounds, so that no task holds an unbounded conversation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import chunks
from .tables import stored

# Conversations of more calls and edges than this are ordered in rounds over all tasks.
LOCAL_ROWS = 200_000
SURROGATE = re.compile("[\ud800-\udfff]")
TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(")|(true|false|null))')

# A small registry; callers pass their own in the same form (a subset of JSON Schema).
TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False,
               "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}},
    "translate": {"type": "object", "required": ["text", "target"], "additionalProperties": False,
                  "properties": {"text": {"type": "string"}, "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}}},
    "measure": {"type": "object", "required": ["length"], "properties": {"length": {"type": "number"}, "exact": {"type": "boolean"}}},
}
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def number(text: str) -> int | Decimal:
    """A JSON number by value, every digit kept: whole numbers of up to 400 digits as int,
    others as exact decimals without trailing zeros."""
    mantissa, _, power = text.lower().partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    digits = (whole + part).lstrip("0")
    kept = digits.rstrip("0")
    if not kept:
        return 0
    exponent = int(power or 0) - len(part) + len(digits) - len(kept)
    if exponent >= 0 and len(kept) + exponent <= 400:
        return int(sign + kept) * 10 ** exponent
    return Decimal(f"{sign}{kept}E{exponent}")


def escaped(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def json_string(text: str) -> str:
    return escaped(json.dumps(text, ensure_ascii=False))


def canonical(value: object) -> str:
    """Canonical JSON, with a stack of its own: nesting is as deep as memory allows."""
    out, stack = [], [(False, value)]
    while stack:
        done, v = stack.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            out.append("{")
            stack.append((True, "}"))
            for i, k in reversed([*enumerate(sorted(v))]):
                stack += [(False, v[k]), (True, ("," if i else "") + json_string(k) + ":")]
        elif isinstance(v, list):
            out.append("[")
            stack.append((True, "]"))
            for i, x in reversed([*enumerate(v)]):
                stack += [(False, x), (True, "," if i else "")]
        else:
            out.append(json_string(v) if isinstance(v, str) else str(v) if isinstance(v, Decimal) else json.dumps(v))
    return "".join(out)


def no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parsed_deep(text: str) -> object:
    """What ``json.loads`` gives, for nesting beyond its recursion."""
    def token(at: int) -> tuple[re.Match, int]:
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON")
        return m, m.end()

    def member(at: int) -> tuple[str, int]:
        """A key and the place of its value."""
        m, at = token(at)
        if not m.group(3):
            raise ValueError("no key")
        key, at = scanstring(text, at, True)
        m, at = token(at)
        if m.group(1) != ":":
            raise ValueError("no colon")
        return key, at

    at, open_ = 0, []           # open containers, each with the key of the value to come (None in a list)
    while True:
        m, at = token(at)
        mark, value = m.group(1), None
        if mark in ("[", "{"):
            first, after = token(at)
            if first.group(1) == ("]" if mark == "[" else "}"):
                value, at = ([] if mark == "[" else {}), after
            elif mark == "[":
                open_.append([[], None])
                continue
            else:
                key, at = member(at)
                open_.append([{}, key])
                continue
        elif mark:
            raise ValueError("no value")
        elif m.group(2):
            value = number(m.group(2))
        elif m.group(3):
            value, at = scanstring(text, at, True)
        else:
            value = {"true": True, "false": False, "null": None}[m.group(4)]
        while open_:            # the value is whole: store it, close what ends here
            held, key = open_[-1]
            if key is None:
                held.append(value)
            else:
                held[key] = value
            m, at = token(at)
            if m.group(1) == ",":
                if key is not None:
                    open_[-1][1], at = member(at)
                break
            if m.group(1) != ("]" if key is None else "}"):
                raise ValueError("not closed")
            value = open_.pop()[0]
        else:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("text after the value")
            return value


def parsed(text: str | None) -> object:
    try:
        try:
            return json.loads(text or "", parse_float=number, parse_int=number, parse_constant=no_constant)
        except RecursionError:
            return parsed_deep(text)
    except (ValueError, ArithmeticError):
        return None


def problem(value: object, schema: dict, where: str = "$") -> str | None:
    """The first violation of the schema, or None."""
    kind = schema.get("type")
    if kind == "integer":
        ok = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, Decimal) and value.as_tuple().exponent >= 0
    elif kind == "number":
        ok = isinstance(value, (int, Decimal)) and not isinstance(value, bool)
    else:
        ok = kind is None or isinstance(value, TYPES[kind])
    if not ok:
        return f"{where}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{where}: not an allowed value"
    if "minimum" in schema and value < schema["minimum"]:
        return f"{where}: below the minimum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{where}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{where}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{where}.{name}: not expected"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := problem(x, schema["items"], f"{where}[{i}]"):
                return found
    return None


def entries(text: str | None, tools: dict) -> list[tuple]:
    """(kind, place, call_id, name, arguments, problem, after, content, label) rows of one
    message; label: identifier and name as JSON members."""
    o = parsed(text)
    if not isinstance(o, dict):
        return []
    rows = []
    if "tool_call_id" in o:
        i = o["tool_call_id"]
        rows.append(("result", 0, canonical_id(i), None, None, None, None, canonical(o.get("content")), f'"id":{json_id(i)}'))
    calls = o.get("tool_calls")
    for place, c in enumerate(calls if isinstance(calls, list) else ()):
        if not isinstance(c, dict):
            continue
        name, arguments = c.get("name"), c.get("arguments", {})
        if isinstance(arguments, str):          # arguments may come as a JSON string
            inner = parsed(arguments)
            arguments = arguments if inner is None else inner
        after = c.get("after")
        after = sorted({canonical_id(x) for x in after}) if isinstance(after, list) else []
        known = isinstance(name, str)
        wrong = "unknown tool" if not known or name not in tools else problem(arguments, tools[name])
        label = f'"id":{json_id(c.get("id"))}' + (f',"name":{json_string(name)}' if known else "")
        rows.append(("call", place, canonical_id(c.get("id")), escaped(name) if known else None, canonical(arguments),
                     None if wrong is None else escaped(wrong), after, None, label))
    return rows


def canonical_id(x: object) -> str:
    return x if isinstance(x, str) and not SURROGATE.search(x) else canonical(x)


def json_id(x: object) -> str:
    return json_string(x if isinstance(x, str) else canonical(x))


ENTRY = ("conv_id long, turn long, kind string, place int, call_id string, name string, arguments string, "
         "problem string, after array<string>, content string, label string")


def tool_entries(messages: DataFrame, tools: dict) -> DataFrame:
    """Calls and results of all messages (conv_id, turn, text)."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string()]
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            rows = [(c, t, *e) for c, t, x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "text"))) for e in entries(x, tools)]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types)], names=names)
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    return m.mapInArrow(run, ENTRY)


def longest_waits(rows: list[tuple]) -> dict[str, int]:
    """Level of each call of one conversation from (call_id, needs or None) rows."""
    waits = {c: 0 for c, _ in rows}
    waiters: dict[str, list[str]] = {}
    for c, needs in rows:
        if needs is not None:
            waits[c] += 1
            waiters.setdefault(needs, []).append(c)
    level = {c: 0 for c, n in waits.items() if n == 0}
    ready = list(level)
    highest: dict[str, int] = {}
    for c in ready:                     # grows while it is read
        for w in waiters.get(c, ()):
            waits[w] -= 1
            highest[w] = max(highest.get(w, 0), level[c] + 1)
            if waits[w] == 0:
                level[w] = highest[w]
                ready.append(w)
    return level


def call_levels(edges: DataFrame, calls: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(conv_id, call_id, level): conversations of at most ``local_rows`` calls and edges are
    ordered in one pass each, many to a task; larger ones in rounds over all tasks."""
    rows = calls.select("conv_id", "call_id", F.lit(None).cast("string").alias("needs")).unionByName(edges.select("conv_id", "call_id", "needs"))
    rows = stored(rows, "call-rows")
    large = stored(rows.groupBy("conv_id").count().where(F.col("count") > local_rows).select(F.col("conv_id").alias("large_id")), "large-conversations")
    of_large = F.col("conv_id").eqNullSafe(F.col("large_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv, held):
            level = longest_waits(held)
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(level), pa.int64()), pa.array(list(level), pa.string()),
                                               pa.array(list(level.values()), pa.int64())], names=["conv_id", "call_id", "level"])
        conv, held = None, []
        for b in batches:
            for c, *row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "call_id", "needs"))):
                if held and c != conv:
                    yield out(conv, held)
                    held = []
                conv = c
                held.append(tuple(row))
        if held:
            yield out(conv, held)

    some_large = large.limit(1).count() > 0
    small = rows.join(large, of_large, "left_anti") if some_large else rows
    done = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, "conv_id long, call_id string, level long")
    if some_large:
        done = done.unionByName(levels(edges.join(large, of_large, "left_semi"), calls.join(large, of_large, "left_semi")))
    return done


def levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls (conv_id, call_id) by rounds over the edges
    (conv_id, call_id, needs); a call in or behind a cycle gets no row."""
    on = lambda a, b, pairs: [a[x].eqNullSafe(b[y]) for x, y in pairs]
    key = [("conv_id", "conv_id"), ("call_id", "call_id")]
    done = None
    left, open_edges, level = calls, edges, 0
    while left.limit(1).count():
        free = left.join(open_edges, on(left, open_edges, key), "left_anti")
        free = stored(free.withColumn("level", F.lit(level).cast("long")), "level")
        if not free.limit(1).count():
            break
        done = free if done is None else done.unionByName(free)
        left = stored(left.join(free, on(left, free, key), "left_anti"), "left")
        open_edges = stored(open_edges.join(free, on(open_edges, free, [("conv_id", "conv_id"), ("needs", "call_id")]), "left_anti"), "edges")
        level += 1
    return calls.withColumn("level", F.lit(0).cast("long")).limit(0) if done is None else done


def link_calls(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row per call and per result without call: conv_id, level, turn, place, call_id,
    name, status, problem, n_results, n_missing, json. Order: level, turn, place."""
    e = stored(tool_entries(messages, TOOLS if tools is None else tools), "tool-entries")
    key = ["conv_id", "call_id"]

    def same(a: str, b: str):
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key]

    calls = e.where("kind = 'call'")
    spot = F.struct(F.col("turn").alias("turn"), F.col("place").alias("place"), F.xxhash64("arguments", "name").alias("h"))
    first = calls.groupBy(*key).agg(F.min(spot).alias("first"))
    calls = calls.alias("c").join(first.alias("f"), same("c", "f")).select("c.*", (spot_of("c") == F.col("f.first")).alias("is_first"))
    results = e.where("kind = 'result'").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    linked = calls.alias("c").join(results.alias("r"), same("c", "r"), "left").select("c.*", F.col("r.r.content").alias("result"), "r.n_results")
    orphans = e.where("kind = 'result'").alias("r").join(first.alias("f"), same("r", "f"), "left_anti").select("r.*")

    known = stored(first.select(*key), "call-ids")
    wanted = calls.where("is_first").select(*key, F.explode("after").alias("needs")).distinct()
    present = [F.col("w.conv_id").eqNullSafe(F.col("k.conv_id")), F.col("w.needs").eqNullSafe(F.col("k.call_id"))]
    edges = stored(wanted.alias("w").join(known.alias("k"), present, "left_semi"), "tool-edges")
    missing = wanted.alias("w").join(known.alias("k"), present, "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("n_missing"))
    level = call_levels(edges, known)

    out = (linked.alias("c").join(level.alias("l"), same("c", "l"), "left").select("c.*", "l.level").alias("c")
           .join(missing.alias("m"), same("c", "m"), "left").select("c.*", "m.n_missing"))
    status = (F.when(~F.col("is_first"), "duplicate_call").when(F.col("problem") == "unknown tool", "unknown_tool")
              .when(F.col("problem").isNotNull(), "invalid_arguments").when(F.col("level").isNull(), "cycle")
              .when(F.col("n_results").isNull(), "no_result").otherwise("ok"))
    zero = F.lit(0).cast("long")
    rows = out.select("conv_id", "level", "turn", "place", "call_id", "name", status.alias("status"), "problem",
                      F.coalesce("n_results", zero).alias("n_results"), F.coalesce("n_missing", zero).alias("n_missing"), "arguments", "result", "label")
    lost = orphans.select("conv_id", F.lit(None).cast("long").alias("level"), "turn", "place", "call_id", "name", F.lit("orphan_result").alias("status"),
                          "problem", F.lit(1).cast("long").alias("n_results"), zero.alias("n_missing"), "arguments", F.col("content").alias("result"), "label")
    whole = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"arguments":'), "arguments", F.lit(",")), F.lit("")), F.col("label"),
                     F.coalesce(F.concat(F.lit(',"result":'), "result"), F.lit("")), F.lit("}"))
    return rows.unionByName(lost).withColumn("json", whole).drop("arguments", "result", "label")


def spot_of(alias: str):
    return F.struct(F.col(f"{alias}.turn").alias("turn"), F.col(f"{alias}.place").alias("place"),
                    F.xxhash64(F.col(f"{alias}.arguments"), F.col(f"{alias}.name")).alias("h"))


def derived_messages(conversations: DataFrame) -> DataFrame:
    """Tool messages made from plain conversations, one per turn: a user turn asks a tool
    (by turn and id), waiting for the call halfway back in the same conversation; an
    assistant turn is the result of the turn before it."""
    turn, n = F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    name = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("measure"), F.lit("guess")),
                        (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(16)) / 5 + 1).cast("int"))
    target = F.when(F.pmod(n, F.lit(7)) == 0, "xx").otherwise("de")
    arguments = (F.when(name == "search", F.to_json(F.struct("text", n.alias("limit")), {"ignoreNullFields": "true"}))
                 .when(name == "translate", F.to_json(F.struct("text", target.alias("target")))).otherwise(F.to_json(F.struct(n.alias("length")))))
    arguments = F.when(name == "search", F.regexp_replace(arguments, r'^\{"text"', '{"query"')).otherwise(arguments)
    back = turn % 2 + 2 * F.floor((F.floor(turn / 2) - 1) / 2)
    after = F.when(turn >= 2, F.array(F.concat(F.lit("c"), back.cast("string")))).otherwise(F.array().cast("array<string>"))
    call = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("id"), name.alias("name"),
                                               arguments.alias("arguments"), after.alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.select("conv_id", "turn", F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result)
                                .otherwise(F.col("text")).alias("text"))
