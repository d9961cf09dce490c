"""Reading loosely shaped recognition entries out of Variant values.

The functions write SQL expressions (text in, text out), parsed once where they
are used; nothing here recurses. A value is "given" when it is present and not
empty: null, false, 0, "", [] and {} are passed over, so the next key of a list
is tried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key lists, in the order they are tried.
CONTAINER_KEYS = ("result", "results", "res", "data", "records", "predictions", "pages", "items", "elements")
BOX_KEYS = ("bbox", "box", "points", "polygon", "poly", "position")
INNER_BOX_KEYS = ("bbox", "box", "points", "polygon", "poly")
TEXT_KEYS = ("text", "value", "content", "label", "transcription")
SCORE_KEYS = ("score", "confidence", "prob", "probability")
INNER_SCORE_KEYS = ("text", "confidence", "prob", "probability")
PATH = re.compile(r"try_variant_get\(([\w.]+), '\$([^']*)', 'variant'\)")
# Kinds of a value, as ``kind`` tells them.
LIST, OBJECT, STRING, NULL, TRUTH, NUMBERS = "AR", "OB", "ST", "VO", "BO", ("BI", "DE", "DO", "FL")


def get(v: str, path: str, kind: str = "variant") -> str:
    """What ``v`` holds at ``path``; paths into paths are written as one, so expressions stay short."""
    inner = PATH.fullmatch(v)
    base, start = inner.groups() if inner else (v, "")
    return f"try_variant_get({base}, '${start}{path}', '{kind}')"


def member(v: str, *keys: str) -> str:
    return get(v, "".join(f".{k}" for k in keys))


def item(v: str, i: int) -> str:
    return get(v, f"[{i}]")


def is_object(v: str) -> str:
    """A cast to a struct looks up its fields only, however large the object is."""
    return f"({get(v, '', 'struct<line:variant>')} IS NOT NULL)"


def is_list(v: str) -> str:
    """A list with elements. A path that leads nowhere is an exception inside Spark and costs microseconds;
    this cast looks at the kind of each element only."""
    return f"coalesce(size({get(v, '', 'array<struct<_:int>>')}) > 0, false)"


def is_container(v: str) -> str:
    """An object or a list with elements."""
    return f"({is_object(v)} OR {is_list(v)})"


def kind(v: str) -> str:
    """Two letters for the kind of a value; containers are not read below their elements."""
    return f"CASE WHEN {is_object(v)} THEN '{OBJECT}' WHEN {is_list(v)} THEN '{LIST}' ELSE substring(schema_of_variant({v}), 1, 2) END"


def is_number(v: str) -> str:
    return f"coalesce({kind(v)} IN {NUMBERS}, false)"


def is_string(v: str) -> str:
    return f"coalesce({kind(v)} = '{STRING}', false)"


def is_given(v: str) -> str:
    """Null, false, zero, '', [] and {} are not given. Tests in turn: ``CASE kind WHEN`` would tell the kind anew for each branch."""
    return (f"CASE WHEN {is_list(v)} THEN true WHEN {is_object(v)} THEN size({get(v, '', 'map<string,variant>')}) > 0 "
            f"WHEN substring(schema_of_variant({v}), 1, 2) = '{STRING}' THEN {get(v, '', 'string')} <> '' "
            f"ELSE coalesce({get(v, '', 'double')} <> 0, {get(v, '', 'boolean')}) END")


FIELDS = tuple(dict.fromkeys((*BOX_KEYS, *TEXT_KEYS, *SCORE_KEYS, "line")))


def fields_of(v: str) -> str:
    """A struct with what an object holds under each known key; NULL where ``v`` is no object.
    One pass over its members instead of a search per key. Where ``v`` is of that form, say ``x.fields``,
    ``listed`` and what builds on it take it instead of a value."""
    return get(v, "", f"struct<{','.join(f'{k}:variant' for k in FIELDS)}>")


def listed(v: str, keys: tuple[str, ...]) -> str:
    named = (f"{v}.{k}" for k in keys) if v.endswith("fields") else (member(v, k) for k in keys)
    return f"array({', '.join(named)})"


def first_given(v: str, keys: tuple[str, ...]) -> str:
    return f"get(filter({listed(v, keys)}, m -> m IS NOT NULL AND coalesce({is_given('m')}, false)), 0)"


def any_given(v: str, keys: tuple[str, ...]) -> str:
    return f"exists({listed(v, keys)}, m -> m IS NOT NULL AND coalesce({is_given('m')}, false))"


def as_text(v: str) -> str:
    """Strings as they are, other values in JSON form."""
    return f"""CASE WHEN {is_string(v)} THEN {get(v, '', 'string')} ELSE to_json({v}) END"""


def has_box_and_text(v: str) -> str:
    return f"({any_given(v, BOX_KEYS)} AND {any_given(v, TEXT_KEYS)})"


def is_pair(v: str) -> str:
    """``[points, info, ...]``: points start with a number or a point, info holds a text."""
    point, info = item(item(v, 0), 0), item(v, 1)
    points = f"({is_number(point)} OR {is_number(item(point, 0))})"
    text = " OR ".join((is_string(info), is_string(item(info, 0)), f"{member(info, 'text')} IS NOT NULL", f"{member(info, 'value')} IS NOT NULL"))
    return f"({item(v, 1)} IS NOT NULL AND {points} AND ({text}))"


WRAPS = 4             # wrapping ``line`` objects that one expression looks through


def wrapped(v: str, times: int) -> str:
    return member(v, *["line"] * times)


def is_entry(v: str, of_kind: str, fields: str) -> str:
    """Whether the value is an entry or an object that wraps one in ``line``; ``of_kind``: its kind, ``fields``: its ``fields_of``.
    An object that wraps more than ``WRAPS`` times counts as one, and its innermost value decides."""
    lines = f"array({', '.join(wrapped(v, n) for n in range(1, WRAPS + 1))})"
    inner = f"exists({lines}, w -> w IS NOT NULL AND ({has_box_and_text('w')} OR {is_pair('w')}))"
    return (f"CASE {of_kind} WHEN '{LIST}' THEN {is_pair(v)} WHEN '{OBJECT}' THEN {has_box_and_text(fields)} OR "
            f"({fields}.line IS NOT NULL AND ({inner} OR {is_container(wrapped(v, WRAPS + 1))})) ELSE false END")


def parses(v: str) -> str:
    """Whether an entry has what makes it one: an object a box, a list a second part."""
    def usable(key: str) -> str:
        box = member(v, key)
        return f"WHEN {is_given(box)} THEN NOT {is_object(box)} OR {any_given(box, INNER_BOX_KEYS)}"
    return (f"coalesce(CASE WHEN {is_object(v)} THEN (CASE {' '.join(map(usable, BOX_KEYS[:2]))} ELSE false END) OR {any_given(v, BOX_KEYS[2:])} "
            f"ELSE {item(v, 1)} IS NOT NULL END, false)")


# ------------------------------------------------------------------ entry -> box, text, score
def once(**columns: str) -> Column:
    """A struct that is computed once per row: consecutive projections would be merged
    and each use of a column would evaluate it anew; a generator is not merged."""
    return F.expr("explode(array(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in columns.items()) + ")))")


def number_or_one(v: str) -> str:
    return f"coalesce(CASE WHEN {is_number(v)} THEN {get(v, '', 'double')} END, 1.0D)"


def info_fields(info: str) -> tuple[str, str]:
    """(text, score) of the info part of a pair: a list, an object or a string."""
    of_list = f"coalesce({as_text(item(info, 0))}, '')"
    named = first_given(info, ("text", "value"))
    raw = f"coalesce(CASE WHEN {kind(member(info, 'score'))} <> '{NULL}' THEN {member(info, 'score')} END, {member(info, 'confidence')})"
    listed_parts, named_parts = is_list(info), is_object(info)
    text = (f"CASE WHEN {listed_parts} THEN {of_list} WHEN {named_parts} THEN coalesce({as_text(named)}, '') "
            f"ELSE coalesce(CASE WHEN {is_string(info)} THEN try_variant_get({info}, '$', 'string') END, '') END")
    score = f"CASE WHEN {listed_parts} THEN {number_or_one(item(info, 1))} WHEN {named_parts} THEN {number_or_one(raw)} ELSE 1.0D END"
    return text, score


def with_fields(rows: DataFrame) -> DataFrame:
    """Adds ``fields``: text, score and box of the entry ``v``; text is NULL where it is none."""
    rows = rows.withColumn("fields", once(fields=fields_of("v"))).withColumn("fields", F.col("fields.fields"))
    rows = rows.withColumn("g", once(is_object="fields IS NOT NULL", **{n: f"CASE WHEN fields IS NULL THEN {item('v', i)} END" for i, n in enumerate(("points", "info", "more"))},
                                     box=first_given("fields", BOX_KEYS[:2]), other=first_given("fields", BOX_KEYS[2:]),
                                     score=first_given("fields", SCORE_KEYS), text=first_given("fields", TEXT_KEYS)))
    (text1, score1), (text2, score2) = info_fields("g.info"), info_fields("g.more")
    box = f"CASE WHEN {is_object('g.box')} THEN {first_given('g.box', INNER_BOX_KEYS)} ELSE g.box END"
    score = f"CASE WHEN {is_object('g.score')} THEN {first_given('g.score', INNER_SCORE_KEYS)} ELSE g.score END"
    either = lambda a, b: f"CASE WHEN g.is_object THEN {a} ELSE {b} END"
    rows = rows.withColumn("h", once(box=either(f"coalesce({box}, g.other)", "g.points"), score=either(score, "NULL"),
                                     text=either(f"coalesce({as_text('g.text')}, '')", text1), pair_score=either("NULL", score1),
                                     text2=either("''", text2), score2=either("1.0D", score2)))
    number = number_or_one(f"CASE WHEN {is_list('h.score')} THEN try_variant_get(h.score, '$[0]', 'variant') ELSE h.score END")
    second = "(h.text = '' AND h.text2 <> '')"
    fields = (f"named_struct('text', CASE WHEN {second} THEN h.text2 ELSE h.text END, "
              f"'score', CASE WHEN {second} THEN h.score2 WHEN g.is_object THEN {number} ELSE h.pair_score END, 'bbox', {flat_box('h.box')})")
    known = "CASE WHEN g.is_object THEN h.box IS NOT NULL ELSE g.info IS NOT NULL END"
    return rows.withColumn("fields", F.expr(f"CASE WHEN {known} THEN {fields} END")).drop("g", "h")


def flat_box(box: str) -> str:
    """Numbers of a list of points (or of numbers), in order; NULL where a part is no number."""
    part = "CASE WHEN try_variant_get(p, '$', 'array<variant>') IS NOT NULL THEN try_variant_get(p, '$', 'array<double>') ELSE array(try_variant_get(p, '$', 'double')) END"
    numbers = f"flatten(transform(try_variant_get({box}, '$', 'array<variant>'), p -> {part}))"      # NULL where a part is NULL
    return f"CASE WHEN NOT exists({numbers}, x -> x IS NULL) THEN {numbers} END"
