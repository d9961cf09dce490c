"""Raw recognition payloads (JSON) -> line records -> page text.

Payloads are Variant values and the walk is a walk of rows: a row is a value
with its path and a tag of its kind. ``FUSED`` nesting levels are one narrow plan:
a container is exploded into its members, an entry passes through. What is left
open is written below the shared folder and goes on, so plans stay small however
deep a payload is. A payload that is no JSON, or that nests below ``max_levels``,
comes out as a reject row with its reason and gives no lines.

One walk serves both readings of a payload. Page walk (N1): an array whose first
element is an entry is a page, its elements are the lines; other elements that
are entries are pages of one line; of an object the container keys with a
non-empty list are followed, in priority order. Fallback (N5), only for payloads
without a surviving page line: every value is followed, each entry is a block of
its own, in order of depth and path. A row knows whether the page walk reaches
it (``on_pages``), with its place there (``page``, ``pos``) and among all values
(``path``). Objects are walked in Variant order, that is by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as vr
from ..session import new_table_path

MAX_LEVELS = 64
FUSED = 6             # nesting levels of one plan
INVALID, TOO_DEEP = "invalid payload", "nesting too deep"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_payloads(df: DataFrame, key: str = "doc_id", payload: str = "j") -> DataFrame:
    """The Variant form of each payload (NULL when it does not parse)."""
    return df.select(F.col(key).alias("key"), F.try_parse_json(F.col(payload)).alias("v"))


def top_kind(v: str = "v") -> Column:
    return F.expr(f"CASE WHEN {v} IS NULL THEN 'invalid' ELSE CASE {vr.kind(v)} WHEN '{vr.LIST}' THEN 'array' WHEN '{vr.OBJECT}' THEN 'object' ELSE 'scalar' END END")


# ------------------------------------------------------------------ walking
CONTAINERS = "array(" + ", ".join(f"'{k}'" for k in vr.CONTAINER_KEYS) + ")"


def looked_at(values: str) -> str:
    """An array of (n, name, child) with the kind of each child and whether it is an entry."""
    known = f"transform({values}, x -> named_struct('n', x.n, 'name', x.name, 'child', x.child, 'kind', {vr.kind('x.child')}, 'fields', {vr.fields_of('x.child')}))"
    return (f"transform({known}, x -> named_struct('n', x.n, 'name', x.name, 'child', x.child, 'kind', x.kind, "
            f"'entry', coalesce({vr.is_entry('x.child', 'x.kind', 'x.fields')}, false)))")


def expanded(rows: DataFrame) -> DataFrame:
    """One nesting level further: open values give way to their members, found ones
    stay. A page line that is no entry stays as a line, and its members are followed for the fallback only. Values
    that are neither found nor a container have no members and are gone after the next level."""
    itself = "named_struct('n', CAST(NULL AS INT), 'name', CAST(NULL AS STRING), 'child', v, 'kind', kind, 'entry', false)"
    of_list = "transform(try_variant_get(v, '$', 'array<variant>'), (x, i) -> named_struct('n', i, 'name', CAST(NULL AS STRING), 'child', x))"
    of_object = "transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), (x, i) -> named_struct('n', i, 'name', x.key, 'child', x.value))"
    members = looked_at(f"CASE WHEN found THEN NULL WHEN kind = '{vr.LIST}' THEN {of_list} ELSE {of_object} END")
    step = f"CASE WHEN found THEN array({itself}) WHEN line THEN concat(array({itself}), coalesce(members, array())) ELSE members END"
    is_list = f"outer_kind = '{vr.LIST}'"
    followed = f"array_position({CONTAINERS}, name) - 1"
    on_pages = f"coalesce(on_pages AND NOT line AND ({is_list} OR ({followed} >= 0 AND {vr.is_list('child')})), false)"
    return rows.sparkSession.sql(f"""
      SELECT key, IF(n IS NULL, path, array_append(path, n)) AS path,
        CASE WHEN n IS NULL OR ({is_list} AND page_list) THEN page WHEN {is_list} THEN array_append(page, n)
          WHEN {followed} >= 0 THEN array_append(page, CAST({followed} AS INT)) ELSE page END AS page,
        CASE WHEN n IS NULL THEN pos WHEN {is_list} AND page_list THEN n ELSE 0 END AS pos,
        IF(n IS NULL, on_pages, {on_pages}) AS on_pages, IF(n IS NULL, line, {on_pages} AND {is_list} AND page_list) AS line,
        n IS NULL OR entry OR ({on_pages} AND {is_list} AND page_list AND NOT {vr.is_container('child')}) AS found,
        IF(n IS NULL, any, entry) AS any, kind, child AS v
      FROM (SELECT key, path, page, pos, on_pages, line, any, kind AS outer_kind, coalesce(members[0].entry, false) AS page_list, inline({step})
        FROM (SELECT r.*, m.members FROM {{rows}} r LATERAL VIEW explode(array(named_struct('members', {members}))) AS m))""", rows=rows)


def walk(roots: DataFrame, max_levels: int) -> tuple[DataFrame, DataFrame | None]:
    """(found rows with what ``line_values`` reads of them; key and on_pages of what nests
    too deep, None if nothing does) of the payloads (key, v)."""
    root = looked_at("array(named_struct('n', 0, 'name', '', 'child', v))")
    none = "CAST(array() AS array<int>)"
    rows = roots.selectExpr("key", f"inline({root})").selectExpr(
        "key", f"{none} AS path", f"{none} AS page", "0 AS pos", "true AS on_pages", "false AS line", "entry AS found", "entry AS any", "kind", "child AS v")
    found, left = [], max_levels - 1
    while True:
        for _ in range(min(FUSED, left)):
            rows = expanded(rows)
        left -= min(FUSED, left)
        rows = rows.selectExpr("*", f"(NOT found AND {vr.is_container('v')}) AS open").where("found OR open")
        level = stored(line_values(rows, "open OR more"), "walk")
        rest = level.where("open")
        found.append(level.where("found" if left else "found OR line"))
        whole = rest.isEmpty()
        if not left or whole:
            break
        rows = rest.select("key", "path", "page", "pos", "on_pages", "line", "found", "any", "kind", "v")
    deep = None if whole else rest.select("key", "on_pages").distinct()
    return reduce(DataFrame.unionByName, found), deep


# ------------------------------------------------------------------ entries
def line_values(entries: DataFrame, kept: str = "more") -> DataFrame:
    """Adds ``text, score, bbox`` of the value ``v`` where it is found; text is NULL where it is no entry.

    An object may wrap the entry in ``line``, any number of times: the innermost
    value that parses counts. ``more``: it is wrapped deeper than one plan looks.
    ``v`` stays only where the condition ``kept`` holds."""
    wraps = [vr.wrapped("v", n) for n in range(1, vr.WRAPS + 2)]
    inmost = f"get(filter(array({', '.join(reversed(wraps[:-1]))}), w -> {vr.is_container('w')} AND {vr.parses('w')}), 0)"
    wrapping = "found AND try_variant_get(v, '$', 'struct<line:variant>').line IS NOT NULL"
    plain = [c for c in entries.columns if c != "v"]
    picked = entries.select(*plain, F.col("v").alias("whole"),
                            vr.once(v=f"CASE WHEN {wrapping} THEN coalesce({inmost}, v) WHEN found THEN v END",
                                    more=f"coalesce({wrapping} AND {vr.is_container(wraps[-1])}, false)").alias("w"))
    lines = vr.with_fields(picked.select(*plain, "whole", "w.v", "w.more"))
    return lines.select(*plain, "more", F.expr(f"CASE WHEN {kept} THEN whole END").alias("v"), "fields.*")


def unwrapped(found: DataFrame) -> DataFrame:
    """Found rows whose entries are wrapped deeper than one plan looks, with the values of the innermost that parses."""
    deeper = found.where("more")
    if deeper.isEmpty():
        return found
    below = deeper.select("key", "path", "on_pages", "found", F.expr(vr.wrapped("v", vr.WRAPS + 1)).alias("v"))
    below = unwrapped(stored(line_values(below), "line-values")).where("text IS NOT NULL")
    joined = found.join(below.select("key", "path", "on_pages", F.struct("text", "score", "bbox").alias("r")), ["key", "path", "on_pages"], "left")
    values = ("text", "score", "bbox")
    return joined.select(*[c for c in found.columns if c not in values],
                         *[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in values])


def survives(min_confidence: float) -> Column:
    return F.col("text").isNotNull() & (F.col("score") >= F.lit(min_confidence)) & (F.col("text") != "")


class Walked:
    """The walked payloads: ``page_lines`` (N1-N3), ``fallback_lines`` (N5, only of payloads
    without a surviving page line) and ``rejects`` (key, reason)."""

    def __init__(self, payloads: DataFrame, key: str = "doc_id", min_confidence: float = 0.3, max_levels: int = MAX_LEVELS):
        self.key, self.min_confidence = key, min_confidence
        roots = stored(parse_payloads(payloads, key), "payloads")
        self.keys = roots.select(F.col("key").alias(key))
        valid = roots.where(F.col("v").isNotNull())
        found, deep = walk(valid, max_levels)
        lines = unwrapped(found)
        pages = lines.where("on_pages").select("key", "page", "pos", "text", "score", "bbox")
        if deep is not None:
            deep = stored(deep, "too-deep")
            pages = pages.join(deep.where("on_pages").select("key"), "key", "left_anti")
        paged = pages.where(survives(min_confidence)).select("key").distinct()
        fallback = lines.where("any AND text IS NOT NULL").join(paged, "key", "left_anti")
        bad = roots.where(F.col("v").isNull()).select("key", F.lit(INVALID).alias("reason"))
        if deep is not None:
            fallback = fallback.join(deep.select("key"), "key", "left_anti")
            too_deep = deep.where("on_pages").select("key").unionByName(deep.where("NOT on_pages").select("key").join(paged, "key", "left_anti"))
            bad = bad.unionByName(too_deep.distinct().select("key", F.lit(TOO_DEEP).alias("reason")))
        self.fallback_lines = fallback.select(F.col("key").alias(key), F.col("path").alias("page"), F.lit(0).alias("pos"), "text", "score", "bbox")
        self.rejects = bad.withColumnRenamed("key", key)
        self.page_lines = pages.withColumnRenamed("key", key)

    def lines(self) -> DataFrame:
        """N4 + F1: ``key, block_id, line_id, text, confidence, bbox, mode``.

        Pages are numbered before the confidence filter, lines after it. Both
        windows share one exchange and one sort (payload, page, pos); a payload's
        lines come from one input row, so a partition is bounded by it."""
        key, ok = self.key, survives(self.min_confidence)
        in_page = Window.partitionBy(key, "page").orderBy("pos")
        rows = self.page_lines.withColumn("ok", ok)
        rows = rows.withColumn("line_id", F.sum(F.col("ok").cast("int")).over(in_page.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        rows = rows.withColumn("block_id", F.dense_rank().over(Window.partitionBy(key).orderBy("page")) - 1)
        shape = lambda df, mode: df.select(
            key, F.col("block_id").cast("int").alias("block_id"), F.col("line_id").cast("int").alias("line_id"), "text",
            F.col("score").alias("confidence"), F.coalesce("bbox", F.array().cast("array<double>")).alias("bbox"), F.lit(mode).alias("mode"))
        breadth = Window.partitionBy(key).orderBy(F.size("page"), "page", "pos")
        other = self.fallback_lines.where(ok).withColumns({"block_id": F.row_number().over(breadth) - 1, "line_id": F.lit(0)})
        return shape(rows.where("ok"), "pages").unionByName(shape(other, "fallback"))

    def documents(self) -> DataFrame:
        """One row per payload: ``key, text, blocks, reject``. A payload without
        lines has the text '' and no blocks; ``reject`` tells why, if it was rejected."""
        key = self.key
        done = assemble_text(self.lines(), key)
        out = self.keys.join(done, key, "left").join(self.rejects.select(key, F.col("reason").alias("reject")), key, "left")
        return out.select(key, F.coalesce("text", F.lit("")).alias("text"),
                          F.coalesce("blocks", F.array().cast(done.schema["blocks"].dataType)).alias("blocks"), "reject")


def extract_lines(payloads: DataFrame, key: str = "doc_id", min_confidence: float = 0.3) -> DataFrame:
    """N1-N5 + F1: payloads ``(key, j)`` -> numbered lines."""
    return Walked(payloads, key, min_confidence).lines().drop("mode")


def assemble_text(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, line texts joined by newline in (block, line) order,
    plus the ordered block array of the response."""
    blk = F.struct(F.col("block_id"), F.col("line_id"), F.col("bbox"), F.col("text"), F.col("confidence"))
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(blk)).alias("b"))
    return g.select(
        key,
        F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"),
        F.transform("b", lambda x: F.struct(
            x["bbox"].alias("bbox"), x["text"].alias("text"), x["confidence"].alias("confidence"),
            x["block_id"].alias("block_id"), x["line_id"].alias("line_id"))).alias("blocks"))
