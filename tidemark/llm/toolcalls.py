"""Chat formatting: tool calls joined to their results, ordered, validated and serialised."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, store, table
from tidemark.operators.walks import walk

#: Calls of a conversation that one task orders at once; longer conversations are ordered round by round.
MOST_CALLS = 20_000

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


class SchemaError(ValueError):
    """A schema that can't be applied."""


def same(a, b) -> bool:
    """JSON equality: true isn't 1, but 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def _bound(schema: dict, name: str, default: float) -> float:
    value = schema.get(name, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise SchemaError(name)
    return value


def _of(schema: dict, name: str, kind: type, default):
    value = schema.get(name, default)
    if not isinstance(value, kind):
        raise SchemaError(name)
    return value


def check_schema(value, schema, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``, in the order found; of JSON Schema: true, false, type, enum, const, required, properties, additionalProperties, items, bounds, lengths and pattern.

    A schema that isn't one (no object, an unknown type, a bound that is no
    number, a broken pattern) raises SchemaError.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        raise SchemaError("no object")
    found = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if not isinstance(kinds, list) or any(not isinstance(k, str) or k not in _TYPES for k in kinds):
        raise SchemaError("type")
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if not any(same(value, x) for x in _of(schema, "enum", list, [value])):
        found.append(f"{at}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        found.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known, rest = _of(schema, "properties", dict, {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in _of(schema, "required", list, []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += check_schema(value[k], known[k], f"{at}.{k}")
            elif rest is False:
                found.append(f"{at}.{k}: unexpected")
            else:
                found += check_schema(value[k], rest, f"{at}.{k}")
    elif isinstance(value, list):
        items = schema.get("items", True)
        for i, v in enumerate(value):
            found += check_schema(v, items, f"{at}[{i}]")
        if not _bound(schema, "minItems", 0) <= len(value) <= _bound(schema, "maxItems", math.inf):
            found.append(f"{at}: number of items")
    elif isinstance(value, str):
        if not _bound(schema, "minLength", 0) <= len(value) <= _bound(schema, "maxLength", math.inf):
            found.append(f"{at}: length")
        if "pattern" in schema:
            try:
                fits = re.search(_of(schema, "pattern", str, ""), value)
            except re.error as e:
                raise SchemaError("pattern") from e
            if not fits:
                found.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not _bound(schema, "minimum", -math.inf) <= value <= _bound(schema, "maximum", math.inf):
            found.append(f"{at}: out of bounds")
    return found


def _plain(value):
    """Integral floats as integers, so that equal numbers are spelt alike; NaN and infinities are refused."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _sound(text: str) -> str:
    """Half surrogate pairs, which no UTF-8 text can hold, as the escapes that they came from."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no needless escapes."""
    return _sound(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


@lru_cache(4096)
def _schema(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError) as e:
        raise SchemaError("not JSON") from e


def _judged(arguments: str | None, schema: str | None) -> tuple[object, list[str]]:
    """The arguments as a value, or None with the reason why they have none; and what is wrong with them."""
    try:
        value = _plain(json.loads(arguments))
        canonical(value)
    except (TypeError, ValueError, RecursionError):
        return None, ["$: not JSON"]
    if schema is None:
        return value, ["unknown tool"]
    try:
        return value, check_schema(value, _schema(schema))
    except (SchemaError, RecursionError):
        return value, ["schema: not usable"]


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds errors and canonical JSON to batches of linked calls."""
    for batch in batches:
        errors, texts = [], []
        for call_id, name, arguments, schema, content, status in zip(*(batch.column(x).to_pylist() for x in ("call_id", "name", "arguments", "schema", "content", "status")), strict=True):
            value, wrong = (None, []) if status == "orphan_result" else _judged(arguments, schema)
            errors.append(_sound("; ".join(wrong)) or None)
            texts.append(canonical({"id": call_id, "name": name, "arguments": arguments if wrong == ["$: not JSON"] else value, "result": content}))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("conv_id", "call_id", "turn", "level", "status")), pa.array(errors, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "call_id", "turn", "level", "status", "errors", "json"])


def _ordered(key: tuple, calls: Iterator[tuple]) -> Iterator[tuple]:
    """The levels of one conversation's calls, each with the calls that it refers to."""
    refs = {call: [r for r in found or [] if r is not None] for call, found in calls}
    users: dict = {call: [] for call in refs}
    need = dict.fromkeys(refs, 0)
    for call, found in refs.items():
        for r in set(found):
            if r in refs:
                users[r].append(call)
                need[call] += 1
    level: dict = {call: 0 for call, n in need.items() if n == 0}
    front = list(level)
    while front:
        call = front.pop()
        for user in users[call]:
            need[user] -= 1
            level[user] = max(level.get(user, 0), level[call] + 1)
            if need[user] == 0:
                front.append(user)
    for call, n in need.items():
        yield (*key, call, level[call] if n == 0 else None)


def levels(calls: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of references below each call; null in and behind cycles. calls: conv_id, call_id, refs.

    A conversation of up to ``most`` calls is ordered by one task, which reads
    its sorted rows as a stream and holds one conversation. Longer ones go round by round.
    """
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = store(sizes.where(F.col("n") > most).select("conv_id"), "long")
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    few = calls.join(long, "conv_id", "left_anti")
    short = walk(few, by=["conv_id"], order=[], take=["call_id", "refs"], visit=_ordered, schema=f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level int")
    if long.isEmpty():
        return short
    many = calls.join(long, "conv_id", "left_semi")
    return short.unionByName(levels_by_rounds(many, many.select("conv_id", "call_id", F.explode("refs").alias("ref")).where("ref IS NOT NULL")))


def levels_by_rounds(calls: DataFrame, references: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of references below each call; null in and behind cycles.

    Round by round: a call is placed once all that it refers to are. Each round
    joins the references with the calls placed last, so no conversation is ever
    gathered in one task, however long it is; rounds are as many as the longest chain.
    """
    key = ["conv_id", "call_id"]
    edges = store(references.select(*key, "ref").distinct().join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]), "refs")
    needs = edges.groupBy(*key).agg(F.count("*").alias("need"))
    waiting = store(needs.withColumns({"have": F.lit(0).cast("bigint"), "level": F.lit(0)}), "waiting")
    front = calls.join(needs, key, "left_anti").select(*key, F.lit(0).alias("level"))
    front = store(front, "placed")
    placed = [front]
    while True:
        hits = edges.join(front.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below")), ["conv_id", "ref"])
        hits = hits.groupBy(*key).agg(F.count("*").alias("n"), F.max("below").alias("below"))
        grown = waiting.join(hits, key, "left").select(*key, "need", (F.col("have") + F.coalesce("n", F.lit(0))).alias("have"), F.greatest("level", F.coalesce(F.col("below") + 1, F.lit(0))).alias("level"))
        grown = store(grown, "waiting")
        front = store(grown.where("have = need").select(*key, "level"), "placed")
        if front.isEmpty():
            break
        placed.append(front)
        release(waiting)
        waiting = store(grown.where("have < need"), "waiting")
        release(grown)
    done = placed[0]
    for more in placed[1:]:
        done = done.unionByName(more)
    return done.unionByName(waiting.select(*key, F.lit(None).cast("int").alias("level")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or orphaned result: conv_id, call_id, turn, level, status, errors, json.

    calls: conv_id, call_id, turn, name, arguments (JSON text), refs (array of
    call_ids whose results it uses); results: conv_id, call_id, turn, content;
    schemas: name, schema (JSON Schema text). More columns are ignored.

    Calls join their results by identifier within the conversation. status:
    linked, no_result (none at or after the call's turn) or orphan_result (no
    such call, or only before it); level orders calls topologically: sorting by
    (level, turn, call_id) puts each after all it refers to; null marks cycles.
    errors lists what of the arguments breaks the tool's schema, null if
    nothing: "$: not JSON" where arguments are null, broken or nested too deep,
    "unknown tool" without a schema, "schema: not usable" where the schema itself is at
    fault. json is canonical: sorted keys, no spaces, plain numbers; half surrogate
    pairs stay escapes. Columns may have any other names beside these.

    Of several calls with one identifier the first by (turn, name, arguments)
    counts, of several results the first by (turn, content); references to
    unknown calls are ignored. Rows without conv_id or call_id are dropped, as nothing can
    link to them. Empty tables give an empty result.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(named).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "refs")).alias("c")).select(*key, "c.*")
    one = store(one, "calls")
    ends = results.where(named).join(one.select(*key, F.col("turn").alias("_called")), key, "left").withColumn("late", F.coalesce(F.col("turn") >= F.col("_called"), F.lit(False)))
    ends = ends.groupBy(*key, "late").agg(F.min(F.struct("turn", "content")).alias("r"))
    ends = store(ends, "results")
    order = levels(one.select(*key, "refs"))
    answered = one.join(ends.where("late").select(*key, F.col("r.content").alias("content"), F.lit(True).alias("has")), key, "left").join(order, key)
    spec = schemas.where("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    linked = answered.join(spec, "name", "left").select("conv_id", "call_id", "turn", "level", "name", "arguments", "schema", "content", F.when(F.col("has"), "linked").otherwise("no_result").alias("status"))
    none = lambda kind: F.lit(None).cast(kind)
    orphans = ends.where("NOT late").select("conv_id", "call_id", "r.turn", none("int").alias("level"), none("string").alias("name"), none("string").alias("arguments"), none("string").alias("schema"), "r.content", F.lit("orphan_result").alias("status"))
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    return linked.unionByName(orphans).mapInArrow(_sealed, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, level int, status string, errors string, json string")


#: The tools that the query's calls name.
SCHEMAS = [
    ("search", '{"type":"object","required":["q","n"],"properties":{"q":{"type":"string","minLength":8},"n":{"type":"integer","minimum":1},"ref":{"type":"string"}},"additionalProperties":false}'),
    ("lookup", '{"type":"object","required":["q"],"properties":{"q":{"type":"string"},"n":{"type":"integer","maximum":400},"ref":{"type":"string"}},"additionalProperties":false}'),
]


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of plain turns: the table has no tool messages of its own.

    Each assistant turn calls a tool with its whole text and the text's length, and
    refers to the call of the assistant turn before it (two turns back), or in
    every fifth to the turn at half its number; each other turn answers the call of the turn before it with its whole text.
    """
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    length = F.char_length("text")
    before = F.when(F.col("turn") % 5 == 0, F.floor(F.col("turn") / 2)).otherwise(F.col("turn") - 2)
    ref = F.when((before < F.col("turn")) & (before >= 0), ident(before))
    odd = F.col("turn") % 7 == 5
    text = F.struct(F.col("text").alias("q"), F.when(~odd, length).alias("n"), F.when(odd, length.cast("string")).alias("m"), ref.alias("ref"))
    arguments = F.regexp_replace(F.to_json(text), r'"m":"(\d+)"(,"ref":"[^"]*")?\}$', r'"n":"$1"$2}')
    arguments = F.when(odd, arguments).otherwise(F.to_json(text))
    calls = conversations.where("role = 'assistant'").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.when(F.col("turn") % 3 == 0, "lookup").otherwise("search").alias("name"), arguments.alias("arguments"), F.array(ref).alias("refs"))
    results = conversations.where("role <> 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Whole texts pass through the operator; the query gives the size and a digest of each call's JSON."""
    calls, results = tool_messages(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, spark.createDataFrame(SCHEMAS, "name string, schema string"))
    return linked.select("conv_id", "call_id", "turn", "level", "status", "errors", F.octet_length("json").cast("bigint").alias("json_bytes"), F.md5("json").alias("json_md5"))


OP5_SQL = """
WITH RECURSIVE turns AS (SELECT *, length(text) AS n, concat('c', conv_id, '-', turn) AS me, CASE WHEN turn % 5 = 0 THEN turn // 2 ELSE turn - 2 END AS b FROM conversations),
named AS (SELECT *, CASE WHEN b < turn AND b >= 0 THEN concat('c', conv_id, '-', b) END AS ref FROM turns),
calls AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'lookup' ELSE 'search' END AS name, turn % 7 = 5 AS odd FROM named WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id, me ORDER BY text) = 1),
results AS (SELECT conv_id, concat('c', conv_id, '-', turn - 1) AS me, turn, text FROM turns WHERE role <> 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
lvl AS (SELECT conv_id, me, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.me = c.ref)
  UNION ALL SELECT c.conv_id, c.me, level + 1 FROM lvl JOIN calls c ON c.conv_id = lvl.conv_id AND c.ref = lvl.me),
args AS (SELECT calls.*, concat('{"n":', CASE WHEN odd THEN '"' END, n, CASE WHEN odd THEN '"' END, ',"q":', to_json(text), CASE WHEN ref IS NOT NULL THEN concat(',"ref":"', ref, '"') END, '}') AS arguments,
  concat_ws('; ', CASE WHEN odd THEN '$.n: not integer' WHEN name = 'lookup' AND n > 400 OR name = 'search' AND n < 1 THEN '$.n: out of bounds' END, CASE WHEN name = 'search' AND n < 8 THEN '$.q: length' END) AS errors FROM calls),
linked AS (SELECT conv_id, me AS call_id, args.turn, CAST(level AS INTEGER) AS level, CASE WHEN results.me IS NULL THEN 'no_result' ELSE 'linked' END AS status, nullif(errors, '') AS errors,
  concat('{"arguments":', arguments, ',"id":"', me, '","name":"', name, '","result":', CASE WHEN results.me IS NULL THEN 'null' ELSE to_json(results.text) END, '}') AS json
FROM args JOIN lvl USING (conv_id, me) LEFT JOIN results USING (conv_id, me)
UNION ALL
SELECT conv_id, me, turn, NULL, 'orphan_result', NULL, concat('{"arguments":null,"id":"', me, '","name":null,"result":', to_json(text), '}')
FROM results WHERE NOT EXISTS (SELECT 1 FROM calls WHERE calls.conv_id = results.conv_id AND calls.me = results.me))
SELECT conv_id, call_id, turn, level, status, errors, strlen(json) AS json_bytes, md5(json) AS json_md5 FROM linked
"""
