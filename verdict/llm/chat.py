"""Chat formatting with tool calls.

Messages become events: messages, the calls in them, and results. Results are
joined to calls by identifier (per conversation). A result depends on its call,
a call on the result of the call that it names in ``after``; each event so has one
predecessor at most, and pointer jumping gives the length of its chain and the
latest turn on it. Ordered by that turn, then that length, every event follows
what it depends on. Arguments are validated against the tool's schema, and each
event is serialised as canonical JSON (sorted keys, no blanks, shortest numbers, with an
exponent below a millionth and from 1e21 on). Arguments with numbers that no double
holds, integers of over 4,300 digits or too deep nesting count as not JSON.

Status: ok; for calls also unanswered, duplicate (not the first of its id),
unknown_tool, invalid (with the path in ``problem``), waits_for_none (``after`` names no
answered call); for results orphan and duplicate; cycle for events whose
chain has no begin. Nothing is dropped.

Positions are dense per conversation: events are range-partitioned by
conversation and order, and numbered over the partitions, so that a conversation
with a third of all rows doesn't fall to one task.

Nulls: a null conv_id is a conversation of its own, a null turn comes first, null
text and roles are JSON nulls; a call with a null id is unanswered. Repeated
messages are events of their own; of their calls and results the first counts.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

CALLS = "array<struct<id:string,name:string,arguments:string,after:string>>"


def _string(x) -> str:
    out = json.dumps(x, ensure_ascii=False)
    return json.dumps(x) if any("\ud800" <= c <= "\udfff" for c in out) else out


def canonical(x) -> str:
    """Canonical JSON of a parsed value."""
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical(x[k])}" for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError("not a JSON number")
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        if 1e-6 <= abs(x) < 1e-4:       # no exponent down to a millionth
            digits, power = repr(abs(x)).split("e-")
            return "-" * (x < 0) + "0." + "0" * (int(power) - 1) + digits.replace(".", "")
        return repr(x).replace("e-0", "e-")
    return _string(x)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(x, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(x, (int, float)) and not isinstance(x, bool) and (kind == "number" or x == int(x))
    return isinstance(x, _TYPES[kind])


def problem(x, schema: dict, at: str = "$") -> str | None:
    """Where and how a value breaks a schema (type, enum, bounds, lengths,
    required, properties, additionalProperties, items), else None."""
    kinds = schema.get("type")
    if kinds and not any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: type"
    if "enum" in schema and canonical(x) not in map(canonical, schema["enum"]):
        return f"{at}: enum"
    if _is(x, "number") and not schema.get("minimum", x) <= x <= schema.get("maximum", x):
        return f"{at}: range"
    size = len(x) if isinstance(x, (str, list)) else None
    low, high = ("minLength", "maxLength") if isinstance(x, str) else ("minItems", "maxItems")
    if size is not None and not schema.get(low, size) <= size <= schema.get(high, size):
        return f"{at}: length"
    if isinstance(x, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in x:
                return f"{at}.{k}: missing"
        for k in sorted(x):
            if k in own:
                if found := problem(x[k], own[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unexpected"
    if isinstance(x, list) and "items" in schema:
        for i, v in enumerate(x):
            if found := problem(v, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _finite(number: str) -> float:
    x = float(number)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    return x


def _written(schemas: dict[str, dict]):
    """Adds problem and message (canonical JSON) to events."""
    def one(r: dict) -> tuple[str | None, str]:
        if r["kind"] != "call":
            body = {"role": r["role"], "content": r["text"]}
            if r["kind"] == "result":
                body["tool_call_id"] = r["call_id"]
            return None, canonical(body)
        wrong, arguments = None, None
        try:
            arguments = json.loads(r["text"] or "", parse_constant=_finite, parse_float=_finite)
            wrong = problem(arguments, schemas[r["name"]]) if r["name"] in schemas else None
            text = canonical(arguments)
        except (ValueError, RecursionError):
            wrong, text = "$: not JSON", _string(r["text"])
        head = canonical({"id": r["call_id"], "name": r["name"]})
        return wrong, f'{{"arguments":{text},{head[1:]}'

    def run(batches):
        for b in batches:
            done = [one(r) for r in b.select(["kind", "role", "text", "call_id", "name"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())],
                [*b.schema.names, "problem", "message"])
    return run


def _numbered(batches):
    """Rows in order: their place among the rows of their conversation in this partition."""
    last, n, begun = None, 0, False
    for b in batches:
        out = []
        for conv in b.column("conv_id").to_pylist():
            n = n + 1 if begun and conv == last else 0
            last, begun = conv, True
            out.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "nth"])


def _chains(nodes: DataFrame) -> DataFrame:
    """(uid, level, latest, cyclic) of nodes (uid, parent, turn): steps to the
    begin of the chain and the latest turn on it, by pointer jumping."""
    state = stored(nodes.select("uid", F.col("parent").alias("to"), F.col("turn").alias("latest"),
                                F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")), "chains")
    rounds = math.ceil(math.log2(max(state.count(), 1) + 1)) + 1
    for _ in range(rounds):
        if state.filter("to is not null").isEmpty():
            break
        ahead = state.select(F.col("uid").alias("to"), F.col("to").alias("next"), F.col("latest").alias("then"), F.col("level").alias("more"))
        state = stored(state.join(ahead, "to", "left").select(
            "uid", F.col("next").alias("to"), F.greatest("latest", "then").alias("latest"),
            (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "chains")
    return state.select("uid", "level", "latest", F.col("to").isNotNull().alias("cyclic"))


def _linked_events(messages: DataFrame) -> DataFrame:
    """Events with uid, kind, call_id, parent, first (of its id) and answered."""
    m = messages.select("conv_id", "turn", "role", "text", "tool_calls", "tool_call_id")
    said = m.select("conv_id", "turn", F.lit(-1).alias("index"), F.when(F.col("tool_call_id").isNull(), "message").otherwise("result").alias("kind"),
                    "role", "text", F.col("tool_call_id").alias("call_id"), F.lit(None).cast("string").alias("name"),
                    F.lit(None).cast("string").alias("after"))
    calls = m.select("conv_id", "turn", "role", F.posexplode("tool_calls").alias("index", "c")).select(
        "conv_id", "turn", "index", F.lit("call").alias("kind"), "role", F.col("c.arguments").alias("text"),
        F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.after").alias("after"))
    events = stored(said.unionByName(calls).withColumn("uid", F.monotonically_increasing_id()), "events")
    # the first call and the first result of each identifier
    ids = stored(events.filter("call_id is not null").groupBy("conv_id", "call_id", "kind")
                 .agg(F.min(F.struct("turn", "index", "uid")).alias("first"))
                 .select("conv_id", "call_id", "kind", F.col("first.uid").alias("first")), "identifiers")

    def of(kind, key, name):
        return ids.filter(F.col("kind") == kind).select(
            F.xxhash64("conv_id", "call_id").alias(f"at_{name}"), F.col("conv_id").alias(f"conv_of_{name}"),
            F.col("call_id").alias(f"id_of_{name}"), F.col("first").alias(name))

    def linked(df, kind, key, name):
        # events without an identifier meet nobody; their own number spreads them
        at = F.when(F.col(key).isNotNull(), F.xxhash64("conv_id", key)).otherwise(F.col("uid"))
        return df.join(of(kind, key, name), (at == F.col(f"at_{name}")) & F.col("conv_id").eqNullSafe(F.col(f"conv_of_{name}"))
                       & (F.col(key) == F.col(f"id_of_{name}")), "left").drop(f"at_{name}", f"conv_of_{name}", f"id_of_{name}")

    slim = events.select("uid", "conv_id", "turn", "kind", "call_id", "after")
    slim = linked(linked(linked(slim, "call", "call_id", "call"), "result", "call_id", "result"), "result", "after", "awaited")
    status = (F.when(F.col("kind") == "result", F.when(F.col("call").isNull(), "orphan").when(F.col("result") != F.col("uid"), "duplicate"))
              .when(F.col("kind") == "call", F.when(F.col("call") != F.col("uid"), "duplicate")
                    .when(F.col("after").isNotNull() & F.col("awaited").isNull(), "waits_for_none")
                    .when(F.col("result").isNull(), "unanswered")))
    parent = F.when(F.col("kind") == "result", F.col("call")).when(F.col("kind") == "call", F.col("awaited"))
    slim = stored(slim.withColumn("parent", parent).select("uid", "turn", "parent", status.alias("fault")), "links")
    chains = _chains(slim.filter("parent is not null").select("uid", "parent", "turn").unionByName(
        slim.join(slim.select(F.col("parent").alias("uid")).filter("uid is not null").distinct(), "uid", "left_semi")
        .filter("parent is null").select("uid", "parent", "turn")))
    return events.join(slim.select("uid", "fault"), "uid").join(chains, "uid", "left")


def format_chat(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, position, turn, kind, call_id, status, problem, message): one
    row an event of ``messages`` (conv_id, turn, role, text, tool_calls of type
    ``CALLS``, tool_call_id for results)."""
    events = _linked_events(messages)
    latest = F.when(F.coalesce("cyclic", F.lit(False)), F.col("turn")).otherwise(F.coalesce("latest", "turn"))
    level = F.when(F.coalesce("cyclic", F.lit(False)), F.lit(0)).otherwise(F.coalesce("level", F.lit(0)))
    events = events.withColumn("latest", latest).withColumn("level", level)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    written = events.mapInArrow(_written(schemas), ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", problem string, message string")
    fine = F.when(F.col("kind") == "call", F.when(~F.coalesce(F.col("name").isin(list(schemas)), F.lit(False)), "unknown_tool")
                  .when(F.col("problem").isNotNull(), "invalid"))
    status = F.coalesce(F.when(F.coalesce("cyclic", F.lit(False)), "cycle"), F.when(F.col("fault") == "duplicate", F.col("fault")),
                        fine, "fault", F.lit("ok"))
    written = written.withColumn("status", status).drop("text", "fault", "cyclic", "name", "after", "role")
    order = ["conv_id", "latest", "level", "turn", "index", "uid"]
    ordered = written.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    ordered = stored(ordered.mapInArrow(_numbered, f"{types}, nth long"), "ordered")
    # a conversation's rows in earlier partitions; one row a conversation and partition
    counts = ordered.groupBy("conv_id", "part").agg((F.max("nth") + 1).alias("rows"))
    spans = counts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "rows"))).alias("parts")) \
        .filter(F.size("parts") > 1)
    before = (spans.select("conv_id", F.posexplode("parts").alias("i", "p"), "parts")
              .select(F.col("conv_id").alias("c"), F.col("p.part").alias("q"),
                      F.expr("aggregate(slice(parts, 1, i), 0L, (s, x) -> s + x.rows)").alias("before")))
    out = ordered.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("q")), "left")
    return out.select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("position"), "turn", "kind", "call_id",
                      "status", "problem", "message")
