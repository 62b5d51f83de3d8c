"""Chat formatting with linked tool calls.

An assistant's text may hold calls, <tool_call>{"id", "name", "arguments"}</tool_call>; a message of role "tool" is the result of one,
{"tool_call_id", "content"}. Arguments may point at an earlier call's result as {"$result": id}. Calls and results are hash-joined by
conversation and identifier, ordered so that a result follows its call and a call follows the results that it uses, checked against the tools'
schemas, and written as canonical JSON (sorted keys, no spaces, no escapes but those that JSON needs).

The result has a row per event, not per conversation, so that a very long conversation is never collected; `after` and `depth` sort its events:
by the latest turn that an event has to wait for, then by steps from it, then by turn and place. Conversations of up to LOCAL tool events are
ordered within a task; longer ones by rounds of a join, each from the events that the round before resolved, as many rounds as the longest
chain has steps. Events on a cycle, or waiting for one, keep their own turn and have cyclic set.

Defined results: null role or text count as empty; a text without well-formed calls is a plain message; a result or call without partner is kept
and not linked; of several results with one identifier each is linked to the first call by turn; a repeated row is an event of its own; a null
conv_id is a conversation like others, a null turn sorts first; other columns are ignored; an empty table gives an empty result. Calls and results
whose JSON can't be written canonically (NaN, infinities, lone surrogates, nesting beyond the parser's depth) are not well-formed; bytes that aren't
UTF-8 are replaced. conv_id and turn are integers, or texts that are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import Scratch, small

#: Schemas by tool: JSON types of properties, required ones and allowed values. A tool without a schema fails its check.
TOOLS = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculate": {"required": ["expression"], "properties": {"expression": {"type": "string"}}},
    "lookup": {"required": ["key"], "properties": {"key": {"type": "string"}, "scope": {"type": "string", "enum": ["page", "site"]}}},
}
OPEN, CLOSE = "<tool_call>", "</tool_call>"
#: Tool events of a conversation that is ordered within one task.
LOCAL = 10_000
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value: object) -> str:
    """Sorted keys, no spaces; ValueError for what JSON or UTF-8 can't hold."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def loaded(text: str) -> object:
    """A JSON text's value; null if it isn't well-formed."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def calls_in(text: str) -> tuple[list[str], str]:
    """What stands between the tags, and the text without them: one pass, whatever the number of unclosed tags."""
    found, rest, at = [], [], 0
    while (a := text.find(OPEN, at)) >= 0 and (b := text.find(CLOSE, a + len(OPEN))) >= 0:
        found.append(text[a + len(OPEN) : b])
        rest.append(text[at:a])
        at = b + len(CLOSE)
    return found, "".join([*rest, text[at:]])


def pointers(value: object) -> list[str]:
    """Identifiers of the results that arguments use."""
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return [str(value["$result"])]
        value = list(value.values())
    return [x for v in value for x in pointers(v)] if isinstance(value, list) else []


def fits(arguments: object, schema: dict | None) -> bool:
    """Whether arguments match a schema; a pointer to a result matches any type."""
    if schema is None or not isinstance(arguments, dict):
        return False
    props = schema.get("properties", {})
    if any(k not in arguments for k in schema.get("required", ())) or any(k not in props for k in arguments):
        return False
    for k, v in arguments.items():
        kind = props[k].get("type")
        if isinstance(v, dict) and set(v) == {"$result"}:
            continue
        if kind and (not isinstance(v, _TYPES[kind]) or (isinstance(v, bool) and kind in ("integer", "number"))):
            return False
        if "enum" in props[k] and v not in props[k]["enum"]:
            return False
    return True


def result_of(text: str) -> tuple | None:
    x = loaded(text)
    if isinstance(x, dict) and isinstance(x.get("tool_call_id"), (str, int)):
        name = str(x["tool_call_id"])
        return "result", name, [], True, canonical({"content": x.get("content"), "role": "tool", "tool_call_id": name})
    return None


def call_of(text: str, tools: dict) -> tuple | None:
    x = loaded(text)
    if isinstance(x, dict) and isinstance(x.get("id"), (str, int)) and isinstance(x.get("name"), str):
        name, arguments = str(x["id"]), x.get("arguments", {})
        return "call", name, pointers(arguments), fits(arguments, tools.get(x["name"])), canonical({"arguments": arguments, "id": name, "name": x["name"], "type": "tool_call"})
    return None


def events_of(role: str, text: str, tools: dict) -> list[tuple]:
    """(kind, call_id, uses, valid, json) of one message: itself, and its calls."""

    def event(read: Callable[..., tuple | None], *args: object) -> tuple | None:
        try:
            return read(*args)
        except (ValueError, RecursionError):  # not to be written as canonical JSON
            return None

    if role == "tool" and (got := event(result_of, text)):
        return [got]
    found, rest = calls_in(text) if role == "assistant" else ([], text)
    calls = [x for x in (event(call_of, t, tools) for t in found) if x]
    plain = rest.strip() if calls else text
    return ([("message", None, [], True, canonical({"content": plain, "role": role}))] if plain or not calls else []) + calls


EVENTS = "conv_id long, turn long, seq int, role string, kind string, call_id string, uses array<string>, valid boolean, json string"


def parsed(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    tools = TOOLS if tools is None else tools

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EVENTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
        for batch in batches:
            rows = []
            texts = [[(v or b"").decode("utf-8", "replace") for v in batch.column(x).cast(pa.binary()).to_pylist()] for x in ("role", "text")]
            for conv, turn, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), *texts):
                rows += [(conv, turn, k, role, *e) for k, e in enumerate(events_of(role, text, tools))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    typed = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return typed.mapInArrow(run, EVENTS)


def ordered(needs: list[tuple[str, str]], turns: dict[str, int | None]) -> dict[str, tuple]:
    """(after, depth) of each event that doesn't wait for a cycle: needs are pairs of an event and one that it waits for."""
    low = lambda t: (t is not None, t or 0)  # noqa: E731  null turns sort first
    waits, frees = dict.fromkeys(turns, 0), {}
    for key, need in needs:
        waits[key] += 1
        frees.setdefault(need, []).append(key)
    best = {k: (low(t), 0) for k, t in turns.items()}
    todo = [k for k, n in waits.items() if not n]
    out = {}
    while todo:
        k = todo.pop()
        out[k] = best[k]
        for x in frees.get(k, ()):
            best[x] = max(best[x], (best[k][0], best[k][1] + 1))
            waits[x] -= 1
            if not waits[x]:
                todo.append(x)
    return {k: (t[1] if t[0] else None, d) for k, (t, d) in out.items()}


def _in_tasks(acts: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, after, depth) of the events of conversations that are small enough; a conversation is a group."""
    import pandas as pd

    def run(got: pd.DataFrame) -> pd.DataFrame:
        turns: dict[str, int | None] = {}
        for key, turn in zip(got.key, got.turn):
            t = None if pd.isna(turn) else int(turn)
            turns[key] = t if key not in turns else min(turns[key], t, key=lambda x: (x is not None, x or 0))
        pairs = {(k, n) for k, some in zip(got.key, got.needs) if some is not None for n in some}
        found = ordered(sorted(pairs), turns)
        return pd.DataFrame([(k, a, d) for k, (a, d) in found.items()], columns=["key", "after", "depth"]).astype({"after": "Int64", "depth": "int32"})

    lists = needs.groupBy("key").agg(F.collect_list("need").alias("needs"))  # of one event: as many as its arguments name
    return acts.select("conv", "key", "turn").join(lists, "key", "left").groupBy("conv").applyInPandas(run, "key string, after long, depth int")


def _in_rounds(acts: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by rounds over all of them: each resolves the events whose needs are met, from those that the last one resolved."""
    turns = acts.groupBy("key").agg(F.min("turn").alias("turn"))
    asks = scratch.cut(needs.join(needs.groupBy("key").agg(F.count("*").alias("n")), "key").join(turns, "key"), "asks")
    new = scratch.cut(turns.join(needs, "key", "left_anti").select("key", F.col("turn").alias("after"), F.lit(0).alias("depth")), "new")
    done, partial, k = new, None, 0
    while not new.isEmpty():
        step = new.select(F.col("key").alias("need"), F.struct("after", (F.col("depth") + 1).alias("depth")).alias("s"))
        got = asks.join(small(step), "need").select("key", "n", "turn", F.lit(1).cast("long").alias("m"), "s")
        got = (got if partial is None else got.union(partial)).groupBy("key", "n", "turn").agg(F.sum("m").alias("m"), F.max("s").alias("s"))
        got = scratch.cut(got, f"got{k}")
        reached = F.greatest("s", F.struct(F.col("turn").alias("after"), F.lit(0).alias("depth")))
        new = scratch.cut(got.where("m = n").select("key", reached.alias("s")).select("key", "s.after", "s.depth"), f"new{k}")
        partial, done, k = got.where("m < n").select("key", "n", "turn", "m", "s"), done.union(new), k + 1
    return done


def formatted(conversations: DataFrame, tools: dict | None = None, local: int = LOCAL) -> DataFrame:
    """conv_id, turn, seq, role, kind, call_id, valid, linked, cyclic, after, depth and json of each event."""
    scratch = Scratch(conversations.sparkSession)
    events = scratch.cut(parsed(conversations, tools), "events")
    plain = events.where("kind = 'message'").select("conv_id", "turn", "seq", "role", "kind", "call_id", "valid", F.lit(False).alias("linked"), F.lit(False).alias("cyclic"), F.col("turn").alias("after"), F.lit(0).alias("depth"), "json")
    # Conversations and events by 128-bit names; a null conv_id has one as well.
    named = lambda *c: F.md5(F.to_json(F.struct(*c)).cast("binary"))
    acts = events.where("kind <> 'message'").withColumns({"conv": named("conv_id"), "key": named("conv_id", "turn", "seq", "kind", "call_id", "json")})
    acts = scratch.cut(acts, "acts")
    if acts.isEmpty():
        scratch.close("events")
        return plain
    calls = acts.where("kind = 'call'").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "seq", "key"))["key"].alias("call_key"))
    linked = scratch.cut(acts.where("kind = 'result'").join(calls, ["conv", "call_id"]).select("conv", "call_id", "key", "call_key"), "linked")
    uses = acts.where("kind = 'call'").select("conv", F.col("key"), F.explode("uses").alias("call_id"))
    needs = uses.join(linked.select("conv", "call_id", F.col("key").alias("need")), ["conv", "call_id"]).select("conv", "key", "need")
    needs = linked.select("conv", "key", F.col("call_key").alias("need")).union(needs).distinct()
    size = acts.groupBy("conv").agg((F.count("*") > local).alias("long"))
    acts = scratch.cut(acts.join(size, "conv"), "sized")
    needs = scratch.cut(needs.join(size, "conv"), "needs")
    pick = lambda df, which: df.where(F.col("long") == which)
    state = _in_tasks(pick(acts, False), pick(needs, False).select("key", "need"))
    if not pick(acts, True).isEmpty():
        state = state.union(_in_rounds(pick(acts, True), pick(needs, True).select("key", "need"), scratch))
    partner = linked.select("key").union(linked.select("call_key")).distinct().withColumn("linked", F.lit(True))
    out = acts.join(state, "key", "left").join(partner, "key", "left").select(
        "conv_id", "turn", "seq", "role", "kind", "call_id", "valid", F.coalesce("linked", F.lit(False)).alias("linked"), F.col("depth").isNull().alias("cyclic"),
        F.when(F.col("depth").isNull(), F.col("turn")).otherwise(F.col("after")).alias("after"), F.coalesce("depth", F.lit(0)).alias("depth"), "json",
    )
    out = scratch.cut(out, "out")
    scratch.close("events", "out")
    return plain.union(out)
