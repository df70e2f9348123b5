"""Operator 13: chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered
and consecutive outputs compared: what the longer one has beyond the shorter is the new turn's span. A template that
ends every output with the same closing is allowed for (the common end is left outside); one whose longer output changes
what the shorter had already said rewrites history, which is reported for the turn (`rewrites`), and its span then starts
where the outputs part. Within a turn under the loss mask, the place of the text is found by rendering the turn with two
one-character probes: what both outputs share before and behind them is the template's.

A conversation may be of any length, a third of all rows included: rows are sorted by ranges of (conversation, turn), the
place of each row follows from counts of the ranges before, and every SEGMENT turns are rendered by themselves behind the
CONTEXT turns before them, each of which is rendered in two segments. So no task holds a whole conversation, prefixes
stay short, and a template may look back CONTEXT turns; one whose rendering of a context turn differs between the two
segments (it counts turns, say) is reported by `rewrites` of the segment's first turn.

Defined results: null text is empty, null role is the empty role; turns of equal number follow each other by role, then
text hash, then place in the input; a null turn comes last; rows with a null conversation form one conversation;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT, CONTEXT = 64, 2

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

# ---------------------------------------------------------------- the template of the query

#: What marks turns; inside texts a backslash behind its first sign breaks it.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
BREAK = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS))
TURN = re.compile(r"<s>\[SYS\] (?P<system>.*?) \[/SYS\]|<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?)</s>| (?P<assistant>.*?)</s>", re.S)


def escaped(text: str) -> str:
    """Text without control strings, from which unescaped() gets it back: backslashes are doubled, control strings broken by one."""
    return BREAK.sub(r"\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def instruct_template(messages: Messages) -> str:
    """Instructions in brackets, answers up to an end mark; roles other than the three are written out."""
    out = []
    for role, text in messages:
        t = escaped(text)
        out.append(f"<s>[SYS] {t} [/SYS]" if role == "system" else f"<s>[INST] {t} [/INST]" if role == "user" else f" {t}</s>" if role == "assistant" else f"<s>[ROLE] {escaped(role)} [/ROLE] {t}</s>")
    return "".join(out)


def read_turns(formatted: str) -> Messages:
    """The turns of a text that instruct_template has rendered."""
    out = []
    for m in TURN.finditer(formatted):
        kind = "other" if m["role"] is not None else m.lastgroup
        out.append((unescaped(m["role"]) if kind == "other" else kind, unescaped(m[kind])))
    return out


# ---------------------------------------------------------------- incremental rendering

def common_start(a: str, b: str) -> int:
    """Length of the longest common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def common_end(a: str, b: str) -> int:
    return common_start(a[::-1], b[::-1])


def step(before: str, after: str, nothing: str = "") -> tuple[int, int, bool]:
    """Span of the new turn in `after`, and whether what `before` had said has changed.

    Where outputs end with a closing, `nothing` (an empty conversation, as rendered) tells it from a turn's own last signs.
    """
    if after.startswith(before):
        return len(before), len(after), False
    at = common_start(before, after)
    if not after.endswith(before[at:]):
        return at, len(after), True
    least = len(before) - at
    closing = max([n for n in range(least, common_end(before, nothing) + 1) if after.endswith(before[len(before) - n:])], default=least)
    return len(before) - closing, len(after) - closing, False


def text_place(template: Template, before: Messages, role: str, formatted: str) -> tuple[int, int]:
    """Start and end, in `formatted`, of the text of the last turn."""
    a, b = (template([*before, (role, probe)]) for probe in "01")
    head = common_start(a, b)
    tail = common_start(a[head:][::-1], b[head:][::-1])
    return head, len(formatted) - tail


def rendered(template: Template, turns: Messages, context: int, loss_roles: tuple[str, ...]) -> tuple[str, list[tuple]]:
    """The segment's text, and (start, end, loss start, loss end, rewrites) in it of each turn but the first `context`, which only stand before it."""
    spans, before, cut = [], "", 0
    try:
        nothing = template([])
    except Exception:  # noqa: BLE001  a black box may refuse an empty conversation
        nothing = ""
    for i, (role, _) in enumerate(turns):
        after = template(turns[:i + 1])
        start, end, rewrites = step(before, after, nothing) if i else (0, len(after) - common_end(after, nothing), False)
        if i < context:
            cut = end
        else:
            if i == context > 1:  # it must not matter how many turns stand before it
                short = turns[1:i]
                a, z, _ = step(template(short), whole := template([*short, turns[i]]), nothing)
                rewrites |= whole[a:z] != after[start:end]
            place = text_place(template, turns[:i], role, after) if role in loss_roles else (None, None)
            spans.append((start, end, *place, rewrites))
        before = after
    move = lambda x: None if x is None else x - cut
    return before[cut:], [(move(s), move(e), move(a), move(z), r) for s, e, a, z, r in spans]


KEYS = ("start", "end", "loss_start", "loss_end", "rewrites")
SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()),
    ("turns", pa.list_(pa.struct([(k, pa.bool_() if k == "rewrites" else pa.int32()) for k in KEYS]))),
])
SEGMENTS_SQL = "conv_id long, segment long, formatted string, turns array<struct<start:int,end:int,loss_start:int,loss_end:int,rewrites:boolean>>"


def render_segments(template: Template, loss_roles: tuple[str, ...]) -> Callable:
    """One row a segment, from its turns and the context turns before them; none where only context has come."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending")])
        own = t["own"].to_pylist()
        if True not in own:
            return pa.Table.from_pylist([], SEGMENTS)
        text, spans = rendered(template, list(zip(t["role"].to_pylist(), t["text"].to_pylist())), own.index(True), loss_roles)
        row = {"conv_id": t["conv_id"][0].as_py(), "segment": t["segment"][0].as_py(), "formatted": text, "turns": [dict(zip(KEYS, s)) for s in spans]}
        return pa.Table.from_pylist([row], SEGMENTS)

    return run


NUMBERED = pa.schema([("part", pa.int32()), ("within", pa.int64()), ("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its conversation in this sorted range."""
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        places = []
        for c in b.column(0).to_pylist():
            last, n = c, (n + 1 if c == last else 0)
            places.append(n)
        yield C.record(NUMBERED, [part] * len(places), places, *(b.column(i) for i in range(3)))


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, place (from 0 in its conversation), role, text: sorted by ranges, places from the counts of earlier ranges."""
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))), F.col(f"`{turn}`").cast("long").alias("turn"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text_key"), F.asc("row")]
    rows = rows.repartitionByRange(C.shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = C.staged(C.map_arrow(rows.select("conv_id", "role", "text"), numbered, "part int, within long, conv_id long, role string, text string"), "turns")
    held = rows.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = held.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.count("*").over(whole).alias("parts"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).filter("parts > 1")
    # only the first and last conversation of a range can be cut: at most two rows a range
    found = rows.join(F.broadcast(cut), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return found.select("conv_id", (F.col("within") + F.coalesce("ahead", F.lit(0))).cast("long").alias("place"), "role", "text")


def format_chats(
    turns: DataFrame, template: Template = instruct_template, loss_roles: tuple[str, ...] = ("assistant",), segment: int = SEGMENT, context: int = CONTEXT,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, segment, formatted, turns: of each of its turns start, end, loss_start, loss_end (null outside the mask) in `formatted`, and rewrites.

    A conversation's text is that of its segments, in order (a closing of the whole stands behind each of them).
    """
    rows = placed(turns, conv_col, turn_col, role_col, text_col)
    at = F.floor(F.col("place") / segment).cast("long")
    own, ahead = F.struct(at.alias("segment"), F.lit(True).alias("own")), F.struct((at + 1).alias("segment"), F.lit(False).alias("own"))
    dealt = rows.select("*", F.inline(F.when(F.pmod(F.col("place"), F.lit(segment)) >= segment - context, F.array(own, ahead)).otherwise(F.array(own))))
    return dealt.groupBy("conv_id", "segment").applyInArrow(render_segments(template, loss_roles), SEGMENTS_SQL)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewrites", pa.int64())])
DIGESTS_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each conversation's segments, which come in order, read back as."""
    done: list[tuple] = []
    state: list = []

    def closed() -> None:
        if state:
            conv, n, turns, chars, loss, size, rewrites = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites))

    for b in batches:
        for conv, _, formatted, turns in zip(*(c.to_pylist() for c in b.columns)):
            if not state or state[0] != conv:
                closed()
                state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in read_turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for t in turns:
                state[6] += t["rewrites"]
                if t["loss_start"] is not None:
                    said = unescaped(formatted[t["loss_start"]:t["loss_end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
            state[5] += len(formatted)
        if len(done) > 1000:
            yield C.record(DIGESTS, *zip(*done))
            done.clear()
    closed()
    if done:
        yield C.record(DIGESTS, *zip(*done))


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation that instruct_template has formatted: counts and digests of what reads back.

    SHA-256 has no parts that could be merged, so a conversation's segments pass one task, one after the other.
    """
    rows = formatted.select("conv_id", "segment", "formatted", "turns")
    rows = rows.repartition(C.shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "segment")
    return C.map_arrow(rows, digests, DIGESTS_SQL)
