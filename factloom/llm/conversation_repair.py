"""Conversation structure repair by Knuth's lightest-derivation agenda (operator 12).

``damaged`` breaks rows of ``conversations`` by a rule of their key; ``repaired`` then finds, for each conversation, the cheapest edits that give
role initials ``(s?(ua)+)?``: keep a row (0), make it a user's or an assistant's (1), delete it (2; blank and duplicate rows must go),
insert an empty one (5); a truncated row that stays costs 5 more. Of equally cheap edits the ASCII-least initials win.

How:

1. Damage and faults are columns. Equal rows of a conversation (turn, role, text) are counted before they move, so a message
   that is repeated a million times is one row with a count. A row is the first of its role and text if its turn is the least of
   them: an aggregate, joined back on its whole key, which no frequent message makes hot.
2. Rows are dealt by ranges of (conversation, turn, role, text), so that a long conversation spreads over many tasks, and each task reads
   its rows in order, a segment of at most ``SEGMENT`` messages at a time. A conversation that lies inside one task and one segment is repaired there.
3. Items of the deduction are (rows read, state), where the state tells which initial may follow. Their weight is (cost, initials of the edits
   so far); every deduction only adds to both, so it is superior, and an item that is popped from the agenda is final.
4. A segment of a longer conversation gives the lightest weight from each state before it to each state behind it. The segments of a
   conversation are deductions between its boundaries, solved by the same agenda; the segments are then written with the edits that were
   chosen, and hashed one after the other.

A conversation's initials (a byte a row) and segment weights meet in one task, its text only streams through.

Defined results: a null in any column reads as one space, except that a null turn sorts first and is left out of ``gaps`` and a null ``conv_id`` is one
conversation whose id stays null; equal turns are taken by role and text; repeated rows are duplicates; long texts make shorter segments; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm import common as C

#: Messages, and bytes of text, of a segment.
SEGMENT, SEGMENT_BYTES = 512, 1 << 20
#: What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: nothing yet, after a system message, after a user's, after an assistant's; the initials that may follow, and where they lead.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]


def lightest(axioms: dict[Hashable, Weight], extend: Callable[[Hashable, Weight, dict], Iterable[tuple[Hashable, Weight]]], goal: Callable[[Hashable], bool]) -> tuple[Hashable | None, dict]:
    """The first goal item that finalises, and every final item's (weight, item it was deduced from).

    ``extend(item, weight, final)`` gives what an item that has just become final deduces, alone or with other final ones. Weights must be
    superior (no deduction is lighter than what it rests on) and monotone; an item popped from the agenda then has its lightest derivation.
    """
    agenda = [(w, item, None) for item, w in axioms.items()]
    heapq.heapify(agenda)
    best, final = dict(axioms), {}
    while agenda:
        w, item, via = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (w, via)
        if goal(item):
            return item, final
        for new, weight in extend(item, w, final):
            if new not in final and (new not in best or weight < best[new]):
                best[new] = weight
                heapq.heappush(agenda, (weight, new, item))
    return None, final


class Message(NamedTuple):
    """A message after damage, ``copies`` times; ``first``: no earlier one has its role and text."""

    turn: int | None
    role: str
    text: str
    copies: int
    first: bool
    blank: bool
    truncated: bool

    @property
    def steps(self) -> list[tuple[bool, int]]:
        """(whether it may stay, rows): the first row of it, and the duplicates that must go."""
        stays = int(self.first and not self.blank)
        return [(True, 1)] * stays + [(False, self.copies - stays)] * (self.copies > stays)


def rows_of(messages: list[Message]) -> list[tuple[Message, bool, int]]:
    return [(m, stays, n) for m in messages for stays, n in m.steps]


def deductions(rows: list[tuple[Message, bool, int]]):
    """What an item (rows read, state) deduces: the next row kept, given a role or deleted, or a message inserted before it."""

    def extend(item: tuple[int, int], weight: Weight, final: dict):
        at, state = item
        cost, audit = weight
        for initial, then in FOLLOW[state].items():
            if initial != "s":
                yield (at, then), (cost + INSERT, audit + "I")
        if at == len(rows):
            return
        message, stays, n = rows[at]
        yield (at + 1, state), (cost + DELETE * n, audit + "D" * n)
        if stays:
            extra = TRUNCATED if message.truncated else 0
            for initial, then in FOLLOW[state].items():
                if message.role[:1] == initial:
                    yield (at + 1, then), (cost + extra, audit + "K")
                elif initial != "s":
                    yield (at + 1, then), (cost + REROLE + extra, audit + "R")

    return extend


def repair(messages: list[Message]) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a whole conversation."""
    rows = rows_of(messages)
    item, final = lightest({(0, START): (0, "")}, deductions(rows), lambda item: item[0] == len(rows) and item[1] in FINAL)
    return final[item][0]


def weights_of(messages: list[Message]) -> list[list[Weight | None]]:
    """Lightest edits of a segment from each state before it to each state behind it."""
    rows = rows_of(messages)
    out = []
    for entry in range(4):
        _, final = lightest({(0, entry): (0, "")}, deductions(rows), lambda item: False)
        out.append([final[(len(rows), x)][0] if (len(rows), x) in final else None for x in range(4)])
    return out


def written(messages: list[Message], audit: str, state: int) -> list[str]:
    """``role:text`` of what the edits leave, from ``state`` on."""
    out, rows, at = [], iter(rows_of(messages)), 0
    while at < len(audit):
        edit = audit[at]
        if edit == "I":
            initial = "a" if state == USER else "u"
            out.append(f"{NAMES[initial]}:")
            state = FOLLOW[state][initial]
            at += 1
            continue
        message, _, n = next(rows)
        at += n
        if edit != "D":
            initial = message.role[:1] if edit == "K" else "a" if state == USER else "u"
            out.append(f"{message.role if edit == 'K' else NAMES[initial]}:{message.text}")
            state = FOLLOW[state][initial]
    return out


def counts_of(messages: list[Message]) -> dict[str, object]:
    """Faults and turns of a run of messages."""
    turns = [m.turn for m in messages if m.turn is not None]
    blank = sum(m.copies for m in messages if m.blank)
    duplicate = sum(m.copies - m.first for m in messages if not m.blank)
    truncated = sum(1 for m in messages if m.first and not m.blank and m.truncated)
    initials = [m.role[:1] for m in messages]
    illegal = sum(m.copies - 1 for m in messages) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return {"turn_from": ends[0], "turn_to": ends[1], "turns": len(set(turns)), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "starts": initials[0] if initials else None, "ends": initials[-1] if initials else None}


def _gaps(turn_from: int | None, turn_to: int | None, turns: int) -> int:
    return 0 if turn_from is None else turn_to - turn_from + 1 - turns


def _sha(parts: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


# ---------------------------------------------------------------- on Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after damage; a dropped row leaves a mark without copies, so that its conversation is not lost."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    cols = [F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text")]
    kept = [F.when(kind != 0, c).alias(n) for c, n in zip(cols, ("turn", "role", "text"))]
    return conversations.select("conv_id", *kept, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


_WHITE = " \t\n\x0b\x0c\r"


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) once each, with ``first``, ``blank``, ``truncated``. Stored."""
    key = ["conv_id", "turn", "role", "text"]
    end = F.rtrim(F.col("text"), F.lit(_WHITE))
    once = rows.groupBy(*key).agg(F.sum("copies").alias("copies"))
    once = once.withColumn("blank", F.col("copies").isNotNull() & (F.length(end) == 0))
    once = once.withColumn("truncated", ~F.col("blank") & ~F.substring(end, -1, 1).isin(".", "!", "?"))
    firsts = once.where("copies > 0 and not blank").groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"].alias("turn"))
    firsts = firsts.select(*[F.col(c).alias(f"of_{c}") for c in key], F.lit(True).alias("first"))
    same = None
    for c in key:
        equal = F.col(c).eqNullSafe(F.col(f"of_{c}"))
        same = equal if same is None else same & equal
    return C.stored(once.join(firsts, same, "left").select(*key, "copies", F.coalesce("first", F.lit(False)).alias("first"), "blank", "truncated"))


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_RESULT = f"gaps long, {_COUNTS}, cost long, audit string, repaired_sha256 string"
_SEGMENT = f"part int, seg int, whole boolean, {_RESULT}, turn_from long, turn_to long, turns long, starts string, ends string, costs array<long>, audits array<string>, messages array<struct<turn:long,role:string,text:string,copies:long,first:boolean,blank:boolean,truncated:boolean>>"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _segments(schema: pa.Schema):
    """Ordered messages -> segments, those of conversations that lie inside one task and one segment with their result."""

    def read(batches) -> Iterator[tuple[object, Message | None]]:
        for batch in batches:
            for part in C.slices(batch):
                rows = part.to_pydict()
                for conv, turn, role, text, copies, first, blank, truncated in zip(*(rows[c] for c in ("conv_id", "turn", "role", "text", "copies", "first", "blank", "truncated"))):
                    yield conv, Message(turn, role, text, copies, first, blank, truncated) if copies else None

    def cuts(batches) -> Iterator[tuple[object, list[Message], bool]]:
        """(conversation, messages, whether these are its last in this task)."""
        conv, held, size, any_row = None, [], 0, False
        for new, message in read(batches):
            if any_row and new != conv:
                yield conv, held, True
                held, size = [], 0
            elif len(held) >= SEGMENT or size >= SEGMENT_BYTES:
                yield conv, held, False
                held, size = [], 0
            conv, any_row = new, True
            if message is not None:
                held.append(message)
                size += len(message.text) + message.copies
        if any_row:
            yield conv, held, True

    def row(part: int, seg: int, conv: object, messages: list[Message], whole: bool) -> dict:
        out = {"conv_id": conv, "part": part, "seg": seg, "whole": whole} | counts_of(messages)
        if whole:
            cost, audit = repair(messages)
            return out | {"gaps": _gaps(out["turn_from"], out["turn_to"], out["turns"]), "cost": cost, "audit": audit, "repaired_sha256": _sha(written(messages, audit, START))}
        found = [w for line in weights_of(messages) for w in line]
        return out | {"costs": [w and w[0] for w in found], "audits": [w and w[1] for w in found], "messages": [m._asdict() for m in messages]}

    def run(batches):
        part, rows, seg, began, ahead = TaskContext.get().partitionId(), [], 0, True, None
        for now in cuts(batches):
            if ahead is not None:
                # whole: neither the first nor the last of the task, and no cut inside
                conv, messages, ends = ahead
                rows.append(row(part, seg, conv, messages, ends and began and seg > 0))
                began, seg = ends, seg + 1
            ahead = now
            if len(rows) >= 256 or (rows and rows[-1].get("messages")):
                yield _batch(rows, schema)
                rows = []
        if ahead is not None:
            rows.append(row(part, seg, ahead[0], ahead[1], False))
        if rows:
            yield _batch(rows, schema)

    return run


_CHOSEN = f"conv bigint, part int, seg int, entry int, audit_part string, last boolean, {_RESULT}"


def _choose(schema: pa.Schema):
    """The segments of one conversation, without texts -> the edits of each, and the conversation's counts."""

    def fn(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seg"]))
        total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        low = high = end = None
        for r in rows:
            if r["starts"] is not None:
                total["illegal"] += end is not None and end + r["starts"] not in ("su", "ua", "au")
                end = r["ends"]
            if r["turn_from"] is not None:
                total["turns"] -= high is not None and high == r["turn_from"]
                low, high = (r["turn_from"] if low is None else low), r["turn_to"]

        def extend(item: tuple[int, int], weight: Weight, final: dict):
            at, state = item
            if at < len(rows):
                for then in range(4):
                    if (cost := rows[at]["costs"][4 * state + then]) is not None:
                        yield (at + 1, then), (weight[0] + cost, weight[1] + rows[at]["audits"][4 * state + then])

        goal, final = lightest({(0, START): (0, "")}, extend, lambda item: item[0] == len(rows) and item[1] in FINAL)
        (cost, audit), states, item = final[goal][0], [], goal
        while item is not None:
            states.append(item[1])
            item = final[item][1]
        states.reverse()
        conv, out = (rows[0]["part"] << 32) + rows[0]["seg"], []
        for k, r in enumerate(rows):
            out.append({"conv_id": r["conv_id"], "conv": conv, "part": r["part"], "seg": r["seg"], "entry": states[k], "audit_part": r["audits"][4 * states[k] + states[k + 1]], "last": False})
        turns = total.pop("turns")
        out[-1] |= total | {"last": True, "gaps": _gaps(low, high, turns), "cost": cost, "audit": audit}
        return pa.Table.from_pylist(out, schema=schema)

    return fn


def _write_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(conv, part, seg, entry, audit_part, messages) -> (conv, part, seg, n, piece)."""
    rows = batch.to_pylist()
    pieces = [written([Message(**m) for m in r["messages"]], r["audit_part"], r["entry"]) for r in rows]
    cols = [batch.column(k) for k in range(3)] + [pa.array([len(p) for p in pieces], type=pa.int64()), pa.array(["\n".join(p) for p in pieces], type=pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["conv", "part", "seg", "n", "piece"])


def _hash_task(batches):
    """Ordered pieces (conv, n, piece) -> (conv, sha), one piece held at a time."""
    conv, sha, begun = None, None, False
    names = ["conv", "sha"]
    for batch in batches:
        for part in C.slices(batch):
            for new, n, piece in zip(*(part.column(k).to_pylist() for k in range(3))):
                if new != conv:
                    if sha is not None:
                        yield pa.RecordBatch.from_pydict({"conv": [conv], "sha": [sha.hexdigest()]}).select(names)
                    conv, sha, begun = new, hashlib.sha256(), False
                if n:
                    sha.update((("\n" if begun else "") + piece).encode("utf-8", "surrogatepass"))
                    begun = True
    if sha is not None:
        yield pa.RecordBatch.from_pydict({"conv": [conv], "sha": [sha.hexdigest()]}).select(names)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation of ``rows`` (as ``damaged`` gives them)."""
    C.ship(rows.sparkSession)
    id_type = rows.schema["conv_id"].dataType

    def typed(columns: str) -> tuple[str, pa.Schema]:
        kinds = rows.sparkSession.createDataFrame([], columns).schema
        fields = [pa.field("conv_id", to_arrow_type(id_type)), *(pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds.fields)]
        return f"conv_id {id_type.simpleString()}, {columns}", pa.schema(fields)

    order = ["conv_id", "turn", "role", "text"]
    dealt = faulty(rows).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
    kind, arrow = typed(_SEGMENT)
    segments = C.stored(dealt.mapInArrow(_segments(arrow), kind))
    result = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    cut = segments.where("not whole")
    kind, arrow = typed(_CHOSEN)
    weights = cut.select("conv_id", "part", "seg", "blank", "duplicate", "truncated", "illegal", "turn_from", "turn_to", "turns", "starts", "ends", "costs", "audits")
    chosen = C.stored(weights.groupBy("conv_id").applyInArrow(_choose(arrow), kind))
    pieces = cut.select("part", "seg", "messages").join(chosen.select("conv", "part", "seg", "entry", "audit_part"), ["part", "seg"]).select("conv", "part", "seg", "entry", "audit_part", "messages")
    pieces = C.map_arrow(pieces, _write_batch, "conv long, part int, seg int, n long, piece string")
    hashed = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seg").select("conv", "n", "piece").mapInArrow(_hash_task, "conv long, sha string")
    spread = chosen.where("last").drop("repaired_sha256").join(hashed.withColumnRenamed("sha", "repaired_sha256"), "conv")
    return segments.where("whole").select(*result).union(spread.select(*result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(C.documents_of(spark, sf_dir, "conversations")))
