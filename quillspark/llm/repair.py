"""Repair of conversation structure: the cheapest edits that make a conversation alternate, as lightest derivations.

A conversation is right if the first letters of its roles read `(s?(ua)+)?`. A row may be kept, given the role of a user
or an assistant, or deleted; an empty row may be inserted. Rows that are blank or repeat an earlier one must go, rows
that end without a sentence mark cost extra while they stay. Of all cheapest edits those whose initials (K, R, D, I) are
least in ASCII order are taken.

Items say what a stretch of rows can do: (start, rows read, end) in states 0 (nothing written), 1 (a system row), 2 (a
user row is open) and 3 (answered). Deductions lengthen an item by a row or an insertion, or join two neighbouring ones.
Knuth's agenda pops items in ascending (cost, audit), a weight that no deduction lowers, so a popped item is final; the
search ends when the goal is popped. Two derivations of one item never have audits of which one begins the other at the
same cost, since the rest could be insertions only; so longer derivations keep their order.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any length is cut over tasks. Each task
derives its stretch for every start state and end state; neighbouring stretches are joined afterwards by the same
agenda. Only the repaired texts of one conversation pass one task in order, as a stream, since a digest needs that.

Rows are read by turn, null turns first. Rows that share a turn are ordered by the first PREFIX characters of role and
text, then by role and text. A null role or text reads as one space; a role without a letter fits nowhere. Repeated rows
count as often as they occur, without being held. Rows with a null conversation id are one conversation. An empty text
is blank, a very long one is held only by the task that reads its row. An empty table gives no rows. Other columns play
no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, written

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
#: state -> {first letter of a role: next state}
FLOW: dict[int, dict[str, int]] = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STATES, ENDS, GOAL = (0, 1, 2, 3), (0, 3), 4
#: Rows of one derivation; longer stretches are joined from such.
STRETCH = 256
PREFIX = 16
BLANKS = r"\x20\x09-\x0D"

Weight = tuple[int, str]
Span = dict[tuple[int, int], Weight]


def lightest(axioms: Iterable[tuple[Hashable, Weight]], deduce: Callable[[Hashable, Weight, dict], Iterable[tuple[Hashable, Weight]]], goal: Hashable = None) -> dict[Hashable, Weight]:
    """Items with their lightest weights, final in ascending order, until the goal is.

    deduce(item, weight, final) gives the conclusions of which item is the last antecedent to become final.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, Weight] = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            break
        for to, heavier in deduce(item, weight, final):
            if to not in final:
                heapq.heappush(agenda, (heavier, to))
    return final


def row_edits(state: int, initial: str, unfinished: bool) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, letter) of each edit that a row allows in a state."""
    extra = UNFINISHED * unfinished
    if initial in FLOW[state]:
        yield FLOW[state][initial], KEEP + extra, "K"
    yield FLOW[state][WANTED[state][0]], REROLE + extra, "R"
    yield state, DELETE, "D"


def derive(tokens: list, starts: Iterable[int], whole: bool = False) -> Span:
    """Lightest derivations over tokens from each start: a token is (initial, unfinished), or the number of rows that
    must go. whole: tokens are all rows of a conversation, so only the goal is asked for, as (0, GOAL)."""
    n = len(tokens)

    def deduce(item: tuple[int, int, int], weight: Weight, final: dict) -> Iterator[tuple[tuple, Weight]]:
        start, i, state = item
        cost, audit = weight
        if whole and i == n and state in ENDS:
            yield (start, n, GOAL), weight
        yield (start, i, FLOW[state][WANTED[state][0]]), (cost + INSERT, audit + "I")
        if i < n:
            token = tokens[i]
            if isinstance(token, int):
                yield (start, i + 1, state), (cost + DELETE * token, audit + "D" * token)
            else:
                for to, more, letter in row_edits(state, *token):
                    yield (start, i + 1, to), (cost + more, audit + letter)

    final = lightest([((s, 0, s), (0, "")) for s in starts], deduce, (0, n, GOAL) if whole else None)
    return {(s, q): w for (s, i, q), w in final.items() if i == n and (q == GOAL) == whole}


def joined(left: Span, right: Span) -> Span:
    """Lightest derivations over two neighbouring stretches: (start, middle) and (middle, end) give (start, end)."""

    def deduce(item: tuple[int, int, int], weight: Weight, final: dict) -> Iterator[tuple[tuple, Weight]]:
        side, a, b = item
        if side == 0:
            for end in STATES:
                if (1, b, end) in final:
                    other = final[1, b, end]
                    yield (2, a, end), (weight[0] + other[0], weight[1] + other[1])
        elif side == 1:
            for start in STATES:
                if (0, start, a) in final:
                    other = final[0, start, a]
                    yield (2, start, b), (other[0] + weight[0], other[1] + weight[1])

    final = lightest([((side, *k), w) for side, span in enumerate((left, right)) for k, w in span.items()], deduce)
    return {(a, b): w for (side, a, b), w in final.items() if side == 2}


#: Of a stretch: rows, of which blank, duplicate, truncated; neighbours that don't fit; first and last initial; turns.
SUMMARY = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last"]


def summary_of(left: list, right: list) -> list:
    """The summary of two neighbouring stretches, of which either may be without rows."""
    if not left[0] or not right[0]:
        return left if left[0] else right
    out = [a + b for a, b in zip(left[:6], right[:6], strict=True)]
    out[4] += left[9] + right[8] not in LEGAL_PAIRS
    out[5] -= left[7] is not None and left[7] == right[6]
    return [*out, right[6] if left[6] is None else left[6], left[7] if right[7] is None else right[7], left[8], right[9]]


class Stretch:
    """The rows of a conversation that pass in order, as spans of about STRETCH rows, joined like a binary counter."""

    def __init__(self):
        self.tokens: list = []
        self.spans: list[tuple[int, Span]] = []
        self.summary: list = [0, 0, 0, 0, 0, 0, None, None, "", ""]

    def row(self, turn, initial: str, copies: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        """copies of a row: all blank, or all but perhaps the first duplicates."""
        if not copies:
            return
        first = not (blank or duplicate)
        if first:
            self.tokens.append((initial, truncated))
        gone = copies - first
        if gone:
            if self.tokens and isinstance(self.tokens[-1], int):
                self.tokens[-1] += gone
            else:
                self.tokens.append(gone)
        odd = initial + initial not in LEGAL_PAIRS
        turns = int(turn is not None)
        self.summary = summary_of(self.summary, [copies, gone * blank, gone * (not blank), int(first and truncated), (copies - 1) * odd, turns, turn, turn, initial, initial])
        if len(self.tokens) >= STRETCH:
            self.cut()

    def add(self, size: int, span: Span) -> None:
        self.spans.append((size, span))
        while len(self.spans) > 1 and self.spans[-2][0] <= 2 * self.spans[-1][0]:
            (n, right), (m, left) = self.spans.pop(), self.spans.pop()
            self.spans.append((m + n, joined(left, right)))

    def cut(self) -> None:
        if self.tokens:
            self.add(len(self.tokens), derive(self.tokens, STATES))
            self.tokens = []

    def span(self, closed: bool) -> Span:
        """closed: no other stretch belongs to the conversation."""
        if closed and not self.spans:
            return derive(self.tokens, (0,), whole=True)
        self.cut()
        out: Span | None = None
        for _, span in reversed(self.spans):
            out = span if out is None else joined(span, out)
        return derive([], STATES) if out is None else out


def goal_of(span: Span) -> Weight:
    """The lightest way from nothing written to a right end."""
    return span[0, GOAL] if (0, GOAL) in span else min(span[0, q] for q in ENDS)


def blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{BLANKS}]")


def truncated(text: Column) -> Column:
    """The last character that isn't white space is no sentence mark; nothing of the kind in a blank text."""
    return ~text.rlike(rf"[.!?][{BLANKS}]*\z")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, role_col, text_col, copies): rows damaged by a rule on their conversation and turn.

    crc32 of `conversation:turn` (nulls one space) modulo 20: 0 drops the row (0 copies), 1 empties its text, 2 takes its
    sentence marks, 3 repeats it, 4 makes it a user's. Null roles and texts become one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    role, text = part(role_col), part(text_col)
    return rows.select(
        conv_col,
        turn_col,
        F.when(kind == 4, "user").otherwise(role).alias(role_col),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def with_faults(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Distinct rows (_conv, _turn, _role, _text) with _copies, _blank, _truncated, and _duplicate if an earlier turn has
    the row already. Written.

    Rows of 0 copies leave one row of null role for their conversation. Equal rows are counted before anything is sorted.
    """
    n = F.col(copies_col).cast("bigint") if copies_col else F.lit(1).cast("bigint")
    there = n > 0
    part = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    own = rows.select(F.col(conv_col).alias("_conv"), F.when(there, F.col(turn_col)).alias("_turn"), part(role_col).alias("_role"), part(text_col).alias("_text"), F.greatest(n, F.lit(0)).alias("_n"))
    own = own.groupBy("_conv", "_turn", "_role", "_text").agg(F.sum("_n").alias("_copies"))
    own = own.withColumn("_key", F.unhex(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)))
    again = own.filter("_copies > 0").groupBy("_conv", "_key").agg(F.min("_turn").alias("_since"), F.max(F.col("_turn").isNull()).alias("_before"), F.count(F.lit(1)).alias("_times"))
    again = again.filter("_times > 1").select(F.col("_conv").alias("_c"), F.col("_key").alias("_k"), "_since", "_before")
    met = own.join(again, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_k")), "left")
    later = F.col("_turn").isNotNull() & (F.col("_before") | (F.col("_turn") > F.col("_since")))
    out = met.select("_conv", "_turn", "_role", "_text", "_copies", blank(F.col("_text")).alias("_blank"), F.coalesce(later, F.lit(False)).alias("_duplicate"), truncated(F.col("_text")).alias("_truncated"))
    return written(out, "turns")


_ORDER = ["_conv", "_turn", "_role_head", "_text_head", "_role", "_text"]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_role_head", F.substring("_role", 1, PREFIX)).withColumn("_text_head", F.substring("_text", 1, PREFIX))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _summary_fields(turn: T.DataType) -> list[T.StructField]:
    kinds = [T.LongType()] * 6 + [turn] * 2 + [T.StringType()] * 2
    return [T.StructField(c, k) for c, k in zip(SUMMARY, kinds, strict=True)]


def _summary_arrays(rows: list[list], turn: pa.DataType) -> list[pa.Array]:
    kinds = [pa.int64()] * 6 + [turn] * 2 + [pa.string()] * 2
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def stretches(rows: DataFrame) -> DataFrame:
    """(_conv, _part, summary, spans): what each task's rows of a conversation can do. rows are with_faults()."""
    schema = T.StructType([T.StructField("_conv", rows.schema["_conv"].dataType), T.StructField("_part", T.LongType()), *_summary_fields(rows.schema["_turn"].dataType), T.StructField("spans", _SPANS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, at, out, first, kinds = None, None, 0, [], True, None
        for batch in batches:
            kinds = kinds or (batch.schema.field(1).type, batch.schema.field(2).type)
            for part, conv, turn, initial, *facts in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if own is None or conv != now:
                    if own is not None:
                        # rows of a task's first conversation may stand in the task before
                        out.append((now, at, own.summary, own.span(closed=not first)))
                        first = False
                    now, own, at = conv, Stretch(), part
                own.row(turn, initial or "", *facts)
            if len(out) > 2000:
                yield made(out, kinds)
                out = []
        if own is not None:
            out.append((now, at, own.summary, own.span(closed=False)))
            yield made(out, kinds)

    def made(out: list[tuple], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        spans = [[{"start": a, "end": b, "cost": c, "audit": s} for (a, b), (c, s) in sorted(span.items())] for *_, span in out]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kinds[0]), pa.array([r[1] for r in out], pa.int64()), *_summary_arrays([r[2] for r in out], kinds[1]), pa.array(spans, _ARROW_SPANS)], ["_conv", "_part", *SUMMARY, "spans"])

    keys = _ORDER[:4]
    dealt = _ordered(rows).repartitionByRange(*keys).sortWithinPartitions(*_ORDER)
    own = dealt.select(F.spark_partition_id().cast("bigint").alias("_part"), "_conv", "_turn", F.substring("_role", 1, 1).alias("_initial"), "_copies", F.coalesce("_blank", F.lit(False)), "_duplicate", F.coalesce("_truncated", F.lit(False)))
    return own.mapInArrow(work, schema)


def plans(parts: DataFrame) -> DataFrame:
    """One row per conversation: its summary, cost and audit, from stretches() in order. Written."""
    turn = parts.schema["first_turn"].dataType
    schema = T.StructType([parts.schema["_conv"], *_summary_fields(turn), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, alone, out, kinds = None, None, None, [], None

        def closed() -> None:
            if own is not None:
                out.append((now, own.summary, goal_of(own.span(closed=False) if alone is None else alone)))

        for batch in batches:
            kinds = kinds or (batch.schema.field(0).type, batch.schema.field(8).type)
            for row in batch.to_pylist():
                if own is None or row["_conv"] != now:
                    closed()
                    now, own, alone = row["_conv"], Stretch(), None
                own.summary = summary_of(own.summary, [row[c] for c in SUMMARY])
                span = {(s["start"], s["end"]): (s["cost"], s["audit"]) for s in row["spans"]}
                if (0, GOAL) in span:
                    alone = span
                else:
                    own.add(max(1, row["rows"]), span)
            if len(out) > 5000:
                yield made(out, kinds)
                out.clear()
        closed()
        if out:
            yield made(out, kinds)

    def made(out: list[tuple], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kinds[0]), *_summary_arrays([r[1] for r in out], kinds[1]), pa.array([r[2][0] for r in out], pa.int64()), pa.array([r[2][1] for r in out], pa.string())], ["_conv", *SUMMARY, "cost", "audit"])

    return written(parts.repartition("_conv").sortWithinPartitions("_conv", "_part").mapInArrow(work, schema), "plans")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(_conv, place, edit, role, text): the repaired conversations, each in order within its partition.

    Each conversation's audit comes before its rows in one sorted stream, so that nothing but one batch is held.
    """
    schema = T.StructType([rows.schema["_conv"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    heads = plan.select("_conv", F.lit(0).alias("_kind"), "audit")
    both = _ordered(rows).withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, state, place, out, held, kind_of = None, None, 0, 0, 0, [], 0, None

        def wrote(edit: str, role: str, text: str) -> None:
            nonlocal state, place, held
            out.append((now, place, edit, role, text))
            state, place, held = FLOW[state][role[0]], place + 1, held + len(text)

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                wrote("I", WANTED[state], "")

        for batch in batches:
            kind_of = kind_of or batch.schema.field(0).type
            for conv, kind, own, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == 0:
                    if audit is not None:
                        inserted()
                    now, audit, at, state, place = conv, own, 0, 0, 0
                    continue
                for _ in range(copies):
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        wrote(edit, role if edit == "K" else WANTED[state], text)
                    if held > 4 << 20 or len(out) > 5000:
                        yield made(out, kind_of)
                        out, held = [], 0
        if audit is not None:
            inserted()
        if out:
            yield made(out, kind_of)

    def made(out: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [conv, pa.int64(), *[pa.string()] * 3], strict=True)], schema.names)

    stream = both.repartition("_conv").sortWithinPartitions("_conv", "_kind", *_ORDER[1:]).select("_conv", "_kind", "audit", "_role", "_text", "_copies")
    return bounded_batches(stream).mapInArrow(work, schema)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256) of the rows of repaired(), read in order: `role:text`, joined by line ends."""
    schema = T.StructType([repaired_rows.schema["_conv"], T.StructField("repaired_sha256", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, out, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if running is None or conv != now:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if len(out) > 5000:
                yield made(out, kind)
                out = []
        if running is not None:
            out.append((now, running.hexdigest()))
            yield made(out, kind)

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], schema.names)

    return repaired_rows.mapInArrow(work, schema)


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation whose rows all have 0 copies has zeros, an empty audit and the digest of nothing.
    """
    own = with_faults(rows, conv_col, turn_col, role_col, text_col, copies_col)
    plan = plans(stretches(own))
    said = digests(repaired(own, plan)).withColumnRenamed("_conv", "_of")
    gaps = F.coalesce(F.col("last_turn").cast("bigint") - F.col("first_turn").cast("bigint") + 1 - F.col("turns"), F.lit(0))
    return plan.join(said, F.col("_conv").eqNullSafe(F.col("_of")), "left").select(
        F.col("_conv").alias(conv_col), gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", F.col("illegal").cast("bigint").alias("illegal"), "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
