"""Removal of byte strings that repeat, by enhanced suffix arrays over the places where repeats can lie.

1. Anchors. Among the 32-byte strings inside each window of 100 bytes the one of least hash is the window's anchor, so
   equal windows share their anchor at the same place, whatever stands around them. Neighbouring windows mostly share
   an anchor, and their union is a slice of at most 168 bytes; one row per slice is shuffled, not one per byte.
   Slices that are equal within a task's block leave only their first; the others are known repeats already.
2. Slices are brought together by anchor. An anchor that occurs once ends here. Equal slices repeat the first of them.
   Anchors with differing slices are where a repeat begins or ends inside the slice; only these need their text.
3. Common-prefix interval tree. The suffixes of such slices are sorted (prefix doubling), adjacent common prefixes taken,
   and one scan with a stack walks the intervals. An interval whose suffixes are preceded by differing bytes is a maximal
   repeat; its occurrences are a range of the sorted suffixes, so all groups with all occurrences take one row a suffix.
4. Of each maximal repeat all occurrences but the first are removed: for a slice that is, of every suffix, the longest
   interval in which it isn't the first, joined within the slice before a row leaves the task; one row a slice.

The slices of one anchor are dealt over chunks of about CHUNK_SLICES. Nearly all anchors have one chunk. Of an anchor with
more, each chunk says which windows are still the first of their kind in it, and the firsts of all chunks are compared by
a hash of 128 bits in an aggregation, so that no task gathers an anchor. Nothing is dropped, capped or sampled.

Equal slices are equal in two hashes of 64 bits, of the anchor and of the whole; suffixes are compared byte by byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Roll, blocks, bounded_batches, flat, mixed, written

LENGTH = 100
ANCHOR = 32
BLOCK = 1 << 18
COLLAPSED = 1 << 17
CHUNK = 1 << 20
CHUNK_SLICES = 2_000
PLACE_BITS, START_BITS, COUNT_BITS = 22, 31, 7
LEVELS = (128, 64, 32, 16, 8)


def place(tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One ordered long: the text's tag (for rows that share an id), the first window's start, the number of windows."""
    return (np.asarray(tag, np.int64) << (START_BITS + COUNT_BITS)) | (np.asarray(start, np.int64) << COUNT_BITS) | np.asarray(count, np.int64)


def tag_of(raw: memoryview | bytes) -> int:
    return zlib.crc32(raw) & 0x1FFFFFF


def slices_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, number of windows, anchor hash, slice hash) of texts data[begin:end], all windows covered."""
    none = np.zeros(0, np.int64)
    if data.size < length or not (end - begin >= length).any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = Roll(data)
    hashes = roll.fixed(ANCHOR)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(hashes.size, dtype=np.uint64)
    width, reach = length - ANCHOR + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: least.size - (width - reach)], least[width - reach :])
    anchor = (least & low).astype(np.int64)
    change = np.zeros(data.size + 1, np.int32)
    fits = end - begin >= length
    np.add.at(change, begin[fits], 1)
    np.add.at(change, end[fits] - length + 1, -1)
    inside = np.cumsum(change)[: anchor.size] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begin_at = np.zeros(data.size + 1, bool)
    begin_at[begin[fits]] = True
    first |= inside & begin_at[: anchor.size]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi - lo + 1, hashes[anchor[lo]], roll.of(lo, hi + length)


def anchor_rows(length: int):
    schema = pa.schema([("ah", pa.int64()), ("sh", pa.int64()), ("d", pa.int64()), ("pos", pa.int64()), ("known", pa.bool_())])

    def pieces(data, offsets):
        """(bytes, begins, ends, row numbers, first byte's place in its text); long texts come in overlapping pieces."""
        for a, b in blocks(offsets, BLOCK):
            if b - a == 1 and offsets[b] - offsets[a] > BLOCK:
                for at in range(int(offsets[a]), int(offsets[b]), BLOCK):
                    end = min(at + BLOCK + length - 1, int(offsets[b]))
                    yield data[at:end], np.array([0]), np.array([end - at]), np.array([a]), np.array([at - int(offsets[a])])
            else:
                own = offsets[a : b + 1] - offsets[a]
                yield data[offsets[a] : offsets[b]], own[:-1], own[1:], np.arange(a, b), np.zeros(b - a, np.int64)

    def collapsed(parts) -> pa.RecordBatch:
        ah, sh, d, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, d, sh, ah))
        ah, sh, d, pos = ah[order], sh[order], d[order], pos[order]
        known = np.zeros(ah.size, bool)
        known[1:] = (ah[1:] == ah[:-1]) & (sh[1:] == sh[:-1]) & ((d[1:] != d[:-1]) | (pos[1:] != pos[:-1]))
        # known repeats needn't meet anyone: they are dealt by their own place
        ah = np.where(known, (d * 1_000_003 + pos).astype(np.uint64), ah)
        return pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(d), pa.array(pos), pa.array(known)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            data, offsets = flat(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            tags = np.array([tag_of(view[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            for part, begin, end, row, shift in pieces(data, offsets):
                lo, count, ah, sh = slices_of(part, begin, end, length)
                of = np.searchsorted(begin, lo, side="right") - 1
                held.append((ah, sh, ids[row[of]], place(tags[row[of]], lo - begin[of] + shift[of], count)))
                n += lo.size
                if n >= COLLAPSED:
                    yield collapsed(held)
                    held, n = [], 0
        if n:
            yield collapsed(held)

    return work


def suffix_order(text: np.ndarray) -> dict[int, np.ndarray]:
    """For each level h the ranks of all positions by their next h bytes (level 0: the next 8 bytes as a number)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(text.size, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + text.size]
    ranks = {0: word, 8: np.unique(word, return_inverse=True)[1].astype(np.int64)}
    h = 8
    while h < LEVELS[0]:
        ahead = np.zeros(text.size, np.int64)
        ahead[:-h] = ranks[h][h:] + 1
        ranks[2 * h] = np.unique(ranks[h] * (text.size + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return ranks


def common_prefix(ranks: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The length of the common prefix of the suffixes at i and j, up to 255 bytes."""
    out = np.zeros(i.size, np.int64)
    for h in LEVELS:
        a, b = i + out, j + out
        inside = np.maximum(a, b) < size
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        out += np.where(inside & (ranks[h][a] == ranks[h][b]), h, 0)
    a, b = i + out, j + out
    inside = np.maximum(a, b) < size
    differ = np.where(inside, ranks[0][np.where(inside, a, 0)] ^ ranks[0][np.where(inside, b, 0)], np.uint64(1) << np.uint64(63))
    for k in range(1, 8):
        out += (differ >> np.uint64(64 - 8 * k)) == 0
    return out


def prefix_intervals(slices: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice numbers, starts in them, intervals): the sorted suffixes of at least length bytes, and the maximal repeats.

    A row (size, first, stop) of intervals is a maximal repeat of size bytes; its occurrences are all of the sorted
    suffixes first to stop. A stack of open intervals scans the suffix array; an interval carries the byte before its
    suffixes, or DIVERSE once two differ. Runs of suffixes that share `length` bytes and the byte before hold no maximal
    repeat and are passed over.
    """
    sizes = np.fromiter(map(len, slices), np.int64, len(slices))
    text = np.frombuffer(b"\0".join([*slices, b""]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    of = np.repeat(np.arange(len(slices)), sizes + 1)
    left = np.concatenate([[0], text[:-1]]).astype(np.int64)
    left[begin] = -1 - np.arange(len(slices))
    rest = begin[of] + sizes[of] - np.arange(text.size)
    ranks = suffix_order(text)
    use = np.flatnonzero(rest >= length)
    ahead = np.concatenate([ranks[LEVELS[0]] + 1, np.zeros(LEVELS[0], np.int64)])[use + LEVELS[0]]
    sa = use[np.argsort(ranks[LEVELS[0]][use] * (text.size + 2) + ahead, kind="stable")]  # by 256 bytes; a slice is shorter
    found: list[tuple[int, int, int]] = []
    if sa.size > 1:
        lcp = np.minimum(common_prefix(ranks, sa[:-1], sa[1:], text.size), np.minimum(rest[sa[:-1]], rest[sa[1:]]))
        joined = lcp >= length
        run = np.cumsum(np.concatenate([[True], ~joined]))
        differs = np.concatenate([[False], joined & (left[sa[1:]] != left[sa[:-1]])])
        wanted = np.flatnonzero(np.bincount(run, weights=differs) > 0)
        first = np.searchsorted(run, wanted)
        stop = np.searchsorted(run, wanted, side="right")
        DIVERSE = 1 << 40
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            heights, before = [*lcp[a : b - 1].tolist(), length - 1], left[sa[a:b]].tolist()
            stack: list[list[int]] = []  # open intervals: common prefix, first suffix, byte before
            for k, height in enumerate(heights):
                start, byte = k, before[k]
                while stack and stack[-1][0] > height:
                    size, start, seen = stack.pop()
                    byte = seen if seen == byte else DIVERSE
                    if byte == DIVERSE:
                        found.append((size, a + start, a + k + 1))
                if stack and stack[-1][0] == height:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else DIVERSE
                elif height >= length:
                    stack.append([height, start, byte])
    return of[sa], sa - begin[of[sa]], np.array(found, np.int64).reshape(-1, 3)


def repeated_ahead(when: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """For each sorted suffix the size of the longest interval in which it isn't the first (0: none); when: their places
    in order of occurrence. An interval lies inside the shorter ones around it, so the longest is written last."""
    size = np.zeros(when.size, np.int64)
    for n, a, b in intervals[np.argsort(intervals[:, 0], kind="stable")].tolist():
        first = a + int(np.argmin(when[a:b]))
        own = size[first]
        size[a:b] = n
        size[first] = own
    return size


def by_chunk(found):
    """A function of batches of rows (ah, part, d, pos, chunks, slice) sorted by these, that calls found(columns) for
    chunks of whole (ah, part) of about CHUNK bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        slices, held = [], 0
        for batch in batches:
            for i in range(5):
                columns[i].append(np.asarray(batch.column(i)))
            new = batch.column(5).to_pylist()
            slices.extend(new)
            held += sum(map(len, new))
            if held >= CHUNK:
                whole = [np.concatenate(c) for c in columns]
                last = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
                n = int(last[-1]) + 1 if last.size else 0  # the last group may go on
                if n:
                    yield found(*[c[:n] for c in whole], slices[:n])
                columns, slices = [[c[n:]] for c in whole], slices[n:]
                held = sum(map(len, slices))
        if slices:
            yield found(*[np.concatenate(c) for c in columns], slices)

    return work


def group_rows(length: int):
    """Rows of by_chunk() -> one row for each suffix in sorted order, with the maximal repeats that begin at it."""

    def found(ah, part, d, pos, chunks, slices) -> pa.RecordBatch:
        which, start, intervals = prefix_intervals(slices, length)
        order = np.lexsort((intervals[:, 0], intervals[:, 1]))
        begins = pa.array(np.searchsorted(intervals[order, 1], np.arange(which.size + 1)), pa.int32())
        opened = pa.StructArray.from_arrays([pa.array(intervals[order, 0], pa.int32()), pa.array(intervals[order, 2] - 1, pa.int64())], ["size", "last"])
        at = ((pos[which] >> COUNT_BITS) & ((1 << START_BITS) - 1)) + start
        return pa.RecordBatch.from_arrays([pa.array(ah[which]), pa.array(part[which], pa.int32()), pa.array(np.arange(which.size)), pa.array(d[which]), pa.array(at), pa.ListArray.from_arrays(begins, opened)], ["ah", "part", "rank", "d", "at", "repeats"])

    return by_chunk(found)


def repeat_rows(length: int):
    """Rows of by_chunk() -> one row for each slice that repeats something or whose anchor has more chunks:
    (d, pos, spans to remove, starts of windows that are the first of their kind in this chunk, the slice for these)."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])), pa.list_(pa.int32()), pa.binary()]
    far = 1 << 12

    def lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)

    def found(ah, part, d, pos, chunks, slices) -> pa.RecordBatch:
        which, start, intervals = prefix_intervals(slices, length)
        when = np.empty(which.size, np.int64)
        when[np.lexsort(((pos[which] >> COUNT_BITS) + start, d[which]))] = np.arange(which.size)
        size = repeated_ahead(when, intervals)
        more = np.flatnonzero(size)
        begin, own = which[more] * far + start[more], which[more]
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate((begin + size[more])[order]) if more.size else begin
        head = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if more.size else more
        stop = end[np.append(head[1:] - 1, more.size - 1)] if more.size else end
        spans = pa.StructArray.from_arrays([pa.array(begin[head] % far, pa.int32()), pa.array(stop - begin[head], pa.int32())], ["start", "size"])
        open_ = np.flatnonzero((size == 0) & (chunks[which] > 1))
        open_ = open_[np.lexsort((start[open_], which[open_]))]
        n = len(slices)
        told = np.zeros(n, bool)
        told[own], told[which[open_]] = True, True
        has = np.zeros(n, bool)
        has[which[open_]] = True
        all_spans, all_open = lists(own[order][head], n, spans), lists(which[open_], n, pa.array(start[open_], pa.int32()))
        keep = pa.array(np.flatnonzero(told))
        texts = pa.array([x if h else None for x, h in zip(slices, has.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(d[told]), pa.array(pos[told]), all_spans.take(keep).cast(kinds[2]), all_open.take(keep), texts.take(keep)], ["d", "pos", "spans", "firsts", "slice"])

    return by_chunk(found)


def cut_slices(length: int):
    """Rows (d, text, edges) -> rows (ah, d, pos, chunks, slice) for the edges that lie in this text."""
    schema = pa.schema([("ah", pa.int64()), ("d", pa.int64()), ("pos", pa.int64()), ("chunks", pa.int32()), ("slice", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, edges = np.asarray(batch.column(0)), batch.column(2)
            data, offsets = flat(batch.column(1))
            raw = memoryview(np.ascontiguousarray(data))
            at = np.asarray(edges.offsets).astype(np.int64)
            ah, pos, chunks = (np.asarray(edges.values.field(f)) for f in range(3))
            start, count, tags = (pos >> COUNT_BITS) & ((1 << START_BITS) - 1), pos & ((1 << COUNT_BITS) - 1), pos >> (START_BITS + COUNT_BITS)
            keep, cut = [], []
            for i in range(len(ids)):
                x, y = int(offsets[i]), int(offsets[i + 1])
                tag = tag_of(raw[x:y])
                for k in range(int(at[i]), int(at[i + 1])):
                    if tags[k] == tag:
                        keep.append((i, k))
                        cut.append(bytes(raw[x + int(start[k]) : x + int(start[k]) + int(count[k]) + length - 1]))
            if keep:
                i, k = (np.array(x) for x in zip(*keep, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ah[k]), pa.array(ids[i]), pa.array(pos[k]), pa.array(chunks[k], pa.int32()), pa.array(cut, pa.binary())], schema=schema)

    return work


def window_rows(length: int):
    """Rows (d, pos, firsts, slice) -> one row for each of the windows: (h, g, d, at), hashes of the whole and of two parts."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("d", pa.int64()), ("at", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, pos, firsts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            data, offsets = flat(batch.column(3))
            at = np.asarray(firsts.offsets).astype(np.int64)
            shift = np.asarray(firsts.values)[at[0] : at[-1]].astype(np.int64)
            of = np.repeat(np.arange(d.size), np.diff(at))
            roll, start = Roll(data), offsets[of] + shift
            half = length // 2
            whole, parts = roll.of(start, start + length), mixed(roll.of(start, start + half)) * np.uint64(3) + roll.of(start + half, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(parts.view(np.int64)), pa.array(d[of]), pa.array((pos[of] >> COUNT_BITS) + shift)], schema=schema)

    return work


def strip_spans(whole: bool = False):
    """Rows (..., text, spans) -> the other columns and what is left of the text's bytes.

    whole: a character of which a span takes a part goes altogether, so that what is left is UTF-8.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            spans = batch.column(names.index("_spans"))
            data, offsets = flat(batch.column(names.index("_text")))
            raw = memoryview(np.ascontiguousarray(data))
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            at = np.asarray(spans.offsets).astype(np.int64)
            begin, size = np.asarray(spans.values.field(0)), np.asarray(spans.values.field(1)).astype(np.int64)
            for i in range(batch.num_rows):
                text = raw[int(offsets[i]) : int(offsets[i + 1])]
                own, long = begin[at[i] : at[i + 1]], size[at[i] : at[i + 1]]
                if own.size:
                    mine = (own >> START_BITS) == tag_of(text)
                    own, long = (own & ((1 << START_BITS) - 1))[mine], long[mine]
                left, runs, gone, end = [], 0, 0, 0
                if own.size:
                    order = np.argsort(own, kind="stable")
                    start, stop = own[order], np.maximum.accumulate((own + long)[order])
                    head = np.concatenate([[True], start[1:] > stop[:-1]])
                    firsts, lasts = start[head], stop[np.concatenate([head[1:], [True]])]
                    runs, gone = firsts.size, int((lasts - firsts).sum())
                    if whole:
                        inside = np.append((data[offsets[i] : offsets[i + 1]] & 0xC0) == 0x80, False)
                        for _ in range(3):
                            firsts, lasts = firsts - inside[firsts], lasts + inside[lasts]
                    for x, y in zip(firsts.tolist(), lasts.tolist(), strict=True):
                        left.append(text[end : max(x, end)])
                        end = y
                left.append(text[end:])
                n_bytes.append(len(text)), n_removed.append(gone), n_spans.append(runs), kept.append(b"".join(left))
            keep = [k for k, c in enumerate(names) if c not in ("_text", "_spans")]
            cols = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                [*[names[k] for k in keep], "_n_bytes", "_n_removed", "_n_spans", "_kept"],
            )

    return work


ANCHOR_SCHEMA = "ah long, sh long, d long, pos long, known boolean"
SLICE_SCHEMA = "ah long, d long, pos long, chunks int, slice binary"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Known repeats (edge false) and the slices whose text must be looked at (edge true), as a written table.

    chunks: over how many chunks the slices of an edge's anchor are dealt.
    """
    rows = _keyed(docs, id_col, text_col).mapInArrow(anchor_rows(length), ANCHOR_SCHEMA)
    same, near = Window.partitionBy("ah", "sh"), Window.partitionBy("ah")
    here = F.struct("d", "pos")
    rows = rows.withColumn("first", ~F.col("known") & (here == F.min(here).over(same)))
    rows = rows.withColumn("edge", F.col("first") & (F.min("sh").over(near) != F.max("sh").over(near)))
    rows = rows.withColumn("chunks", F.ceil(F.sum(F.col("first").cast("int")).over(near) / CHUNK_SLICES).cast("int"))
    return written(rows.filter("known OR NOT first OR edge").select("ah", "d", "pos", "edge", "chunks"), "marks")


def edge_slices(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(ah, part, d, pos, chunks, slice) of the edges in marks(), each chunk of an anchor together and in order."""
    lists = found.filter("edge").groupBy("d").agg(F.collect_list(F.struct("ah", "pos", "chunks")).alias("edges"))
    cut = _keyed(docs, id_col, text_col).join(lists, "d").mapInArrow(cut_slices(length), SLICE_SCHEMA)
    cut = cut.select("ah", F.pmod(F.hash("d", "pos"), F.col("chunks")).alias("part"), "d", "pos", "chunks", "slice")
    return cut.repartition("ah", "part").sortWithinPartitions("ah", "part", "d", "pos")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(ah, part, rank, d, at, repeats): all maximal repeats of at least `length` bytes with all occurrences.

    Suffixes of one (ah, part) are rows in order of rank. A struct (size, last) in a row's repeats is a group: `size`
    bytes that occur at the rows of ranks rank to last, preceded by differing bytes. One row a suffix, whatever the
    number of groups. Slices that equal an earlier one as a whole are not listed again; marks() has them.
    """
    return edge_slices(docs, marks(docs, id_col, text_col, length), id_col, text_col, length).mapInArrow(group_rows(length), "ah long, part int, rank long, d long, at long, repeats array<struct<size:int,last:long>>")


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (d, at, size) that cover every byte to remove; at holds the text's tag above START_BITS bits of start."""
    found = marks(docs, id_col, text_col, length)
    low = F.lit((1 << COUNT_BITS) - 1)
    start = F.shiftright("pos", COUNT_BITS)
    known = found.filter("NOT edge").select("d", start.alias("at"), (F.col("pos").bitwiseAND(low) + (length - 1)).cast("int").alias("size"))
    tree = edge_slices(docs, found, id_col, text_col, length).mapInArrow(repeat_rows(length), "d long, pos long, spans array<struct<start:int,size:int>>, firsts array<int>, slice binary")
    tree = written(tree, "tree")
    settled = tree.select("d", start.alias("at"), F.explode("spans").alias("span")).select("d", (F.col("at") + F.col("span.start")).alias("at"), "span.size")
    # firsts of the chunks of one anchor: a window of another chunk may come before
    windows = tree.filter("slice IS NOT NULL").select("d", "pos", "firsts", "slice").repartition("d", "pos").mapInArrow(window_rows(length), "h long, g long, d long, at long")
    earliest = windows.groupBy("h", "g").agg(F.min(F.struct("d", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g", "first")
    late = windows.hint("merge").join(earliest, ["h", "g"]).filter(F.struct("d", "at") != F.col("first")).select("d", "at", F.lit(length).alias("size"))
    return known.unionByName(settled).unionByName(late)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, whole: bool = False) -> DataFrame:
    """The columns of docs but text_col, and _n_bytes, _n_removed, _n_spans, _kept (the bytes left of the text, binary).

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document of smaller id or at an
    earlier place of the same one. Matches never cross documents. Null texts count as empty and a null id comes before
    all others; texts shorter than `length` are kept whole; rows that repeat an id with another text are ordered by a
    checksum of the text; rows that repeat id and text are one document and each get its result. Other columns pass as
    they are, whatever their names. whole: _kept loses the rest of a character of which a part is removed, so that it
    is UTF-8; the counts are those of the bytes removed as such.
    """
    spans = repeat_spans(docs, id_col, text_col, length)
    lists = spans.groupBy("d").agg(F.collect_list(F.struct("at", "size")).alias("_spans"))
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_own_{c}") for c in rest])
    joined = keyed.join(lists, "d", "left").drop("d")
    joined = joined.withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<at:bigint,size:int>>")))
    schema = T.StructType([*[T.StructField(f"_own_{c}", docs.schema[c].dataType) for c in rest], *[T.StructField(c, T.LongType()) for c in ("_n_bytes", "_n_removed", "_n_spans")], T.StructField("_kept", T.BinaryType())])
    out = joined.select(*[f"_own_{c}" for c in rest], "_text", "_spans").mapInArrow(strip_spans(whole), schema)
    return out.select(*[F.col(f"_own_{c}").alias(c) for c in rest], "_n_bytes", "_n_removed", "_n_spans", "_kept")
