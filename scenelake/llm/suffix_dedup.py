"""Removal of byte strings that an earlier document has too, by suffix sorting with bucket pointers.

A window is a string of LENGTH bytes. Equal windows have the same anchor: the smallest hash among the GRAM-byte
strings in them, the leftmost if several. So windows meet where their anchors do, and an anchor that only one
document has needs no more work. Neighbouring windows with one anchor travel as one string.

1. Documents are dealt into groups by a hash of doc_id and packed. Each group lists its anchors; a task per range of
   anchors tells the groups which of theirs occur in several documents.
2. Each group sends the distinct strings around those anchors, with the smallest and largest doc_id that has them. A
   task per range sorts all suffixes of its strings to LENGTH bytes: buckets of equal 8-byte strings first, then each
   bucket of several suffixes is refined by sorting on the bucket pointers 8, 16 and 18 bytes further on, whose
   latest values are used each time. A bucket's smallest doc_id covers its windows in all later documents.
3. Each group marks the covered bytes in its documents.

However many documents share a string, a group sends it once.

Defined results: a null text counts as empty; texts shorter than a window lose nothing; texts of any length are read
whole; rows that repeat a doc_id are equal in rank, so neither removes from the other; a row with a null doc_id
neither loses bytes nor makes others lose any; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.shingles import Powers, mixed
from scenelake.llm.tables import pieces_for, scratch, stored

#: Bytes of a repeated string.
LENGTH = 50
#: Bytes of an anchor.
GRAM = 16
#: Bytes that the first buckets agree in, and the offsets at which bucket pointers refine them: 8, 16, 32, 50 bytes.
FIRST = 8
OFFSETS = (8, 16, 18)
#: Bytes of text in a group of documents, ranges of anchors per group, and bytes of text in one vectorised pass.
GROUP = 4 << 20
RANGES = 4
SPAN = 1 << 18
#: Anchors listed, and bytes gathered, at a time.
LISTED = 1 << 19
GATHERED = 1 << 20
_PLACE = np.uint64((1 << 40) - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
_POWERS = Powers(0xD1342543DE82EF95)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; each is stored byte plane by byte plane, so that unused planes vanish."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype=np.int64).tobytes()
    return _ZIP.compress(head + b"".join(planes))


def unpacked(block: bytes, *kinds: type) -> list[np.ndarray]:
    raw = _UNZIP.decompress(block)
    lengths = np.frombuffer(raw, dtype=np.int64, count=len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def ascending(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as their differences."""
    return np.diff(values, prepend=np.uint64(0))


def words8(data: np.ndarray) -> np.ndarray:
    """At each byte the 8 bytes from there on as a number; zeros follow the end."""
    x = np.concatenate([data, np.zeros(7, dtype=np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64)
    x = words8(data)
    grams = x[: len(data) - GRAM + 1] * _C[0] + x[8 : len(data) - GRAM + 9] * _C[1]
    grams ^= grams >> np.uint64(32)
    grams *= _C[2]
    # The upper 24 bits rank the grams; with the place below them, ties go to the left.
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, wanted = 1, LENGTH - GRAM + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wanted:
        least = np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :])
    closed = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(closed, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(closed, offsets[1:], -1)
    windows = np.flatnonzero(np.cumsum(closed[:-1]) == 0)
    if not len(windows):
        return none, none, none.astype(np.uint64)
    place = (least[windows] & _PLACE).astype(np.int64)
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    # Chosen as the smallest, these hashes are all small; mixed once more they fill their ranges evenly.
    return windows[at], np.diff(at, append=len(windows)), mixed(grams[place[at]])


def spans(ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about SPAN bytes."""
    at = 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SPAN, side="right")) - 1)
        yield at, end
        at = end


def pack_documents(docs: DataFrame, groups: int) -> DataFrame:
    """Rows of (grp, docs): the ids, lengths and bytes of the documents of a group that one batch holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(2).to_numpy()
            for group in np.unique(number):
                rows = batch.filter(pa.array(number == group))
                texts = [(text or "").encode() for text in rows.column(1).to_pylist()]
                ids = rows.column(0)
                block = packed(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()).astype(np.uint8), np.array([len(t) for t in texts], dtype=np.int64),
                               np.frombuffer(b"".join(texts), dtype=np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([block], pa.binary())], ["grp", "docs"])

    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long")
    # A null doc_id takes no part; such rows are dealt out by their text.
    group = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(groups)).cast("long")).otherwise(group)
    return docs.select(F.col("doc_id").cast("long"), "text", group.alias("grp")).mapInArrow(run, "grp long, docs binary")


def documents(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, whether null, offsets and bytes of packed documents, in an order that does not depend on the blocks'."""
    parts = sorted(blocks)
    ids, null, sizes, data = (np.concatenate(x) for x in zip(*(unpacked(b, np.int64, np.uint8, np.int64, np.uint8) for b in parts), strict=True))
    return ids, null.astype(bool), np.concatenate([[0], np.cumsum(sizes)]), data


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def list_anchors(ranges: int):
    """Packed documents to (part, block): by range, the anchors of each group, and whether several documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for group, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                anchor, several = _group_anchors(*documents([block]))
                held.append((anchor, np.full(len(anchor), group), several))
                if sum(len(h[0]) for h in held) >= LISTED:
                    yield _by_range(held, ranges)
                    held = []
        if held:
            yield _by_range(held, ranges)

    return run


def _group_anchors(ids: np.ndarray, null: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors and whether several doc_ids have them."""
    hashes, owners = [], []
    for at, end in spans(ids, offsets):
        first, _, anchor = anchors(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        owner = np.searchsorted(offsets[at : end + 1] - offsets[at], first, side="right") - 1 + at
        hashes.append(anchor[~null[owner]])
        owners.append(ids[owner[~null[owner]]])
    anchor, owner = np.concatenate(hashes), np.concatenate(owners)
    if not len(anchor):
        return anchor, np.zeros(0, dtype=bool)
    order = np.argsort(anchor)
    anchor, owner = anchor[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[at], np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)


def _by_range(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    anchor, group, several = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(anchor)
    anchor, group, several = anchor[order], group[order], several[order]
    cuts = np.searchsorted(_range(anchor, ranges), np.arange(ranges + 1))
    parts = np.flatnonzero(np.diff(cuts))
    blocks = [packed(ascending(anchor[s]), group[s].astype(np.int64), several[s].astype(np.uint8)) for p in parts for s in [slice(cuts[p], cuts[p + 1])]]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blocks, pa.binary())], ["part", "block"])


def shared_anchors(table: pa.Table) -> pa.Table:
    """For one range of anchors: to each group those of its anchors that occur in several documents."""
    lists = [unpacked(block, np.uint64, np.int64, np.uint8) for block in table.column("block").to_pylist()]
    anchor = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists])
    group, many = np.concatenate([x[1] for x in lists]), np.concatenate([x[2] for x in lists]).astype(bool)
    order = np.argsort(anchor)
    anchor, many, group = anchor[order], many[order], group[order]
    at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(at, append=len(anchor))
    # Entries of one anchor come from different documents, or from one that is marked.
    good = np.repeat((sizes > 1) | np.logical_or.reduceat(many, at), sizes)
    anchor, group = anchor[good], group[good]
    order = np.lexsort((anchor, group))
    anchor, group = anchor[order], group[order]
    names, starts = np.unique(group, return_index=True)
    blocks = [packed(ascending(np.unique(own))) for own in np.split(anchor, starts[1:])] if len(names) else []
    return pa.table({"grp": pa.array(names, pa.int64()), "kind": pa.array([0] * len(names), pa.int32()), "part": pa.array([table.column("part")[0].as_py()] * len(names), pa.int64()),
                     "block": pa.array(blocks, pa.binary())})


class Strings:
    """The strings around shared anchors in a group's documents, occurrence by occurrence, and the distinct ones."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, offsets: np.ndarray, data: np.ndarray, shared: np.ndarray, ranges: int, content: bool) -> None:
        found: list[tuple[np.ndarray, ...]] = []
        texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, end in spans(ids, offsets):
            part = data[offsets[at] : offsets[end]]
            first, n, anchor = anchors(part, offsets[at : end + 1] - offsets[at])
            owner = np.searchsorted(offsets[at : end + 1] - offsets[at], first, side="right") - 1 + at
            spot = np.minimum(np.searchsorted(shared, anchor), max(len(shared) - 1, 0))
            good = (shared[spot] == anchor) & ~null[owner] if len(shared) else np.zeros(len(anchor), dtype=bool)
            first, n, anchor, owner = first[good], n[good], anchor[good], owner[good]
            key = keys(part, first, n)
            found.append((key, anchor, first + offsets[at], n, owner))
            if content:
                own, where = np.unique(key, return_index=True)
                texts.append((own, n[where], gathered(part, first[where], n[where] + LENGTH - 1)))
        self.key, anchor, self.first, self.n, self.owner = (np.concatenate(x) for x in zip(*found, strict=True))
        self.distinct, where, self.item = np.unique(self.key, return_index=True, return_inverse=True)
        # Distinct strings by range of their anchors, then by key.
        part = _range(anchor[where], ranges)
        order = np.lexsort((self.distinct, part))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.distinct, self.item = self.distinct[order], place[self.item]
        self.cuts = np.searchsorted(part[order], np.arange(ranges + 1))
        self.windows = self.n[where][order]
        self.low = np.full(len(order), np.iinfo(np.int64).max)
        self.high = np.full(len(order), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.item, ids[self.owner])
        np.maximum.at(self.high, self.item, ids[self.owner])
        if content and len(order):
            own, sizes = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]) + LENGTH - 1
            whole = np.concatenate([t[2] for t in texts])
            own, where = np.unique(own, return_index=True)
            where = where[np.searchsorted(own, self.distinct)]
            self.text = gathered(whole, (np.cumsum(sizes) - sizes)[where], sizes[where])
            self.ends = np.cumsum(sizes[where])


def keys(data: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the string that each run of windows covers."""
    up, down = _POWERS.to(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mixed((prefix[first + windows + LENGTH - 1] - prefix[first]) * down[first] + windows.astype(np.uint64) * _C[0])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``data`` one after the other."""
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=data.dtype)
    at = 0
    while at < len(sizes):
        begin = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + GATHERED, side="right")))
        out[begin : ends[to - 1]] = data[expanded(starts[at:to], sizes[at:to])]
        at = to
    return out


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def refined(data: np.ndarray) -> np.ndarray:
    """Bucket pointers of all positions after sorting suffixes to LENGTH bytes.

    A pointer is the place in suffix order where the bucket starts. Pointers of positions whose string runs beyond
    the data are of no use.
    """
    key = words8(data)
    order = np.argsort(key, kind="stable")
    value = key[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(start, append=len(value))
    pointer = np.empty(len(data), dtype=np.uint64)
    pointer[order] = np.repeat(start, sizes).astype(np.uint64)
    active = order[np.repeat(sizes > 1, sizes)]
    for offset in OFFSETS:
        if not len(active):
            break
        later = pointer[np.minimum(active + offset, len(data) - 1)]
        both = (pointer[active] << np.uint64(32)) | later
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        old = both >> np.uint64(32)
        bucket = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        sizes = np.diff(start, append=len(both))
        begun = bucket[np.searchsorted(bucket, start, side="right") - 1]
        pointer[active] = np.repeat(old[start] + (start - begun).astype(np.uint64), sizes)
        active = active[np.repeat(sizes > 1, sizes)]
    return pointer


def cover(table: pa.Table) -> pa.Table:
    """For one range of anchors: to each group the windows of its strings that a smaller doc_id has, and which."""
    rows = [unpacked(block, np.uint8, np.uint8, np.int64, np.int64) for block in table.column("block").to_pylist()]
    text, windows, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
    windows = windows.astype(np.int64)
    sizes = windows + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    key, where, item = np.unique(keys(text, starts, windows), return_index=True, return_inverse=True)
    own = gathered(text, starts[where], sizes[where])
    del text
    own_windows, own_starts = windows[where], np.cumsum(sizes[where]) - sizes[where]
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, item, low)
    # All windows of the distinct strings, and the smallest doc_id of the bucket that each falls into.
    window = expanded(own_starts, own_windows)
    pointer = refined(own)[window].astype(np.int64)
    smallest = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(smallest, pointer, np.repeat(least, own_windows))
    smallest = smallest[pointer]
    # Runs of windows of one string with one smallest doc_id.
    place = expanded(np.zeros(len(key), dtype=np.int64), own_windows)
    new = np.flatnonzero((place == 0) | np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    last = np.append(new[1:], len(place)) - 1
    string = np.repeat(np.arange(len(key)), own_windows)[new]
    runs = np.searchsorted(string, np.arange(len(key) + 1))
    # Of each sent string the runs that matter to some document that has it.
    count = np.diff(runs)[item]
    run = expanded(runs[:-1][item], count)
    sent = np.repeat(np.arange(len(item)), count)
    useful = smallest[new[run]] < high[sent]
    run, sent = run[useful], sent[useful]
    begins = np.cumsum([0, *(len(r[1]) for r in rows)])
    cuts = np.searchsorted(sent, begins)
    groups, blocks = [], []
    for number, group in enumerate(table.column("grp").to_pylist()):
        part = slice(cuts[number], cuts[number + 1])
        if cuts[number] < cuts[number + 1]:
            groups.append(group)
            blocks.append(packed((sent[part] - begins[number]).astype(np.uint32), place[new[run[part]]].astype(np.uint8), place[last[run[part]]].astype(np.uint8), smallest[new[run[part]]]))
    return pa.table({"grp": pa.array(groups, pa.int64()), "kind": pa.array([1] * len(groups), pa.int32()), "part": pa.array([table.column("part")[0].as_py()] * len(groups), pa.int64()),
                     "block": pa.array(blocks, pa.binary())})


def _shared(table: pa.Table) -> np.ndarray:
    lists = [np.cumsum(unpacked(b, np.uint64)[0], dtype=np.uint64) for b, kind in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), strict=True) if kind == 0]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.uint64)


def send_strings(ranges: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        parts: list[tuple[int, int, bytes]] = []
        if docs.num_rows and told.num_rows:
            s = Strings(*documents(docs.column("docs").to_pylist()), _shared(told), ranges, content=True)
            for p in np.flatnonzero(np.diff(s.cuts)):
                a, b = s.cuts[p], s.cuts[p + 1]
                text = s.text[s.ends[a - 1] if a else 0 : s.ends[b - 1]]
                parts.append((int(p), docs.column("grp")[0].as_py(), packed(text, s.windows[a:b].astype(np.uint8), s.low[a:b], s.high[a:b])))
        return pa.table({"part": pa.array([p[0] for p in parts], pa.int64()), "grp": pa.array([p[1] for p in parts], pa.int64()), "block": pa.array([p[2] for p in parts], pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, last: long>>"


def mark(ranges: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()),
                             "kept_sha256": pa.array([], pa.string()), "spans": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))})
        ids, null, offsets, data = documents(docs.column("docs").to_pylist())
        change = np.zeros(len(data) + 1, dtype=np.int32)
        if told.num_rows:
            s = Strings(ids, null, offsets, data, _shared(told), ranges, content=False)
            told_runs = [(p, unpacked(b, np.uint32, np.uint8, np.uint8, np.int64)) for b, kind, p in
                         zip(told.column("block").to_pylist(), told.column("kind").to_pylist(), told.column("part").to_pylist(), strict=True) if kind == 1]
            if told_runs:
                item = np.concatenate([runs[0].astype(np.int64) + s.cuts[p] for p, runs in told_runs])
                first, last, smallest = (np.concatenate([runs[i] for _, runs in told_runs]) for i in (1, 2, 3))
                order = np.argsort(item, kind="stable")
                item, first, last, smallest = item[order], first[order].astype(np.int64), last[order].astype(np.int64), smallest[order]
                cuts = np.searchsorted(item, np.arange(len(s.distinct) + 1))
                count = np.diff(cuts)[s.item]
                ends, at = np.cumsum(count), 0
                while at < len(count):  # some strings occur often and have many runs: a bounded number of them at a time
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + LISTED, side="right")))
                    run_ = expanded(cuts[:-1][s.item[at:to]], count[at:to])
                    where = np.repeat(np.arange(at, to), count[at:to])
                    hit = smallest[run_] < ids[s.owner[where]]
                    run_, where = run_[hit], where[hit]
                    np.add.at(change, s.first[where] + first[run_], 1)
                    np.add.at(change, s.first[where] + last[run_] + LENGTH, -1)
                    at = to
        gone = np.cumsum(change[:-1]) > 0
        rows = []
        for i in range(len(ids)):
            own, lost = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
            edge = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0))
            rows.append((None if null[i] else int(ids[i]), len(own), int(lost.sum()), len(edge) // 2, hashlib.sha256(own[~lost].tobytes()).hexdigest(),
                         [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    return run


def repeated_strings(docs: DataFrame, group_bytes: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of bytes (first and last)."""
    folder = scratch(docs.sparkSession, "suffixes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    groups = pieces_for(total, group_bytes)
    ranges = RANGES * groups
    texts = stored(pack_documents(docs, groups), f"{folder}/documents")
    lists = texts.mapInArrow(list_anchors(ranges), "part long, block binary")
    told = "grp long, kind int, part long, block binary"
    shared = stored(lists.groupBy("part").applyInArrow(shared_anchors, told), f"{folder}/shared")
    strings = texts.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(send_strings(ranges), "part long, grp long, block binary")
    covered = strings.groupBy("part").applyInArrow(cover, told)
    return texts.groupBy("grp").cogroup(shared.unionByName(covered).groupBy("grp")).applyInArrow(mark(ranges), RESULT)
