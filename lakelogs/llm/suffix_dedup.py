"""Suffix-array dedup over bytes: common-prefix interval trees, built in cells that share an anchor.

Two equal strings of ``length`` bytes pick the same anchor, the K bytes in them with the smallest hash, at the same place
(a minimizer). So all suffixes that can share ``length`` bytes meet in the cell of one anchor, and no suffix array
of the whole corpus is needed. The stretch of windows (strings of ``length`` bytes) that have an anchor in common is a
segment of at most 2 * length - K bytes.

1. Texts are dealt by a hash of doc_id and text into chunks of about 8 MB, one shuffle that all later steps reuse; so no doc_id,
   null or repeated, fills a chunk (only a row that is repeated as a whole does).
2. Each chunk sends its different anchors, sorted and delta-coded, to buckets of the hash space; a bucket answers each
   chunk with a bit for each anchor: does another chunk have it? An anchor in a third of all texts costs a chunk one entry.
3. For shared anchors each chunk sends its different segments with their smallest doc_id, again once however often they occur.
4. A bucket merges equal segments. Where an anchor has different ones, it sorts their suffixes and takes neighbours' longest
   common prefixes; a stack scan yields the common-prefix intervals of ``length`` bytes or more, and those whose
   occurrences differ in the byte before (or begin a segment) are the maximal repeat groups, with all occurrences. The smallest
   doc_id of a group tells which windows of which segments are repeats of an earlier document.
5. Each chunk applies the answers to its own texts.

An anchor with over HOT_SEGMENTS segments in all chunks (a phrase shorter than ``length`` amid ever different words) has no
tree: its segments' windows are keyed by their 64-bit hashes and dealt over all buckets by them, a chunk sending of each
window those places only that belong to its smallest doc_id there, so neither the phrase nor a common window meets in one task.

``repeat_groups`` returns the groups themselves, every occurrence with its document and offset. Groups are maximal in
their cell: a repeat longer than a cell appears as a chain of groups, each shifted, with the same documents.

Edges: a null or empty text has no bytes; rows with equal doc_id never remove from each other and are all reported;
a null doc_id is before all others; texts shorter than ``length`` have no windows; an empty table gives an empty
result; other columns are not looked at. Anchors and equal segments are told apart by 64-bit hashes; different segments by bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelogs.llm.common import CHUNK_BYTES, chunk_of, eight_bytes, mix, ragged, range_hash, read_table, stretch_hash, string_views, text_bytes

LENGTH = 50
K = 24
#: An anchor with more segments (counted in powers of two a chunk) is cut by windows instead of a tree.
HOT_SEGMENTS = 20_000
STARTS = 1 << 17  # window starts that are handled together, so that their arrays stay in a core's cache
NULL_ID = np.iinfo(np.int64).min
_POS = np.uint64(0xFFFFFF)
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class Entries:
    """Segments of a chunk: windows lo..hi (starts) that share an anchor, its hash, and the row of the text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, k: int):
        parts = [self._some(data, offsets, s, min(s + STARTS, len(data)), length, k) for s in range(0, len(data), STARTS)]
        self.lo, self.hi, self.at, self.key = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else [()] * 4, (np.int64, np.int64, np.int64, np.uint64), strict=True))
        self.row = np.searchsorted(offsets, self.lo, "right") - 1
        self.size = self.hi - self.lo + length

    @staticmethod
    def _some(data, offsets, first, last, length, k):
        part = data[first : last + length - 1]
        w, n = length - k + 1, len(part) - length + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none.astype(np.uint64)
        eight = eight_bytes(part)
        m = len(part) - k + 1
        x = eight[:m] * _C[0]
        for j in range(1, k // 8):
            x += eight[8 * j : 8 * j + m] * _C[j]
        x = mix(x)
        low = (x & ~_POS) | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        anchor = (low & _POS).astype(np.int64)
        fits = np.ones(n, bool)  # the window ends inside its text
        ends = offsets[1:][(offsets[1:] > first) & (offsets[1:] < first + n + length)] - first
        late = ragged(ends - length + 1, np.full(len(ends), length - 1))
        fits[late[(late >= 0) & (late < n)]] = False
        at = np.flatnonzero(fits)
        if not len(at):
            return none, none, none, none.astype(np.uint64)
        a = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        lo, hi, where = at[begin], at[np.append(begin[1:], len(at)) - 1], a[begin]
        return lo + first, hi + first, where + first, mix(x[where] ^ _C[4])


class Chunk:
    """The texts of a chunk in a fixed order, with their entries and the classes of equal segments."""

    def __init__(self, table: pa.Table, length: int, k: int):
        ids = table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NULL_ID)
        ids = ids.to_numpy() if not isinstance(ids, pa.ChunkedArray) else ids.to_numpy()
        self.data, self.offsets = string_views(table.column("text"))
        order = np.lexsort((stretch_hash(self.data, self.offsets[:-1], self.offsets[1:])[:, 0], ids))  # the same each time
        if not np.array_equal(order, np.arange(len(order))):
            sizes = np.diff(self.offsets)[order]
            self.data = self.data[ragged(self.offsets[:-1][order], sizes)]
            self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.ids = ids[order]
        self.e = Entries(self.data, self.offsets, length, k)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors, sorted, and for each the power of two that its number of entries doesn't exceed."""
        keys = np.sort(self.e.key)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        return keys[first], np.ceil(np.log2(np.diff(first, append=len(keys)))).astype(np.uint8)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each entry its class of equal segments; for each class its first entry, of the smallest doc_id (rows are in that order)."""
        e = self.e
        same = mix(range_hash(eight_bytes(self.data), e.lo, e.size, 7) ^ mix(e.key + (e.at - e.lo).astype(np.uint64)))
        _, first, cls = np.unique(same, return_index=True, return_inverse=True)
        return cls, first


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, their bytes place by place: the upper places are nearly all zero and compress."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(code: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(code, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


# --- 2: which anchors do chunks share -----------------------------------------------------------------------


def _send_anchors(table: pa.Table, buckets: int, length: int, k: int) -> pa.Table:
    keys, powers = Chunk(table, length, k).anchors()
    to = bucket_of(keys, buckets)
    own, first = np.unique(to, return_index=True)
    chunk = table.column("chunk")[0].as_py()
    cut = lambda x, code: _binary([code(p) for p in np.split(x, first[1:])] if len(own) else [])
    return pa.table({"bucket": pa.array(own), "chunk": pa.array(np.full(len(own), chunk)), "code": cut(keys, _planes), "powers": cut(powers, np.ndarray.tobytes)})


def _answer_anchors(table: pa.Table, hot: int) -> pa.Table:
    """For each chunk's anchors a bit, does another chunk have it; and the places of those that are hot."""
    table = table.combine_chunks()
    lists = [_unplanes(c) for c in table.column("code").to_pylist()]
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][again]] = True
    shared[order[:-1][again]] = True
    entries = np.int64(1) << np.concatenate([np.frombuffer(c, np.uint8) for c in table.column("powers").to_pylist()]).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], ~again)))
    many = np.zeros(len(keys), bool)
    many[order] = np.repeat(np.add.reduceat(entries[order], first) > hot, np.diff(first, append=len(keys)))
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "code": _binary([np.packbits(p).tobytes() for p in np.split(shared, cuts)]), "hot": _binary([np.flatnonzero(p).tobytes() for p in np.split(many, cuts)])})


def _shared_keys(chunk: Chunk, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's anchors that another chunk has as well, and those that are hot."""
    keys, _ = chunk.anchors()
    own, first, n = np.unique(bucket_of(keys, buckets), return_index=True, return_counts=True)
    flags = np.zeros(len(keys), bool)
    hot = [np.zeros(0, np.int64)]
    by_bucket = dict(zip(answers.column("bucket").to_pylist(), zip(answers.column("code").to_pylist(), answers.column("hot").to_pylist(), strict=True), strict=True))
    for b, at, count in zip(own.tolist(), first.tolist(), n.tolist(), strict=True):
        flags[at : at + count] = np.unpackbits(np.frombuffer(by_bucket[b][0], np.uint8), count=count).view(bool)
        hot.append(np.frombuffer(by_bucket[b][1], np.int64) + at)
    return keys[flags], keys[np.concatenate(hot)]


# --- 3: segments of shared anchors --------------------------------------------------------------------------

#: What a code holds: segments; windows of hot anchors (hash, doc_id, class * 64 + start in it); or such starts that are repeats already.
SEGMENTS, WINDOWS, OWN = range(3)
_FIELDS = (("key", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("left", "u1"), ("size", "u1"))


def _pack_segments(chunk: Chunk, pick: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, code) of the picked entries, if there are any; place is what an answer names an entry by."""
    if not len(pick):
        return
    e = chunk.e
    order = np.argsort(e.key[pick], kind="stable")
    pick, place = pick[order], place[order]
    own, first = np.unique(bucket_of(e.key[pick], buckets), return_index=True)
    for b, i, j in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(pick)], strict=True):
        p = pick[i:j]
        cols = {"key": e.key[p], "doc": chunk.ids[e.row[p]], "place": place[i:j], "left": e.at[p] - e.lo[p], "size": e.size[p]}
        yield b, b"".join((np.int64(len(p)).tobytes(), *(cols[n].astype(t).tobytes() for n, t in _FIELDS), chunk.data[ragged(e.lo[p], e.size[p])].tobytes()))


def _unpack_segments(codes: list[bytes]) -> dict[str, np.ndarray]:
    cols: dict[str, list] = {n: [] for n, _ in _FIELDS} | {"bytes": [], "of": []}
    for k, code in enumerate(codes):
        n, at = int(np.frombuffer(code, "<i8", 1)[0]), 8
        for name, kind in _FIELDS:
            cols[name].append(np.frombuffer(code, kind, n, at))
            at += n * np.dtype(kind).itemsize
        cols["bytes"].append(np.frombuffer(code, np.uint8, -1, at))
        cols["of"].append(np.full(n, k))
    out = {n: np.concatenate(x) for n, x in cols.items()}
    out["size"] = out["size"].astype(np.int64)
    out["start"] = np.cumsum(out["size"]) - out["size"]
    return out


def _send_windows(chunk: Chunk, place: np.ndarray, pick: np.ndarray, buckets: int, length: int) -> Iterator[tuple[int, bytes, int]]:
    """The windows of hot segments (place: class, pick: its first entry), at most 64 each, as (bucket, code, kind)."""
    e = chunk.e
    n = e.size[pick] - length + 1
    of = np.repeat(np.arange(len(pick)), n)
    inside = ragged(np.zeros(len(n), np.int64), n)
    key = range_hash(eight_bytes(chunk.data), e.lo[pick][of] + inside, np.full(len(of), length), 13)
    doc, at = chunk.ids[e.row[pick]][of], place[of] * 64 + inside
    order = np.lexsort((doc, key))
    key, doc, at = key[order], doc[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lead = doc == np.repeat(doc[first], np.diff(first, append=len(key)))
    # What an earlier document of this chunk has needs no bucket; it only passes through one.
    yield int(bucket_of(key[:1], buckets)[0]), at[~lead].tobytes(), OWN
    key, doc, at = key[lead], doc[lead], at[lead]
    own, first = np.unique(bucket_of(key, buckets), return_index=True)
    for b, i, j in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
        yield b, np.stack((key[i:j].view(np.int64), doc[i:j], at[i:j])).tobytes(), WINDOWS


def _send_segments(chunk: Chunk, shared: np.ndarray, hot: np.ndarray, buckets: int, length: int, occurrences: bool) -> pa.Table:
    e = chunk.e
    rows = []
    cls, first = chunk.classes()
    if occurrences:
        # Every entry whose anchor another entry has, here or elsewhere.
        _, inverse, n = np.unique(e.key, return_inverse=True, return_counts=True)
        pick = np.flatnonzero((n[inverse] > 1) | np.isin(e.key, shared))
        place = e.lo[pick] - chunk.offsets[e.row[pick]]
    else:
        # A class, if another chunk has its anchor, or another class and document of this chunk.
        keys, inverse, n = np.unique(e.key[first], return_inverse=True, return_counts=True)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), NULL_ID)
        of_key = inverse[cls]
        np.minimum.at(low, of_key, e.row)
        np.maximum.at(high, of_key, e.row)
        place = np.flatnonzero(((n > 1) & (low < high))[inverse] | np.isin(e.key[first], shared))
        many = np.isin(e.key[first[place]], hot)
        if many.any():
            rows = list(_send_windows(chunk, place[many], first[place[many]], buckets, length))
            place = place[~many]
        pick = first[place]
    rows += [(b, c, SEGMENTS) for b, c in _pack_segments(chunk, pick, place, buckets)]
    return pa.table({"bucket": pa.array([b for b, _, _ in rows], pa.int64()), "code": _binary([c for _, c, _ in rows]), "kind": pa.array([k for _, _, k in rows], pa.int64())})


# --- 4: the interval trees ----------------------------------------------------------------------------------


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(group, kind="stable")
    new = np.ones(len(group), bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    return order, np.flatnonzero(new)


def interval_groups(text: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, cell: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes text[start:end] of segments that begin at ``begin`` -> maximal repeats of ``least`` bytes or more, as
    (depths, bounds into members, members): an enhanced suffix array in each cell, scanned with a stack."""
    width = -(-int((end - start).max(initial=1)) // 8) * 8
    padded = np.concatenate((text, np.zeros(width, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    rows[np.arange(width) >= (end - start)[:, None]] = 0
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((end - start, *keys.T[::-1], cell))
    rows, start, end, begin, cell = rows[order], start[order], end[order], begin[order], cell[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.where(cell[1:] == cell[:-1], np.minimum(lcp[1:], np.minimum(end[1:] - start[1:], end[:-1] - start[:-1])), 0)
    # The byte before, or a sign of its own where a segment begins.
    before = np.where(start > begin, padded[np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    out = []
    deep = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for k, depth in enumerate([*lcp[a:b].tolist(), 0]):
            left = a + k - 1
            while stack and stack[-1][0] > depth:
                d, left = stack.pop()
                if changes[a + k - 1] > changes[left]:
                    out.append((d, left, a + k - 1))
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))
    depth, left, right = np.array(out, np.int64).reshape(-1, 3).T
    sizes = right - left + 1
    return depth, np.concatenate(([0], np.cumsum(sizes))), order[ragged(left, sizes)]


def _tree_groups(s: dict[str, np.ndarray], pick: np.ndarray, cell: np.ndarray, length: int, batch: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Interval groups of the picked segments, cell by cell: (depths, bounds, members' segments, members' starts in them)."""
    windows = s["size"][pick] - length + 1
    order, first = _by_group(cell)
    upto = np.cumsum(windows[order])
    at = 0
    while at < len(first):
        done = upto[first[at] - 1] if first[at] else 0
        nxt = max(at + 1, int(np.searchsorted(np.append(upto[first[1:] - 1], upto[-1]), done + batch, "right")))
        mine = order[first[at] : first[nxt] if nxt < len(first) else len(order)]
        seg = pick[mine]
        n = windows[mine]
        inside = ragged(np.zeros(len(n), np.int64), n)
        of = np.repeat(np.arange(len(n)), n)
        begin = s["start"][seg][of]
        depth, bounds, members = interval_groups(s["bytes"], begin + inside, begin + s["size"][seg][of], begin, cell[mine][of], length)
        yield depth, bounds, seg[of[members]], inside[members]
        at = nxt


def _cells(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of anchors, and numbers of equal segments."""
    _, cell = np.unique(s["key"], return_inverse=True)
    same = mix(range_hash(eight_bytes(s["bytes"]), s["start"], s["size"], 11) ^ mix(s["key"] + s["left"].astype(np.uint64)))
    _, equal = np.unique(same, return_inverse=True)
    return cell, equal


def _full(size: np.ndarray, length: int) -> np.ndarray:
    return (np.uint64(1) << (size - length + 1).astype(np.uint64)) - np.uint64(1)


def _as_bits(at: np.ndarray) -> bytes:
    return np.stack(((at >> 6).astype(np.uint64), np.uint64(1) << (at & 63).astype(np.uint64))).tobytes()


def _answer_windows(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(chunk, code) of the windows of hot anchors that an earlier document has."""
    parts = [np.frombuffer(c, np.int64).reshape(3, -1) for c in table.column("code").to_pylist()]
    key, doc, at = np.concatenate(parts, axis=1)
    chunk = np.repeat(table.column("chunk").to_numpy(), [p.shape[1] for p in parts])
    order = np.lexsort((doc, key))
    first = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
    late = order[doc[order] > np.repeat(doc[order[first]], np.diff(first, append=len(order)))]
    late = late[np.argsort(chunk[late], kind="stable")]
    own, first = np.unique(chunk[late], return_index=True)
    for c, mine in zip(own.tolist(), np.split(late, first[1:]), strict=bool(len(own))):
        yield c, _as_bits(at[mine])


def _answer_segments(table: pa.Table, length: int) -> pa.Table:
    """For each segment the windows that an earlier document has, as bits; a class may have several answers."""
    table = table.combine_chunks()
    kind = table.column("kind").to_numpy()
    of_kind = lambda k: table.filter(pa.array(kind == k))
    rows = [(c, _as_bits(np.frombuffer(x, np.int64))) for c, x in zip(of_kind(OWN).column("chunk").to_pylist(), of_kind(OWN).column("code").to_pylist(), strict=True)]
    rows += _answer_windows(of_kind(WINDOWS)) if (kind == WINDOWS).any() else []
    rows += _answer_trees(of_kind(SEGMENTS), length) if (kind == SEGMENTS).any() else []
    return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "code": _binary([x for _, x in rows])})


def _answer_trees(table: pa.Table, length: int) -> list[tuple[int, bytes]]:
    table = table.combine_chunks()
    s = _unpack_segments(table.column("code").to_pylist())
    cell, equal = _cells(s)
    n = equal.max(initial=-1) + 1
    order = np.argsort(s["doc"], kind="stable")[::-1]
    first = np.zeros(n, np.int64)
    first[equal[order]] = order  # of each kind of segment the one with the smallest doc_id
    kinds = np.bincount(cell[first], minlength=cell.max(initial=-1) + 1)
    bits = np.zeros(len(equal), np.uint64)
    pick = first[kinds[cell[first]] > 1]
    if len(pick):
        for depth, bounds, seg, inside in _tree_groups(s, pick, cell[pick], length):
            if len(depth):
                doc = s["doc"][seg]
                earliest = np.repeat(np.minimum.reduceat(doc, bounds[:-1]), np.diff(bounds))
                late = doc > earliest
                depths = np.repeat(depth, np.diff(bounds))[late]
                np.bitwise_or.at(bits, seg[late], _full(depths, length) << inside[late].astype(np.uint64))
    bits = np.where(s["doc"] > s["doc"][first[equal]], _full(s["size"], length), bits[first[equal]])
    chunks = table.column("chunk").to_pylist()
    out: dict[int, list[bytes]] = {}
    for k, c in enumerate(chunks):
        mine = np.flatnonzero((s["of"] == k) & (bits > 0))
        if len(mine):
            out.setdefault(c, []).append(np.stack((s["place"][mine].astype(np.uint64), bits[mine])).tobytes())
    return [(c, y) for c, x in out.items() for y in x]


def _answer_groups(table: pa.Table, length: int) -> pa.Table:
    """The maximal repeat groups with all occurrences."""
    s = _unpack_segments(table.combine_chunks().column("code").to_pylist())
    cell, _ = _cells(s)
    rows = []
    for depth, bounds, seg, inside in _tree_groups(s, np.arange(len(cell)), cell, length):
        k = np.repeat(np.arange(len(depth)), np.diff(bounds))
        head = bounds[:-1][k]
        group = mix(s["key"][seg[head]] ^ mix((depth[k] * 1024 + inside[head]).astype(np.uint64) + (seg[head].astype(np.uint64) << np.uint64(24))))
        rows.append((group.view(np.int64), depth[k], s["doc"][seg], s["place"][seg] + inside))
    g, d, doc, start = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
    return pa.table({"group": pa.array(g), "length": pa.array(d), "doc_id": pa.array(doc, mask=doc == NULL_ID), "start": pa.array(start)})


# --- 5: apply -----------------------------------------------------------------------------------------------

REMOVAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _apply(chunk: Chunk, answers: pa.Table, length: int) -> pa.Table:
    e, size = chunk.e, len(chunk.data)
    cls, first = chunk.classes()
    bits = np.zeros(len(first), np.uint64)
    for code in answers.column("code").to_pylist():
        place, b = np.frombuffer(code, np.uint64).reshape(2, -1)
        np.bitwise_or.at(bits, place.astype(np.int64), b)
    marks = np.zeros(size + 1, np.int32)
    later = chunk.ids[e.row] > chunk.ids[e.row[first]][cls]
    np.add.at(marks, e.lo[later], 1)
    np.add.at(marks, (e.hi + length)[later], -1)
    some = np.flatnonzero(~later & (bits[cls] > 0))
    mine = bits[cls[some]]
    for j in range(int((e.hi - e.lo).max(initial=-1)) + 1):
        at = e.lo[some[(mine >> np.uint64(j)) & np.uint64(1) > 0]] + j
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
    gone = np.cumsum(marks[:-1]) > 0
    border = np.zeros(size + 1, bool)
    border[chunk.offsets] = True
    starts = np.flatnonzero(gone & (border[:-1] | ~np.concatenate(([False], gone[:-1]))))
    ends = np.flatnonzero(gone & (border[1:] | ~np.concatenate((gone[1:], [False])))) + 1
    upto = np.concatenate(([0], np.cumsum(gone)))
    removed = upto[chunk.offsets[1:]] - upto[chunk.offsets[:-1]]
    kept, cut = memoryview(chunk.data[~gone].tobytes()), chunk.offsets - upto[chunk.offsets]
    sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    at = np.searchsorted(starts, chunk.offsets)
    spans = [np.stack((starts[a:b] - o, ends[a:b] - o), axis=1).astype("<i8").tobytes() for a, b, o in zip(at[:-1].tolist(), at[1:].tolist(), chunk.offsets[:-1].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(chunk.ids, mask=chunk.ids == NULL_ID), "n_bytes": pa.array(np.diff(chunk.offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(at)), "kept_sha256": pa.array(sha, pa.string()), "spans": _binary(spans)})


class _Plan:
    """The shuffles up to the segments, for removal and for groups."""

    def __init__(self, docs: DataFrame, length: int, k: int, chunk_bytes: int, occurrences: bool, hot: int = HOT_SEGMENTS):
        if k % 8 or not 8 <= k <= 32 or not k < length <= k + 63 or 2 * length - k > 255:
            raise ValueError("k is 8, 16, 24 or 32; length is above k, by 63 at most, and 2 * length - k is 255 at most")
        chunks = buckets = max(1, math.ceil(text_bytes(docs) / chunk_bytes))
        self.docs = docs.select("doc_id", "text", chunk_of(F.xxhash64("doc_id", "text"), chunks).alias("chunk"))
        sent = self.docs.groupBy("chunk").applyInArrow(lambda t: _send_anchors(t, buckets, length, k), "bucket long, chunk long, code binary, powers binary")
        answers = sent.groupBy("bucket").applyInArrow(lambda t: _answer_anchors(t, hot), "chunk long, bucket long, code binary, hot binary")

        def send(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "code": _binary([]), "kind": pa.array([], pa.int64())})
            chunk = Chunk(texts, length, k)
            out = _send_segments(chunk, *_shared_keys(chunk, answers, buckets), buckets, length, occurrences)
            return pa.table({"bucket": out.column("bucket"), "chunk": pa.array(np.full(out.num_rows, key[0].as_py(), np.int64)), "code": out.column("code"), "kind": out.column("kind")})

        self.segments = self.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send, "bucket long, chunk long, code binary, kind long")


def repeat_groups(docs: DataFrame, length: int = LENGTH, k: int = K, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents -> (group, length, doc_id, start): maximal repeats within their cells, a row for each occurrence; start in bytes."""
    segments = _Plan(docs, length, k, chunk_bytes, True).segments
    return segments.groupBy("bucket").applyInArrow(lambda t: _answer_groups(t, length), "group long, length long, doc_id long, start long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT_SEGMENTS) -> DataFrame:
    """Documents -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row a document. spans: the removed
    runs as little-endian int64 pairs (start, end) of byte offsets."""
    plan = _Plan(docs, length, k, chunk_bytes, False, hot)
    answers = plan.segments.groupBy("bucket").applyInArrow(lambda t: _answer_segments(t, length), "chunk long, code binary")

    def apply(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        return _apply(Chunk(texts, length, k), answers, length)

    return plan.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, REMOVAL)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS rank, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, rank, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT r, rank, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
f AS (SELECT s, min(rank) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM w JOIN f ON w.s = f.s WHERE rank > first),
p AS (SELECT g.r, sum(least(50, coalesce(next - i, 50)))::BIGINT AS n_removed, count(*) FILTER (prev IS NULL OR i - prev > 50) AS n_spans, max(i) + 50 AS tail,
        string_agg(substr(x, 2 * coalesce(prev + 50, 0) + 1, 2 * (i - coalesce(prev + 50, 0))), '' ORDER BY i) FILTER (prev IS NULL OR i - prev > 50) AS kept
      FROM g JOIN d ON g.r = d.r GROUP BY g.r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN p.r IS NULL THEN x ELSE kept || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN p ON d.r = p.r
"""


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")
