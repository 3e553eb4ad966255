"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints are 64 bits: bit i is 1 if it is set in over half of the XXH64 values (seed 42) of the
document's shingles, of 3 words by default. Equal fingerprints are merged first (count and smallest doc_id, combined
before the shuffle), so copies never meet as pairs.

Two fingerprints at distance d agree on at least one of d + 1 bit blocks, so each is sent once per block
to the group that shares the block. A group that is too large to search in one task is cut again by the
blocks of the bits that are still free; after two cuts at most 2**20 different fingerprints can share a
group, so no task's work is unbounded and no pair is lost. Within a task the fingerprints are sorted
by Gray rank and an index is built over them: each node covers a run of the order and holds the bit
pattern that its run shares (pattern and mask); a parent's bits are factored out of its children. Queries
go down level by level, adding up differences in the newly shared bits only, and a whole run is dropped
as soon as the sum exceeds the distance. What is left are single fingerprints within the distance.

A task returns links to the smallest member of each local set, and the link table is closed by
distributed union-find.

Edges: a null, empty or all-blank text has fingerprint zero and links like any other; texts of one or
two words have one shingle; repeated rows share a fingerprint and a component, a null doc_id is left out of
choosing a component's name unless it is alone (its component is then null); an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.llm.common import if_small, joined_roots, materialize, read_table, string_views
from lakelogs.llm.components import connected_components

#: Words of a shingle, and bits in which linked fingerprints may differ.
WIDTH = 3
DISTANCE = 2
#: A group of more fingerprints than this is cut again by blocks of its free bits.
GROUP_LIMIT = 20_000
LEAF = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: bytes, width: int = WIDTH, seed: int = 42) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    runs = [words] if len(words) < width else zip(*(words[k:] for k in range(width)), strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    values = np.array([digest(join(r), seed) for r in runs], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 8192):  # long texts a piece at a time
        bits = np.unpackbits(values[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint of a text's shingles of ``width`` words, as a signed 64-bit number."""

    @F.arrow_udf(T.LongType())
    def marked(texts: pa.Array) -> pa.Array:
        data, offsets = string_views(texts)
        raw = data.tobytes()
        return pa.array(np.array([text_fingerprint(raw[a:b], width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64).view(np.int64))

    return marked(text.cast("string"))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- the index -----------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Runs of Gray-ordered fingerprints with the bit patterns they share, a tree of fan-out LEAF."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves' parents up: (pattern, mask)
        ones, zeros = self.values, ~self.values
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), LEAF)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones, ones | zeros))

    def within(self, part: np.ndarray, distance: int, root: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions in part, positions in ``self.values``) of the pairs within the distance. With the values'
        roots and the queries' own ones, runs that are wholly in a query's component are passed by."""
        q, node, spent, known = np.arange(len(part)), *(np.zeros(len(part), k) for k in (np.int64, np.int64, np.uint64))
        if not len(self.values):
            return q[:0], q[:0]
        low = high = root
        spans = []
        for pattern, _ in self.levels if root is not None else ():
            cuts = np.arange(0, len(low), LEAF)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            spans.append(np.where(low == high, low, -1))
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[level]
            if level < len(self.levels) - 1:
                q, node, spent, known = self._down(q, node, spent, known, len(pattern))
            spent = spent + np.bitwise_count((part[q] ^ pattern[node]) & mask[node] & ~known)
            keep = spent <= distance
            if root is not None:
                keep &= spans[level][node] != own[q]
            q, node, spent, known = q[keep], node[keep], spent[keep], mask[node[keep]]
        if self.levels:
            q, node, spent, known = self._down(q, node, spent, known, len(self.values))
        keep = spent + np.bitwise_count((part[q] ^ self.values[node]) & ~known) <= distance
        return q[keep], node[keep]

    def components(self, distance: int) -> np.ndarray:
        """For each of ``self.values`` the smallest position that it reaches within its links."""
        root, at, batch = np.arange(len(self.values)), 0, 16
        while at < len(root):
            q, near = self.within(self.values[at : at + batch], distance, root, root[at : at + batch])
            root = joined_roots(root, q + at, near)
            at, batch = at + batch, min(batch * 4, 1024)  # the first few join a large group before many ask for it
        return root

    @staticmethod
    def _down(q, node, spent, known, below):
        first = node * LEAF
        n = np.minimum(first + LEAF, below) - first
        child = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return np.repeat(q, n), child, np.repeat(spent, n), np.repeat(known, n)


def _search_groups(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    parts = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches]
    values = np.unique(np.concatenate(parts)).view(np.uint64) if parts else np.zeros(0, np.uint64)
    if len(values) > 1:
        index = GrayIndex(values)
        root = index.components(distance)
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(index.values[root[linked]].view(np.int64)), pa.array(index.values[linked].view(np.int64))], ["a", "b"])


def _blocks(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Deal free bits, as (start, length) runs, over blocks of near equal width."""
    bits = [i for start, n in free for i in range(start, start + n)]
    out = []
    for k in range(parts):
        mine = bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]
        runs: list[tuple[int, int]] = []
        for i in mine:
            if runs and i == runs[-1][0] + runs[-1][1]:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((i, 1))
        out.append(runs)
    return out


def _block_value(fp: Column, runs: list[tuple[int, int]]) -> Column:
    value, shift = F.lit(0).cast("long"), 0
    for start, n in runs:
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << n) - 1)), shift))
        shift += n
    return value


def _without(free: list[tuple[int, int]], used: list[tuple[int, int]]) -> list[tuple[int, int]]:
    taken = {i for s, n in used for i in range(s, s + n)}
    return [(i, 1) for s, n in free for i in range(s, s + n) if i not in taken]


def similar_links(fps: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Different fingerprints (fp long) -> links (a, b) whose closure joins all pairs within the distance."""
    spark = fps.sparkSession
    free = [(0, 64)]
    blocks = _blocks(free, distance + 1)
    entries = [F.struct(F.lit(k).alias("path"), _block_value(F.col("fp"), b).alias("key"), F.lit(k).alias("block")) for k, b in enumerate(blocks)]
    rows = fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.path", "e.key", "e.block")
    frees = {(k,): _without(free, b) for k, b in enumerate(blocks)}
    groups = []
    for depth in range(3):
        counts = rows.groupBy("path", "key").count()
        hot = counts.filter(F.col("count") > group_limit).select("path", "key") if depth < 2 else None
        if hot is None or not hot.limit(1).count():
            groups.append(rows.select("path", "key", "fp"))
            break
        hot = materialize(hot, "hot")
        groups.append(rows.join(hot, ["path", "key"], "left_anti").select("path", "key", "fp"))
        rows = rows.join(hot, ["path", "key"], "left_semi")
        # Cut what is hot by blocks of the bits that its path leaves free.
        cut, nxt = [], {}
        for path, bits in frees.items():
            code = sum(p * 4**i for i, p in enumerate(path))
            sub = _blocks(bits, distance + 1)
            for k, b in enumerate(sub):
                new = (*path, k)
                nxt[new] = _without(bits, b)
                cut.append(F.when(F.col("path") == code, F.struct(F.lit(sum(p * 4**i for i, p in enumerate(new))).alias("path"), F.xxhash64("key", _block_value(F.col("fp"), b)).alias("key"), F.lit(k).alias("block"))))
        frees = nxt
        rows = rows.select("fp", F.explode(F.filter(F.array(*cut), lambda e: e.isNotNull())).alias("e")).select("fp", "e.path", "e.key", "e.block")
    grouped = groups[0]
    for g in groups[1:]:
        grouped = grouped.union(g)
    # Many groups share a task; the index prunes what isn't near, so a task may search all its groups at once.
    dealt = grouped.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "key").select("fp")
    return dealt.mapInArrow(lambda it: _search_groups(it, distance), "a long, b long")


def simhash_components(docs: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT, width: int = WIDTH) -> DataFrame:
    """Documents -> (doc_id, fp, component_id), one row a document; component_id is the smallest doc_id reachable."""
    marked = materialize(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    members = connected_components(similar_links(classes.select("fp"), distance, group_limit))
    named = (
        classes.join(members.withColumnRenamed("node", "fp"), "fp")
        .groupBy("component").agg(F.min("first_id").alias("component_id"))
        .join(members, "component").select(F.col("node").alias("fp"), "component_id")
    )
    of_class = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "classes")
    # Nothing else is in the stage of this join, so a hot fingerprint is broadcast or split.
    return marked.join(if_small(of_class), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
