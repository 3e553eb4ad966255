"""Alignment of two tokenizers over the same texts.

Encoding. Both tokenizers read a text with a space before it. A blank after a non-blank always begins a token of the byte-level
one, and of the pieces one unless one of its pieces has that blank inside (``PairEncoder`` looks); texts are cut there, each different
stretch is encoded once, and its ids, kept up to CACHE_PIECES while a worker lives, are put back in place. A text whose
tokens' bytes aren't the text's (a piece's U+2581 stands for a space) has no tokens.

Lockstep merging (``lockstep``). One vector holds a pointer into A's and one into B's token ends for every document of a batch.
Each step moves them all, whichever end is behind, or both where they meet: that is a cut, which closes a group of A and
B tokens and emits its links, all pairs of its tokens. Finished documents leave the vector. A text of more than LANE tokens has
several lanes, begun at stretches, where both tokenizers surely cut, so that one long text doesn't hold a batch up.

Counts. A batch of documents is stored as one row: the different id pairs linked in it, in how many of its documents each is, and
for each document its pairs' places in that list. The lists are added up to ``pair_counts``; counts go back to batches, not to
documents, so shuffles carry a row a pair and batch. Nothing is broadcast by hand and no list is capped.

Edges: null and empty texts and those that don't come back have zeros and '' as digest; repeated rows and repeated or null doc_ids
are documents of their own; the strings of special tokens are plain text; a group of many tokens is linked by its different
ids with their numbers; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.llm.common import eight_bytes, materialize, ragged, range_hash, read_table, spans_of_bytes, string_views

CACHE_PIECES = 500_000
#: Text that is handed to a worker at once and aligned at once; links between documents and pairs that make up a batch; tokens of a lane.
#: Workers stay, and what is held at once decides their memory.
ARROW_BYTES = 4 << 20
PIECE_BYTES = 512 << 10
BATCH_LINKS = 500_000
LANE = 256
#: Stored batches that Spark reads or writes at once: by itself it holds a hundred, as it looks at the size of no fewer rows.
ROWS_READ = 4
#: Links of a group that are written out one by one; larger groups by their different ids.
WIDE = 256
#: Links and tokens that are written out at once.
SLICE = 1 << 18
#: Pair (a, b) is a * B_SPACE + b.
B_SPACE = 1 << 24
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class PairEncoder:
    """Texts, each with its space before it, -> the ids of both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        vocab = self.a.get_vocab(with_added_tokens=True)
        if max(*vocab.values(), self.b.get_piece_size()) >= len(_NUMBERS):
            raise ValueError("an id has five digits at most")
        self.a_width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a byte-level token has one character a byte
            self.a_width[i] = len(token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.b_width = np.array([len(p) for p in self.b_bytes], np.int64)
        self.blank = np.zeros(256, bool)
        self.blank[[c for c in _BLANKS if not any(c in p[1:] and any(y == c and x not in _BLANKS for x, y in zip(p, p[1:], strict=False)) for p in self.b_bytes)]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.whole = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.starts, self.sizes, self.flat = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int32)] * 2

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of stretches: at texts, and at blanks after what is surely no blank."""
        cut = np.zeros(len(data), bool)
        before = data[:-1]
        one, two = np.concatenate(([0], data))[:-2], np.concatenate(([0, 0], data))[:-3]
        wide = (before >= 0x80) & ((one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3)))  # may end U+0085, U+00A0, U+1680, U+2000.., U+3000
        cut[1:] = self.blank[data[1:]] & (before > 0x20) & ~wide
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids after those of a leading "x" and its space: a text that begins with a blank is cut there."""
        found = self.b.encode(["x" + t for t in texts], num_threads=1)
        lead = self.b.encode("x")
        return [ids[len(lead) :] if ids[: len(lead)] == lead else [] for ids in found]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new stretches: those that end in plain ASCII run together, cut again by their widths; the others each for itself."""
        sides, whole = [], np.ones(len(pieces), bool)
        plain = np.array([k for k, p in enumerate(pieces) if p[0] == 0x20 and 0x20 < p[-1] < 0x7F], np.int64)
        for side, (encode, width) in enumerate(((self._encode_a, self.a_width), (self._encode_b, self.b_width))):
            starts, sizes, parts, total = np.full(len(pieces), -1), np.zeros(len(pieces), np.int32), [], len(self.flat[side])
            for at in range(0, len(plain), 1024):
                some = plain[at : at + 1024]
                run = [pieces[k] for k in some.tolist()]
                ids = encode([b"".join(run).decode()])[0]
                got = np.array(ids, np.int32)
                ends, want = np.cumsum(width[got]), np.cumsum([len(p) for p in run])
                where = np.searchsorted(ends, want)
                if not len(ends) or where[-1] != len(ends) - 1 or not np.array_equal(ends[where], want):
                    continue
                if side and b"".join([self.b_bytes[i] for i in ids]) != b"".join(run):
                    continue
                sizes[some] = np.diff(where, prepend=-1)
                starts[some] = total + where + 1 - sizes[some]
                parts.append(got)
                total += len(got)
            rest = np.flatnonzero(starts < 0).tolist()
            for at in range(0, len(rest), 1024):  # the libraries' results are large
                some = rest[at : at + 1024]
                for k, ids in zip(some, encode([pieces[k].decode() for k in some]), strict=True):
                    starts[k], sizes[k] = total, len(ids)
                    parts.append(np.array(ids, np.int32))
                    total += len(ids)
                    whole[k] &= b"".join([self.b_bytes[i] for i in ids]) == pieces[k] if side else int(width[parts[-1]].sum()) == len(pieces[k])
            sides.append((starts, sizes))
            self.flat[side] = np.concatenate((self.flat[side], *parts))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.whole = keys[order], np.concatenate((self.whole, whole))[order]
        for side, (starts, sizes) in enumerate(sides):
            self.starts[side], self.sizes[side] = np.concatenate((self.starts[side], starts))[order], np.concatenate((self.sizes[side], sizes))[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each stretch, A's number of ids in it, B's, all ids of A, of B) of the texts that both give back whole."""
        starts = self._cuts(data, offsets)
        sizes = np.diff(np.append(starts, len(data)))
        keys = range_hash(eight_bytes(data), starts, sizes)
        own, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            raw = data.tobytes()
            self._learn(own[new], [raw[starts[i] : starts[i] + sizes[i]] for i in first[new]])
        at = np.searchsorted(self.keys, own)[place]
        text = np.searchsorted(offsets, starts, "right") - 1
        lost = np.zeros(len(offsets) - 1, bool)
        lost[text[~self.whole[at]]] = True
        good = ~lost[text]
        at, text = at[good], text[good]
        n_a, n_b = (self.sizes[side][at].astype(np.int64) for side in range(2))
        return text, n_a, n_b, self.flat[0][ragged(self.starts[0][at], n_a)], self.flat[1][ragged(self.starts[1][at], n_b)]


_ENCODERS: dict[tuple[str, str], PairEncoder] = {}


def encoder(a_path: str, b_path: str) -> PairEncoder:
    if (a_path, b_path) not in _ENCODERS:
        _ENCODERS[a_path, b_path] = PairEncoder(a_path, b_path)
    return _ENCODERS[a_path, b_path]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_stop: np.ndarray) -> np.ndarray:
    """Groups of lanes (their first tokens in A and B, and where A's end; both cover the same bytes): rows of a_start, a_stop, b_start,
    b_stop, ordered by a_start."""
    live = np.flatnonzero(a_first < a_stop)
    a, b, stop = a_first[live], b_first[live], a_stop[live]
    from_a, from_b, closed = a.copy(), b.copy(), []
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        next_a, next_b = a + (end_a <= end_b), b + (end_b <= end_a)
        cut = end_a == end_b
        if cut.any():
            closed.append(np.stack((from_a[cut], next_a[cut], from_b[cut], next_b[cut])))
            from_a, from_b = np.where(cut, next_a, from_a), np.where(cut, next_b, from_b)
        a, b = next_a, next_b
        going = a < stop
        if not going.all():
            a, b, stop, from_a, from_b = a[going], b[going], stop[going], from_a[going], from_b[going]
    groups = np.concatenate(closed, axis=1) if closed else np.zeros((4, 0), np.int64)
    place = np.full(len(a_ends), -1)
    place[groups[0]] = np.arange(groups.shape[1])
    return groups[:, place[place >= 0]]


def _merged(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (document, pair) in order, with the sums of their times."""
    order = np.lexsort((pairs, docs))
    docs, pairs, times = docs[order], pairs[order], times[order]
    heads = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])))) if len(docs) else np.zeros(0, np.int64)
    return docs[heads], pairs[heads], np.add.reduceat(times, heads) if len(heads) else times


def _linked(groups: np.ndarray, doc: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (document, pair) of the groups' links, and how often each is there; some links at a time."""
    found = [(np.zeros(0, np.int64),) * 3]
    written = np.minimum((groups[1] - groups[0]) * (groups[3] - groups[2]), WIDE)
    for at, to in spans_of_bytes(np.concatenate(([0], np.cumsum(written))), SLICE):
        some, of = groups[:, at:to], doc[at:to]
        n_a, n_b = some[1] - some[0], some[3] - some[2]
        n = n_a * n_b
        few = np.flatnonzero(n <= WIDE)
        within = ragged(np.zeros(len(few), np.int64), n[few])
        width = np.repeat(n_b[few], n[few])
        pair = a_ids[np.repeat(some[0][few], n[few]) + within // width].astype(np.int64) * B_SPACE + b_ids[np.repeat(some[2][few], n[few]) + within % width]
        parts = [(np.repeat(of[few], n[few]), pair, np.ones(len(pair), np.int64))]
        for k in np.flatnonzero(n > WIDE).tolist():
            (x, n_x), (y, n_y) = (np.unique(ids[i:j], return_counts=True) for ids, i, j in ((a_ids, *some[:2, k]), (b_ids, *some[2:, k])))
            pair = (x.astype(np.int64)[:, None] * B_SPACE + y).ravel()
            parts.append((np.full(len(pair), of[k]), pair, (n_x[:, None] * n_y).ravel()))
        found.append(_merged(*(np.concatenate(x) for x in zip(*parts, strict=True))))
    return _merged(*(np.concatenate(x) for x in zip(*found, strict=True))) if len(found) > 2 else found[-1]


_NUMBERS = np.arange(100_000)
_DIGITS = np.stack([_NUMBERS // 10**p % 10 + 48 for p in range(4, -1, -1)], axis=1).astype(np.uint8)
_SHOWN = np.stack([_NUMBERS >= 10**p if p else _NUMBERS >= 0 for p in range(4, -1, -1)], axis=1)


def _digests(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, tokens: np.ndarray) -> list[str]:
    """SHA-256 of the groups' ids for each text; ``tokens`` are its ids of both, '' where it has none."""
    n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
    ids, marks = np.zeros(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    ids[np.arange(len(a_ids)) + np.repeat(groups[2], n_a)] = a_ids
    ids[np.arange(len(b_ids)) + np.repeat(groups[1], n_b)] = b_ids
    marks[groups[1] + groups[2] - 1] = ord("|")
    marks[groups[1] + groups[3] - 1] = ord(";")
    ends, hashes = np.cumsum(tokens), [hashlib.sha256() if n else None for n in tokens.tolist()]
    for at in range(0, len(ids), SLICE):  # some tokens at a time
        shown = np.concatenate((_SHOWN[ids[at : at + SLICE]], np.ones((len(ids[at : at + SLICE]), 1), bool)), axis=1)
        bounds = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))
        written = memoryview(np.concatenate((_DIGITS[ids[at : at + SLICE]], marks[at : at + SLICE, None]), axis=1)[shown])
        first, last = np.searchsorted(ends, [at, min(at + SLICE, len(ids)) - 1], "right").tolist()
        for k in range(first, last + 1):
            i, j = max(int(ends[k] - tokens[k]) - at, 0), min(int(ends[k]) - at, len(bounds) - 1)
            if i < j:  # without the mark after the text's last id
                hashes[k].update(written[bounds[i] : bounds[j] - (at + j == ends[k])])
    return [h.hexdigest() if h else "" for h in hashes]


def _aligned(encode: PairEncoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> (n_a, n_b, n_groups, n_links as rows), digests, and the different (text, pair, times)."""
    n = len(offsets) - 1
    counts = np.zeros((4, n), np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    spaced = np.full(len(data) + len(full), 0x20, np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.diff(offsets)[full] + 1)))
    inside = np.ones(len(spaced), bool)
    inside[bounds[:-1]] = False
    spaced[inside] = data
    text, n_a, n_b, a_ids, b_ids = encode.encode(spaced, bounds)
    np.add.at(counts[0], full[text], n_a)
    np.add.at(counts[1], full[text], n_b)
    # Lanes: a text's stretches in runs of about LANE tokens.
    a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
    lane = (a_at - np.repeat(a_at[begins], np.diff(np.append(begins, len(text))))) // LANE
    begins = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (lane[1:] != lane[:-1])))) if len(text) else begins
    a_first = a_at[begins]
    groups = lockstep(np.cumsum(encode.a_width[a_ids]), np.cumsum(encode.b_width[b_ids]), a_first, b_at[begins], np.append(a_first[1:], len(a_ids)) if len(begins) else a_first)
    doc = np.searchsorted(np.cumsum(counts[0]), groups[0], "right")
    counts[2] = np.bincount(doc, minlength=n)
    np.add.at(counts[3], doc, (groups[1] - groups[0]) * (groups[3] - groups[2]))
    return counts, _digests(groups, a_ids, b_ids, counts[0] + counts[1]), *_linked(groups, doc, a_ids, b_ids)


_BATCH = "batch string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, docs array<long>, n_pairs array<long>, steps array<int>, times array<long>"


def _one(values) -> pa.Array:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _batch_row(parts: list[tuple]) -> pa.RecordBatch:
    counts, n_pairs = np.concatenate([p[1] for p in parts], axis=1), np.concatenate([np.bincount(p[3], minlength=p[1].shape[1]) for p in parts])
    pairs, place, docs = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True, return_counts=True)
    times = np.concatenate([p[5] for p in parts])
    columns = [pa.array([uuid.uuid4().hex]), _one(pa.concat_arrays([p[0] for p in parts])), *map(_one, counts)]
    columns += [_one(pa.array([d for p in parts for d in p[2]], pa.string())), _one(pairs), _one(docs), _one(n_pairs), _one(np.diff(place, prepend=0).astype(np.int32)), _one(times)]
    names = [c.split()[0] for c in _BATCH.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names)


def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    encode, parts, links = encoder(a_path, b_path), [], 0
    for batch in batches:
        data, offsets = string_views(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64())
        for i, j in spans_of_bytes(offsets, PIECE_BYTES):
            parts.append((ids.slice(i, j - i), *_aligned(encode, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            links += len(parts[-1][3])
            if links > BATCH_LINKS:
                yield _batch_row(parts)
                parts, links = [], 0
                pa.default_memory_pool().release_unused()
    if parts:
        yield _batch_row(parts)
    del parts
    pa.default_memory_pool().release_unused()  # the worker stays


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents -> stored batches (``_BATCH``): each document's numbers and digest, the batch's different pairs with their documents,
    and for each document the steps from one of its pairs' places to the next, with the pairs' times in it."""
    conf = docs.sparkSession.conf
    before = conf.get(_ARROW_BYTES, None)
    conf.set(_ARROW_BYTES, ARROW_BYTES)  # read when the plan is made, which is within materialize
    try:
        return materialize(docs.select("doc_id", "text").mapInArrow(partial(_align, a_path=a_path, b_path=b_path), _BATCH), "aligned", "zstd", {"parquet.block.row.count.limit": ROWS_READ})
    finally:
        conf.set(_ARROW_BYTES, before) if before else conf.unset(_ARROW_BYTES)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, best): documents that hold each id pair linked, and whether no other pair of its A id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    split = each.withColumn("a_id", F.shiftright("pair", 24)).withColumn("b_id", F.col("pair") % B_SPACE)
    return split.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a_id")))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batch: pa.Table, counts: pa.Table) -> pa.Table:
    """A batch's documents, once its pairs' counts are known."""
    column = lambda name: batch.column(name).combine_chunks().flatten()
    count, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
    place = counts.column("place").to_numpy()
    count[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    pair, times = np.cumsum(column("steps").to_numpy().astype(np.int64)), column("times").to_numpy()
    n_pairs = column("n_pairs").to_numpy()
    doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
    n_best, total = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
    np.add.at(n_best, doc, times * best[pair])
    np.add.at(total, doc, times * count[pair])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*map(column, names), pa.array(n_best), pa.array(total), column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])


def aligned_documents(aligned: DataFrame) -> DataFrame:
    """Stored batches -> a row a document: numbers of tokens, groups and links, links of best pairs, the sum of the links' counts, digest."""
    met = aligned.select("batch", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(aligned), "pair").select("batch", "place", "count", "best")
    rest = aligned.drop("pairs", "docs")
    rest = rest.toDF(*rest.columns)  # columns of its own for the cogroup
    return rest.groupBy("batch").cogroup(met.groupBy("batch")).applyInArrow(_scored, _RESULT)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return aligned_documents(align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
