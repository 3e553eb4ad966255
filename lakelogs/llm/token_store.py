"""Token ids of documents in directly addressable codes.

Encoding. A byte-level BPE vocabulary never joins text across the border from a non-blank to a blank, so a text is cut there
into pieces, each different piece is encoded once by the tokenizers library, and its ids are put back in place. Pieces are
keyed by a 64-bit hash and kept, up to CACHE_PIECES, while a Python worker lives.

File format. Documents are range-partitioned and sorted by doc_id; each task writes segments of about SEGMENT_IDS ids
as rows of a Parquet table (uncompressed): ``part`` and ``seq`` order the segments, ``own_start`` counts the ids before within ``part``, ``code`` is one binary value:

    b"DAC1", int64 counts (documents, ids, levels), doc_ids (int64, null = int64 minimum), ends of documents (int64),
    then for each level: int64 entries, their low 8 bits (bytes), continuation bitmap (little-endian bits, whole
    512-bit blocks), rank directory (int64 ones before each block).

An id is split into 8-bit levels; an id whose higher bits aren't zero has its continuation bit set and its rank among
the set bits is its place in the next level. ``token_at`` reads any id with one rank a level and decodes no block.

Edges: a null or empty text has only the end id; documents with equal doc_id are all written, ordered by doc_id, then
by the text's hash, which also deals the rows of one doc_id over tasks; a null doc_id comes first; one document is never split over segments; an empty table gives no segments; the string
of a special token in a text becomes that token, as the library does it (such strings hold no blanks, so no piece cuts
one); other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.llm.common import eight_bytes, materialize, new_path, ragged, range_hash, read_table, spans_of_bytes, string_views

END_ID = 2
SEGMENT_IDS = 1 << 19
CACHE_PIECES = 2_000_000
BLOCK_BYTES = 4 << 20
NULL_ID = np.iinfo(np.int64).min
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class PieceEncoder:
    """Texts -> ids through a tokenizer file, each different piece encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a byte-level token has one character a byte
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces: at texts, and at blanks after what is surely no blank."""
        blank = _BLANK[data]
        cut = np.zeros(len(data), bool)
        sure = data[:-1] > 0x20
        high = data[:-1] >= 0x80
        if high.any():  # not after what may end a wider blank (U+0085, U+00A0, U+1680, U+2000.., U+3000)
            one = np.concatenate(([0], data))[:-2]
            two = np.concatenate(([0, 0], data))[:-3]
            sure &= ~(high & ((one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3))))
        cut[1:] = blank[1:] & sure
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces. Those from a blank to a non-blank are run together, and cut again by their bytes."""
        plain = np.array([k for k, p in enumerate(pieces) if _BLANK[p[0]] and 0x20 < p[-1] < 0x7F], np.int64)
        starts, sizes, parts, total = np.full(len(pieces), -1), np.zeros(len(pieces), np.int64), [], len(self.flat)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            run = [pieces[k] for k in some.tolist()]
            got = np.array(self.tokenizer.encode_batch_fast([b"".join(run).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends, want = np.cumsum(self.width[got]), np.cumsum([len(p) for p in run])
            where = np.searchsorted(ends, want)
            if not len(ends) or where[-1] >= len(ends) or not np.array_equal(ends[where], want):
                continue  # not cut where the pieces are: each for itself, below
            sizes[some] = np.diff(where, prepend=-1)
            starts[some] = total + where + 1 - sizes[some]
            parts.append(got)
            total += len(got)
        rest = np.flatnonzero(starts < 0).tolist()
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in rest], add_special_tokens=False), strict=True):
            starts[k], sizes[k] = total, len(e.ids)
            parts.append(np.array(e.ids, np.int32))
            total += len(e.ids)
        self.flat = np.concatenate((self.flat, *parts))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.sizes = keys[order], np.concatenate((self.starts, starts))[order], np.concatenate((self.sizes, sizes))[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts -> all their ids, and the number of ids of each text."""
        counts = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return np.zeros(0, np.int32), counts
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
        n = self.sizes[at]
        text = np.searchsorted(offsets, starts, "right") - 1
        counts = np.bincount(text, weights=n, minlength=len(counts)).astype(np.int64)
        return self.flat[ragged(self.starts[at], n)], counts


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# --- the format ----------------------------------------------------------------------------------------------


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left >= 256
        bits = np.zeros(-(-len(left) // 512) * 512, bool)
        bits[: len(left)] = more
        ones = np.concatenate(([0], np.cumsum(bits.reshape(-1, 512).sum(axis=1))))[:-1] if len(left) else np.zeros(0)
        levels.append(b"".join((np.int64(len(left)).tobytes(), (left & 255).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones.astype("<i8").tobytes())))
        if not more.any():
            break
        left = left[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(levels)], "<i8").tobytes()
    return b"".join((b"DAC1", head, doc_ids.astype("<i8").tobytes(), np.cumsum(counts).astype("<i8").tobytes(), *levels))


class Segment:
    """A view of a packed segment."""

    def __init__(self, code: bytes):
        if code[:4] != b"DAC1":
            raise ValueError("not a token segment")
        docs, self.n, levels = (int(x) for x in np.frombuffer(code, "<i8", 3, 4))
        at = 28
        self.doc_ids, at = np.frombuffer(code, "<i8", docs, at), at + 8 * docs
        self.ends, at = np.frombuffer(code, "<i8", docs, at), at + 8 * docs
        self.levels = []
        for _ in range(levels):
            n, at = int(np.frombuffer(code, "<i8", 1, at)[0]), at + 8
            blocks = -(-n // 512)
            low, bits, ones = np.frombuffer(code, np.uint8, n, at), np.frombuffer(code, np.uint8, blocks * 64, at + n), np.frombuffer(code, "<i8", blocks, at + n + blocks * 64)
            self.levels.append((low, bits, ones))
            at += n + blocks * 72

    def token_at(self, i: int) -> int:
        """The i-th id of the segment, by ranks alone."""
        out, shift = 0, 0
        for low, bits, ones in self.levels:
            out |= int(low[i]) << shift
            byte = int(bits[i >> 3])
            if not byte >> (i & 7) & 1:
                return out
            start = (i >> 9) << 6
            i = int(ones[i >> 9]) + int(np.bitwise_count(bits[start : i >> 3]).sum()) + (byte & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return out

    def ids(self) -> np.ndarray:
        """All ids at once."""
        out = np.zeros(self.n, np.uint32)
        place, shift = np.arange(self.n), 0
        for low, bits, _ in self.levels:
            out[place] |= low.astype(np.uint32) << np.uint32(shift)
            place = place[np.unpackbits(bits, count=len(low), bitorder="little").view(bool)]
            shift += 8
        return out


SEGMENTS = "part int, seq int, n_docs long, n_ids long, own_start long, code binary"
#: Tasks that wrote, up to which their totals (16 bytes each) are broadcast.
BROADCAST_TASKS = 1_000_000


def _encode_tasks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, part, seq, own = encoder(path), TaskContext.get().partitionId(), 0, 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nonlocal seq, own
        doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        seq, own = seq + 1, own + len(ids)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)]), pa.array([len(ids)]), pa.array([own - len(ids)]), pa.array([pack(doc_ids, counts, ids)], pa.binary())], ["part", "seq", "n_docs", "n_ids", "own_start", "code"])

    for b in batches:
        doc_ids = b.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()
        data, offsets = string_views(b.column("text"))
        for i, j in spans_of_bytes(offsets, BLOCK_BYTES):
            ids, counts = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.cumsum(counts)
            held.append((doc_ids[i:j], counts + 1, np.insert(ids, ends, end_id)))
            if sum(len(x[2]) for x in held) >= SEGMENT_IDS:
                yield flush()
    if held:
        yield flush()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode documents and write their ids, in ascending doc_id order, as segments under ``out``."""
    ordered = docs.select("doc_id", "text").repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(lambda it: _encode_tasks(it, tokenizer, end_id), SEGMENTS).write.option("compression", "none").parquet(out)


def segments_with_starts(spark, path: str) -> DataFrame:
    """The written segments with the number of ids before each: those of its own task, which it holds, and of all tasks
    before, a running sum of one row a task. The codes themselves are not shuffled."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = materialize(segments.groupBy("part").agg(F.sum("n_ids").alias("n")), "token_totals")
    before = totals.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    if totals.count() <= BROADCAST_TASKS:
        before = F.broadcast(before)
    return segments.join(before, "part").withColumn("start", F.col("own_start") + F.coalesce("before", F.lit(0)))


def _decode_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for code, start in zip(b.column("code"), b.column("start").to_pylist(), strict=True):
            s = Segment(memoryview(code.as_buffer()))
            raw, begins = memoryview(s.ids().astype("<u4").tobytes()), np.concatenate(([0], s.ends[:-1]))
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), s.ends.tolist(), strict=True)]
            ids = pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(begins + start), pa.array(s.ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(spark, path: str) -> DataFrame:
    """Written tokens -> (doc_id, start, n_tokens, ids_crc32), one row a document."""
    rows = segments_with_starts(spark, path).select("code", "start")
    return rows.mapInArrow(_decode_tasks, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, out)
