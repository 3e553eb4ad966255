"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window); a window is a set of
positioned shingles of SHINGLE words (fewer if the window has fewer). A document contains a window only if it
contains each of its shingles, so one shingle, the rarest, is a sufficient prefix to join on:

1. the positions at which any item shingle occurs in a document are found, with their words, in one pass over the texts: the
   hashes of a document's shingles are first tried on a bitmap of the item shingles (a Bloom filter of FILTER_BITS at most), within the
   document's array, and what it lets through is semi-joined with the item shingles. One more row counts the document's words;
2. counts over these positions, for all documents, order the shingles by rarity, and each window gets its rarest one;
3. positions of prefix shingles are joined with the windows they stand for: at the shingle's offset the window must
   begin inside the document (position bound) and end inside it (length bound);
4. the words found at the candidate stretch are compared with the window's words, exactly.

The item shingles are a small table of their own. They are broadcast only if they are few (16 bytes each, counted
first: ``common.BROADCAST_ROWS``); beyond that the join is shuffled, of a document only the positions that passed the bitmap.
The bitmap is a constant of the plan whose size doesn't grow beyond its bound; more shingles only let more positions pass.
Everything else is shuffled by document or by shingle. Windows of fewer words than a shingle have shingles of their own size, found in the same pass.

Edges: a null or empty text has no words and is clean; an item without words has no window; equal items each count;
repeated document rows are one document if all their columns are equal in (doc_id, text), else each row is
judged alone and reported; empty documents give an empty result, an empty benchmark finds nothing; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelogs.llm.common import ascii_lower, if_small, materialize, read_table

WINDOW = 13
SHINGLE = 3
#: 100 * hit words / words at which a document counts as contaminated.
PERCENT = 5
#: Bits of the bitmap of item shingles: 16 a shingle, at least and at most.
FILTER_BITS = (1 << 16, 1 << 22)
#: Stands for a shingle in the row that counts a document's words.
NO_SHINGLE = -1
#: Words before lower-casing A-Z.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words of a text as they are written; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def exact_words(words: Column) -> Column:
    """Words with A-Z in lower case."""
    return F.transform(words, ascii_lower)


def _shingles(words: Column, size: int) -> Column:
    """A hash for each run of ``size`` words. The words come from ``lower``, which is quick, joins all that A-Z
    alone would join, and never changes where words begin or end; exact words are compared at the end."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    part = lambda k: F.slice(words, F.lit(1 + k), n)
    if size == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.arrays_zip(*[part(k).alias(f"w{k}") for k in range(size)]), lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(size)]))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, text) -> (item_id, n, words) for each window of each item."""
    items = benchmark.select("item_id", exact_words(raw_words(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("words")).withColumn("n", F.size("words"))


def _filter_places(sh: Column, bits: int) -> tuple[Column, Column]:
    """The two bits of a shingle in a bitmap of so many."""
    return F.pmod(sh, F.lit(bits)), F.pmod(F.shiftrightunsigned(sh, 32), F.lit(bits))


def _bitmap(known: DataFrame) -> tuple[bytearray, int]:
    """A bitmap of the shingles of (sh), six bits a byte from "0" on, so that each byte is a character; and its number of bits."""
    least, most = FILTER_BITS
    bits = min(max(least, 1 << (16 * known.count()).bit_length()), most)
    place = known.select(F.explode(F.array(*_filter_places(F.col("sh"), bits))).alias("i"))
    six = place.groupBy(F.call_function("div", F.col("i"), F.lit(6)).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.pmod("i", F.lit(6))).cast("int")).alias("b"))
    map_ = bytearray(b"0" * (bits // 6 + 1))
    for r in six.collect():  # bits / 6 rows at most
        map_[r["byte"]] = 48 + r["b"]
    return map_, bits


def _maybe(sh: Column, bitmap: bytearray, bits: int) -> Column:
    """Whether a shingle's bits are both set."""
    def is_set(i: Column) -> Column:
        char = F.ascii(F.substring(F.lit(bytes(bitmap)), (F.call_function("div", i, F.lit(6)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.getbit(char - 48, F.pmod(i, F.lit(6)).cast("int")) == 1

    one, two = _filter_places(sh, bits)
    return is_set(one) & is_set(two)


def _once(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _occurrences(docs: DataFrame, windows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Item shingles (window, offset, size, sh), and the document positions (row_id, pos, size, sh, words) at which one occurs,
    with the exact words there. One more row for each document, of size 0, has its number of words as pos."""
    sizes = sorted({shingle, *(r["s"] for r in windows.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect())}, reverse=True)  # at most SHINGLE numbers
    cut = [windows.filter(F.least("n", F.lit(shingle)) == s).select("window", F.posexplode(_shingles(F.transform("words", F.lower), s)).alias("offset", "sh"), F.lit(s).alias("size")) for s in sizes]
    item_side = cut[0]
    for c in cut[1:]:
        item_side = item_side.union(c)
    item_side = materialize(item_side, "shingles")
    # With each size the mark of the row that counts words; it is of the first size only.
    marks = item_side.sparkSession.range(1).select(F.lit(sizes[0]).cast("int").alias("size"), F.lit(NO_SHINGLE).cast("long").alias("sh"))
    known = materialize(item_side.select("size", "sh").union(marks).distinct(), "known").filter(F.col("size") <= sizes[0])

    bitmap, bits = _bitmap(known.filter(F.col("sh") != NO_SHINGLE).select("sh"))

    def runs(words: Column, low: Column, s: int) -> Column:
        """The places of a document whose shingle of ``s`` words passes the bitmap."""
        hashes = F.transform(low, lambda x, i: F.when(i <= F.size(low) - s, F.xxhash64(x, *[F.get(low, i + k) for k in range(1, s)])))
        passed = lambda h, i: F.when(_maybe(h, bitmap, bits), F.struct(h.alias("sh"), F.lit(s).alias("size"), i.alias("pos"), F.slice(words, i + 1, s).alias("words")))
        return F.array_compact(F.transform(hashes, passed))

    def places(words: Column) -> Column:
        last = F.struct(F.lit(NO_SHINGLE).cast("long").alias("sh"), F.lit(sizes[0]).alias("size"), F.size(words).alias("pos"), F.lit(None).cast("array<string>").alias("words"))
        return _once(F.transform(words, F.lower), lambda low: F.concat(*[runs(words, low, s) for s in sizes], F.array(last)))

    rows = docs.select("row_id", F.explode(_once(raw_words(F.col("text")), places)).alias("e")).select("row_id", "e.*")
    joined = rows.join(if_small(known), ["size", "sh"], "left_semi")
    end = F.col("words").isNull()
    found = joined.select("row_id", "pos", F.when(end, 0).otherwise(F.col("size")).alias("size"), "sh", F.when(~end, exact_words(F.col("words"))).alias("words"))
    return item_side, materialize(found, "occurrences")


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(row_id, text) documents -> every occurrence of an item window (row_id, item_id, pos, n), and (row_id, n_words)."""
    per_item = item_windows(benchmark, window)
    windows = materialize(per_item.groupBy("words", "n").agg(F.collect_set("item_id").alias("items")).withColumn("window", F.xxhash64("words", "n")), "windows")
    item_side, found = _occurrences(docs, windows, shingle)
    counted, found = found.filter("size = 0").select("row_id", F.col("pos").cast("long").alias("n_words")), found.filter("size > 0")
    rarity = item_side.join(found.groupBy("size", "sh").count(), ["size", "sh"])
    whole = rarity.groupBy("window").agg(F.min(F.struct("count", "offset", "sh", "size")).alias("p"), F.countDistinct("offset").alias("seen"))
    # A window one of whose shingles occurs nowhere is in no document.
    prefix = whole.select("window", "p.*", "seen").join(windows, "window").filter(F.col("seen") == F.col("n") - F.col("size") + 1)
    prefix = materialize(prefix.select("window", "offset", "sh", "size", "n", "words", "items"), "prefix")
    begun = found.join(prefix.select("size", "sh", "window", "offset", "n"), ["size", "sh"]).select("row_id", (F.col("pos") - F.col("offset")).alias("start"), "window", "n", "size").filter("start >= 0")
    # The window's words lie under shingles at offsets 0, size, 2 * size, ... and the last one.
    parts = F.array_distinct(F.array_append(F.sequence(F.lit(0), F.col("n") - F.col("size"), F.col("size")), F.col("n") - F.col("size")))
    begun = begun.withColumn("parts", parts).select("*", F.explode("parts").alias("part")).withColumn("pos", F.col("start") + F.col("part"))
    there = begun.join(found.select("row_id", "pos", "size", F.col("words").alias("there")).distinct(), ["row_id", "pos", "size"])
    expected = prefix.select("window", "n", F.col("words").alias("expected"), "items")
    same = there.join(expected, ["window", "n"]).filter(F.col("there") == F.slice("expected", F.col("part") + 1, F.col("size")))
    hits = same.groupBy("row_id", F.col("start").alias("pos"), "window", "n", "items").agg(F.countDistinct("part").alias("met"), F.first(F.size("parts")).alias("needed")).filter("met = needed")
    return hits.select("row_id", F.explode("items").alias("item_id"), "pos", "n"), counted


def _sha(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.sort_array(ids)), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents -> (doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated), one row a different (doc_id, text)."""
    return _judged(docs, benchmark, **options).drop("row_id")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """As ``decontaminate``, with row_id (doc_id and hash of the text)."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row_id"), "text")
    hits, counted = window_hits(keyed, benchmark, window, shingle)
    sized = counted.distinct().withColumn("doc_id", F.col("row_id.doc_id"))
    hits = materialize(hits.distinct(), "hits")
    stretches = hits.select("row_id", "pos", "n").distinct()
    words = stretches.select("row_id", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("at")).distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
    items = hits.groupBy("row_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    sums = words.join(items, "row_id")
    out = sized.join(sums, "row_id", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        "row_id", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), _sha(F.col("items")).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = _judged(docs, benchmark, **options).filter("contaminated").select(F.col("row_id.doc_id").alias("bad_id"), F.col("row_id.h").alias("bad_h")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    return rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.col("h") == F.col("bad_h")), "left_anti").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS n, w[i : i + CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END - 1] AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i : i + n - 1] AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
p AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("items")
