"""Divergence of sources within their languages, from term counts.

``term_counts`` counts each term of each (lang, source) group: tasks add up their own texts first, so a hot source sends a row a
term and task, not a row a word. A language keeps the terms of at least ``min_docs`` of its documents. A term's smoothed share
p is 1 + floor(10^9 * (count + 1) / (N + V)) in integers, N the group's words among the V kept terms; a group's terms without an
occurrence all have the same share z. The distance of p from q is floor((p - q)^2 / q).

``pair_values`` sums it over all kept terms for each two groups of a language. The group-term matrix is cut into blocks of terms (and
tiles of groups); a task builds the K^2-quadtree of a block: a level is the bitmap of its nodes' K x K quadrants, with running ranks that lead
to the next level, and an all-zero quadrant has no node. Both rows of a pair go down the tree together, all pairs of row ranges at once;
where both are zero they stop, and the terms that no pair of leaves met are priced at once: their number times the
distance of both groups' z. States are taken depth first in bounded runs, so a task's memory doesn't grow with the leaves it visits.

``top_terms`` ranks the terms that a group uses more than its language does.

Edges: null text, lang and source count as ''; a group without kept terms still has its rows; a language without kept terms has
pair values of 0; one source alone in its language has no pairs; repeated rows count as documents; equal values rank by the
item's UTF-8 bytes; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.llm.common import if_small, materialize, read_table, spans_of_bytes, string_views

MIN_DOCS = 3
TOP = 200
#: Text that is counted at once, and rows that a task gathers before it sends them on.
PIECE_BYTES = 8 << 20
PIECE_ROWS = 1_000_000
#: Terms of a block and groups of a tile of the matrix; children of a node along one side; states of a run.
BLOCK = 1 << 14
TILE = 128
K = 4
RUN = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[97:123] = True
_TERM[128:] = True
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Texts' bytes -> the text of each term occurrence, and the terms, lower-cased, in order."""
    low = _LOWER[data]
    inside = _TERM[low]
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | starts[1:-1]
    end[:-1] &= ~inside[1:] | starts[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    ends = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin + 1, out=ends[1:])
    terms = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(low[inside]))
    return np.searchsorted(offsets, begin, "right") - 1, terms


def _piece_counts(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.Table:
    """Rows of ``_COUNTS`` of some texts."""
    text, terms = _terms(data, offsets)
    coded = terms.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    per_text, n = np.unique(text * width + coded.indices.to_numpy(), return_counts=True)
    keys, place = np.unique(group[per_text // width] * width + per_text % width, return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, place, n)
    group, term = keys // width, keys % width
    return pa.table([
        langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))),
        coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(counts), pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
    ], schema=_COUNTS)


def _merged(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts)
    return whole.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_COUNTS.names).cast(_COUNTS) if len(parts) > 1 else whole


def _count(batches: Iterator[pa.RecordBatch], piece_bytes: int, piece_rows: int) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for batch in batches:
        data, offsets = string_views(batch.column("text"))
        for i, j in spans_of_bytes(offsets, piece_bytes):
            parts.append(_piece_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.column("lang").slice(i, j - i), batch.column("source").slice(i, j - i)))
            rows += len(parts[-1])
            if rows > piece_rows:
                parts = [_merged(parts)]
                rows = len(parts[0])
                if 2 * rows > piece_rows:
                    yield from parts[0].to_batches(max_chunksize=1 << 16)
                    parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(max_chunksize=1 << 16)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, piece_bytes: int = PIECE_BYTES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Documents -> stored (lang, source, term, n, lang_n, leads) of kept terms; one of a term's rows in a language leads."""
    counted = _named(docs).mapInArrow(partial(_count, piece_bytes=piece_bytes, piece_rows=piece_rows), "lang string, source string, term string, n long, docs long")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = summed.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term)).withColumn("leads", F.row_number().over(of_term.orderBy("source")) == 1)
    return materialize(kept.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "leads"), "term-counts", "zstd")


def _share(n: str, words: str) -> F.Column:
    return F.expr(f"1 + (cast({n} + 1 AS decimal(20,0)) * 1000000000) div cast({words} + kept AS decimal(20,0))")


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored (lang, source, g, words, lang_words, kept, zero): one row a group, numbered from 0 within its language; zero is the share of a
    term without occurrences (null where nothing is kept)."""
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.sum(F.col("leads").cast("long")).alias("led"))
    found = _named(docs).select("lang", "source").distinct().join(words, ["lang", "source"], "left").fillna(0, ["words", "led"])
    of_lang = Window.partitionBy("lang")
    numbered = found.withColumn("g", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("lang_words", F.sum("words").over(of_lang)).withColumn("kept", F.sum("led").over(of_lang))
    return materialize(numbered.withColumn("zero", F.when(F.col("kept") > 0, _share("0", "words"))).drop("led"), "groups")


class Quadtree:
    """The K^2-tree of a matrix's nonzero cells (row, column), all different: ``bits[l]`` holds K * K bits a node of level l, and
    ``ranks[l]`` the place of each set bit's node on the next level; leaves are numbered so that ``order`` brings the cells to them."""

    def __init__(self, row: np.ndarray, column: np.ndarray, k: int = K):
        self.k, self.height = k, 1
        while k**self.height <= max(row.max(initial=0), column.max(initial=0)):
            self.height += 1
        code = np.zeros(len(row), np.int64)
        for level in range(self.height - 1, -1, -1):
            code = code * (k * k) + (row // k**level % k) * k + column // k**level % k
        self.order = np.argsort(code)
        nodes, self.bits, self.ranks = code[self.order], [], []
        for _ in range(self.height):
            above, parent = np.unique(nodes // (k * k), return_inverse=True)
            bits = np.zeros(len(above) * k * k, bool)
            bits[parent * (k * k) + nodes % (k * k)] = True
            self.bits.insert(0, bits)
            self.ranks.insert(0, np.cumsum(bits) - 1)
            nodes = above

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The node of a quadrant on the next level, -1 if it is all zero or has no parent."""
        at = np.maximum(node, 0) * (self.k * self.k) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.ranks[level][at], -1)


def pair_leaves(tree: Quadtree, rows: int, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, leaf, leaf) wherever one of two rows, the first one less, has a leaf in a column; -1 is a zero. In runs."""
    k = tree.k
    first, second, across = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k), np.arange(k), indexing="ij"))
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero, zero)]
    while stack:
        level, i, j, a, b = stack.pop()
        if level == tree.height:
            apart = i < j
            yield i[apart], j[apart], a[apart], b[apart]
            continue
        side = k ** (tree.height - level - 1)
        i, j = ((x[:, None] * k + y).ravel() for x, y in ((i, first), (j, second)))
        a = tree.child(level, a[:, None], first * k + across).ravel()
        b = tree.child(level, b[:, None], second * k + across).ravel()
        live = np.flatnonzero(((a >= 0) | (b >= 0)) & (i <= j) & (j * side < rows))
        for at in range(0, len(live), run // (k * k)):
            some = live[at : at + run // (k * k)]
            stack.append((level + 1, i[some], j[some], a[some], b[some]))


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _block_pairs(key: tuple, cells: pa.Table, groups: pa.Table, size: int, run: int) -> pa.Table:
    """Of a block of terms and two tiles of groups: (lang, g, h, met, value) over the terms that g or h has."""
    lang, _, tile, other = (x.as_py() for x in key)
    g = groups.column("g").to_numpy()
    by = np.argsort(g)
    g, zero = g[by], groups.column("zero").to_numpy()[by]
    met, value = np.zeros(len(g) ** 2, np.int64), np.zeros(len(g) ** 2, np.int64)
    if len(cells):
        column = cells.column("term").combine_chunks().dictionary_encode()
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices.to_numpy().astype(np.int64)
        tree = Quadtree(np.searchsorted(g, cells.column("g").to_numpy()), column)
        share = cells.column("p").to_numpy()[tree.order]
        for i, j, a, b in pair_leaves(tree, len(g), run):
            p, q = np.where(a >= 0, share[a], zero[i]), np.where(b >= 0, share[b], zero[j])
            for x, y, v in ((i, j, _distance(p, q)), (j, i, _distance(q, p))):
                np.add.at(value, x * len(g) + y, v)
                met += np.bincount(x * len(g) + y, minlength=len(met))
    at = np.flatnonzero(met)
    x, y = g[at // len(g)], g[at % len(g)]
    if tile != other:  # pairs within a tile are met where it is paired with itself
        across = (x // size) != (y // size)
        at, x, y = at[across], x[across], y[across]
    return pa.table({"lang": pa.array([lang] * len(at), pa.string()), "g": pa.array(x, pa.int32()), "h": pa.array(y, pa.int32()), "met": met[at], "value": value[at]})


def pair_values(counts: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE, run: int = RUN) -> DataFrame:
    """(lang, source, item, value) for each group and each other source of its language."""
    blocks = F.ceil(F.col("kept") / block)
    tiles = groups.withColumn("blocks", blocks).withColumn("tile", F.floor(F.col("g") / tile)).withColumn("last", F.max("tile").over(Window.partitionBy("lang")))
    spread = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    spread = materialize(spread.select("*", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u")), "tiles")
    cells = counts.join(if_small(spread), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "t", "u", "g", "term", _share("n", "words").alias("p")
    )
    zeros = spread.filter("blocks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "t", "u", "g", "zero")
    zeros = zeros.toDF("lang", "block", "t", "u", "g", "zero")  # columns of its own for the cogroup
    keys = ["lang", "block", "t", "u"]
    of_block = lambda key, cells, groups: _block_pairs(key, cells, groups, tile, run)
    parts = cells.groupBy(*keys).cogroup(zeros.groupBy(*keys)).applyInArrow(of_block, "lang string, g int, h int, met long, value long")
    sums = parts.groupBy("lang", "g", "h").agg(F.sum("met").alias("met"), F.sum("value").alias("value"))
    one, two = groups.select("lang", "source", "g", "kept", "zero"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("zero").alias("h_zero"))
    pairs = one.join(two, "lang").filter("g <> h").join(sums, ["lang", "g", "h"], "left")
    unmet = F.expr("(kept - coalesce(met, 0)) * (((zero - h_zero) * (zero - h_zero)) div h_zero)")
    return pairs.select("lang", "source", "item", F.when(F.col("kept") > 0, F.coalesce("value", F.lit(0)) + unmet).otherwise(0).cast("long").alias("value"))


def top_terms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each term that a group uses more than its language does."""
    shares = counts.join(if_small(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "words").alias("p"), _share("lang_n", "lang_words").alias("q"))
    return shares.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, pieces: tuple[int, int] = (PIECE_BYTES, PIECE_ROWS), block: int = BLOCK, tile: int = TILE, run: int = RUN) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of a group, and its ``top`` terms. The sizes change no result."""
    counts = term_counts(docs, min_docs, *pieces)
    groups = groups_of(docs, counts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    terms = ranked(top_terms(counts, groups), "term").filter(F.col("rank") <= top)  # tasks cut to the first ranks before they send
    return ranked(pair_values(counts, groups, block, tile, run), "pair").unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS nl FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(v, 0)::HUGEINT AS v, coalesce(nl, 0)::HUGEINT AS nl, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (g.nl + g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))
