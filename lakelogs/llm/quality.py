"""Quality rules: counts over whole texts, and repetition by a suffix array over each text's words.

Base counts: words are runs outside space and U+0009..U+000D; word_chars are their code points; n_symbols
counts ``[#*$%&|<>]``; n_dup_lines are \\n-split lines with a word that equal an earlier line of the text;
n_repeat_words are the words in 3-word windows that occur twice or more in the text.

Repetition: suffixes that start with a repeated 3-word window (no other suffix can be in a repeat of
``min_repeat`` words) are sorted by prefix doubling; neighbours' longest common prefixes follow from the
ranks of the doubling steps. A stack scan yields the common-prefix intervals; an interval whose occurrences
have different words before them is a maximal repeat. The union of all occurrences' spans gives the covered
fraction of the words, and the deepest interval the longest repeat. A text is dropped if it fails
the base rules, or if it has more covered words or a longer repeat than the limits allow.

All texts of an Arrow batch are handled together, a block of about a megabyte at a time, each whole; a
text longer than that is a block of its own (about 60 bytes of memory for each of its bytes).

Edges: a null or blank text has no words and fails the base rules; repeated rows get equal verdicts; an
empty table gives an empty result; as a filter, all columns are kept and none is looked at but the text.
Equality of words, lines and windows is that of 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.llm.common import eight_bytes, mix, ragged, range_hash, read_table, spans_of_bytes, stretch_hash, string_views

#: Repeats of fewer words don't count as repetition.
MIN_REPEAT = 10
#: Largest covered fraction of the words, and longest repeat in words, of a text that is kept.
MAX_COVERED = 0.45
MAX_LONGEST = 200
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_repeats")
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and whether each place in it starts a new key."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, new


def _repeated(new: np.ndarray) -> np.ndarray:
    """Places of a sorted order whose key occurs twice or more."""
    last = np.append(new[1:], True)
    return ~(new & last)


class SuffixRuns:
    """Word suffixes of many texts that share 3 words or more with another suffix of the same text, sorted, with common prefixes.

    ``key`` numbers the 3-word windows (text included) at each word, ``has`` tells where a window fits."""

    def __init__(self, key: np.ndarray, has: np.ndarray, word: np.ndarray, doc: np.ndarray):
        n = len(word)
        self.word, self.doc = word, doc
        at = np.flatnonzero(has)
        order, new = _groups(key[at])
        self.repeated = at[order[_repeated(new)]]  # every word that starts a repeated window
        # A suffix is compared with another at its own start or right after words that are all in repeated windows.
        wanted = np.zeros(n, bool)
        for k in range(4):
            wanted[(self.repeated + k)[self.repeated + k < n]] = True
        wanted = np.flatnonzero(wanted)
        first = [np.where((wanted + k < n) & (doc[np.minimum(wanted + k, n - 1)] == doc[wanted]), word[np.minimum(wanted + k, n - 1)], np.uint64(0)) for k in range(3)]
        order = np.lexsort((first[2], first[1], first[0], doc[wanted]))
        self.sorted = wanted[order]
        new = np.ones(len(order), bool)
        for part in (*first, doc[wanted]):
            new[1:] = (part[order[1:]] != part[order[:-1]]) | (new[1:] if part is not first[0] else False)
        self.ranks: list[np.ndarray] = []  # for each depth the place of a suffix's group in the order
        rank = np.full(n, -1)
        rank[self.sorted] = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        place, step = np.flatnonzero(_repeated(new)), 3
        while len(place):
            self.ranks.append(rank)
            tied = self.sorted[place]
            second = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
            order = np.lexsort((second, rank[tied]))
            a, b = rank[tied[order]], second[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            self.sorted[place] = tied[order]
            rank = rank.copy()
            rank[tied[order]] = place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            place = place[_repeated(new)]
            step *= 2
        self.lcp = self._prefixes()

    def _prefixes(self) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it (0 across texts)."""
        n, s = len(self.word), self.sorted
        out = np.zeros(len(s), np.int64)
        if len(s) < 2:
            return out
        i, j = s[1:].copy(), s[:-1].copy()
        own = self.doc[i] == self.doc[j]
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[level], 3 << level
            same = (i < n) & (j < n)
            same[same] = rank[i[same]] == rank[j[same]]
            i, j, got = i + width * same, j + width * same, got + width * same
        for _ in range(2):
            same = own & (i < n) & (j < n)
            x, y = i[same], j[same]
            same[same] = (self.word[x] == self.word[y]) & (self.doc[x] == self.doc[s[1:][same]]) & (self.doc[y] == self.doc[s[:-1][same]])
            i, j, got = i + same, j + same, got + same
        out[1:] = np.where(own, got, 0)
        return out

    def maximal_repeats(self, least: int) -> list[tuple[int, int, int]]:
        """(words, first, last place in the sorted order) of each common-prefix interval of at least that many words
        whose occurrences differ in the word before."""
        before = np.where((self.sorted > 0) & (self.doc[np.maximum(self.sorted - 1, 0)] == self.doc[self.sorted]), self.word[np.maximum(self.sorted - 1, 0)].view(np.int64), -1 - self.sorted)
        changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))) if len(before) else before
        deep = self.lcp >= least
        out = []
        runs = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
        for a, b in zip(runs[::2], runs[1::2], strict=True):  # lcp[a:b] are all deep: suffixes a - 1 .. b - 1
            stack: list[tuple[int, int]] = []
            for k, depth in enumerate([*self.lcp[a:b].tolist(), 0]):
                left = a + k - 1
                while stack and stack[-1][0] > depth:
                    d, left = stack.pop()
                    if changes[a + k - 1] > changes[left]:
                        out.append((d, left, int(a + k - 1)))
                if depth and (not stack or stack[-1][0] < depth):
                    stack.append((depth, left))
        return out


def measure_block(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> np.ndarray:
    """Texts -> an array of len(COUNTS) rows, a column for each text."""
    n = len(offsets) - 1
    out = np.zeros((len(COUNTS), n), np.int64)
    if not len(data):
        return out
    per_doc = lambda flags: (c := np.concatenate(([0], np.cumsum(flags, dtype=np.int64))))[offsets[1:]] - c[offsets[:-1]]
    is_word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], is_word[:-1])), np.concatenate((is_word[1:], [False]))
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    out[1] = per_doc(is_word & ((data & 0xC0) != 0x80))
    out[2] = per_doc(_SYMBOL[data])
    eight = eight_bytes(data)

    # Lines: from each text's start or newline to the next.
    cuts = np.flatnonzero(data == 10)
    some = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = np.sort(np.concatenate((some, cuts + 1)))
    begin = begin[(begin < len(data))]
    close = np.minimum(np.concatenate((cuts, [len(data)]))[np.searchsorted(cuts, begin)], offsets[np.searchsorted(offsets, begin, "right")])
    begin, first = np.unique(begin, return_index=True)
    close = close[first]
    words_to = np.concatenate(([0], np.cumsum(is_word, dtype=np.int64)))
    full = words_to[close] > words_to[begin]
    begin, close = begin[full], close[full]
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    order, new = _groups(mix(stretch_hash(data, begin, close)[:, 0] + line_doc.astype(np.uint64) * _A))
    out[3] = np.bincount(line_doc[order[~new]], minlength=n)

    doc = np.searchsorted(offsets, starts, "right") - 1
    out[0] = np.bincount(doc, minlength=n)
    if len(starts) < 3:
        return out
    word = range_hash(eight, starts, ends - starts)
    has = np.zeros(len(word), bool)
    has[:-2] = doc[2:] == doc[:-2]
    key = np.zeros(len(word), np.uint64)
    key[:-2] = mix(mix(word[:-2] * _A + word[1:-1] * _B + word[2:] * _C) + doc[:-2].astype(np.uint64) * _A)
    runs = SuffixRuns(key, has, word, doc)
    hit = np.zeros(len(word), bool)
    for k in range(3):
        hit[runs.repeated + k] = True
    out[4] = np.bincount(doc[hit], minlength=n)
    repeats = runs.maximal_repeats(min_repeat)
    if repeats:
        depth, left, right = np.array(repeats, np.int64).T
        which = ragged(left, right - left + 1)
        at, length = runs.sorted[which], np.repeat(depth, right - left + 1)
        marks = np.zeros(len(word) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        out[5] = np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=n)
        np.maximum.at(out[6], doc[at], length)
        out[7] = np.bincount(doc[runs.sorted[left]], minlength=n)
    return out


def quality(text: Column, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """A struct of the counts and the verdict for a text."""

    @F.arrow_udf(SCHEMA)
    def measured(texts: pa.Array) -> pa.Array:
        data, offsets = string_views(texts)
        parts = [measure_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_repeat) for i, j in spans_of_bytes(offsets, BLOCK_BYTES)]
        c = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
        failed = (c[0] < 50) | (100 * c[4] > 50 * c[0])
        kept = ~failed & (c[5] <= max_covered * c[0]) & (c[6] <= max_longest)
        return pa.StructArray.from_arrays([*map(pa.array, c), pa.array(failed), pa.array(kept)], fields=[pa.field(f.name, pa.bool_() if f.dataType == T.BooleanType() else pa.int64()) for f in SCHEMA])

    return measured.asNondeterministic()(text.cast("string"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), quality(F.col("text"), **limits).alias("q"))
    return rows.filter("q.kept").select("row.*")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*")
