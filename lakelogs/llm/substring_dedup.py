"""Substring dedup by hashing units: paragraphs, their lines, the sentences of lines, and runs of one word.

A unit is a paragraph (what blank lines separate), a line, or a sentence of a line (what ends with ``.``, ``!`` or ``?`` before a
blank), so that a passage that was pasted into the middle of a line is found by the sentences it brings along. A run is a word
that a line repeats ``run_words`` times in sequence; longer runs are cut into as many units as they have whole lots of words,
because such passages have no sentence ends and rarely equal length. Units are
normalised (A-Z in lower case, runs of blanks to one, trimmed), digested with 128 bits, and grouped over all documents, whatever
their kind. Of each digest that occurs again, the earliest occurrence stays, ranked by (doc_id, start, end); the
others are removed and keep their offsets in the original text. Only units of ``min_chars`` normalised code points or
more count (sentences: ``min_sentence``), so short headings and phrases stay. With several kinds, a paragraph of one line
counts as that line, a line of one sentence as the line, and a run that is a whole line or sentence as that one.

The keeper of a digest is an aggregate (combined before the shuffle), so one digest in a third of all documents
costs a row a task. The keepers of repeated digests are stored, and removals are a join of the units with them that has nothing
else in its stage: Spark broadcasts them where they are small, and splits a hot digest's partition where not.

Edges: a null or empty text has no units; blank lines are no units; repeated rows: the same doc_id twice counts as
one document's occurrence at the same place, and both rows are removed alike but for the kept place; an empty
table gives no rows; null doc_ids rank first; a long text is cut whole, in one task; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelogs.llm.common import materialize, ragged, read_table, spans_of_bytes, stretch_hash, string_views

MIN_CHARS = 20
MIN_SENTENCE = 40
RUN_WORDS = 50
UNITS = ("paragraph", "line", "sentence", "run")
BLOCK_BYTES = 1 << 19
SCHEMA = "doc_id long, unit byte, start int, end int, high long, low long"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(norm: np.ndarray, x: np.ndarray, y: np.ndarray, new_line: np.ndarray, words: int) -> np.ndarray:
    """Words norm[x:y] -> the first word of each lot of ``words`` equal words in sequence, within a line."""

    def lengths() -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(~same)
        return first, np.diff(first, append=len(x))

    middle = (x + y) // 2
    same = ~new_line
    for place in (x, middle, y - 1):
        same[1:] &= norm[place[1:]] == norm[place[:-1]]
    same[1:] &= (y - x)[1:] == (y - x)[:-1]
    first, count = lengths()
    long = count >= words
    if not long.any():
        return np.zeros(0, np.int64)
    maybe = ragged(first[long], count[long])  # what three bytes and the length can't tell apart is compared as a whole
    digest = stretch_hash(norm.tobytes(), x[maybe], y[maybe])
    same[maybe[1:]] &= (digest[1:] == digest[:-1]).all(axis=1)
    first, count = lengths()
    lots = count // words
    return np.repeat(first, lots) + words * ragged(np.zeros(len(lots), np.int64), lots)


def _whole(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether first..last is all of a stretch that starts at a flag."""
    starts = np.append(flags, True)
    return starts[first] & starts[last + 1] & (np.cumsum(flags)[first] == np.cumsum(flags)[last])


def _block(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, units: Sequence[str], least: Sequence[int], run_words: int) -> pa.RecordBatch:
    blank = _BLANK[data]
    full = np.flatnonzero(~blank)  # every unit starts and ends at one of these
    row = np.searchsorted(offsets, full, "right") - 1
    newlines = np.concatenate(([0], np.cumsum(data == 10)))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    # Between a full byte and the one before: another text, a gap, and the newlines in it.
    other = np.ones(len(full), bool)
    other[1:] = row[1:] != row[:-1]
    gap, lines = ~other, np.zeros(len(full), np.int64)
    gap[1:] &= full[1:] > full[:-1] + 1
    lines[1:] = newlines[full[1:]] - newlines[full[:-1]]
    new_line, new_par = other | (lines > 0), other | (lines > 1)
    new_sentence = new_line.copy()
    new_sentence[1:] |= gap[1:] & _STOP[data[full[:-1]]]
    # Normalised text: full bytes in lower case, and one space for each gap.
    spaced = full.astype(np.int64) * 0 + 1
    spaced[gap] += 1
    at = np.cumsum(spaced) - 1  # of each full byte in the normalised text
    norm = np.full(int(at[-1]) + 1 if len(at) else 0, 32, np.uint8)
    norm[at] = _LOWER[data[full]]
    norm_points = np.concatenate(([0], np.cumsum((norm & 0xC0) != 0x80)))
    found = []
    for unit, flags in zip(UNITS, (new_par, new_line, new_sentence, other | gap), strict=True):
        if unit not in units:
            continue
        first = np.flatnonzero(flags)
        last = np.append(first[1:], len(full)) - 1
        if unit == "run":
            lot = _runs(norm, at[first], at[last] + 1, new_line[first], run_words)
            first, last = first[lot], last[lot + run_words - 1]
        a, b = full[first], full[last] + 1
        if unit == "paragraph" and "line" in units:
            keep = newlines[b] > newlines[a]
        elif unit == "sentence" and "line" in units:
            line = np.cumsum(new_line)[first]
            keep = np.bincount(line)[line] > 1
        elif unit == "run":
            keep = np.ones(len(first), bool)
            for name, starts in (("line", new_line), ("sentence", new_sentence)):
                if name in units:
                    keep &= ~_whole(starts, first, last)
        else:
            keep = np.ones(len(first), bool)
        keep &= norm_points[at[last] + 1] - norm_points[at[first]] >= least[UNITS.index(unit)]
        first, last, a, b = first[keep], last[keep], a[keep], b[keep]
        if unit == "line":  # with the blanks around it
            cuts = np.flatnonzero(data == 10)
            bounds = np.sort(np.concatenate((cuts + 1, offsets[:-1])))
            ends = np.sort(np.concatenate((cuts, offsets[1:])))
            b = ends[np.searchsorted(ends, b)]
            a = bounds[np.searchsorted(bounds, a, "right") - 1]
        found.append((np.full(len(first), UNITS.index(unit), np.int8), row[first], a, b, at[first], at[last] + 1))
    kind, row, a, b, x, y = (np.concatenate(part) for part in zip(*found, strict=True))
    digest = stretch_hash(norm.tobytes(), x, y).view(np.int64)
    base = points[offsets[row]]
    cols = [ids.take(pa.array(row)), pa.array(kind), pa.array(points[a] - base, pa.int32()), pa.array(points[b] - base, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "unit", "start", "end", "high", "low"])


def _cut(batches: Iterator[pa.RecordBatch], units: Sequence[str], least: Sequence[int], run_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_views(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64())
        for i, j in spans_of_bytes(offsets, BLOCK_BYTES):
            yield _block(ids.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], units, least, run_words)


def units_of(docs: DataFrame, units: str | Sequence[str] = "line", min_chars: int = MIN_CHARS, min_sentence: int = MIN_SENTENCE, run_words: int = RUN_WORDS) -> DataFrame:
    """Documents -> (doc_id, unit, start, end, high, low): a row for each unit with its digest; ``unit`` is a place in UNITS,
    offsets are code points in the text, end exclusive."""
    named = [units] if isinstance(units, str) else list(units)
    if not named or not set(named) <= set(UNITS):
        raise ValueError(f"units are {UNITS}")
    if run_words < 2:
        raise ValueError("a run has two words or more")
    least = (min_chars, min_chars, min_sentence, 0)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, named, least, run_words), SCHEMA)


def repeated_units(docs: DataFrame, units: str | Sequence[str] = "line", min_chars: int = MIN_CHARS, min_sentence: int = MIN_SENTENCE, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, unit, start, end, kept_doc_id, kept_start): every occurrence that goes, and the one that stays instead."""
    found = materialize(units_of(docs, units, min_chars, min_sentence, run_words), "units")
    place = F.struct("doc_id", "start", "end")
    keep = found.groupBy("high", "low").agg(F.min(place).alias("k"), F.count("*").alias("n")).filter("n > 1").select("high", "low", "k")
    gone = found.join(materialize(keep, "kept_units"), ["high", "low"]).filter(~place.eqNullSafe(F.col("k")))
    name = F.element_at(F.array(*map(F.lit, UNITS)), F.col("unit").cast("int") + 1)
    return gone.select("doc_id", name.alias("unit"), "start", "end", F.col("k.doc_id").alias("kept_doc_id"), F.col("k.start").alias("kept_start"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM d)),
ln AS (SELECT doc_id, (i - 1 + coalesce(list_sum(list_transform(t[1 : i - 1], lambda x: len(x))), 0))::INT AS start, t[i] AS x FROM l),
s AS (SELECT doc_id, start, p, unnest(range(1, len(p) + 1)) AS i FROM (
        SELECT doc_id, start, list_filter(regexp_extract_all(x, '(?:[^.!?]|[.!?]+[^.!?\x20\x09-\x0D])*[.!?]*[\x20\x09-\x0D]*'), lambda x: x <> '') AS p FROM ln) WHERE len(p) > 1),
sn AS (SELECT doc_id, (start + coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: len(x))), 0))::INT AS start, p[i] AS x FROM s),
g AS (SELECT doc_id, regexp_split_to_array(text, '\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*') AS p, regexp_extract_all(text, '\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*') AS q FROM d),
gp AS (SELECT doc_id, p, q, unnest(range(1, len(p) + 1)) AS i FROM g),
pn AS (SELECT doc_id, (coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(q[1 : i - 1], lambda x: len(x))), 0))::INT AS start, p[i] AS x FROM gp),
tr AS (SELECT doc_id, unit, (start + len(x) - len(regexp_replace(x, '^[\x20\x09-\x0D]+', '')))::INT AS start, regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS x
       FROM (SELECT doc_id, 'sentence' AS unit, start, x FROM sn UNION ALL SELECT doc_id, 'paragraph', start, x FROM pn)),
u AS (SELECT doc_id, unit, start, x FROM tr WHERE unit = 'sentence' OR contains(x, chr(10)) UNION ALL SELECT doc_id, 'line', start, x FROM ln),
n AS (SELECT doc_id, unit, start, (start + len(x))::INT AS "end",
        trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM u),
wl AS (SELECT *, row_number() OVER () AS line FROM (SELECT doc_id, start, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS p FROM ln) WHERE len(p) >= 50),
wu AS (SELECT doc_id, start, line, len(p) AS words, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM wl),
wk AS (SELECT *, regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', '') AS k, start + sum(len(t)) OVER (PARTITION BY line ORDER BY i) AS till FROM wu),
wf AS (SELECT *, lag(k) OVER (PARTITION BY line ORDER BY i) AS before FROM wk),
wg AS (SELECT *, sum((before IS NULL OR before <> k)::INT) OVER (PARTITION BY line ORDER BY i) AS g FROM wf),
wj AS (SELECT *, (row_number() OVER (PARTITION BY line, g ORDER BY i) - 1) // 50 AS lot FROM wg),
rn AS (SELECT doc_id, 'run' AS unit, min(till - len(k))::INT AS start, max(till)::INT AS "end", repeat(any_value(k) || ' ', 49) || any_value(k) AS norm
       FROM wj GROUP BY doc_id, line, words, g, lot HAVING count(*) = 50
         AND NOT (max(i) = words AND (words = 50 OR (NOT regexp_matches(any_value(k), '[.!?]$') AND regexp_matches(arg_min(coalesce(before, '.'), i), '[.!?]$'))))),
b AS (SELECT * FROM n WHERE len(norm) >= CASE unit WHEN 'sentence' THEN 40 ELSE 20 END UNION ALL SELECT * FROM rn),
k AS (SELECT norm, min(row(doc_id, start, "end")) AS k FROM b GROUP BY norm HAVING count(*) > 1),
j AS (SELECT b.*, k.k FROM b JOIN k ON b.norm = k.norm)
SELECT doc_id, unit, start, "end", struct_extract(k, 1) AS kept_doc_id, struct_extract(k, 2) AS kept_start FROM j WHERE row(doc_id, start, "end") <> k
"""


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_units(read_table(spark, sf_dir, "documents"), UNITS)
