"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans stand alone: assignments of a password, token or key of 12+ characters, AKIA access ids of 18+,
hexadecimal runs of 16+. Weak parts mean little alone: identifiers (``client_id = x``, ``user: x``), bare
40-character key material, and endpoints (URLs, ``host = x``). A weak part is reported only when complementary
parts lie in its scope, at most ``scope`` code points away within the document:

    ident     a secret (assign, hex or key) in scope
    key       an access id, an ident or an endpoint in scope
    endpoint  a secret and (an access id or an ident) in scope

The interval join takes the gap between two intervals, from the end of one to the start of the other, whichever comes
first; overlapping ones have none. It is a sweep without pairs: the complements that start no later than a part are
near it if their largest end so far is, those that start later if the next start is, both running values over the
document's parts in order.

Positions come from the lengths of split pieces and matches in turn, exploded with their place and summed up by a running sum, so a
text costs what its matches cost, however many they are. Texts themselves are never shuffled. Positions are code
points, end exclusive; matches are leftmost and do not overlap within a kind.

Edges: a null or empty text has no spans; repeated (doc_id, text) rows are one document (they are told apart by doc_id and a
64-bit hash of the text); a null doc_id is a document as any other; a document without spans has a row with zero
counts; a long text's matches are swept in one task; an empty table gives an empty result; other columns are not
looked at. A weak span that overlaps a strong one of a complementary kind is still reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.llm.common import read_table

SCOPE = 200
#: Characters that an assigned value has at least.
VALUE_CHARS = 12
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""(?i:(?:access_?key_?id|client_?id|account(?:_?id)?|user(?:name)?|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"""(?:(?i:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb)://[^\x20\x09-\x0D"'<>]+)|(?:(?i:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,})"""
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
PATTERNS = (ASSIGN, ACCESS, HEX, IDENT, KEY, ENDPOINT)


SPANS = "array<struct<kind:int,pieces:array<struct<gap:int,hit:int,ok:boolean>>>>"


def _pieces(text: Column, kind: int) -> Column:
    """(kind, pieces) of the pattern's matches, null if there is none: each piece is the length of the text before a match, that
    of the match, and whether it counts; the text after the last match is a piece without one."""
    pattern, lengths = PATTERNS[kind], lambda words: F.transform(words, F.length)
    gaps = lengths(F.split(text, pattern, -1)).alias("gap")
    hits = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("hit")
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.transform(values, lambda v: F.length(v) >= (VALUE_CHARS if kind == 0 else 0)).alias("ok")
    return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.arrays_zip(gaps, hits, counts).alias("pieces")))


def spans(docs: DataFrame) -> DataFrame:
    """Documents -> (doc_id, h, kind, start, end), a row for each match; one row with nulls for a document without any.
    Partitioned by (doc_id, h)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.filter(F.array(*[_pieces(text, k) for k in range(len(KINDS))]), lambda s: s.isNotNull()).cast(SPANS)
    each = docs.select("doc_id", F.xxhash64(text).alias("h"), F.explode_outer(found).alias("s"))
    each = each.select("doc_id", "h", "s.kind", F.posexplode_outer("s.pieces").alias("n", "p")).select("doc_id", "h", "kind", "n", "p.*")
    each = each.repartition("doc_id", "h").distinct().filter("hit IS NOT NULL OR kind IS NULL")
    upto = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("doc_id", "h", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ends = each.withColumn("end", upto).filter("ok OR kind IS NULL OR n = 0").withColumn("kind", F.when(F.col("ok"), F.col("kind")))
    return ends.select("doc_id", "h", "kind", F.when(F.col("ok"), F.col("end") - F.col("hit")).alias("start"), F.when(F.col("ok"), F.col("end")).alias("end"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Documents -> (doc_id, parts), one row a document; parts: sorted array of (start, kind, end) that are reported."""
    each = spans(docs)
    own = Window.partitionBy("doc_id", "h")
    before, after = own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0), own.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    groups = {"secret": ("assign", "hex", "key"), "owner": ("access", "ident"), "place": ("access", "ident", "endpoint")}
    of = {name: F.col("kind").isin(*[KINDS.index(k) for k in kinds]) for name, kinds in groups.items()}
    each = each.withColumns({f"{name}_end": F.max(F.when(test, F.col("end"))).over(before) for name, test in of.items()})
    each = each.withColumns({f"{name}_start": F.min(F.when(test, F.col("start"))).over(after) for name, test in of.items()})
    near = {name: F.coalesce((F.col(f"{name}_end") >= F.col("start") - scope) | (F.col(f"{name}_start") <= F.col("end") + scope), F.lit(False)) for name in groups}
    linked = (
        F.when(F.col("kind") < 3, True)
        .when(F.col("kind") == 3, near["secret"])
        .when(F.col("kind") == 4, near["place"])
        .when(F.col("kind") == 5, near["secret"] & near["owner"])
    )
    return each.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.when(linked, F.struct("start", "kind", "end")))).alias("parts")).drop("h")


def listed(parts: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(parts, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _oracle() -> str:
    """The query's result as DuckDB SQL; its patterns know no look-around, so runs of key characters are taken whole and measured."""
    found = []
    for k, pattern in enumerate(PATTERNS):
        p = "'" + ("[A-Za-z0-9+/]+" if KINDS[k] == "key" else pattern).replace("'", "''") + "'"
        value = f"regexp_extract_all(t, {p}, {2 if k == 0 else 0})"
        test = {"assign": f"len(v[i]) >= {VALUE_CHARS}", "key": "len(v[i]) = 40"}.get(KINDS[k], "true")
        found.append(
            f"SELECT doc_id, t, {k} AS kind, s, s + len(m[i]) AS e FROM (SELECT *, (list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::INT AS s "
            f"FROM (SELECT doc_id, t, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, {value} AS v FROM d))) WHERE {test}"
        )
    near = lambda *kinds: f"EXISTS (SELECT 1 FROM a b WHERE b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.t = a.t AND b.kind IN ({', '.join(str(KINDS.index(k)) for k in kinds)}) AND b.s <= a.e + {SCOPE} AND b.e >= a.s - {SCOPE})"
    secret, owner, place = near("assign", "hex", "key"), near("access", "ident"), near("access", "ident", "endpoint")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(found)}),
l AS (SELECT *, {names}[kind + 1] || ':' || s || ':' || e AS span FROM a WHERE kind < 3 OR (kind = 3 AND {secret}) OR (kind = 4 AND {place}) OR (kind = 5 AND {secret} AND {owner}))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.t = l.t GROUP BY d.doc_id, d.t
"""


ORACLE = _oracle()


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("parts", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("parts", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("parts")).alias("spans"),
    )
