"""URL filter by association rules.

A list of (action, host, path) rules judges the urls that it fits (``listed``); those verdicts are the labels. Spark's FP-growth
mines the combinations of url tokens that go with a label in at least ``min_support`` of the labelled urls (``mine``). Of the
combinations that imply a label with ``min_confidence``, those are dropped that a part of them implies as surely. What is left
judges the urls that no rule fits (``judge``): an inverted index leads from a combination's rarest token to the combination, so
an url meets only those that share it, and containment is checked there. The surest combination wins (confidence, then
support, then fewer tokens, then code point order); an url that meets none is allowed.

Tokens: host labels from the right (``h1=org``, ``h2=example``), path segments from the left (``p1=en``; one that begins with a digit
is ``p2=#`` and that digit), the file ending (``x=html``), names of query parameters (``q=page``). Combinations of host labels stand
for domains, so a host of many labels has as many tokens and no quadratic list of suffixes.

Size: the tokens of combinations are frequent ones, (tokens of a labelled url on average) / min_support at most, a list that
FP-growth itself holds in the driver. Urls are judged by their different sets of such tokens: a set that a third of all urls
share is judged once, and comes back by a broadcast join, beyond BROADCAST_ROWS sets by a salted one.

Edges: a null url or one without ``://`` has no host, path and tokens; no rule fits it and it is allowed. Repeated rows are judged
alike and all stay; an empty table gives no rows; without labelled urls nothing is mined; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.llm.common import BROADCAST_ROWS, ascii_lower, materialize, read_table

#: The rules of the query: (action, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
#: Copies of each token set in the join of more than BROADCAST_ROWS sets.
SALTS = 16
_LABEL = "v="


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of an url; both empty for null and without ``://``."""
    text, pattern = F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, action) of the longest rule that fits a host or its subdomains and a path's beginning, else null."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of an url."""
    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p, i: F.concat(F.lit(kind), (i + 1).cast("string"), F.lit("="), F.regexp_replace(p, "^([0-9]).*$", "#$1") if kind == "p" else p))

    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)/?$", 1)
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(asked, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("q="), F.substring_index(p, "=", 1)))
    return F.array_distinct(F.concat(
        numbered("h", F.reverse(F.split(host, r"\."))), numbered("p", F.split(path, "/")),
        F.when(ending != "", F.array(F.concat(F.lit("x="), ending))).otherwise(F.array().cast("array<string>")), names,
    ))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, label) -> stored rules (pattern, tokens, label, confidence, support), without those that a part of them makes needless."""
    spark = labelled.sparkSession
    items = materialize(labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(_LABEL), F.col("label")))).alias("items")), "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], "pattern string, tokens array<string>, label string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    label = F.element_at("consequent", 1)
    rules = model.associationRules.filter(label.startswith(_LABEL)).select(
        F.sort_array("antecedent").alias("tokens"), F.substring(label, len(_LABEL) + 1, 1 << 30).alias("label"), "confidence", "support"
    )
    rules = materialize(rules.withColumn("pattern", F.array_join("tokens", " ")), "url-rules")
    # A part of a rule shares its own first token with it, so parts are found by that token.
    parts = rules.select(F.element_at("tokens", 1).alias("token"), F.col("tokens").alias("part"), F.col("label").alias("p_label"), F.col("confidence").alias("p_confidence"))
    whole = rules.select("pattern", "tokens", "label", "confidence", F.explode("tokens").alias("token"))
    contained = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    needless = whole.join(parts, "token").filter(contained & (F.col("label") == F.col("p_label")) & (F.col("p_confidence") >= F.col("confidence"))).select("pattern", "label").distinct()
    return materialize(rules.join(needless, ["pattern", "label"], "left_anti"), "url-rules")


def judge(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Different ``tokens`` arrays -> (tokens, best): the surest of the rules that an array contains, as struct(label, pattern, confidence); arrays without one are left out."""
    used = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = rules.select("*", F.explode("tokens").alias("token")).join(used, "token").groupBy("pattern", "label").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = rules.withColumnRenamed("tokens", "need").join(rarest, ["pattern", "label"])
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), F.size("need"), "pattern", "label")
    return met.groupBy("tokens").agg(F.min_by(F.struct("label", "pattern", "confidence"), order).alias("best"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT, key: str = "page_id", url: str = "url") -> DataFrame:
    """Pages -> (key, host, path, rule, verdict, pattern, confidence), one row a page; ``pattern`` is the mined rule that judged it."""
    host, path = host_path(F.col(url))
    parts = pages.select(F.col(key), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("listed", listed(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    stored = materialize(parts.select(key, "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.action").alias("action"), "tokens"), "urls")
    mined = mine(stored.filter("action IS NOT NULL").select("tokens", F.col("action").alias("label")), min_support, min_confidence)
    known = [r["token"] for r in mined.select(F.explode("tokens").alias("token")).distinct().collect()]  # frequent tokens only, see above
    kept = F.array_intersect("tokens", F.array(*[F.lit(t) for t in known])) if known else F.array().cast("array<string>")
    # Judged by the list: no tokens needed.
    kept = F.when(F.col("action").isNull(), F.sort_array(kept)).otherwise(F.array().cast("array<string>"))
    rows = stored.withColumn("tokens", kept)
    sets = rows.filter(F.size("tokens") > 0).select("tokens").distinct()
    best = materialize(judge(sets, mined), "url-sets")
    if best.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(best), "tokens", "left")
    else:
        copies = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(key, "host", "path"), F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, ["tokens", "salt"], "left")
    verdict = F.coalesce("action", "best.label", F.lit(default)).alias("verdict")
    return joined.select(key, "host", "path", "rule", verdict, F.col("best.pattern").alias("pattern"), F.col("best.confidence").alias("confidence"))


ORACLE = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
k(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
l AS (SELECT u.*,
    (SELECT arg_max(rh || rp, length(rh || rp)) FROM k WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT arg_max(action, length(rh || rp)) FROM k WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)) AS action,
    list_filter(list_reverse(string_split(host, '.')), lambda x: x <> '') AS hs, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps,
    regexp_extract(path, '\.([A-Za-z0-9]+)/?$', 1) AS ending,
    list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS qs FROM u),
t AS (SELECT page_id, host, path, rule, action, row_number() OVER () AS rid, list_sort(list_distinct(list_concat(list_concat(list_concat(
    list_transform(hs, lambda x, i: 'h' || i || '=' || x), list_transform(ps, lambda x, i: 'p' || i || '=' || regexp_replace(x, '^([0-9]).*$', '#\1'))),
    CASE WHEN ending <> '' THEN ['x=' || ending] ELSE []::VARCHAR[] END), list_transform(qs, lambda x: 'q=' || split_part(x, '=', 1))))) AS toks FROM l),
m AS (SELECT ceil(0.005::DOUBLE * count(*))::BIGINT AS least FROM t WHERE action IS NOT NULL),
f AS (SELECT tok FROM (SELECT unnest(toks) AS tok FROM t WHERE action IS NOT NULL) GROUP BY tok HAVING count(*) >= (SELECT least FROM m)),
s AS (SELECT coalesce(list_sort(list(tok) FILTER (tok IN (SELECT tok FROM f))), []) AS toks, action FROM (SELECT rid, action, unnest(toks) AS tok FROM t WHERE action IS NOT NULL) GROUP BY rid, action),
g AS (SELECT toks, action, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT toks, action, n, 0 AS pos, []::VARCHAR[] AS sub FROM g
  UNION ALL SELECT toks, action, n, pos + 1, CASE WHEN keep THEN list_append(sub, toks[pos + 1]) ELSE sub END FROM r, (VALUES (true), (false)) AS c(keep) WHERE pos < len(toks)),
c AS (SELECT sub, sum(n)::BIGINT AS n, sum(n) FILTER (action = 'allow')::BIGINT AS allow, sum(n) FILTER (action = 'block')::BIGINT AS block FROM r WHERE pos = len(toks) AND len(sub) > 0 GROUP BY sub),
a AS (SELECT sub, 'allow' AS label, allow::DOUBLE / n::DOUBLE AS confidence, allow AS support FROM c WHERE allow >= (SELECT least FROM m)
  UNION ALL SELECT sub, 'block', block::DOUBLE / n::DOUBLE, block FROM c WHERE block >= (SELECT least FROM m)),
b AS (SELECT *, array_to_string(sub, ' ') AS pattern FROM a WHERE confidence >= 0.8),
e AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS y WHERE y.label = b.label AND y.confidence >= b.confidence AND len(y.sub) < len(b.sub) AND list_has_all(b.sub, y.sub))),
w AS (SELECT rid, label, pattern, confidence FROM t JOIN e ON list_has_all(t.toks, e.sub) WHERE action IS NULL
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, support DESC, len(sub), pattern, label) = 1)
SELECT page_id, host, path, rule, coalesce(action, label, 'allow') AS verdict, pattern, confidence FROM t LEFT JOIN w USING (rid)
"""


def op13_url_rules(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
