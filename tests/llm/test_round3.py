"""Operators 11 to 13 against plain versions and their SQL, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns whose names the operators use themselves."""

import hashlib
import itertools
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakelogs.llm import alignment, decontaminate, divergence, line_dedup, secrets, sharding, token_store, url_rules
from lakelogs.llm.common import new_path
from tests.llm import brute

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHES = "batch string, pair long, place int, g int, n long, tokens string, listed string, pattern string, items string, leads string"
SF = "/root/testdata/sf0.001"


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, "b", 1, 2, 3, 4, "t", "l", "p", "i", "x") for r in rows], f"{schema}, {CLASHES}").repartition(3)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def from_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


# --- 11 -----------------------------------------------------------------------------------------------------


def plain_alignment(docs):
    """Rows of the contract by whole encodings, without stretches, lanes or batches."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    byte_of = {c: k for k, c in enumerate_bytes().items()}
    rows, held = [], Counter()
    for doc_id, text in docs:
        groups, want = [], (" " + (text or "")).encode()
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            found = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if b"".join(found[0]) == want == b"".join(found[1]):
                ends = [list(itertools.accumulate(map(len, f))) for f in found]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                group = lambda side, k: [i for i, e in zip(ids[side], ends[side], strict=True) if (cuts[k - 1] if k else 0) < e <= cuts[k]]
                groups = [(group(0, k), group(1, k)) for k in range(len(cuts))]
        links = [(x, y) for p, q in groups for x in p for y in q]
        held.update(set(links))
        rows.append((doc_id, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    shown = lambda gs: hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in gs).encode()).hexdigest() if gs else ""
    return sorted(
        ((d, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(ls), sum(held[x] == most[x[0]] for x in ls), sum(held[x] for x in ls), shown(gs)) for d, gs, ls in rows), key=repr
    )


def enumerate_bytes():
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {k: chr(k) if k in plain else chr(256 + i) for k, i in zip([*plain, *(k for k in range(256) if k not in plain)], [*[0] * len(plain), *range(256)], strict=False)}


def odd_texts():
    r = random.Random(11)
    words = ["the", "Ünder", "naïve", "日本語", "x_1", "don't", "hello", "tionble", "1234567", "e\u0301", "\u00a0", "\u3000", "😀", "ﬁ", "--", "\r\n", "\t\t", "  ", ";\r", "aaaaaaaaaaaaaaaaaaaaaaaaa", "<s>", "<0x0A>", "<|endoftext|>", "\u0000", "\u0085", "\u2003"]
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "a\n", "▁", "a ▁ b", "<unk>", "=" * 300, "ab" * 900, " " * 100, "\n" * 70]
    texts += ["".join(r.choice(words) + r.choice(["", " ", " ", "\n", "\t", "  "]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    return [*texts, " ".join(r.choice(words[:9]) for _ in range(9000)), texts[40], texts[41]]


def test_alignment(spark, monkeypatch):
    docs = [*enumerate(odd_texts()), (None, "the hello"), (None, None), (3, "the hello")]
    got = alignment.aligned_documents(alignment.align(clashing(spark, docs, "doc_id long, text string"), A_PATH, B_PATH))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert values(got) == plain_alignment(docs)


def test_alignment_in_small_batches_and_lanes(monkeypatch):
    """Results don't depend on the sizes of pieces, lanes, caches or wide groups."""
    docs = odd_texts()
    encode = alignment.PairEncoder(A_PATH, B_PATH)
    raw = [(t or "").encode() for t in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    want = alignment._aligned(encode, data, offsets)
    monkeypatch.setattr(alignment, "LANE", 7)
    monkeypatch.setattr(alignment, "WIDE", 2)
    monkeypatch.setattr(alignment, "SLICE", 13)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 10)
    for got in (alignment._aligned(encode, data, offsets), alignment._aligned(alignment.PairEncoder(A_PATH, B_PATH), data, offsets)):
        for x, y in zip(got, want, strict=True):
            assert np.array_equal(x, y)


def test_alignment_over_batches(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(odd_texts()) if t and len(t) < 2000]
    parts = [alignment._align(iter(clashing(spark, docs[k::3], "doc_id long, text string").toArrow().to_batches()), A_PATH, B_PATH) for k in range(3)]
    stored = alignment.materialize(spark.createDataFrame([tuple(r.values()) for p in parts for b in p for r in b.to_pylist()], alignment._BATCH), "aligned")
    assert stored.count() == 3
    assert values(alignment.aligned_documents(stored)) == plain_alignment(docs)


def test_alignment_of_nothing(spark):
    none = clashing(spark, [(1, "a")], "doc_id long, text string").limit(0)
    assert alignment.aligned_documents(alignment.align(none, A_PATH, B_PATH)).count() == 0


# --- 12 -----------------------------------------------------------------------------------------------------


def plain_audit(docs, min_docs=3, top=200):
    import re

    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    kept = {la: [t for t, n in seen[la].items() if n >= min_docs] for la, _ in groups}
    rows = []
    share = lambda count, words, v: 1 + 1000000000 * (count + 1) // (words + v)
    words = {g: sum(counts[g][t] for t in kept[g[0]]) for g in groups}
    in_lang = lambda la, t: sum(counts[g][t] for g in groups if g[0] == la)
    far = lambda p, q: (p - q) * (p - q) // q
    for la, so in groups:
        terms, v = kept[la], len(kept[la])
        p = {t: share(counts[la, so][t], words[la, so], v) for t in terms}
        pairs = [(so2, sum(far(p[t], share(counts[la, so2][t], words[la, so2], v)) for t in terms)) for la2, so2 in groups if la2 == la and so2 != so]
        own = [(t, share(in_lang(la, t), sum(words[g] for g in groups if g[0] == la), v)) for t in terms if counts[la, so][t]]
        over = [(t, far(p[t], q)) for t, q in own if p[t] > q]
        for part, items, most in (("pair", pairs, None), ("term", over, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            rows += [(la, so, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])]
    return sorted(rows, key=repr)


def audited_texts():
    r = random.Random(12)
    vocab = ["Alpha", "beta", "ÉTÉ", "été", "naïve", "日本", "x", "it's", "a1b", "Zz", *(f"w{c}" for c in "abcdefghijklmnop")]
    docs = [(" ".join(r.choice(vocab) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "S3", "é", None, ""])) for _ in range(90)]
    docs += [(None, "en", "empty"), ("", "xx", "one"), ("alone alone", "xx", "two"), ("same", "yy", "only"), ("same", "yy", "only"), ("same", "yy", "only"), (None, None, None)]
    return [*docs, (" ".join(r.choice(vocab) for _ in range(20000)), "en", "s1"), docs[0], docs[0]]


@pytest.mark.parametrize("sizes", [{}, {"pieces": (50, 20), "block": 4, "tile": 2, "run": 32, "min_docs": 2, "top": 3}])
def test_audit(spark, sizes):
    docs = audited_texts()
    got = divergence.audit(clashing(spark, docs, "text string, lang string, source string"), **sizes)
    assert values(got) == plain_audit(docs, sizes.get("min_docs", 3), sizes.get("top", 200))


def test_audit_of_nothing(spark):
    assert divergence.audit(clashing(spark, [("a", "b", "c")], "text string, lang string, source string").limit(0)).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4])
def test_quadtree(k):
    """All nonzero cells are met, zeros only against them, in every run size."""
    r = np.random.default_rng(k)
    cells = r.random((13, 70)) < 0.15
    cells[4] = False
    cells[:, 20:50] = False
    row, column = np.nonzero(cells)
    shuffled = r.permutation(len(row))
    tree = divergence.Quadtree(row[shuffled], column[shuffled], k)
    value = (row * 1000 + column)[shuffled][tree.order]
    for run in (k * k, 1 << 16):
        met = Counter()
        for i, j, a, b in divergence.pair_leaves(tree, 13, run):
            for x, y, p, q in zip(i, j, a, b, strict=True):
                assert p < 0 or value[p] // 1000 == x
                assert q < 0 or value[q] // 1000 == y
                at = {int(value[c] % 1000) for c in (p, q) if c >= 0}
                assert len(at) == 1
                met[int(x), int(y), at.pop(), bool(p >= 0), bool(q >= 0)] += 1
        want = Counter((x, y, c, bool(cells[x, c]), bool(cells[y, c])) for x in range(13) for y in range(x + 1, 13) for c in range(70) if cells[x, c] or cells[y, c])
        assert met == want


def test_audit_sql(spark):
    names, rows = from_duckdb(divergence.ORACLE, documents=f"{SF}/documents.parquet")
    got = divergence.op12_source_divergence(spark, SF).select(*names)
    assert values(got) == sorted(rows, key=repr)


# --- 13 -----------------------------------------------------------------------------------------------------


def plain_filter(urls, support, confidence):
    """(host, path, rule, verdict, pattern) by counting every combination of every labelled url's tokens."""
    import re

    def parts(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        asked = re.search(r"://[^?#]*\?([^#]*)", url or "")
        end = re.search(r"\.([A-Za-z0-9]+)/?$", path)
        labels = [x for x in reversed(host.split(".")) if x]
        segments = [x for x in path.split("/") if x]
        toks = {f"h{i}={x}" for i, x in enumerate(labels, 1)} | {f"p{i}={'#' + x[0] if x[0] in '0123456789' else x}" for i, x in enumerate(segments, 1)}
        toks |= {f"q={x.split('=')[0]}" for x in (asked[1].split("&") if asked else []) if x} | ({"x=" + end[1]} if end else set())
        return host, path, (max(fits)[1:] if fits else (None, None)), toks

    found = [parts(u) for u in urls]
    labelled = [(t, r[1]) for _, _, r, t in found if r[0]]
    least = -(-len(labelled) * support // 1)
    number = Counter(x for t, _ in labelled for x in t)
    both, alone = Counter(), Counter()
    for t, label in labelled:
        common = sorted(x for x in t if number[x] >= least)
        for n in range(1, len(common) + 1):
            for c in itertools.combinations(common, n):
                alone[c] += 1
                both[c, label] += 1
    rules = {(c, label): (n / alone[c], n) for (c, label), n in both.items() if n >= least and n / alone[c] >= confidence}
    rules = {(c, v): s for (c, v), s in rules.items() if not any(rules.get((x, v), (0,))[0] >= s[0] for n in range(1, len(c)) for x in itertools.combinations(c, n))}
    rows = []
    for host, path, (rule, action), t in found:
        hits = sorted((-s[0], -s[1], len(c), " ".join(c), v) for (c, v), s in rules.items() if set(c) <= t) if not rule else []
        rows.append((host, path, rule, action or (hits[0][4] if hits else "allow"), hits[0][3] if hits else None))
    return sorted(rows, key=repr)


def odd_urls():
    r = random.Random(13)
    hosts = ["example.org", "m.ab.example.ORG", "www.x.com", "ab.example.com", "ab.example.net", "org", "notorg", "xexample.org", "com", "a..b.com", ""]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['es', 'en', 'fr', 'de', 'EN'])}/{r.choice(['1', '12', '7', 'x'])}{r.choice(['', '.html', '/', '?page=2&ref=x', '#top', '?'])}" for _ in range(160)]
    return [None, "", "no scheme", "http://", "http://org", "http://org/", "a://b://c/d", "http://org?x/es/", "http://example.org#/es/", "HTTP://Example.org/es/\n1", urls[3], urls[3], "http://com/fr/" + "a/" * 300, *urls]


def test_url_rules(spark):
    urls = odd_urls()
    pages = clashing(spark, list(enumerate(urls)), "page_id long, url string")
    got = url_rules.filter_urls(pages, min_support=0.04, min_confidence=0.7)
    assert values(got.select("host", "path", "rule", "verdict", "pattern")) == plain_filter(urls, 0.04, 0.7)
    assert got.count() == len(urls)


def test_url_rules_in_a_salted_join(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", 0)
    urls = odd_urls()
    got = url_rules.filter_urls(clashing(spark, list(enumerate(urls)), "page_id long, url string"), min_support=0.04, min_confidence=0.7)
    assert values(got.select("host", "path", "rule", "verdict", "pattern")) == plain_filter(urls, 0.04, 0.7)


def test_url_rules_of_nothing(spark):
    schema = "page_id long, url string"
    assert url_rules.filter_urls(clashing(spark, [(1, "http://a.org/")], schema).limit(0)).count() == 0
    unlabelled = url_rules.filter_urls(clashing(spark, [(1, "http://a.net/"), (None, None)], schema))
    assert values(unlabelled.select("verdict", "pattern")) == [("allow", None)] * 2


def test_url_rules_sql(spark, tmp_path):
    names, rows = from_duckdb(url_rules.ORACLE, pages=f"{SF}/pages.parquet")
    assert values(url_rules.op13_url_rules(spark, SF).select(*names)) == sorted(rows, key=repr)
    odd = str(tmp_path / "pages.parquet")
    clashing(spark, [(i, u) for i, u in enumerate(odd_urls()) if not u or len(u) < 200], "page_id long, url string").write.parquet(odd)
    names, rows = from_duckdb(url_rules.ORACLE, pages=f"{odd}/*.parquet")
    assert values(url_rules.op13_url_rules(spark, os.path.dirname(odd)).select(*names)) == sorted(rows, key=repr)


def test_longest_rule(spark):
    host, path = F.col("host"), F.col("path")
    rules = [("allow", "b.c", "/"), ("block", "c", "/x/y"), ("allow", "c", "/x/")]
    df = spark.createDataFrame([("a.b.c", "/x/y/z"), ("b.c", "/x/"), ("c", "/x/1"), ("xb.c", "/"), ("b.c", "")], "host string, path string")
    got = [tuple(r) for r in df.select(url_rules.listed(host, path, rules)["rule"], url_rules.listed(host, path, rules)["action"]).collect()]
    assert got == [("c/x/y", "block"), ("b.c/", "allow"), ("c/x/", "allow"), (None, None), (None, None)]


# --- 1, in groups above the limit ----------------------------------------------------------------------------


def chained_lines():
    """600 lines of one template in chains of four, each at about 0.85 to the next, some chains near each other; and a few very long ones."""
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, tail, lines = word(74), word(74), []
    for _ in range(150):
        own = word(52)
        for k in range(4):
            lines.append(head + own + tail)
            own = own[: 13 * k] + word(6) + own[13 * k + 6 :]
    return lines + [x[:100] + "#" + x[101:] for x in lines[:40:7]] + [lines[3][: -k] for k in range(1, 12, 2)]


@pytest.mark.parametrize("group_limit", [4096, 30, 8])
def test_line_dedup_in_large_groups(spark, group_limit):
    lines = chained_lines()
    sets = [line_dedup.shingle_set(x) for x in lines]
    root = brute.classes(len(lines), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.repeated_lines(docs, group_limit=group_limit).collect()}
    assert got == {i: c for i, c in enumerate(root) if i != c}
    assert len(set(root)) > 100


def test_line_dedup_of_long_lines(spark, monkeypatch):
    """Groups of long lines are cut by their code points."""
    r = random.Random(22)
    monkeypatch.setattr(line_dedup, "GROUP_POINTS", 30_000)
    base = "".join(r.choice("abcdefgh ") for _ in range(9000))
    lines = [base[: 700 * k] + "#" * 5 + base[700 * k :] for k in range(12)] + ["".join(r.choice("abcdefgh") for _ in range(9000)) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in line_dedup.repeated_lines(docs).collect())
    assert got == list(range(1, 12))


# --- 2, 5, 6 and 8 -------------------------------------------------------------------------------------------


def test_decontamination_with_a_full_bitmap(spark, monkeypatch):
    """Results don't depend on the bitmap: not on its size, nor when it lets everything through."""
    r = random.Random(31)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "Ñandu", "zeta", "x1"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, line(r.randint(1, 20))) for i in range(30)]
    docs = [(i, line(r.randint(0, 60))) for i in range(60)] + [(100 + i, f"{line(9)} {t} {line(3)}") for i, t in items[:10]]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(d, n, hit, len(of)) for (d, _), (n, hit, of) in zip(docs, brute.contamination(docs, items), strict=True)]
    for bits in ((1 << 16, 1 << 22), (64, 64)):
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        got = decontaminate.decontaminate(*frames).select("doc_id", "n_words", "n_hit", "n_items")
        assert values(got) == sorted(want, key=repr)


def test_null_and_empty_texts_are_one_document_of_secrets(spark):
    got = secrets.scan_secrets(spark.createDataFrame([(1, None), (1, ""), (2, None)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def test_tokens_of_many_rows_of_one_id(spark):
    """Rows of one doc_id are dealt over tasks and stay in order."""
    rows = [(5, f"text number {i}") for i in range(400)] + [(None, f"none {i}") for i in range(400)] + [(i, "x") for i in range(3)]
    out = new_path(spark, "tokens")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), out, A_PATH)
    parts = spark.read.parquet(out).filter("n_ids > 0").select("part").distinct().count()
    got = sorted(token_store.read_back(spark, out).collect(), key=lambda x: x["start"])
    assert parts > 4
    assert [x["doc_id"] for x in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d or 0))
    ends = [x["start"] + x["n_tokens"] for x in got]
    assert [x["start"] for x in got] == [0, *ends[:-1]]


def test_compaction_reads_what_it_merges(spark):
    """Full shards of an earlier compaction aren't read again when its remainder is merged; expiry keeps the rows of the last version."""
    store = sharding.ShardStore(spark, new_path(spark, "store"))
    r = random.Random(41)
    text = lambda n: "".join(chr(r.randrange(33, 127)) for _ in range(n))
    docs = lambda a, n: spark.createDataFrame([(i, text(400)) for i in range(a, a + n)], "doc_id long, text string").coalesce(1)
    store.append(docs(0, 2600), 100)
    store.compact(target=400_000, fan_in=2)
    first = {x["path"]: x["n_docs"] for x in store.manifest().collect()}
    full = [p for p, n in first.items() if n > 500]
    assert len(full) >= 2
    for k in range(5):
        store.append(docs(3000 + 100 * k, 100), 100)
    base = store.version()
    plan = sharding.materialize(store.plan(400_000, 2), "plan")
    planned = {x["path"]: x["n_docs"] for x in store.manifest().join(plan.select("path"), "path").collect()}
    assert planned
    assert not set(planned) & set(full)
    assert store._planned(plan, base).count() == sum(planned.values())
    store.compact(target=400_000, fan_in=2)
    assert sorted(x["doc_id"] for x in store.rows().collect()) == [*range(2600), *range(3000, 3500)]
    fs = store._fs()
    before = len(fs.listStatus(store._path("data")))
    assert store.expire() == store.version() - 1
    assert len(fs.listStatus(store._path("data"))) < before
    assert sorted(x["doc_id"] for x in store.rows().collect()) == [*range(2600), *range(3000, 3500)]
    assert store.rows().count() == store._stored(store.manifest()).count()
    store.append(docs(9000, 10))
    assert store.rows().count() == 3110
    assert store.expire(5) == 0
