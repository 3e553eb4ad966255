"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text, min_repeat):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
    long = Counter(tuple(w[i : i + min_repeat]) for i in range(len(w) - min_repeat + 1))
    covered = {i + k for i in range(len(w) - min_repeat + 1) if long[tuple(w[i : i + min_repeat])] > 1 for k in range(min_repeat)}
    longest = 0
    for n in range(min_repeat, len(w)):
        if max(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values(), default=0) < 2:
            break
        longest = n
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(covered), longest]


def repeats(w, least):
    """Maximal repeats of a word list: {(words, starts)}."""
    out = set()
    for n in range(least, len(w)):
        at = {}
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), []).append(i)
        for starts in at.values():
            if len(starts) > 1:
                right = {w[i + n] if i + n < len(w) else -1 - i for i in starts}
                left = {w[i - 1] if i else -1 for i in starts}
                if len(right) > 1 and len(left) > 1:
                    out.add((n, tuple(starts)))
    return out


BLANKS = r"[\x20\x09-\x0D]"


def units(text, least=20, least_sentence=40, run_words=50):
    """[(unit, start, end, normalised)] of a text's paragraphs of several lines, lines, sentences of lines of several, and runs of a word."""
    text, out = text or "", []
    norm = lambda x: re.sub(BLANKS + "+", " ", low(x)).strip(" ")

    def add(unit, start, x, trim):
        if trim:
            start, x = start + len(x) - len(x.lstrip(" \t\n\v\f\r")), x.strip(" \t\n\v\f\r")
        if len(norm(x)) >= (least_sentence if unit == "sentence" else least):
            out.append((unit, start, start + len(x), norm(x)))

    at = 0
    for m in [*re.finditer(rf"\n{BLANKS}*\n{BLANKS}*", text), None]:
        par = text[at : m.start() if m else len(text)]
        if "\n" in par.strip(" \t\n\v\f\r"):
            add("paragraph", at, par, True)
        at = m.end() if m else at
    at = 0
    for line in text.split("\n"):
        add("line", at, line, False)
        cuts = [0, *(m.end() for m in re.finditer(rf"[.!?]{BLANKS}+(?=[^\x20\x09-\x0D])", line)), len(line)]
        for a, b in zip(cuts, cuts[1:]) if len(cuts) > 2 else ():
            add("sentence", at + a, line[a:b], True)
        strip = lambda x: x.strip(" \t\n\v\f\r")
        wholes = [strip(line), *(strip(line[a:b]) for a, b in zip(cuts, cuts[1:]))]
        words, i = [(m.start(), m.end(), low(m.group())) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)], 0
        while i < len(words):
            j = i
            while j < len(words) and j < i + run_words and words[j][2] == words[i][2]:
                j += 1
            if j == i + run_words:
                a, b = words[i][0], words[j - 1][1]
                at_cut = a in [c + len(line[c:]) - len(line[c:].lstrip(" \t\n\v\f\r")) for c in cuts]
                if not (at_cut and line[a:b] in wholes):
                    out.append(("run", at + a, at + b, " ".join([words[i][2]] * run_words)))
            i = j
        at += len(line) + 1
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fingerprint(text):
    import xxhash

    w = words(low(text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    """The smallest index that each of n indices reaches, for a link test on indices."""
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def contamination(docs, items, window=13):
    """{index: (n_words, hit words, items)}."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall(low(t))
    wins = {}
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for _, text in docs:
        w, hit, of = cut(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    of |= found
        out.append((len(w), len(hit), of))
    return out


def removed(docs, length=50):
    """[(n_bytes, n_removed, n_spans, kept sha)] for (doc_id, text) in any order."""
    first, out = {}, []
    key = lambda d: -(2**63) if d is None else d
    raw = [(key(d), (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def fill(sizes, weights, share=1.5, most=2.0):
    """Water-filling by rounds: clamp what is above its cap, share the rest anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]] if total else []
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(s)


WEAK = [
    r"""(?i:access_?key_?id|client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
    r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
    r"""(?:(?i:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb)://[^\x20\x09-\x0D"'<>]+)|(?:(?i:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,})""",
]


def secrets(text, scope=200):
    """Base spans, and weak ones with complements at most scope code points away, all pairs compared."""
    strong = base_spans(text)
    both = strong + [(m.start(), 3 + k, m.end()) for k, p in enumerate(WEAK) for m in re.finditer(p, text or "")]

    def near(span, kinds):
        return any(k in kinds and max(a - span[2], span[0] - b) <= scope for a, k, b in both)

    keep = {3: lambda s: near(s, (0, 2, 4)), 4: lambda s: near(s, (1, 3, 5)), 5: lambda s: near(s, (0, 2, 4)) and near(s, (1, 3))}
    return sorted(s for s in both if s[1] < 3 or keep[s[1]](s))
