"""Small fixtures and brute-force versions of the operators."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, ties, copies and near copies."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(r.randint(5, 80)) for _ in range(12)]
    out: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, t) for i, t in enumerate(base[:6])]
    for i, t in enumerate(base * 2):
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append((40 + i, " ".join(w)))
    shared = prose(40)
    out += [(100 + i, f"{prose(8)}\n{shared}\n{prose(5)}\nThe Same Line  \n the same line\n") for i in range(14)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "x" * 99), (206, "x" * 100), (207, "x" * 5000), (208, prose(30_000)), (209, "\n\n\n"), (210, "日本 日本 日本 日本 🎉 <s> ▁▁ a▁b\x00")]
    return out


def frame(spark, rows=None):
    """With columns whose names clash with results of the operators."""
    rows = edge_texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 3) AS source", "1L AS n_words", "2L AS n_lines", "3 AS label", "'x' AS items", "0.5D AS score", "4L AS n_tokens", "'k' AS _key", "doc_id AS doc")


def jaccard(rows, n, numerator, denominator):
    sets, parent = [], {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    postings = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        w = SPACED.findall(lower(t))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.append(s)
        for j, k in Counter(j for g in s for j in postings[g]).items():
            if denominator * k >= numerator * (len(s) + len(sets[j]) - k):
                a, b = root(d), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            postings[g].append(i)
    return sorted((d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True))


def leaks(rows, benchmark, window=10):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = ALNUM.findall(lower(text))
        if w and item is not None:
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = ALNUM.findall(lower(t))
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    items |= found
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=repr)


def suffixes(rows, length):
    """Rows of equal id do not count against each other."""
    seen: dict[bytes, int] = {}
    out = []
    order = sorted(rows, key=lambda x: (2**63 if x[0] is None else x[0]))
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        added = []
        for d, t in order[i:j]:
            b, own = (t or "").encode(), set()
            gone = bytearray(len(b))
            for s in range(len(b) - length + 1):
                if (w := b[s : s + length]) in seen or w in own:
                    gone[s : s + length] = b"\1" * length
                own.add(w)
            added.append(own)
            spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
            out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
        for own in added:
            seen.update(dict.fromkeys(own, 1))
        i = j
    return sorted(out, key=repr)


def line_drop(rows, min_docs):
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for _, t in rows for k in {strip(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (strip(x) and counts[strip(x)] >= min_docs)]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rules(text):
    w = SPACED.findall(text or "")
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    own = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(repeated)


CLASH = ["_words", "_joined", "_key", "_places", "_found", "_score", "_judged", "_grams", "_table", "_chars", "_verdict", "_lines", "_flags", "_hit", "_text", "_row", "_id", "_label", "_rest", "_pass", "a.b", "N_Words", "Labels", "Verdict", "LLR", "Failed_Rule", "Items"]


def clashing(df, key, leave=()):
    """``df`` with a column for each name that an operator may use itself; each holds its name and the row's key."""
    from pyspark.sql import functions as F

    extra = {c: F.concat(F.lit(f"{c} "), F.coalesce(F.col(key).cast("string"), F.lit("-"))) for c in CLASH if c.lower() not in {x.lower() for x in leave}}
    return df.withColumns(extra)


def assert_clashing_came_back(out, key, leave=()):
    """Columns whose names no result has hold what they held; the others are replaced, not doubled."""
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    own = [c for c in CLASH if c.lower() not in {x.lower() for x in leave}]
    assert set(own) <= set(out.columns)
    for r in out.collect():
        d = r.asDict()
        assert all(d[c] == f"{c} {'-' if d[key] is None else d[key]}" for c in own)


MARKS = {".": 27, "/": 28, "-": 29, "_": 30, "%": 31}


def url_verdicts(urls, rules):
    """``(host, path, rule, llr, verdict)`` of each URL, model and cut included."""

    def codes(url):
        out = []
        for c in url or "":
            low = c.lower()
            out.append(ord(low) - 97 if c.isascii() and "a" <= low <= "z" else 26 if c in "0123456789" else 32 if c in "?=&#;+" else MARKS.get(c, 33))
        return [34, 34, 34, *out, 35]

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def ruled(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    parts = [split(u) for u in urls]
    found = [ruled(*p) for p in parts]
    side = lambda u: zlib.crc32((u or "").encode()) % 2

    def model(out):
        """Counts by class of every gram of one to four symbols, without those of the fold ``out``."""
        n = {c: Counter() for c in ("allow", "block")}
        for u, r in zip(urls, found, strict=True):
            if r and side(u) != out:
                x = codes(u)
                for i in range(3, len(x)):
                    for size in range(1, 5):
                        n[r.verdict][tuple(x[i - size + 1 : i + 1])] += 1
        context = {c: (Counter(), Counter()) for c in n}
        for c, counts in n.items():
            for g, k in counts.items():
                context[c][0][g[:-1]] += k
                context[c][1][g[:-1]] += 1

        def p(c, g):
            below = p(c, g[1:]) if len(g) > 1 else 1 / 36
            seen, kinds = context[c][0][g[:-1]], context[c][1][g[:-1]]
            return (n[c][g] + kinds * below) / (seen + kinds) if seen else below

        def llr(u):
            x = codes(u)
            return sum(math.log(p("allow", tuple(x[i - 3 : i + 1])) / p("block", tuple(x[i - 3 : i + 1]))) for i in range(3, len(x))) / (len(x) - 3)

        return llr

    if {r.verdict for r in found if r} != {"allow", "block"}:
        return [(*p, r and r.name, None, r.verdict if r else "allow") for p, r in zip(parts, found, strict=True)]
    halves, whole = (model(0), model(1)), model(None)
    taught = [(r.verdict, halves[side(u)](u)) for u, r in zip(urls, found, strict=True) if r]
    low, high = min(x for _, x in taught), max(x for _, x in taught)
    cut, best = 0.0, -1.0
    if low < high:
        step = (high - low) / 200
        total = Counter(v for v, _ in taught)
        below = Counter()
        for k in sorted({math.floor((x - low) / step) for _, x in taught}):
            below += Counter(v for v, x in taught if math.floor((x - low) / step) == k)
            if (balance := below["block"] / total["block"] - below["allow"] / total["allow"]) > best:
                best, cut = balance, low + (k + 1) * step
    out = []
    for p, r, u in zip(parts, found, urls, strict=True):
        x = whole(u)
        out.append((*p, r and r.name, x, r.verdict if r else "block" if x < cut else "allow"))
    return out


def license_rows(text, rules, phrases, confidence, phrase_confidence):
    """``(n_words, n_base, first_word, last_word, base_labels, labels, score)``, all rules tried on every text."""
    w = ALNUM.findall(lower(text))
    places, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    joined = f" {' '.join(w)} "
    hits = [(m.start(), m.end(), r.priority, i) for i, r in enumerate(rules) for m in re.finditer(rf"(?<= ){r.pattern}(?= )", joined)]
    hits.sort(key=lambda h: (h[0], -h[1], -h[2], h[3]))
    left = [h for k, h in enumerate(hits) if not any(o[0] <= h[0] and o[1] >= h[1] and o[2] >= h[2] for o in hits[:k])]
    labels = base | {rules[h[3]].label for h in left}
    score = max([confidence[h[2]] for h in left] + ([phrase_confidence] if base else []) + [0.0])
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), score
