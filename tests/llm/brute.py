"""Plain Python versions of the corpus operators' contracts, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACED = rb"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACED, (text or "").encode())


def lower_words(text):
    return re.findall(SPACED, (text or "").encode().lower())


def quality(text):
    w = words(text)
    n = len(w)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(n - 2))
    covered = {k + d for k in range(n - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    chars = sum(len(x.decode()) for x in w)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, chars, symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def shingles(text):
    w = lower_words(text)
    if len(w) < 3:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2))


def components(rows, percent=90):
    """{doc_id: (set size, component)} of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            inverted[g].append(k)
    for k, (i, s) in enumerate(sets):
        for other, shared in Counter(o for g in s for o in inverted[g] if o < k).items():
            j, t = sets[other]
            if 100 * shared >= percent * (len(s) + len(t) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def contamination(text, benchmark):
    item = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, items = item(text), set(), set()
    for name, t in benchmark:
        b = item(t)
        for s in range(max(1, len(b) - 12) if b else 0):
            p = b[s : s + 13]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    items.add(str(name))
    return len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w)


def held(doc_id, of, rest):
    return zlib.crc32(str(doc_id).encode()) % of == rest


def deleted_lines(rows, least=50):
    """{doc_id: set of deleted places among lines with words} by comparing all runs."""
    lines = {i: [(x, len(words(x))) for x in (t or "").split("\n") if words(x)] for i, t in rows}
    seen, gone = {}, defaultdict(set)
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += own[b][1]
                if n >= least:
                    key = tuple(x for x, _ in own[a : b + 1])
                    if seen.setdefault(key, (i, a)) < (i, a):
                        gone[i] |= set(range(a, b + 1))
    return gone


def vector(text):
    """The statistics of a text before they are scaled, and its number of words."""
    w = [x.decode() for x in words(text)]
    n = len(w)
    counts = [sum(len(x) <= 3 for x in w), sum(any(c.isupper() for c in x) for x in w), sum(not x.isalpha() for x in w), sum(len(set(w[k : k + 50])) for k in range(0, n, 50))]
    return [math.log(max(sum(map(len, w)), 1) / max(n, 1)), *[math.log((k + 0.5) / (n - k + 0.5)) for k in counts]], n


def rank(v, p):
    return np.sort(v, axis=0)[max(1, int(np.ceil(p * len(v)))) - 1]


def scale(x, n):
    """Medians, variances between long texts and variances of one word."""
    centre, cut = rank(x, 0.5), rank(n, 0.5)
    off, lo, hi = abs(x - centre), n <= cut, n > cut
    least = np.array([0.01, 4, 4, 4, 4])
    a, u = (1.4826 * rank(off[lo], 0.5)) ** 2, (1 / n[lo]).mean()
    if hi.any():
        b, v = (1.4826 * rank(off[hi], 0.5)) ** 2, (1 / n[hi]).mean()
        word = np.maximum((a - b) / (u - v), least)
        return centre, np.maximum(b - word * v, 0.1 * word / cut), word
    word = np.maximum(a / u, least)
    return centre, 0.1 * word / cut, word


def mcd(x, keep=0.75, consistency=0.75 / 0.531135, inner=12.8325, unit=0.1, still=1e-4):
    """Centre and regularised covariance of least determinant over two starts, reweighted."""
    k = x.shape[1]
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    mixed = lambda y, f: np.cov(y.T, bias=True) * f * (1 - unit) + unit * np.eye(k)
    med = rank(x, 0.5)
    off = x - med
    norm2 = (off**2).sum(1)
    off = off[norm2 > 0] / np.sqrt(norm2[norm2 > 0])[:, None]
    found = []
    for c in (np.eye(k), off.T @ off / len(off) * k * (1 - unit) + unit * np.eye(k)):
        m, was = med, np.linalg.slogdet(c)[1]
        for _ in range(30):
            d = dist(m, c)
            core = x[d <= rank(d, keep)]
            m, c = core.mean(0), mixed(core, consistency)
            now = np.linalg.slogdet(c)[1]
            if abs(now - was) <= still:
                break
            was = now
        found.append((now, m, c))
    _, m, c = min(found, key=lambda f: f[0])
    core = x[dist(m, c) <= inner]
    return core.mean(0), mixed(core, 1.055533)


def kept(rows, far=45.7946, language=50, source=20, drawn=50):
    """Ids that pass the base rules and the robust distance, of (doc_id, text, lang, source) rows."""
    good = [(r[0], (r[2], r[3]), *vector(r[1])) for r in rows if not quality(r[1])[5]]
    out = set()
    for i, g, v, n in good:
        pool = [r for r in good if r[1][0] == g[0]]
        if len(pool) < language:
            pool = good
        if len(pool) >= language:
            centre, between, word = scale(np.array([r[2] for r in pool]), np.array([r[3] for r in pool]))
            y = lambda some: (np.array([r[2] for r in some]) - centre) / np.sqrt(between + word / np.array([r[3] for r in some])[:, None])  # noqa: B023, E731
            m, c = mcd(y(pool))
            own = [r for r in good if r[1] == g]
            if len(own) >= source:
                m2, c2 = mcd(y(own))
                part = len(own) / (len(own) + drawn)
                m, c = part * m2 + (1 - part) * m, part * c2 + (1 - part) * c
            z = y([(i, g, v, n)])[0] - m
            if z @ np.linalg.inv(c) @ z > far:
                continue
        out.add(i)
    return out


def ppm_stream(text):
    """A text's bytes: words closed by a blank, and an end."""
    return b"".join(w + b" " for w in lower_words(text)) + b"\n"


def ppm_trie(streams, order=5):
    """Counts by context: at the full order occurrences, below it the longer contexts in which a symbol occurs."""
    full, longer = {}, {}
    for s in streams:
        s = b"\t" * order + b" " + s
        for j in range(order + 1, len(s)):
            row = full.setdefault(s[j - order : j], {})
            row[s[j]] = row.get(s[j], 0) + 1
            for k in range(order):
                longer.setdefault(s[j - k : j], {}).setdefault(s[j], set()).add(s[j - k - 1 : j])
    return full | {c: {x: len(found) for x, found in row.items()} for c, row in longer.items()}


def ppm_score(stream, trie, order=5):
    """Log10 probability of a stream by method D with symbol exclusion."""

    s, total = b"\t" * order + b" " + stream, 0.0
    for j in range(order + 1, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            context = s[j - k : j]
            if b"\t" in context:
                continue
            row = trie.get(context, {})
            left = {x: c for x, c in row.items() if x not in gone}
            mass = sum(left.values())
            if s[j] in left:
                total += math.log10((2 * left[s[j]] - 1) / (2 * mass))
                break
            if mass:
                total += math.log10(len(left) / (2 * mass))
            gone |= set(row)
        else:
            total -= math.log10(256 - len(gone))
    return total


def page(source):
    """Text, title, language and links of a page by the standard library's parser."""
    from html.parser import HTMLParser

    blocks = set("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr table article section nav header footer main aside body html head blockquote pre form figure".split())
    out, title, known = [], [], {"lang": "", "links": 0, "silent": None, "titles": 0}

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if known["silent"]:
                return
            if tag in ("script", "style", "noscript", "template", "title"):
                known["silent"] = tag
                known["titles"] += tag == "title"
            if tag in blocks:
                out.append("\x1e")
            names = dict(attrs)
            known["links"] += tag == "a" and "href" in names
            if tag == "html" and not known["lang"]:
                known["lang"] = (names.get("lang") or "").lower()

        def handle_endtag(self, tag):
            if known["silent"]:
                known["silent"] = None if tag == known["silent"] else known["silent"]
            elif tag in blocks:
                out.append("\x1e")

        def handle_data(self, data):
            if not known["silent"]:
                out.append(data)
            elif known["silent"] == "title" and known["titles"] == 1:
                title.append(data)

    reader = Reader()
    reader.feed(source)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(out).split("\x1e")]
    return "\n".join(x for x in lines if x), " ".join("".join(title).split()), known["lang"], known["links"]


GLYPHS = dict(zip("аеорсхуіѕјԁոкмтвнαοιντκυεıɑɡⅼ", "aeopcxyisjdnkmtbhaoivtkueiagl")) | {"ρ": "p"}
SIGNS = dict(zip("01345789@$!€", "oieastbgasie"))


def fold(text):
    """Letters by word, blanks around each, sign by sign."""
    letter = lambda c: c.isalnum() and not c.isdecimal()
    if not text:
        return " "
    text = "".join(GLYPHS.get(c, chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c) for c in (text or "").lower() if c not in "\u200b\u200c\u200d\u2060\ufeff\xad")
    out, i = list(text), 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "0123456789@$!€":
            j += 1
        n = j - i if i < j < len(text) and i and letter(text[i - 1]) and letter(text[j]) else 0
        for k in (2, 1):
            word = text[i + k : i + k + 2]
            if not n and all(c in "0134579@$" for c in text[i : i + k]) and not (i and letter(text[i - 1])) and len(word) == 2 and letter(word[0]) and word[1].isalnum():
                n = k
        out[i : i + n] = [SIGNS.get(c, c) for c in text[i : i + n]]
        i += n or 1
    return " " + " ".join("".join(c if letter(c) else " " for c in out).split()) + " "


def lexicon(rows, least=5, weight=1.2, g2=24.0, phrase=4, share=0.25):
    """Weights of entries and exception phrases from (text, toxic) rows by plain counting."""

    toxic = sum(t for _, t in rows)
    clean = len(rows) - toxic
    held = []
    for text, t in rows:
        w = set(fold(text).split())
        held.append(({f" {x} " for x in w if len(x) > 2} | {f" {x[:k]}" for x in w for k in range(4, 9) if len(x) > k}, t))
    weights = {}
    log = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    for e in {e for found, t in held if t for e in found}:
        a, b = (sum(e in found for found, t in held if t == y) for y in (1, 0))
        both = (a + b) / (toxic + clean)
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        ratio = 2 * (log(a, toxic, a / toxic) + log(b, clean, b / clean) - log(a, toxic, both) - log(b, clean, both))
        if a >= least and odds >= weight and ratio >= g2:
            weights[e] = odds
    phrases = defaultdict(Counter)
    for text, t in rows:
        w = fold(text).split()
        hit = lambda x: f" {x} " in weights or any(f" {x[:k]}" in weights for k in range(4, 9))
        for p in {f" {a} {b} " for a, b in zip(w, w[1:]) if hit(a) or hit(b)}:
            phrases[p][t] += 1
    return weights, {p for p, n in phrases.items() if n.total() >= phrase and n[1] < share * n.total()}


def lexicon_features(text, weights, exceptions):
    """Heaviest weight, log of the sum and sum per square root of words, by looking for each entry at each place."""

    text = fold(text)
    best, covered = {}, []
    for at in range(len(text)):
        for e, w in weights.items():
            if text.startswith(e, at):
                best[at] = max(w, best.get(at, 0.0))
        covered += [(at, at + len(p) - 1) for p in exceptions if text.startswith(p, at)]
    found = [w for at, w in best.items() if not any(a <= at < b for a, b in covered)]
    return max(found, default=0.0), math.log1p(sum(found)), sum(found) / math.sqrt(max(1, text.count(" ") - 1))


def planted_words(doc_id, text):
    """The words of a text with the periodic end that the contract gives to a tenth of the ids."""
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n or doc_id is None:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def periodic_runs(w, min_length=24, min_periods=3):
    """All runs ``(start, length, period)`` by comparing each word with the one a period on."""
    n, least = len(w), {}
    for q in range(1, n // min_periods + 1):
        k = 0
        while k + q < n:
            s = k
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k + q - s >= max(min_length, min_periods * q):
                least.setdefault((s, k + q - s), q)
            k += 1
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)
