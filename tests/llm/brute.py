"""Plain definitions of what the operators return."""

import collections
import hashlib
import html.parser
import re

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def jaccard(rows, percent=75):
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    return [(i, len(s), least[g] if s else i) for (i, _), s, g in zip(rows, sets, group, strict=True)]


def leaks(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for i, t in rows:
        w, hit, named = word.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[x]
        names = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        held = [x for x in t.split("\n") if SPACED.search(x)]
        windows = collections.defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        again = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(8)}
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(held) - len(set(held)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(rows):
    out = []
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        count = collections.Counter(s[3] for s in spans)
        out.append((i, count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))))
    return out


KINDS = ["assign", "access", "hex", "weak", "ident", "endpoint"]


def linked_spans(text, patterns, scope=200):
    """All spans of a text: base ones, and weak candidates with a complement within ``scope``, every pair looked at. ``patterns``: the operator's seven patterns by their number."""
    assign, access, hexes, named, bare, ident, endpoint = ([m for m in re.finditer(p, text)] for p in patterns)
    others = [m.span() for m in (*assign, *named, *ident, *endpoint)]
    spans = [(m.start(), 0, m.end()) for m in assign if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in access if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in hexes]
    parts = [(m.start(), 3, m.end()) for m in assign if 6 <= len(m[2]) <= 11] + [(m.start(), 3, m.end()) for m in named]
    parts += [(m.start(), 3, m.end()) for m in bare if not any(a <= m.start() and m.end() <= b for a, b in others)]
    parts += [(m.start(), 4, m.end()) for m in ident] + [(m.start(), 4, m.end()) for m in access if 10 <= len(m[0]) <= 17] + [(m.start(), 5, m.end()) for m in endpoint]

    def links(x, y):
        near = y[0] <= x[2] + scope and x[0] <= y[2] + scope and (y[1] != 2 or y[0] >= x[2] or y[2] <= x[0])
        return near and (x[1] in (0, 3) and y[1] in (1, 4, 5) or x[1] in (1, 4, 5) and y[1] in (0, 2, 3))

    found = spans + sorted({x for x in parts if any(links(x, y) for y in spans + parts)})
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


class Article(html.parser.HTMLParser):
    """The text of the article elements of a page, a line per block, by the library's parser and plain sets of tags."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "div", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "section", "article", "main", "figure", "hr", "nav", "header", "footer", "aside", "form"}
    LEFT_OUT = {"nav", "header", "footer", "aside", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.piece, self.within, self.out = [], "", 0, 0

    def line(self):
        if text := " ".join(self.piece.split()):
            self.lines.append(text)
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.line()
        self.within += tag == "article"
        self.out += tag in self.LEFT_OUT
        self.piece += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.line()
        self.within -= tag == "article"
        self.out -= tag in self.LEFT_OUT

    def handle_data(self, data):
        if self.within and not self.out:
            self.piece += data


def main_text(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.line()
    return "\n".join(parser.lines)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
