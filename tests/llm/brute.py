"""Plain Python versions of the operators, by their definitions."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def line_dedup(docs, similarity=0.8, k=8):
    def shingles(x):
        return frozenset([x]) if len(x) < k else frozenset(x[i : i + k] for i in range(len(x) - k + 1))

    places = [(i, n, x) for i, t in docs if i is not None for n, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    sets = {x: shingles(x) for _, _, x in places}
    links, keys = Sets(sets), list(sets)
    for p, a in enumerate(keys):
        for b in keys[:p]:
            c = len(sets[a] & sets[b])
            if c >= similarity * (len(sets[a]) + len(sets[b]) - c):
                links.join(a, b)
    first, gone = {}, collections.defaultdict(set)
    for i, n, x in sorted(places, key=lambda p: p[:2]):
        if first.setdefault(links.find(x), (i, n)) != (i, n):
            gone[i, x].add(n)
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        drop = {n for n, x in enumerate(parts) if i is not None and n in gone.get((i, x), ())}
        out.append((i, len(parts), len(drop), "\n".join(x for n, x in enumerate(parts) if n not in drop)))
    return out


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def near_dup(docs, percent=85):
    sets = [shingle_set(t) for _, t in docs]
    rows = [k for k, (i, _) in enumerate(docs) if i is not None and sets[k]]
    links = Sets(rows)
    for p, a in enumerate(rows):
        for b in rows[:p]:
            c = len(sets[a] & sets[b])
            if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                links.join(a, b)
    low = {}
    for k in rows:
        r = links.find(k)
        low[r] = min(low.get(r, docs[k][0]), docs[k][0])
    out = []
    for k, (i, _) in enumerate(docs):
        comp = None if i is None else low[links.find(k)] if sets[k] else i
        out.append((i, len(sets[k]), comp, i is None or comp == i))
    return out


def substring_dedup(docs):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    low = {}
    for i, w in words:
        for k in range(len(w) - 12) if i is not None else ():
            g = tuple(w[k : k + 13])
            low[g] = min(i, low.get(g, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - 12) if i is not None and low[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contamination(docs, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find((t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else ():
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w = find((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if g := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= g
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def base_scores(docs):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = [(i, [*WORD.findall((t or "").translate(LOWER)), " end"]) for i, t in docs]
    c = collections.Counter(x for i, w in words if not held(i) for x in w)
    total = sum(c.values())
    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w)) for i, w in words]


def secrets(docs):
    kinds = [
        ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    out = []
    for i, t in docs:
        s = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least)
        out.append((i, *(sum(x[1] == k for x in s) for k in range(3)), sha(",".join(f"{n}:{a}:{b}" for a, _, b, n in s))))
    return out


def lattice_scores(docs, model_file, steps, prior=0.1, shift=50.0):
    """log10 probability of each document: every segmentation of every word summed, weights by plain EM."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rank = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i)) and "\u2581" not in p[1:]:
            rank[p] = sp.get_piece_size() if sp.is_byte(i) else -sp.get_score(i)
    rank["</s>"] = 0
    weight = {p: 1 / (r + shift) for p, r in rank.items()}
    total = sum(weight.values())
    weight = {p: w / total for p, w in weight.items()}
    longest = max(map(len, weight))

    def arcs(s):
        for i in range(len(s)):
            if s[i] not in weight:
                raw = [f"<0x{b:02X}>" for b in s[i].encode()]
                yield i, i + 1, raw
            for j in range(i + 1, min(len(s), i + longest) + 1):
                if s[i:j] in weight:
                    yield i, j, [s[i:j]]

    def sums(s):
        a = [1.0] + [0.0] * len(s)
        edges = [(i, j, ps, math.prod(weight[p] for p in ps)) for i, j, ps in arcs(s)]
        for i, j, _, w in sorted(edges, key=lambda e: (e[0], e[1])):
            a[j] += a[i] * w
        b = [0.0] * len(s) + [1.0]
        for i, j, _, w in sorted(edges, key=lambda e: (-e[0], -e[1])):
            b[i] += b[j] * w
        return a, b, edges

    words = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(x for i, w in words if not held(i) for x in w)
    for _ in range(steps):
        got = collections.Counter()
        for x, c in count.items():
            a, b, edges = sums("\u2581" + x)
            for i, j, ps, w in edges:
                for p in ps:
                    got[p] += c * a[i] * w * b[j] / a[-1]
        got["</s>"] = sum(not held(i) for i, _ in words)
        whole = sum(got[p] for p in weight) + prior * len(weight)
        weight = {p: (got[p] + prior) / whole for p in weight}
    own = {x: math.log10(sums("\u2581" + x)[0][-1]) for _, w in words for x in w}
    return [(i, sum(own[x] for x in w) + math.log10(weight["</s>"])) for i, w in words]
