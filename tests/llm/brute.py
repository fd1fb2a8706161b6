"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(docs, size, percent=80):
    """{doc_id: (n, component)} of [(doc_id, text)]."""
    sets = {}
    for i, t in docs:
        sets.setdefault(i, shingles(t, size))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


SECRET = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def secrets(text):
    """Base spans, (begin, kind, end)."""
    return sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(SECRET) for m in p.finditer(text or "") if good(m))


def random_spans(text, candidate, allow, holders, classes, window):
    out = []
    for m in re.finditer(candidate, text or ""):
        c = m[0]
        if any(re.search(p, c) for p in allow):
            continue
        least = next(v for p, v in classes.items() if re.search(p, c))
        for word in holders:
            c = re.sub(word, " " * len(word), c, flags=re.I)
        high = [i for i in range(len(c) - window + 1) if " " not in c[i : i + window] and math.log2(window) - sum(v * math.log2(v) for v in Counter(c[i : i + window]).values()) / window >= least]
        if high:
            out.append((m.start() + high[0], 3, m.start() + high[-1] + window))
    return out


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = set()
    for i in range(len(w) - 7):
        if times[tuple(w[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    """[(n_words, n_hit, items)] of texts, items [(id, text)]."""
    windows = {}
    for i, t in items:
        w = BENCH.findall(low(t or ""))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for t in docs:
        w = BENCH.findall(low(t or ""))
        hit, of = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    of |= found
        out.append((len(w), len(hit), sorted(of)))
    return out


def lines(docs, least=20, shared=3):
    """{doc_id: (n_lines, n_dropped, text)} of [(doc_id, text)] with distinct doc_ids."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(holders.get(key(x), ())) >= shared and max(holders[key(x)]) != i)]
        out[i] = len(all_), len(all_) - len(kept), "\n".join(kept)
    return out


def held_out(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def base_scores(docs, folds=5, fold=1):
    """[(n_tokens, n_known, score)] and the number of training tokens."""
    tokens = [[*WORD.findall(low(t or "")), None] for _, t in docs]
    count = Counter(w for (i, _), ws in zip(docs, tokens, strict=True) if not held_out(i, folds, fold) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in tokens], n


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: (size, target)} of [(source, size)], by sharing again and again."""
    total = Counter()
    for s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, out, open_ = share * sum(total.values()), {}, set(order)
    while open_:
        left = budget - sum(out.values())
        given = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if given[s] > most * total[s]}
        if not over:
            out |= given
            break
        out |= {s: most * total[s] for s in over}
        open_ -= over
    return {s: (total[s], out[s]) for s in order}


def audit(docs, labels):
    """{(part, order, step): counts} of [(doc_id, text, source)] and [(doc_id, quality, toxic)]."""
    from itertools import permutations

    least = {}
    for i, t, _ in docs:
        least.setdefault(t or "", []).append(float("-inf") if i is None else i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    each = []
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and min(least[t]) < i)
        each.append((source or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in bad))
    out = {}
    for part in {p for p, *_ in each}:
        mine = [e[1:] for e in each if e[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                before = set(order[:k])
                here = [e for e in mine if x in e[0] and not e[0] & before]
                out[part, order, k + 1] = [
                    sum(not e[0] & (before | {x}) for e in mine), len(here), sum(x in e[0] and bool(e[0] & before) for e in mine), sum(e[0] == {x} for e in mine), sum(e[1] for e in here), sum(e[2] for e in here),
                ]
        for x in "ABCDE":
            total = sum(v[1] for (p, order, k), v in out.items() if p == part and order[k - 1] == x)
            for (p, order, k), v in out.items():
                if p == part and order[k - 1] == x:
                    v.append(total)
    return out


def repeats(texts, length):
    """[(kept, spans)] of texts: bytes under strings of ``length`` bytes that stand in several places are removed."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(b) + 1) if (gone[i] if i < len(b) else 0) != (gone[i - 1] if i else 0)]
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), tuple(zip(edges[::2], edges[1::2], strict=True))))
    return out


def tree(nodes):
    """The root over digests, eight at a time, and for each of them what stands before and after it at each level."""
    level, paths = list(nodes), [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] of [(doc_id, source, lang, n_chars, text)]."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((members, *tree([leaf(r) for r in members])))
    root, tops = tree([m[1] for m in made])
    out = []
    for (members, subroot, paths), top in zip(made, tops, strict=True):
        for r, path in zip(members, paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            up = leaf((*r[:4], low(r[4]))) if changed else leaf(r)
            for before, after in path + top:
                up = sha(before + up + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in path + top)), up, up == root))
    return out
