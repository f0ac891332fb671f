"""Plain versions of the operators, for small tables; they share no code with the library."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def components(nodes, linked):
    """Smallest node that each node reaches; ``linked`` says whether two nodes have a link."""
    least = {n: n for n in nodes}
    ordered = sorted(nodes)
    changed = True
    pairs = [(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1:] if linked(a, b)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def fingerprint(text):
    parts = [w.lower() for w in words(text)]
    if not parts:
        return 0
    grams = [b" ".join(parts[k:k + 3]) for k in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def base_scores(docs):
    tokens = {d: [w.lower() for w in words(t)] + [None] for d, t in docs}
    counts = Counter()
    for d, row in tokens.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(row)
    total, distinct = sum(counts.values()), len(counts)
    whole = total + 0.1 * (distinct + 1)
    return {
        d: (zlib.crc32(str(d).encode()) % 10 == 0, len(row), sum(counts[t] > 0 for t in row), total,
            sum(math.log10((counts[t] + 0.1) / whole) for t in row))
        for d, row in tokens.items()
    }


def secret_spans(text):
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def spans_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def license_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    places = [(k, label) for k in range(len(parts)) for p, label in phrases.items() if tuple(parts[k:k + len(p)]) == p]
    return len(parts), sorted(k for k, _ in places), sorted({label for _, label in places})


def longest_first(groups, shards):
    """Loads of the shards when groups, by falling size, go to the least-loaded one."""
    loads = [0] * shards
    for size in sorted(groups, reverse=True):
        loads[loads.index(min(loads))] += size
    return sorted(loads)


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def spelling(docs, shortest=5, least=3):
    counts = Counter()
    for d, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 2 * words[w]:
            forms[w] = best
    out = {}
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, words[w], len(near[w]), words.get(forms.get(w)))
    return out


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_tree(leaves, arity):
    """Root, and for every leaf the digests left and right of its path."""
    level, paths = list(leaves), [[] for _ in leaves]
    width = 1
    while len(level) > 1:
        for k, path in enumerate(paths):
            own = k // width
            start = own // arity * arity
            path.append(("".join(level[start:own]), "".join(level[own + 1 : start + arity])))
        level = [sha(*level[k : k + arity]) for k in range(0, len(level), arity)]
        width *= arity
    return level[0], paths


def merkle(rows, arity=8):
    """(leaf, subroot, root, proof) of rows of (doc_id, text, lang, source, n_chars) in their order."""
    def leaf(r):
        fields = (r[0], r[3], r[2], r[4], r[1])
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r), k))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = merkle_tree([x[1] for x in groups[g]], arity)
    root, tops = merkle_tree([trees[g][0] for g in names], arity) if names else ("", [])
    out = {}
    for g, top in zip(names, tops, strict=True):
        for (_, own, k), path in zip(groups[g], trees[g][1], strict=True):
            out[k] = (own, trees[g][0], root, path + top)
    return [out[k] for k in range(len(rows))]
