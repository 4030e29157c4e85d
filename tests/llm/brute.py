"""Plain versions of the operators, for small tables: rows are (doc_id, text)."""

import re

import xxhash

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def groups(n, linked):
    """Group number of each of n members under the links of linked(i, j)."""
    of = list(range(n))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                of[b] = a
    return [find(i) for i in range(n)]


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """Fingerprint, component (smallest doc_id reachable) and group number of every row."""
    fps = [simhash(t) for _, t in rows]
    of = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {g: min((rows[i][0] for i in range(len(rows)) if of[i] == g and rows[i][0] is not None), default=None) for g in set(of)}
    return [(f"{fps[i]:016x}", least[of[i]], of[i]) for i in range(len(rows))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def line_classes(rows, least, near, edits):
    """Lines of each class, by all pairs of different lines."""
    lines = sorted({s for _, t in rows for s in (t or "").split("\n") if len(s) >= least and s.strip(" \t\r\x0b\x0c")})
    close = lambda i, j: min(len(lines[i]), len(lines[j])) >= near and abs(len(lines[i]) - len(lines[j])) <= edits and distance(lines[i], lines[j]) <= edits
    of = groups(len(lines), close)
    return [[s for s, g in zip(lines, of) if g == k] for k in sorted(set(of))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def hits(text, items):
    """Hit word positions and the items with a window in the text; items: (item_id, text)."""
    w, at, ids = words(text), set(), set()
    for item, own in items:
        own = words(own)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                at |= set(range(i, i + n))
                ids.add(str(item))
    return sorted(at), sorted(ids)


def spans(text, rules):
    found = []
    for at, rule in enumerate(rules):
        for m in re.finditer(rule.regex, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), at, m.end(), rule.kind))
    return sorted(found)
