"""What the operators must return, computed plainly over all documents at once."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(rows, window=13):
    """(n_words, n_removed, kept) of each row."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def groups(rows, percent=80):
    """Number of the group of each row, None for empty sets."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return [find(k) if sets[k] else None for k in range(len(rows))], sets


def contamination(rows, items, window=13):
    """(n_words, n_hit, items) of each row."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[k : k + window])].add(i)
    sizes = {len(g) for g in windows}
    out = []
    for _, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def lines_left(rows, run=3, passage=50):
    """(n_lines, n_removed, kept) of each row: repeated runs of lines go, and shorter ones of so many words."""
    has_words = lambda x: bool(words(x))
    place = lambda i, k: (i is None, i or 0, k)

    def runs(lines):
        for long in range(1, run + 1):
            for k in range(len(lines) - long + 1):
                g = tuple(lines[k : k + long])
                if long == run or (passage and sum(len(words(x)) for x in g) >= passage):
                    yield k, g

    first = {}
    for i, t in rows:
        lines = [x for x in (t or "").split("\n") if has_words(x)]
        for k, g in runs(lines):
            first[g] = min(first.get(g, (True, LAST, LAST)), place(i, k))
    out = []
    for i, t in rows:
        if t is None:
            out.append((0, 0, None))
            continue
        lines = [x for x in t.split("\n") if has_words(x)]
        gone = set()
        for k, g in runs(lines):
            if place(i, k) > first[g]:
                gone.update(range(k, k + len(g)))
        kept, own = [], -1
        for x in t.split("\n"):
            own += has_words(x)
            if own not in gone:
                kept.append(x)
        out.append((len(lines), len(gone), "\n".join(kept)))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed
