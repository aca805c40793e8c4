"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

WHITE = r"[^\x20\x09-\x0D]+"
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def repeats(docs, length):
    """docs: (order, text) in order. Bytes kept, and the removed places."""
    seen, out = set(), []
    for _, text in docs:
        data, gone = (text or "").encode(), set()
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone.update(range(p, p + length))
            seen.add(data[p : p + length])
        out.append((bytes(b for i, b in enumerate(data) if i not in gone), gone))
    return out


def contaminated(text, items, window=13):
    """(n_words, n_hit, ids, contaminated)"""
    words = LETTERS.findall(lower(text))
    places = {}
    hit, ids = set(), set()
    for item_id, item in items:
        own = LETTERS.findall(lower(item))
        n = min(window, len(own))
        if not n:
            continue
        if n not in places:
            places[n] = {}
            for i in range(len(words) - n + 1):
                places[n].setdefault(tuple(words[i : i + n]), []).append(i)
        for j in range(len(own) - n + 1):
            for i in places[n].get(tuple(own[j : j + n]), ()):
                hit.update(range(i, i + n))
                if item_id is not None:
                    ids.add(item_id)
    return len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)


def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def frequent_lines(texts, least):
    counts = {}
    for text in texts:
        for key in {line_key(x) for x in (text or "").split("\n")}:
            counts[key] = counts.get(key, 0) + 1
    return lambda line: line_key(line) != "" and counts.get(line_key(line), 0) >= least


def shingles(text):
    words = re.findall(WHITE, lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def component_roots(texts, percent):
    """texts: key to text. Smallest key of each near-duplicate component, all pairs compared."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    for k in sorted(sets):
        for other in {o for x in sets[k] for o in holders[x] if o < k}:
            both = len(sets[k] & sets[other])
            if 100 * both >= percent * len(sets[k] | sets[other]):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}
