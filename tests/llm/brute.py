"""Plain Python versions of the document operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(docs, items, size=10):
    of = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for i in range(len(words) - n + 1) if n else ():
            of[tuple(words[i : i + n])].add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, met = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in of}:
            for i in range(len(words) - n + 1):
                if got := of.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= got
        out.append((doc, len(words), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return out


def near_duplicates(docs, percent=85, size=5):
    sets = []
    for _, text in docs:
        words = BLANK.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            by[x].append(i)
    shared = Counter()
    for where in by.values():
        for a in where:
            for b in where:
                if a < b:
                    shared[a, b] += 1
    for (a, b), n in shared.items():
        if docs[a][0] is not None and docs[b][0] is not None and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    group = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            group[root(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        low = min(group[root(i)]) if doc is not None else None
        out.append((doc, len(sets[i]), low, low == doc))
    return out


def substring(docs, size=50):
    first = {}
    for doc, text in docs:
        words = BLANK.findall(text or "")
        for i in range(len(words) - size + 1) if doc is not None else ():
            key = tuple(words[i : i + size])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        words, gone = BLANK.findall(text or ""), set()
        for i in range(len(words) - size + 1) if doc is not None else ():
            if first[tuple(words[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), sha(" ".join(kept))))
    return out


def one_edit(a, b):
    """At most one substitution, insertion or deletion."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    if len(a) > len(b):
        a, b = b, a
    return a[i:] == b[i + 1 :]


def line_duplicates(docs, min_chars=20):
    """{(doc_id, line)} to go: False for copies, True for near matches. Ids must be unique and not null."""
    visible = re.compile(r"[^\x09-\x0D\x20]")
    first, out = {}, {}
    for doc, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n") if text is not None else ()):
            if visible.search(line):
                if line in first:
                    out[doc, i] = False
                else:
                    first[line] = (doc, i)
    by_size = defaultdict(list)
    for line, place in first.items():
        if len(line) >= min_chars:
            by_size[len(line)].append((place, line))
    for size, own in by_size.items():
        for place, line in own:
            for near in (size - 1, size, size + 1):
                if any(p < place and one_edit(x, line) for p, x in by_size.get(near, ())):
                    out[place] = True
                    break
    return out
