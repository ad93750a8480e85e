"""Plain versions of the contracts, over small lists of rows."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def op2(docs, k=2, percent=80):
    sets = {}
    for i, text in docs:
        w = SPACE.findall((text or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def op3(text):
    words = SPACE.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(triples)
    hit = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def op5(docs, size=35):
    words = {i: SPACE.findall(t or "") for i, t in docs}
    places = defaultdict(list)
    for i, w in words.items():
        for s in range(len(w) - size + 1):
            places[tuple(w[s : s + size])].append((i, s))
    gone = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for i, s in at:
                gone[i].update(range(s, s + size))
    return {i: (len(w), len(gone[i]), sha(" ".join(x for k, x in enumerate(w) if k not in gone[i]))) for i, w in words.items()}


def op7(docs, percent=80):
    lines = [(i, n, set(SPACE.findall(line))) for i, t in docs for n, line in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    holders, gone = defaultdict(list), defaultdict(set)
    for k, (i, n, s) in enumerate(lines):
        near = Counter(j for w in s for j in holders[w])
        if any(100 * c >= percent * (len(s) + len(lines[j][2]) - c) for j, c in near.items()):
            gone[i].add(n)
        for w in s:
            holders[w].append(k)
    out = {}
    for i, t in docs:
        parts = [] if t is None else t.split("\n")
        out[i] = (len(parts), len(gone[i]), sha("\n".join(x for n, x in enumerate(parts) if n not in gone[i])))
    return out


def op9(docs, items, size=13):
    windows = []
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.append((item, w[s : s + size]))
    out = {}
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOW))
        at = defaultdict(list)
        for k, x in enumerate(w):
            at[x].append(k)
        hit, held = set(), set()
        for item, win in windows:
            for s in at[win[0]]:
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    held.add(item)
        names = sorted(str(x) for x in held if x is not None)
        out[i] = (len(w), len(hit), len(held), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w))
    return out
