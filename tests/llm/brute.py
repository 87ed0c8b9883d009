"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removal_masks(rows, span=50):
    """Per row (doc_id, text): its bytes and a mask of what is removed."""
    enc = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in enc:
        if i is not None:
            for p in range(len(b) - span + 1):
                w = b[p : p + span]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in enc:
        m = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - span + 1):
                if first[b[p : p + span]] < i:
                    m[p : p + span] = True
        out.append((i, b, m))
    return out


def removal_digest(rows):
    out = []
    for i, b, m in removal_masks(rows):
        edges = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        out.append((i, len(b), int(m.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """Per row (doc_id, text): doc_id, size of its set, component, number of other rows that it links with."""
    sets, where = [(i, shingles(t)) for i, t in rows], collections.defaultdict(list)
    links = [0] * len(rows)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        if i is None:
            continue
        common = collections.Counter(b for g in s for b in where[g])
        for g in s:
            where[g].append(a)
        for b, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[b][1]) - k):
                links[a] += 1
                links[b] += 1
                x, y = find(i), find(sets[b][0])
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), n) for (i, s), n in zip(sets, links)]


def line_hash(line):
    x = re.sub("[0-9]", "0", line.lower())
    return hashlib.md5(re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").encode()).hexdigest()


def quality(rows, least_docs=20, max_share=0.02, min_left=30):
    """Per row (doc_id, text, source): kept, and the text left."""
    holders, every = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, source in rows:
        every[source].add(text or "")
        for x in (text or "").split("\n"):
            if WORD.search(x):
                holders[source, line_hash(x)].add(text or "")
    out = []
    for i, text, source in rows:
        words = WORD.findall(text or "")
        grams = collections.defaultdict(list)
        for p in range(len(words) - 4):
            grams[tuple(words[p : p + 5])].append(p)
        repeat = {q for ps in grams.values() if len(ps) > 1 for p in ps for q in range(p, p + 5)}
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        hot = lambda x: bool(WORD.search(x)) and len(holders[source, line_hash(x)]) > max(least_docs, max_share * len(every[source]))
        lines = (text or "").split("\n")
        gone = sum(len(WORD.findall(x)) for x in lines if hot(x))
        left = len(words) - gone
        ok = not failed and 100 * left >= min_left * len(words)
        out.append((i, ok, "\n".join(x for x in lines if not hot(x)) if gone else text))
    return out


def mix(rows, seed=17):
    """Per row (doc_id, text, source): words taken, by the same keys and budgets."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    taken = [0] * len(rows)
    for s in names:
        epochs = min(3, int(target[s] // total[s])) if total[s] else 0
        rest = max(0, math.floor(target[s] - epochs * total[s] + 0.5))
        order = []
        for k, (i, t, own) in enumerate(rows):
            if own == s:
                h = hashlib.md5(f"{seed}|{'null' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
                u = (int(h[:12], 16) + 0.5) / (1 << 48)
                lines = [x for x in (t or "").split("\n") if WORD.search(x)]
                mean = max(1, len("".join(WORD.findall(t or "")))) / max(1, size[k])
                q = max(0.0, 1 - len(re.findall(r"[#*$%&|<>]", t or "")) / max(1, size[k])) * (len(set(lines)) / len(lines) if lines else 1.0)
                q = max(0.05, q * min(1.0, mean / 3, 12 / mean))
                order.append((-math.log(u) / q, k))
        for _, k in sorted(order):
            part = max(0, min(size[k], rest))
            rest -= part
            taken[k] = epochs * size[k] + part
    return size, taken


def window_removals(rows, window=20):
    """Per row (doc_id, text): doc_id, words, removed words, digest of the others."""
    said, first = [(i, WORD.findall(t or "")) for i, t in rows], {}
    for i, w in said:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min((i, p), first.get(key, (i, p)))
    out = []
    for i, w in said:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def periodic_runs(w, least=12):
    """(start, length, period) of all runs of a list, by start and period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))
