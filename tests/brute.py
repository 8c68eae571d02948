"""Plain Python mining on a few rows, to check the library against."""

from __future__ import annotations

import math


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts if c) if n else None


def gain(counts, parent):
    rest = [p - c for p, c in zip(parent, counts)]
    n, left, right = sum(parent), sum(counts), sum(rest)
    if right == 0 or left == 0:
        return None
    return round(entropy(parent) - left / n * entropy(counts) - right / n * entropy(rest), 12)


def mine(rows, n_classes, length, g, top_k, fs_k):
    """rows: list of (dict item -> micro utility, class). Returns [(items, support, util, ig)] in pid order."""
    items = sorted({i for r, _ in rows for i in r})
    twu = {i: sum(sum(r.values()) for r, _ in rows if i in r) for i in items}
    riu = sorted((sum(r[i] for r, _ in rows if i in r) for i in items), reverse=True)
    t = riu[top_k - 1] if len(items) >= top_k else 0
    order = sorted((i for i in items if twu[i] >= t), key=lambda i: (twu[i], i))
    tids = {i: frozenset(n for n, (r, _) in enumerate(rows) if i in r) for i in order}
    unit = {i: next(r[i] for r, _ in rows if i in r) for i in order}

    def counts(s):
        return [sum(1 for n in s if rows[n][1] == k) for k in range(n_classes)]

    whole = counts(range(len(rows)))
    if length >= 2:
        pair = [
            len(tids[a] & tids[b]) * (unit[a] + unit[b])
            for n, a in enumerate(order) for b in order[n + 1 :] if tids[a] & tids[b]
        ]
        pair = sorted((u for u in pair if u >= t), reverse=True)
        if len(pair) >= top_k:
            t = max(t, pair[top_k - 1])
    found = []
    groups = [((), None, [(i, tids[i], gain(counts(tids[i]), whole)) for i in order])]
    level = 1
    while groups and (length == -1 or level <= length):
        deeper = []
        for prefix, prefix_tids, siblings in groups:
            alive = [s for s in siblings if s[2] is not None and s[2] > g]
            for x, sx, ig in alive:
                util = len(sx) * sum(unit[i] for i in (*prefix, x))
                if util >= t and util > 0:
                    found.append(((*prefix, x), sx, util, ig))
            for n, (x, sx, _) in enumerate(alive):
                if len(sx) * sum(unit[i] for i in (*prefix, x)) <= 0:
                    continue
                extended = []
                parent = whole if prefix_tids is None else counts(prefix_tids)
                for y, sy, _ in alive[n + 1 :]:
                    both = sx & sy
                    if both and not any(both == e[1] for e in extended):
                        ig = gain(counts(both), parent)
                        if ig is not None and ig > g:
                            extended.append((y, both, ig))
                if extended:
                    deeper.append(((*prefix, x), sx, extended))
        groups, level = deeper, level + 1
    found = sorted(found, key=lambda p: (-p[2], p[0]))[:top_k]
    best = {}
    for p in found:
        key = p[1]
        rank = (p[3], p[2], tuple(-i for i in p[0]), -len(p[0]))
        if key not in best or rank < best[key][0]:
            best[key] = (rank, p)
    kept = sorted((p for _, p in best.values()), key=lambda p: (-p[3], -p[2], p[0]))
    return [(list(p[0]), len(p[1]), p[2], p[3]) for p in (kept if fs_k == -1 else kept[:fs_k])]
