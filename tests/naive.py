"""Plain Python restatements of the operators, for comparison on small inputs."""

from __future__ import annotations

import math

import numpy as np


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def unit(v):
    n = math.sqrt(dot(v, v))
    return [np.float32(float(x) * (1.0 / n if n else 1.0)) for x in v]


def match(query, identities, default, agreements, margin):
    """identities: list of dict(id, embeddings, prototypes, negatives, threshold)."""
    q, best = unit(query), None
    for ident in identities:
        rows = ident["prototypes"] or ident["embeddings"]
        if not rows:
            continue
        scores = sorted((dot(q, g) for g in rows), reverse=True)
        need = min(agreements, len(rows))
        if ident["negatives"] and scores[0] - max(dot(q, g) for g in ident["negatives"]) < margin:
            continue
        t = ident["threshold"]
        t = default if t is None or not math.isfinite(t) else t
        if scores[0] >= t and scores[need - 1] >= t and (best is None or scores[0] > best[1]):
            best = (ident["id"], scores[0])
    return best


def first_come(items, conflict, fixed=None):
    kept = []
    for i, item in enumerate(items):
        if (fixed and fixed[i]) or not any(conflict(items[k], item) for k in kept):
            kept.append(i)
    return kept


def box_iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def cluster(vectors, radius, min_cluster):
    units = [unit(v) for v in vectors]
    n = len(vectors)
    edges = [
        (i, j) for i in range(n) for j in range(i + 1, n) if dot(units[i], units[j]) >= 1 - radius
    ]
    degree = [sum(i in e for e in edges) for i in range(n)]
    label = components(range(n), edges)
    groups = {}
    for i in range(n):
        groups.setdefault(label[i], []).append(i)
    top = max(groups.values(), key=lambda g: (len(g), -g[0]))
    reason = "outlier"
    if len(top) < min_cluster:
        hub = max(range(n), key=lambda i: (degree[i], -i))
        top, reason = groups[label[hub]], "small-cluster"
    return degree, label, {i: (None if i in top else reason) for i in range(n)}


def prototypes(vectors, k):
    units = [unit(v) for v in vectors]
    norms = [math.sqrt(dot(v, v)) for v in vectors]
    picks = [norms.index(max(norms))]
    gap = [1 - dot(u, units[picks[0]]) for u in units]
    while len(picks) < min(k, len(vectors)):
        free = [i for i in range(len(vectors)) if i not in picks]
        pick = max(free, key=lambda i: (gap[i], -i))
        picks.append(pick)
        gap = [min(g, 1 - dot(u, units[pick])) for g, u in zip(gap, units)]
    nearest = set()
    for p in picks:
        scores = [dot(units[p], u) for u in units]
        nearest.add(scores.index(max(scores)))
    return nearest


class Tracker:
    """Detection rounds one after the other, tracks as dicts."""

    def __init__(self, iou=0.3, misses=4, age=2000):
        self.iou, self.misses, self.age = iou, misses, age
        self.tracks, self.count = [], 0

    def round(self, now, boxes):
        live = [t for t in self.tracks if self.age is None or now - t["seen"] <= self.age]
        free_t, free_d = list(range(len(live))), list(range(len(boxes)))
        pairs = {}

        def overlap(t, d):
            b = live[t]["box"]
            if min(b[2], b[3], boxes[d][2], boxes[d][3]) <= 0:
                return 0.0
            return box_iou(b, boxes[d])

        def gap(t, d):
            b, c = live[t]["box"], boxes[d]
            return math.hypot(c[0] + c[2] / 2 - b[0] - b[2] / 2, c[1] + c[3] / 2 - b[1] - b[3] / 2)

        def reach(t):
            return max(1.5 * max(live[t]["box"][2:]), 24)

        while True:
            options = [(overlap(t, d), -t, -d) for t in free_t for d in free_d if overlap(t, d) > self.iou]
            if not options:
                break
            _, t, d = max(options)
            pairs[-t] = -d
            free_t.remove(-t), free_d.remove(-d)
        while True:
            options = [(gap(t, d), t, d) for t in free_t for d in free_d if gap(t, d) <= reach(t)]
            if not options:
                break
            _, t, d = min(options)
            pairs[t] = d
            free_t.remove(t), free_d.remove(d)
        after = []
        for i, t in enumerate(live):
            if i in pairs:
                new, dt = boxes[pairs[i]], now - t["seen"]
                v = ((new[0] - t["box"][0]) / dt, (new[1] - t["box"][1]) / dt) if dt > 0 else t["v"]
                after.append({"id": t["id"], "box": new, "v": v, "seen": now, "misses": 0})
            elif t["misses"] + 1 <= self.misses:
                after.append({**t, "misses": t["misses"] + 1})
        for d in free_d:
            after.append({"id": self.count, "box": boxes[d], "v": (0.0, 0.0), "seen": now, "misses": 0})
            self.count += 1
        self.tracks = after
        return [(t["box"], t["v"], t["seen"], t["misses"]) for t in after]
