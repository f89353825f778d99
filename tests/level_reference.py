"""Single-machine reference of the condensed tree with equal weights removed together, for small test inputs."""

from __future__ import annotations

import numpy as np


def _components(nodes, edges):
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v, _ in edges:
        parent[find(u)] = find(v)
    out = {}
    for v in nodes:
        out.setdefault(find(v), set()).add(v)
    return list(out.values())


def level_labels(n: int, edges: list[tuple[int, int, float]], least: int) -> list[int]:
    """Remove weights from the heaviest down; excess of mass without the roots."""
    clusters = []                                   # birth, parent, members' exits

    def grow(members, c, own):
        """Follow cluster ``c`` down from component ``members`` with edges ``own``."""
        while True:
            w = max((e[2] for e in own), default=None)
            if w is None:
                return
            lam = 1.0 / max(w, 1e-12)
            rest = [e for e in own if e[2] < w]
            parts = _components(members, rest)
            big = [p for p in parts if len(p) >= least]
            inside = big[0] if len(big) == 1 else set()
            for p in members - inside:
                clusters[c]["exit"][p] = lam
            if len(big) == 1:
                members, own = inside, [e for e in rest if e[0] in inside]
                continue
            for part in big:
                clusters.append({"birth": lam, "parent": c, "exit": {}, "members": part})
                grow(part, len(clusters) - 1, [e for e in rest if e[0] in part])
            return

    for part in _components(range(n), edges):
        if len(part) >= least:
            clusters.append({"birth": 0.0, "parent": None, "exit": {}, "members": part})
            grow(part, len(clusters) - 1, [e for e in edges if e[0] in part])
    stab = [sum(x - c["birth"] for x in c["exit"].values()) for c in clusters]
    best, chosen = [0.0] * len(clusters), [False] * len(clusters)
    for i in reversed(range(len(clusters))):
        kids = sum(best[j] for j, c in enumerate(clusters) if c["parent"] == i)
        chosen[i] = clusters[i]["parent"] is not None and stab[i] >= kids
        best[i] = max(stab[i], kids)
    final = []
    for i, c in enumerate(clusters):
        p, under = c["parent"], False
        while p is not None:
            under |= chosen[p]
            p = clusters[p]["parent"]
        if chosen[i] and not under:
            final.append(c["members"])
    out = np.full(n, -1)
    for k, members in enumerate(sorted(final, key=min)):
        out[list(members)] = k
    return out.tolist()
