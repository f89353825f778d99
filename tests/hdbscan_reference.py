"""Single-machine reference of HDBSCAN labels for small test inputs.

Classic formulation: core distances, mutual reachability, Prim's MST,
single-linkage merges, condensed tree, excess-of-mass selection without the
root.  Used only by tests on a few hundred points.
"""

from __future__ import annotations

import numpy as np


def core_distances(X: np.ndarray, min_samples: int) -> np.ndarray:
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    return np.sort(D, axis=1)[:, min_samples - 1], D


def prim_mst(M: np.ndarray) -> list[tuple[int, int, float]]:
    n = len(M)
    in_tree = np.zeros(n, bool)
    best = np.full(n, np.inf)
    parent = np.full(n, -1)
    best[0] = 0
    edges = []
    for _ in range(n):
        cand = np.where(in_tree, np.inf, best)
        u = int(np.argmin(cand))
        in_tree[u] = True
        if parent[u] >= 0:
            edges.append((int(parent[u]), u, float(best[u])))
        upd = (~in_tree) & (M[u] < best)
        best[upd] = M[u][upd]
        parent[upd] = u
    return edges


def hdbscan_labels(X: np.ndarray, min_cluster_size: int, min_samples: int | None = None) -> np.ndarray:
    n = len(X)
    ms = min_samples or min_cluster_size
    core, D = core_distances(X, ms)
    M = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(M, np.inf)
    edges = sorted(prim_mst(M), key=lambda e: (e[2], min(e[0], e[1]), max(e[0], e[1])))
    # single linkage: node ids n.. for merges
    uf = list(range(2 * n))
    size = [1] * n + [0] * n
    children = {}
    dist = {}

    def find(a):
        while uf[a] != a:
            uf[a] = uf[uf[a]]
            a = uf[a]
        return a

    nxt = n
    for a, b, w in edges:
        ra, rb = find(a), find(b)
        children[nxt] = (ra, rb)
        dist[nxt] = w
        size[nxt] = size[ra] + size[rb]
        uf[ra] = uf[rb] = nxt
        nxt += 1
    root = nxt - 1

    def leaves(node):
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack.extend(children[x])
        return out

    # condensed tree: clusters with birth lambda, point exits, child clusters
    clusters = {0: {"birth": 0.0, "parent": None, "points": {}, "kids": []}}
    stack = [(root, 0)]
    while stack:
        node, cl = stack.pop()
        if node < n:
            clusters[cl]["points"][node] = clusters[cl]["points"].get(node, np.inf)
            continue
        lam = 1.0 / dist[node] if dist[node] > 0 else np.inf
        a, b = children[node]
        big = [c for c in (a, b) if size[c] >= min_cluster_size]
        if len(big) == 2:
            for c in (a, b):
                new = len(clusters)
                clusters[new] = {"birth": lam, "parent": cl, "points": {}, "kids": [], "size": size[c]}
                clusters[cl]["kids"].append(new)
                for p in leaves(c):
                    clusters[cl]["points"][p] = lam
                stack.append((c, new))
        else:
            for c in (a, b):
                if size[c] >= min_cluster_size:
                    stack.append((c, cl))
                else:
                    for p in leaves(c):
                        clusters[cl]["points"][p] = lam
    stab = {}
    for c, info in clusters.items():
        stab[c] = sum(l - info["birth"] for l in info["points"].values())
    selected = {}
    best = {}
    for c in sorted(clusters, reverse=True):
        if c == 0:
            continue
        kids = sum(best[k] for k in clusters[c]["kids"])
        if stab[c] >= kids:
            best[c] = stab[c]
            selected[c] = True
        else:
            best[c] = kids
            selected[c] = False
    chosen = set()
    for c in sorted(clusters):
        if c == 0 or not selected.get(c):
            continue
        p = clusters[c]["parent"]
        anc = False
        while p is not None and p != 0:
            if p in chosen:
                anc = True
            p = clusters[p]["parent"]
        if not anc:
            chosen.add(c)
    labels = np.full(n, -1)
    # a point's deepest cluster is the one whose "points" it exits last (largest depth)
    depth = {0: 0}
    for c in sorted(clusters):
        if c:
            depth[c] = depth[clusters[c]["parent"]] + 1
    deepest = {}
    for c, info in clusters.items():
        for p in info["points"]:
            if p not in deepest or depth[c] > depth[deepest[p]]:
                deepest[p] = c
    for p, c in deepest.items():
        x = c
        while x is not None and x != 0 and x not in chosen:
            x = clusters[x]["parent"]
        if x is not None and x != 0:
            labels[p] = x
    # number by smallest member
    order = sorted({l for l in labels if l >= 0}, key=lambda c: min(np.flatnonzero(labels == c)))
    remap = {c: i for i, c in enumerate(order)}
    return np.array([remap.get(l, -1) for l in labels])
