"""Plain single-array answers for small grids, used to check the distributed ones."""

import heapq

import numpy as np

RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def fill(z):
    """Minimax level to the border by repeated relaxation (slow, obviously right)."""
    ny, nx = z.shape
    w = np.full(z.shape, np.inf)
    w[0], w[-1], w[:, 0], w[:, -1] = z[0], z[-1], z[:, 0], z[:, -1]
    while True:
        best = w.copy()
        for di, dj in RING:
            sh = np.full(z.shape, np.inf)
            i0, i1 = max(0, -di), ny - max(0, di)
            j0, j1 = max(0, -dj), nx - max(0, dj)
            sh[i0:i1, j0:j1] = w[i0 + di:i1 + di, j0 + dj:j1 + dj]
            best = np.minimum(best, np.maximum(z, sh))
        if (best == w).all():
            return w
        w = best


def epsilon_surface(z, eps):
    """Queue from the border, every newly reached cell strictly above its source."""
    ny, nx = z.shape
    w, seen, heap = z.astype(float).copy(), np.zeros(z.shape, bool), []
    for i in range(ny):
        for j in range(nx):
            if i in (0, ny - 1) or j in (0, nx - 1):
                seen[i, j] = True
                heapq.heappush(heap, (w[i, j], i, j))
    while heap:
        x, i, j = heapq.heappop(heap)
        for di, dj in RING:
            a, b = i + di, j + dj
            if 0 <= a < ny and 0 <= b < nx and not seen[a, b]:
                seen[a, b] = True
                if w[a, b] <= x:
                    w[a, b] = x + eps
                heapq.heappush(heap, (w[a, b], a, b))
    return w


def d8(w):
    ny, nx = w.shape
    down = {}
    for i in range(ny):
        for j in range(nx):
            down[i, j] = None
            if i in (0, ny - 1) or j in (0, nx - 1):
                continue
            best = 0.0
            for di, dj in RING:
                s = (w[i, j] - w[i + di, j + dj]) / (2 ** 0.5 if di and dj else 1.0)
                if s > best:
                    best, down[i, j] = s, (i + di, j + dj)
    return down


def accumulate(w, down):
    acc = {k: 1.0 for k in down}
    for k in sorted(down, key=lambda k: -w[k]):
        if down[k] is not None:
            acc[down[k]] += acc[k]
    return acc


def hand(z, w, down, stream):
    ref = {}
    for k in sorted(down, key=lambda k: w[k]):
        ref[k] = z[k] if stream[k] or down[k] is None else ref[down[k]]
    return {k: z[k] - ref[k] for k in down}


def label(mask, diagonal):
    ny, nx = mask.shape
    ring = RING if diagonal else [d for d in RING if 0 in d]
    out = np.full(mask.shape, -1)
    for i in range(ny):
        for j in range(nx):
            if mask[i, j] and out[i, j] < 0:
                out[i, j], todo = i * nx + j, [(i, j)]
                while todo:
                    a, b = todo.pop()
                    for di, dj in ring:
                        p, q = a + di, b + dj
                        if 0 <= p < ny and 0 <= q < nx and mask[p, q] and out[p, q] < 0:
                            out[p, q] = i * nx + j
                            todo.append((p, q))
    return out
