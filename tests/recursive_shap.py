"""The published recursion of path-dependent Tree SHAP (Lundberg et al. 2018),
node by node, as the twin of the path-wise operator."""

import numpy as np


def add_tree(X, t, phi, scale):
    """Add one tree's path-dependent SHAP values (times ``scale``) to phi
    for all rows of X at once."""
    n = X.shape[0]
    # path element: [feature, zero_fraction (scalar), one_fraction (n,), weight (n,)]

    def extend(path, z, o, d):
        depth = len(path)
        new = [[e[0], e[1], e[2], e[3].copy()] for e in path]
        new.append([d, z, o, np.ones(n) if depth == 0 else np.zeros(n)])
        for i in range(depth - 1, -1, -1):
            new[i + 1][3] = new[i + 1][3] + o * new[i][3] * (i + 1) / (depth + 1)
            new[i][3] = z * new[i][3] * (depth - i) / (depth + 1)
        return new

    def unwind(path, k):
        depth = len(path) - 1
        o, z = path[k][2], path[k][1]
        nz = o != 0
        safe_o = np.where(nz, o, 1.0)
        w = [e[3].copy() for e in path]
        nxt = w[depth].copy()
        for i in range(depth - 1, -1, -1):
            tmp = w[i].copy()
            with_one = nxt * (depth + 1) / ((i + 1) * safe_o)
            without = w[i] * (depth + 1) / (z * (depth - i)) if z != 0 else np.zeros(n)
            w[i] = np.where(nz, with_one, without)
            nxt = np.where(nz, tmp - w[i] * z * (depth - i) / (depth + 1), nxt)
        out = []
        for i in range(depth):
            src = path[i + 1] if i >= k else path[i]
            out.append([src[0], src[1], src[2], w[i]])
        return out

    def unwound_sum(path, k):
        depth = len(path) - 1
        o, z = path[k][2], path[k][1]
        nz = o != 0
        safe_o = np.where(nz, o, 1.0)
        nxt = path[depth][3].copy()
        total = np.zeros(n)
        for i in range(depth - 1, -1, -1):
            tmp = nxt * (depth + 1) / ((i + 1) * safe_o)
            zero_part = (path[i][3] / z) / ((depth - i) / (depth + 1)) if z != 0 else np.zeros(n)
            total = total + np.where(nz, tmp, zero_part)
            nxt = np.where(nz, path[i][3] - tmp * z * ((depth - i) / (depth + 1)), nxt)
        return total

    def recurse(j, path, z, o, d):
        path = extend(path, z, o, d)
        if t.left[j] < 0:
            for k in range(1, len(path)):
                w = unwound_sum(path, k)
                e = path[k]
                phi[:, e[0]] += scale * w * (e[2] - e[1]) * t.value[j]
            return
        f = int(t.feature[j])
        goes_left = X[:, f] <= t.threshold[j]
        iz, io = 1.0, np.ones(n)
        k = next((i for i in range(1, len(path)) if path[i][0] == f), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = unwind(path, k)
        lc, rc = t.left[j], t.right[j]
        cj = t.cover[j] if t.cover[j] > 0 else 1.0
        # the left child is "hot" for rows that go left, "cold" for the others
        recurse(lc, path, iz * t.cover[lc] / cj, np.where(goes_left, io, 0.0), f)
        recurse(rc, path, iz * t.cover[rc] / cj, np.where(goes_left, 0.0, io), f)

    recurse(0, [], 1.0, np.ones(n), -1)
