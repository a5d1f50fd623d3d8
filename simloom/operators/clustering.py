"""Clusters of submissions by similarity: preprocessing, algorithms, and what clusters are worth.

Edges are ``(i, j, w)`` with ``i < j``; pairs that are absent have similarity 0. Preprocessing and quality are
DataFrame plans. The two algorithms need the whole matrix of what preprocessing leaves; they take it to the
driver only below a stated number of nodes and fail above it, where ``single_linkage`` scales.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import numbers as N
from simloom.sources import stored

#: Nodes of the largest matrix that the driver takes: 4,000 squared doubles are 128 MB.
MOST_NODES = 4000
#: Distinct similarities that are broadcast; those of six places are 1,000,001 at most.
MOST_SHARES = 1_100_000


def connected(edges: DataFrame) -> DataFrame:
    """``(node)``: nodes with a similarity above 0."""
    return edges.where("w > 0").select(F.explode(F.array("i", "j")).alias("node")).distinct()


def by_threshold(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("w") >= threshold)


def percentile_type2(edges: DataFrame, percent: float, n_pairs: int | None = None) -> DataFrame:
    """One row ``value``: the percentile by averaging at steps (Hyndman and Fan's type 2) over all pairs.

    ``n_pairs`` adds the zeros of absent pairs as a count.
    """
    known = edges.count()
    n = max(known, n_pairs or 0)
    zeros = n - known
    h = n * percent / 100 + 0.5
    low, high = max(1, int(np.ceil(h - 0.5))), min(n, int(np.floor(h + 0.5)))
    k = F.row_number().over(Window.orderBy("w")) + zeros
    at = lambda p: F.coalesce(F.max(F.when(F.col("k") == p, F.col("w"))), F.lit(0.0))
    return edges.select("w").withColumn("k", k).agg(((at(low) + at(high)) / 2).alias("value"))


def by_percentile(edges: DataFrame, percent: float, n_pairs: int | None = None) -> DataFrame:
    value = percentile_type2(edges, percent, n_pairs)
    return edges.crossJoin(F.broadcast(value)).where("w >= value").select("i", "j", "w")  # one row


def by_cumulative(edges: DataFrame) -> DataFrame:
    """Each similarity times the share of similarities that are no greater.

    The cumulative share comes from counts of distinct values, so equal similarities are counted before
    anything is ordered.
    """
    counts = edges.groupBy("w").agg(F.count("*").alias("n"))
    share = counts.select("w", (F.sum("n").over(Window.orderBy("w")) / F.sum("n").over(Window.partitionBy())).alias("share"))
    share = stored.saved(share, "shares")
    small = F.broadcast(share) if share.count() <= MOST_SHARES else share
    return edges.join(small, "w").select("i", "j", (F.col("w") * F.col("share")).alias("w"))


def matrix(edges: DataFrame) -> tuple[list[int], np.ndarray]:
    """Nodes and their symmetric matrix, on the driver; an error above ``MOST_NODES``."""
    nodes = connected(edges)
    n = nodes.limit(MOST_NODES + 1).count()
    if n > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} connected submissions; use a threshold, or single_linkage")
    ids = sorted(r[0] for r in nodes.collect())
    at = {x: k for k, x in enumerate(ids)}
    out = np.zeros((n, n))
    for r in edges.where("w > 0").collect():
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["w"]
    return ids, out


def agglomerative(w: np.ndarray, threshold: float = 0.2, linkage: str = "average") -> list[list[int]]:
    """Clusters of a similarity matrix: the most similar two are joined while their similarity reaches ``threshold``."""
    n = len(w)
    members = {k: [k] for k in range(n)}
    # Row k: what cluster k has with each node, as a sum or as an extreme; merging two adds or compares two rows.
    near = {k: w[k].astype(float) for k in range(n)}
    fold = {"average": np.add, "max": np.maximum, "min": np.minimum}[linkage]
    heap = [(-float(w[i, j]), i, j) for i, j in zip(*np.nonzero(np.triu(w >= threshold, 1)), strict=True)]
    heapq.heapify(heap)
    fresh = n
    while heap:
        _, i, j = heapq.heappop(heap)
        if i not in members or j not in members:
            continue
        both = members.pop(i) + members.pop(j)
        row = fold(near.pop(i), near.pop(j))
        # By the last cluster of each node: the same fold over its members.
        keys = list(members)
        if keys:
            order = np.concatenate([members[k] for k in keys])
            starts = np.cumsum([0] + [len(members[k]) for k in keys[:-1]])
            sims = fold.reduceat(row[order], starts)
            if linkage == "average":
                sims = sims / (len(both) * np.array([len(members[k]) for k in keys]))
            for k, s in zip(keys, sims.tolist(), strict=True):
                if s >= threshold:
                    heapq.heappush(heap, (-s, k, fresh))
        members[fresh], near[fresh] = both, row
        fresh += 1
    return [sorted(int(x) for x in m) for m in members.values()]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Labels by k-means with spread starting centres."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    label = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return label


def modularity(w: np.ndarray, clusters: list[list[int]]) -> list[float]:
    """For each cluster the share of similarity inside it less the square of its share of all."""
    total = w.sum()
    if total <= 0:
        return [0.0] * len(clusters)
    return [float(w[np.ix_(c, c)].sum() / total - (w[c].sum() / total) ** 2) for c in clusters]


def spectral(w: np.ndarray, seed: int = 7) -> list[list[int]]:
    """Clusters by the normalised Laplacian's eigenvectors; their number is searched for the greatest modularity.

    At least two, and at least as many as there are eigenvalues below 0.05; at most half of the nodes. The search
    starts from spread numbers and goes on where a Gaussian process expects an improvement.
    """
    n = len(w)
    if n < 3:
        return []
    degree = w.sum(1)
    scale = 1 / np.sqrt(np.where(degree > 0, degree, 1))
    values, vectors = np.linalg.eigh(np.eye(n) - scale[:, None] * w * scale[None, :])
    least = max(2, int((values < 0.05).sum()))
    most = max(least, -(-n // 2))
    rng = np.random.default_rng(seed)
    made: dict[int, tuple[float, list[list[int]]]] = {}

    def worth(k: int) -> float:
        if k not in made:
            x = vectors[:, :k]
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            label = _kmeans(x / np.where(norm > 0, norm, 1), k, rng)
            clusters = [c.tolist() for j in range(k) if len(c := np.flatnonzero(label == j))]
            made[k] = (sum(modularity(w, clusters)), clusters)
        return made[k][0]

    best = maximize(worth, least, most)
    return [sorted(c) for c in made[best][1]]


def maximize(f, low: int, high: int, start: int = 5, useless: int = 3, steps: int = 50) -> int:
    """The integer of ``[low, high]`` with the greatest ``f`` that a Bayesian search finds.

    Spread points first; then the point of the greatest expected improvement under a Gaussian process, until
    ``useless`` of them in a row bring none.
    """
    xs = sorted({low + round((high - low) * t) for t in np.linspace(0, 1, min(start, high - low + 1))})
    ys = [f(x) for x in xs]
    wasted = 0
    rest = [x for x in range(low, high + 1) if x not in xs]
    while rest and wasted < useless and steps:
        steps -= 1
        mean, dev = gaussian_process(np.array(xs, float), np.array(ys), np.array(rest, float), (high - low) / 4 or 1.0)
        best = max(ys)
        z = (mean - best) / dev
        gain = (mean - best) * _normal_cdf(z) + dev * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
        x = rest.pop(int(gain.argmax()))
        y = f(x)
        wasted = 0 if y > best else wasted + 1
        xs.append(x)
        ys.append(y)
    return xs[int(np.argmax(ys))]


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    from math import erf

    return np.array([0.5 * (1 + erf(v / 2**0.5)) for v in z])


def gaussian_process(x: np.ndarray, y: np.ndarray, at: np.ndarray, scale: float, noise: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at points, with a Matern kernel and standardised values."""

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.abs(a[:, None] - b[None, :]) / scale * 5**0.5
        return (1 + d + d * d / 3) * np.exp(-d)

    mid, spread = y.mean(), y.std() or 1.0
    root = np.linalg.cholesky(kernel(x, x) + noise * np.eye(len(x)))
    weights = np.linalg.solve(root.T, np.linalg.solve(root, (y - mid) / spread))
    cross = kernel(at, x)
    v = np.linalg.solve(root, cross.T)
    return mid + spread * cross @ weights, spread * np.sqrt(np.maximum(1e-12, 1 - (v * v).sum(0)))


def clusters(edges: DataFrame, algorithm: str = "agglomerative", threshold: float = 0.2, linkage: str = "average", seed: int = 7) -> DataFrame:
    """``(cluster_id, member)`` of good clusters: two members or more and a strength that isn't negative."""
    ids, w = matrix(edges)
    found = [] if len(ids) <= 2 else agglomerative(w, threshold, linkage) if algorithm == "agglomerative" else spectral(w, seed)
    good = [c for c, s in zip(found, modularity(w, found), strict=True) if len(c) >= 2 and s >= 0]
    rows = [(k, ids[m]) for k, c in enumerate(sorted(good)) for m in c]
    return edges.sparkSession.createDataFrame(rows, "cluster_id int, member long")


def quality(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(cluster_id, size, strength, avg_similarity)`` of clusters over the whole matrix.

    Strength is the share of similarity inside a cluster less the square of its share of all; both directions of
    a pair count. The mean is over all pairs of members, absent ones as 0. Similarities are summed in millionths, so
    that no order of rows shows.
    """
    mine = members.select(F.col("member").alias("i"), F.col("cluster_id").alias("ci"))
    other = members.select(F.col("member").alias("j"), F.col("cluster_id").alias("cj"))
    return quality_of(edges.join(mine, "i", "left").join(other, "j", "left"), members)


def quality_of(sides: DataFrame, members: DataFrame) -> DataFrame:
    """The same of edges ``(w, ci, cj)`` that know their sides' clusters, null for none; they are read once."""
    w = N.millionths(F.col("w"))
    both = F.array(F.struct(F.col("ci").alias("cluster_id"), F.col("cj").alias("other"), w.alias("w")), F.struct(F.col("cj").alias("cluster_id"), F.col("ci").alias("other"), w.alias("w")))
    own = F.when(F.col("cluster_id") == F.col("other"), F.col("w"))
    sums = sides.select(F.inline(both)).groupBy("cluster_id").agg(F.sum("w").alias("of_row"), F.coalesce(F.sum(own), F.lit(0)).alias("inside"))
    sums = stored.saved(sums, "sums")
    total = sums.agg(F.sum("of_row").alias("total"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    out = sizes.join(sums, "cluster_id", "left").crossJoin(F.broadcast(total))  # one row
    inside, row = F.coalesce("inside", F.lit(0)), F.coalesce("of_row", F.lit(0)) / F.col("total")
    share = inside / F.col("total") - row * row
    mean = N.mean_of(inside, F.col("size") * (F.col("size") - 1))
    return out.select("cluster_id", "size", N.rounded(F.when(F.col("total") > 0, share).otherwise(0.0)).alias("strength"), F.coalesce(mean, F.lit(0.0)).alias("avg_similarity"))


def worth(facts: DataFrame) -> DataFrame:
    """Normalised strength and worth of clusters ``(cluster_id, size, strength, avg_similarity)``."""
    links = F.col("size") * (F.col("size") - 1) / 2
    each = F.col("strength") / links
    most = F.max(each).over(Window.partitionBy())
    normal = F.when(most > 0, each / most).otherwise(0.0)
    return facts.select("*", F.round(each, 6).alias("per_connection"), F.round(normal, 6).alias("normalized"), F.round(normal * F.col("avg_similarity"), 6).alias("worth"))


def single_linkage(edges: DataFrame, threshold: float) -> DataFrame:
    """``(node, component)`` over edges of ``threshold`` or more: labels spread until they no longer change.

    Each round takes the least label of a node's neighbours and then its label's label, so long paths need few
    rounds. Each round's labels are written to the shared folder, those of the round before deleted.
    """
    turned = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    both = stored.saved(edges.where(F.col("w") >= threshold).select(F.inline(turned)).distinct(), "links")
    labels = both.groupBy(F.col("i").alias("node")).agg(F.least(F.min("j"), F.first("i")).alias("label"))
    was = old = None
    while True:
        labels = stored.saved(labels, "labels")
        if old is not None:
            stored.dropped(old)
        old = labels
        state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if state == was:
            stored.dropped(both)
            return labels.select("node", F.col("label").alias("component"))
        was = state
        near = both.join(labels.withColumnsRenamed({"node": "j", "label": "near"}), "j").groupBy(F.col("i").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = step.join(jump, "label").select("node", F.least("label", "next").alias("label"))
