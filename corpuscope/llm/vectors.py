"""Near duplicates among vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Kept, bounded_sample
from .components import components

#: Vectors the centres are fitted on at most, cells at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
#: Vectors of a block at most on average; two blocks are compared in one task.
BLOCK = 2048
#: Seconds that one product and one row handed to a task take, roughly: what the number of
#: cells is chosen by. The result does not depend on it.
PRODUCT_S, ROW_S = 5e-9, 2e-5
#: Products this close to the threshold are computed again without rounding of the sums.
CLOSE = 1e-9


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres by spherical k-means; the first are drawn far apart, empty cells keep theirs."""
    if not len(x):
        return x
    rng = np.random.Generator(np.random.PCG64(7))
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        gap = np.maximum(1 - near, 0) + 1e-12
        chosen.append(int(rng.choice(len(x), p=gap / gap.sum())))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        home = np.argmax(x @ c.T, 1)
        sums = np.stack([np.bincount(home, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision. Scaled first, so that no square overflows."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def guests(near: np.ndarray, gap: np.ndarray, half: float) -> np.ndarray:
    """Which other cells each vector visits, from its products with the centres and their distances."""
    home = near.argmax(1)
    rows = np.arange(len(near))
    away = near[rows, home][:, None] - near <= half * gap[home]
    away[rows, home] = False
    return away


def gaps(middle: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * middle @ middle.T, 0))


def cells(sample: np.ndarray, size: float, half: float) -> np.ndarray:
    """The centres that make comparing cheapest for ``size`` vectors of a label, judged by the sample.

    More cells mean fewer products but more guests, above all where vectors lie evenly around
    the origin. Two cells are the least for more vectors than a block holds.
    """
    best, cost, k = centres(sample, 1), float("inf") if size > BLOCK else 0.0, 2
    while k <= MOST_CELLS and k * BLOCK <= 4 * size and k <= len(sample):
        middle = centres(sample, k)
        visits = guests(sample @ middle.T, gaps(middle), half).sum(1).mean()
        at_home, away = size / k, visits * size / k
        blocks, other = math.ceil(at_home / BLOCK), math.ceil(away / BLOCK)
        now = at_home * (1 + visits) * PRODUCT_S + (blocks + other + visits * blocks) * ROW_S
        if now >= cost:
            break
        best, cost, k = middle, now, 2 * k
    return best


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix of hits between ``a`` and ``b`` connects, one a vector at most."""
    out: list[tuple[int, int]] = []
    seen_a, seen_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for start in np.flatnonzero(hit.any(1)):
        if seen_a[start]:
            continue
        seen_a[start] = True
        front, root = np.array([start]), int(a[start])
        while len(front):
            new_b = np.flatnonzero(hit[front].any(0) & ~seen_b)
            seen_b[new_b] = True
            out += [(int(v), root) for v in b[new_b] if v != root]
            front = np.flatnonzero(hit[:, new_b].any(1) & ~seen_a)
            seen_a[front] = True
            out += [(int(v), root) for v in a[front] if v != root]
    return out


def compare(left: pd.DataFrame, right: pd.DataFrame | None, cell: int, threshold: float, kind: str) -> pd.DataFrame:
    """Links of a block of home vectors with another block of its cell, or within it.

    Counts by vector, and links that connect what is linked. A pair from two cells may meet in
    both; it is counted in the lower cell unless it meets in the other one only.
    """
    same = right is None
    right = left if same else right
    x = units(np.frombuffer(b"".join(left["x"]), kind).reshape(len(left), -1))
    y = x if same else units(np.frombuffer(b"".join(right["x"]), kind).reshape(len(right), -1))
    product = x @ y.T
    hit = product >= threshold
    for i, j in zip(*np.nonzero(np.abs(product - threshold) < CLOSE)):
        hit[i, j] = exact_cosine(x[i], y[j]) >= threshold
    if same:
        np.fill_diagonal(hit, False)
    count = hit
    home = right["home"].to_numpy()
    if not same and (home < cell).any():
        lower = np.unique(home[home < cell])
        visits = np.zeros((len(left), len(lower) + 1), bool)  # the last column stands for other homes
        for i, cells_ in enumerate(left["guests"].tolist()):
            visits[i, :-1] = np.isin(lower, cells_)
        at = np.where(home < cell, np.minimum(np.searchsorted(lower, home), len(lower) - 1), len(lower))
        count = hit & ~visits[:, at]
    copies_l, copies_r = left["copies"].to_numpy(float), right["copies"].to_numpy(float)
    node_l, node_r = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
    links = [(node_l, count @ copies_r)] + ([] if same else [(node_r, copies_l @ count)])
    out = [pd.DataFrame({"node": n, "links": v.astype(np.int64)})[v > 0] for n, v in links]
    edges = pd.DataFrame(forest(hit, node_l, node_r), columns=["node", "other"])
    return pd.concat([*(o.assign(other=pd.NA) for o in out), edges.assign(links=0)], ignore_index=True)[
        ["node", "other", "links"]].astype({"node": "int64", "other": "Int64", "links": "int64"})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding, label``).

    Rows link when their labels are equal and not null and the cosine of their vectors in double
    precision is at least ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows without an id or a label, nor vectors of
    different lengths. Equal vectors of a label are compared once and counted as often as they
    stand there. Rows that share an id count as one vector where components are formed.

    Cells: each vector has its nearest centre as home. A linked pair lies within
    d = sqrt(2 - 2 threshold); if it has two homes, the distances of both vectors to the plane
    between the two centres add up to d at most, so one of them is within d / 2. Such vectors
    are guests in the other cell too, which makes the search exact whatever the centres are.
    The vectors at home in a cell and its guests are cut into blocks of at most ``BLOCK`` on
    average; a block at home is compared with every other one in a task of its own, so no task
    holds a cell.
    """
    spark = vectors.sparkSession
    kept = Kept(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
             & (F.size("embedding") > 0)
             & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
             & F.exists("embedding", lambda e: e != 0))
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({
        "k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64("embedding", F.lit(1), "label")})
    good = keyed.where("sound")
    single = kept.write(good.groupBy("label", "k1", "k2").agg(
        F.min(F.struct("vec_id", "embedding")).alias("first"), F.count("*").alias("copies")).select(
        "label", F.col("first.vec_id").alias("node"), "copies", F.col("first.embedding").alias("embedding")))
    # the size of the label that the average vector has
    size = single.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0
    drawn = bounded_sample(single, "node", SAMPLE).select("embedding").toPandas()["embedding"]
    dims = [len(v) for v in drawn]
    dim = max(set(dims), key=lambda n: (dims.count(n), n)) if dims else 0
    half = math.sqrt(max(2 - 2 * threshold, 0)) / 2 + 1e-9
    middle = cells(units(np.stack([v for v in drawn if len(v) == dim])), size, half) if dim else np.zeros((0, 0))
    label, vector = (dict(single.dtypes)[c] for c in ("label", "embedding"))
    kind = "<f4" if vector == "array<float>" else "<f8"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = gaps(middle)
        for batch in batches:
            batch = batch.reset_index(drop=True)
            size = batch["embedding"].map(len).to_numpy()
            home = np.full(len(batch), -1)
            visited: list[list[int]] = [[]] * len(batch)
            fits = np.flatnonzero(size == dim)  # other lengths share the cell -1
            if len(fits):
                near = units(np.stack(batch["embedding"].iloc[fits].tolist())) @ middle.T
                home[fits] = near.argmax(1)
                for i, row in zip(fits, guests(near, gap, half)):
                    visited[i] = np.flatnonzero(row).tolist()
            raw = [np.asarray(v, kind).tobytes() for v in batch["embedding"]]
            out = batch[["label", "node", "copies"]].assign(dim=size, home=home, guests=visited, x=raw)
            away = out.loc[np.repeat(out.index, [len(v) for v in visited])].assign(cell=[c for v in visited for c in v])
            yield pd.concat([out.assign(cell=home), away], ignore_index=True)[
                ["label", "dim", "cell", "home", "node", "copies", "x", "guests"]]

    placed = kept.write(single.select("label", "node", "copies", "embedding").mapInPandas(
        place, f"label {label}, dim int, cell int, home int, node long, copies long, x binary, guests array<int>"))
    key = ["label", "dim", "cell"]
    at_home = F.col("home") == F.col("cell")
    count = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    blocks = placed.groupBy(*key).agg(count(at_home).alias("homes"), count(~at_home).alias("others"))
    mine = F.pmod(F.xxhash64("node"), F.when(at_home, F.col("homes")).otherwise(F.col("others"))).cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("is_left"))
    # guest blocks have the numbers below zero
    of_home = F.concat(
        F.transform(upto("homes"), lambda o: pair(F.least("block", o), F.greatest("block", o), F.col("block") <= o)),
        F.transform(upto("others"), lambda o: pair(F.col("block"), -o - 1, F.lit(True))))
    of_guest = F.transform(upto("homes"), lambda o: pair(o, -F.col("block") - 1, F.lit(False)))
    paired = placed.join(blocks, key).withColumn("block", mine).select(
        *key, "home", "node", "copies", "x", "guests", F.explode(F.when(at_home, of_home).otherwise(of_guest)).alias("p")
    ).select(*key, "home", "node", "copies", "x", "guests", "p.i", "p.j", "p.is_left")

    def cross(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        left, right = (table[table["is_left"] == side].reset_index(drop=True) for side in (True, False))
        if group[3] == group[4]:
            right = None
        if len(left) == 0 or len(left) == 1 and right is None or right is not None and len(right) == 0:
            return pd.DataFrame({"node": [], "other": [], "links": []}).astype({"node": "int64", "other": "Int64", "links": "int64"})
        return compare(left, right, group[2], threshold, kind)

    found = kept.write(paired.groupBy(*key, "i", "j").applyInPandas(cross, "node long, other long, links long"))
    links = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = components(links)
    groups = good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    told = groups.join(counts, "node", "left").join(nodes, "node", "left").select(
        "label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "label", "k1", "k2").join(told, ["label", "k1", "k2"]).select(
        "vec_id", "n_links", "component_id")
    alone = keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
