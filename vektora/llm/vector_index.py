"""Most similar vectors through learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced partitions; a small classifier
learns from it in which partitions the neighbours of a vector lie. Every vector is stored in its
most probable partition and compared with the vectors of every partition whose log-odds lie at most
a margin below the best; the margin is calibrated on held-out rows to a stated recall, so that
vectors in dense places try one or two partitions and loose ones many. Since a comparison counts for
both of its vectors, a pair is missed only if neither tries the other's partition. Similarities are
found in single and decided in double precision.

The number of partitions follows the number of rows. A first classifier has FANOUT classes at most;
a partition of more than REFINE rows gets a classifier of its own, fitted on a sample of its rows in
the task that holds them, and so on. Only samples are bounded (SAMPLE rows each, a parameter); every
vector is stored and searched. `exact` tries every partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektora.operators.scoring import topk
from vektora.session import Stored, materialize

SAMPLE = 12_000
#: Rows aimed at per partition, classes of one classifier, and rows from which a partition is cut again.
ROWS, FANOUT, REFINE = 128, 256, 32_768
#: Rows stored in the partitions that travel together.
GROUP = 24_576
#: Largest blocks that one task compares: stored rows and searching rows.
BLOCK, SEARCHERS = 32_768, 98_304
CHUNK = 512
#: Held-out rows whose neighbours are looked up among all rows to choose the margin.
HELD = 1000
SLACK = 1e-5
#: Levels of classifiers beyond which a partition that can't be told apart is only cut into blocks.
LEVELS = 5


def usable(vectors: DataFrame, names: DataFrame, dim: int, split: str | None = None) -> DataFrame:
    """(id, v): one row per non-null id whose vector has `dim` finite numbers that aren't all zero.

    vectors and names are joined on dataset, split, chunk and pos; should an id have several vectors,
    the smallest counts."""
    if split is not None:
        vectors, names = vectors.filter(F.col("split") == split), names.filter(F.col("split") == split)
    v = F.col("vecs")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    keys = ["dataset", "split", "chunk", "pos"]
    n = names.filter("ids is not null").select(*keys, F.col("ids").alias("id")).distinct()
    return vectors.filter(good).select(*keys, v.alias("v")).join(n, keys).groupBy("id").agg(F.min("v").alias("v"))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first so that huge and tiny numbers survive."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


@dataclass
class Router:
    """The classifier: log-odds of the partitions are unit vectors times `w` plus `b`."""

    w: np.ndarray
    b: np.ndarray
    margin: float
    expected: float  # the recall that the calibration on held-out rows expects
    group: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))  # partition -> the first partition of its group

    def behind(self, u: np.ndarray) -> np.ndarray:
        """How far the log-odds of each partition lie below the row's best."""
        z = u.astype(np.float32) @ self.w + self.b
        return z.max(axis=1, keepdims=True) - z

    def pack(self) -> bytes:
        import pickle

        return pickle.dumps((self.w, self.b, self.margin, self.expected, self.group))


def neighbours(u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row, and their cosines, unordered."""
    u, near, sims = u.astype(np.float32), [], []
    k = min(k, len(u) - 1)
    for i in range(0, len(u), CHUNK):
        s = u[i : i + CHUNK] @ u.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        at = np.argpartition(-s, k - 1, axis=1)[:, :k].copy() if k else np.zeros((len(s), 0), np.int64)  # a view would keep the whole
        near.append(at)
        sims.append(np.take_along_axis(s, at, 1))
    return np.vstack(near), np.vstack(sims)


def balanced_partition(u: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, spare: float = 0.05, seed: int = 7) -> np.ndarray:
    """Cut the neighbour graph into `parts` of nearly equal size.

    Rows start at the nearest of the centres and move round by round to where most of their
    neighbours are, the surest first, as far as the capacities of the partitions allow."""
    rng = np.random.default_rng(seed)
    n, cap = len(u), math.ceil(len(u) / parts * (1 + spare))
    centre = u[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for r in range(rounds):
        score = u @ centre.T
        if r:
            votes = np.zeros((n, parts))
            np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), label[near].ravel()), 1.0 / max(1, near.shape[1]))
            score = votes + 0.5 * score
        want = np.argsort(-score, axis=1)
        best = np.take_along_axis(score, want, 1)
        free = np.full(parts, cap)
        for i in np.argsort(-(best[:, 0] - best[:, min(1, parts - 1)]), kind="stable"):
            for p in want[i]:
                if free[p]:
                    label[i] = p
                    free[p] -= 1
                    break
        for p in range(parts):
            m = u[label == p].sum(axis=0)
            centre[p] = m / max(np.linalg.norm(m), 1e-9)
    return label


def train(u: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 512, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on distributions over partitions (Adam)."""
    rng = np.random.default_rng(seed)
    x, y = u.astype(np.float32), target.astype(np.float32)
    theta = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for e in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            r = order[i : i + batch]
            z = x1[r] @ theta
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = x1[r].T @ (p - y[r]) / len(r)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (1 - e / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], theta[-1]


def held_out(n: int, seed: int = 7) -> np.ndarray:
    """The fifth of a sample of n rows that isn't trained on."""
    return np.random.default_rng(seed).permutation(n)[: n // 5]


def fit(sample: np.ndarray, parts: int, recall: float | None, k: int = 10, min_similarity: float | None = None, group: float = 1.0, seed: int = 7, partners: tuple[np.ndarray, np.ndarray] | None = None) -> Router:
    """Partition the sample's graph, train the classifier and choose the margin.

    A fifth of the sample is held out. With min_similarity the margin finds the stated share of
    partners at exactly that similarity in a random direction, the hardest that count; without, that
    share of `partners`, vectors of held-out rows and of their nearest neighbours in the whole collection,
    or else of the sample's own nearest neighbours. recall None: every partition is tried. `group` partitions travel together."""
    u = unit(sample)
    dim = u.shape[1]
    parts = max(1, min(parts, len(u) // 8))
    if parts == 1:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(u))
    held, use = order[: len(u) // 5], order[len(u) // 5 :]  # the former as in held_out
    near, _ = neighbours(u[use], k)
    label = balanced_partition(u[use], near, parts, seed=seed)
    target = np.zeros((len(use), parts))
    np.add.at(target, (np.repeat(np.arange(len(use)), near.shape[1]), label[near].ravel()), 0.5 / max(1, near.shape[1]))
    target[np.arange(len(use)), label] += 0.5
    w, b = train(u[use], target, seed=seed)
    router = Router(w, b, math.inf, 1.0)
    bundles = max(1, min(parts, round(parts / group)))
    centre = unit(np.array([u[use][label == p].sum(axis=0) if (label == p).any() else u[use][0] for p in range(parts)]))
    bundle = balanced_partition(centre, neighbours(centre, k)[0], bundles, seed=seed) if bundles > 1 else np.zeros(parts, np.int64)
    router.group = np.array([np.argmax(bundle == x) for x in bundle], np.int32)
    if recall is None:
        return router
    if min_similarity is not None:
        x = np.repeat(u[held], max(1, 20_000 // len(held)), axis=0)
        noise = rng.normal(size=x.shape)
        noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
        y = min_similarity * x + math.sqrt(1 - min_similarity**2) * unit(noise)
        a, o = router.behind(x), router.behind(y)
    elif partners is not None:
        a, o = router.behind(unit(partners[0])), router.behind(unit(partners[1]))
    else:
        s, _ = neighbours(u, min(5, k))
        a, o = router.behind(u[np.repeat(held, s.shape[1])]), router.behind(u[s[held].ravel()])
    # how far the one's own partition lies behind in the other's odds, the better of both directions
    every = np.arange(len(a))
    gap = np.sort(np.minimum(a[every, o.argmin(axis=1)], o[every, a.argmin(axis=1)]))
    router.margin = float(gap[min(len(gap) - 1, math.ceil(recall * len(gap)) - 1)])
    router.expected = float((gap <= router.margin).mean())
    return router


def visits(n, v, cell: int, own, model: Router, dim: int):
    """A record batch (n, v, visits): for each row the groups (g, home, leaves) of partitions that it visits.

    A partition's number is its cell's, which it is part of, times 1024, plus its place from 1; home
    is the row's own partition, where it is stored, or -1; rows that aren't the cell's own are stored
    elsewhere."""
    import pyarrow as pa

    rows = len(n)
    behind = model.behind(unit(matrix(v, dim))) if rows else np.zeros((0, len(model.b)))
    by_group = np.argsort(model.group, kind="stable")
    r, c = np.nonzero(behind[:, by_group] <= model.margin)
    leaf = by_group[c]
    g = model.group[leaf]
    start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])]) if len(r) else np.zeros(0, np.int64)
    home = behind.argmin(axis=1) if rows else np.zeros(0, np.int64)
    mine = own[r[start]] & (model.group[home[r[start]]] == g[start])
    first = cell * 1024 + 1
    ends = np.r_[start, len(r)].astype(np.int32)
    s = pa.StructArray.from_arrays(
        [pa.array(first + g[start].astype(np.int64)), pa.array(np.where(mine, first + home[r[start]], -1).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(first + leaf.astype(np.int64)))],
        names=["g", "home", "leaves"],
    )
    per_row = np.r_[0, np.cumsum(np.bincount(r[start], minlength=rows))].astype(np.int32) if rows else np.zeros(1, np.int32)
    return pa.RecordBatch.from_arrays([n, v, pa.ListArray.from_arrays(pa.array(per_row), s)], names=["n", "v", "visits"])


VISITS = "n bigint, v array<float>, visits array<struct<g: bigint, home: bigint, leaves: array<bigint>>>"


@dataclass
class Index:
    """Vectors in their blocks (g, mb, qs, home, leaves, n, v), ready to be compared."""

    classes: Stored  # n, id, v: one row per distinct vector; n follows the order of the ids
    members: Stored  # id, n of its class
    routed: list[Stored]
    blocks: DataFrame
    router: Router
    partitions: int
    groups: int
    dim: int

    def drop_routed(self) -> None:
        """Delete the routed vectors. `nearest` and `clusters` have stored what they found when they return."""
        for t in self.routed:
            t.drop()


def _neighbours_in_all(classes: DataFrame, asked: DataFrame, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of `asked` (n, v), a bounded number of rows, and of the k nearest of all classes, one row per pair."""
    dim = asked.select(F.size("v")).first()[0]

    def units(batches):
        import pyarrow as pa

        for t in batches:
            u = unit(matrix(t.column("v"), dim)) if t.num_rows else np.zeros((0, dim))
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dim), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(u), pa.string()), t.column("n"), v], names=["scheme", "id", "v"])

    plain = lambda df: df.select("n", "v").mapInArrow(units, "scheme string, id bigint, v array<double>")
    near = topk(plain(classes), plain(asked), k + 1).filter("query_id <> doc_id").select("query_id", "doc_id")
    near = near.join(classes.select(F.col("n").alias("doc_id"), F.col("v").alias("b")), "doc_id").join(asked.select(F.col("n").alias("query_id"), F.col("v").alias("a")), "query_id")
    got = near.select("a", "b").toArrow()  # at most k + 1 rows per row asked
    return matrix(got["a"], dim), matrix(got["b"], dim)


def _refined(hot: DataFrame, big: DataFrame, model_of: Callable, dim: int, sample: int) -> Stored:
    """Visits of the rows of `hot` (n, v, cell, own) to partitions of their cells.

    Each cell of `big` (cell, stored, rows) gets a classifier from at most some `sample` of its stored
    rows, which meets the cell's rows in slices, so no task holds a whole cell."""
    schema = "cell bigint, model binary"

    def learn(key, table):
        import pyarrow as pa

        t = table.slice(0, 2 * sample)  # the hash leaves about `sample`
        stored = table.column("stored")[0].as_py()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "model": pa.array([model_of(matrix(t.column("v"), dim), stored).pack()], pa.binary())})

    part = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("stored"))
    sampled = hot.filter("own").join(big, "cell").filter(F.pmod(F.xxhash64("n", F.lit(5)), F.lit(1_000_003)) < part * 1_000_003)
    models = materialize(sampled.select("cell", "stored", "n", "v").groupBy("cell").applyInArrow(learn, schema), "models").df
    slices = F.ceil(F.col("rows") / F.lit(SEARCHERS)).cast("int")
    left = hot.join(big, "cell").select("cell", F.pmod(F.xxhash64("n", F.lit(13)), slices).cast("int").alias("slice"), "n", "v", "own")
    right = models.join(big, "cell").select("cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "model")

    def route(key, rows, model):
        import pickle

        import pyarrow as pa

        m = Router(*pickle.loads(model.column("model")[0].as_py())) if model.num_rows else Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), 0.0, 1.0)
        n, v = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("n", "v"))
        return pa.Table.from_batches([visits(n, v, key[0].as_py(), rows.column("own").to_numpy().astype(bool), m, dim)])

    return materialize(left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(route, VISITS), "routed", "lz4")


def build(
    vectors: DataFrame,
    dim: int,
    recall: float | None,
    min_similarity: float | None = None,
    rows: int = ROWS,
    sample: int = SAMPLE,
    fanout: int = FANOUT,
    refine: int = REFINE,
) -> Index:
    """Index `vectors` (id, v). Ids with equal vectors form a class of which only the smallest id is indexed.

    recall None: exact, every vector meets every other. Otherwise the stated share of neighbours (or,
    with min_similarity, of partners at least so similar) is aimed at."""
    sc = vectors.sparkSession.sparkContext
    own = materialize(vectors, "vectors", "lz4")
    tagged = own.df.select("id", F.xxhash64("v").alias("d"), F.xxhash64(F.lit(1), "v").alias("e"))  # 128 bits
    members = materialize(tagged.join(tagged.groupBy("d", "e").agg(F.min("id").alias("class_id")), ["d", "e"]).select("id", "class_id"), "members")
    reps = own.df.join(members.df.filter("id = class_id").select("id"), "id", "left_semi")
    classes = materialize(reps.sort("id").withColumn("n", F.monotonically_increasing_id()), "classes", "lz4")
    own.drop()
    named = materialize(members.df.join(classes.df.select("n", F.col("id").alias("class_id")), "class_id").select("id", "n"), "members")
    members.drop()
    members = named
    count = classes.df.count()
    take = classes.df.select("id", "n", "v").withColumn("h", F.xxhash64("id"))
    if count > 4 * sample:
        take = take.filter(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * 1.5 * sample / count))
    got = take.orderBy("h").limit(sample).select("n", "v").toArrow()
    s = matrix(got["v"], dim) if got.num_rows else np.zeros((0, dim))
    partners = None
    if recall is not None and min_similarity is None and count > len(s):
        # the sample's neighbours lie farther apart than those in the whole collection, which the margin is for
        held = got.take(held_out(len(s))[:HELD].copy())
        partners = _neighbours_in_all(classes.df, vectors.sparkSession.createDataFrame(held.to_pandas(), "n bigint, v array<float>"))
    tasks = 3 * sc.defaultParallelism

    def model_of(vectors: np.ndarray, stored: int) -> Router:
        parts = max(1, min(fanout, round(stored / rows)))
        return fit(vectors, parts, recall, min_similarity=min_similarity, group=GROUP / max(1, stored / parts))

    parts = max(1, min(fanout, round(count / rows)))
    levels, left = 1, count / parts
    while left > refine and levels < LEVELS:
        levels, left = levels + 1, left / fanout
    recall = recall and recall ** (1 / levels)  # the levels' losses add up
    router = fit(s, parts, recall, min_similarity=min_similarity, group=max(1.0, min(GROUP / max(1, count / parts), parts / tasks)), partners=partners) if len(s) else Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), 0.0, 1.0)
    packed = sc.broadcast(router.pack())  # at most FANOUT x (dim + 2) numbers

    def route(batches):
        import pickle

        m = Router(*pickle.loads(packed.value))
        for t in batches:
            yield visits(t.column("n"), t.column("v"), 0, np.ones(t.num_rows, bool), m, dim)

    plain = classes.df.select("n", "v")
    if count > 4096 and plain.rdd.getNumPartitions() < sc.defaultParallelism:
        plain = plain.repartition(2 * sc.defaultParallelism)
    level = materialize(plain.mapInArrow(route, VISITS), "routed", "lz4")
    # the first classifier's partitions and groups come to the driver: at most 2 x FANOUT rows
    first = level.df.select(F.explode("visits").alias("x")).groupBy("x.g", "x.home").agg(F.count(F.lit(1)).alias("c")).collect()
    sizes = {r["home"]: r["c"] for r in first if r["home"] >= 0}
    routed, out, partitions, groups = [level], [], len(sizes), len({r["g"] for r in first})
    hottest = max(sizes.values(), default=0)
    for depth in range(LEVELS):
        each = level.df.select("n", "v", F.explode("visits").alias("x")).select("n", "v", "x.g", "x.home", "x.leaves")
        if hottest <= refine or depth == LEVELS - 1:
            out.append(each)
            break
        # sizes of partitions, without the vectors
        stored = level.df.select(F.explode("visits").alias("x")).filter("x.home >= 0").groupBy(F.col("x.home").alias("cell")).agg(F.count(F.lit(1)).alias("stored"))
        visiting = level.df.select(F.explode("visits").alias("x")).select(F.explode("x.leaves").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        hot_cells = materialize(stored.filter(F.col("stored") > refine).join(visiting, "cell"), "hot")
        big = hot_cells.df
        # what isn't hot stays as it is; hot partitions get one row per visitor and are cut again
        flat = each.select("n", "v", "g", "home", F.explode("leaves").alias("cell"))
        hot = flat.join(big.select("cell"), "cell", "left_semi").select("n", "v", "cell", (F.col("home") == F.col("cell")).alias("own"))
        rest = flat.join(big.select("cell"), "cell", "left_anti")
        out.append(rest.select("n", "v", "g", F.when(F.col("home") == F.col("cell"), F.col("home")).otherwise(F.lit(-1)).alias("home"), F.array("cell").alias("leaves")))
        level = _refined(hot, big, model_of, dim, sample)
        routed += [hot_cells, level]
        tally = level.df.select(F.explode("visits").alias("x")).filter("x.home >= 0").groupBy("x.g", "x.home").agg(F.count(F.lit(1)).alias("c"))
        tally = tally.agg(F.max("c").alias("most"), F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("groups")).first()
        hottest, partitions, groups = tally["most"] or 0, partitions + tally["n"], groups + tally["groups"]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    one = F.lit(0).alias("mb"), F.lit(0).alias("qs")
    whole = every.select("g", *one, "home", "leaves", "n", "v")
    rows_of: dict[int, int] = {}
    stored_of: dict[int, int] = {}
    for r in first:
        rows_of[r["g"]] = rows_of.get(r["g"], 0) + r["c"]
        stored_of[r["g"]] = stored_of.get(r["g"], 0) + (r["c"] if r["home"] >= 0 else 0)
    if len(out) == 1 and max(rows_of.values(), default=0) <= SEARCHERS and max(stored_of.values(), default=0) <= BLOCK:
        return Index(classes, members, routed, whole, router, partitions, groups, dim)
    shape = every.groupBy("g").agg(F.sum((F.col("home") >= 0).cast("bigint")).alias("stored"), F.count(F.lit(1)).alias("rows")).filter("stored > 0")
    shape = materialize(shape.filter((F.col("stored") > BLOCK) | (F.col("rows") > SEARCHERS)), "shape")
    routed.append(shape)
    cut = shape.df.select("g", F.ceil(F.col("stored") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("rows") / SEARCHERS).cast("int").alias("ns"))
    h = F.xxhash64("n", F.lit(11))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    some = every.join(cut, "g")
    searching = some.select("g", F.explode(upto("nb")).alias("mb"), F.pmod(h, "ns").cast("int").alias("qs"), F.lit(-1).cast("bigint").alias("home"), "leaves", "n", "v")
    stored_ = some.filter("home >= 0").select("g", F.pmod(h, "nb").cast("int").alias("mb"), F.explode(upto("ns")).alias("qs"), "home", F.array().cast("array<bigint>").alias("leaves"), "n", "v")
    blocks = whole.join(cut, "g", "left_anti").unionByName(searching).unionByName(stored_)
    return Index(classes, members, routed, blocks.select("g", "mb", "qs", "home", "leaves", "n", "v"), router, partitions, groups, dim)


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def cosines(u: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Double-precision cosines of the pairs u[r], v[c], the same for (x, y) and (y, x)."""
    out = np.empty(len(r))
    for i in range(0, len(r), 200_000):
        out[i : i + 200_000] = np.einsum("ij,ij->i", u[r[i : i + 200_000]], v[c[i : i + 200_000]])
    return np.round(np.minimum(out, 1.0), 12)


def best(rows: np.ndarray, others: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different others of each row: higher cosine, then smaller other."""
    order = np.lexsort((others, -cos, rows))
    r, o = rows[order], others[order]
    again = np.r_[False, (r[1:] == r[:-1]) & (o[1:] == o[:-1])] if len(r) else np.zeros(0, bool)  # found from both sides
    order = order[~again]
    r = rows[order]
    start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
    return order[place < k]


class Top:
    """The k best partners of each of some rows, while pairs are offered."""

    def __init__(self, rows: int, k: int, least: float):
        self.k, self.floor = k, np.full(rows, least - SLACK, np.float32)
        self.held, self.fresh, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def offer(self, a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> None:
        self.fresh += [(a, b, cos), (b, a, cos)]
        self.waiting += 2 * len(a)
        if self.waiting > len(self.held[0]) + 200_000:
            self.settle()

    def settle(self) -> None:
        new = tuple(np.concatenate(x) for x in zip(self.held, *self.fresh, strict=True))
        at = best(*new, self.k)
        self.held, self.fresh, self.waiting = tuple(x[at] for x in new), [], 0
        full = np.bincount(self.held[0], minlength=len(self.floor)) >= self.k
        low = np.full(len(self.floor), np.inf)
        np.minimum.at(low, self.held[0], self.held[2])
        self.floor = np.where(full, np.maximum(self.floor, low - SLACK), self.floor).astype(np.float32)


def meetings(table, dim: int, k: int, floor: Callable[[], np.ndarray], nodes: list):
    """Pairs (a, b, cosine) of places among the block's rows whose similarity reaches the floor of either.

    Appends the rows' n, in order, to nodes before the first pair. Partition by partition, the rows
    that try it are compared with those stored in it. Floors below -1 are raised to the k-th best of
    the first comparison with more than k rows."""
    n, inverse = np.unique(table.column("n").to_numpy(), return_inverse=True)
    nodes.append(n)
    home, lists = table.column("home").to_numpy(), table.column("leaves").combine_chunks()
    tries, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(home)), lists.value_lengths().to_numpy())
    u = unit(matrix(table.column("v"), dim)) if len(home) else np.zeros((0, dim))
    f = u.astype(np.float32)
    order = np.argsort(tries, kind="stable")
    tries, at = tries[order], at[order]
    kept = np.flatnonzero(home >= 0)
    kept = kept[np.argsort(home[kept], kind="stable")]
    leaves, start = np.unique(home[kept], return_index=True)
    for leaf, m in zip(leaves, np.split(kept, start[1:]) if len(kept) else (), strict=False):
        q = at[np.searchsorted(tries, leaf) : np.searchsorted(tries, leaf, "right")]
        q = np.concatenate([q[home[q] == leaf], q[home[q] != leaf]])  # the partition's own rows first, as their floors rise soonest
        mine, stored = inverse[m], f[m]
        for i in range(0, len(q), CHUNK):
            part = q[i : i + CHUNK]
            who = inverse[part]
            s = f[part] @ stored.T
            s[who[:, None] == mine[None, :]] = -3
            low = floor()
            for axis, places in ((1, who), (0, mine)):
                loose = np.flatnonzero(low[places] < -1)
                if len(loose) and s.shape[axis] > k:
                    kth = np.partition(s[loose] if axis else s[:, loose].T, -k, axis=1)[:, -k]
                    low[places[loose]] = np.where(kth > -2, kth - SLACK, low[places[loose]])
            r, c = np.divmod(np.flatnonzero(s >= np.minimum(np.maximum(low[who], -2)[:, None], np.maximum(low[mine], -2)[None, :])), s.shape[1])
            if len(r):
                yield who[r], mine[c], cosines(u[part], u[m], r, c)


def nearest_in_block(table, dim: int, k: int, min_similarity: float | None):
    """(n, others, cosines): the k best partners of every row of a block, those at least as similar as min_similarity."""
    least = -2.0 if min_similarity is None else min_similarity
    nodes: list = []
    top = Top(len(np.unique(table.column("n").to_numpy())), k, least)
    for a, b, cos in meetings(table, dim, k, lambda: top.floor, nodes):
        top.offer(a, b, cos)
    top.settle()
    a, b, cos = top.held
    if min_similarity is not None:
        near = cos >= min_similarity
        a, b, cos = a[near], b[near], cos[near]
    order = np.argsort(a, kind="stable")
    return nodes[0][a[order]], nodes[0][b[order]], cos[order]


def blockwise(index: Index) -> DataFrame:
    """The blocks, dealt out so that each of them is one group."""
    return index.blocks.repartition(max(8, min(20_000, 3 * index.groups)), "g", "mb", "qs")


def nearest(index: Index, k: int, min_similarity: float | None = None) -> DataFrame:
    """(id, rank from 1, other_id, cosine): the k most similar other ids, best first, equal cosines by id.

    With min_similarity only those at least as similar. Ids of equal vectors have cosine 1."""
    dim, top = index.dim, k

    def run(table):
        import pyarrow as pa

        n, o, cos = nearest_in_block(table, dim, top, min_similarity)
        start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[start, len(n)].astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(-cos), pa.array(o.astype(np.int64))], names=["c", "o"])
        return pa.table({"n": pa.array(n[start].astype(np.int64)), "l": pa.ListArray.from_arrays(ends, pairs)})

    found = blockwise(index).groupBy("g", "mb", "qs").applyInArrow(run, "n bigint, l array<struct<c: double, o: bigint>>")
    # each vector has one list of at most k from each block it was in
    near = found.groupBy("n").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))), 1, k).alias("l"))
    near = materialize(near.select("n", F.explode("l").alias("x")).select("n", F.col("x.o").alias("o"), (-F.col("x.c")).alias("cos")), "near").df
    m = index.members.df
    first = m.withColumn("r", F.row_number().over(_by("n").orderBy("id"))).filter(F.col("r") <= k + 1).select("n", F.col("id").alias("other_id"))
    offers = near.join(first.withColumnRenamed("n", "o"), "o").select("n", "other_id", "cos")
    several = m.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("n")
    inside = first.join(several, "n", "left_semi").select("n", "other_id", F.lit(1.0).alias("cos"))
    each = offers.unionByName(inside).join(m, "n").filter("id <> other_id")
    ranked = each.withColumn("rank", F.row_number().over(_by("id").orderBy(F.desc("cos"), "other_id"))).filter(F.col("rank") <= k)
    return ranked.select("id", "rank", "other_id", F.col("cos").alias("cosine"))
