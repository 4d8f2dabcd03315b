"""Most similar vectors for every vector: probed lists scanned in column blocks of rotated vectors, with early abandonment.

Vectors are normalised, equal ones are collapsed, all are turned by one random rotation and put into the list of their nearest centroid. Each
vector scans its own list exactly, which sets its distance threshold; in each further probed list it computes partial distances over blocks of
columns and abandons a candidate when a hypothesis test on the partial distance rejects that the whole one is within the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.skew import hot_keys, join_unique
from plumbline.session import cut_lineage

#: Columns per block, and the width of the hypothesis test: a candidate within the threshold is lost with a probability of well under 1 %.
BLOCK = 16
EPSILON = 3.0
#: Vectors and queries that one task compares; groups of lists and their queries beyond are cut into blocks, so no list is too large.
MEMBERS, QUERIES = 8_000, 8_000
#: Lists of one model at most: their centroids are sent to every executor (25 MB at 96 dimensions). They are fitted on SAMPLE_PER_LIST vectors each.
MAX_LISTS, SAMPLE_PER_LIST = 65_536, 8
#: Neighbouring lists that are scanned in one task: a query is sent once for all of them.
GROUP = 8
#: Models of at most this many vectors are compared whole, any number of such models together.
SMALL = 2_000


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means; empty clusters are set to random members."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = norm[:, 0] == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.where(empty[:, None], 1, norm)
    return c.astype(np.float32)


def fit_lists(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About k unit centroids of a sample, and the group of GROUP neighbouring ones or so that each is in. In two levels, so that fitting and assigning cost
    the root of k for each vector."""
    top = kmeans(x, max(1, round(k / GROUP) if k <= 32 * GROUP else round(k**0.5)), seed)
    own = np.concatenate([np.argmax(x[i : i + 4096] @ top.T, 1) for i in range(0, len(x), 4096)])
    found, groups, count = [], [], 0
    for g in range(len(top)):
        part = x[own == g]
        if not len(part):
            continue
        sub = kmeans(part, max(1, round(k * len(part) / len(x))), seed)
        found.append(sub)
        # Cells of many lists are cut into groups along their first principal direction.
        order = np.argsort(sub @ np.linalg.svd(sub - sub.mean(0), full_matrices=False)[2][0]) if len(sub) > GROUP else np.arange(len(sub))
        number = np.empty(len(sub), np.int32)
        number[order] = np.arange(len(sub)) // GROUP
        groups.append(number + count)
        count += int(number.max()) + 1
    return np.concatenate(found).astype(np.float32), np.concatenate(groups)


def probe(x: np.ndarray, centroids: np.ndarray, parents: np.ndarray, children: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``reach`` nearest lists of each vector and their similarities, the nearest first: among all lists, or if these are many among those of the nearest
    groups that hold eight times as many."""
    if len(centroids) <= 2048:
        sims = x @ centroids.T
        near = np.argsort(-sims, 1, kind="stable")[:, :reach]
        return near, np.take_along_axis(sims, near, 1)
    near = np.empty((len(x), reach), np.int64)
    value = np.empty((len(x), reach), np.float32)
    order = np.argsort(-(x @ parents.T), 1, kind="stable")
    for i in range(len(x)):
        cand, taken = [], 0
        for g in order[i]:
            cand.append(children[g])
            taken += len(children[g])
            if taken >= 8 * reach:
                break
        ids = np.concatenate(cand)
        sims = centroids[ids] @ x[i]
        best_ = np.argsort(-sims, kind="stable")[:reach]
        near[i], value[i] = ids[best_], sims[best_]
    return near, value


def scan(q: np.ndarray, c: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, squared distance) within each query's ``limit`` of squared distance, by adaptive partial distances."""
    dim = q.shape[1]
    first = min(BLOCK, dim)
    part = (q[:, :first] ** 2).sum(1)[:, None] + (c[:, :first] ** 2).sum(1)[None, :] - 2 * (q[:, :first] @ c[:, :first].T)
    i, j = np.nonzero(part * (dim / first) <= (limit * (1 + EPSILON / np.sqrt(first)) ** 2)[:, None])
    d = part[i, j]
    del part
    if first == dim:  # one block holds the whole vector: its distance is no estimate
        keep = d <= limit[i] + 1e-6
        i, j, d = i[keep], j[keep], d[keep]
    for a in range(first, dim, BLOCK):
        b = min(a + BLOCK, dim)
        for s in range(0, len(i), 200_000):
            e = s + 200_000
            diff = q[i[s:e], a:b] - c[j[s:e], a:b]
            d[s:e] += np.einsum("ij,ij->i", diff, diff)
        # At the last block the partial distance is the whole one and the test is exact.
        keep = d * (dim / b) <= limit[i] * ((1 + EPSILON / np.sqrt(b)) ** 2 if b < dim else 1.0) + 1e-6
        i, j, d = i[keep], j[keep], d[keep]
    return i, j, np.maximum(d, 0)


def best(i: np.ndarray, j: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of each query; ties go to the smaller id."""
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1]) if len(i) else np.empty(0, int)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.concatenate([start, [len(i)]])))
    return i[rank < k], j[rank < k], d[rank < k]


def usable_vectors(df: DataFrame, key: str, vector: str, model: str) -> DataFrame:
    """(model, vec_id, v, copy) of vectors that are not null, not all zero, without NaN or infinity and of their model's length, the most frequent of
    its valid ones (the smaller of equally frequent ones). v has unit length; equal v share ``copy``."""
    whole = df.select(F.col(model).alias("model"), F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    whole = whole.withColumn("norm", norm).where("norm > 0").withColumn("dim", F.size("v"))
    dims = whole.groupBy("model", "dim").count().groupBy("model").agg(F.max(F.struct("count", (-F.col("dim")).alias("neg"))).alias("x"))
    dims = dims.select("model", (-F.col("x.neg")).alias("dim"))
    unit = F.transform("v", lambda x: (x / F.col("norm")).cast("float"))
    kept = whole.join(dims, (whole["model"].eqNullSafe(dims["model"])) & (whole["dim"] == dims["dim"]), "left_semi")
    kept = kept.select(F.coalesce("model", F.lit("")).alias("model"), "vec_id", unit.alias("v"))
    return kept.withColumn("copy", F.concat_ws(":", "model", F.xxhash64("v", F.lit(1)), F.xxhash64("v", F.lit(2))))


def nearest(
    df: DataFrame,
    k: int = 10,
    min_similarity: float | None = None,
    key: str = "vec_id",
    vector: str = "embedding",
    model: str = "model",
    probes: int | None = None,
    list_size: int = 400,
    sample: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """(model, vec_id, neighbour, similarity): up to k most similar vectors of the same model for every usable vector, by cosine, itself excluded, ties to the
    smaller id; with ``min_similarity`` only those at least as similar. Unusable vectors (see usable_vectors) take no part; an empty input gives an
    empty result; a repeated key is one vector per distinct value.

    The index is fitted on ``sample`` vectors of each model, or SAMPLE_PER_LIST for each of its lists if these are more (half a million at most), and holds all. Its lists grow
    in number with the vectors, up to MAX_LISTS. Models of at most SMALL vectors have none and are compared whole. Equal vectors are searched once, by their smallest id; of their copies
    the k + 1 smallest are kept as neighbours, which is all that k neighbours can need. No list, probe or group of copies has to fit a task."""
    spark = df.sparkSession
    probes = probes or (16 if min_similarity is not None and min_similarity >= 0.8 else 24)
    schema = "model string, vec_id bigint, neighbour bigint, similarity double"
    base = cut_lineage(usable_vectors(df, key, vector, model))
    by_copy = Window.partitionBy("copy").orderBy("vec_id")
    few = base.select("copy", "vec_id").distinct().withColumn("r", F.row_number().over(by_copy)).where(F.col("r") <= k + 1)
    groups = few.groupBy("copy").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = base.groupBy("copy").agg(F.min("vec_id").alias("rep"), F.first("model").alias("model"), F.first("v").alias("v"))
    reps = cut_lineage(reps.select("model", "rep", "v", "copy"))
    copies = cut_lineage(reps.select("model", "rep", "copy").join(groups, "copy"))  # without the vectors
    sizes = cut_lineage(reps.groupBy("model").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("dim")))
    large = [(r.model, r.n, r.dim) for r in sizes.where(F.col("n") > SMALL).collect()]  # fewer than the vectors by SMALL
    small = reps.join(sizes.where(F.col("n") <= SMALL).select("model"), "model", "left_semi")
    found = _whole(small, k, min_similarity)
    for name, n, dim in large:
        found = found.unionByName(_search(reps.where(F.col("model") == name), n, dim, k, min_similarity, probes, list_size, sample, seed))
    # Neighbours stand for their copies, and vectors for theirs.
    near = found.join(copies.select(F.col("rep").alias("near"), F.col("model").alias("m2"), F.col("ids").alias("near_ids")), [F.col("near") == F.col("near_rep"), F.col("m2") == F.col("model")])
    near = near.groupBy("model", "rep").agg(F.collect_list(F.struct("d", "near_ids")).alias("near"))
    table = copies.join(near, ["model", "rep"], "left").select("copy", "ids", "near")
    hot = hot_keys(base, "copy", base.count())
    rows = join_unique(base.select("model", "vec_id", "copy").distinct(), table, "copy", "inner", hot)
    own = F.transform("ids", lambda x: F.struct(F.lit(0.0).alias("d"), x.alias("id")))
    others = F.flatten(F.transform(F.coalesce("near", F.array()), lambda g: F.transform(g["near_ids"], lambda x: F.struct(g["d"].alias("d"), x.alias("id")))))
    every = F.filter(F.concat(own, others), lambda x: x["id"] != F.col("vec_id"))
    picked = rows.select("model", "vec_id", F.explode(F.slice(F.array_sort(F.array_distinct(every)), 1, k)).alias("x"))
    return picked.select("model", "vec_id", F.col("x.id").alias("neighbour"), (1 - F.col("x.d") / 2).alias("similarity"))


def _whole(reps: DataFrame, k: int, least: float | None) -> DataFrame:
    """(model, rep, near_rep, d) of models that fit a task, by all their distances."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = np.stack(pdf["v"].to_numpy()).astype(np.float32), pdf["rep"].to_numpy()
        d = np.maximum(2 - 2 * (v @ v.T), 0)
        np.fill_diagonal(d, 9.0)
        i, j = np.nonzero(d <= (4.0 + 1e-6 if least is None else 2 - 2 * least + 1e-6))
        i, j, x = best(i, j, d[i, j], ids, k)
        return pd.DataFrame({"model": pdf["model"].iloc[0], "rep": ids[i], "near_rep": ids[j], "d": x.astype(np.float64)})

    return reps.select("model", "rep", "v").groupBy("model").applyInPandas(compare, "model string, rep bigint, near_rep bigint, d double")


def _search(reps: DataFrame, n: int, dim: int, k: int, least: float | None, probes: int, list_size: int, sample: int, seed: int) -> DataFrame:
    """(model, rep, near_rep, d): up to k nearest representatives of each one, by squared distance of unit vectors.

    A vector is sent once to each group of lists that it probes. Lists that cannot hold a nearer vector than those found, by the angle to their centroid
    and their widest member, are not probed."""
    spark = reps.sparkSession
    name = reps.select("model").first()[0]
    turn = rotation(dim, seed)
    lists = int(min(MAX_LISTS, max(1, n // list_size)))
    sample = max(sample, SAMPLE_PER_LIST * lists)
    taken = reps.sample(fraction=min(1.0, 1.2 * sample / n), seed=seed).select("v").limit(sample).toPandas()
    fit = np.stack(taken["v"].to_numpy()).astype(np.float32) @ turn
    centroids, groups = fit_lists(fit, max(1, min(lists, len(fit) // SAMPLE_PER_LIST)), seed)
    children = [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
    parents = np.stack([centroids[c].mean(0) for c in children])
    sent = spark.sparkContext.broadcast((turn, centroids, groups, parents, children))
    most = 4.0 if least is None else max(0.0, 2 - 2 * least)
    reach = min(probes, len(centroids))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, cent, group, up, down = sent.value
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float32) @ turn
            near, sims = probe(x, cent, up, down, reach)
            angle = np.arccos(np.clip(sims, -1, 1)).astype(np.float32)
            yield pd.DataFrame({"grp": group[near[:, 0]], "list": near[:, 0].astype(np.int32), "angle": angle[:, 0], "rep": pdf["rep"], "v": list(x), "lists": list(near.astype(np.int32)), "groups": list(group[near].astype(np.int32)), "angles": list(angle)})

    members = cut_lineage(reps.mapInPandas(assign, "grp int, list int, angle float, rep bigint, v array<float>, lists array<int>, groups array<int>, angles array<float>"))
    probes_of = F.transform(F.arrays_zip("lists", "groups", "angles"), lambda p: F.struct(p["lists"].alias("list"), p["groups"].alias("grp"), p["angles"].alias("angle")))
    members = members.withColumn("probes", probes_of)
    widest = {r["list"]: float(r["w"]) for r in members.groupBy("list").agg(F.max("angle").alias("w")).collect()}  # at most MAX_LISTS rows
    width = F.lit([widest.get(x, -9.0) for x in range(len(centroids))])
    sizes = {r["grp"]: r["count"] for r in members.groupBy("grp").count().collect()}
    spot = F.abs(F.xxhash64("rep", F.lit(3)))

    def table(values: dict[int, int], size: int):
        """Into how many parts of ``size`` each group is cut."""
        cut = [max(1, -(-values.get(g, 0) // size)) for g in range(len(children))]
        return F.lit(1) if max(cut) == 1 else F.lit(cut)[F.col("grp")]

    blocks = table(sizes, MEMBERS)

    def compare(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"rep": np.empty(0, np.int64), "near_rep": np.empty(0, np.int64), "d": np.empty(0)})
        if not len(q) or not len(c):
            return out
        qv, cv = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy())
        qi, ci, lim, held = q["rep"].to_numpy(), c["rep"].to_numpy(), q["lim"].to_numpy(np.float64).copy(), c["list"].to_numpy()
        asked = q["asked"].to_list()
        rows = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
        flat = np.concatenate(asked)
        parts = []
        for x in np.unique(held):
            at, own = rows[flat == x], np.flatnonzero(held == x)
            for s in range(0, len(at), 1024):
                mine = at[s : s + 1024]
                limit = lim[mine]
                free = limit >= most  # no threshold yet: the distances in this list set one
                if free.any() and len(own) > k + 1:
                    d = 2 - 2 * (qv[mine[free]] @ cv[own].T)
                    limit[free] = np.minimum(limit[free], np.partition(d, k, axis=1)[:, k] + 1e-5)  # its own row may be among them
                i, j, d = scan(qv[mine], cv[own], limit)
                other = qi[mine[i]] != ci[own[j]]
                i, j, d = best(i[other], j[other], d[other], ci[own], k)
                parts.append(pd.DataFrame({"rep": qi[mine[i]], "near_rep": ci[own[j]], "d": d.astype(np.float64)}))
        found = pd.concat(parts) if parts else out
        # Only the nearest of all lists of the group go on.
        order = found.sort_values(["rep", "d", "near_rep"], kind="stable")
        return order[order.groupby("rep").cumcount() < k]

    found = "rep bigint, near_rep bigint, d double"
    parts = ["grp", "block", "chunk"]
    rank = Window.partitionBy("rep").orderBy("d", "near_rep")

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).drop("r")

    def scanned(q: DataFrame) -> DataFrame:
        """Queries (grp, rep, v, lim, asked) against the members of their groups, both cut into parts where they are many."""
        asking = {r["grp"]: r["count"] for r in q.groupBy("grp").count().collect()}
        chunks = table(asking, QUERIES)
        held = members.select("grp", (spot % blocks).cast("int").alias("block"), "list", "rep", "v", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        held = held.select(*[F.col(c).alias(c) for c in ("grp", "block", "chunk", "list", "rep", "v")])  # other columns than the queries', which are of the same table
        rows = q.withColumn("chunk", (spot % chunks).cast("int")).select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "chunk", "rep", "v", "lim", "asked")
        return rows.groupBy(*parts).cogroup(held.groupBy(*parts)).applyInPandas(compare, found)

    # The own group first, the own list before its others: that sets the threshold for all other groups.
    here = F.transform(F.filter("probes", lambda p: p["grp"] == F.col("grp")), lambda p: p["list"])
    first = cut_lineage(top(scanned(members.select("grp", "rep", "v", F.lit(float(most)).alias("lim"), here.alias("asked")))))
    done = first
    if reach > 1:
        kth = first.groupBy("rep").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float(most)).alias("lim"))
        limit = F.least(F.coalesce("lim", F.lit(float(most))), F.lit(float(most)))
        q = members.join(kth, "rep", "left").select("grp", "rep", "v", "probes", limit.alias("lim"))
        within = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.col("lim")) / 2)) + 1e-3
        q = q.withColumn("probes", F.filter("probes", lambda p: (p["grp"] != F.col("grp")) & (p["angle"] - F.element_at(width, p["list"] + 1) <= within)))
        q = q.select("rep", "v", "lim", "probes", F.explode(F.array_distinct(F.transform("probes", lambda p: p["grp"]))).alias("grp"))
        q = q.select("grp", "rep", "v", "lim", F.transform(F.filter("probes", lambda p: p["grp"] == F.col("grp")), lambda p: p["list"]).alias("asked"))
        done = top(first.unionByName(scanned(q)).distinct())
    return done.select(F.lit(name).alias("model"), "rep", "near_rep", "d")


def similar_pairs(near: DataFrame) -> DataFrame:
    """nearest()'s rows as pairs (vec_lo, vec_hi), each once."""
    return near.select(F.least("vec_id", "neighbour").alias("vec_lo"), F.greatest("vec_id", "neighbour").alias("vec_hi")).distinct()
