"""Centroid clustering with Yinyang bounds: exact assignments, most distances never computed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Workspace, table

SIZE, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Centroids a group holds on average.
PER_GROUP = 10
#: Largest magnitude of a component: squared distances of 64 of them fit 64 bits.
LIMIT = 2**27

STATE = "vec_id long, vec binary, cluster int, distance long, bounds binary, n long, total array<long>"


def up(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are no smaller, for upper bounds."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are no larger, for lower bounds."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def group_centroids(centers: np.ndarray, per_group: int = PER_GROUP, steps: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of plain clustering of the centroids themselves, done once."""
    seeds = centers[:: max(1, per_group)][: max(1, len(centers) // per_group)].astype(np.float64)
    for _ in range(steps):
        of = ((centers[:, None, :] - seeds[None, :, :]) ** 2).sum(2).argmin(1)
        seeds = np.stack([centers[of == g].mean(0) if (of == g).any() else seeds[g] for g in range(len(seeds))])
    return of


@dataclass
class Model:
    """Centroids, the group of each, and how far each moved in the last update."""

    centers: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def start(self, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper bound and lower bounds of rows of which nothing is known."""
        groups = int(self.group.max()) + 1
        return np.zeros(rows, np.int64), np.full(rows, np.inf, np.float32), np.full((rows, groups), -np.inf, np.float32)

    def moved(self, centers: np.ndarray) -> Model:
        return Model(centers, self.group, np.sqrt(squared(centers, self.centers).astype(np.float64)))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New cluster, upper and lower bounds of integer vectors, and the number of distances computed.

        upper bounds the distance to the own centroid; lower has one bound a group, on the distance to the nearest other
        centroid in it. All hold after the centroids' drift. A vector whose upper bound is below all its lower bounds
        stays; one that is not has its own distance computed and is tested again; then groups and at last centroids
        whose bounds are not above it are scanned. Ties are scanned and go to the smaller number.
        """
        groups = [np.flatnonzero(self.group == g) for g in range(lower.shape[1])]
        before = lower.astype(np.float64)
        near = up(upper + self.drift[cluster])
        far = down(before - np.array([self.drift[g].max(initial=0) for g in groups]))
        cluster, lower, done = cluster.copy(), far.copy(), 0
        todo = np.flatnonzero(far.min(1) <= near)
        own = squared(x[todo], self.centers[cluster[todo]])
        done += len(todo)
        near[todo] = up(np.sqrt(own.astype(np.float64)))
        left = far[todo].min(1) <= near[todo]
        todo, best = todo[left], own[left]
        if not len(todo):
            return cluster, near, lower, done
        who, limit, mine = cluster[todo], near[todo], x[todo]
        bound = down(before[todo][:, self.group] - self.drift)  # of each centroid but the vector's own
        bound[np.arange(len(todo)), who] = down(np.sqrt(best.astype(np.float64)))
        first = who.copy()
        for g, members in enumerate(groups):
            open_group = far[todo, g] <= limit
            for c in members:
                scan = np.flatnonzero(open_group & (first != c) & (bound[:, c] <= limit))
                if not len(scan):
                    continue
                d = squared(mine[scan], self.centers[c])
                done += len(scan)
                bound[scan, c] = down(np.sqrt(d.astype(np.float64)))
                better = (d < best[scan]) | ((d == best[scan]) & (c < who[scan]))
                won = scan[better]
                best[won], who[won] = d[better], c
                limit[won] = up(np.sqrt(d[better].astype(np.float64)))
        bound[np.arange(len(todo)), who] = np.inf
        for g, members in enumerate(groups):
            lower[todo, g] = bound[:, members].min(1, initial=np.inf)
        cluster[todo], near[todo] = who, limit
        return cluster, near, lower, done


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and embedding of the vectors of `size` components, none null or not finite."""
    finite: Column = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where((F.size("embedding") == size) & finite).select("vec_id", "embedding")


def as_integers(values: np.ndarray) -> np.ndarray:
    out = np.floor(SCALE * values.astype(np.float64))
    if len(out) and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component times {SCALE} is beyond {LIMIT}: squared distances would not fit 64 bits")
    return out.astype(np.int64)


def _pass(rows: DataFrame, model: Model, size: int, raw: bool) -> DataFrame:
    """Assigns all rows once. Returns their new state and, per task and cluster, count, sum and distance (rows with n)."""
    out = to_arrow_schema(StructType.fromDDL(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.centers)
        counts, totals, distances = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if raw:
                x = as_integers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, size))
                cluster, upper, lower = model.start(n)
            else:
                x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i4").reshape(n, size).astype(np.int64)
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), "<f4").reshape(n, -1)
                upper, lower = bounds[:, 0], bounds[:, 1:]
            cluster, upper, lower, _ = model.assign(x, cluster, upper, lower)
            distance = squared(x, model.centers[cluster])
            order = np.argsort(cluster, kind="stable")
            present, starts = np.unique(cluster[order], return_index=True)
            counts += np.bincount(cluster, minlength=k)
            totals[present] += np.add.reduceat(x[order], starts, axis=0)
            distances[present] += np.add.reduceat(distance[order], starts)
            bounds = np.concatenate((upper[:, None], lower), axis=1).astype("<f4")
            made = [
                batch.column("vec_id").cast(pa.int64()), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array(cluster, pa.int32()),
                pa.array(distance), pa.array([r.tobytes() for r in bounds], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, out.field("total").type),
            ]
            yield pa.RecordBatch.from_arrays(made, schema=out)
        at = np.flatnonzero(counts)
        if len(at):
            none = [pa.nulls(len(at), out.field(f).type) for f in ("vec_id", "vec", "bounds")]
            made = [none[0], none[1], pa.array(at, pa.int32()), pa.array(distances[at]), none[2], pa.array(counts[at]), pa.array(totals[at].tolist(), out.field("total").type)]
            yield pa.RecordBatch.from_arrays(made, schema=out)

    return rows.mapInArrow(run, STATE)


def cluster_vectors(spark: SparkSession, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia and inertia of every kept vector, and the final centroids.

    Centroids start as the k kept vectors of the smallest seeded hashes of vec_id, of equal ones those of the smaller
    components. `rounds` times all vectors are assigned and centroids become floored means, then all are assigned again.
    Each pass writes vectors and bounds to the shared folder, and the driver sees k sums. Vectors of another size, null
    ones and those with a null or non-finite component are left out. Repeated rows count each, a null vec_id is hashed
    as no digits, other columns play no part, and with fewer than k vectors each is a centroid. An empty table gives no
    rows. Components beyond 2^19 have no distances in 64 bits and raise an error.
    """
    rows = kept(vectors, size)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("embedding", order.alias("_order")).orderBy("_order", "embedding").limit(k).collect()
    if not first:
        empty = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long")
        return empty, np.zeros((0, size), np.int64)
    centers = as_integers(np.array([r["embedding"] for r in first], np.float64))
    model = Model(centers, group_centroids(centers), np.zeros(len(centers)))
    state, space = rows, None
    for turn in range(rounds + 1):
        here = Workspace(spark, "yinyang")
        state = here.save(_pass(state, model, size, raw=turn == 0), f"pass{turn}")
        if space:
            space.clear()  # the pass before is not read again
        sums = state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("d"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size))).collect()
        state, space = state.where("n is null"), here
        if turn < rounds:
            centers = model.centers.copy()
            for r in sums:
                centers[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(size)]
            model = model.moved(centers)
    inertia = sum(r["d"] for r in sums)
    # one row a centroid, so never more than k
    per = spark.createDataFrame([(r["cluster"], r["d"], inertia) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster"), model.centers


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = cluster_vectors(spark, table(spark, sf_dir, "embeddings"))
    named = spark.createDataFrame([(c, ",".join(map(str, v))) for c, v in enumerate(centers.tolist())], "cluster int, _values string")
    named = named.select("cluster", F.sha2("_values", 256).alias("centroid_sha256"))  # one row a centroid
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    steps = [
        f"""x AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {SIZE}),
e AS MATERIALIZED (SELECT id, unnest(v) AS v, unnest(range({SIZE})) AS i FROM x),
s AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM x QUALIFY c < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS v, unnest(range({SIZE})) AS i FROM s)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (SELECT id, c, CAST(sum((e.v - c{k}.v) * (e.v - c{k}.v)) AS BIGINT) AS d FROM e JOIN c{k} USING (i) GROUP BY id, c),
a{k} AS MATERIALIZED (SELECT id, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT c, i, CAST(sum(v) AS BIGINT) AS t, count(*) AS n FROM e JOIN a{k} USING (id) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, c{k}.i, coalesce((t - ((t % n) + n) % n) // n, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c, i))""")
    last = ROUNDS
    return f"""
WITH {", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN x USING (id) JOIN h USING (c)
"""


OP11_SQL = _op11_sql()
