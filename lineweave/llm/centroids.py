"""Centroid clustering over subvector dictionaries.

Vectors become integers once and are written as chunks of one Arrow batch each.  A chunk's dimensions are cut into blocks,
and a block is stored losslessly as its distinct subvectors and one code per vector; the cut is the one of least work,
found from single dimensions upwards.  A round computes the exact distance of each distinct subvector to each centroid's
block once, adds up a vector's partial distances by its codes, and sums clusters from counts of codes.  The chunks are a
table in the shared folder that every round reads anew; only clusters times dimensions sums reach the driver.
"""
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table, table

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Largest integer component: 64 squared differences stay below 2^63.
LARGEST = 2 ** 27
CHUNK = "n int, starts array<int>, ends array<int>, sizes array<int>, subvectors array<binary>, codes array<binary>"


def integers(vectors: DataFrame, dims=DIMS, scale=SCALE) -> DataFrame:
    """(vec_id, v): vectors of ``dims`` components, none null or non-finite, as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", x.alias("x")).filter((F.size("x") == dims) & F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))
    wide = F.exists("x", lambda e: F.abs(e) * scale > LARGEST)
    v = F.when(wide, F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}: its squared distance may not fit a long"))).otherwise(F.transform("x", lambda e: F.floor(e * scale).cast("long")))
    return kept.select("vec_id", v.alias("v"))


def dictionaries(m):
    """Blocks (start, end, distinct subvectors, codes) of an integer matrix whose lookups and distances cost least."""
    n, dims = m.shape
    level = []
    for i in range(dims):
        values, first, codes = np.unique(m[:, i], return_index=True, return_inverse=True)
        level.append((3 * len(values) + n, [(i, i + 1, m[first, i:i + 1], codes)], first, codes, i, i + 1))
    while len(level) > 1:
        joined = []
        for a, b in zip(level[::2], level[1::2]):
            _, first, codes = np.unique(a[3].astype(np.int64) * len(b[2]) + b[3], return_index=True, return_inverse=True)
            start, end = a[4], b[5]
            cost = 3 * len(first) * (end - start) + n
            whole = cost <= a[0] + b[0]
            joined.append((min(cost, a[0] + b[0]), [(start, end, m[first, start:end], codes)] if whole else a[1] + b[1], first, codes, start, end))
        level = joined + level[len(level) // 2 * 2:]
    return level[0][1]


def encode(ints: DataFrame) -> DataFrame:
    """Chunks of ``integers``: ids, and per block its distinct subvectors and the codes of all vectors of the chunk."""
    import pyarrow as pa
    names = [f.split()[0] for f in CHUNK.split(", ")]

    def chunks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)
            blocks = dictionaries(m)
            row = [batch.num_rows, [b[0] for b in blocks], [b[1] for b in blocks], [len(b[2]) for b in blocks], [np.ascontiguousarray(b[2], np.int64).tobytes() for b in blocks],
                   [b[3].astype(_code_type(len(b[2]))).tobytes() for b in blocks]]
            types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x], t) for x, t in zip(row, types)]], ["ids", *names])
    id_type = ints.schema["vec_id"].dataType.simpleString()
    return ints.select("vec_id", "v").mapInArrow(chunks, f"ids array<{id_type}>, {CHUNK}")


def _code_type(size):
    return np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.uint32


def _assigned(row, centroids):
    """Cluster and squared distance of each vector of a chunk, and the chunk's blocks; ties go to the smaller number."""
    total = np.zeros((row["n"], len(centroids)), np.int64)
    blocks = []
    for start, end, size, values, codes in zip(row["starts"], row["ends"], row["sizes"], row["subvectors"], row["codes"]):
        values = np.frombuffer(values, np.int64).reshape(size, end - start)
        codes = np.frombuffer(codes, _code_type(size))
        part = np.zeros((size, len(centroids)), np.int64)
        for j in range(end - start):
            part += (values[:, j, None] - centroids[None, :, start + j]) ** 2
        total += part[codes]
        blocks.append((start, end, values, codes))
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster], blocks


def _sums(chunks: DataFrame, centroids):
    """(counts, inertia, component sums) of the clusters, exact; one small row per task and cluster is shuffled."""
    import pyarrow as pa
    k, dims = centroids.shape

    def partial(batches):
        counts, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                cluster, distance, blocks = _assigned(row, centroids)
                counts += np.bincount(cluster, minlength=k)
                np.add.at(inertia, cluster, distance)
                for start, end, values, codes in blocks:
                    met = np.bincount(cluster * len(values) + codes, minlength=k * len(values)).reshape(k, -1)
                    sums[:, start:end] += met @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), pa.array(inertia), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "inertia", "sums"])
    rows = chunks.drop("ids").mapInArrow(partial, "cluster int, n long, inertia long, sums array<long>").filter("n > 0")
    rows = rows.select("cluster", F.posexplode(F.concat(F.array("n", "inertia"), "sums")).alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found = {(r["cluster"], r["at"]): int(r["x"]) for r in rows.collect()}  # clusters x (components + 2) numbers
    return [[found.get((c, i), 0) for i in range(dims + 2)] for c in range(k)]


def first_centroids(ints: DataFrame, clusters=CLUSTERS, salt=3):
    """The vectors with the smallest hashes of their ids; equal hashes by components, a null id last."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, clusters=CLUSTERS, rounds=ROUNDS, dims=DIMS, scale=SCALE) -> DataFrame:
    """``vectors`` (vec_id, embedding) as (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    One row per kept row, repeated ids and vectors too.  Vectors of another length, null, or with a null or non-finite
    component are left out.  With fewer vectors than clusters there are as many clusters as vectors; without any the result
    is empty.  A component beyond 2^17 (``LARGEST / scale``) ends the job with a message.
    """
    import pyarrow as pa
    spark = vectors.sparkSession
    ints = integers(vectors, dims, scale)
    id_type = ints.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long"
    centroids = first_centroids(ints, clusters)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = shared_table(encode(ints), "subvectors")
    for _ in range(rounds):
        for c, (n, _, *sums) in enumerate(_sums(chunks, centroids)):
            if n:
                centroids[c] = [s // n for s in sums]
    final = centroids.copy()
    totals = [(n, inertia) for n, inertia, *_ in _sums(chunks, final)]
    inertia = sum(t for _, t in totals)
    facts = [(c, t, inertia, hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest()) for c, (n, t) in enumerate(totals) if n]

    def assign(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, row in enumerate(batch.select(list(range(1, batch.num_columns))).to_pylist()):
                number, distance, _ = _assigned(row, final)
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return chunks.mapInArrow(assign, schema).join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # ``known`` has a row per cluster


def op12_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(rounds):
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(v) AS v, min_by(k, d * 8 + k) AS k, min(d) AS d FROM (SELECT r, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, floor(sum(v[i]) / count(*))::BIGINT AS m FROM (SELECT k, v, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) n USING (k))")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 8)),
{_sql(ROUNDS)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)
"""
