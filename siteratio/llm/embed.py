"""Near-duplicate vectors by p-stable hashing for Euclidean distance.

Vectors are normalised, so a cosine of at least 0.98 is a distance of at most 0.2. In each of several
tables a vector gets a bucket from random projections, shifted and cut into cells of one width; vectors
that share a bucket of any table are compared by exact cosine in double precision. With the defaults,
a pair at the threshold shares one of the 32 buckets with probability 0.998 (nearer pairs more surely),
and unrelated vectors share one with about 7e-5.

Components keep their type: floats stay floats and anything else is taken as double, and all arithmetic is
double. Vectors are scaled by powers of two first, which is exact, so very large and very small ones neither
overflow nor vanish. Labels are compared as text.

Equal vectors are one class and hashed once. The members of a bucket are split into blocks of bounded
size and blocks are compared two by two, so a bucket of any size is compared completely by tasks of
bounded memory; a task sorts its rows by pair of blocks and walks through all of them. A pair counts in the first table where its buckets agree, so links are counted once
without a table of pairs; for components each comparison hands on one edge per vector.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components, and rows
with a null label, link with nothing; vectors of different lengths aren't compared; rows that repeat a
vec_id are separate vectors that share the smallest id; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from siteratio.llm.components import components
from siteratio.llm.store import stored
from siteratio.llm.words import mix

TABLES = 32
PROJECTIONS = 10
WIDTH = 1.0
COSINE = 0.98
SEED = 7
#: Members of a block.
BLOCK = 256
#: Numbers that are equal for the rows of one pair of blocks; ``pair`` stands for the label too.
PAIR = ["pair", "table", "dim", "bucket", "low", "high"]


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows of ``vectors``, finite and not all zero, by powers of two that bring them near length one."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per table for each row of ``vectors``."""
    a, b = _projections(vectors.shape[1])
    near = scaled(vectors)
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(vectors), TABLES, PROJECTIONS)
    key = np.zeros((len(vectors), TABLES), dtype=np.uint64)
    for k in range(PROJECTIONS):
        key = mix(key + cells[:, :, k])
    return key.view(np.int64)


def _classes(vectors: DataFrame, element: str) -> DataFrame:
    """id (smallest vec_id), label, dim, n and the buckets of each distinct usable vector."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, len(rows), 2000):
                    part = rows.slice(at, 2000)
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                    keys = bucket_keys(x.reshape(-1, dim).astype(np.float64))
                    ends = pa.array(np.arange(0, keys.size + 1, TABLES, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                        names=[*part.schema.names, "buckets"],
                    )

    columns = f"id long, class long, label string, dim int, n long, embedding array<{element}>, buckets array<long>"
    return vectors.mapInArrow(hashed, columns)


def _usable() -> str:
    finite = "x is not null and not isnan(x) and abs(x) < float('infinity')"
    return (
        "label is not null and embedding is not null and size(embedding) > 0 "
        f"and forall(embedding, x -> {finite}) and exists(embedding, x -> x <> 0)"
    )


def _matrix(lists: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """The given rows, all of one length, of a column of lists."""
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _links(x: np.ndarray, buckets: np.ndarray, side: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows with a cosine of at least COSINE that share none of ``buckets``, those of earlier tables."""
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    x = scaled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :])
    i, j = np.nonzero(cosine >= COSINE)
    if alone:
        i, j = i[i < j], j[i < j]
    i, j = left[i], right[j]
    if buckets.shape[1]:
        new = np.ones(len(i), dtype=bool)
        for at in range(0, len(i), 100_000):
            new[at : at + 100_000] = ~(buckets[i[at : at + 100_000]] == buckets[j[at : at + 100_000]]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def _least_reached(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``size`` positions reaches by the links (i, j)."""
    root = np.arange(size)
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _compared(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """class, links, root of the linked rows of each pair of blocks in ``rows``, which are sorted by pair."""
    number = {c: rows[c].to_numpy() for c in (*PAIR, "side", "class", "n")}
    embedding, buckets = rows["embedding"].combine_chunks(), rows["buckets"].combine_chunks()
    for start, end in zip(*_ranges(number), strict=True):
        at = np.arange(start, end)
        table, alone = int(number["table"][start]), number["low"][start] == number["high"][start]
        x = _matrix(embedding, at).astype(np.float64)
        earlier = _matrix(buckets, at)[:, :table]
        i, j = _links(x, earlier, number["side"][at], bool(alone))
        if len(i):
            n = number["n"][at]
            links = np.zeros(len(at), dtype=np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            some = np.flatnonzero(links)
            names = number["class"][at]
            yield names[some], links[some], names[_least_reached(len(at), i, j)[some]]


def _ranges(number: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of rows with equal PAIR columns."""
    size = len(number["pair"])
    new = np.ones(size, dtype=bool)
    new[1:] = np.any([number[c][1:] != number[c][:-1] for c in PAIR], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], size)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within pairs of blocks: class, links (rows linked with it) and root (a class it reaches here).

    Rows come sorted by PAIR; the last pair of a batch may go on in the next and waits for it.
    """
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        if not len(rows):
            continue
        last = int(_ranges({c: rows[c].to_numpy() for c in PAIR})[0][-1])
        yield from _told(rows.slice(0, last))
        rest = rows.slice(last)
    if rest is not None:
        yield from _told(rest)


def _told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    found = list(_compared(rows)) if len(rows) else []
    if found:
        columns = [pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "links", "root"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    element = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("string"),
        F.col("embedding").cast(f"array<{element}>"),
    ).withColumn("embedding", F.expr(f"if({_usable()}, embedding, null)"))
    # equal vectors: compared by their components, named by a hash of label, vector and smallest id
    distinct = (
        rows.where("embedding is not null")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("class", F.xxhash64("label", "embedding"))
        .select("id", "class", "label", "dim", "n", "embedding")
    )
    classes = stored(_classes(distinct, element), "vectors")
    members = classes.select(
        "class", "label", "dim", F.posexplode("buckets").alias("table", "bucket")
    )
    where = ["table", "label", "dim", "bucket"]
    crowded = members.groupBy(*where).agg(F.count("*").alias("members")).where("members > 1")
    blocks = members.join(crowded, where).selectExpr(
        "class", *[f"`{c}`" for c in where],
        f"cast(ceil(members / {BLOCK}) as int) as blocks",
        f"cast(pmod(class, cast(ceil(members / {BLOCK}) as int)) as int) as own",
    )
    # each block meets itself and every other one of its bucket once
    met = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr(
        "class", *[f"`{c}`" for c in where],
        "least(own, other) as low", "greatest(own, other) as high",
        "if(own = other, 0, if(own < other, 0, 1)) as side",
    )
    filled = met.join(classes.select("class", "n", "embedding", "buckets"), "class").withColumn(
        "pair", F.xxhash64(*where, "low", "high")
    )
    sorted_ = filled.select(*PAIR, "side", "class", "n", "embedding", "buckets").repartition(*PAIR).sortWithinPartitions(*PAIR)
    found = stored(sorted_.mapInArrow(compare, "class long, links long, root long"), "links")
    edges = found.where("class <> root").selectExpr("class as a", "root as b")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    label = components(edges).withColumnRenamed("id", "class")
    named = (
        classes.select("class", "id", "n", "label", "embedding")
        .join(links, "class", "left")
        .join(label, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    lowest = named.groupBy("component").agg(F.min("id").alias("lowest"))
    of_class = named.join(lowest, "component").select(
        "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "lowest"
    )
    keyed = rows.select("vec_id", F.expr("if(embedding is null, null, xxhash64(label, embedding))").alias("class"))
    return keyed.join(of_class, "class", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("lowest")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
