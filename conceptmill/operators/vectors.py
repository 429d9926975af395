"""Vectors: hashed n-gram embeddings in SQL expressions, cosine search, pooling and feedback."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from conceptmill.checkpoints import checkpointed

DIM = 512
TOKEN = "[\\x{4E00}-\\x{9FFF}]+|[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Words of a-z and 0-9, and the character pairs of each run of CJK characters (a lone one as it is)."""
    runs = F.regexp_extract_all(F.lower(F.trim(text)), F.lit(TOKEN), F.lit(0))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike("^[a-z0-9]") | (F.length(run) == 1), F.array(run)).otherwise(pairs)

    return F.flatten(F.transform(runs, cut))


def bucket(token: Column, dim: int = DIM) -> Column:
    """The first 8 md5 bytes, read little-endian and unsigned, modulo dim."""
    hexed = F.md5(token)
    swapped = F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in range(7, -1, -1)])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % dim).cast("int")


def sign(token: Column) -> Column:
    """+1 if bit 63 of the same number is set, else -1."""
    return F.when(F.substring(F.md5(token), 15, 1) >= "8", 1.0).otherwise(-1.0)


def term_weights(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, idx, weight): signed 1 + ln(tf) summed per bucket, before normalisation."""
    terms = df.select(F.col(key), F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    return terms.groupBy(key, bucket(F.col("token"), dim).alias("idx")).agg(F.sum(sign(F.col("token")) * (1 + F.ln("tf"))).alias("weight"))


def unit_weights(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, idx, value): the cells of the vector of length 1 that some token fills; a sum of zero stays zero."""
    w = term_weights(df, key, text, dim)
    norm = w.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return w.join(norm, F.col(key) == F.col("_key")).select(key, "idx", F.coalesce(F.try_divide("weight", "norm"), F.lit(0.0)).alias("value"))


def embed(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, vector array<float>): dense, of length 1; the zero vector for texts without tokens."""
    sparse = unit_weights(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return df.select(key).join(sparse, key, "left").select(key, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(unit).alias("vector"))


def embed_query(text: str, dim: int = DIM) -> list[float]:
    """One query's vector on the driver, by the same rule."""
    counts: dict[str, int] = {}
    for run in re.findall("[一-鿿]+|[a-z0-9]+", text.strip().lower()):
        parts = [run] if run[0] < "一" or len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        for t in parts:
            counts[t] = counts.get(t, 0) + 1
    out = [0.0] * dim
    for t, n in counts.items():
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")
        out[h % dim] += (1 if h >> 63 else -1) * (1 + math.log(n))
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, inside one row."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def query_column(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def topk(index: DataFrame, query: Column, k: int, vector: str = "vector", ident: str = "id") -> DataFrame:
    """The k most similar entries, of those the positive ones; ties by order. A top-k per task, then one merge."""
    sim = dot(F.col(vector), query).alias("sim")
    return index.select(ident, "ord", sim).orderBy(F.desc("sim"), "ord").limit(k).filter("sim > 0")


#: Queries that are scored together: so many vectors are broadcast at once, in passes until all are done.
QUERY_BLOCK = 4096
#: Similarities that a task holds at once, and blocks that one plan unites.
HELD_CELLS, PLAN_BLOCKS = 1 << 20, 16


def _best(k: int, parts: list[tuple]) -> tuple:
    """Of (query, sim, ord, id) entries the first k of each query: by similarity, then order."""
    query, sim, place, ident = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, -sim, query))
    query, sim, place, ident = query[order], sim[order], place[order], ident[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return tuple(x[rank < k] for x in (query, sim, place, ident))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles; without gaps they are read where they lie, not as Python objects."""
    flat = lists.flatten()
    if lists.null_count or flat.null_count or not len(lists) or len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1:
        return np.array(lists.to_pylist(), float)
    return flat.to_numpy().astype(float, copy=False).reshape(len(lists), -1)


def _block_topk(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per task, the best k entries of each query of one block; similarities are rounded to 12 decimals, so that ties are ties."""
    rows = queries.select("qid", "qvec").collect()
    ids = pa.array([r["qid"] for r in rows], to_arrow_type(queries.schema["qid"].dataType))
    wanted = np.array([r["qvec"] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0))
    shared = index.sparkSession.sparkContext.broadcast((ids, wanted))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, ord long, sim double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))]
        for batch in batches:
            step = max(1, HELD_CELLS // max(1, len(q)))
            for low in range(0, batch.num_rows if len(q) else 0, step):
                part = batch.slice(low, step)
                v = _matrix(part.column(2))
                sims = v @ q.T
                np.round(sims, 12, out=sims)
                least = np.maximum(np.partition(sims, -min(k, len(v)), axis=0)[-min(k, len(v))], np.nextafter(0, 1))
                row, query = np.nonzero(sims >= least)
                place = part.column(1).to_numpy(zero_copy_only=False)
                ident = np.array(part.column(0).to_pylist(), object)
                held = [_best(k, [*held, (query, sims[row, query], place[row], ident[row])])]
        query, sim, place, ident = held[0]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ident.tolist(), id_kind), pa.array(place), pa.array(sim)], names=["qid", "id", "ord", "sim"])

    id_kind = to_arrow_type(index.schema["id"].dataType)
    return index.select("id", F.col("ord").cast("long").alias("ord"), "vector").mapInArrow(run, kinds)


def topk_join(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, sim, rank) for any number of queries (qid, qvec): the k nearest entries of positive similarity.

    Queries are dealt into blocks by a hash; a block is scored in one pass over the index, every task
    keeps k entries a query, and the tasks' entries merge by query. Ties go by order. A repeated qid
    counts once.
    """
    each = queries.dropDuplicates(["qid"])
    blocks = -(-max(each.count(), 1) // QUERY_BLOCK)
    done = None
    for b in range(blocks):
        found = _block_topk(index, each.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k)
        done = found if done is None else done.unionByName(found)
        if b % PLAN_BLOCKS == PLAN_BLOCKS - 1:
            done = checkpointed(done)
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "ord")
    return done.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "id", "sim", "rank")


def max_pool(index: DataFrame, queries: list[Column], k: int) -> DataFrame:
    """Per entry, its largest similarity to any query; top k, positive ones."""
    best = F.greatest(*[dot(F.col("vector"), q) for q in queries]) if len(queries) > 1 else dot(F.col("vector"), queries[0])
    return index.select("id", "ord", best.alias("sim")).orderBy(F.desc("sim"), "ord").limit(k).filter("sim > 0")


def centroid(vectors: DataFrame) -> DataFrame:
    """One row (centroid): the mean of the vectors, of length 1."""
    each = vectors.select(F.posexplode("vector").alias("idx", "x")).groupBy("idx").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("c"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return whole.select(F.transform("c", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))).alias("centroid"))


def feedback(index: DataFrame, queries: list[Column], k: int, weight: float = 0.4, seeds: int = 3, names: DataFrame | None = None) -> DataFrame:
    """Max-pooled hits, boosted by the centroid of the first hits; the first hit stays first, unboosted.

    ``names`` (id, vector) has the vectors that the centroid is made of, those of the entries' names;
    without it the entries' own vectors are.
    """
    first = max_pool(index, queries, k)
    lead = first.orderBy(F.desc("sim"), "ord").limit(seeds)
    mean = centroid((index if names is None else names).join(F.broadcast(lead.select("id")), "id", "left_semi"))
    pooled = max_pool_all(index, queries)
    boosted = pooled.join(F.broadcast(mean)).select("id", "ord", (F.col("sim") + weight * dot(F.col("vector"), F.col("centroid"))).alias("sim"))
    pinned = first.orderBy(F.desc("sim"), "ord").limit(1).withColumn("pin", F.lit(0))
    others = boosted.join(F.broadcast(pinned.select(F.col("id").alias("_pin"))), F.col("id") == F.col("_pin"), "left_anti").withColumn("pin", F.lit(1))
    return pinned.unionByName(others).orderBy("pin", F.desc("sim"), "ord").limit(k).filter("sim > 0").select("id", "ord", "sim", "pin")


def max_pool_all(index: DataFrame, queries: list[Column]) -> DataFrame:
    best = F.greatest(*[dot(F.col("vector"), q) for q in queries]) if len(queries) > 1 else dot(F.col("vector"), queries[0])
    return index.select("id", "ord", "vector", best.alias("sim"))


def node_text(nodes: DataFrame) -> DataFrame:
    """A node's index text: the name three times, aliases, domain and description."""
    return nodes.withColumn("text", F.concat_ws(" ", "name", "name", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "domain", "desc"))


def signature(nodes: DataFrame, edges: DataFrame, mastery: DataFrame, tag: str) -> DataFrame:
    """One row (signature): changes with any node, edge, current mastery or the embedder's tag.

    Rows are hashed and the hashes summed, so nothing is gathered in one task.
    """
    parts = []
    for name, df in (("n", nodes), ("e", edges), ("m", mastery)):
        total = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.lit(name), *[F.to_json(F.struct(*df.columns))]).cast("decimal(38,0)")).alias("s"))
        parts.append(total.select(F.concat_ws(":", F.lit(name), "n", "s").alias("p")))
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.agg(F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("p")), "|"), F.lit(tag)), 256).alias("signature"))
