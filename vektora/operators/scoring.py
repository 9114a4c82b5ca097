"""Exact top-k by dot product: a stated set of queries against all documents, in blocks.

The Arrow path multiplies a block of queries with batches of documents and keeps, over all batches of
a task, the k best of every scheme and query, so that no more than tasks x schemes x queries x k rows
leave it; a window takes the k best of all. `topk_schemes` also encodes and decodes the documents in
the same kernel. The Column path says the same in SQL terms and serves as its check. Order: score
rounded to 9 decimals descending, then document id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vektora.functions import kernels
from vektora.functions.vectors import dot, doubles
from vektora.operators.calibration import Calibration
from vektora.operators.schemes import Scheme, decoding
from vektora.session import materialize

#: So many queries at most are broadcast at a time, and so many bytes of them.
BLOCK, BLOCK_BYTES = 4096, 64 << 20
#: Best rows that one task holds: 16 bytes each.
HELD = 4_000_000
ROWS = "scheme string, query_id bigint, doc_id bigint, score double"


def ranked(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, ids, matrix) of queries (key, id, v), at most `most` of them and BLOCK_BYTES of vectors at a time.

    Few queries are one block. Many are written once, dealt out to blocks by a hash, and read block by
    block; the blocks behave alike in any number."""
    total = queries.count()
    parts = max(1, math.ceil(total * 1.25 / most)) if total > most else 1
    stored = materialize(queries.withColumn("block", F.pmod(F.xxhash64("key", "id"), F.lit(parts)).cast("int")).repartition("block"), "queries") if parts > 1 else None
    for p in range(parts):
        rows = (stored.df.filter(F.col("block") == p).drop("block") if stored else queries).toArrow()
        keys, ids = np.array(rows["key"].to_pylist(), dtype=object), rows["id"].to_numpy()
        m = kernels.matrix(rows["v"])
        step = max(1, min(most, BLOCK_BYTES // max(8, 8 * m.shape[1])))
        for i in range(0, len(ids), step):
            yield keys[i : i + step], ids[i : i + step], m[i : i + step]
    if stored:
        stored.drop()


class Best:
    """The k best documents of some queries, while scores are offered: higher rounded score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.waiting = k, np.full(queries, -np.inf), 0
        self.held, self.fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        """score: queries x documents."""
        near = np.round(score, 9)
        low = self.floor
        if near.shape[1] > self.k:
            low = np.maximum(low, np.partition(near, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero(near >= low[:, None])
        self.fresh.append((q, doc[d], score[q, d]))
        self.waiting += len(q)
        if self.waiting > len(self.held[0]) + self.k * len(self.floor):
            self.settle()

    def settle(self) -> None:
        q, d, s = (np.concatenate(x) for x in zip(self.held, *self.fresh, strict=True))
        near = np.round(s, 9)
        order = np.lexsort((d, -near, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        keep = order[place < self.k]
        self.held, self.fresh, self.waiting = (q[keep], d[keep], s[keep]), [], 0
        full = place == self.k - 1
        self.floor[q[order[full]]] = near[order[full]]


def _leave(best: dict[str, Best], ids: dict[str, np.ndarray]):
    """One record batch per scheme with its best rows."""
    import pyarrow as pa

    for name, b in best.items():
        b.settle()
        q, d, s = b.held
        scheme = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(q), np.int32)), pa.array([name], pa.string())).dictionary_decode()
        yield pa.RecordBatch.from_arrays([scheme, pa.array(ids[name][q].astype(np.int64)), pa.array(d.astype(np.int64)), pa.array(s)], names=["scheme", "query_id", "doc_id", "score"])


def _union(parts: list[DataFrame], spark) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], ROWS)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topk_columns(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(scheme, query_id, doc_id, score, rank) of docs (scheme, id, v) for queries (id, v): for small sets, as a check."""
    spark, parts = docs.sparkSession, []
    each = queries.filter("v is not null").select(F.lit("").alias("key"), F.col("id").cast("bigint").alias("id"), doubles(F.col("v")).alias("v"))
    for _, ids, m in query_blocks(each, BLOCK):
        q = spark.createDataFrame(list(zip(ids.tolist(), m.tolist(), strict=True)), "query_id bigint, qv array<double>")
        parts.append(docs.filter("v is not null").crossJoin(F.broadcast(q)).select("scheme", "query_id", F.col("id").cast("bigint").alias("doc_id"), dot(doubles(F.col("v")), F.col("qv")).alias("score")))
    return ranked(_union(parts, spark), k, ["scheme", "query_id"])


def topk(docs: DataFrame, queries: DataFrame, k: int, query_key: str | None = None) -> DataFrame:
    """(scheme, query_id, doc_id, score, rank), ids bigint, of docs (scheme, id, v). Fewer than k documents give fewer rows.

    With query_key, queries (key, id, v) differ by scheme: a query is only met by documents of its key,
    as when queries are encoded, too. Null vectors are left out."""
    spark, parts = docs.sparkSession, []
    cols = ([F.col(query_key).alias("key")] if query_key else [F.lit("").alias("key")]) + [F.col("id").cast("bigint").alias("id"), doubles(F.col("v")).alias("v")]
    d = docs.filter("v is not null").select("scheme", F.col("id").cast("bigint").alias("id"), doubles(F.col("v")).alias("v"))
    for block in query_blocks(queries.filter("v is not null").select(*cols), max(1, min(BLOCK, HELD // (8 * k)))):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES

        def run(batches, sent=sent):
            keys, ids, m = sent.value
            best, own, who = {}, {}, {}
            for t in batches:
                if not t.num_rows:
                    continue
                names = t.column("scheme").dictionary_encode()
                code, doc, v = names.indices.to_numpy(zero_copy_only=False), t.column("id").to_numpy(), kernels.matrix(t.column("v"))
                for i, s in enumerate(names.dictionary.to_pylist()):
                    if s not in best:
                        who[s] = np.flatnonzero((keys == s) | (keys == ""))
                        best[s], own[s] = Best(len(who[s]), k), ids[who[s]]
                    at = np.flatnonzero(code == i)
                    best[s].offer(m[who[s]] @ v[at].T, doc[at])
            yield from _leave(best, own)

        parts.append(d.mapInArrow(run, ROWS))
    return ranked(_union(parts, spark), k, ["scheme", "query_id"])


def topk_schemes(vectors: DataFrame, ident: str, v: str, dim: int, schemes: Sequence[Scheme], stats: Calibration | None, queries: DataFrame, k: int) -> DataFrame:
    """`topk` of every scheme's decoded vectors, from one scan of `vectors`: decoded in the kernel that scores them."""
    spark, parts = vectors.sparkSession, []
    decode, names = decoding(schemes, dim, stats), [s.name for s in schemes]
    d = vectors.filter(F.col(v).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), doubles(F.col(v)).alias("v"))
    q = queries.filter("v is not null").select(F.lit("").alias("key"), F.col("id").cast("bigint").alias("id"), doubles(F.col("v")).alias("v"))
    for block in query_blocks(q, max(1, min(BLOCK, HELD // (k * len(names))))):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES

        def run(batches, sent=sent):
            _, ids, m = sent.value
            best = {s: Best(len(ids), k) for s in names}
            for t in batches:
                for at in range(0, t.num_rows, 2048):
                    part = t.slice(at, 2048)
                    doc = part.column("id").to_numpy()
                    for s, x in decode(kernels.matrix(part.column("v"))):
                        best[s].offer(m @ x.T, doc)
            yield from _leave({s: b for s, b in best.items() if b.fresh or len(b.held[0])}, dict.fromkeys(names, ids))

        parts.append(d.mapInArrow(run, ROWS))
    return ranked(_union(parts, spark), k, ["scheme", "query_id"])


def truth_ranks(docs: DataFrame, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """(scheme, query_id, doc_id, rank) of the true documents (query_id, doc_id) among all documents, ids bigint.

    The rank is 1 + the number of documents before the true one in the order of topk. Null vectors are
    left out; a true document that isn't among the documents has no row."""
    spark, out = docs.sparkSession, None
    d = docs.filter("v is not null").select("scheme", F.col("id").cast("bigint").alias("id"), doubles(F.col("v")).alias("v"))
    t = truth.select(F.col("query_id").cast("bigint").alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"))
    q = queries.filter("v is not null").select(F.col("id").cast("bigint").alias("id"), doubles(F.col("v")).alias("v")).join(t, "id").select(F.col("doc_id").alias("key"), "id", "v")
    for right, ids, m in query_blocks(q, BLOCK):
        part = spark.createDataFrame(list(zip(ids.tolist(), right.tolist(), m.tolist(), strict=True)), "query_id bigint, doc_id bigint, qv array<double>")
        own = d.join(F.broadcast(part), F.col("id") == F.col("doc_id")).select("scheme", "query_id", "doc_id", "qv", dot(F.col("v"), F.col("qv")).alias("score"))
        rows = own.toArrow()  # at most BLOCK rows a scheme
        schemes, ids, right = np.array(rows["scheme"].to_pylist(), dtype=object), rows["query_id"].to_numpy(), rows["doc_id"].to_numpy()
        sent = spark.sparkContext.broadcast((schemes, ids, right, kernels.matrix(rows["qv"]), np.round(rows["score"].to_numpy(), 9)))

        def run(batches, sent=sent):
            import pyarrow as pa

            schemes, ids, right, m, score = sent.value
            count: dict = {}
            for t in (t.slice(i, 1024) for t in batches for i in range(0, t.num_rows, 1024)):
                if not len(ids):
                    continue
                names = t.column("scheme").dictionary_encode()
                code, doc, v = names.indices.to_numpy(zero_copy_only=False), t.column("id").to_numpy(), kernels.matrix(t.column("v"))
                for i, s in enumerate(names.dictionary.to_pylist()):
                    at, who = np.flatnonzero(code == i), np.flatnonzero(schemes == s)
                    got, limit, true = np.round(m[who] @ v[at].T, 9), score[who, None], right[who, None]
                    before = ((got > limit) & (doc[at] != true)) | ((got == limit) & (doc[at] < true))
                    count[s] = count.get(s, 0) + before.sum(axis=1)
            for s, before in count.items():
                who = np.flatnonzero(schemes == s)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(who), pa.string()), pa.array(ids[who]), pa.array(right[who]), pa.array(before)], names=["scheme", "query_id", "doc_id", "before"])

        each = d.mapInArrow(run, "scheme string, query_id bigint, doc_id bigint, before bigint")
        out = each if out is None else out.unionByName(each)
    if out is None:
        out = spark.createDataFrame([], "scheme string, query_id bigint, doc_id bigint, before bigint")
    return out.groupBy("scheme", "query_id", "doc_id").agg((F.sum("before") + 1).alias("rank"))


def merged(state: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """The running top-k after `more` top-k rows: repeated (scheme, query, document) count once."""
    cols = ["scheme", "query_id", "doc_id", "score"]
    return ranked(state.select(*cols).unionByName(more.select(*cols)).dropDuplicates(cols[:3]), k, cols[:2])
