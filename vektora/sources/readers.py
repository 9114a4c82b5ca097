"""Scans: JSONL records, TSV judgements, chunks of vectors, results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.functions.text import composed, composed_trimmed, truncated
from vektora.session import _fs

SPLITS = ("test", "dev", "train")
RECORD = "_id string, title string, text string"


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it doesn't exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def jsonl_records(spark: SparkSession, path: str, trimmed: bool = False) -> DataFrame:
    """(id, title, text, content) of every line that isn't blank; ids become strings."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", RECORD).alias("r")).select("r.*")
    body = (composed_trimmed if trimmed else composed)(F.col("title"), F.col("text"))
    return rows.select(F.col("_id").alias("id"), "title", "text", body.alias("content"))


def jsonl_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, text), null texts empty."""
    return jsonl_records(spark, path).select("id", F.coalesce("text", F.lit("")).alias("text"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a file, blank ones included."""
    return spark.read.text(path).count()


def judgements_file(spark: SparkSession, folder: str) -> str:
    """The first of test.tsv, dev.tsv and train.tsv that exists."""
    there = set(listing(spark, folder))
    for s in SPLITS:
        if f"{s}.tsv" in there:
            return f"{folder}/{s}.tsv"
    raise FileNotFoundError(f"no judgements in {folder}")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Positive (query_id, corpus_id, score) of a TSV file with a header; of repeated pairs the last line counts."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    rows = raw.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), "score", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).alias("o"))
    return rows.filter("score > 0").groupBy("query_id", "corpus_id").agg(F.max_by("score", "o").alias("score"))


CHUNK = re.compile(r"^(chunk_\d+)(?:\.(.+))?\.npy$")


def discover_chunks(spark: SparkSession, folder: str, tag: str = "") -> list[str]:
    """Chunk files of a tag in order; the empty tag means untagged chunks only."""
    return [f"{folder}/{n}" for n in listing(spark, folder) if (m := CHUNK.match(n)) and (m.group(2) or "") == tag]


def discover_datasets(spark: SparkSession, root: str) -> list[str]:
    """Folders with corpus.jsonl and queries.jsonl, directly or one level further down."""
    out = []
    for name in listing(spark, root):
        for at in (f"{root}/{name}", f"{root}/{name}/{name}"):
            if {"corpus.jsonl", "queries.jsonl"} <= set(listing(spark, at)):
                out.append(at)
                break
    return out


def common_subsets(spark: SparkSession, data: str, vectors: str, wanted: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Subsets in both roots with at least one chunk, and those wanted but missing."""
    there = [n for n in listing(spark, vectors) if n in set(listing(spark, data)) and any(CHUNK.match(x) for x in listing(spark, f"{vectors}/{n}/corpus"))]
    return ([n for n in there if n in wanted], [n for n in wanted if n not in there]) if wanted else (there, [])


def npy_shape(head: bytes) -> tuple[int, ...]:
    """The shape that the header of a .npy file states."""
    import ast

    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = head[6] > 1
    size = int.from_bytes(head[8 : 12 if wide else 10], "little")
    start = 12 if wide else 10
    return tuple(ast.literal_eval(head[start : start + size].decode("latin1").strip())["shape"])


def npy_rows(spark: SparkSession, path: str) -> int:
    """The number of vectors in a .npy file, from its header alone."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        head = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(4096, fs.getFileStatus(p).getLen()))
    finally:
        stream.close()
    return npy_shape(bytes(head))[0]


def legacy_sizes(spark: SparkSession, folder: str, tag: str = "") -> list[tuple[str, int]]:
    """(path, rows) of the chunk files of a tag in order, from their headers alone."""
    return [(path, npy_rows(spark, path)) for path in discover_chunks(spark, folder, tag)]


def super_batches(sizes: list[tuple[str, int]], rows: int) -> list[list[str]]:
    """Consecutive chunks put together until they have `rows` rows at least; the last may have fewer."""
    out: list[list[str]] = []
    held, n = [], 0
    for path, size in sizes:
        held.append(path)
        n += size
        if n >= rows:
            out.append(held)
            held, n = [], 0
    return [*out, held] if held else out


def broken_pairs(spark: SparkSession, folder: str, tag: str = "", repair: bool = False) -> list[str]:
    """Chunk files without ids, with another number of ids, or unreadable; with `repair` they and their ids are deleted.

    What is left are whole chunks, behind which an interrupted run goes on."""
    bad = []
    for path in discover_chunks(spark, folder, tag):
        ids = path[: -len(".npy")] + ".ids.txt"
        fs, p = _fs(spark, ids)
        try:
            if not fs.exists(p) or npy_rows(spark, path) != count_lines(spark, ids):
                bad.append(path)
        except ValueError:
            bad.append(path)
    if repair:
        for path in bad:
            for x in (path, path[: -len(".npy")] + ".ids.txt"):
                fs, p = _fs(spark, x)
                fs.delete(p, False)
    return bad


def capped(chunks: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of a table of chunks (chunk, pos, ...) in their order; 0 takes all.

    Only as many rows as are asked for are put in order."""
    if not most:
        return chunks
    return chunks.orderBy("chunk", "pos").limit(most)


def in_order(embedded: DataFrame, items: DataFrame, ident: str, seq: str) -> DataFrame:
    """(seq, id, v) of embedded items by their sequence number, whichever task was done first."""
    order = items.select(F.col(ident).cast("string").alias("id"), F.col(seq).alias("seq"))
    return embedded.join(order, "id").select("seq", "id", "v").orderBy("seq")


def legacy_chunks(spark: SparkSession, folder: str, tag: str = "", files: list[str] | None = None) -> DataFrame:
    """(chunk, pos, id, v) from .npy files with their .ids.txt: row and line of the same number belong together.

    A chunk whose numbers of rows and lines differ raises ValueError. One task reads one file. `files`
    takes these instead of all chunks of the tag."""
    files = discover_chunks(spark, folder, tag) if files is None else list(files)
    if not files:
        return spark.createDataFrame([], "chunk string, pos int, id string, v array<float>")
    names = [f.rsplit("/", 1)[1][: -len(".npy")] for f in files]
    glob = ",".join(files)
    arrays = spark.read.format("binaryFile").load(glob.split(",")).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("chunk"), "content")
    ids = spark.read.format("binaryFile").load([f[: -len(".npy")] + ".ids.txt" for f in files]).select(F.regexp_extract("path", r"([^/]+)\.ids\.txt$", 1).alias("chunk"), F.col("content").alias("ids"))

    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for t in batches:
            for name, a, b in zip(t.column("chunk").to_pylist(), t.column("content").to_pylist(), t.column("ids").to_pylist(), strict=True):
                m = np.load(io.BytesIO(a)).astype(np.float32)
                lines = b.decode().splitlines()
                if len(m) != len(lines):
                    raise ValueError(f"{name}: {len(m)} vectors but {len(lines)} ids")
                for i in range(0, len(m), 4096):
                    x = m[i : i + 4096]
                    n = len(x)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(lines[i : i + n]), v], names=["chunk", "pos", "id", "v"])

    joined = arrays.join(ids, "chunk", "left").withColumn("ids", F.coalesce("ids", F.lit(b"")))
    return joined.repartition(len(names), "chunk").mapInArrow(rows, "chunk string, pos int, id string, v array<float>")


def chunk_table(vectors: DataFrame, names: DataFrame, split: str | None = None, tag: str | None = None) -> DataFrame:
    """(dataset, chunk, pos, id, v) of chunk tables: vectors and ids meet by dataset, split, chunk and position.

    tag "" takes chunks without a tag, another tag those that carry it, None all."""
    on = ["dataset", "split", "chunk", "pos"]
    v = vectors.select(*on, F.col("vecs").alias("v"))
    n = names.select(*on, F.col("ids").alias("id")).distinct()
    if split is not None:
        v, n = v.filter(F.col("split") == split), n.filter(F.col("split") == split)
    if tag is not None:
        own = F.coalesce(F.nullif(F.regexp_extract("chunk", r"^[^.]+\.(.+)$", 1), F.lit("")), F.lit(""))
        v, n = v.filter(own == tag), n.filter(own == tag)
    return v.join(n, on).select("dataset", "split", "chunk", "pos", "id", "v")


def metric_columns(results: DataFrame) -> list[str]:
    """The columns of metrics (ndcg<k>, recall<k>) that hold numbers, ndcg first, each by k as a number.

    A column counts if the first row has a number there, so text columns that were never parsed do, too."""
    named = [c for c in results.columns if re.fullmatch(r"(ndcg|recall)\d+", c)]
    first = results.select(*(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in named)).first() if named else None
    numeric = [c for c in named if first is not None and first[c] is not None]
    return sorted(numeric, key=lambda c: (c.startswith("recall"), int(re.sub(r"\D", "", c))))


def results(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Result files of several subsets, with the subset's name."""
    out = None
    for subset, path in paths.items():
        df = spark.read.csv(path, header=True, schema=schema).withColumn("subset", F.lit(subset))
        out = df if out is None else out.unionByName(df)
    return out


Embedder = Callable[[list[str]], "object"]


def embed(items: DataFrame, ident: str, text: str, make: Callable[[], Embedder], dim: int, batch: int = 256, already: DataFrame | None = None, halve: bool = True) -> DataFrame:
    """(id, v) from an embedder that is made once per task; vectors come back at length 1.

    Ids of `already` (id) are skipped, so a run can be taken up again. With `halve`, a batch that fails is
    halved until single texts fail, whose error is raised. Rows keep the order of their partition."""
    rows = items.select(F.col(ident).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if already is not None:
        rows = rows.join(already.select("id"), "id", "left_anti")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = make()

        def vectors(texts):
            try:
                return np.asarray(model(texts), dtype=np.float64)
            except Exception:
                if len(texts) == 1 or not halve:
                    raise
                h = len(texts) // 2
                return np.vstack([vectors(texts[:h]), vectors(texts[h:])])

        for t in batches:
            for i in range(0, t.num_rows, batch):
                part = t.slice(i, batch)
                m = vectors(part.column("text").to_pylist())
                m = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), v], names=["id", "v"])

    return rows.mapInArrow(run, "id string, v array<float>")


def hashing_embedder(dim: int = 64) -> Callable[[], Embedder]:
    """A deterministic stand-in for a model: signed hashes of the words."""

    def make():
        import hashlib

        import numpy as np

        def run(texts):
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in (t.lower().split() or [""]):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out

        return run

    return make
