"""Encoding of texts with a public tokenizer, and decoding.

The tokenizers library runs over Arrow batches; the vocabulary file is read once on the driver and
broadcast (a few MB, the size of the file). Null and empty texts have no ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many characters (or one text) are encoded in one call, which bounds the memory of a task.
CALL_CHARS = 500_000
#: Words whose ids a task remembers, and the largest vocabulary file that is broadcast, in characters.
WORDS_KEPT, MODEL_CHARS = 100_000, 64 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The vocabulary's place: `folder`, else the installed package of public tokenizers, else /opt/tokenizers."""
    if folder is None:
        try:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.__file__)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else n))
        n += b not in shown
    return out


def load(model: str):
    """The tokenizer of a vocabulary file's text, for which the strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model)
    t.encode_special_tokens = True
    if hasattr(t.model, "_resize_cache"):
        t.model._resize_cache(WORDS_KEPT)
    return t


def vocabulary(spark: SparkSession, path: str | None):
    """The broadcast text of a vocabulary file, whose size is checked."""
    path = path or tokenizer_path()
    if os.path.getsize(path) > MODEL_CHARS:
        raise ValueError(f"{path} is too large to be a vocabulary")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def calls(texts: list[str | None], most: int = CALL_CHARS) -> Iterator[list[str]]:
    """Runs of texts of together at most `most` characters; null counts as empty."""
    run, size = [], 0
    for x in texts:
        x = x or ""
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def _mapped(records: DataFrame, key: str, text: str, path: str | None, schema: str, columns) -> DataFrame:
    """mapInArrow over (key, text); `columns` turns the encodings of a call into Arrow arrays."""
    model = vocabulary(records.sparkSession, path)
    rows = records.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        import pyarrow as pa

        t = load(model.value)
        for batch in batches:
            at = 0
            for texts in calls(batch.column("text").to_pylist()):
                arrays, names = columns(t, texts)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(texts)), *arrays], names=["key", *names])
                at += len(texts)

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {schema}").withColumnRenamed("key", key)


def _ids(encodings):
    import numpy as np
    import pyarrow as pa

    lists = [e.ids for e in encodings]
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))))


def encode(records: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row, repeated and null keys included; other columns are not used."""
    return _mapped(records, key, text, path, "ids array<int>", lambda t, texts: ([_ids(t.encode_batch_fast(texts, add_special_tokens=False))], ["ids"]))


def count_tokens(records: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row."""

    def columns(t, texts):
        import pyarrow as pa

        return [pa.array([len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)], pa.int64())], ["n_tokens"]

    return _mapped(records, key, text, path, "n_tokens bigint", columns)


def truncate(records: DataFrame, key: str, text: str, most: int, path: str | None = None) -> DataFrame:
    """(key, text, n_tokens): each text up to the end of its `most`-th id, and the ids left; null texts come out empty.

    Texts that fit are unchanged. A character that the cut would split is left out, so that the cut text
    never holds a damaged character; n_tokens counts the ids of whole characters only."""

    def columns(t, texts):
        import pyarrow as pa

        cut, left = [], []
        for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            n = len(e.ids)
            if n > most:
                n, spans = most, e.offsets
                while n and spans[n][0] < spans[n - 1][1]:  # the next id shares its character
                    n -= 1
                text = text[: spans[n - 1][1]] if n else ""
            cut.append(text)
            left.append(n)
        return [pa.array(cut, pa.string()), pa.array(left, pa.int32())], ["text", "n_tokens"]

    return _mapped(records, key, text, path, "text string, n_tokens int", columns)


def encode_with_offsets(records: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids, starts, ends): the code points, counted from 0, that each id covers. Ids that share a split character all name it."""

    def columns(t, texts):
        import pyarrow as pa

        es = t.encode_batch(texts, add_special_tokens=False)
        lists = [[o[i] for o in e.offsets] for i in (0, 1) for e in es]
        kind = pa.list_(pa.int32())
        return [_ids(es), pa.array(lists[: len(es)], kind), pa.array(lists[len(es) :], kind)], ["ids", "starts", "ends"]

    return _mapped(records, key, text, path, "ids array<int>, starts array<int>, ends array<int>", columns)


def decoder(model: str):
    """A function from ids to text: the characters of the vocabulary go back to bytes, the bytes to UTF-8.

    Bytes of a character that the ids cut off become U+FFFD; ids outside the vocabulary raise KeyError."""
    import json

    d = json.loads(model)
    byte = {c: b for b, c in enumerate(byte_characters())}
    special = {x["id"]: x["content"].encode() for x in d["added_tokens"]}
    piece = {i: bytes(byte[c] for c in s) for s, i in d["model"]["vocab"].items() if i not in special} | special
    return lambda ids: b"".join(piece[i] for i in ids).decode("utf-8", "replace")


def decode(encoded: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of every row; null ids give null, no ids the empty text."""
    model = vocabulary(encoded.sparkSession, path)
    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))

    def run(batches):
        import pyarrow as pa

        text = decoder(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([None if x is None else text(x) for x in b.column("ids").to_pylist()], pa.string())], names=["key", "text"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
