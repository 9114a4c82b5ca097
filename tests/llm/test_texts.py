"""Chunking, sampling, encoding, mixing and quality rules."""

import json
from pathlib import Path

import numpy as np
import oracle
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vektora.llm import chunking, encoding, mixing, p4_chunks, p6_sample, p7_encoding, p8_mixture, p9_quality
from vektora.llm import quality_training as qt
from vektora.llm import rule_learning, text_quality
from vektora.llm.stable_sample import Register

PIECE = st.sampled_from(["word ", "a", "\n", "\n\n", "# head\n", "End. ", "。", "x" * 40, "\t", "é😀"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=120).map("".join), st.integers(2, 60), st.data())
def test_pieces(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    got = chunking.pieces(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in got)
    assert chunking.rejoin([(a, text[a:b]) for a, b, _ in got]) == text
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert c == b - min(overlap, b - a) and d > b
        assert text[c:d].startswith(text[b - (b - c) : b])


def test_natural_boundaries():
    text = "\n\n".join(("Some words make a sentence. " * 10).strip() for _ in range(8))
    got = chunking.pieces(text, 700, 50)
    assert {cut for _, _, cut in got[:-1]} == {"paragraph"}
    assert {cut for _, _, cut in chunking.pieces("x" * 5000, 700, 50)[:-1]} == {"character"}
    line = text.replace("\n\n", " ")
    assert all(line[b - 2 : b] == ". " for _, b, _ in chunking.pieces(line, 700, 50)[:-1])
    assert chunking.first_unbroken("ab " + "x" * 30 + " y", 20) == 4 and chunking.first_unbroken("ab cd", 20) == 0


def test_split_oversized(spark):
    rows = [(1, "word " * 900, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, "y" * 4100, "x"), (1, "word " * 900, "x")]
    df = spark.createDataFrame(rows, "id int, text string, seq string")
    got = chunking.split_oversized(df, "id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {1, None} and {r.unbroken_from for r in by[None]} == {1}
    assert chunking.rejoin([(r.start, r.piece) for r in by[None]]) == "y" * 4100
    assert chunking.split_oversized(df.limit(0), "id", "text").count() == 0


def test_register(spark, tmp_path):
    ids = spark.createDataFrame([("c", f"i{i}") for i in range(3000)] + [("c", None), (None, "x"), ("q", "i1")], "kind string, id string")
    whole = Register(spark, f"{tmp_path}/a")
    whole.insert(ids, 0)
    parts = Register(spark, f"{tmp_path}/b")
    parts.insert(ids.filter("id < 'i2'").union(ids.filter("id < 'i2'")).repartition(7), 0)
    small = {tuple(r) for r in parts.select(0.1).collect()}
    parts.insert(ids, 1)
    parts.insert(ids, 1)  # a batch tried again
    full = [tuple(r) for r in parts.select(0.1).collect()]
    assert len(full) == len(set(full)) and small <= set(full) == {tuple(r) for r in whole.select(0.1).collect()}
    assert 230 < len(full) < 370 and parts.numbers().count() == 3001
    assert set(full) <= {tuple(r) for r in parts.select(0.2).collect()}
    with pytest.raises(ValueError):
        parts.select(0.1)


TEXTS = ["", None, "plain", "héllo <|endoftext|> 😀 é", "日本語のテキスト", "a‍b\u0000c\r\n\t", "x" * 70_000, "퟿\U0010ffff"]


def test_encoding(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "z", 0)], "doc int, body string, ids int")
    got = {r.doc: r.ids for r in encoding.encode(df, "doc", "body").collect()}
    t = Tokenizer.from_file(encoding.tokenizer_path())
    t.encode_special_tokens = True
    assert got == {**{i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}, None: t.encode("z").ids}
    back = {r.doc: r.text for r in encoding.decode(encoding.encode(df, "doc", "body"), "doc").collect()}
    assert back == {**{i: x or "" for i, x in enumerate(TEXTS)}, None: "z"}
    assert {r.doc: r.n_tokens for r in encoding.count_tokens(df, "doc", "body").collect()} == {k: len(v) for k, v in got.items()}
    for r in encoding.encode_with_offsets(df.filter("doc is not null"), "doc", "body").collect():
        text = TEXTS[r.doc] or ""
        assert r.ids == got[r.doc] and all(0 <= a <= b <= len(text) for a, b in zip(r.starts, r.ends))
    one = encoding.decoder(open(encoding.tokenizer_path(), encoding="utf-8").read())
    cut = t.encode("😀", add_special_tokens=False).ids[:1]
    assert "�" in one(cut) and one([50256]) == "<|endoftext|>"
    assert encoding.encode(df.limit(0), "doc", "body").count() == 0
    assert len(set(encoding.byte_characters())) == 256


@pytest.mark.parametrize("most", [0, 1, 3, 7, 1000])
def test_truncation(spark, most):
    texts = ["plain words and more of them", "é😀日本語 mixed 😀😀", "", None, "x" * 50, "😀" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in encoding.truncate(df, "id", "text", most).collect()}
    t = encoding.load(open(encoding.tokenizer_path(), encoding="utf-8").read())
    for i, x in enumerate(texts):
        ids, r = t.encode(x or "", add_special_tokens=False).ids, got[i]
        assert (x or "").startswith(r.text) and r.n_tokens <= most
        assert len(t.encode(r.text, add_special_tokens=False).ids) <= max(most, 0) and (len(ids) > most or r.text == (x or ""))
        # the next character would take more ids than are left
        rest = (x or "")[len(r.text) :]
        assert not rest or len(encoding.decoder(open(encoding.tokenizer_path(), encoding="utf-8").read())(ids[:most]).rstrip("\ufffd")) == len(r.text)


def test_calls():
    assert list(encoding.calls(["aa", None, "b" * 9, "c"], 5)) == [["aa", ""], ["b" * 9], ["c"]]


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, s, int(n)) for i, (s, n) in enumerate([("big", x) for x in rng.integers(1, 400, 3000)] + [("small", x) for x in rng.integers(1, 400, 60)])]
    rows += [(9001, "other", 5), (9002, None, 5), (9003, "big", None)]
    docs = spark.createDataFrame(rows, "doc int, source string, n int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = mixing.copies(docs, "doc", "source", "n", targets)
    c = {r.doc: r.copies for r in got.collect()}
    assert set(c) == {r[0] for r in rows if r[1] in ("big", "small")}
    assert all(0 <= x <= 1 for d, x in c.items() if d < 3000) and all(x == 4 for d, x in c.items() if 3000 <= d < 9000)
    s = {r.source: r for r in mixing.shares(got, "source", "n", targets).collect()}
    assert s["big"].actual_share == pytest.approx(2 / 3, abs=0.01) and s["small"].repeats == 4 and s["none"].actual_share == 0
    again = {r.doc: r.copies for r in mixing.copies(docs.repartition(5), "doc", "source", "n", targets).collect()}
    assert again == c
    assert mixing.copies(docs.limit(0), "doc", "source", "n", targets).count() == 0
    assert mixing.plan({"a": 10}, {"a": (0.5, 2), "b": (0.5, 1)}) == {"a": 2 * mixing.UNIT, "b": 0}
    assert mixing.plan({}, {"a": (0.5, 2)}) == {"a": 0}


@pytest.mark.parametrize("run", ["p8_shares", "p8_large_shares"])
def test_mixtures_of_a_test_table(spark, run):
    """Every source that isn't at its cap comes within a hundredth of its part of what is left."""
    s = p8_mixture.QUERIES[run](spark, "/root/testdata/sf0.1").toPandas()
    free = s[~s.capped]
    assert (s.repeats <= s.max_repeats).all() and s.actual_share.sum() == pytest.approx(1)
    part = free.actual_share / free.actual_share.sum() / (free.target_share / free.target_share.sum())
    assert (part - 1).abs().max() < 0.01
    if run == "p8_shares":
        assert (s.actual_share / s.target_share - 1).abs().max() < 0.02
    else:
        assert s.capped.any() and s.mixed_tokens.sum() == pytest.approx(s.tokens.sum(), rel=0.01)


def test_plans():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1)}
    got = mixing.plan({"a": 1000, "b": 50, "c": 1000}, t, 1000)
    assert got["b"] == 2 * mixing.UNIT and got["a"] / got["c"] == pytest.approx(2.5) and got["a"] * 1000 + got["b"] * 50 + got["c"] * 1000 == pytest.approx(1000 * mixing.UNIT)
    assert mixing.plan({"a": 10, "b": 10, "c": 10}, t, 1e9) == {"a": mixing.UNIT, "b": 2 * mixing.UNIT, "c": mixing.UNIT}


QUALITY = [
    ("list", "List of colleagues:\n1) Anna\n2) studying (1920)\n3) Vornu\n4) writing (1864)\n5) Plin Foundation"),
    ("table", "a,b,c\n86.2%,87.11,x\n44.9%,80.36,n/a\n80.2%,19.59,n/a\n89.3%,30.39,yes\n11.2%,3.39,yes"),
    ("junk", "iWAg3PFTak8u1b2yTRMs2jhzyQA0vQ20cXloj53dxQSfrMkLZBgbTfRmnXYw9FeoYvN5Cny+69o6TYlZTeT2mHMK/+bCvsCSagL8HVBgLHVI7ngm"),
    ("junk", "free settlers! " * 20),
    (None, "The committee was never common, said a spokesperson, but the servings believed it. It has since been followed by others."),
    (None, "Es gibt in der Stadt einen Fluss, der seit dem Jahr für die Anleger wichtig ist. Nach der Prüfung waren nur vier davon da."),
    (None, None), (None, ""), (None, " \n\t "), (None, "​"), (None, " "),
]


def test_quality(spark):
    common = {"en": "the a of to was it has by but been in said never".split(), "de": "der die das in seit nach für ist es nur waren".split(), "ja": ["の", "は"]}
    df = spark.createDataFrame([(i, t, None if i % 2 else "en-XX", 1) for i, (_, t) in enumerate(QUALITY)], "id int, text string, lang string, words int")
    got = {r.id: r for r in text_quality.not_prose(text_quality.statistics(df, "id", "text", "lang", common)).collect()}
    assert {i: r.kind for i, r in got.items()} == {i: k for i, (k, _) in enumerate(QUALITY)}
    assert got[6].n_words is None and got[7].n_words == 0 and got[8].symbol_ratio == 0
    assert got[4].n_words == 20 and got[4].ending_share == 1.0 and got[4].common_share > 0.4
    assert text_quality.statistics(df.limit(0), "id", "text", "lang", {}).count() == 0


def test_documents_labelled_by_reading(spark):
    """A hundred documents of sf0.1, drawn so that each verdict of the rules has its part, labelled by reading without the verdicts; both halves apart."""
    read = pd.read_csv(Path(__file__).with_name("documents_read.tsv"), sep="\t")
    found = {r.doc_id: r.kind for r in p9_quality.p9_found(spark, "/root/testdata/sf0.1").filter(F.col("doc_id").isin(read.doc_id.tolist())).collect()}
    right = np.array([found.get(i, "prose") == k for i, k in zip(read.doc_id, read.kind)])
    assert len(read) >= 100 and read.reason.notna().all() and right[::2].mean() >= 0.95 and right[1::2].mean() >= 0.95


def test_rule_learning():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(3000, 3))
    kind = np.where(x[:, 0] > 0.8, "a", np.where((x[:, 1] < 0.3) & (x[:, 2] > 0.5), "b", ""))
    rules = rule_learning.learn(x, kind, ("f", "g", "h"))
    import pandas as pd

    t = pd.DataFrame(x, columns=["f", "g", "h"])
    assert (qt.apply(rules, t) == kind).mean() > 0.98
    assert rule_learning.learn(x, np.full(3000, ""), ("f", "g", "h")) == []


def test_rules_on_other_rows(spark):
    table = qt.labelled(spark, "/root/testdata/sf0.01")
    rules = json.loads(text_quality.RULES.read_text())["rules"]
    assert (qt.apply(rules, table) == table.kind).mean() > 0.99


@pytest.mark.parametrize("part", [p4_chunks, p6_sample, p7_encoding, p9_quality])
def test_queries_with_sql(spark, sf, part):
    for name, sql in part.ORACLES.items():
        assert not oracle.same(part.QUERIES[name](spark, sf), sql, sf)[1]


@pytest.mark.parametrize("part", [p4_chunks, p7_encoding, p8_mixture, p9_quality])
def test_other_queries(spark, sf, part):
    for name, run in part.QUERIES.items():
        if name not in part.ORACLES:
            assert run(spark, sf).count() > 0
