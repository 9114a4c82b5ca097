"""Labelled documents for the quality rules, and their training.

Labels come from inspecting a text's lines and segments one by one, which is far too slow for a
corpus; the rules learn to reach the same verdicts from the cheap statistics.

    python -m vektora.llm.quality_training DIR [HELD_OUT_DIR]

reads DIR/documents.parquet and DIR/common_words.parquet, learns from at most SAMPLE rows and writes
quality_rules.json; the held-out folder is only measured.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter

import numpy as np

from vektora.llm import rule_learning, text_quality

#: At most so many labelled rows are learned from, and at most so many others decide between runs.
SAMPLE, VALIDATION = 20_000, 60_000
#: Tables are told apart first, as their cells may look like anything else.
ORDER = ["table", "junk", "list"]
BLANKS = re.compile("[\\s​﻿‌‍]+")
DAMAGED = set("�¤¶™€âÂÃ")
VOWEL = re.compile("[aeiouyäöüáéíóúàèùâêîôûæøå]")
MARK = re.compile(r"<[^>]*>|&[a-z]+;|\{\{[^}]*|\}\}|\[\[|\]\]|style=\"\"|0px|\|")
BULLET = re.compile(r"^\s*(\[[ x]\]|\[\d+\]|[-+*–•·]|\(?\d+[.)])\s*")


def letters_of(t: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+", t)]


def kana(t: str) -> float:
    return sum("ぁ" <= c <= "ヿ" for c in t) / max(1, len(t))


def common_share(t: str, common: set[str]) -> float:
    w = letters_of(t)
    return sum(x in common for x in w) / max(1, len(w))


def repeats(t: str) -> bool:
    """The same few segments make up nearly everything."""
    parts = [re.sub(r"\W+", " ", x.lower()).strip() for x in re.split(r"(?<=[.!?])\s+|\n+|(?<=[。！？])", t)]
    c = Counter(x for x in parts if x)
    n = sum(c.values())
    return n >= 4 and len(c) <= max(3, 0.12 * n) and sum(v for v in c.values() if v >= 3) / n > 0.7


def is_junk(t: str) -> bool:
    s, words = BLANKS.sub("", t), t.split()
    n = len(s)
    if n < 8:
        return False
    alnum = sum(c.isalnum() for c in s)
    rows = [x for x in t.split("\n") if x.strip()]
    asian = kana(s) > 0.1
    if sum(c in DAMAGED for c in s) / n > 0.08:  # misread bytes
        return True
    if not asian and len(words) > 10 and sum(len(x) == 1 and x.isalpha() for x in words) / len(words) > 0.3:  # s p a c e d
        return True
    if sum(len(x) for x in words if len(x) >= 40 and re.fullmatch(r"[A-Za-z0-9+/=_-]+", x)) / n > 0.5:  # encoded
        return True
    if sum(bool(re.match(r"^[0-9a-f]{6,8}:?\s+([0-9a-f]{2,4} ?)+", x)) for x in rows) / len(rows) > 0.5:  # dumped bytes
        return True
    if len(re.findall(r"[\w%-]+=[0-9a-f]{6,}&?", t)) >= 3 and len(words) <= 6:  # query strings
        return True
    if alnum / n < 0.3 or (alnum / n < 0.4 and not re.search(r"\|\s*\w", t)):  # symbols
        return True
    if not re.search("<t[dr]>", t) and re.search(r"<|&\w+;|\{\{", t) and len(BLANKS.sub("", MARK.sub("", t))) < 0.4 * n:  # remains of markup
        return True
    w = letters_of(t)
    if not asian and len(w) >= 6:  # struck keys
        long = [x for x in w if len(x) > 1]
        dry = sum(not VOWEL.search(x) for x in long) / max(1, len(long))
        chars = "".join(w)
        if dry > 0.45 or (dry > 0.3 and not re.search(r"\d", t[:200])) or (len(chars) >= 30 and sum(c in "iouäöüáéíóúà" for c in chars) / len(chars) < 0.02):
            return True
    return len(re.findall(r"https?://\S+|www\.\S+", t)) >= 3 or repeats(t)


def row_shape(row: str) -> str | None:
    """The delimiter of a table row, or null."""
    if "<td>" in row or "<tr>" in row:
        return "<td>"
    if row.strip().startswith("|"):
        return "|"
    if "\t" in row:
        return "\t"
    if len(re.findall(r"[\w .-]+=[^;=]*(?:;|$)", row)) >= 2:
        return "="
    if re.search(r" {2,}(?=\S)", row.strip()):
        return "  "
    bare = re.sub(r'"[^"]*"', "", row)
    if bare.count(";") >= 2:
        return ";"
    if "," in bare.strip().strip(",") and not re.search(r", \w", bare):
        return ","
    if re.fullmatch(r"[\d., %-]+", row.strip()) and len(row.split()) >= 3:
        return "number"
    return None


def is_table(rows: list[str]) -> bool:
    c = Counter(filter(None, map(row_shape, rows)))
    most = max(c.values(), default=0)
    return most >= 4 and most >= 0.6 * len(rows)


def is_sentence(t: str, common: set[str]) -> bool:
    return len(letters_of(t)) >= 6 and common_share(t, common) >= 0.12


def is_list(rows: list[str], common: set[str]) -> bool:
    if len(rows) >= 5 and kana("".join(rows)) <= 0.1:
        return not any(is_sentence(BULLET.sub("", x), common) or len(x.split()) > 12 for x in rows)
    t = "\n".join(rows)
    if len(rows) > 2 or kana(t) > 0 or common_share(t, common) > 0.1:
        return False
    for sep in (";", "·", "•", "|", ",", " / ", " – "):
        items = [x for x in t.split(sep) if x.strip()]
        if len(items) >= 5 and max(len(x.split()) for x in items) <= 8 and not any(is_sentence(x, common) for x in items):
            return True
    return False


def is_loose(t: str, common: set[str]) -> bool:
    """Words that form no sentence; not the search phrases that name a thing and a year."""
    rows = [x for x in t.split("\n") if x.strip()]
    if len(letters_of(t)) < 10 or len(rows) > 3 or kana(t) > 0 or re.search(r"[.;,·•?]", t):
        return False
    return common_share(t, common) < 0.06 and not all(re.match(r"^[A-Z].*\d{4}$", x) for x in rows)


def label(t: str | None, common: set[str]) -> str:
    """table, junk, list or "" (prose and blank texts); a heading or sentence at the start may be left off."""
    if t is None or not BLANKS.sub("", t):
        return ""
    rows = [x for x in t.split("\n") if x.strip()]
    bodies = [t, *("\n".join(rows[i:]) for i in (1, 2) if len(rows) > i)]
    if m := re.match(r"^[^.!?\n:]{3,300}[.!?:][\"”]?\s+", t):
        bodies.append(t[m.end() :])
    for b in bodies:
        rows = [x for x in b.split("\n") if x.strip()]
        if not rows or len(b) < 0.25 * len(t):
            continue
        if repeats(b) and not any(x in r for r in rows for x in ("|", ";", "\t", "<td")):
            return "junk"
        if is_table(rows) and not re.search(r"[0-9a-f]{8}  ", b) and not re.search(r"&nbsp;|\{\{", b):
            return "table"
        if is_junk(b):
            return "junk"
        if is_list(rows, common):
            return "list"
        if is_loose(b, common):
            return "junk"
    return ""


def labelled(spark, path: str, most: int | None = None):
    """A pandas table of the features and the label of each document with words, the smallest hashes first."""
    from pyspark.sql import functions as F

    common = text_quality.common_sets(spark.read.parquet(f"{path}/common_words.parquet"))
    flat = {w for k, v in common.items() if k != "ja" for w in v}
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("text is not null").orderBy(F.xxhash64("doc_id"))
    docs = (docs.limit(most) if most else docs).select("doc_id", "text", "lang")
    table = text_quality.statistics(docs, "doc_id", "text", "lang", common).toPandas().merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    table["kind"] = [label(t, flat) for t in table.text]
    return table[table.words > 0]


def apply(rules: list[dict], table) -> np.ndarray:
    """What the CASE expression gives, in NumPy."""
    out, free = np.full(len(table), "", object), np.ones(len(table), bool)
    for r in rules:
        m = free.copy()
        for f, op, t in r["if"]:
            m &= (table[f] <= t) if op == "<=" else (table[f] >= t)
        out[m] = r["kind"]
        free &= ~m
    return out


def train(table, order: list[str] = ORDER, runs: int = 40) -> list[dict]:
    """The best of some runs on SAMPLE rows, which split them into growing and pruning sets differently, by VALIDATION rows that none sees."""
    table = table.sample(frac=1.0, random_state=1)
    cut = min(SAMPLE, len(table) * 4 // 5)
    seen, unseen = table[:cut], table[cut : cut + VALIDATION]
    x, kind = seen[list(text_quality.FEATURES)].to_numpy(float), seen.kind.to_numpy(str)
    tried = [rule_learning.learn(x, kind, text_quality.FEATURES, order, seed=i, sample=SAMPLE) for i in range(runs)]
    return max(tried, key=lambda r: ((apply(r, unseen) == unseen.kind).mean(), -len(r)))


def main(path: str, held: str | None = None) -> None:
    from vektora.session import get_session

    spark = get_session()
    table = labelled(spark, path, SAMPLE + VALIDATION)
    rules = train(table)
    lines = ",\n".join("  " + json.dumps(r, ensure_ascii=False) for r in rules)
    text_quality.RULES.write_text(f'{{"rules": [\n{lines}\n]}}\n', encoding="utf-8")
    print("learned from", len(table), "rows:", (apply(rules, table) == table.kind).mean())
    if held:
        other = labelled(spark, held)
        got = apply(rules, other)
        print("held out", len(other), "rows:", (got == other.kind).mean())
        for k in text_quality.KINDS:
            print(k, "precision", round((other.kind[got == k] == k).mean(), 4), "recall", round((got[other.kind == k] == k).mean(), 4))


if __name__ == "__main__":
    main(*sys.argv[1:])
