"""Statistics of texts and rules that tell prose from lists, tables and junk.

All statistics are built-in expressions, computed in one pass without Python. Those that decide are
taken from the body: the text without a heading or sentence at its start, which may introduce
anything. The rules are an ordered list learned by `rule_learning` from labelled documents; its
thresholds are kept in quality_rules.json and applied as one CASE expression.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = Path(__file__).with_name("quality_rules.json")
KINDS = ("junk", "table", "list")
COMMON_WORDS = 20_000
#: Fixed patterns.
SPACE = r"[\s\p{Z}\p{Cf}]+"
INTRODUCTION = r"^\s*[^\n.!?:。！？]{1,400}([.!?:]+[\"'”’»)]*[ \t]*\n?|[.!?]+[\"'”’»)]*\s+|。|\n)\s*"
LINE_END = r"[.!?…。！？:;][\"'”’»)\]]*\s*$"
SENTENCE_END = r"[.!?…][\"'”’»)\]]*(\s|$)|[。！？]"
MARKUP = r"<[^<>]{0,80}>|&[A-Za-z]{2,8};|&#\d+;|\{\{|\}\}|\[\[|\]\]|\b[a-z]+=\"[^\"]{0,40}\"|\b\d+px"
MARKUP_SIGN = r"[<&{\[=]|px"
DAMAGE = "�¤¶™€âÂÃ"
VOWELS = "iouyäöüáéíóúàèùâêîôûøå"
BULLET = r"^\s*([-+*–•·]|\[[ xX]?\]|\[\d+\]|\(?\d{1,3}[.)])\s"
CODED = r"^[A-Za-z0-9+/=_-]{32,}$"
DELIMITER = r"\t|\||;|,(?!\s\w+\s\w+)| {2,}|</td>|="
ITEM_BREAK = r"[;,·•|/](\s|$)"
PHRASE_BREAK = r"[.!?…。！？]+|\n|\s>>\s"


def _len(c: Column) -> Column:
    return F.length(c).cast("double")


def _kept(c: Column, drop: str) -> Column:
    """Number of characters that remain once the runs matched by `drop` are taken out."""
    return _len(F.regexp_replace(c, drop, ""))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


#: What the rules decide by.
FEATURES = (
    "word_length", "symbols", "digits", "endings", "common", "kana", "distinct_words", "distinct_phrases", "single_letters", "open_vowels", "coded", "markup",
    "damage", "line_words", "short_lines", "row_lines", "even_rows", "bullets", "breaks", "sentence_ends", "pairs", "longest_line_words", "phrases", "lines", "words",
)


def common_sets(common_words: DataFrame) -> dict[str, list[str]]:
    """The frequent words of each language, COMMON_WORDS at most over all of them, as they become part of expressions."""
    out: dict[str, list[str]] = {}
    rows = common_words.filter("lang is not null and word is not null").distinct().limit(COMMON_WORDS + 1).collect()
    if len(rows) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    for r in rows:
        out.setdefault(r["lang"], []).append(r["word"])
    return {k: sorted(v) for k, v in sorted(out.items())}


def language(lang: Column, known: list[str]) -> Column:
    """The language's plain spelling if the common words have it, else null."""
    plain = F.lower(F.get(F.split(F.trim(lang), "[-_]"), F.lit(0)))
    return F.when(plain.isin(known), plain)


def statistics(documents: DataFrame, key: str, text: str, lang: str, common: dict[str, list[str]], only: Sequence[str] | None = None) -> DataFrame:
    """(key, n_words, mean_word_length, symbol_ratio, ending_share, common_share, then FEATURES of the body), or the columns `only`.

    common_share counts the words of the document's language where that is usable, else of all
    languages. In texts without spaces between words it is the share of letters in common words. A null
    text has null statistics, an empty or blank one zeros."""
    known = list(common)
    spaced = {k: v for k, v in common.items() if not all("぀" <= w[0] <= "鿿" for w in v)}
    other = sorted({w for k, v in common.items() if k not in spaced for w in v}, key=lambda w: (-len(w), w))
    words_of = sorted({w for v in spaced.values() for w in v}) or [""]
    particles = "|".join(other) or "(?!)"
    d = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("lang")).withColumn("lang", language(F.col("lang"), known))
    # again a generator, so that the beginning is looked for once
    d = d.select("*", F.inline(F.array(F.struct(F.regexp_replace("t", INTRODUCTION, "").alias("rest")))))
    d = d.withColumn("b", F.when(_len(F.trim("rest")) >= F.greatest(F.lit(20.0), _len(F.col("t")) * 0.2), F.col("rest")).otherwise(F.col("t"))).drop("rest")

    def parts(c: str, p: str) -> dict[str, Column]:
        x = F.col(c)
        return {
            f"{p}digit": _kept(x, r"\P{Nd}+"),
            f"{p}tokens": F.filter(F.split(x, SPACE), lambda w: w != ""),
            f"{p}rows": F.filter(F.split(x, r"[\r\n]+"), lambda w: w.rlike(r"[^\s\p{Z}\p{Cf}]")),
            f"{p}kana": _kept(x, r"[^぀-ヿ一-鿿]+"),
        }

    names = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+)"), 1)
    # the body's words are the last ones of the text, as what is left off ends between words
    head = F.expr("left(t, length(t) - length(b))")
    d = d.withColumns(parts("t", "w_") | parts("b", "b_") | {"w_names": names(F.col("t")), "head": F.size(names(head))})
    d = d.withColumns({"b_names": F.expr("slice(w_names, head + 1, size(w_names))")})
    joined = lambda c: _len(F.array_join(c, ""))
    d = d.withColumns({f"{p}chars": joined(f"{p}tokens") for p in ("w_", "b_")} | {f"{p}letters": joined(f"{p}names") for p in ("w_", "b_")})
    n = lambda c: F.size(c).cast("double")
    cnt = lambda c, f: F.size(F.filter(c, f)).cast("double")
    among = lambda v: lambda w: w.isin(v)
    unspaced = lambda p, c: _share(_len(F.array_join(F.regexp_extract_all(F.col(c), F.lit(f"({particles})"), 1), "")), F.col(f"{p}letters"))
    in_lang = F.lit(None).cast("double")
    for k, v in spaced.items():
        in_lang = F.when(F.col("lang") == k, cnt("w_names", among(v))).otherwise(in_lang)
    in_any = cnt("w_names", among(words_of))
    share = F.when(F.col("w_kana") * 3 > F.col("w_letters"), unspaced("w_", "t")).otherwise(_share(F.coalesce(in_lang, in_any), n("w_names")))
    d = d.withColumn("delims", F.transform("b_rows", lambda r: F.regexp_count(F.trim(r), F.lit(DELIMITER)))).withColumn("phrase_list", F.filter(F.transform(F.split(F.lower("b"), PHRASE_BREAK), lambda x: F.trim(x)), lambda x: x.rlike(r"[\p{L}\p{Nd}]")))
    d = d.withColumn("usual", F.get(F.array_sort("delims"), F.floor(F.size("delims") / 2).cast("int")))
    words_in = lambda r: F.size(F.split(F.trim(r), r"\s+"))
    stats = {
        "n_words": F.size("w_tokens"),
        "mean_word_length": _share(F.col("w_chars"), n("w_tokens")),
        "symbol_ratio": _share(F.col("w_chars") - F.col("w_letters") - F.col("w_digit"), F.col("w_chars")),
        "ending_share": _share(cnt("w_rows", lambda r: r.rlike(LINE_END)), n("w_rows")),
        "common_share": share,
    }
    feats = {
        "words": n("b_tokens"),
        "word_length": _share(F.col("b_chars"), n("b_tokens")),
        "symbols": _share(F.col("b_chars") - F.col("b_letters") - F.col("b_digit"), F.col("b_chars")),
        "digits": _share(F.col("b_digit"), F.col("b_chars")),
        "endings": _share(cnt("b_rows", lambda r: r.rlike(LINE_END)), n("b_rows")),
        "common": F.when(F.col("b_kana") * 3 > F.col("b_letters"), unspaced("b_", "b")).otherwise(_share(cnt("b_names", among(words_of)), n("b_names"))),
        "kana": _share(F.col("b_kana"), F.col("b_chars")),
        "distinct_words": _share(n(F.array_distinct("b_names")), n("b_names")),
        "distinct_phrases": _share(n(F.array_distinct("phrase_list")), n("phrase_list")),
        "phrases": n("phrase_list"),
        "single_letters": _share(cnt("b_tokens", lambda w: w.rlike(r"^\p{L}$")), n("b_tokens")),
        "open_vowels": _share(_kept(F.lower("b"), f"[^{VOWELS}]+"), F.col("b_letters")),
        "coded": _share(joined(F.filter("b_tokens", lambda w: (F.length(w) >= 32) & w.rlike(CODED))), F.col("b_chars")),
        "markup": F.when(F.col("b").rlike(MARKUP_SIGN), _share(F.col("b_chars") - _kept(F.regexp_replace("b", MARKUP, ""), SPACE), F.col("b_chars"))).otherwise(F.lit(0.0)),
        "damage": _share(_kept(F.col("b"), f"[^{DAMAGE}]+"), F.col("b_chars")),
        "lines": n("b_rows"),
        "line_words": _share(n("b_tokens"), n("b_rows")),
        "short_lines": _share(cnt("b_rows", lambda r: (words_in(r) <= 7) & ~r.rlike(SENTENCE_END)), n("b_rows")),
        "row_lines": _share(cnt("delims", lambda x: x >= 2), n("delims")),
        "even_rows": _share(F.when(F.col("usual") >= 1, cnt("delims", lambda x: x == F.col("usual"))).otherwise(F.lit(0.0)), n("delims")),
        "bullets": _share(cnt("b_rows", lambda r: r.rlike(BULLET)), n("b_rows")),
        "breaks": _share(F.regexp_count("b", F.lit(ITEM_BREAK)).cast("double"), n("b_tokens")),
        "sentence_ends": _share(F.regexp_count("b", F.lit(SENTENCE_END)).cast("double"), n("b_tokens")),
        "pairs": _share(F.regexp_count("b", F.lit(r"\w=[^\s=;&]+[&;]")).cast("double"), n("b_tokens")),
        "longest_line_words": F.coalesce(F.array_max(F.transform("b_rows", words_in)), F.lit(0)).cast("double"),
    }
    every = stats | {k: feats[k] for k in FEATURES}
    # a generator between the statistics and what uses them keeps the optimiser from working them out once per
    # use, but also from leaving out those that nobody uses
    row = F.struct(*(F.when(F.col("t").isNotNull(), every[k]).alias(k) for k in (every if only is None else only)))
    return d.select("key", F.inline(F.array(row))).withColumnRenamed("key", key)


def load_rules(path: Path = RULES) -> list[dict]:
    return json.loads(path.read_text(encoding="utf-8"))["rules"]


def deciding(rules: list[dict]) -> list[str]:
    """The features that rules look at, with those by which blank texts are told."""
    used = {"word_length", "words"} | {f for r in rules for f, _, _ in r["if"]}
    return [f for f in FEATURES if f in used]


def case_expression(rules: list[dict]) -> str:
    """The ordered rules as SQL: the first whose conditions all hold names the kind; blank and null texts, and the rest, are null."""
    whens = " ".join("WHEN " + " AND ".join(f"{f} {op} {t!r}" for f, op, t in r["if"]) + f" THEN '{r['kind']}'" for r in rules)
    return f"CASE WHEN word_length IS NULL OR words = 0 THEN NULL {whens} ELSE NULL END"


def not_prose(stats: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """`stats` with the column kind: list, table, junk, or null for prose and for blank texts."""
    return stats.withColumn("kind", F.expr(case_expression(load_rules() if rules is None else rules)))
