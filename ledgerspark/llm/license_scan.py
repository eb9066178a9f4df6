"""Licence scans: ordered signatures behind a keyword prefilter, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.license_rules import BASE, DOUBT, rules

#: ASCII characters that part words, capitals excluded and included.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _CLOSE = "\u0001", "\u0002"  # control characters part words, so no word holds them


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors() -> list[str]:
    """Strings of which any detection's text holds at least one: "licen" where a rule's pattern cannot match without it, else the longest word of its keyword. Strings in which another stands are left out."""
    words = {max(p.split(), key=len) for p in BASE if p != "cc by"}
    for _, _, keyword, pattern in rules():
        bare, now = "", pattern.removeprefix("(?<= )(?:").removesuffix(")(?= )")
        while bare != now:  # groups that may be missing
            bare, now = now, re.sub(r"\((?:\?:)?[^()]*\)\?", "", now)
        words.add("licen" if "licen" in bare and "|" not in bare else max(keyword.split(), key=len))
    words -= {"by", "cc"}
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def _normal(text: Column) -> Column:
    """ " word word ... word ": what capitals, digits and other characters leave, a single space on either side of each word."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.translate(text, _UPPER, _LOWER), F.lit(" ")), _GAPS, " ")))


def _places(normal: Column, pattern: Column) -> Column:
    """start and end (words, end excluded) of every match: matches are marked, and words with a mark are numbered."""

    def numbered(words: Column, test) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(test(w), i).otherwise(-1)), lambda i: i >= 0)

    def spans(words: Column) -> Column:
        starts, ends = numbered(words, lambda w: F.startswith(w, F.lit(_OPEN))), numbered(words, lambda w: F.endswith(w, F.lit(_CLOSE)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))

    marked = F.regexp_replace(normal, pattern, F.lit(f"{_OPEN}$0{_CLOSE}"))
    return _let(marked, lambda m: F.when(m == normal, F.array().cast("array<struct<start:int,end:int>>")).otherwise(_let(F.split(F.trim(m), " "), spans)))


def _detected(normal: Column, table: Column) -> Column:
    live = F.filter(table, lambda r: F.contains(normal, r["keyword"]))
    return F.flatten(
        F.transform(live, lambda r: F.transform(_places(normal, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), r["level"].alias("level"), r["rank"].alias("rank"), r["label"].alias("label"))))
    )


def _suppressed(found: Column) -> Column:
    """What is left of the detections: one goes if another of the same or a better level contains it.

    In order of (start, longest first, level, rank), a detection is contained in
    an earlier one whose end is no smaller; so the furthest end so far of each
    level tells, and one pass does it. Of equal spans the better level stays,
    then the earlier rule.
    """
    far = F.struct(*[F.lit(0).alias(f"end{i}") for i in range(len(DOUBT))], F.lit(0.0).alias("doubt"), F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["back"]
        reach = F.lit(0)
        for i in range(len(DOUBT)):
            reach = F.greatest(reach, F.when(d["level"] >= i, acc[f"end{i}"]).otherwise(0))
        stays = reach < end
        ends = [F.when(stays & (d["level"] == i), F.greatest(acc[f"end{i}"], end)).otherwise(acc[f"end{i}"]).alias(f"end{i}") for i in range(len(DOUBT))]
        doubt = F.get(F.array(*[F.log(F.lit(x)) for x in DOUBT]), d["level"])
        return F.struct(
            *ends,
            (acc["doubt"] + F.when(stays, doubt).otherwise(0.0)).alias("doubt"),
            F.when(stays & ~F.array_contains(acc["labels"], d["label"]), F.array_append(acc["labels"], d["label"])).otherwise(acc["labels"]).alias("labels"),
        )

    # on equal spans a worse level must come after: (start, back, level, rank)
    return F.aggregate(F.array_sort(found), far, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    Words are runs of lower-cased ASCII letters, digits and characters outside
    ASCII. n_base counts the places of the BASE phrases, first_word and
    last_word are their smallest and largest start. Every rule whose keyword is
    in the text is matched over the whole text; a match inside a match of the
    same or a better level is suppressed. labels joins what is left and the
    base labels; score is 1 less the product of the doubt that each match left
    by suppression carries, 0 without any. Null and empty texts: no words,
    no labels. Null ids and repeated rows are scanned like any row; other
    columns are not read. No shuffle, and no row depends on another.
    """
    table = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(i).alias("rank"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern")) for i, (level, label, keyword, pattern) in enumerate(rules())])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", F.lower("text").alias("low"))
    gate = F.contains("low", F.lit("cc")) & F.rlike("low", F.lit(f"cc{_GAPS}by"))
    for word in anchors():
        gate = gate | F.contains("low", F.lit(word))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), F.when(gate, _normal(F.col("text"))).alias("normal"))
    phrases = F.lit("(?<= )(?:" + "|".join(map(re.escape, BASE)).replace("\\ ", " ") + ")(?= )")
    rows = rows.select("doc_id", "n_words", "normal", F.when(F.col("normal").isNotNull(), F.transform(_places(F.col("normal"), phrases), lambda p: p["start"])).alias("base"), F.when(F.col("normal").isNotNull(), _suppressed(_detected(F.col("normal"), table))).alias("left"))
    own = F.array_compact(F.array(*[F.when(F.contains("normal", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
    rows = rows.select("doc_id", "n_words", "base", "left", F.coalesce(F.array_sort(own), F.array().cast("array<string>")).alias("own"))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("left.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("left").isNull(), 0.0).otherwise(1 - F.exp("left.doubt")).alias("score"),
    )
