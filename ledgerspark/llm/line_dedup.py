"""Global line dedup over overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3


def _windows(lines: Column) -> Column:
    """pos and a 128-bit hash (a, b) of every WINDOW consecutive lines that are not all blank."""
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) != "").alias("worded")))

    def window(h: Column) -> Column:
        def at(i: Column) -> Column:
            own = [F.get(h, i + k) for k in range(WINDOW)]
            worded = own[0]["worded"]
            for o in own[1:]:
                worded = worded | o["worded"]
            a, b = F.xxhash64(*[o["h"] for o in own]), F.xxhash64(F.lit("b"), *[o["h"] for o in own])
            return F.struct(i.alias("pos"), a.alias("a"), b.alias("b"), worded.alias("worded"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at), lambda w: w["worded"])

    return F.when(F.size(lines) >= WINDOW, F.get(F.transform(F.array(hashes), window), F.lit(0)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for every row of docs.

    Lines are what newlines part. Of each window of WINDOW lines that stands
    more than once in the corpus, the first occurrence (by id, null first, then
    by place) is spared; every line that a later occurrence covers goes, where
    occurrences that overlap are merged. Windows of blank lines alone do not
    count, and a text of fewer lines keeps them all. A null text stays null,
    with no lines; an empty text has one. Rows that repeat an id are told apart
    by their text; wholly equal rows share one place, so none is emptied by its
    own twin. Other columns are not read; an empty table gives an empty result.
    Windows count as equal where two 64-bit hashes of their lines' hashes are;
    the lines themselves are not compared again.

    Windows are counted by aggregation, so a window that a third of the
    documents hold is combined before the shuffle; the join back has one row a
    window on its other side, which adaptive execution splits where it is skewed.
    """
    lines = F.split("text", "\n", -1)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    windows = texts.select("doc_id", "tie", lines.alias("lines")).select("doc_id", "tie", F.explode(_windows(F.col("lines"))).alias("w")).select("doc_id", "tie", "w.pos", "w.a", "w.b")
    place = F.struct("doc_id", "tie", "pos")
    often = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = windows.join(often, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    covers = later.groupBy(F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie")).agg(F.collect_set("pos").alias("starts"))
    # split after the join: a text is shuffled and sorted once, not beside its own lines
    both = texts.join(covers, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")), "left").withColumn("lines", lines)
    covered = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    picked = both.select("doc_id", "text", "lines", F.when(F.col("starts").isNotNull(), kept).alias("kept"))
    return picked.select(
        "doc_id",
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).alias("text"),
    )


#: The same in DuckDB SQL over documents.
SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT * FROM w WHERE c IS NOT NULL AND NOT (trim(a, ' ') = '' AND trim(b, ' ') = '' AND trim(c, ' ') = '')),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM v),
x AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text, count(*) AS n FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.pos = e.pos WHERE x.pos IS NULL GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(len(l.lines), 0)::BIGINT AS n_lines, (coalesce(len(l.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM l LEFT JOIN k ON k.doc_id = l.doc_id
"""
