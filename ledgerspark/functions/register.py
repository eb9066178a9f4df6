"""Functions for SQL text: fold, normalize_text, tokenize, decode_grid, find_tables and the table function extract_tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import _ACCENTED, _PLAIN, STOPWORDS
from ledgerspark.operators import extract


_ROWS = T.ArrayType(T.ArrayType(T.StringType()))
_FOUND = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("rows", _ROWS), T.StructField("context", T.StringType())])


@F.pandas_udf(_ROWS)
def decode_grid(inner: pd.Series) -> pd.Series:
    """The cells of a table's inner HTML, spans decoded; null stays null."""
    return pd.Series([None if x is None else extract.decode_grid(x) for x in inner], dtype=object)


@F.udtf(returnType=_FOUND)
class ExtractTables:
    """One row a table of a text: HTML tables, or columns of text where there is none; a null text gives none."""

    def eval(self, text: str):
        for t in extract.html_tables(text) or extract.text_tables(text):
            yield t["position"], t["page"], t["rows"], t["context"]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql of this session; their names. The text functions are SQL bodies that Catalyst inlines."""
    plain = f"translate(regexp_replace(s, '\\\\p{{Mn}}+', ''), '{_ACCENTED}', '{_PLAIN}')"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    bodies = {
        "fold": ("STRING", plain.replace("(s,", "(lower(s),")),
        "normalize_text": ("STRING", f"trim(regexp_replace(lower({plain}), '(?U)\\\\s+', ' '))"),
        "tokenize": ("ARRAY<STRING>", f"filter(split(lower({plain}), '[^0-9a-z]+'), t -> t <> '' AND NOT array_contains(array({stop}), t))"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("decode_grid", decode_grid)
    spark.udf.register("find_tables", extract.find_tables)
    spark.udtf.register("extract_tables", ExtractTables)
    return [*bodies, "decode_grid", "find_tables", "extract_tables"]
