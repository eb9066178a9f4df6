"""Numbers and units as they stand in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.phrases import first_said, joined, words
from ledgerspark.functions.text import let

# Fixed values.
LOOK_ALIKES = ("OoQDlI|iSsBZzg", "00001111558229")
UNIT_SCALES = {
    "vnd": 1.0, "dong": 1.0, "nghin": 1e3, "nghin dong": 1e3, "ngan dong": 1e3, "trieu": 1e6, "trieu dong": 1e6,
    "ty": 1e9, "ty dong": 1e9, "thousand": 1e3, "million": 1e6, "billion": 1e9,
}
# What a unit may be called beside its currency, and the abbreviations that stand alone after "unit:".
CURRENCY = ("dong", "vnd", "d")
UNIT_MARKS = ("dvt", "don vi", "don vi tinh")


def _unit_phrases() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(label, phrases), the largest unit first: a scale before a currency, or a short scale after a unit mark."""

    def marked(scale: str) -> tuple[str, ...]:
        return tuple(f"{m} : {s}" for m in UNIT_MARKS for s in (scale, *joined([scale], CURRENCY)))

    return (
        ("ty dong", joined(["ty"], CURRENCY) + marked("ty")),
        ("billion", ("billion",)),
        ("trieu dong", joined(["trieu", "tr"], CURRENCY) + marked("tr")),
        ("million", ("million",)),
        ("nghin dong", joined(["nghin", "ngan", "ng"], CURRENCY) + marked("ng")),
        ("thousand", ("thousand", "vnd 000", "vnd000", "vnd ' 000", "vnd ’ 000")),
        ("vnd", ("vnd", "dong")),
    )


def is_numeric_like(s: Column) -> Column:
    return F.coalesce(F.trim(s).rlike(r"^[(\-]?[\d\s.,OoIlSsBZzQgD]+[)%]?$") & s.rlike(r"\d"), F.lit(False))


def fix_numeric_token(s: Column) -> Column:
    return F.translate(s, *LOOK_ALIKES)


def _squeezed(raw: Column) -> Column:
    """A cell without quotes and white space."""
    return F.regexp_replace(F.btrim(raw, F.lit(" \t'\"*")), r"[\s\u00a0]", "")


def _mended(t: Column) -> Column:
    """Look-alike letters of a figure as the digits they stand for."""
    return F.when(t.rlike(r"^[(\-]?[\d.,OoIlSsBZzQgD]+[)%]?$") & t.rlike(r"\d"), fix_numeric_token(t)).otherwise(t)


def _value(t: Column, d: Column, as_ratio: bool, scale: Column) -> Column:
    """The value of a mended cell t whose digits and marks are d.

    Of two kinds of mark the last is decimal; one kind parts thousands if it
    repeats or three digits follow.
    """
    dots, commas = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit(""))), F.length(d) - F.length(F.replace(d, F.lit(","), F.lit("")))
    comma_last = F.length(F.substring_index(d, ",", -1)) < F.length(F.substring_index(d, ".", -1))
    both = F.when(comma_last, F.translate(d, ",.", ".")).otherwise(F.replace(d, F.lit(","), F.lit("")))
    thousands = (dots + commas > 1) | d.rlike(r"^\d+[.,]\d{3}$")
    plain = F.when((dots > 0) & (commas > 0), both).when(thousands, F.translate(d, ".,", "")).otherwise(F.replace(d, F.lit(","), F.lit(".")))
    number = F.when(t.rlike(r"^(?:\([+-]?[\d.,]+%?\)|[+-]?[\d.,]+%?)$"), plain.try_cast("double"))
    signed = F.when(F.startswith(t, F.lit("(")) != F.contains(t, F.lit("-")), -number).otherwise(number)
    return (F.when(F.contains(t, F.lit("%")), signed / 100.0).otherwise(signed) if as_ratio else signed) * scale


def _marks(t: Column) -> Column:
    return F.translate(t, "()+-%", "")


def parse_number(raw: Column, fix_ocr: bool = True, as_ratio: bool = False, scale: Column | float = 1.0) -> Column:
    """The value of a cell, null where it holds none. As one expression, for use inside others; with_number() is the faster form."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    mended = let(_squeezed(raw), _mended) if fix_ocr else _squeezed(raw)
    return let(mended, lambda t: let(_marks(t), lambda d: _value(t, d, as_ratio, scale)))


def with_number(df: DataFrame, name: str, raw: Column, fix_ocr: bool = True, as_ratio: bool = False, scale: Column | float = 1.0) -> DataFrame:
    """df with the value of a cell as column `name`: parse_number() as projections, one a step, which stay in generated code."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    out = df.withColumn("_ls_t", _squeezed(raw))
    if fix_ocr:
        out = out.withColumn("_ls_t", _mended(F.col("_ls_t")))
    out = out.withColumn("_ls_d", _marks(F.col("_ls_t")))
    return out.withColumn(name, _value(F.col("_ls_t"), F.col("_ls_d"), as_ratio, scale)).drop("_ls_t", "_ls_d")


def split_glued(s: Column) -> Column:
    """Figures that a cell holds without a gap; one part if they do not tile it, none for a blank."""
    token = r"\(?-?\d{1,3}(?:\.\d{3})+(?:,\d+)?\)?|-"

    def cut(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(token), F.lit(0))
        ok = t.rlike(r"^[\d\s.,()\-]+$") & (F.array_join(parts, "") == F.regexp_replace(t, r"\s", "")) & (F.size(parts) >= 2)
        return F.when(t == "", F.array().cast("array<string>")).when(ok, parts).otherwise(F.array(t))

    return let(F.trim(s), cut)


def detect_unit(context: Column) -> Column:
    """STRUCT<label, scale>: the largest unit that is named; dong with scale 1 where nothing is said."""
    scales = F.create_map(*[F.lit(x) for kv in UNIT_SCALES.items() for x in kv])
    label = let(words(context), lambda w: F.coalesce(first_said(w, _unit_phrases()), F.lit("vnd")))
    return let(label, lambda u: F.struct(u.alias("label"), F.element_at(scales, u).alias("scale")))


def coerce_number(raw: Column) -> Column:
    """A finite double or null."""
    v = raw.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
