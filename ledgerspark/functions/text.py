"""Text functions as Column builders."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no information in a question.
STOPWORDS = (
    "la", "cua", "va", "cho", "voi", "trong", "tren", "duoi", "den", "tu", "bao", "nhieu", "the", "nao", "gi", "co", "khong", "nam", "cong", "ty",
    "hay", "hoac", "mot", "cac", "nhung", "duoc", "bi", "se", "da", "dang", "thi", "ma", "nay", "do", "vay", "ra", "vao", "ve", "boi",
)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once; nested expressions then stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _accents() -> tuple[str, str]:
    """Every precomposed letter whose decomposition is one letter and marks, and those letters; đ by hand."""
    source, plain = ["đ", "Đ"], ["d", "D"]
    for c in map(chr, range(0xC0, 0x1EFF + 1)):
        parts = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(parts) == 1 and parts[0] != c:
            source.append(c)
            plain.append(parts[0])
    return "".join(source), "".join(plain)


_ACCENTED, _PLAIN = _accents()


def strip_accents(s: Column) -> Column:
    return F.translate(F.regexp_replace(s, r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def normalize_ws(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalize_text(s: Column) -> Column:
    """Folded, lower case, white space collapsed."""
    return normalize_ws(F.lower(strip_accents(s)))


def fold(s: Column) -> Column:
    """Folded and lower case, white space as it is."""
    return strip_accents(F.lower(s))


def tokenize(s: Column, remove_stopwords: bool = True) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    parts = F.split(normalize_text(s), "[^0-9a-z]+")
    return F.filter(parts, lambda t: (t != "") & (~F.array_contains(stop, t) if remove_stopwords else F.lit(True)))


def slugify(s: Column, max_len: int = 80) -> Column:
    return F.substring(F.array_join(tokenize(s, False), "_"), 1, max_len)


def clean_line(s: Column) -> Column:
    """Control characters out, runs of one mark cut to two, right end trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"(?U)([^\w\s])\1{2,}", "$1$1"), r"\s+$", "")


def is_page_noise(s: Column) -> Column:
    return s.rlike(r"(?i)^\s*(?:trang\s*\d+|page\s*\d+|-\s*\d+\s*-|\d+\s*/\s*\d+)\s*$")


# Phrases that scanning often spoils.
TERM_FIXES = {"Doanh thu thuan": "Doanh thu thuần", "TONG CONG": "TỔNG CỘNG", "TAI SAN": "TÀI SẢN", "NGUON VON": "NGUỒN VỐN"}


def fix_ocr_text(s: Column, drop_page_noise: bool = True) -> Column:
    def line(x: Column) -> Column:
        for bad, good in TERM_FIXES.items():
            x = F.replace(x, F.lit(bad), F.lit(good))
        return x

    lines = F.transform(F.split(s, "\n", -1), clean_line)
    if drop_page_noise:
        lines = F.filter(lines, lambda x: ~is_page_noise(x))
    return F.array_join(F.transform(lines, lambda x: line(F.regexp_replace(x, "[ \t]{2,}", "  "))), "\n")
