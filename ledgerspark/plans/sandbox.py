"""Running query text that something else wrote: SQL over the tables of a question, checked, timed, diagnosed and repaired."""

from __future__ import annotations

import math
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.plans.answer import check_sql

TIMEOUT, ATTEMPTS, SHOWN = 15.0, 3, 15


@dataclass
class Result:
    """What a run gave: value, or error_type and error; text is the statement that ran."""

    text: str
    value: float | None = None
    error_type: str = ""
    error: str = ""
    attempt: int = 1
    hints: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return not self.error_type


def extract_query(reply: str | None) -> str:
    """The first fenced block that holds a SELECT, else the reply itself if it is one, else ''."""
    blocks = re.findall(r"```[a-zA-Z]*\s*\n?(.*?)```", reply or "", re.S)
    for text in [*blocks, reply or ""]:
        if re.match(r"(?is)\s*(?:--[^\n]*\n\s*)*(select|with)\b", text):
            return text.strip().rstrip(";").strip()
    return ""


def warnings_of(text: str) -> list[str]:
    """Remarks on a statement that may run but is likely wrong."""
    out = []
    if re.search(r"(?i)\b(read_files|csv\.|parquet\.|json\.)", text):
        out.append("reads files instead of the tables given")
    if re.search(r"(?i)\bitem\s*=\s*'", text) and not re.search(r"(?i)\b(like|ilike|contains)\b", text):
        out.append("compares an item by equality: spelling and accents differ between tables")
    if not re.search(r"(?i)\bresult\b", text):
        out.append("names no column result; the first column is taken")
    return out


def bind(frames: dict[str, DataFrame]) -> list[str]:
    """Temporary views df1 ... dfN and all_df, their union; their names."""
    union = None
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
        union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    if union is not None:
        union.createOrReplaceTempView("all_df")
    return [*frames, "all_df"]


def _tables_of(spark: SparkSession, text: str) -> set[str]:
    """Names of relations that a statement reads and does not define itself."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    read = set(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan))
    own = set(re.findall(r"(?is)(?:\bwith|,)\s+(\w+)\s+as\s*\(", text))
    return {r for r in read if r.lower() not in {o.lower() for o in own}}


def run(spark: SparkSession, text: str, frames: dict[str, DataFrame], attempt: int = 1, timeout: float = TIMEOUT) -> Result:
    """One SELECT over df1 ... dfN and all_df; the column result (else the first) of its only row is the value.

    One run at a time a session: the views carry those names while it lasts.
    Refused: anything that is no single SELECT, and relations other than those
    bound. No row, or null, is EmptyFilterError; several rows, text, NaN and
    infinity are ResultTypeError; a job beyond timeout seconds is cancelled.
    """
    out = Result(text, attempt=attempt)
    names: list[str] = []
    job = f"query-{uuid.uuid4().hex}"
    late: list[int] = []
    stop = threading.Timer(timeout, lambda: (late.append(1), spark.sparkContext.cancelJobGroup(job)))
    try:
        try:
            check_sql(spark, text)
        except ValueError as e:
            out.error_type, out.error = "UnsafeCodeError", str(e)
            return out
        known = {*frames, "all_df"}
        unknown = sorted(_tables_of(spark, text) - known)
        if unknown:
            out.error_type, out.error = "NameError", f"no table {', '.join(unknown)}"
            return out
        names = bind(frames)
        df = spark.sql(text)
        column = "result" if "result" in df.columns else df.columns[0]
        spark.sparkContext.setJobGroup(job, "checked query", interruptOnCancel=True)
        stop.start()
        rows = df.select(F.col(f"`{column}`")).limit(2).collect()
        if not rows or (len(rows) == 1 and rows[0][0] is None):
            out.error_type, out.error = "EmptyFilterError", "the conditions leave no row"
        elif len(rows) > 1:
            out.error_type, out.error = "ResultTypeError", "more than one row: aggregate, or narrow the conditions"
        else:
            try:
                value = float(rows[0][0])
            except (TypeError, ValueError):
                out.error_type, out.error = "ResultTypeError", f"{rows[0][0]!r} is no number"
            else:
                if math.isfinite(value):
                    out.value = value
                else:
                    out.error_type, out.error = "ResultTypeError", f"{value} is not finite"
    except Exception as e:  # whatever Spark refuses is told to the writer of the query
        said = str(e).split("\n")[0]
        kinds = (("UNRESOLVED_COLUMN", "KeyError"), ("PARSE_SYNTAX_ERROR", "SyntaxError"), ("DIVIDE_BY_ZERO", "ZeroDivisionError"), ("UNRESOLVED_ROUTINE", "AttributeError"))
        out.error_type = "TimeoutError" if late else next((k for s, k in kinds if s in str(e)), type(e).__name__)
        out.error = said
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for view in names:
            spark.catalog.dropTempView(view)
    return out


def diagnose(result: Result, frames: dict[str, DataFrame]) -> list[str]:
    """Hints for the next attempt, by kind of error; keywords of the statement are looked for in every table."""
    if result.success:
        return []
    hints = [result.error]
    kind = result.error_type
    if kind == "KeyError":
        hints.append(f"columns: {sorted({c for df in frames.values() for c in df.columns})}")
    elif kind == "NameError":
        hints.append(f"tables: {sorted({*frames, 'all_df'})}")
    elif kind == "UnsafeCodeError":
        hints.append("write one SELECT; nothing may be created, changed or read from files")
    elif kind == "ZeroDivisionError":
        hints.append("use try_divide and check the row that gives the denominator")
    elif kind == "TimeoutError":
        hints.append("filter before joining; avoid joins without an equality")
    elif kind == "ResultTypeError":
        hints.append("return one number: aggregate with sum, max or min_by")
    elif kind == "EmptyFilterError":
        words = re.findall(r"(?i)(?:like|contains\s*\([^,']+,)\s*'%?([^'%]+)%?'", result.text)
        items = {n: df for n, df in frames.items() if "item" in df.columns}
        for word in words:
            near = [n for n, df in items.items() if df.where(F.contains(F.lower("item"), F.lit(word.lower()))).head(1)]
            hints.append(f"'{word}' is in {', '.join(near)}" if near else f"'{word}' is in no table")
        if not words or any(h.endswith("in no table") for h in hints):
            hints += [f"items of {n}: {[r[0] for r in df.groupBy('item').agg(F.min('row_idx').alias('o')).orderBy('o', 'item').limit(SHOWN).collect()]}" for n, df in items.items() if "row_idx" in df.columns]
    return hints


def repair(spark: SparkSession, question: str, text: str, frames: dict[str, DataFrame], write: Callable[[str, str, Result | None], str] | None = None, attempts: int = ATTEMPTS, fallback: float = 0.0) -> Result:
    """Runs text; on an error asks write(question, hints, result) for another one, up to attempts runs. The last failure carries fallback as its value."""
    text = extract_query(text)
    last: Result | None = None
    if not text and write:
        text = extract_query(write(question, "no statement yet", None))
    if not text:
        return Result("", fallback, "SyntaxError", "no statement", 0)
    for attempt in range(1, attempts + 1):
        last = run(spark, text, frames, attempt)
        if last.success:
            return last
        last.hints = diagnose(last, frames)
        if write is None or attempt == attempts:
            break
        text = extract_query(write(question, "\n".join(last.hints), last)) or text
    last.value = fallback
    return last
