"""Text rules as Spark Column expressions (PRJ-01..06, PRJ-10, PRJ-17).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays JVM-side and is evaluated inside whole-stage codegen where Spark can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/str.strip() whitespace: Unicode White_Space plus the four
# information separators U+001C..U+001F.  Java's (?U)\s is Unicode White_Space.
WS_CLASS = r"[\s\x{1c}-\x{1f}]"
WS_RUN = r"(?U)" + WS_CLASS + "+"
_STRIP_BOTH = r"(?U)\A" + WS_CLASS + r"+|" + WS_CLASS + r"+\z"
_STRIP_RIGHT = r"(?U)" + WS_CLASS + r"+\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col) -> Column:
    """``str(x).strip()``: remove leading/trailing Unicode whitespace (T8).

    Spark's ``trim`` only removes spaces; tabs and NBSP would survive it.
    NULL stays NULL (callers decide what a null means, see T5).
    """
    text = _c(col).cast("string")
    # most texts have nothing to strip, which their ends tell
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(WS_RUN), F.regexp_replace(text, _STRIP_BOTH, "")).otherwise(text)


def urstrip(col) -> Column:
    """``str.rstrip()`` with Python's whitespace set."""
    return F.regexp_replace(_c(col).cast("string"), _STRIP_RIGHT, "")


def char_len(col) -> Column:
    """Length in code points (Python ``len``), PRJ-02."""
    return F.char_length(_c(col))


def split_ws(col) -> Column:
    """``str.split()``: whitespace tokens, empty strings removed (T9)."""
    return F.array_remove(F.split(_c(col), WS_RUN), "")


def token_count(col) -> Column:
    """``len(str.split())`` (PRJ-03)."""
    return F.size(split_ws(col))


def blank_placeholder(col) -> Column:
    """Generated text that is blank after strip becomes a single space (PRJ-04).

    A single space survives a TSV round trip when the writer does not trim
    (T6/T7), which is the reason the reference does this.
    """
    stripped = ustrip(col)
    return F.when(_c(col).isNull() | (stripped == F.lit("")), F.lit(" ")).otherwise(stripped)


def empty_if_null(col) -> Column:
    """Non-string / missing text is scored as '' (PRJ-05)."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def reference_fallback(reference, source) -> Column:
    """Missing or empty reference falls back to the source (PRJ-06, T24)."""
    return F.coalesce(F.nullif(_c(reference), F.lit("")), _c(source))


def clip(col, lo: float, hi: float) -> Column:
    """``np.clip`` with NULL preserved (PRJ-10).

    ``greatest``/``least`` skip NULLs, so NULL is re-imposed explicitly.
    """
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c.cast("double"))))


def truncate_tokens(col, max_len: int = 128) -> Column:
    """Keep the first ``max_len`` whitespace tokens (PRJ-17).

    The reference truncates sub-word ids at 128; we truncate whitespace tokens,
    since sub-word vocabularies are model internals.
    """
    return F.array_join(F.slice(split_ws(col), 1, int(max_len)), " ")


def na_to_null(col, na_tokens) -> Column:
    """pandas ``read_csv`` NA handling: listed words and empty fields -> NULL (T6)."""
    c = _c(col)
    return F.when(c.isin(list(na_tokens)) | (c == F.lit("")), F.lit(None).cast("string")).otherwise(c)


# pandas' default na_values (fixed values that must equal pandas' list for the
# same results, pandas.io.parsers default NA set):
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
