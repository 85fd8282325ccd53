"""Text expressions: vacuum query scrubbing (H1) and status truncation (H2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.  (?i) ignore case; (?d) makes '.' stop only at '\n' as in
# Python's re (Java's '.' also stops at '\r', U+0085, U+2028, U+2029).
VACUUM_PATTERN = r"(?id)vacuum .*[^;]"
AUTOVACUUM_MARK = "autovacuum: "
# Line breaks of Python's str.splitlines().
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
BREAK_CHARS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
HEAD_LINES, TAIL_LINES = 50, 100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scrub_vacuum_query(query) -> Column:
    """Keep only the vacuum statement of a session's query text.

    Text with 'autovacuum: ' (case-sensitive) is kept; otherwise, when the
    lower-cased text contains 'vacuum ' and the pattern matches, the first
    match, stripped and lower-cased, replaces the text; else it is kept.
    This is not a privacy-grade scrub: text after ';' on the same line stays.
    """
    q = _c(query)
    hit = F.regexp_extract(q, VACUUM_PATTERN, 0)
    stripped = F.regexp_replace(hit, r"(?U)^\s+|\s+$", "")
    return (F.when(q.contains(AUTOVACUUM_MARK), q)
            .when(F.lower(q).contains("vacuum ") & q.rlike(VACUUM_PATTERN), F.lower(stripped))
            .otherwise(q))


def split_lines(text) -> Column:
    """str.splitlines(): split on every line break, no trailing empty line."""
    t = _c(text)
    parts = F.split(t, LINE_BREAKS)
    ends_with_break = F.substring(t, -1, 1).isin(*BREAK_CHARS)
    return F.when(t == "", F.array().cast("array<string>")) \
        .when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def truncate_lines(text, head: int = HEAD_LINES, tail: int = TAIL_LINES, lines: Column | None = None) -> Column:
    """Keep the first ``head`` and last ``tail`` lines with a marker between.

    ``lines`` may pass an already split column (see ``truncate_status``).
    """
    t = _c(text)
    lines = split_lines(t) if lines is None else lines
    n = F.size(lines)
    marker = F.concat(F.lit("...ignore "), (n - head - tail).cast("string"), F.lit(" lines here..."))
    kept = F.concat(F.slice(lines, 1, head), F.array(marker), F.slice(lines, -tail, tail))
    return F.when(n <= head + tail, t).otherwise(F.array_join(kept, "\n"))


def truncate_status(df, text: str = "text", out: str = "status", head: int = HEAD_LINES,
                    tail: int = TAIL_LINES):
    """H2 over a DataFrame: the text is split into lines once per row."""
    split = df.withColumn("_lines", split_lines(F.col(text)))
    return split.withColumn(out, truncate_lines(F.col(text), head, tail, F.col("_lines"))).drop("_lines")
