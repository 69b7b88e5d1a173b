"""Source text as columns: comments, strings, lines, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A line that defines a catalogue of patterns rather than code.
_CATALOGUE_CALL = r"re\.(compile|search|match|findall|sub)\s*\("
_CATALOGUE_NAME = r"(?i)\b(pattern|regex|signatures?|sql_kw|sinks?|tokens?)\w*\s*=\s*([\[\(]|r['\"])"


def without_comments(source: Column, language: Column) -> Column:
    """Comments, docstrings and catalogue lines gone, string literals kept.

    # starts a comment in every language, // in all but Python and Ruby.
    """
    s = source
    for block in (r'(?s)""".*?"""', r"(?s)'''.*?'''", r"(?s)/\*.*?\*/", r"#[^\n]*"):
        s = F.regexp_replace(s, block, "")
    s = F.when(language.isin("python", "ruby"), s).otherwise(F.regexp_replace(s, r"//[^\n]*", ""))
    s = F.when(language.isin("sql", "lua", "haskell", "ada"), F.regexp_replace(s, r"--[^\n]*", "")).otherwise(s)
    lines = F.filter(F.split(s, "\r?\n", -1), lambda x: ~(x.rlike(_CATALOGUE_CALL) | x.rlike(_CATALOGUE_NAME)))
    return F.array_join(lines, "\n")


def without_strings(code: Column) -> Column:
    """Literals on one line emptied, so that words inside them don't count."""
    return F.regexp_replace(F.regexp_replace(code, r'"[^"\n]*"', '""'), r"'[^'\n]*'", "''")


def line_of(source: Column, pattern: str, first: Column) -> Column:
    """Number of the first line that matches, else the unit's first line."""
    lines = F.split(source, "\n", -1)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), first + i)), lambda n: n.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), first)


def words(text: Column) -> Column:
    """Distinct words of three characters or more, lower-cased, in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w{2,})"), F.lit(1)), F.lower))


def type_words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"), F.lit(1)))


def normal_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Confidences halved and rounded as binary doubles round (0.85 gives 0.42).
HALVED = {0.4: 0.2, 0.45: 0.23, 0.5: 0.25, 0.55: 0.28, 0.6: 0.3, 0.7: 0.35, 0.75: 0.38, 0.78: 0.39, 0.8: 0.4, 0.85: 0.42, 0.9: 0.45}


def halved(confidence: Column) -> Column:
    out = F.round(confidence / 2, 2)
    for k, v in HALVED.items():
        out = F.when(confidence == k, F.lit(v)).otherwise(out)
    return out


def lenient_json(raw: Column) -> Column:
    """The text of the JSON object in a reply: fences, prose and trailing commas gone; null if none parses."""
    plain = F.trim(F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    tries = [plain, F.regexp_replace(plain, r",(\s*[}\]])", "$1"), inner, F.regexp_replace(inner, r",(\s*[}\]])", "$1")]
    single = F.replace(F.regexp_replace(F.regexp_replace(inner, r"\bTrue\b", "true"), r"\bFalse\b", "false"), F.lit("'"), F.lit('"'))
    tries.append(F.regexp_replace(F.regexp_replace(single, r"\bNone\b", "null"), r",(\s*[}\]])", "$1"))
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & (t != ""), t) for t in tries])


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, as its wall clock says."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))
