"""What a path says: language, role, tier, buckets. All native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.catalog import languages as L
from lintel.catalog import roles as R


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, lower-cased; leading dots of a name don't count."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """By whole file name, else by extension; null if unknown."""
    return F.coalesce(lookup(L.by_file_name(), base_name(path)), lookup(L.by_extension(), extension(path)))


def is_deep(language_: Column) -> Column:
    return F.coalesce(language_.isin(*L.DEEP), F.lit(False))


def label(language_: Column) -> Column:
    return F.coalesce(lookup(L.labels(), language_), language_)


def in_skipped_dir(rel_path: Column) -> Column:
    dirs = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*L.SKIPPED_DIRS) | d.startswith("."))


def is_binary(path: Column) -> Column:
    name = F.lower(base_name(path))
    return any_of([F.endswith(name, F.lit(e)) for e in L.BINARY_ENDINGS])


def scan_status(rel_path: Column, size: Column, cap: int = L.MAX_FILE_BYTES) -> Column:
    """skipped_dirs, skipped_binary, skipped_unknown_lang, skipped_too_large or analysable: the first that holds."""
    lang = language(rel_path)
    return (
        F.when(in_skipped_dir(rel_path), "skipped_dirs")
        .when(is_binary(rel_path), "skipped_binary")
        .when(lang.isNull() | (lang == "text"), "skipped_unknown_lang")
        .when(size > cap, "skipped_too_large")
        .otherwise("analysable")
    )


def role(rel_path: Column) -> Column:
    """doc, test, vendor, security_tool or application: the first that holds."""
    path = F.lower(F.replace(rel_path, F.lit("\\"), F.lit("/")))
    parts, base = F.split(path, "/"), F.substring_index(path, "/", -1)
    stems = F.transform(parts, lambda p: F.substring_index(p, ".", 1))
    ends = lambda text, values: any_of([F.endswith(text, F.lit(v)) for v in values])
    starts = lambda text, values: any_of([F.startswith(text, F.lit(v)) for v in values])
    overlap = lambda a, values: F.arrays_overlap(a, literal_array(values))
    return (
        F.when(extension(path).isin(*R.DOC_ENDINGS), "doc")
        .when(overlap(stems, R.TEST_PARTS) | F.startswith(base, F.lit("test_")) | ends(base, R.TEST_ENDINGS), "test")
        .when(
            overlap(parts, R.VENDOR_PARTS)
            | contains_any(path, R.VENDOR_WITHIN)
            | F.substring_index(base, ".", 1).isin(*R.VENDOR_STEMS)
            | starts(base, R.VENDOR_PREFIXES)
            | base.rlike(r"[.\-]min\.(js|css)\z"),
            "vendor",
        )
        .when(overlap(stems, R.TOOL_STEMS), "security_tool")
        .otherwise("application")
    )


def tier(path: Column) -> Column:
    """1, 2 or 3: how early a file is scanned."""
    p = F.lower(path)
    return F.when(contains_any(p, R.FIRST_WORDS), 1).when(contains_any(p, R.SECOND_WORDS), 2).otherwise(3)


def keyword_place(path: Column, keywords: list[str]) -> Column:
    """Place of the first keyword that the path holds, else their number."""
    p = F.lower(path)
    found = F.lit(len(keywords))
    for i, k in reversed(list(enumerate(keywords))):
        found = F.when(F.contains(p, F.lit(k)), i).otherwise(found)
    return found


def route_buckets(path: Column, methods: Column) -> Column:
    """The probes that a route enables, as an array."""
    p = F.lower(path)
    found = []
    for name, (method, words) in R.ROUTE_BUCKETS.items():
        takes = contains_any(p, words.split())
        found.append(F.when(takes & F.array_contains(methods, method) if method else takes, name))
    found.insert(2, F.when(F.array_contains(methods, "GET") & path.rlike(R.ROUTE_ID), "id"))
    return F.array_compact(F.array(*found))
