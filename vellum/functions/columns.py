"""Scalar operators as native columns; each has a SQL form as well (``register``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F


def glob_to_regex(pattern: str, separator: bool = True) -> str:
    """An anchored Java regular expression; with ``separator``, * and ? don't cross a slash."""
    one, many = ("[^/]", "[^/]*") if separator else (".", ".*")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        if c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_to_regex(x, separator)[5:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += many if c == "*" else one if c == "?" else re.escape(c)
        i += 1
    return "(?s)^" + out + "$"


def filename_date(basename: Column) -> Column:
    """The first dddd-dd-dd in a name as a date; null if that isn't one."""
    return F.try_to_date(F.nullif(F.regexp_extract(basename, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("")), "yyyy-MM-dd")


def percent_decode(s: Column) -> Column:
    """%XX to UTF-8; malformed sequences and + stay."""
    return F.try_url_decode(F.regexp_replace(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"), "\\+", "%2B"))


def normalize_path(path: Column) -> Column:
    """Removes . and .. by their names alone; .. beyond the top is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def link_target(url: Column, source_dir: Column) -> Column:
    """The path that a local link leads to; null for http(s) links and bare fragments."""
    once = lambda c, f: F.transform(F.array(c), f)[0]
    bare = F.regexp_extract(url, "(?s)^[^#?]*", 0)
    # without the bindings each part would be worked out where it is used
    decoded = once(bare, lambda b: F.when(F.contains(b, F.lit("%")), percent_decode(b)).otherwise(b))
    joined = once(decoded, lambda b: F.when(b.startswith("/"), b).otherwise(F.concat_ws("/", F.when(source_dir != "", source_dir), b)))
    return F.when(~(url.startswith("http://") | url.startswith("https://") | url.startswith("#")), once(joined, normalize_path))


def parse_date(s: Column) -> Column:
    """A date in one of the accepted spellings, else that of a date and time, else null."""
    dates = [F.try_to_date(s, p) for p in ("yyyy-M-d", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")]
    return F.coalesce(*dates, F.to_date(parse_datetime(s)))


def parse_datetime(s: Column) -> Column:
    t = F.regexp_replace(s, r"(?: \+0000)? UTC$", "")
    shapes = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss Z")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in shapes))


ENTRY_HEADING = r"(?s)^([0-9]{4}-[0-9]{2}-[0-9]{2})(?: ([0-9]{2}:[0-9]{2}))?(?: - (.*))?$"


def entry_key(text: Column) -> Column:
    """What date headings are ordered by: date, then time; a day without a time comes after its timed entries."""
    date, time = F.regexp_extract(text, ENTRY_HEADING, 1), F.regexp_extract(text, ENTRY_HEADING, 2)
    return F.when(date != "", F.concat(date, F.lit(" "), F.when(time != "", time).otherwise("99:99")))


def month_title(stem: Column) -> Column:
    """February 2026 for 2026-02; null for other names."""
    return F.when(stem.rlike("^[0-9]{4}-[0-9]{2}$"), F.date_format(F.try_to_date(F.concat(stem, F.lit("-01")), "yyyy-MM-dd"), "MMMM yyyy"))


def needs_yaml_quotes(s: Column) -> Column:
    return (s == "") | (F.trim(s) != s) | s.rlike("[:#\\n\"'`]") | s.rlike("^[!&*]") | F.lower(s).isin("true", "false", "null", "~") | s.rlike(r"^[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?$")


def property_equals(values: Column, kind: Column, raw: str) -> Column:
    """Front matter equality: lists by any element, booleans by true/yes or false/no, null by an empty word or ~."""
    plain = F.array_contains(values, raw)
    yes = {"yes": "true", "no": "false"}.get(raw)
    return F.when(kind == "null", F.lit(raw in ("", "null", "~"))).when(kind == "map", F.lit(False)).when((kind == "bool") & F.lit(yes is not None), F.array_contains(values, yes or raw)).otherwise(plain)


def template_regex(template: str) -> str:
    """A template such as ``- **Bold**: Text`` as a Java regular expression."""
    out, i = "", 0
    separators = (" - ", "- ", ", ", "; ", ": ", " (", ") ", "(", ")", " – ", "–")  # fixed values of the template language
    while i < len(template):
        rest = template[i:]
        if m := re.match(r"\[[^\]]*\]\([^)]*\)", rest):
            out, i = out + r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]\([^)]*\)", i + m.end()
        elif m := re.match(r"\*\*.+?\*\*", rest):
            out, i = out + r"(?s:\*\*(?:(?!\*\*).)+\*\*)", i + m.end()
        elif m := re.match(r"YYYY-MM-DD|[0-9]{4}-[0-9]{2}-[0-9]{2}", rest):
            out, i = out + "(?:YYYY-MM-DD|[0-9]{4}-[0-9]{2}-[0-9]{2})", i + m.end()
        elif s := next((x for x in separators if rest.startswith(x)), None):
            out, i = out + re.escape(s), i + len(s)
        else:
            n = next((k for k in range(1, len(rest)) if rest[k] in "[(*)" or re.match(r"YYYY-MM-DD|[0-9]{4}-[0-9]{2}-[0-9]{2}", rest[k:]) or any(rest[k:].startswith(x) for x in separators)), len(rest))
            out, i = out + "(?s:.*?)", i + n
    return "^" + out + r"\s*\z"


def register(spark: SparkSession) -> None:
    """SQL functions for expressions over the tables."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION filename_date(s STRING) RETURNS DATE RETURN try_to_date(nullif(regexp_extract(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0), ''), 'yyyy-MM-dd')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION percent_decode(s STRING) RETURNS STRING RETURN try_url_decode(regexp_replace(regexp_replace(s, '%(?![0-9A-Fa-f]{2})', '%25'), '[+]', '%2B'))")
