"""Names, paths and dates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Strptime directives and the digits each accepts.
_DATE_FIELDS = {
    "%Y": ("year", r"([0-9]{4})"),
    "%y": ("short_year", r"([0-9]{2})"),
    "%m": ("month", r"(1[0-2]|0?[1-9])"),
    "%d": ("day", r"(3[01]|[12][0-9]|0?[1-9])"),
    "%H": ("hour", r"(2[0-3]|[01]?[0-9])"),
    "%M": ("minute", r"([0-5]?[0-9])"),
    "%S": ("second", r"([0-5]?[0-9])"),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    def stem(name):
        suffix = F.length(F.substring_index(name, ".", -1))
        kept = F.substr(name, F.lit(1), F.length(name) - suffix - 1)
        return F.when((F.instr(name, ".") > 0) & (F.ltrim(kept, F.lit(".")) != ""), kept).otherwise(name)

    return let(file_name(path), stem)


def expected_code(group: Column) -> Column:
    return F.element_at(F.split(group, "/"), -1)


def is_set_aside(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "aside")


def safe_name(name: Column) -> Column:
    cleaned = F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), 1, 60)
    return F.when(cleaned == "", F.lit("series")).otherwise(cleaned)


def export_folder(group: Column) -> Column:
    """Folder name that stays unique when two names clean to the same text."""
    return F.concat(safe_name(group), F.lit("-"), F.substring(F.sha2(group, 256), 1, 12))


def template_pattern(template: str) -> tuple[str, list[str]]:
    """Turn ``{group}.{date}`` into an anchored regex and its field order."""
    fields: list[str] = []
    pattern = []
    for literal, field in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        pattern.append(re.sub(r"([^\w\s-])", r"\\\1", literal))
        if field:
            pattern.append("(.+?)")
            fields.append(field)
    return "(?is)^" + "".join(pattern) + "$", fields


def template_field(name: Column, template: str, field: str) -> Column:
    """Value of one template field, or null when the name does not match."""
    pattern, fields = template_pattern(template)
    return F.nullif(F.regexp_extract(name, pattern, fields.index(field) + 1), F.lit(""))


def template_fields(name: Column, template: str) -> Column:
    """struct of all template fields; empty texts when the name does not match."""
    pattern, fields = template_pattern(template)
    return let(name, lambda n: F.struct(*[F.regexp_extract(n, pattern, i + 1).alias(f) for i, f in enumerate(fields)]))


def parse_date(text: Column, date_format: str) -> Column:
    """Parse by strptime directives; null when the text or the calendar day is invalid.

    Two-digit years below 69 belong to this century, the others to the last one.
    """
    names: list[str] = []
    pattern = ""
    for token in re.findall(r"%[A-Za-z]|.", date_format):
        if token in _DATE_FIELDS:
            names.append(_DATE_FIELDS[token][0])
            pattern += _DATE_FIELDS[token][1]
        elif token.startswith("%") and len(token) == 2:
            raise ValueError(f"unsupported date directive {token}")
        else:
            pattern += re.sub(r"([^\w\s-])", r"\\\1", token)
    pattern = f"^{pattern}$"

    def build(t: Column) -> Column:
        def part(name: str, default: int) -> Column:
            if name not in names:
                return F.lit(default)
            return F.regexp_extract(t, pattern, names.index(name) + 1).try_cast("int")

        if "short_year" in names:
            year = let(part("short_year", 0), lambda y: y + F.when(y < 69, 2000).otherwise(1900))
        else:
            year = part("year", 1900)
        return F.try_make_timestamp_ntz(
            year, part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), part("second", 0)
        )

    return let(text, build)


def clean_date_text(text: Column, suffix: str = "_1", legacy: bool = False) -> Column:
    """Drop a duplicate marker from the date text.

    ``legacy`` drops every occurrence, which also damages texts such as ``20220925_143045``.
    """
    quoted = re.sub(r"([^\w\s-])", r"\\\1", suffix)
    return F.regexp_replace(text, quoted if legacy else quoted + "$", "")
