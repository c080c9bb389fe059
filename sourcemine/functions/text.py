"""Text rules as native column expressions.  Nothing here needs Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcemine import fixed_values as fixed


def format_columns(pattern: str, **values: Column | str) -> Column:
    """``str.format`` for columns: ``{name}`` stands for the column ``name``."""
    parts = []
    for literal, field in re.findall(r"([^{}]+)|\{(\w+)\}", pattern):
        value = values[field] if field else F.lit(literal)
        parts.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*parts)


def strip(text: Column) -> Column:
    """Trim all Unicode white space; ``trim`` would only take blanks."""
    space = f"[{fixed.SPACE_CLASS}]+"
    return F.regexp_replace(text, f"^{space}|{space}\\z", "")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


# paths


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*\\z", "")


def ancestor_dirs(directory: Column) -> Column:
    """The directory itself and all directories above it."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
    )


# URLs


def _url_parts(url: Column) -> tuple[Column, Column, Column]:
    cleaned = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\t\r\n]", "")
    pattern = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"

    def part(group: int) -> Column:
        return F.regexp_extract(cleaned, pattern, group)

    scheme = F.lower(part(1))
    # Schemes whose last path part may carry ``;parameters``.
    with_params = scheme.isin(
        "", "ftp", "hdl", "prospero", "http", "https", "imap", "shttp", "rtsp", "rtsps",
        "rtspu", "sip", "sips", "mms", "sftp", "tel",
    )
    path = F.when(with_params, F.regexp_replace(part(3), ";[^/]*\\z", "")).otherwise(part(3))
    return scheme, part(2), path


def _bad_host(host: Column) -> Column:
    return F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))


def clean_url(url: Column) -> Column:
    """Scheme, authority and path.  A host with one lone bracket gives null."""
    scheme, host, path = _url_parts(url)
    return F.when(~_bad_host(host), F.concat(scheme, F.lit("://"), host, path))


def url_stem(url: Column) -> Column:
    """Last path part without its last suffix."""
    _, host, path = _url_parts(url)
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.when(~_bad_host(host), F.regexp_replace(name, "(?<=[^/])[.][^.]+\\z", ""))


# options


def options_map(options: Column) -> Column:
    """``key=value`` strings to a map; the last value of a key wins."""
    entries = F.transform(
        F.filter(options, lambda option: F.contains(option, F.lit("="))),
        lambda option: F.struct(
            F.substring_index(option, "=", 1).alias("key"),
            F.regexp_replace(option, "^[^=]*=", "").alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(entries, lambda entry: entry["key"]))
    values = F.transform(
        keys,
        lambda key: F.element_at(F.filter(entries, lambda entry: entry["key"] == key), -1)["value"],
    )
    return F.map_from_arrays(keys, values)


# answers


def first_choice(choices: Column) -> Column:
    """Text of the first choice; null when any level of it is missing."""
    return F.get(choices, F.lit(0))["message"]["content"]


def code_blocks(text: Column) -> Column:
    """All fenced blocks of a text joined by a blank line; ``''`` when there is none."""
    blocks = F.regexp_extract_all(text, F.lit(fixed.FENCE_PATTERN), F.lit(1))
    return F.coalesce(F.array_join(blocks, fixed.BLOCK_SEPARATOR), F.lit(""))


# documents


def clean_markdown(text: Column) -> Column:
    for pattern, replacement in fixed.MARKDOWN_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def doc_banner(title: Column, intro: Column, body: Column) -> Column:
    """Document between its begin and end lines; a missing or empty one is ``''``."""
    wrapped = format_columns(
        fixed.BANNER_FORMAT, title=title, intro=intro, body=clean_markdown(body)
    )
    return F.when(body != "", wrapped).otherwise(F.lit(""))


# labels


def safe_model_name(model: Column) -> Column:
    return F.translate(strip(model), "/:", "..")


def run_time_label(ts: Column) -> Column:
    return F.lower(F.date_format(ts, fixed.RUN_TIME_FORMAT))


def run_label(source: Column, model: Column, ts: Column) -> Column:
    return format_columns(
        fixed.RUN_LABEL_FORMAT,
        source=source,
        model=safe_model_name(model),
        time=run_time_label(ts),
    )


def harness_file_name(name: Column) -> Column:
    return format_columns(fixed.HARNESS_FILE_FORMAT, name=name)


def failure_entry(ts: Column, context: Column, message: Column) -> Column:
    return format_columns(
        fixed.FAILURE_ENTRY_FORMAT,
        ts=F.date_format(ts, fixed.FAILURE_TIME_FORMAT),
        context=context,
        message=message,
    )
