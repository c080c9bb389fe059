"""Templates, docs blocks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sourcemine import fixed_values as fixed
from sourcemine.functions import text as text_rules


def template_settings(catalogue: DataFrame) -> DataFrame:
    """The three fields of a catalogue entry that a run uses."""
    return catalogue.select(
        "prompt_id",
        F.col("temperature").cast("double").alias("temperature"),
        "description",
        "template",
    )


def lookup_template(catalogue: DataFrame, prompt_id: str) -> Row:
    """Settings of one template; an unknown id is an error."""
    found = template_settings(catalogue.filter(F.col("prompt_id") == prompt_id)).head(2)
    if len(found) != 1:
        raise KeyError(f"Prompt ID {prompt_id!r} is in the catalogue {len(found)} times")
    missing = [name for name in ("temperature", "template") if found[0][name] is None]
    if missing:
        raise KeyError(f"Prompt ID {prompt_id!r} has no {' and no '.join(missing)}")
    return found[0]


def resolve_templates(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Settings for many runs at once; ``found`` is false where an id is unknown."""
    settings = template_settings(catalogue).withColumn("found", F.lit(True))
    return requests.join(settings, "prompt_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def with_titles(documents: DataFrame) -> DataFrame:
    """Documents (``block, doc_key, body``) with the usual titles and introduction."""
    title = F.lit(None).cast("string")
    for key, value in zip(fixed.DOC_KEYS, fixed.DOC_TITLES):
        title = F.when(F.col("doc_key") == key, F.lit(value)).otherwise(title)
    return documents.withColumn("title", title).withColumn("intro", F.lit(fixed.DOC_INTRO))


def docs_blocks(documents: DataFrame) -> DataFrame:
    """One docs block per ``block``: two cleaned, bannered documents.

    A block has two slots, so the aggregate keeps two texts and no list."""
    banner = text_rules.doc_banner(F.col("title"), F.col("intro"), F.col("body"))
    slots = [
        F.coalesce(F.max(F.when(F.col("doc_key") == key, F.col("banner"))), F.lit(""))
        for key in fixed.DOC_KEYS
    ]
    return (
        documents.select("block", "doc_key", banner.alias("banner"))
        .groupBy("block")
        .agg(F.concat_ws(fixed.BLOCK_SEPARATOR, *slots).alias("docs"))
    )


def docs_text(documents: DataFrame, block: str) -> Column:
    """One docs block as a scalar: at most one row, read once, no join."""
    chosen = docs_blocks(documents.filter(F.col("block") == block)).select("docs")
    return F.coalesce(chosen.scalar(), F.lit(fixed.BLOCK_SEPARATOR))


def target_text(kind: Column, code: Column, class_code: Column, method: Column) -> Column:
    """What a candidate shows of its code: a function alone, a method with its class."""
    focus = text_rules.format_columns(
        fixed.METHOD_TARGET_FORMAT, class_code=class_code, method=method, code=code
    )
    return F.when(kind == "method", focus).otherwise(code)


def render(template: Column, target: Column, docs: Column) -> Column:
    """Literal replacement in sequence: a docs token inside the code is expanded too."""
    with_code = F.replace(template, F.lit(fixed.CODE_TOKEN), target)
    return F.replace(with_code, F.lit(fixed.DOCS_TOKEN), docs)


def render_prompts(candidates: DataFrame, template: Column, docs: Column) -> DataFrame:
    """Adds ``prompt``.  A projection, so it belongs after the last shuffle:
    the docs block then never travels with the rows."""
    target = target_text(F.col("kind"), F.col("code"), F.col("class_code"), F.col("method"))
    return candidates.withColumn("prompt", render(template, target, docs))
