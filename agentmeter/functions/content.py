"""Measuring what a result put into context."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentmeter.model import TRUNCATION_MARKERS

_BLOCKS = "array<struct<type: string, text: string, source: struct<data: string>>>"


def truncation_marker(text: Column) -> Column:
    """First marker present, in the fixed order; '' for clean text."""
    found = F.lit("")
    for marker in reversed(TRUNCATION_MARKERS):
        found = F.when(F.contains(text, F.lit(marker)), F.lit(marker)).otherwise(found)
    return F.coalesce(found, F.lit(""))


def json_string(value: Column, not_array: Column) -> Column:
    """The decoded text when the VARIANT is a string, else NULL. The shape of
    an array is never spelled out just to see that it is none."""
    is_string = F.when(not_array, F.schema_of_variant(value) == "STRING")
    return F.when(is_string, F.try_variant_get(value, "$", "string"))


def open_content(content: Column) -> Column:
    """(blocks, text) of a VARIANT content field; both NULL in other shapes."""
    blocks = F.try_variant_get(content, "$", _BLOCKS)
    return F.struct(blocks.alias("blocks"), json_string(content, blocks.isNull()).alias("text"))


def measure_opened(opened: Column) -> Column:
    """(context_bytes, image_bytes, marker) of opened content.

    A string counts its decoded UTF-8 bytes. An array counts the text of its
    blocks and, apart from it, the inline data of image blocks. Any other shape
    measures zero.
    """
    blocks, text = opened["blocks"], opened["text"]
    zero = F.lit(0).cast("bigint")
    block_text = F.aggregate(
        blocks, zero, lambda acc, b: acc + F.coalesce(F.octet_length(b["text"]), F.lit(0))
    )
    block_image = F.aggregate(
        F.filter(blocks, lambda b: b["type"] == "image"),
        zero,
        lambda acc, b: acc + F.coalesce(F.octet_length(b["source"]["data"]), F.lit(0)),
    )
    block_markers = F.filter(
        F.transform(blocks, lambda b: truncation_marker(b["text"])), lambda m: m != ""
    )
    first_marker = F.when(blocks.isNotNull(), F.try_element_at(block_markers, F.lit(1)))
    return F.struct(
        F.coalesce(block_text, F.octet_length(text).cast("bigint"), zero).alias("context_bytes"),
        F.coalesce(block_image, zero).alias("image_bytes"),
        F.coalesce(first_marker, truncation_marker(text)).alias("marker"),
    )


_CODEX_BLOCKS = "array<struct<type: string, text: string, image_url: string>>"
_DATA_URL = r"(?s)^data:image/[^,]*;base64,"


def measure_codex(output: Column) -> Column:
    """Text and inline image bytes of a rollout output, a VARIANT, with what is known."""
    blocks = F.try_variant_get(output, "$", _CODEX_BLOCKS)
    return _measured_codex(blocks, json_string(output, blocks.isNull()))


def measure_codex_text(output: Column) -> Column:
    """As ``measure_codex``, of an output's JSON text that no VARIANT holds; so it is no plain string."""
    is_array = F.startswith(F.ltrim(output), F.lit("["))
    return _measured_codex(F.from_json(F.when(is_array, output), _CODEX_BLOCKS), F.lit(None).cast("string"))


def _measured_codex(blocks: Column, text: Column) -> Column:
    known_shape = text.isNotNull() | blocks.isNotNull()
    safe = F.coalesce(blocks, F.array().cast(_CODEX_BLOCKS))
    is_text = lambda b: F.coalesce(b["type"] == "input_text", F.lit(False))
    is_image = lambda b: F.coalesce(b["type"] == "input_image", F.lit(False))
    inline = lambda b: F.coalesce(F.rlike(b["image_url"], F.lit(_DATA_URL)), F.lit(False))
    other = F.exists(safe, lambda b: ~is_text(b) & ~is_image(b))
    text_gap = F.exists(safe, lambda b: is_text(b) & b["text"].isNull())
    image_gap = F.exists(safe, lambda b: is_image(b) & ~inline(b))
    block_text = F.aggregate(
        F.filter(safe, is_text),
        F.lit(0).cast("bigint"),
        lambda acc, b: acc + F.coalesce(F.octet_length(b["text"]), F.lit(0)),
    )
    block_image = F.aggregate(
        F.filter(safe, lambda b: is_image(b) & inline(b)),
        F.lit(0).cast("bigint"),
        lambda acc, b: acc + F.octet_length(F.regexp_replace(b["image_url"], r"(?s)^[^,]*,", "")),
    )
    return F.struct(
        F.coalesce(F.octet_length(text).cast("bigint"), block_text).alias("text_bytes"),
        block_image.alias("image_bytes"),
        F.exists(safe, is_image).alias("has_image"),
        (known_shape & ~other & ~text_gap).alias("text_known"),
        (known_shape & ~other & ~image_gap).alias("image_known"),
        (known_shape & ~other).alias("images_known"),
    )
