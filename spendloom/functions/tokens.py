"""Token arithmetic shared by every log format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields

# How many bytes of thinking text count as one token.
BYTES_PER_TOKEN = 4

# Where a usage block may state its reasoning share.
REASONING_FIELDS = ["reasoning_tokens", "thinking_tokens", "output_reasoning_tokens"]
REASONING_DETAILS = ["output_tokens_details", "output_tokens_detail", "completion_tokens_details"]
REASONING_DETAIL_FIELDS = ["reasoning_tokens", "thinking_tokens"]


def reasoning_share(generated: Column, reasoning: Column) -> Column:
    """The reasoning part of a generated count, never more than the count."""
    return F.least(F.greatest(reasoning, F.lit(0).cast("bigint")), generated)


def visible_output(generated: Column, reasoning: Column) -> Column:
    """What is left of a generated count once reasoning is carved out."""
    return generated - reasoning_share(generated, reasoning)


def stated_reasoning(usage: Column) -> Column:
    """First positive reasoning figure a usage VARIANT states, null if none."""
    paths = [f"$.{name}" for name in REASONING_FIELDS]
    paths += [f"$.{outer}.{inner}" for outer in REASONING_DETAILS for inner in REASONING_DETAIL_FIELDS]
    return F.coalesce(*[F.nullif(fields.count(fields.member(usage, p)), F.lit(0)) for p in paths])


def thinking_bytes(content: Column) -> Column:
    """UTF-8 size of the thinking blocks in a content VARIANT."""

    def size(block: Column) -> Column:
        kind = fields.text(fields.member(block, "$.type"))
        shown = F.octet_length(fields.text(fields.member(block, "$.thinking"))) + F.octet_length(
            fields.text(fields.member(block, "$.reasoning"))
        )
        hidden = F.octet_length(fields.text(fields.member(block, "$.data")))
        return (
            F.when(kind.isin("thinking", "reasoning"), shown)
            .when(kind == "redacted_thinking", hidden)
            .otherwise(F.lit(0))
            .cast("bigint")
        )

    return F.aggregate(fields.items(content), F.lit(0).cast("bigint"), lambda acc, block: acc + size(block))


def estimated_reasoning(stated: Column, thinking: Column) -> Column:
    """The stated figure, else an estimate from the size of the thinking text."""
    return F.coalesce(stated, fields.whole_div(thinking, BYTES_PER_TOKEN))


def total(*parts: Column) -> Column:
    """Sum of the disjoint token buckets."""
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out
