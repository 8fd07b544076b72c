"""Input budgets over Columns: truncate, or give an error struct in strict mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomtext.functions.errors import ERROR_TYPE
from fathomtext.functions.models import Limits
from fathomtext.functions.text import truncate_bytes
from fathomtext.operators.tokens import Counter, count_tokens, truncate_tokens


def _error(index: Column, message: Column, too_long: bool) -> Column:
    return F.struct(index.cast("int").alias("index"), message.alias("message"), F.lit(None).cast("string").alias("batch_cause"), F.lit(True).alias("permanent"), F.lit(too_long).alias("too_long"))


def apply_limits(text: Column, limits: Limits, model: str = "", strict: bool = False, tokenizer: Counter | None = None, index: Column | None = None) -> Column:
    """struct<text, error>: exact tokens where a tokenizer is given, else bytes, else as is."""
    index = F.lit(0) if index is None else index
    none = F.lit(None).cast(ERROR_TYPE)
    if tokenizer is not None and limits.max_tokens > 0:
        if strict:
            over = count_tokens(text, tokenizer) > limits.max_tokens
            why = F.concat(F.lit("embedding: input "), index.cast("string"), F.lit(f" exceeds {model} MaxTokens ({limits.max_tokens})"))
            return F.struct(F.when(~over, text).alias("text"), F.when(over, _error(index, why, True)).otherwise(none).alias("error"))
        return F.struct(truncate_tokens(text, limits.max_tokens, tokenizer).alias("text"), none.alias("error"))
    if limits.max_bytes <= 0:
        return F.struct(text.alias("text"), none.alias("error"))
    if strict:
        over = F.octet_length(text) > limits.max_bytes
        why = F.concat(F.lit("embedding: input "), index.cast("string"), F.lit(f" exceeds {model} MaxBytes ("), F.octet_length(text).cast("string"), F.lit(f" > {limits.max_bytes})"))
        return F.struct(F.when(~over, text).alias("text"), F.when(over, _error(index, why, False)).otherwise(none).alias("error"))
    return F.struct(truncate_bytes(text, limits.max_bytes).alias("text"), none.alias("error"))


def limit_documents(document: Column, max_bytes: int) -> Column:
    return truncate_bytes(document, max_bytes) if max_bytes > 0 else document
