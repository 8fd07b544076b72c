"""Error classification, as exceptions for the driver and as Columns for result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what servers say when an input is too long
TOO_LONG = ["context length", "context window", "maximum context", "too long", "too large", "exceeds", "exceed the", "input length", "number of tokens", "maximum tokens"]

ERROR_TYPE = "struct<index:int,message:string,batch_cause:string,permanent:boolean,too_long:boolean>"


class PermanentError(Exception):
    """Trying again won't help; too_long says that a shorter input may."""

    def __init__(self, message: str, too_long: bool = False):
        super().__init__(message)
        self.too_long = too_long


class RerankUnavailable(Exception):
    """The reranker can't answer now; the first-stage order stands."""


def chain(error: BaseException | None):
    while error is not None:
        yield error
        error = error.__cause__


def is_retryable(error: BaseException | None) -> bool:
    return error is not None and not any(isinstance(e, PermanentError) for e in chain(error))


def is_context_length(status: int, body: str) -> bool:
    return status == 413 or any(x in body.lower() for x in TOO_LONG)


def http_error(message: str, status: int, body: str) -> Exception:
    """400 to 499 is permanent, too many requests included."""
    return PermanentError(message, is_context_length(status, body)) if 400 <= status < 500 else RuntimeError(message)


def rerank_http_error(message: str, status: int, body: str) -> Exception:
    if status == 429 or status >= 500:
        return RerankUnavailable(message)
    return PermanentError(message, is_context_length(status, body)) if status >= 400 else RuntimeError(message)


def is_rerank_available(error: BaseException | None) -> bool:
    return not any(isinstance(e, (RerankUnavailable, TimeoutError)) for e in chain(error))


def context_length(status: Column, body: Column) -> Column:
    found = status == 413
    for phrase in TOO_LONG:
        found |= F.lower(body).contains(phrase)
    return found


def classify_http(status: Column, body: Column) -> Column:
    """struct<permanent, too_long> of a response that isn't 200."""
    client = status.between(400, 499)
    return F.struct(client.alias("permanent"), (client & context_length(status, body)).alias("too_long"))


def classify_rerank_http(status: Column, body: Column) -> Column:
    """struct<unavailable, permanent, too_long>."""
    away = (status == 429) | (status >= 500)
    permanent = ~away & (status >= 400)
    return F.struct(away.alias("unavailable"), permanent.alias("permanent"), (permanent & context_length(status, body)).alias("too_long"))
