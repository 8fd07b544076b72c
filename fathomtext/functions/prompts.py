"""Records and prompts as string-building Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomtext.functions.models import DEFAULT, Registry

RETRIEVAL_DOCUMENT, RETRIEVAL_QUERY, CLUSTERING, CLASSIFICATION = "retrieval-document", "retrieval-query", "clustering", "classification"
SIMILARITY, QUESTION_ANSWERING, FACT_CHECKING, CODE_RETRIEVAL = "similarity", "question-answering", "fact-checking", "code-retrieval"

#: fixed values: what each model was trained to see before the text
_NOMIC = {RETRIEVAL_DOCUMENT: "search_document:\n", RETRIEVAL_QUERY: "search_query:\n", CLASSIFICATION: "classification:\n", CLUSTERING: "clustering:\n"}
_GEMMA = {
    RETRIEVAL_DOCUMENT: "title: none | text:\n",
    RETRIEVAL_QUERY: "task: search result | query:\n",
    CLUSTERING: "task: clustering | query:\n",
    CLASSIFICATION: "task: classification | query:\n",
    SIMILARITY: "task: sentence similarity | query:\n",
    QUESTION_ANSWERING: "task: question answering | query:\n",
    FACT_CHECKING: "task: fact checking | query:\n",
    CODE_RETRIEVAL: "task: code retrieval | query:\n",
}


def _prefixer(table: dict[str, str]):
    return lambda task, text: F.concat(F.lit(table[task]), text) if task in table else text


def gemma_document(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.when(F.coalesce(title, F.lit("")) == "", "none").otherwise(title), F.lit(" | text:\n"), text)


DEFAULT.task_prompters |= {"nomic-embed-text": _prefixer(_NOMIC), "nomic-embed-text-v2": _prefixer(_NOMIC), "embeddinggemma": _prefixer(_GEMMA)}
DEFAULT.document_prompters["embeddinggemma"] = gemma_document


def passthrough(task: str, text: Column) -> Column:
    return text


def lookup_task_prompter(model: str, registry: Registry = DEFAULT):
    return registry._resolve(registry.task_prompters, model) or passthrough


def register_task_prompter(model: str, prompter, registry: Registry = DEFAULT) -> None:
    """None takes a prompter away."""
    if prompter is None:
        registry.task_prompters.pop(model, None)
    else:
        registry.task_prompters[model] = prompter


def lookup_document_prompter(model: str, registry: Registry = DEFAULT):
    return registry._resolve(registry.document_prompters, model)


def register_document_prompter(model: str, prompter, registry: Registry = DEFAULT) -> None:
    if prompter is None:
        registry.document_prompters.pop(model, None)
    else:
        registry.document_prompters[model] = prompter


def has_prompts(registry: Registry, model: str) -> bool:
    """Known by the clustering task: a model with a prefix for it has prompts."""
    found = registry._resolve(registry.task_prompters, model)
    probe = object()
    if found in (None, passthrough):
        return False
    try:
        return found(CLUSTERING, probe) is not probe
    except Exception:  # it builds a Column around the text, so it has a prefix
        return True


def fields(*pairs: tuple[str, Column]) -> Column:
    """An ordered array<struct<key, value>>."""
    return F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))


def format_record(items: Column, body: Column) -> Column:
    """``key: value`` lines, a blank line and the body; pairs with an empty side are left out."""
    full = F.filter(items, lambda f: (F.coalesce(f["key"], F.lit("")) != "") & (F.coalesce(f["value"], F.lit("")) != ""))
    head = F.array_join(F.transform(full, lambda f: F.concat(f["key"], F.lit(": "), f["value"])), "\n")
    return F.when(body == "", F.regexp_replace(head, r"\n+\z", "")).when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def format_for_task(model: str, task: str, text: Column, registry: Registry = DEFAULT) -> Column:
    return lookup_task_prompter(model, registry)(task, text)


def format_record_for_task(model: str, task: str, items: Column, body: Column, registry: Registry = DEFAULT) -> Column:
    return format_for_task(model, task, format_record(items, body), registry)


def format_retrieval_document(model: str, title: Column, items: Column, body: Column, registry: Registry = DEFAULT) -> Column:
    """The title goes to the model's title slot; a model without one gets it as a leading field."""
    prompter = lookup_document_prompter(model, registry)
    if prompter is not None:
        return prompter(title, format_record(items, body))
    titled = F.concat(F.array(F.struct(F.lit("title").alias("key"), title.alias("value"))), items)
    return format_record_for_task(model, RETRIEVAL_DOCUMENT, F.when(F.coalesce(title, F.lit("")) == "", items).otherwise(titled), body, registry)
