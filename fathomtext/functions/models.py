"""Model names, aliases, input budgets and prompters: one registry object, snapshotted into plans.

Registered state is plain data. Column builders read it when a plan is built, so a later
registration doesn't reach plans that exist already; nothing is looked up on executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomtext.functions.text import WHITE, trim_space

BYTES_PER_TOKEN = 2.0  # cautious stand-in where no measured ratio is given


@dataclass(frozen=True)
class Limits:
    """Input budget; 0 means not enforced."""

    max_bytes: int = 0
    max_tokens: int = 0


@dataclass(frozen=True)
class ModelInfo:
    name: str
    canonical: str
    limits: Limits
    has_prompts: bool


#: fixed values: budgets of known models
KNOWN_LIMITS = {
    "nomic-embed-text": Limits(6000, 2000),
    "nomic-embed-text-v2": Limits(6000, 2000),
    "embeddinggemma": Limits(6000, 2000),
    "bge-reranker-v2-m3": Limits(18000, 6000),
}


@dataclass
class Registry:
    limits: dict[str, Limits] = field(default_factory=lambda: dict(KNOWN_LIMITS))
    aliases: dict[str, str] = field(default_factory=dict)
    task_prompters: dict[str, Callable[[str, Column], Column]] = field(default_factory=dict)
    document_prompters: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    def register_alias(self, alias: str, canonical: str) -> None:
        """The key is folded, the value only trimmed."""
        self.aliases[alias.strip(WHITE).lower()] = canonical.strip(WHITE)

    def reset_aliases(self) -> None:
        self.aliases.clear()

    def register_limits(self, model: str, limits: Limits) -> None:
        self.limits[model] = limits

    def unregister_limits(self, model: str) -> None:
        self.limits.pop(model, None)

    def canonical(self, name: str) -> str:
        """An alias' target, else the name without packaging: case, ``user.``, a tag, a file format."""
        if (own := self.aliases.get(name.strip(WHITE).lower())) is not None:
            return own
        s = name.strip(WHITE).lower().removeprefix("user.")
        if (i := s.find(":")) > 0:
            s = s[:i]
        return s.removesuffix(".gguf").removesuffix("-gguf")

    def _resolve(self, table: dict, model: str):
        """An exact entry wins over the canonical name's."""
        return table.get(model, table.get(self.canonical(model)))

    def lookup_limits(self, model: str) -> Limits:
        return self._resolve(self.limits, model) or Limits()

    def token_budget(self, model: str) -> int:
        return self.lookup_limits(model).max_tokens

    def effective_limits(self, model: str, override: Limits = Limits(), bytes_per_token: float = 0.0) -> Limits:
        """Registered budget, overridden field by field; bytes follow from tokens only where none are set."""
        own = self.lookup_limits(model)
        max_bytes, max_tokens = override.max_bytes or own.max_bytes, override.max_tokens or own.max_tokens
        if max_bytes == 0 and max_tokens > 0:
            max_bytes = int(max_tokens * (bytes_per_token if bytes_per_token > 0 else BYTES_PER_TOKEN))
        return Limits(max_bytes, max_tokens)

    def lookup_model(self, name: str) -> tuple[ModelInfo, bool]:
        """What a name stands for, and whether anything is known of it."""
        from fathomtext.functions.prompts import has_prompts

        limits, prompts = self.lookup_limits(name), has_prompts(self, name)
        return ModelInfo(name, self.canonical(name), limits, prompts), prompts or limits != Limits()

    def check_strict(self, model: str) -> None:
        info, known = self.lookup_model(model)
        if not known:
            raise ValueError(f"embedding: model {model!r} is not recognised (canonical {info.canonical!r}): no prefixes and no budget would apply")


def parse_aliases(source: str, value: str) -> list[tuple[str, str]]:
    """Pairs of a comma-separated list of served=canonical; blank items are skipped."""
    out = []
    for item in value.split(","):
        if not item.strip(WHITE):
            continue
        served, equals, canonical = item.partition("=")
        if not equals or not served.strip(WHITE) or not canonical.strip(WHITE):
            raise ValueError(f"embedding: {source}: {item.strip(WHITE)!r} is not a served=canonical pair")
        out.append((served.strip(WHITE), canonical.strip(WHITE)))
    return out


DEFAULT = Registry()


def canonical_name(name: Column, registry: Registry = DEFAULT) -> Column:
    """Registry.canonical as a Column; aliases become literals of the plan."""
    folded = F.lower(trim_space(name))
    s = F.regexp_replace(folded, r"^user\.", "")
    s = F.regexp_replace(s, r"^([^:]+):(?s:.*)$", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\.gguf\z", ""), r"-gguf\z", "")
    for alias, target in registry.aliases.items():
        s = F.when(folded == alias, F.lit(target)).otherwise(s)
    return s


def model_limits(name: Column, registry: Registry = DEFAULT) -> Column:
    """struct<max_bytes, max_tokens> of a column of model names."""
    canonical = canonical_name(name, registry)
    fields = []
    for f in ("max_bytes", "max_tokens"):
        out = F.lit(0)
        for key in (canonical, name):  # the exact name is looked at first, so it goes outermost
            for model, limits in registry.limits.items():
                out = F.when(key == model, getattr(limits, f)).otherwise(out)
        fields.append(out.cast("int").alias(f))
    return F.struct(*fields)




def strict_error(name: Column, registry: Registry = DEFAULT) -> Column:
    """Registry.check_strict as a Column: why a model isn't recognised, null if it is."""
    from fathomtext.functions.prompts import has_prompts

    canonical, limits = canonical_name(name, registry), model_limits(name, registry)
    prompts = F.lit(False)
    for key in (canonical, name):  # as in model_limits
        for model in registry.task_prompters:
            prompts = F.when(key == model, has_prompts(registry, model)).otherwise(prompts)
    known = prompts | (limits["max_bytes"] != 0) | (limits["max_tokens"] != 0)
    why = F.concat(F.lit("embedding: model '"), name, F.lit("' is not recognised (canonical '"), canonical, F.lit("'): no prefixes and no budget would apply"))
    return F.when(~known, why)
