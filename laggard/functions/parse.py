"""Column expressions for the text columns of direct traces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted keys per resource, first present key wins.
RESOURCE_KEYS = {
    "cpu_request": ("cpus", "cpu"),
    "memory_request": ("memory", "mem"),
    "disk_space_request": ("disk", "disk_space"),
}

# A whole mapping literal; the JSON reader alone would also take a prefix.
_MAPPING = r"(?s)^\{.*\}$"
# Literal forms that JSON spells otherwise, in the order they are rewritten.
_AS_JSON = (
    (r"(:\s*)None(?=\s*[,}])", "$1null"),
    (r"(:\s*)True(?=\s*[,}])", "$1 1.0"),
    (r"(:\s*)False(?=\s*[,}])", "$1 0.0"),
    (r"(?<=[\[(,])(\s*)(?:None|True|False)(?=\s*[,\])])", "$1null"),  # inside a sequence, which is no number anyway
    (r"\(\s*([^(),'\"]*)\s*\)", "$1"),  # one scalar in parentheses is that scalar
    (r"\(", "["),
    (r"\)", "]"),
    (r",(\s*[}\]])", "$1"),
    (r"(?<=[:\[,\s+-])\.(?=[0-9])", "0."),
    (r"(?<=[0-9])\.(?=\s*[,}\]]|[eE])", ".0"),
    (r"(:\s*)\+(?=[0-9])", "$1"),
)


def resource_requests(text: Column) -> dict[str, Column]:
    """cpu, memory and disk out of a text such as ``{'cpus': 0.02, 'memory': 0.014}``.

    The presence of a key decides, not its value: a first key that is None
    gives NULL even when the second key has a number.  Anything but a mapping
    gives NULL for all three.
    """
    body = F.trim(text)
    json = body
    for form, other in _AS_JSON:
        json = F.regexp_replace(json, form, other)
    as_json = F.when(body.rlike(_MAPPING), json)
    entries = F.from_json(as_json, "map<string,string>", {"allowSingleQuotes": "true"})

    def value(first: str, second: str) -> Column:
        raw = F.when(F.map_contains_key(entries, first), F.element_at(entries, F.lit(first))).otherwise(
            F.element_at(entries, F.lit(second))
        )
        return raw.try_cast("double")

    return {name: value(*keys) for name, keys in RESOURCE_KEYS.items()}


# A bracketed literal with content.  One pair of parentheses around a single
# scalar is only grouping, so tuples need a comma.
_FILLED = r"(?s)^(\[\s*[^\s\],].*\]|\{\s*[^\s\},].*\}|\(\s*[^\s\),][^,]*,.*\))$"
# What cannot be a literal: words other than the constants outside quotes.
_BARE_WORD = r"(?<![\w.'\"])(?!(?:True|False|None|e|E|j|b|r|u)\b)[A-Za-z_]\w*(?![\w'\"])"
_BROKEN = r",\s*,|\w\s+\w"
_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""


def constraint_flag(text: Column) -> Column:
    """1.0 for a non-empty list, tuple, set or mapping literal, 0.0 for other text, NULL for NULL."""
    body = F.trim(text)
    unquoted = F.regexp_replace(body, _QUOTED, "0")
    filled = unquoted.rlike(_FILLED) & ~unquoted.rlike(_BARE_WORD) & ~unquoted.rlike(_BROKEN)
    return F.when(body.isNull(), F.lit(None).cast("double")).when(filled, 1.0).otherwise(0.0)
