"""Labels given by people or language models: reading, wrapping, checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ten classes of the policy field, in their order
FIELDS = ["unemployment", "retirement", "sickness/health/care", "disability", "survivors", "family/children", "housing", "labour market", "taxes", "none"]
NO_SECOND = "na"


def wrap(values: Column, coder: Column, date: Column) -> Column:
    """Flat map to a map of ``(value, coder, date)``."""
    return F.transform_values(values, lambda k, v: F.struct(v.alias("value"), coder.alias("coder"), date.alias("date")))


def unwrap(labels: Column, field: str) -> Column:
    """The value of a field of a wrapped map; null for an absent field."""
    return F.element_at(labels, F.lit(field))["value"]


def has(labels: Column, field: str) -> Column:
    """Whether the field is there at all (null maps have none)."""
    return F.coalesce(F.map_contains_key(labels, field), F.lit(False))


def flag(v: Column) -> Column:
    """0/1 from the texts ``0``, ``1``, ``true``, ``false`` in any case; everything else, ``1.0`` included, is null."""
    t = F.lower(F.trim(v.cast("string")))
    return F.when(t.isin("1", "true"), 1).when(t.isin("0", "false"), 0)


def variant_flag(v: Column) -> Column:
    """0/1 from a variant by its type: whole numbers 0 and 1, booleans, the strings "0" and "1"; all else null."""
    kind = F.schema_of_variant(v)
    n = F.try_variant_get(v, "$", "bigint")
    s = F.try_variant_get(v, "$", "string")
    return F.when(kind == "BIGINT", F.when(n.isin(0, 1), n.cast("int"))).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).when(kind == "STRING", F.when(s == "1", 1).when(s == "0", 0))


def label_set(first: Column, second: Column, classes: list[str] = FIELDS) -> Column:
    """Set of the valid labels; null if the first is none. An invalid second is left out, equal ones count once."""
    return F.when(first.isin(classes), F.array_distinct(F.filter(F.array(first, second), lambda x: x.isin(classes))))


def normal_label(v: Column, present: Column) -> Column:
    """Lower case without outer blanks; null, empty, ``none`` and ``null`` become ``na``; an absent label is null."""
    t = F.lower(F.trim(v))
    return F.when(present, F.when(t.isNull() | t.isin("", "none", "null"), F.lit("na")).otherwise(t))


def compliant(labels: Column, required: Column, batch: Column, classes: list[str] = FIELDS) -> Column:
    """Whether a label map has all ``required`` keys, a valid first field, a valid or no second, and (in batch scope) a 0/1 flag.

    A null map is not compliant. Dates are not checked.
    """
    keys = F.forall(required, lambda k: F.map_contains_key(labels, k))
    first = unwrap(labels, "social_policy_field_1").isin(classes)
    second = unwrap(labels, "social_policy_field_2").isin([*classes, NO_SECOND])
    crisis = ~batch | flag(unwrap(labels, "crisis_ref")).isNotNull()
    return F.coalesce(keys & first & second & crisis, F.lit(False))


def first_object(raw: Column) -> Column:
    """The JSON object in a response, as text: decoded from the first brace, whatever follows it, else in a fenced block, else null.

    The JSON parser reads one value and leaves the rest alone, so nesting, braces in strings and braces in the tail need no
    pattern. An array or a bare value is no object.
    """
    at = F.instr(raw, "{")
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)

    def valid(c):
        v = F.try_parse_json(F.nullif(c, F.lit("")))
        return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.to_json(v))

    return F.coalesce(F.when(at > 0, valid(F.substr(raw, at))), valid(fenced))


def recode(c: Column, names: dict[str, str]) -> Column:
    """Display label of a value; a value without one gives null."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def by_alias(labels: Column, names: list[str]) -> tuple[Column, Column]:
    """(value, is_present) of the first of ``names`` that the map has; a value that is there and null is present."""
    value, present = F.lit(None).cast("string"), F.lit(False)
    for n in reversed(names):
        value = F.when(has(labels, n), unwrap(labels, n)).otherwise(value)
        present = has(labels, n) | present
    return value, present


def prompt_factors(key: Column) -> dict[str, Column]:
    """The four two-valued dimensions of a prompt key, by parts of its name."""
    return {
        "shot": F.contains(key, F.lit("few")).cast("int"),
        "scope": F.contains(key, F.lit("single")).cast("int"),
        "def": F.contains(key, F.lit("def")).cast("int"),
        "jus": F.contains(key, F.lit("jus")).cast("int"),
    }


def problems(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that fail (a null check fails)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(msg)) for ok, msg in checks]))


def is_article(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\p{N}+[a-zA-Z]?$"), F.lit(False))
