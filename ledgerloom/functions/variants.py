"""Dynamic JSON values: absent, null, empty and falsy are four different things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import parse_number
from .text import strip


def parse_json(c: Column) -> Column:
    """VARIANT of a JSON text; null if it cannot be parsed."""
    return F.try_parse_json(c)


def member(v: Column, name: str) -> Column:
    """The member as VARIANT; null only if it is absent."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def members(v: Column, *names: str, **typed: str) -> Column:
    """struct of an object's members, as VARIANT or as typed says; null for what is no object.

    A VARIANT member is null only if it is absent. All are taken in one pass, and what they stand in is not copied for each.
    """
    return v.try_cast(members_type(*names, **typed))


def members_type(*names: str, **typed: str) -> str:
    return f"struct<{', '.join([f'{n}:variant' for n in names] + [f'{n}:{t}' for n, t in typed.items()])}>"


def names(v: Column) -> Column:
    """Names of an object's members; null for what is no object."""
    return F.map_keys(v.try_cast("map<string,struct<>>"))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, NUMBER, NULL (JSON null) or null (absent)."""

    def found(x: Column) -> Column:
        # only scalars are asked for their schema; a container's would walk all of it
        return F.when(x.isNotNull(), F.when(is_object(x), "OBJECT").when(is_array(x), "ARRAY").otherwise(_scalar(x)))

    return let(v, found)


def _scalar(v: Column) -> Column:
    """The kind of a scalar; of a container NUMBER."""
    told = F.create_map(*(F.lit(x) for x in ("STRING", "STRING", "BOOLEAN", "BOOLEAN", "VOID", "NULL")))
    return F.coalesce(F.try_element_at(told, F.schema_of_variant(v)), F.lit("NUMBER"))


def is_object(v: Column) -> Column:
    # a struct without fields: members are not made
    return v.try_cast("struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return v.try_cast("array<struct<>>").isNotNull()


def let(v: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    # of no elements an aggregation is its start; unlike transform it copies nothing
    return F.aggregate(F.array(), v, lambda a, _: a, f)


def text(v: Column) -> Column:
    """A scalar's or structure's text; null for absent and JSON null."""
    return v.try_cast("string")


def number(v: Column) -> Column:
    """A double: numbers and booleans as they are, texts by their digits, all else null."""

    def parsed(x: Column, k: Column) -> Column:
        # null and containers make no double; of a text only digits count, so that white space around it needs no care
        return F.when(k == "STRING", parse_number(x.try_cast("string"))).when(k == "BOOLEAN", x.try_cast("boolean").cast("double")).otherwise(x.try_cast("double"))

    return let(F.struct(v.alias("x"), F.schema_of_variant(v).alias("k")), lambda s: parsed(s["x"], s["k"]))


def is_number(v: Column) -> Column:
    """Numbers and booleans, but not numeric texts."""
    return F.coalesce(kind(v).isin("NUMBER", "BOOLEAN"), F.lit(False))


#: A text that is a number as a whole.
NUMERIC_TEXT = r"^[+-]?(?:\d+\.?\d*|\d*\.\d+)$"


def _container(schema: Column) -> Column:
    return schema.startswith("OBJECT<") | schema.startswith("ARRAY<")


def numeric_kind(schema: Column) -> Column:
    """Whether the text of a schema, as `schema_of_variant` gives it, is that of a number or boolean."""
    return ~(schema.isin("STRING", "VOID") | _container(schema))


def filled(v: Column) -> Column:
    """Whether an object or array holds anything; null for what is neither."""
    return F.coalesce(F.size(names(v)) > 0, F.size(v.try_cast("array<struct<>>")) > 0)


def truthy(v: Column) -> Column:
    """Neither absent, null, false, zero, nor empty."""

    def full(x: Column) -> Column:
        # a scalar's JSON text tells all falsy ones apart
        scalar = ~F.to_json(x).isin('""', "null", "false") & ~F.coalesce((_scalar(x) == "NUMBER") & (x.try_cast("double") == 0), F.lit(False))
        return F.when(x.isNotNull(), F.coalesce(F.when(is_object(x) | is_array(x), filled(x)), scalar, F.lit(False))).otherwise(False)

    return let(v, full)


def first_truthy(*values: Column) -> Column:
    """The first truthy value, else the last one as it is."""
    if len(values) == 1:
        return values[0]
    return F.coalesce(F.try_element_at(F.filter(F.array(*values[:-1]), truthy), F.lit(1)), values[-1])


def present(v: Column, numeric: bool = False, collection: bool = False, numeric_text: bool = False) -> Column:
    """Filled in: a non-blank text (looking numeric, if asked), or what the flags allow."""

    def judged(x: Column, k: Column) -> Column:
        if numeric_text:
            full = strip(x.try_cast("string")).rlike(NUMERIC_TEXT)
        else:
            full = x.try_cast("string").rlike(r"(?U)[^\s\x1c-\x1f]")  # any sign but white space
        found = F.when(k == "STRING", full)
        if collection:
            found = found.when(_container(k), filled(x))
        return found.otherwise(numeric_kind(k) if numeric else F.lit(False))

    # asked for its schema alone, a value is opened once; of a list, which it would walk, only whether it is one
    schema = F.when(is_array(v), "ARRAY<").otherwise(F.schema_of_variant(v)) if collection else F.schema_of_variant(v)
    return F.coalesce(let(F.struct(v.alias("x"), schema.alias("k")), lambda s: judged(s["x"], s["k"])), F.lit(False))


def items(v: Column) -> Column:
    """array<variant> of a JSON array; empty for anything else."""
    return F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>"))
