"""Text functions: blanks, previews, token estimates, JSON in free text, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def is_blank(text: Column) -> Column:
    """Empty or white space alone, by Unicode's white space and the four separators 1C-1F."""
    return text.rlike(BLANK)


def token_count(text: Column) -> Column:
    """The tokenizer-free estimate: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def truncate_to_tokens(text: Column, most: int) -> Column:
    """Text of over ``most`` estimated tokens cut at 0.9 of its share, with an ellipsis; else as it is."""
    n = token_count(text)
    keep = F.floor(F.lit(float(most)) * (F.length(text).cast("double") / n.cast("double")) * F.lit(0.9)).cast("int")
    return F.when(n > most, F.concat(F.substring(text, F.lit(1), keep), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int = 100) -> Column:
    """First n characters on one line, an ellipsis if there are more."""
    flat = F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > n, F.concat(flat, F.lit("..."))).otherwise(flat)


def json_object_text(text: Column) -> Column:
    """From the first opening to the last closing brace; empty without such."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def strip_fences(text: Column) -> Column:
    """A reply without its code fences."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def structured(reply: Column, ddl: str, allowed: dict[str, list] | None = None) -> Column:
    """A reply without fences as a struct of the given fields; null unless it is an object that fits them (see ``reply_fault``)."""
    return F.when(reply_fault(reply, ddl, allowed).isNull(), _parsed(reply, ddl)[0])


def _parsed(reply: Column, ddl: str) -> tuple[Column, Column, T.StructType]:
    """The reply's value without its marker, the marker of a broken one, and the fields."""
    fields = T.StructType.fromDDL(ddl)
    read = T.StructType([*fields.fields, T.StructField(BROKEN, T.StringType())])
    value = F.from_json(strip_fences(reply), read, {"columnNameOfCorruptRecord": BROKEN})
    return F.struct(*[value[f.name].alias(f.name) for f in fields]), value[BROKEN], fields


BROKEN = "_corrupt_record"


def reply_fault(reply: Column, ddl: str, allowed: dict[str, list] | None = None) -> Column:
    """The path of the first fault of a reply, null where there is none.

    Fields, to any depth, are required unless their type says otherwise by a comment ``optional``; elements of arrays and values
    of maps must not be null; ``allowed`` names the values that a path may have (``[]`` stands for every element). ``$``: the
    reply is no object, or has a value of another type than asked for. ``$.a[2].b``: that value is missing or not allowed.
    """
    value, broken, fields = _parsed(reply, ddl)
    faults = [_fault(value[f.name], f, F.lit(f"$.{f.name}"), f"$.{f.name}", allowed or {}) for f in fields]
    empty = F.regexp_extract(strip_fences(reply), r"(?s)^\{.*\}$", 0) == ""
    return F.when(reply.isNull() | empty | broken.isNotNull(), F.lit("$")).otherwise(F.coalesce(*faults))


def _fault(value: Column, spec: T.StructField, path: Column, name: str, allowed: dict[str, list]) -> Column:
    """The first fault in a value, or null; a missing value is one unless it is optional."""
    none, kind = F.lit(None).cast("string"), spec.dataType
    inside = none
    if isinstance(kind, T.StructType):
        inside = F.coalesce(*[_fault(value[f.name], f, F.concat(path, F.lit(f".{f.name}")), f"{name}.{f.name}", allowed) for f in kind])
    elif isinstance(kind, T.ArrayType):
        item = T.StructField("", kind.elementType)
        each = F.transform(value, lambda x, i: _fault(x, item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), f"{name}[]", allowed))
        inside = F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))
    elif isinstance(kind, T.MapType):
        inside = F.when(F.exists(F.map_values(value), lambda x: x.isNull()), path)
    elif name in allowed:
        inside = F.when(~value.isin(allowed[name]), path)
    optional = (spec.metadata or {}).get("comment") == "optional"
    return F.when(value.isNull(), none if optional else path).otherwise(inside)


def sanitised(name: Column) -> Column:
    return F.translate(name, "/\\", "__")


def channel_name(name: Column, channel_id: Column, is_im: Column, is_mpim: Column) -> Column:
    """The display name; direct and group messages are named by their id."""
    no = F.lit(False)
    return (
        F.when(F.coalesce(is_im, no), F.concat(F.lit("dm_"), channel_id))
        .when(F.coalesce(is_mpim, no), F.concat(F.lit("group_dm_"), channel_id))
        .otherwise(F.coalesce(name, channel_id))
    )


def for_embedding(text: Column, most: int | None = None) -> Column:
    """A blank becomes one space; some models take only so many characters."""
    filled = F.when(is_blank(text), F.lit(" ")).otherwise(text)
    return filled if most is None else F.substring(filled, 1, most)


def squashed(score: Column, scale: float = 5.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score / F.lit(scale)))
