"""Columns over model replies (JSON text) and over open-keyed figures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import text as X

LINES = "(?mdU)"
QUOTES = "array<struct<speaker:string,theme:string,text:string>>"
NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
NEWS = "array<struct<date:string,source:string,headline:string,snippet:string,tags:array<string>>>"


def strip_fences(reply: Column) -> Column:
    opened = F.regexp_replace(reply, LINES + V.FENCE_OPEN, "")
    return X.strip(F.regexp_replace(opened, LINES + V.FENCE_CLOSE, ""))


def _parsed_as(reply: Column, kind: str) -> Column:
    """The reply's only JSON value, if it is of the kind.

    The parser stops after a first value, so the reply is parsed inside a list, where a second value or any other
    text breaks it, and inside an object, which a reply that closes the list itself breaks. A repeated key and a bare
    ``NaN`` are errors as well.
    """

    def only(body: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
        keyed = F.try_parse_json(F.concat(F.lit('{"k":'), body, F.lit("}")))
        value = F.try_variant_get(listed, "$[0]", "variant")
        alone = keyed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
        return F.when(alone & F.schema_of_variant(value).startswith(kind), value)

    # a list of one binds the text, which is used twice
    return F.get(F.transform(F.array(strip_fences(reply)), only), F.lit(0))


def as_object(reply: Column) -> Column:
    """The reply as a variant when it is a JSON object; null for anything else."""
    return _parsed_as(reply, "OBJECT")


def as_array(reply: Column) -> Column:
    """The reply as a variant when it is a JSON array; null for anything else."""
    return _parsed_as(reply, "ARRAY")


def has_key(value: Column, key: str) -> Column:
    """True when the key is there, an explicit null included."""
    return F.try_variant_get(value, f"$.{key}", "variant").isNotNull()


def field(value: Column, key: str, kind: str, missing: Column) -> Column:
    """A field of an object reply; ``missing`` stands in only when the key is absent."""
    return F.when(has_key(value, key), F.try_variant_get(value, f"$.{key}", kind)).otherwise(missing)


def empty(kind: str) -> Column:
    """An empty array or map of a type."""
    return F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)


def figures(reply: Column) -> Column:
    """An object reply as a map of texts; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(as_object(reply), "$", "map<string,string>"), empty("map<string,string>"))


def news_items(reply: Column) -> Column:
    """An array reply as news items; an empty list for anything else."""
    return F.coalesce(F.try_variant_get(as_array(reply), "$", NEWS), empty(NEWS))


def _escaped_char(char: Column) -> Column:
    point = F.ascii(char)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = F.floor((point - 0x10000) / 0x400) + 0xD800
    low = (point - 0x10000) % 0x400 + 0xDC00
    return F.when(point < 128, char).when(point < 0x10000, unit(point)).otherwise(F.concat(unit(high), unit(low)))


def json_text(value: Column) -> Column:
    """A quoted JSON string in ASCII, other characters as ``\\uXXXX``."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    quoted = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    ascii_only = F.array_join(F.transform(F.split(quoted, ""), _escaped_char), "")
    return F.when(quoted.rlike(r"[^\x00-\x7f]"), ascii_only).otherwise(quoted)


def metric_number(value: Column) -> Column:
    """A figure as a number when it is written as JSON writes numbers (``NaN`` or ``4680d`` are texts)."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def metric_flag(value: Column) -> Column:
    return F.when(value == "true", True).when(value == "false", False)


def metric_text(value: Column) -> Column:
    return F.when(metric_number(value).isNull() & metric_flag(value).isNull(), value)


def figures_json(figures_map: Column) -> Column:
    """Figures as JSON with two blanks of indent, keys in their own order, nulls kept.

    Numbers with a point are shown the shortest way: 0.50 as 0.5.
    """

    def line(entry: Column) -> Column:
        value = entry["value"]
        shown = (
            F.when(value.isNull(), F.lit("null"))
            .when(metric_number(value).isNotNull() & value.rlike("[.eE]"), X.float_text(value))
            .when(metric_text(value).isNull(), value)
            .otherwise(json_text(value))
        )
        return F.concat(F.lit("  "), json_text(entry["key"]), F.lit(": "), shown)

    lines = F.transform(F.map_entries(figures_map), line)
    body = F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return F.when(F.size(lines) == 0, F.lit("{}")).otherwise(body)
