"""Typed key/value attributes and oneof numbers of telemetry records."""

from functools import reduce

from pyspark.sql import functions as F

# The typed fields of one attribute value.
VALUE_FIELDS = [
    "stringValue", "boolValue", "intValue", "doubleValue", "bytesValue",
    "arrayValue", "kvlistValue",
]


def exactly_one(columns):
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]) == 1


def attribute_problem(entries):
    """Reason why an attribute list cannot be read, NULL when it can."""
    keys = F.transform(entries, lambda e: e["key"])
    bad = F.exists(
        entries, lambda e: ~F.coalesce(exactly_one([e["value"][f] for f in VALUE_FIELDS]), F.lit(False))
    )
    unread = F.exists(
        entries,
        lambda e: e["value"]["intValue"].isNotNull()
        & e["value"]["intValue"].try_cast("bigint").isNull(),
    )
    return (
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate attribute key")
        .when(bad, "attribute value must have exactly one field")
        .when(unread, "attribute value is not a whole number")
    )


def attribute_map(entries):
    """Array of ``{key, value: {...}}`` to a key-sorted map of JSON texts.

    Numbers are bare, texts quoted, lists and nested maps kept as JSON. A list with
    a problem gives NULL; ``attribute_problem`` says why.
    """
    def text(v):
        quoted = F.to_json(F.array(F.coalesce(v["stringValue"], v["bytesValue"])))
        return F.coalesce(
            F.when(
                v["stringValue"].isNotNull() | v["bytesValue"].isNotNull(),
                F.substring(quoted, F.lit(2), F.length(quoted) - 2),
            ),
            v["boolValue"].cast("string"),
            v["intValue"].try_cast("bigint").cast("string"),
            v["doubleValue"].cast("string"),
            v["arrayValue"], v["kvlistValue"],
        )

    pairs = F.transform(entries, lambda e: F.struct(e["key"], text(e["value"])))
    empty = F.create_map().cast("map<string,string>")
    built = F.when(attribute_problem(entries).isNull(), F.map_from_entries(F.array_sort(pairs)))
    return F.when(entries.isNull(), empty).otherwise(built)


def text_attribute(attributes, key, default=""):
    """Plain text of a string attribute of a JSON-text map."""
    raw = F.element_at(attributes, key)
    plain = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 0)
    return F.coalesce(plain, F.lit(default))


def number_fields(point):
    """``int_value``, ``double_value`` and ``number_ok`` of a number data point.

    Whole numbers stay LONG, to be differenced before any cast. A point flagged
    as having no recorded value may lack both.
    """
    as_int = point["asInt"].try_cast("bigint")
    as_double = point["asDouble"].try_cast("double")
    one = exactly_one([point["asInt"], point["asDouble"]])
    flagged = F.coalesce(point["flags"], F.lit(0)).bitwiseAND(1) == 1
    readable = (as_int.isNotNull() | as_double.isNotNull())
    neither = point["asInt"].isNull() & point["asDouble"].isNull()
    return as_int, as_double, (one & readable) | (flagged & neither)


def numeric_attribute(json_text, path):
    """A number at a JSON path, NULL for booleans, texts and absent keys."""
    v = F.try_parse_json(json_text)
    number = F.try_variant_get(v, path, "double")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), number)
