"""Strict JSON parsing into an envelope.

No built-in parser accepts and rejects exactly what strict parsing does
(repeated keys, NaN, text after the value), so this one step is an Arrow UDF.
Everything after it works on the map column with built-in functions.
"""

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from inspectlake.functions.text import normalize_response

PARSED = (
    Y.StructType()
    .add("ok", Y.BooleanType())
    .add("kind", Y.StringType())
    .add("data", Y.MapType(Y.StringType(), Y.StringType()))
    .add("kinds", Y.MapType(Y.StringType(), Y.StringType()))
    .add("error", Y.StringType())
)
_MAP = pa.map_(pa.string(), pa.string())
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}


def _as_text(value):
    """Strings as they are, null as null, any other value as compact JSON text."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _storable(text):
    """A lone surrogate escape is valid JSON but has no UTF-8 form."""
    return text if text is None else text.encode("utf-8", "replace").decode("utf-8")


def _parse(text):
    if text is None:
        return False, None, None, None, "no response"
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        return False, None, None, None, str(e)
    kind = _KINDS.get(type(value), "null")
    data = kinds = None
    if kind == "object":
        data = [(_storable(k), _storable(_as_text(v))) for k, v in value.items()]
        kinds = [(_storable(k), _KINDS.get(type(v), "null")) for k, v in value.items()]
    return True, kind, data, kinds, None


def _parse_all(texts: pa.Array) -> pa.Array:
    rows = [_parse(t) for t in texts.to_pylist()]
    ok, kind, data, kinds, error = zip(*rows) if rows else ((), (), (), (), ())
    return pa.StructArray.from_arrays(
        [
            pa.array(ok, pa.bool_()),
            pa.array(kind, pa.string()),
            pa.array(data, _MAP),
            pa.array(kinds, _MAP),
            pa.array(error, pa.string()),
        ],
        ["ok", "kind", "data", "kinds", "error"],
    )


# Declared non-deterministic only so that the optimizer never repeats it below
# a filter on its own result.
parse_json = F.arrow_udf(_parse_all, PARSED).asNondeterministic()


def parse_envelope(responses, raw="raw_response"):
    """Add ``success, kind, data, kinds, error`` for a column of raw responses.

    ``kind`` tells an object from other JSON values; only an object has
    ``data``, a map in which a key with a null value differs from no key.
    ``kinds`` has the JSON kind of every value, so that the text ``[1]`` and
    the list ``[1]`` stay apart.
    """
    parsed = responses.withColumn("_p", parse_json(normalize_response(F.col(raw))))
    return parsed.select(
        *responses.columns,
        F.col("_p.ok").alias("success"),
        F.col("_p.kind").alias("kind"),
        F.col("_p.data").alias("data"),
        F.col("_p.kinds").alias("kinds"),
        F.concat(F.lit("JSON parsing failed: "), F.col("_p.error")).alias("error"),
    )


def parse_llm_response(responses, raw="raw_response"):
    """Add ``data`` for responses taken as they are, without unwrapping.

    Text that does not parse becomes a map of ``raw_response`` and ``error``.
    """
    parsed = responses.withColumn("_p", parse_json(F.col(raw)))
    fallback = F.create_map(
        F.lit("raw_response"), F.col(raw), F.lit("error"), F.lit("Failed to parse JSON")
    )
    return parsed.select(
        *responses.columns,
        F.col("_p.ok").alias("success"),
        F.col("_p.kind").alias("kind"),
        F.when(F.col("_p.ok"), F.col("_p.data")).otherwise(fallback).alias("data"),
    )


def given(data, key, default=None):
    """``data[key]``, or the default only when the key is absent."""
    value = F.try_element_at(data, F.lit(key))
    if default is None:
        return value
    return F.when(F.map_contains_key(data, key), value).otherwise(F.lit(default))


def text_list(value, kind="array"):
    """A list column from the text of a JSON value of that kind; a value that is no list becomes one item."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    items = F.from_json(value, "array<string>")
    return F.when(value.isNull(), None).when(kind == "array", items).otherwise(F.array(value))
