"""The one scalar helper that is a search rather than an expression."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def first_document(text: str | None) -> str | None:
    """The longest prefix, from the first bracket, that is a JSON value: decoding stops where the value ends."""
    starts = [i for i in ((text or "").find("{"), (text or "").find("[")) if i >= 0]
    if not starts:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, min(starts))
    except ValueError:
        return None
    return text[min(starts) : end]


def _batch(texts: pa.Array) -> pa.Array:
    return pa.array([first_document(t) for t in texts.to_pylist()], pa.string())


_batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
longest_prefix = F.arrow_udf(_batch, StringType())
