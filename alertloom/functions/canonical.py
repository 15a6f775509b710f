"""Canonical JSON text, byte for byte as Python writes it, and the identifiers of content that hang on it."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def canonical(value: Any) -> str:
    """Keys sorted, ", " and ": " between, non-ASCII escaped, numbers as Python writes them."""
    return json.dumps(value, sort_keys=True, default=str)


def _step(doc: Any, path: str) -> Any:
    for name in path.split(".")[1:]:
        doc = doc.get(name) if isinstance(doc, dict) else None
    return doc


def canonical_items(text: Column, envelopes: tuple[str, ...], inner: str | None = None) -> Column:
    """The canonical texts of a document's items: those of the list, of the list under the first envelope that it has, or of the document itself.

    Of an item that holds something under ``inner`` that is written in its place. A text that is no JSON gives null. Numbers
    keep what the text says (1.0 is not 1), which they don't after a VARIANT; a document is parsed once, in Arrow batches.
    """

    def items(text: str | None) -> list[str] | None:
        try:
            doc = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if doc is None:
            return None
        rows = next((x for x in (_step(doc, e) for e in ("$", *envelopes)) if isinstance(x, list)), [doc])
        held = ((r.get(inner) if inner is not None and isinstance(r, dict) else None, r) for r in rows)
        return [canonical(own if own is not None else r) for own, r in held]

    @F.pandas_udf(ArrayType(StringType()))
    def texts(column: pd.Series) -> pd.Series:
        return column.map(items, na_action=None)

    return texts(text)


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """The canonical text of each JSON text, null for what is none."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


def content_id(prefix: str, text: Column, n: int = 16) -> Column:
    """The prefix and the first characters of the SHA-256 of a canonical text."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, n))
