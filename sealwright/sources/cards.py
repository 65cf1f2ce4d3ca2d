"""Dataset cards of published tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T


def dataset_features(schema: T.StructType, always: frozenset[str] | set[str] = frozenset()) -> str:
    """The feature list of a card as YAML, in the order of the fields; `always` names the fields that are present and not null.

    Strings that are always there are strings; everything else is json.
    """
    if not schema.fields:
        raise ValueError("a card needs one field at least")
    lines = ["dataset_info:", "  config_name: default", "  features:"]
    for f in schema.fields:
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_-]*", f.name):
            raise ValueError(f"{f.name!r} is not safe in a card")
        sure = isinstance(f.dataType, T.StringType) and (not f.nullable or f.name in always)
        lines += [f"  - name: {f.name}", f"    dtype: {'string' if sure else 'json'}"]
    return "\n".join(lines) + "\n"
