"""Content identity and display labels of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglathe.schema import COMPLEX, PROSE_KINDS

#: Fixed values of the content hash: format version, and labels by kind.
VERSION = 2
LABELS = {"prompt": "you", "say": "claude", "think": "think", "fail": "fail", "note": "note"}


def label(kind: Column, tool: Column) -> Column:
    out = F.when(kind == "tool", tool)
    for k, v in LABELS.items():
        out = out.when(kind == k, v)
    return out


def is_complex(kind: Column, raw: Column) -> Column:
    return (kind == "say") & (F.length(raw) > COMPLEX)


def content_hash(kind: Column, tool: Column, raw: Column) -> Column:
    """16 hexadecimal digits of sha-256 over label, version byte, complexity byte and text: equal
    for equal text anywhere."""
    flag = F.when(is_complex(kind, raw), "01").otherwise("00")
    data = F.concat(label(kind, tool).cast("binary"), F.unhex(F.lit(f"{VERSION:02x}")), F.unhex(flag), raw.cast("binary"))
    return F.substring(F.sha2(data, 256), 1, 16)


def needs_model(kind: Column) -> Column:
    return kind.isin(*PROSE_KINDS)
