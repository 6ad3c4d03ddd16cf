"""Names, limits and schemas of the normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
PARSER_VERSION = 1

#: Fixed values.
KINDS = ("prompt", "say", "think", "tool", "fail", "note")
PROSE_KINDS = ("prompt", "say", "think", "note")
PROMPT_LIMIT, PROSE_LIMIT, OPENING, COMPLEX = 200, 96, 90, 700

EVENTS = (
    "source STRING, session STRING, seq BIGINT, uid STRING, ts TIMESTAMP, role STRING, kind STRING, tool STRING, raw STRING, gist STRING, "
    "gist_src STRING, outcome STRING, is_error BOOLEAN, tokens BIGINT, content_hash STRING, parser_version INT"
)
SESSIONS = (
    "id STRING, source STRING, title STRING, path STRING, project STRING, branch STRING, modified TIMESTAMP, bytes BIGINT, assistant_last BOOLEAN, "
    "first_ts TIMESTAMP, last_ts TIMESTAMP, seen BIGINT, parser_version INT"
)
GISTS = "hash STRING, gist STRING, model STRING, created TIMESTAMP, tok_in BIGINT, tok_out BIGINT"


def require_version(df: DataFrame) -> DataFrame:
    """``df``, read from an archive; ValueError if a newer program wrote it."""
    newest = df.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > SCHEMA_VERSION:
        raise ValueError(f"the archive has schema version {newest}, this program knows {SCHEMA_VERSION}")
    return df
