"""Parsing of model responses: which repair a response needed and whether its scores are in order.

Tags depend on Python's own JSON rules (``NaN`` and repeated keys pass, trailing text doesn't), which the JVM parsers
don't share, so this is an Arrow function; the scores are then read natively from the normalised payload.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCORE_FIELDS

TAGS = ("raw_valid_json", "extracted_embedded_json", "repaired_json", "schema_invalid", "unparseable", "empty")
SCHEMA = "payload string, repair_type string, schema_valid boolean, schema_errors array<string>"

# The patterns and characters that decide which repair a response counts as.
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
_STRING = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)', re.S)
_PLAIN = {0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'", 0xA0: " "}


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):  # no JSON, or nested too deeply to read
        return None
    return found if isinstance(found, dict) else None


def close_brackets(text: str) -> str:
    bare = _STRING.sub("", text)
    return text + "]" * max(0, bare.count("[") - bare.count("]")) + "}" * max(0, bare.count("{") - bare.count("}"))


def _mended(text: str) -> dict | None:
    text = re.sub(r",\s*([}\]])", r"\1", text)
    found = _object(text)
    return found if found is not None else _object(close_brackets(text))


def schema_errors(payload: dict) -> list[str]:
    """What is missing, no number or out of 0 to 10 among the scores, at the top or under OUTCOME."""
    nested = payload.get("OUTCOME")
    have = payload | nested if isinstance(nested, dict) else payload
    errors = []
    for name in SCORE_FIELDS:
        try:
            if not 0 <= float(have[name]) <= 10:
                errors.append(f"out_of_range:{name}")
        except KeyError:
            errors.append(f"missing:{name}")
        except OverflowError:  # an integer beyond any double
            errors.append(f"out_of_range:{name}")
        except (TypeError, ValueError):
            errors.append(f"non_numeric:{name}")
    return errors


def parse(text: str | None) -> tuple[str | None, str, bool, list[str]]:
    """(payload as JSON text, tag, whether the schema holds, its errors)."""
    text = (text or "").strip()
    if not text:
        return None, "empty", False, []
    text = text.translate(_PLAIN)
    if m := _FENCE.search(text):
        text = m[1].strip()
    braces = re.search(r"\{.*\}", text, re.S)
    inner = braces[0] if braces else text
    for tag, attempt in (("raw_valid_json", lambda: _object(text)), ("extracted_embedded_json", lambda: _object(inner) if braces else None), ("repaired_json", lambda: _mended(inner))):
        payload = attempt()
        if payload is not None:
            errors = schema_errors(payload)
            return json.dumps(payload), "schema_invalid" if errors else tag, not errors, errors
    return None, "unparseable", False, []


def parse_response(text: Column | str) -> Column:
    """``struct<payload, repair_type, schema_valid, schema_errors>`` of a response."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in texts], columns=["payload", "repair_type", "schema_valid", "schema_errors"])

    return run(text)


def flattened(payload: Column, depth: int = 3) -> Column:
    """``map<string, string>`` of an object's values by dotted path; objects are entered ``depth`` deep, lists stay as JSON text."""
    found = F.map_entries(F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>")))
    if depth <= 1:
        return F.map_from_entries(found)

    def entered(e: Column) -> Column:
        inner = F.map_entries(flattened(e["value"], depth - 1))
        below = F.transform(inner, lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(F.startswith(F.ltrim(e["value"]), F.lit("{")) & (F.size(inner) > 0), below).otherwise(F.array(e))

    return F.map_from_entries(F.flatten(F.transform(found, entered)))


def payload_number(payload: Column, name: str, nested: bool = False) -> Column:
    """A score of the payload's top level, and under OUTCOME too if asked for; null where it is no number."""
    from .scores import to_number

    top = to_number(F.get_json_object(payload, f"$['{name}']"))
    return F.coalesce(top, to_number(F.get_json_object(payload, f"$.OUTCOME['{name}']"))) if nested else top
