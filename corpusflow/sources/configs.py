"""Routing and repository files: a small YAML subset as Python values, and what the operators take of it.

Mappings by indentation, lists of ``- `` items, inline maps and lists, scalars in quotes or not; # begins a
comment on a line of its own. These files are read on the driver: they are a user's configuration.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_PAIR = re.compile(r"^(\"[^\"]*\"|'[^']*'|[^:\"']+):(?:\s+(.*))?$")


def _scalar(text: str):
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in _parts(text[1:-1])]
    if text[:1] == "{" and text[-1:] == "}":
        return {k: v for k, v in (_pair(x) for x in _parts(text[1:-1]))}
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _parts(text: str) -> list[str]:
    """Split at commas that are neither in quotes nor in brackets."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _pair(text: str) -> tuple[str, object]:
    key, _, value = text.partition(":")
    return str(_scalar(key)), _scalar(value)


def read(lines: Iterable[str]):
    """The file's value: nested dicts and lists of text."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in lines if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int) -> tuple[object, int]:
        many = rows[i][1].startswith("- ")
        out: object = [] if many else {}
        while i < len(rows) and rows[i][0] >= indent:
            depth, text = rows[i]
            if depth > indent or text.startswith("- ") != many:
                i += 1  # a line that belongs to nothing
            elif many:
                rest = text[2:].strip()
                if (m := _PAIR.match(rest)) and rest[:1] not in "[{\"'":
                    rows[i] = (depth + 2, rest)  # the item is a mapping that begins here
                    value, i = block(i, depth + 2)
                else:
                    value, i = _scalar(rest), i + 1
                out.append(value)
            else:
                m, i = _PAIR.match(text), i + 1
                if not m:
                    continue
                key, rest = str(_scalar(m[1])), m[2]
                if rest:
                    out[key] = _scalar(rest)
                elif i < len(rows) and (rows[i][0] > depth or rows[i][0] == depth and rows[i][1].startswith("- ")):
                    out[key], i = block(i, rows[i][0])
                else:
                    out[key] = ""
        return out, i

    return block(0, rows[0][0])[0] if rows else {}


def mail_routes(spark: SparkSession, lines: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(domains (domain, route), labels (ordinal, label, route)) for records.route_mail."""
    found = read(lines)
    labels = [(i, x["label"], x["route"]) for i, x in enumerate(found.get("label_routes") or []) if isinstance(x, dict) and x.get("label") and x.get("route")]
    domains = [(k, v) for k, v in (found.get("domain_routes") or {}).items() if v]
    return spark.createDataFrame(domains, "domain string, route string"), spark.createDataFrame(labels, "ordinal int, label string, route string")


def channel_routes(spark: SparkSession, lines: Iterable[str]) -> tuple[DataFrame, str]:
    """(routes (channel, route), the route of direct messages) for captures.chat_records."""
    found = read(lines)
    rows = [(x["channel"], x["route"]) for x in found.get("channel_routes") or [] if isinstance(x, dict) and x.get("channel") and x.get("route")]
    return spark.createDataFrame(rows, "channel string, route string"), found.get("dm_route") or "_dms"


def repositories(lines: Iterable[str]) -> tuple[str, list[str]]:
    """(owner, names of repositories that aren't switched off)."""
    found = read(lines)
    return found.get("owner") or "", [x["name"] for x in found.get("repos") or [] if isinstance(x, dict) and x.get("name") and str(x.get("enabled", "")).lower() != "false"]


def board_routes(spark: SparkSession, lines: Iterable[str], section: str = "monday_routes") -> DataFrame:
    """(board, folder, tags) of a routing file's section."""
    rows = [(k, v.get("folder") or None, v.get("tags") if isinstance(v.get("tags"), list) else []) for k, v in (read(lines).get(section) or {}).items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "board string, folder string, tags array<string>")


def seeds(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities (type, name, canonical_id, description), patterns (entity, pattern), aliases (alias,
    client)) of a JSON file of seeds."""
    data = json.loads(text)
    kinds = [(kind, x) for key, kind in (("products", "product"), ("technologies", "technology")) for x in data.get(key) or []]
    entities = [(kind, x["name"], x["canonical_id"], x.get("description") or "") for kind, x in kinds]
    patterns = [(x["canonical_id"], f"(?i){p}") for _, x in kinds for p in x.get("patterns") or []]
    return spark.createDataFrame(entities, "type string, name string, canonical_id string, description string"), spark.createDataFrame(patterns, "entity string, pattern string"), spark.createDataFrame(list((data.get("client_aliases") or {}).items()), "alias string, client string")
