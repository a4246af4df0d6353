"""The driver's tables as the corpus views that the operators work on.

Each view is one SQL text for both engines but where their functions differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

_DAY = "date_add(DATE '2024-01-01', cast({} as int))"
_DAY_DUCK = "(DATE '2024-01-01' + cast({} as int))"
_FOLDER = "CASE doc_id % 4 WHEN 0 THEN '20 - Projects' WHEN 1 THEN '30 - Areas' WHEN 2 THEN '40 - Resources' ELSE 'raw/' || source END"
_NOTE = """
    '---' || chr(10) || 'type: ' || CASE WHEN doc_id % 5 = 0 THEN 'meeting' ELSE 'raw-doc' END || chr(10) || 'date: ' || cast({day} as {string}) || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'lang: ' || coalesce(lang, '') || chr(10) END
    || 'tags: [doc, thread/t' || cast(doc_id % 7 as {string}) || ']' || chr(10)
    || 'attendees:' || chr(10) || '- ada.lovelace' || cast(doc_id % 11 as {string}) || '@acme.example' || chr(10) || '- bob+x@mail.' || source || '.example' || chr(10)
    || '---' || chr(10) || chr(10) || '# Doc ' || cast(doc_id as {string}) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10)
    || '#thread/t' || cast(doc_id % 7 as {string}) || CASE WHEN doc_id % 2 = 0 THEN ' #thread/T-' || cast(doc_id % 7 as {string}) ELSE '' END || chr(10) || chr(10)
    || '- [' || CASE WHEN doc_id % 3 = 1 THEN 'x' ELSE ' ' END || '] task ' || cast(doc_id as {string}) || ' 📅 ' || cast({due} as {string})
    || CASE WHEN doc_id % 3 = 1 THEN ' ✅ ' || cast({due} as {string}) ELSE '' END || chr(10) || chr(10)
    || CASE WHEN doc_id % 10 <> 0 THEN '[[Doc ' || cast(doc_id - 1 as {string}) || ']]' ELSE '[[Missing ' || cast(doc_id % 13 as {string}) || '|alias]]' END || chr(10)"""


def _views(day: str, string: str) -> dict[str, str]:
    note = _NOTE.format(day=day.format("doc_id % 30"), due=day.format("doc_id % 30 + 3"), string=string)
    return {
        "v_items": f"SELECT doc_id AS item_id, source, {day.format('doc_id % 30')} AS item_date, 'Doc ' || cast(doc_id as {string}) AS title, text AS body FROM documents",
        "v_notes": f"SELECT doc_id, {_FOLDER} AS folder, 'Doc ' || cast(doc_id as {string}) AS stem, {_FOLDER} || '/Doc ' || cast(doc_id as {string}) || '.md' AS rel, source, {day.format('doc_id % 30')} AS note_date, {note} AS text FROM documents",
        "v_meetings": f"SELECT o_orderkey AS meeting_id, cast(o_orderdate as date) AS meeting_date, 'Customer' || cast(c_custkey % 400 as {string}) || '.' || lower(c_mktsegment) || '7' AS local_part, replace(lower(n_name), ' ', '') || '.' || lower(c_mktsegment) || '.example' AS domain, c_custkey, o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        "v_records": "SELECT event_id, event_type AS source, user_id, ts FROM events",
    }


SPARK = _views(_DAY, "string")
DUCK = _views(_DAY_DUCK, "varchar")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables or views. Only what it names is read; no name is registered in the session."""
    ship(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", SPARK[name])}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", SPARK[name]), **tables)


def duck(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    used = [n for n in DUCK if n in sql]
    ctes = ", ".join(f"{n} AS ({DUCK[n]})" for n in used)
    if not used:
        return sql
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
