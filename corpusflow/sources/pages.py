"""JSON pages of services as rows: mail, labels, chat, boards, notes, documents, calls.

A page is (page, text). One that is no JSON, or of no known shape, gives no rows and is named by
``malformed``: a bad page stops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import payloads


def _value(pages: DataFrame) -> DataFrame:
    return pages.select("page", F.try_parse_json("text").alias("v"))


def _is(c: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(c), F.lit(kind)), F.lit(False))


def _get(c: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(c, path, kind)


def _first(c: str, *keys: str) -> Column:
    return payloads.first_of(F.col(c), [f"$.{k}" for k in keys])


def malformed(pages: DataFrame) -> DataFrame:
    """(page, error) of pages that are no JSON."""
    return _value(pages).filter("v is null").select("page", F.lit("malformed JSON").alias("error"))


def mail(pages: DataFrame) -> DataFrame:
    """Threads of messages -> what captures.mail_records takes, and next_page, the token of the page."""
    threads = _value(pages).select(_get("v", "$.nextPageToken").alias("next_page"), F.explode(_get("v", "$.threads", "array<variant>")).alias("t"))
    rows = threads.select("next_page", _get("t", "$.id").alias("thread"), F.explode(_get("t", "$.messages", "array<variant>")).alias("m"))
    parts = [F.col("m"), *[_get("m", f"$.payload{path}", "variant") for path in ("", *(f".parts[{i}]" for i in range(4)), *(f".parts[{i}].parts[{j}]" for i in range(2) for j in range(3)))]]
    data = lambda kind: F.coalesce(*[F.nullif(F.when(_get(p, "$.mimeType") == kind, payloads.base64url(_get(p, "$.body.data"))), F.lit("")) for p in parts[1:]])
    return rows.select(
        _get("m", "$.id").alias("id"), F.coalesce("thread", F.lit("")).alias("thread"), F.coalesce(_get("m", "$.sender"), F.lit("")).alias("sender"), F.coalesce(_get("m", "$.toRecipients", "array<string>"), F.array().cast("array<string>")).alias("recipients"),
        F.coalesce(_get("m", "$.subject"), F.lit("")).alias("subject"), F.coalesce(_get("m", "$.date"), F.lit("")).alias("date"), F.coalesce(_get("m", "$.labelIds", "array<string>"), F.array().cast("array<string>")).alias("label_ids"),
        _first("m", "body", "textBody", "bodyText", "text").alias("decoded"), data("text/plain").alias("plain"), data("text/html").alias("html"), _get("m", "$.snippet").alias("snippet"), "next_page",
    )


def label_names(pages: DataFrame) -> DataFrame:
    """(id, name) of labels under either of their keys; entries without both are left out."""
    rows = _value(pages).select(F.explode(F.coalesce(_get("v", "$.labels", "array<variant>"), _get("v", "$", "array<variant>"))).alias("e"))
    return rows.select(_first("e", "id", "labelId").alias("id"), _first("e", "name", "displayName").alias("name")).filter("id is not null and name is not null")


def chat(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks (id, text) for transcripts.chat, messages: variant rows (page, m)): a page holds its
    messages as one text or as an array."""
    rows = _value(pages).withColumn("said", _get("v", "$.messages", "variant"))
    text = rows.filter(F.schema_of_variant("said") == "STRING").select(F.col("page").alias("id"), _get("said", "$").alias("text")).filter("text <> ''")
    return text, rows.filter(_is(F.col("said"), "ARRAY")).select("page", F.explode(_get("said", "$", "array<variant>")).alias("m"))


def chat_messages(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """rows (page, m), channels (page, channel, kind) -> what captures.chat_records takes."""
    v = lambda p: _get("m", p)
    files = "array<struct<name:string,title:string,mimetype:string,size:bigint,id:string>>"
    return rows.join(channels, "page").select(
        "channel", "kind", v("$.ts").alias("ts"), v("$.event_ts").alias("event_ts"), v("$.user").alias("user"), v("$.bot_id").alias("bot"), v("$.user_profile.real_name").alias("real_name"), v("$.user_profile.display_name").alias("display_name"),
        v("$.username").alias("username"), v("$.text").alias("text"), v("$.thread_ts").alias("thread_ts"), _get("m", "$.files", files).alias("files"),
    )


def board(pages: DataFrame) -> DataFrame:
    """(page, item: variant, cursor) of the shapes a board answers in."""
    items = F.coalesce(*[_get("v", p, "array<variant>") for p in ("$.items", "$.data.items", "$.data.items_page.items")])
    cursor = F.coalesce(*[_get("v", p) for p in ("$.nextCursor", "$.data.nextCursor", "$.data.cursor")])
    return _value(pages).select("page", cursor.alias("cursor"), F.explode(items).alias("item"))


def notes(pages: DataFrame) -> DataFrame:
    """An array of notes, or an object with one -> what captures.note_captures takes."""
    rows = _value(pages).select(F.explode(F.coalesce(_get("v", "$.notes", "array<variant>"), _get("v", "$", "array<variant>"))).alias("n"))
    pick = {"uri": "id", "name": "name", "folder": "folder", "created": "creation_date", "modified": "modification_date", "html": "html_body"}
    return rows.select(*[F.coalesce(_get("n", f"$.{k}"), F.lit("")).alias(c) for c, k in pick.items()])


def docs(pages: DataFrame) -> DataFrame:
    """(id, name, text, modified, created, link) of documents in a list or under docs, files or items, or
    of a page that is one. An id may stand in the link; an entry with neither is left out. Markdown
    may come in an envelope."""
    listed = F.coalesce(*[_get("v", p, "array<variant>") for p in ("$.docs", "$.files", "$.items", "$")], F.when(_is(F.col("v"), "OBJECT"), F.array("v")))
    rows = _value(pages).select(F.explode(listed).alias("e")).filter(_is(F.col("e"), "OBJECT"))
    link = _first("e", "link", "web_link", "webViewLink", "url")
    doc_id = F.coalesce(_first("e", "id", "file_id", "document_id", "doc_id"), F.nullif(F.regexp_extract(F.coalesce(link, F.lit("")), "/d/([A-Za-z0-9_-]+)", 1), F.lit("")))
    raw = F.coalesce(*[_get("e", f"$.{k}", "variant") for k in ("markdown", "content", "result")])
    text = _get(raw, "$")
    inner = F.when(F.startswith(F.ltrim(text), F.lit("{")), F.try_parse_json(text))
    markdown = F.when(_is(raw, "OBJECT"), F.coalesce(*[F.nullif(_get(raw, f"$.{k}"), F.lit("")) for k in ("result", "markdown", "content")], F.lit(""))).otherwise(F.coalesce(_get(inner, "$.result"), text, F.lit("")))
    return rows.select(
        doc_id.alias("id"), F.coalesce(_first("e", "name", "title", "file_name"), F.lit("")).alias("name"), markdown.alias("text"), _first("e", "modified_time", "modifiedTime", "modified").alias("modified"), _first("e", "created_time", "createdTime", "created").alias("created"), link.alias("link"),
    ).filter("id is not null")


def file_doc_id(stem: Column) -> Column:
    """The id of an exported document by its file's name, so that a new export meets it."""
    return F.concat(F.lit("md-"), F.substring(F.sha1(stem), 1, 16))


def calls(pages: DataFrame, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """(calls (page, call: variant), transcripts (page, id, monologues: variant)) wherever a payload holds
    them: lists, calls, call, callTranscripts, result, and JSON as text inside a tool's answer, so many
    envelopes deep at most. Each round peels one envelope of all pages."""
    from ..operators.meetings import is_call

    rows = _value(pages).filter("v is not null")
    found, said = [], []
    for _ in range(depth + 1):
        rows = rows.withColumn("v", F.coalesce(F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(_get("v", "$"))), F.col("v")))
        obj, call = _is(F.col("v"), "OBJECT"), is_call(F.col("v"))
        one = _get("v", "$.call", "variant")
        whole = F.when(call, F.col("v")).when(_is(one, "OBJECT"), one)
        found.append(rows.select("page", F.when(obj, whole).alias("call")).filter("call is not null"))
        given = F.concat(F.coalesce(_get("v", "$.callTranscripts", "array<variant>"), F.array().cast("array<variant>")), F.when(_is(_get("v", "$.transcript", "variant"), "ARRAY") & ~call, F.array("v")).otherwise(F.array().cast("array<variant>")))
        each = rows.filter(obj).select("page", F.explode(given).alias("t")).select("page", _get("t", "$.callId").alias("id"), _get("t", "$.transcript", "variant").alias("monologues"))
        said.append(each.filter("id is not null"))
        texts = F.transform(F.filter(F.coalesce(_get("v", "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda p: _is(p, "OBJECT")), lambda p: _get(p, "$.text", "variant"))
        result = F.when(_get("v", "$.result", "variant").isNotNull() & ~_is(_get("v", "$.calls", "variant"), "ARRAY"), F.array(_get("v", "$.result", "variant"))).otherwise(F.array().cast("array<variant>"))
        below = F.when(_is(F.col("v"), "ARRAY"), _get("v", "$", "array<variant>")).when(obj & whole.isNull(), F.concat(F.coalesce(_get("v", "$.calls", "array<variant>"), F.array().cast("array<variant>")), result, texts))
        rows = rows.select("page", F.explode(below).alias("v")).filter("v is not null")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(found), union(said)


def batches(ids: DataFrame, size: int = 100) -> DataFrame:
    """ids (id) -> (batch, ids): requests of about size ids each, by hash, so none is one task's."""
    n = max(1, -(-ids.count() // size))
    return ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
