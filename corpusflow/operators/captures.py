"""Records of single captures: mail, chat, board items, code reviews, notes, dictation, memos.

Each function takes rows as a reader yields them and gives the record's typed columns; what
is new, changed or left alone is a plan of ``merge``, and the text of a page one more column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..sources import html, payloads
from . import people as P
from . import records as R


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def or_else(*columns: Column) -> Column:
    """The first filled column, else an empty text."""
    return F.coalesce(T.first_filled(*columns), F.lit(""))


# --- mail and chat ---------------------------------------------------------------------


def mail_records(messages: DataFrame, people: DataFrame, domains: DataFrame, labels: DataFrame, label_names: DataFrame) -> DataFrame:
    """messages (id, thread, sender, recipients: array, subject, date, label_ids: array, decoded,
    plain, html, snippet), people (email, slug), domains (domain, route), labels (ordinal, label,
    route), label_names (id, name) -> a record for each message with an id: (id, thread, subject,
    sender, recipients, participants, date, labels, route, tier, body)."""
    rows = messages.filter(filled(F.col("id")))
    routed = R.route_mail(rows.select("id", "sender", F.col("label_ids").alias("labels")), domains, labels, names=label_names)
    linked = P.link_participants(rows.select("id", F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>"))).alias("addresses")), people)
    body = payloads.mime_body(F.col("decoded"), F.col("plain"), F.col("html"), F.col("snippet"))
    out = rows.select(
        "id", "thread", T.strip(html.unescape(F.col("subject"))).alias("subject"), T.extract_email(F.col("sender")).alias("sender"),
        F.transform("recipients", T.extract_email).alias("recipients"), "date", F.col("label_ids").alias("labels"), F.coalesce(F.nullif(body, F.lit("")), F.lit("_(no body)_")).alias("body"),
    )
    none = F.array().cast("array<string>")
    return out.join(routed, "id").join(linked, "id", "left").withColumn("participants", F.coalesce("participants", none))


def channel_route(name: Column, kind: Column, route: Column, dm_route: str = "_dms") -> Column:
    """Where a channel's messages go: direct ones together, else its route, else its name."""
    own = F.coalesce(F.nullif(T.plain_slug(F.coalesce(name, F.lit(""))), F.lit("")), F.lit("unnamed"))
    return F.when(kind == "im", F.lit(dm_route)).otherwise(F.coalesce(route, own))


def chat_records(messages: DataFrame, routes: DataFrame, dm_route: str = "_dms") -> DataFrame:
    """messages (channel, kind, ts, event_ts, user, bot, real_name, display_name, username, text,
    thread_ts, files: array<struct<name, title, mimetype, size, id>>), routes (channel, route) -> a
    record for each message with a time: (ts, channel, route, sender_id, sender, date, timestamp,
    thread_ts, is_reply, text of 1000 characters at most, files)."""
    ts = T.first_filled(F.col("ts"), F.col("event_ts"))
    rows = messages.withColumn("ts", ts).filter("ts is not null").join(routes, "channel", "left")
    at = F.timestamp_seconds(F.col("ts").try_cast("double"))
    sender_id = or_else(F.col("user"), F.col("bot"))
    sender = F.coalesce(T.first_filled(F.col("real_name"), F.col("display_name"), F.col("username"), sender_id), F.lit("unknown"))
    text = F.coalesce("text", F.lit(""))
    files = F.transform(
        F.coalesce("files", F.array().cast(messages.schema["files"].dataType)),
        lambda f: F.struct(
            F.coalesce(T.first_filled(f["name"], f["title"]), F.lit("(unnamed)")).alias("name"), F.coalesce(f["mimetype"], F.lit("")).alias("mimetype"),
            F.coalesce(f["size"], F.lit(0)).cast("long").alias("size"), F.coalesce(f["id"], F.lit("")).alias("file_id"),
        ),
    )
    return rows.select(
        "ts", "channel", channel_route(F.col("channel"), F.col("kind"), F.col("route"), dm_route).alias("route"), sender_id.alias("sender_id"), sender.alias("sender"),
        F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("")).alias("date"), F.coalesce(F.date_format(F.date_trunc("second", at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("ts")).alias("timestamp"),
        or_else(F.col("thread_ts"), F.col("ts")).alias("thread_ts"), (filled(F.col("thread_ts")) & (F.col("thread_ts") != F.col("ts"))).alias("is_reply"),
        F.when(F.length(text) > 1000, F.concat(F.substring(text, 1, 999), F.lit("…"))).otherwise(text).alias("text"), files.alias("files"),
    )


# --- boards ----------------------------------------------------------------------------


def column_text(value: Column) -> Column:
    """A board column's variant as text: a scalar as it is; the first five of a list; of an object
    its text, display value, name and ids, else 120 characters of its JSON."""
    kind, json = F.schema_of_variant(value), F.to_json(value)
    part = lambda k: F.nullif(F.try_variant_get(value, f"$.{k}", "string"), F.lit(""))
    parts = F.filter(F.array(*[F.concat(F.lit(f"{k}="), part(k)) for k in ("text", "display_value", "name", "ids")]), lambda x: x.isNotNull() & ~x.rlike(r"=\[\]$"))
    listed = F.array_join(F.slice(F.try_variant_get(value, "$", "array<string>"), 1, 5), ", ")
    of_object = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.substring(json, 1, 120))
    return F.when(F.startswith(kind, F.lit("OBJECT")), of_object).when(F.startswith(kind, F.lit("ARRAY")), listed).otherwise(F.try_variant_get(value, "$", "string"))


def description(value: Column) -> Column:
    """A description as text: a text, blocks with content or text (or lists of such), or an object."""
    kind = F.schema_of_variant(value)
    inner = lambda v: or_else(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"))

    def block(v: Column) -> Column:
        whole = F.try_variant_get(v, "$.content", "variant")
        content = F.coalesce(F.when(F.schema_of_variant(whole).rlike("^(OBJECT|ARRAY)") | filled(F.try_variant_get(whole, "$", "string")), whole), F.try_variant_get(v, "$.text", "variant"))
        many = F.transform(F.try_variant_get(content, "$", "array<variant>"), inner)
        return F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), many).otherwise(F.array(F.coalesce(F.try_variant_get(content, "$", "string"), F.lit(""))))

    parts = F.filter(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), block)), lambda x: x != "")
    of_object = or_else(F.try_variant_get(value, "$.content", "string"), F.try_variant_get(value, "$.text", "string"), F.substring(F.to_json(value), 1, 500))
    return F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "\n")).when(F.startswith(kind, F.lit("OBJECT")), of_object).otherwise(F.try_variant_get(value, "$", "string")), F.lit(""))


def board_items(pages: DataFrame) -> DataFrame:
    """pages (workspace, board, item: variant) -> a record for each item with an id: (id, name,
    workspace, board, folder, created_at, updated_at, columns: map, description). Columns may be an
    object or a list of objects with an id; empty ones are left out."""
    v = lambda p, t="string": F.try_variant_get("item", p, t)
    listed = F.map_from_entries(F.transform(v("$.column_values", "array<variant>"), lambda c: F.struct(F.coalesce(F.try_variant_get(c, "$.id", "string"), F.lit("")).alias("k"), or_else(F.try_variant_get(c, "$.text", "string"), F.try_variant_get(c, "$.display_value", "string")).alias("v"))))
    keyed = F.transform_values(v("$.column_values", "map<string, variant>"), lambda _, x: column_text(x))
    columns = F.map_filter(F.coalesce(keyed, listed, F.create_map().cast("map<string, string>")), lambda _, x: filled(x))
    rows = pages.filter(filled(v("$.id")))
    slug = lambda c: F.coalesce(F.nullif(T.plain_slug(F.col(c)), F.lit("")), F.lit("unnamed"))
    return rows.select(
        v("$.id").alias("id"), F.coalesce(F.nullif(v("$.name"), F.lit("")), F.lit("(unnamed)")).alias("name"), "workspace", "board", F.concat_ws("/", slug("workspace"), slug("board")).alias("folder"),
        F.coalesce(v("$.created_at"), F.lit("")).alias("created_at"), F.coalesce(v("$.updated_at"), F.lit("")).alias("updated_at"), columns.alias("columns"),
        description(F.coalesce(v("$.description", "variant"), v("$.item_description", "variant"))).alias("description"),
    )


#: The board columns that hold a stage and an owner, what an address looks like, and
#: words that don't count in an item's name.
STAGE_COLUMNS = ("status9", "status", "status__1", "status4")
OWNER_COLUMNS = ("person", "people")
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
NAME_STOPWORDS = (
    "the", "a", "an", "of", "and", "at", "by", "in", "on", "to", "for",
    "with", "from", "or",
    "inn", "lodge", "hotel", "suites", "spa",
    "resort", "ridge", "hills", "valley", "lake", "lakes", "creek",
    "national", "park", "city", "company", "co", "inc", "llc", "ltd",
    "group", "international",
)


def board_lookup(files: DataFrame, internal: tuple[str, ...] = (), owners: tuple[str, ...] = OWNER_COLUMNS, stages: tuple[str, ...] = STAGE_COLUMNS) -> DataFrame:
    """files (id, name, text, columns: array<struct<column_id, text>>) -> (id, name, emails, owner,
    stage): every address in the file but internal ones, and the first filled column of each role
    that isn't JSON."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)), F.lower)))
    outside = F.filter(found, lambda e: ~F.substring_index(e, "@", -1).isin(*internal)) if internal else found
    cells = F.filter("columns", lambda c: filled(F.trim(c["text"])) & ~F.startswith(F.trim(c["text"]), F.lit("{")))
    first = lambda ids: F.coalesce(F.trim(F.try_element_at(F.filter(cells, lambda c: F.lower(c["column_id"]).isin(*ids)), F.lit(1))["text"]), F.lit(""))
    return files.select("id", "name", outside.alias("emails"), first(owners).alias("owner"), first(stages).alias("stage"))


def match_name(name: Column) -> Column:
    """An item's name for a search in titles: words of two characters or more that count; null
    unless two are left, of eight characters together."""
    kept = F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*NAME_STOPWORDS))
    joined = F.array_join(kept, " ")
    return F.when((F.size(kept) >= 2) & (F.length(joined) >= 8), joined)


def inbox_note(notes: DataFrame, internal: tuple[str, ...] = ()) -> DataFrame:
    """notes (id, stem, text, attendees: array) -> (id, title, emails): the title without its date,
    the attendees' addresses, then those of the text that are neither internal nor listed yet."""
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("stem", r"^\d{4}-\d{2}-\d{2}\s*[—-]\s*(.+)$", 1)), F.lit("")), F.col("stem"))
    low = lambda c: F.transform(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)), F.lower)
    body = F.filter(low(F.col("text")), lambda e: ~F.substring_index(e, "@", -1).isin(*internal)) if internal else low(F.col("text"))
    return notes.select("id", title.alias("title"), F.array_distinct(F.concat(F.flatten(F.transform("attendees", lambda a: low(a))), body)).alias("emails"))


# --- code reviews ----------------------------------------------------------------------


def review_records(details: DataFrame, most: int = 50) -> DataFrame:
    """details (repo, kind, number, title, state, author, created_at, merged_at, closed_at, labels:
    array, body, comments and reviews: array<struct<author, at, state, body>>) -> (repo, kind, number,
    title, state, author, ..., body of 2000 characters, comments: the first ``most`` by time, n_comments:
    all). Reviews are comments that begin with their state; a merged one's state is merged."""
    none = F.array().cast("array<struct<at:string,i:int,author:string,head:string,body:string>>")
    placed = lambda c, head, first: F.coalesce(F.transform(c, lambda x, i: F.struct(F.coalesce(x["at"], F.lit("")).alias("at"), (first + i).alias("i"), x["author"].alias("author"), head(x).alias("head"), x["body"].alias("body"))), none)
    n_said = lambda c: F.greatest(F.size(c), F.lit(0))
    both = F.concat(placed("comments", lambda x: F.lit(""), F.lit(0)), placed("reviews", lambda x: F.concat(F.lit("("), F.lower(F.coalesce(x["state"], F.lit(""))), F.lit(") ")), n_said("comments")))
    # a stable sort by time: what was said at one time stays in its order; only what is kept is made up
    body = lambda x: T.clip(F.concat(x["head"], T.strip(F.coalesce(x["body"], F.lit("")))), 1000)
    kept = F.transform(F.slice(F.array_sort(both), 1, most), lambda x: F.struct(x["at"].alias("at"), F.coalesce(F.nullif(x["author"], F.lit("")), F.lit("ghost")).alias("author"), body(x).alias("body")))
    state = F.when(filled(F.col("merged_at")), "merged").otherwise(F.coalesce(F.nullif(F.lower("state"), F.lit("")), F.when(F.col("kind") == "pr", "open").otherwise("")))
    return details.select(
        "repo", "kind", "number", T.strip(F.coalesce("title", F.lit(""))).alias("title"), state.alias("state"), F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("ghost")).alias("author"), "created_at",
        F.coalesce(F.nullif(F.col("merged_at"), F.lit("")), F.lit("null")).alias("merged_at"), F.coalesce(F.nullif(F.col("closed_at"), F.lit("")), F.lit("null")).alias("closed_at"),
        F.filter("labels", filled).alias("labels"), F.coalesce(F.nullif(T.clip(F.col("body"), 2000), F.lit("")), F.lit("(no description)")).alias("body"), kept.alias("comments"), (n_said("comments") + n_said("reviews")).cast("long").alias("n_comments"),
    )


def review_stamp() -> Column:
    """What tells a changed review: its state, when it was merged or closed, how much was said."""
    return F.concat_ws("|", "state", F.when(F.col("kind") == "pr", F.col("merged_at")).otherwise(F.col("closed_at")), F.col("n_comments").cast("string"))


def detail_pages(listed: DataFrame, details: DataFrame, since: str, most: int = 200) -> DataFrame:
    """listed (repo, kind, number, created), details (repo, kind, number, ...) -> the details of the
    listed ones that were created since, the newest ``most`` of each list; a list without
    details gives none."""
    from pyspark.sql.window import Window as W

    newest = W.partitionBy("repo", "kind").orderBy(F.desc("created"), F.desc("number"))
    wanted = listed.filter(F.col("created") >= F.lit(since)).withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= most)
    return details.join(wanted.select("repo", "kind", "number"), ["repo", "kind", "number"], "left_semi")


# --- notes, dictation, memos -------------------------------------------------------------


def note_id(uri: Column) -> Column:
    """x-coredata://.../ICNote/p12 -> p12; else the last part; null for none."""
    named = F.regexp_extract(uri, r"/ICNote/(p\d+)", 1)
    return T.first_filled(named, F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1))


def note_captures(notes: DataFrame, known: DataFrame, since: str | None = None) -> DataFrame:
    """notes (uri, name, folder, created, modified, html), known (id, last_modified) -> (id, title,
    folder, created_at, modified_at, body, redactions, action): written if the vault hasn't it,
    whatever its date; else changed if it was modified after it was taken and not before since, which
    is told and not applied; else present. A note without an id is an error."""
    at = lambda c: F.date_format(D.apple_date(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss")
    text = T.redact(html.markdown(F.col("html")))
    rows = notes.select(note_id(F.col("uri")).alias("id"), F.trim(or_else(F.col("name"), F.lit("(untitled)"))).alias("title"), F.coalesce(F.nullif(T.plain_slug(F.trim(or_else(F.col("folder"), F.lit("Notes")))), F.lit("")), F.lit("unfiled")).alias("folder"), at("created").alias("created_at"), at("modified").alias("modified_at"), text.alias("t"))
    old = known.select("id", F.col("last_modified").alias("was"), F.lit(True).alias("there"))
    early = F.coalesce(F.col("modified_at") < F.lit(since), F.lit(False)) if since else F.lit(False)
    action = F.when(F.col("id").isNull(), "error").when(F.col("there").isNull(), "written").when(~early & (F.col("modified_at") > F.col("was")), "changed").otherwise("present")
    return rows.join(old, "id", "left").select("id", "title", "folder", "created_at", "modified_at", F.col("t.text").alias("body"), F.col("t.n").alias("redactions"), action.alias("action"))


#: Names of applications by their bundle.
APPS = {
    "com.anthropic.claudefordesktop": "Claude Desktop",
    "com.tinyspeck.slackmacgap": "Slack",
    "com.google.Chrome": "Chrome",
    "com.apple.Safari": "Safari",
    "com.apple.Terminal": "Terminal",
    "com.googlecode.iterm2": "iTerm",
    "com.microsoft.VSCode": "VS Code",
    "com.todesktop.230313mzl4w4u92": "Cursor",
    "notion.id": "Notion",
    "md.obsidian": "Obsidian",
    "com.apple.mail": "Mail",
    "com.apple.iCal": "Calendar",
    "com.electron.gather": "Gather",
    "com.linear": "Linear",
}


def app_name(bundle: Column, names: dict[str, str] = APPS) -> Column:
    """A bundle's name: known, or its last part in title case."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    last = F.initcap(F.replace(F.element_at(F.split(bundle, r"\."), -1), F.lit("-"), F.lit(" ")))
    return F.when(~filled(bundle) | (bundle == "unknown"), "Unknown app").otherwise(F.coalesce(F.try_element_at(table, bundle), last))


def dictations(rows: DataFrame) -> DataFrame:
    """rows (id, edited, formatted, raw, ts, app, duration) -> a record for each with an id: (id,
    timestamp, date, app, title, body, body_source). A time keeps its offset; other text is kept as
    it is."""
    shape = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?: ([+-]\d{2}:\d{2}))?"
    ts = F.coalesce("ts", F.lit(""))
    part = lambda i: F.regexp_extract(ts, shape, i)
    iso = F.when(ts.rlike(shape), F.concat(part(1), F.lit("T"), part(2), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("+00:00")))).otherwise(ts)
    date = F.substring(ts, 1, 10)
    human = D.short_duration(F.col("duration"))
    body = R.pick_body(F.col("edited"), F.col("formatted"), F.col("raw"))
    kept = rows.filter(filled(F.col("id"))).withColumn("__b", body)
    source = F.coalesce("__b.source", F.lit("empty"))
    return kept.select("id", iso.alias("timestamp"), date.alias("date"), "app", F.concat(date, F.lit(" — "), app_name(F.col("app")), F.lit(" ("), human, F.lit(")")).alias("title"), F.coalesce("__b.body", F.lit("(no text content)")).alias("body"), source.alias("body_source"))


def calendar_records(events: DataFrame) -> DataFrame:
    """events (external_id, title, start_ms, end_ms, url, summary, content) -> a record for each with
    an id."""
    start = F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = events.filter(filled(F.col("external_id")))
    return rows.select(F.col("external_id").alias("id"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")).alias("title"), F.coalesce(start, F.lit("")).alias("start_utc"), "end_ms", F.coalesce("url", F.lit("")).alias("url"), or_else(F.col("summary"), F.col("content")).alias("body"))


def memo_states(memos: DataFrame, existing: DataFrame, ready: bool, budget: int, retry_stubs: bool = False) -> DataFrame:
    """memos (id, recorded, native, sidecar, audio: whether there is one), existing (id, source) ->
    (id, source, transcript, action). A transcript of its own comes first, then the file beside it;
    else the helper, if it is ready, for the newest ``budget`` of those that need it, and the rest wait
    (deferred); else there is none. What is there stays, but a stub (source none) is upgraded where
    retries are asked for and a transcript has appeared."""
    text = T.first_filled(F.col("native"), F.col("sidecar"))
    old = existing.select("id", F.col("source").alias("was"))
    rows = memos.join(old, "id", "left").withColumn("text", text)
    stub = F.col("was").eqNullSafe(F.lit("none")) & F.lit(retry_stubs)
    wants = F.col("text").isNull() & F.col("audio") & (F.col("was").isNull() | stub) & F.lit(ready)
    served = rows.filter(wants).orderBy(F.desc("recorded"), "id").limit(budget).select("id", F.lit(True).alias("served"))
    rows = rows.join(F.broadcast(served), "id", "left")  # budget rows
    source = F.when(filled(F.col("native")), "native").when(F.col("text").isNotNull(), "on-device").when(F.col("served"), "helper").when(wants, "deferred").otherwise("none")
    got = ~source.isin("none", "deferred")
    action = F.when(F.col("was").isNull(), F.when(source == "deferred", "deferred").otherwise("written")).when(stub & got, "upgraded").when(stub & (source == "deferred"), "deferred").otherwise("present")
    return rows.select("id", source.alias("source"), F.col("text").alias("transcript"), action.alias("action"))


def scan_floor(rows: DataFrame, column: str, last: str | None, overlap_days: int = 30) -> DataFrame:
    """rows of the last run's newest day less an overlap on: a bound of the scan alone, since what
    is there already is told by its key."""
    return rows.filter(F.col(column) >= F.date_sub(F.lit(last[:10]).cast("date"), overlap_days)) if last else rows


# --- summaries -------------------------------------------------------------------------


def attendee_pairs(named: Column, bare: Column, junk: tuple[str, ...] = ()) -> Column:
    """struct(pairs, dropped): (name, email) of attendees, then of bare addresses that aren't among
    them; sorted by address, nameless ones last. Addresses of junk domains go, and numbers as
    a local part without a name."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    tidy = lambda x, name: F.struct(F.trim(F.coalesce(name, F.lit(""))).alias("name"), F.trim(F.coalesce(x, F.lit(""))).alias("email"))
    none = F.array().cast("array<struct<name:string,email:string>>")
    listed = F.coalesce(F.transform(named, lambda p: tidy(p["email"], p["name"])), none)
    more = F.filter(F.coalesce(F.transform(bare, lambda e: tidy(e, F.lit(""))), none), lambda p: p["email"] != "")
    bad = lambda p: (F.lit(False) if not junk else low(p["email"]).rlike("@.*(?:" + "|".join(j.replace(".", r"\.") for j in junk) + ")$")) | ((p["name"] == "") & p["email"].rlike(r"^\d+(?:@|$)"))
    every = F.concat(listed, more)
    kept = R.attendees(F.filter(F.filter(every, lambda p: ~bad(p)), lambda p: (p["name"] != "") | (p["email"] != "")))
    known = F.transform(F.filter(listed, lambda p: ~bad(p)), lambda p: low(p["email"]))
    gone = F.filter(every, lambda p: bad(p) & (p["email"] != "") & ~F.array_contains(known, low(p["email"])))
    return F.struct(kept.alias("pairs"), F.array_sort(F.array_distinct(F.transform(gone, lambda p: p["email"]))).alias("dropped"))


def summary_records(meetings: DataFrame, junk: tuple[str, ...] = (), view_url: str = "https://app.example/view/") -> DataFrame:
    """meetings (id, title, date, url, attendees, participants, keywords, overview, short_summary,
    action_items: array) -> (id, title, date, url, attendees, dropped, keywords, overview, actions)."""
    pairs = attendee_pairs(F.col("attendees"), F.col("participants"), junk)
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    rows = meetings.withColumn("__p", pairs).withColumn("id", F.trim(F.coalesce("id", F.lit(""))))
    url = or_else(F.trim("url"), F.when(F.col("id") != "", F.concat(F.lit(view_url), "id")))
    return rows.select("id", F.trim("title").alias("title"), D.any_epoch(F.col("date")).alias("date"), url.alias("url"), F.col("__p.pairs").alias("attendees"), F.col("__p.dropped").alias("dropped"), tidy(F.col("keywords")).alias("keywords"), or_else(F.trim("overview"), F.trim("short_summary")).alias("overview"), F.array_join(tidy(F.col("action_items")), "\n").alias("actions"))


def page_state(text: Column, marker: str) -> Column:
    """What a record's page is: stub, summary or conflict."""
    status = F.regexp_extract(text, r"(?ms)\A---\n(?:.*?\n)?transcript_status: *(\S+) *$", 1)
    return F.when(~text.rlike(r"(?s)\A---\n.*?\n---"), "conflict").when(status == "summary", "summary").when((status == "not-retained-locally") & text.contains(marker), "stub").otherwise("conflict")


def same_but_stamp(a: Column, b: Column, key: str = "enriched_at") -> Column:
    """Whether two pages differ in nothing but the lines of one key."""
    bare = lambda c: F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.startswith(x, F.lit(f"{key}:"))), "\n")
    return bare(a) == bare(b)


def has_content(text: Column, headings: tuple[str, ...] = ("Overview", "Action Items")) -> Column:
    """Whether a page has text under any of the headings, up to a rule or the next heading."""
    found = F.lit(False)
    for h in headings:
        found |= F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?ms)^## {h}[ \t]*$(.*?)(?=^## |^---[ \t]*$|\z)", 1), r"\s+", " ")) != ""
    return found


def mark_unavailable(records: DataFrame, ids: DataFrame, day: str) -> DataFrame:
    """records (id, status, checked) with status unavailable for stubs that ids names; others stay."""
    named = ids.select("id", F.lit(True).alias("__n")).distinct()
    hit = F.col("__n") & (F.col("status") == "stub")
    return records.join(named, "id", "left").withColumn("checked", F.when(hit, F.lit(day)).otherwise(F.col("checked"))).withColumn("status", F.when(hit, "unavailable").otherwise(F.col("status"))).drop("__n")


def pending(records: DataFrame) -> DataFrame:
    """Stubs that wait for a summary, by date and id."""
    return records.filter("status = 'stub'").orderBy("date", "id")
