"""Queries of the capture and meeting operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..operators import captures, forms, matching, meetings, merge, people, records, segments
from ..session import arrow_uri, shared_dir, spread
from ..sources import documents, page_sink, pages, payloads, transcripts
from ..sources import frontmatter as fm
from ..sources import notes as N
from ..sources.views import view
from .catalogue import query



def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- mail, chat, boards ------------------------------------------------------------------


@query("""SELECT 'm' || doc_id AS id, 't' || doc_id % 9 AS thread, 'A & "' || doc_id || '"' AS subject, 'a@' || source AS sender,
    CASE WHEN source = 'src1' THEN 'team' WHEN doc_id % 3 = 0 THEN 'triage' WHEN doc_id % 3 = 1 THEN 'nested' ELSE '_unrouted' END AS route,
    CASE WHEN source = 'src1' THEN 'domain' WHEN doc_id % 3 < 2 THEN 'label' ELSE 'unrouted' END AS tier,
    CASE WHEN source IN ('src1', 'src2') THEN 'P-' || source || CASE WHEN source <> 'src2' THEN ',P-src2' ELSE '' END ELSE 'P-src2' END AS participants,
    CASE doc_id % 5 WHEN 0 THEN 'one & two' WHEN 1 THEN 'plain &amp; kept' WHEN 2 THEN 'html <text> here' WHEN 3 THEN 'snip > pet' ELSE '_(no body)_' END AS body FROM documents WHERE doc_id % 17 <> 0""")
def mail_records(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    mails = docs.selectExpr(
        "if(doc_id % 17 = 0, null, concat('m', doc_id)) as id", "concat('t', doc_id % 9) as thread", "concat(' A &amp; &quot;', doc_id, '&quot; ') as subject", "concat('Some One <A@', upper(source), '>') as sender",
        "array('x@src2', 'Z <z@nowhere>', 'X <x@SRC2>') as recipients", "'2024-01-01' as date", "array(concat('L', doc_id % 3), 'INBOX') as label_ids",
        "if(doc_id % 5 = 0, ' one &amp; two ', ' ') as decoded", "if(doc_id % 5 = 1, 'plain &amp; kept\n', '') as plain", "if(doc_id % 5 = 2, '<p>html <b>&lt;text&gt;</b> here</p>', null) as html", "if(doc_id % 5 = 3, 'snip &gt; pet', '') as snippet",
    )
    known = _frame(spark, [("a@src1", "P-src1"), ("x@src2", "P-src2"), ("a@src2", "P-src2")], "email string, slug string")
    found = captures.mail_records(mails, known, _frame(spark, [("SRC1", "team")], "domain string, route string"), _frame(spark, [(0, "Add To Triage", "triage"), (1, "flat", "nested")], "ordinal int, label string, route string"), _frame(spark, [("L0", "add to triage"), ("L1", "Family/Flat")], "id string, name string"))
    return found.select("id", "thread", "subject", "sender", "route", "tier", F.array_join("participants", ",").alias("participants"), "body")


@query("""SELECT '17' || conv_id || '.' || turn AS ts, CASE WHEN conv_id % 5 = 0 THEN '_dms' WHEN conv_id % 5 = 1 THEN 'team/one' ELSE 'ch-' || conv_id % 5 END AS route, CASE turn % 4 WHEN 0 THEN 'Real' WHEN 1 THEN 'disp' WHEN 2 THEN 'U7' ELSE 'unknown' END AS sender,
    turn > 0 AS is_reply, length(CASE WHEN length(text) > 1000 THEN text[:999] || '…' ELSE text END) AS n, CASE WHEN turn % 2 = 0 THEN 'f|(unnamed)' ELSE '' END AS files,
    strftime(to_timestamp(('17' || conv_id || '.' || turn)::DOUBLE) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date FROM conversations""")
def chat_records(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations").selectExpr(
        "concat('Ch ', conv_id % 5) as channel", "if(conv_id % 5 = 0, 'im', 'channel') as kind", "if(turn % 2 = 0, concat('17', conv_id, '.', turn), '') as ts", "concat('17', conv_id, '.', turn) as event_ts", "if(turn % 4 = 2, 'U7', null) as user", "cast(null as string) as bot",
        "if(turn % 4 = 0, 'Real', '') as real_name", "if(turn % 4 = 1, 'disp', '') as display_name", "cast(null as string) as username", "text", "concat('17', conv_id, '.0') as thread_ts",
        "if(turn % 2 = 0, array(named_struct('name', 'f', 'title', 't', 'mimetype', 'm', 'size', 1L, 'id', 'i'), named_struct('name', '', 'title', '', 'mimetype', null, 'size', null, 'id', null)), null) as files",
    )
    found = captures.chat_records(rows, _frame(spark, [("Ch 1", "team/one")], "channel string, route string"))
    return found.select("ts", "route", "sender", "is_reply", F.length("text").cast("long").alias("n"), F.array_join(F.transform("files", lambda f: f["name"]), "|").alias("files"), "date").withColumn("files", F.coalesce("files", F.lit("")))


@query("""SELECT p_partkey::VARCHAR AS id, p_name AS name, 'my-space/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9-]+', '-', 'g'), '-') AS folder, 'k=' || p_type || ';n=' || p_size || ';o=text=t' || p_size || ';l=1, 2, 3, 4, 5' AS columns, 'first' || chr(10) || p_type || chr(10) || 'deep' AS description FROM part""")
def board_items(spark, sf_dir):
    item = F.to_json(F.expr("""named_struct('id', p_partkey, 'name', p_name, 'column_values', named_struct('k', p_type, 'n', p_size, 'o', named_struct('text', concat('t', p_size), 'ids', array()), 'l', array(1, 2, 3, 4, 5, 6), 'e', ''),
        'description', array(named_struct('content', 'first', 'text', ''), named_struct('content', '', 'text', p_type), named_struct('content', null, 'text', 'deep')))"""))
    pages = view(spark, sf_dir, "part").select(F.lit("My Space").alias("workspace"), F.col("p_brand").alias("board"), F.parse_json(item).alias("item"))
    found = captures.board_items(pages)
    cells = F.array_join(F.transform(F.array(*[F.lit(x) for x in "knol"]), lambda k: F.concat(k, F.lit("="), F.try_element_at("columns", k))), ";")
    return found.select("id", "name", "folder", cells.alias("columns"), "description")


@query("""SELECT c_custkey AS id, 'c' || c_custkey % 50 || '@far.example' AS emails, CASE WHEN c_custkey % 2 = 0 THEN 'Ada' ELSE 'Bo' END AS owner, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'won' END AS stage FROM customer""")
def board_lookup(spark, sf_dir):
    files = view(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "c_name as name", "concat('x C', c_custkey % 50, '@far.example, me@own.example; c', c_custkey % 50, '@far.example') as text",
        "array(named_struct('column_id', 'people', 'text', if(c_custkey % 2 = 0, 'Ada', '{json}')), named_struct('column_id', 'Person', 'text', 'Bo'), named_struct('column_id', 'status', 'text', if(c_custkey % 3 = 0, ' ', 'won'))) as columns",
    )
    return captures.board_lookup(files, ("own.example",)).select("id", F.array_join("emails", ",").alias("emails"), "owner", "stage")


@query("""SELECT doc_id AS id, 'Doc ' || doc_id AS title, 'ada.lovelace' || doc_id % 11 || '@acme.example,out@far.example' AS emails FROM documents""")
def inbox_notes(spark, sf_dir):
    notes = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "if(doc_id % 2 = 0, concat('2024-01-01 — Doc ', doc_id), concat('Doc ', doc_id)) as stem", "'see OUT@far.example and me@own.example' as text", "array(concat('Ada <Ada.Lovelace', doc_id % 11, '@acme.example>')) as attendees")
    return captures.inbox_note(notes, ("own.example",)).select("id", "title", F.array_join("emails", ",").alias("emails"))


@query("""WITH s AS (SELECT p_partkey, lower(p_name) AS n FROM part), w AS (SELECT p_partkey, [x for x in string_split(n, ' ') if length(x) > 1 AND x NOT IN ('the', 'lake', 'ring')] AS k FROM s)
    SELECT p_partkey AS id, CASE WHEN len(k) >= 2 AND length(array_to_string(k, ' ')) >= 8 THEN array_to_string(k, ' ') END AS name FROM w""")
def item_match_names(spark, sf_dir):
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), captures.match_name(F.regexp_replace(F.concat("p_name", F.lit(" a")), "ring", "lake")).alias("name"))


# --- code reviews, notes, memos ------------------------------------------------------------


@query("""SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'merged' WHEN o_orderkey % 3 = 1 THEN 'closed' ELSE 'open' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN 'ghost' ELSE 'u' || o_custkey % 7 END AS author, 60::BIGINT AS n_comments,
    CASE WHEN o_orderkey % 2 = 0 THEN 1999 ELSE 4 END + 1::BIGINT AS n_body, '2024-01-01T00:00:00Z ghost (approved) ok' AS first, 50::BIGINT AS kept FROM orders""")
def review_records(spark, sf_dir):
    rows = spread(view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).selectExpr(
        "'r' as repo", "'pr' as kind", "o_orderkey as number", "' T ' as title", "if(o_orderkey % 3 = 1, 'CLOSED', '') as state", "if(o_orderkey % 5 = 0, '', concat('u', o_custkey % 7)) as author", "'2024' as created_at", "if(o_orderkey % 3 = 0, '2024-02-01', '') as merged_at", "'' as closed_at", "array('a', '', null) as labels",
        "if(o_orderkey % 2 = 0, repeat('x', 2001), 'short') as body", "transform(sequence(1, 59), i -> named_struct('author', 'c', 'at', concat('2024-01-02T00:', lpad(60 - i, 2, '0')), 'state', '', 'body', concat('c', i))) as comments", "array(named_struct('author', '', 'at', '2024-01-01T00:00:00Z', 'state', 'APPROVED', 'body', ' ok ')) as reviews",
    )
    found = captures.review_records(rows)
    one = F.col("comments")[0]
    return found.select("number", "state", "author", "n_comments", F.length("body").cast("long").alias("n_body"), F.concat_ws(" ", one["at"], one["author"], one["body"]).alias("first"), F.size("comments").cast("long").alias("kept"))


@query("SELECT o_orderkey AS number FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderdate >= DATE '1996-01-01') WHERE k <= 200")
def review_detail_pages(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").selectExpr("'r' as repo", "o_orderstatus as kind", "o_orderkey as number", "cast(o_orderdate as string) as created")
    return captures.detail_pages(orders, orders.drop("created"), "1996-01-01").select("number")


@query("""SELECT CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'p' || doc_id ELSE 'n' || doc_id END AS id, 'my-folder' AS folder, '2024-03-0' || (doc_id % 9 + 1) || 'T10:00:00' AS modified_at, CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN doc_id % 3 = 0 THEN 'written'
    WHEN doc_id % 9 + 1 >= 3 AND doc_id % 3 = 1 AND doc_id % 9 + 1 > 2 THEN 'changed' ELSE 'present' END AS action, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS redactions FROM documents""")
def note_captures(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    notes = docs.selectExpr(
        "if(doc_id % 13 = 0, '', if(doc_id % 2 = 0, concat('x-coredata://S/ICNote/p', doc_id), concat('x://a/n', doc_id, '/'))) as uri", "'' as name", "' My Folder ' as folder", "'Friday, March 1, 2024 at 10:00:00' as created",
        "concat('Friday, March ', doc_id % 9 + 1, ', 2024 at 10:00:00') as modified", "if(doc_id % 4 = 0, '<div>password: x</div>', '<div>y</div>') as html",
    )
    known = docs.filter("doc_id % 3 <> 0").selectExpr("if(doc_id % 2 = 0, concat('p', doc_id), concat('n', doc_id)) as id", "if(doc_id % 3 = 1, '2024-03-02T10:00:00', '2024-04-01T10:00:00') as last_modified")
    return captures.note_captures(notes, known, "2024-03-03T00:00:00").select("id", "folder", "modified_at", "action", "redactions")


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '2024-01-01T10:00:00.5+02:00' ELSE 'odd' END AS timestamp, CASE event_id % 4 WHEN 0 THEN 'edited' WHEN 1 THEN 'formatted' WHEN 2 THEN 'asr' ELSE 'empty' END AS body_source,
    CASE WHEN event_id % 2 = 0 THEN '2024-01-01' ELSE 'odd' END || ' — ' || CASE event_id % 3 WHEN 0 THEN 'Slack' WHEN 1 THEN 'My Tool' ELSE 'Unknown app' END || ' (' || CASE WHEN event_id % 5 = 0 THEN '—' WHEN event_id % 5 < 3 THEN (event_id % 5 * 30) || '.0s' ELSE (event_id % 5 * 60 // 60) || 'm 1s' END || ')' AS title FROM events""")
def dictations(spark, sf_dir):
    e = "event_id % 4"
    rows = view(spark, sf_dir, "events").selectExpr(
        "event_id as id", f"if({e} = 0, 'e', '') as edited", f"if({e} <= 1, 'f', '') as formatted", f"if({e} <= 2, 'a', '') as raw", "if(event_id % 2 = 0, '2024-01-01 10:00:00.5 +02:00', 'odd') as ts",
        "element_at(array('com.tinyspeck.slackmacgap', 'org.x.my-tool', 'unknown'), cast(event_id % 3 as int) + 1) as app", "cast(case when event_id % 5 = 0 then null when event_id % 5 < 3 then event_id % 5 * 30 else event_id % 5 * 60 + 1 end as double) as duration",
    )
    return captures.dictations(rows).select("id", "timestamp", "body_source", "title")


@query("SELECT event_id AS id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%SZ') AS start_utc, CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'c' END AS body FROM events")
def calendar_records(spark, sf_dir):
    rows = view(spark, sf_dir, "events").selectExpr("cast(event_id as string) as external_id", "'' as title", "unix_millis(cast(ts as timestamp)) as start_ms", "0L as end_ms", "'' as url", "if(event_id % 2 = 0, 's', '') as summary", "'c' as content")
    return captures.calendar_records(rows).select(F.col("id").cast("long").alias("id"), "start_utc", "body")


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderdate AS d, CASE o_orderkey % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'on-device' END AS t, o_orderkey % 4 <> 3 AS audio, CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'native' END AS was FROM orders),
    w AS (SELECT *, t IS NULL AND audio AND (was IS NULL OR was = 'none') AS wants FROM m), r AS (SELECT *, CASE WHEN wants THEN row_number() OVER (PARTITION BY wants ORDER BY d DESC, id) <= 20 ELSE false END AS served FROM w),
    s AS (SELECT *, CASE WHEN t IS NOT NULL THEN t WHEN served THEN 'helper' WHEN wants THEN 'deferred' ELSE 'none' END AS source FROM r)
    SELECT id, source, CASE WHEN was IS NULL THEN CASE WHEN source = 'deferred' THEN 'deferred' ELSE 'written' END WHEN was = 'none' AND source NOT IN ('none', 'deferred') THEN 'upgraded' WHEN was = 'none' AND source = 'deferred' THEN 'deferred' ELSE 'present' END AS action FROM s""")
def memo_states(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    memos = orders.selectExpr("o_orderkey as id", "o_orderdate as recorded", "if(o_orderkey % 4 = 0, 'x', '') as native", "if(o_orderkey % 4 = 1, 'y', null) as sidecar", "o_orderkey % 4 <> 3 as audio")
    old = orders.filter("o_orderkey % 5 < 2").selectExpr("o_orderkey as id", "if(o_orderkey % 5 = 0, 'none', 'native') as source")
    return captures.memo_states(memos, old, True, 20, True).select("id", "source", "action")


@query("SELECT event_id AS id FROM events WHERE ts::DATE >= DATE '2024-01-20' - 5 AND event_id % 3 <> 0")
def overlap_scan_insert(spark, sf_dir):
    """The scan is bounded by the last run less an overlap, and the key settles what is new."""
    rows = view(spark, sf_dir, "events").selectExpr("event_id as id", "cast(ts as date) as day")
    new = captures.scan_floor(rows, "day", "2024-01-20T08:00:00", 5)
    return merge.insert_only(new, rows.filter("id % 3 = 0"), "id").filter("action = 'insert'").select("id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Ada <ada@x.example>' ELSE ' <c' || c_custkey || '@x.example>' END || '; <z@x.example>' AS attendees, CASE WHEN c_custkey % 2 = 0 THEN '77@y.example,log@crm.example' ELSE 'log@crm.example' END AS dropped, 'a' || chr(10) || 'b' AS actions,
    CASE WHEN c_custkey % 3 = 0 THEN 'https://u' ELSE 'v/' || c_custkey END AS url, CASE c_custkey % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-01-01T08:00:00Z' ELSE '1970-01-02T00:00:00Z' END AS date FROM customer""")
def summary_records(spark, sf_dir):
    rows = view(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as id", "c_name as title", "element_at(array('2024-01-01', '2024-01-01T10:00:00.25+02:00', '86400000'), cast(c_custkey % 3 as int) + 1) as date", "if(c_custkey % 3 = 0, ' https://u', '') as url",
        "if(c_custkey % 2 = 0, array(named_struct('name', ' Ada', 'email', 'ada@x.example'), named_struct('name', '', 'email', '77@y.example')), array(named_struct('name', '', 'email', concat('c', c_custkey, '@x.example')))) as attendees",
        "if(c_custkey % 2 = 0, array('ADA@x.example', 'z@x.example', 'log@crm.example'), array('z@x.example', 'log@crm.example')) as participants", "array(' k ', '') as keywords", "'' as overview", "' short ' as short_summary", "array('a ', ' ', 'b') as action_items",
    )
    found = captures.summary_records(rows, ("crm.example",), "v/")
    pairs = F.array_join(F.transform("attendees", lambda p: F.concat(p["name"], F.lit(" <"), p["email"], F.lit(">"))), ";")
    pairs = F.regexp_replace(F.regexp_replace(pairs, "; <", "; <"), ";(?! )", ";")
    return found.select(F.col("id").cast("long").alias("id"), pairs.alias("attendees"), F.array_join("dropped", ",").alias("dropped"), "actions", "url", "date")


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'stub' ELSE 'conflict' END AS state, doc_id % 3 = 0 AS content, doc_id % 2 = 0 AS same FROM documents""")
def page_states(spark, sf_dir):
    d = F.col("doc_id")
    head = F.when(d % 4 == 0, "---\nid: x\ntranscript_status: summary\n---\n").when(d % 4 <= 2, "---\ntranscript_status: not-retained-locally\n---\n").otherwise("none\n")
    page = F.concat(head, F.when(d % 4 == 1, "MARK\n").otherwise(""), F.lit("## Overview\n"), F.when(d % 3 == 0, "text\n").otherwise("\n---\npointer\n"))
    old, new = F.concat(F.lit("enriched_at: 1\n"), page), F.concat(page, F.when(d % 2 == 0, "enriched_at: 2").otherwise("more"))
    same = captures.same_but_stamp(old, F.concat(F.lit("enriched_at: 3\n"), F.when(d % 2 == 0, page).otherwise(new)))
    return view(spark, sf_dir, "documents").select(d.alias("id"), captures.page_state(page, "MARK").alias("state"), captures.has_content(page).alias("content"), same.alias("same"))


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 QUALIFY k <= 50""")
def pending_summaries(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    kept = orders.selectExpr("o_orderkey as id", "if(o_orderkey % 3 = 0, 'stub', 'summary') as status", "cast(null as string) as checked", "o_orderdate as date")
    left = captures.pending(captures.mark_unavailable(kept, orders.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey as id"), "2024-01-01")).limit(50)
    from pyspark.sql.window import Window as W

    return left.select("id", F.row_number().over(W.orderBy("date", "id")).cast("long").alias("k"))  # fifty rows


# --- sessions, names, readers ----------------------------------------------------------------


@query("""SELECT 's' || conv_id AS session, min(turn) AS first, count(*) FILTER (role IN ('user', 'assistant')) AS turns, max(turn) FILTER (turn % 3 = 0) AS file FROM conversations GROUP BY conv_id""")
def session_log_events(spark, sf_dir):
    said = F.when(F.col("turn") % 2 == 0, F.to_json(F.expr("named_struct('type', role, 'timestamp', '2024-01-01T00:00:00Z', 'content', text)"))).otherwise(F.to_json(F.expr("named_struct('type', role, 'message', named_struct('content', array(named_struct('type', 'text', 'text', text))))")))
    tool = F.when(F.col("turn") % 3 == 0, F.to_json(F.expr("named_struct('type', 'tool_use', 'name', 'Edit', 'input', named_struct('path', concat('/', lpad(turn, 6, '0'))))"))).otherwise(F.lit("no json {"))
    lines = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(said, F.lit("\n"), tool).alias("x")))).alias("p"), F.min("turn").alias("first"))
    files = lines.select(F.concat(F.lit("s"), "conv_id").alias("session"), F.array_join(F.transform("p", lambda p: p["x"]), "\n").alias("text"))
    got = payloads.session_events(files).groupBy("session").agg(F.count_if(F.col("role").isin("user", "assistant")).alias("turns"), F.max(F.substring("file", 2, 6).cast("long")).alias("file"))
    return got.join(lines.selectExpr("concat('s', conv_id) as session", "first"), "session").select("session", "first", "turns", "file")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'filename-gmt' WHEN 1 THEN 'folder-name' WHEN 2 THEN 'filename' ELSE 'file-mtime' END AS date_source, CASE o_orderkey % 4 WHEN 0 THEN 'Weekly sync' WHEN 1 THEN 'Weekly sync' WHEN 2 THEN 'Plan review' ELSE 'Chat about x' END AS title,
    CASE o_orderkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN 1 THEN TIMESTAMP '2024-01-02 20:30:00' WHEN 2 THEN TIMESTAMP '2024-07-02 19:30:00' END AS start, CASE o_orderkey % 4 WHEN 0 THEN DATE '2024-01-01' WHEN 1 THEN DATE '2024-01-02' WHEN 2 THEN DATE '2024-07-02' ELSE DATE '2020-05-05' END AS day FROM orders""")
def meeting_file_names(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    stem = F.when(k == 0, "GMT20240102-030405_Recording.transcript").when(k == 1, "audio_only.cc").when(k == 2, "2024-07-02 1430 Plan review recording").otherwise("Chat_about_x_transcript")
    folder = F.when(k == 0, "Weekly sync").when(k == 1, "2024-01-02 14.30.00 Weekly sync 81234567890")
    n = meetings.file_name(stem, folder, F.lit("2020-05-05 06:00:00").cast("timestamp"), "America/Chicago")
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), n["date_source"].alias("date_source"), n["title"].alias("title"), n["start"].cast("timestamp_ntz").alias("start"), n["local_date"].alias("day"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Plain' ELSE 'Weekly: sync' END AS title, CASE o_orderkey % 3 WHEN 1 THEN TIMESTAMP '2024-01-02 18:30:00' WHEN 2 THEN TIMESTAMP '2024-07-02 14:30:00' END AS utc FROM orders""")
def document_names(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, "Plain - Notes by Gemini.md").when(k == 1, "Weekly: sync - 2024/01/02 15:00 NST - Notes by Gemini").otherwise("Weekly: sync - 2024/07/02 9:30 - Notes by Gemini")
    n = documents.document_name(name, "America/Chicago")
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), n["title"].alias("title"), n["utc"].cast("timestamp_ntz").alias("utc"))


def _documents(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(
        F.lit("# Full notes\nJul 10, 2026\n## Sync "), d, F.lit("\nInvited [Ada Vale](mailto:ADA@x.example) [Bo](mailto:bo@x.example)\nAttachments [deck](u1)\nMeeting records [Transcript](u2) [video](u3)\n### Summary\nabout "), d,
        F.lit("\u000bsoft\n\n\n\nend\n*How is the quality of it\n### Decisions\nyes\n## Aligned\nall\n### Next steps\n- [ ] a\n- [x] b\nplain\n# Quick notes\n## Sync\nblurb\n### T1\nq"), d, F.lit("\n# Transcript\n### 00:01:05\n**Ada:** hi\n**Bo:** yo\nnoise\n### Transcription ended after 00:30:00\n"),
    )
    return documents.tabs(view(spark, sf_dir, "documents").select(d.alias("id"), text.alias("text")))


@query("""SELECT doc_id AS id, s AS section, CASE s WHEN 'Summary' THEN 'about ' || doc_id || chr(10) || 'soft' || chr(10) || chr(10) || 'end' WHEN 'Decisions' THEN 'yes' || chr(10) || '### Aligned' || chr(10) || 'all' ELSE '- [ ] a' || chr(10) || '- [x] b' || chr(10) || 'plain' END AS body
    FROM documents, (SELECT unnest(['Summary', 'Decisions', 'Next steps']) AS s)""")
def document_sections(spark, sf_dir):
    return documents.sections(_documents(spark, sf_dir))


@query("""SELECT doc_id AS id, 'Sync ' || doc_id AS title, DATE '2026-07-10' AS date, 'Ada Vale,Bo' AS participants, 'ada@x.example,bo@x.example' AS emails, 'u1,u3' AS attachments, 'u2' AS transcript_url, 2::BIGINT AS steps FROM documents""")
def document_headers(spark, sf_dir):
    h = documents.headers(_documents(spark, sf_dir))
    return h.select("id", "title", "date", *[F.array_join(c, ",").alias(c) for c in ("participants", "emails", "attachments")], "transcript_url", "steps")


@query("""SELECT doc_id AS id, unnest(['Ada', 'Bo']) AS speaker, 65::BIGINT AS start, unnest(['hi', 'yo']) AS text, unnest(['Sync', 'T1']) AS topic, unnest(['blurb', 'q' || doc_id]) AS body FROM documents""")
def document_transcript_and_topics(spark, sf_dir):
    lines = _documents(spark, sf_dir)
    said = documents.transcript(lines).withColumn("k", F.when(F.col("speaker") == "Ada", "Sync").otherwise("T1"))
    return said.join(documents.topics(lines).withColumnRenamed("topic", "k"), ["id", "k"]).select("id", "speaker", "start", "text", F.col("k").alias("topic"), "body")


@query("""SELECT o_orderkey AS id, 'edt' AS zone, 24 * 60 + CASE WHEN o_orderkey % 2 = 0 THEN -300 ELSE 570 END AS ahead, CASE WHEN o_orderkey % 2 = 0 THEN 'CST' ELSE '' END AS name, CASE WHEN o_orderkey % 200 < 60 THEN (o_orderkey % 200) || 'm' ELSE (o_orderkey % 200 // 60) || 'h ' || printf('%02d', o_orderkey % 200 % 60) || 'm' END AS human
    FROM orders WHERE o_orderkey % 200 > 0""")
def zones_and_spans(spark, sf_dir):
    k = F.col("o_orderkey")
    local = F.lit("2024-07-01 12:00:00").cast("timestamp")
    ahead = D.offset_minutes(F.when(k % 2 == 0, "none").otherwise("acst"), local, "America/Chicago")
    name = F.when(k % 2 == 0, D.zone_abbreviation(F.lit("2024-01-01 12:00:00").cast("timestamp"), "America/Chicago")).otherwise(F.coalesce(D.zone_abbreviation(local, "No/Where"), F.lit("")))
    return view(spark, sf_dir, "orders").filter(k % 200 > 0).select(k.alias("id"), F.lit("edt").alias("zone"), (ahead + 1440).alias("ahead"), name.alias("name"), D.duration(k % 200).alias("human"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '### Top' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '#### Next Steps' || chr(10) || '- a' || chr(10) || '1. b' || chr(10) || '### End' || chr(10) || '- c' ELSE '### Deep' || chr(10) || '- x' END AS body, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS n FROM customer""")
def summary_spine(spark, sf_dir):
    body = F.when(F.col("c_custkey") % 2 == 0, "# Top\n```\n# code\n```\n## Next Steps\n- a\n1. b\n# End\n- c").otherwise("### Deep\n- x\n")
    rows = spread(view(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), T.spine(body).alias("body"))
    return rows.withColumn("n", T.next_steps(F.col("body")))


# --- meetings ------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    entry = F.to_json(F.expr("""named_struct('uuid', if(o_orderkey % 5 = 0, '', concat('u', o_orderkey)), 'topic', if(o_orderkey % 4 = 0, '', concat('Sync ', o_custkey)), 'start_time', if(o_orderkey % 11 = 0, '', date_format(o_orderdate, "yyyy-MM-dd'T'10:00:00.5+02:00")),
        'end_time', if(o_orderkey % 3 = 0, date_format(o_orderdate, "yyyy-MM-dd'T'08:30:00'Z'"), ''), 'duration', if(o_orderkey % 3 = 1, 15, null), 'host_email', 'HOST@x.example', 'participants', array('ann@x.example', 'Bob'),
        'summary', named_struct('meeting_topic', 'From summary', 'summary_content', if(o_orderkey % 2 = 0, '# Notes\n## Next steps\n- go', ''), 'summary_overview', 'over', 'next_steps', array('s1', ' '), 'meeting_id', '9'),
        'transcript_vtt', if(o_orderkey % 7 = 0, 'WEBVTT\n\n00:00:01.000 --> 00:01:40.000\nAda: hi\n', ''))"""))
    pages = spread(view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"meetings": ['), entry, F.lit("]}"))).otherwise(F.concat(F.lit("["), entry, F.lit("]"))).alias("text"))
    return meetings.entries(pages)


_ENTRY = """e AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 4 = 0 THEN 'From summary' ELSE 'Sync ' || o_custkey END AS title, o_orderdate::DATE + INTERVAL 8 HOUR AS start, o_orderkey % 5 = 0 AS unnamed, o_orderkey % 7 = 0 AS spoken,
    CASE WHEN o_orderkey % 3 = 0 THEN 1800 WHEN o_orderkey % 3 = 1 THEN 900 WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END::BIGINT AS duration, o_orderkey % 2 = 0 AS own FROM orders WHERE o_orderkey % 11 <> 0)"""


@query(f"""WITH {_ENTRY} SELECT CASE WHEN unnamed THEN 'file-' || substr(sha1(replace(lower(title), ' ', '-') || '|' || strftime(start, '%Y-%m-%d %H:%M')), 1, 12) ELSE 'u' || page END AS id, title, start, duration, 'Bob' AS participants, 'ann@x.example,host@x.example' AS emails,
    CASE WHEN own THEN '### Notes' || chr(10) || '#### Next steps' || chr(10) || '- go' ELSE 'over' END AS summary, CASE WHEN own THEN '' ELSE 's1' END AS steps, 1::BIGINT AS n_steps, CASE WHEN spoken THEN 1 ELSE 0 END::BIGINT AS segments FROM e""")
def meeting_entries(spark, sf_dir):
    found, _ = meetings.from_entries(_entries(spark, sf_dir))
    return found.select("id", "title", F.col("start").cast("timestamp_ntz").alias("start"), "duration", F.array_join("participants", ",").alias("participants"), F.array_join("emails", ",").alias("emails"), "summary", F.array_join("steps", ",").alias("steps"), "n_steps", F.size("segments").cast("long").alias("segments"))


@query("SELECT o_orderkey AS page, 'entry has no start_time' AS error FROM orders WHERE o_orderkey % 11 = 0")
def meeting_entry_errors(spark, sf_dir):
    return meetings.from_entries(_entries(spark, sf_dir))[1].select("page", "error")


def _files(spark, sf_dir):
    vtt = F.concat(F.lit("WEBVTT\n\n00:00:01.000 --> 00:00:50.000\nCy: yes\n"), F.when(F.col("o_orderkey") % 2 == 0, "\n00:00:51.000 --> 00:00:59.000\nDi: no\n").otherwise(""))
    orders = view(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0")
    k = F.col("o_orderkey")
    return orders.select(F.concat(F.lit("/x/"), k, F.lit(".vtt")).alias("path"), F.lit(None).cast("string").alias("folder"), F.concat(F.lit("2024-01-01 0900 Talk "), F.floor(k / 2)).alias("stem"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("mtime"), vtt.alias("vtt"), F.when(k % 2 == 1, F.concat(F.lit(" n"), k)).otherwise(F.lit("")).alias("notes"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey // 2 AS g, o_orderkey % 2 = 0 AS two FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT 'Talk ' || g AS title, bool_or(two)::INT + 1 AS segments, CASE WHEN bool_or(two) THEN 59 ELSE 50 END::BIGINT AS duration, coalesce(max(CASE WHEN NOT two THEN 'n' || k END), '') AS notes, CASE WHEN bool_or(two) THEN 'Cy,Di' ELSE 'Cy' END AS participants FROM f GROUP BY g""")
def meeting_files(spark, sf_dir):
    return meetings.from_files(_files(spark, sf_dir)).select("title", F.size("segments").alias("segments"), "duration", "notes", F.array_join("participants", ",").alias("participants"))


def _records(spark, sf_dir, rows):
    """orders-shaped rows (id, input, title, start, duration, summary, said, notes, ordinal) as records."""
    none = F.array().cast("array<string>")
    said = F.when(F.col("said"), F.expr("array(named_struct('start', 0L, 'speaker', 'Ada', 'text', 'hi'))")).otherwise(F.array().cast(meetings.SEGMENTS)).cast(meetings.SEGMENTS)
    return rows.select("id", "input", "title", "start", F.lit("api").alias("date_source"), F.to_date("start").alias("local_date"), "duration", F.lit("").alias("host"), none.alias("participants"), F.split("emails", ",").alias("emails"), "summary", none.alias("steps"), F.lit(0).cast("long").alias("n_steps"), F.lit("").alias("url"), said.alias("segments"), "notes", "ordinal")


@query("""SELECT 'a' || c_custkey AS id, 'api' AS input, CASE WHEN c_custkey % 2 = 0 THEN 'S2' ELSE 'S1' END AS summary, CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE 7 END::BIGINT AS duration, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS segments, CASE WHEN c_custkey % 3 = 0 THEN 'fn' ELSE '' END AS notes, 'x@e,y@e' AS emails FROM customer
    UNION ALL SELECT 'f' || c_custkey, 'file', '', 50, 1, 'fn', '' FROM customer WHERE c_custkey % 3 = 1""")
def meeting_merge(spark, sf_dir):
    """Two answers of an interface for each meeting, and files near some of them."""
    c = view(spark, sf_dir, "customer").withColumn("start", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, c_custkey, 0, 0)"))
    api = c.selectExpr("concat('a', c_custkey) as id", "'api' as input", "'T' as title", "start", "if(c_custkey % 3 = 0, 0L, 7L) as duration", "if(c_custkey % 2 = 0, '', 'S1') as summary", "false as said", "'' as notes", "0L as ordinal", "'x@e' as emails")
    again = c.selectExpr("concat('a', c_custkey) as id", "'api' as input", "'T' as title", "start", "0L as duration", "'S2' as summary", "false as said", "'' as notes", "1L as ordinal", "'y@e' as emails")
    files = c.filter("c_custkey % 3 < 2").selectExpr("concat('f', c_custkey) as id", "'file' as input", "'T' as title", "start + make_dt_interval(0, 0, if(c_custkey % 3 = 0, 1, 20), 0) as start", "50L as duration", "'' as summary", "true as said", "'fn' as notes", "cast(c_custkey as long) as ordinal", "'' as emails")
    found = meetings.merge_sources(_records(spark, sf_dir, api.union(again)), _records(spark, sf_dir, files))
    return found.select("id", "input", "summary", "duration", F.size("segments").alias("segments"), "notes", F.array_join("emails", ",").alias("emails"))


@query("""SELECT 'm' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'old-' || o_orderkey || '.md' ELSE strftime(TIMESTAMP '2000-01-01' + INTERVAL 1 HOUR * o_orderkey, '%Y-%m-%d') || '-sync-' || substr(sha1('m' || o_orderkey), 1, 8) || '.md' END AS file, CASE WHEN o_orderkey % 4 <> 0 THEN 'insert' ELSE 'update' END AS action,
    CASE WHEN o_orderkey % 5 = 1 THEN 'only-content' ELSE 'pointer' END AS policy, CASE WHEN o_orderkey % 5 = 1 THEN true ELSE false END AS included, CASE WHEN o_orderkey % 6 = 0 THEN 'x=' || o_orderkey ELSE '' END AS links FROM orders WHERE o_orderkey % 5 <> 0""")
def meeting_ingest(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").withColumn("start", F.expr("timestamp'2000-01-01 00:00:00' + make_dt_interval(0, cast(o_orderkey as int), 0, 0)"))
    rows = _records(spark, sf_dir, orders.selectExpr("concat('m', o_orderkey) as id", "'api' as input", "'Sync' as title", "start", "60L as duration", "if(o_orderkey % 5 < 2, '', 's') as summary", "o_orderkey % 5 in (1, 2) as said", "'' as notes", "0L as ordinal", "'' as emails"))
    others = orders.filter("o_orderkey % 6 = 0").selectExpr("'x' as source", "o_orderkey as id", "start + make_dt_interval(0, 0, 9, 0) as start")
    known = orders.filter("o_orderkey % 4 = 0").selectExpr("concat('m', o_orderkey) as id", "concat('old-', o_orderkey, '.md') as file", "'0' as hash")
    plan = meetings.ingest(rows.drop("ordinal"), others, known)
    links = F.coalesce(F.array_join(F.transform(F.map_entries("links"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit(""))
    return plan.select("id", "file", "action", "policy", "included", links.alias("links"))


@query("""SELECT c_custkey AS id, '**Ada** (00:00:05) a b' || chr(10) || chr(10) || '**Bo** (01:01:01) c' AS text, c_custkey % 2 = 0 AS good FROM customer""")
def transcript_text(spark, sf_dir):
    s = F.expr("array(named_struct('start', 5L, 'speaker', 'Ada', 'text', 'a'), named_struct('start', 9L, 'speaker', 'Ada', 'text', 'b'), named_struct('start', 3661L, 'speaker', 'Bo', 'text', 'c'))")
    name = F.when(F.col("c_custkey") % 2 == 0, "Ada de la Vega").otherwise("one two three four five six seven")
    return view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), meetings.transcript_text(s).alias("text"), meetings.valid_name(name).alias("good"))


@query("""SELECT c_custkey::VARCHAR AS id, 'Call' AS title, 'Ada,Bo' AS participants, 'a@x.example,b@y.example' AS emails, 'Ada' AS internal, 'b@y.example,Bo' AS external, CASE WHEN c_custkey % 4 = 0 THEN 'hl' ELSE '' END AS highlights, CASE WHEN c_custkey % 4 = 1 THEN 'do it' ELSE '' END AS steps, c_custkey % 3 = 0 AS private,
    CASE WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE '' END AS outline, c_custkey % 4 <> 3 AS has_content FROM customer""")
def call_records(spark, sf_dir):
    call = F.parse_json(F.to_json(F.expr("""named_struct('metaData', named_struct('id', c_custkey, 'title', ' Call ', 'started', '2024-01-01T10:00:00+02:00', 'duration', 60, 'isPrivate', c_custkey % 3 = 0),
        'parties', array(named_struct('emailAddress', 'A@x.example', 'name', 'Ada', 'affiliation', 'Internal'), named_struct('emailAddress', 'b@y.example', 'name', '', 'affiliation', 'External'), named_struct('emailAddress', '', 'name', 'Bo', 'affiliation', 'External')),
        'content', named_struct('highlights', array(named_struct('title', if(c_custkey % 2 = 0, 'Good', 'Next Steps'), 'items', array(named_struct('text', case c_custkey % 4 when 0 then 'hl' when 1 then 'do it' else '' end), named_struct('text', ' ')))),
            'outline', if(c_custkey % 4 = 2, array(named_struct('section', c_mktsegment, 'startTime', 5, 'items', array(named_struct('text', 'i')))), array())))""")))
    rows = view(spark, sf_dir, "customer").select(call.alias("call")).filter(meetings.is_call(F.col("call")))
    found = meetings.call_records(rows)
    return found.select("id", F.trim("title").alias("title"), *[F.array_join(c, ",").alias(c) for c in ("participants", "emails", "internal", "external", "highlights", "steps")], "private", F.array_join(F.transform("outline", lambda o: o["section"]), ",").alias("outline"), "has_content")


@query("""SELECT 'raw/' || CASE WHEN s_suppkey % 2 = 0 THEN 'zoom' ELSE 'teams' END || '/' || s_suppkey || '.md' AS rel, CASE WHEN s_suppkey % 2 = 0 THEN 'raw-zoom-meeting' ELSE 'raw-teams-meeting' END AS type, 'Sync: ' || s_name AS title,
    (DATE '2024-01-01' + s_nationkey::INT)::VARCHAR AS date, CASE WHEN s_suppkey % 3 = 0 THEN '1h 15m' ELSE '' END AS duration, s_suppkey % 4 = 0 AS linked, 'mine ' || s_suppkey % 7 AS kept, CASE WHEN s_suppkey % 5 = 0 THEN '**Ada** ' || s_acctbal::DECIMAL(12, 2) ELSE '_(transcript file had no speech)_' END AS transcript FROM supplier""")
def pages_written_and_read(spark, sf_dir):
    """Meeting pages written by the sink over older ones whose own region stays, and read again as notes."""
    import uuid

    vault, marks = f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}", ("<!-- mine -->", "<!-- /mine -->")
    key = F.col("s_suppkey")
    rows = view(spark, sf_dir, "supplier").repartition(8).selectExpr(
        "s_suppkey", "cast(s_suppkey as string) as zoom_id", "cast(s_suppkey as string) as teams_meeting_id", "concat('Sync: ', s_name) as title", "date_add(date'2024-01-01', cast(s_nationkey as int)) as date", "if(s_suppkey % 3 = 0, '1h 15m', '') as duration", "array('Ada', 'Bo') as participants",
        "if(s_suppkey % 4 = 0, map('gemini', named_struct('id', 'g1', 'note', '[[G]]')), map()) as links", "if(s_suppkey % 5 = 0, concat('**Ada** ', cast(s_acctbal as decimal(12, 2))), '') as transcript",
    )
    rel = F.concat(F.lit("raw/"), F.when(key % 2 == 0, "zoom").otherwise("teams"), F.lit("/"), key, F.lit(".md"))
    region = lambda c: F.concat(F.lit(f"\n{marks[0]}\n"), c, F.lit(f"\n{marks[1]}\n"))
    text = F.when(key % 2 == 0, forms.page(rows, "zoom")).otherwise(forms.page(rows, "teams"))
    page_sink.save(rows.select(rel.alias("rel"), F.concat(F.lit("old"), region(F.concat(F.lit("mine "), key % 7))).alias("text")), arrow_uri(spark, vault), *marks)
    page_sink.save(rows.select(rel.alias("rel"), F.concat(text, region(F.lit("new"))).alias("text")), arrow_uri(spark, vault), *marks)
    found, f = N.scan(spark, vault), F.col("fm")
    said = F.regexp_extract("text", r"## Transcript\n\n(.*)\n", 1)
    return found.select("rel", fm.scalar(f, "type").alias("type"), fm.scalar(f, "title").alias("title"), fm.scalar(f, "date").alias("date"), fm.scalar(f, "duration").alias("duration"), F.contains("text", F.lit("> Also captured by Gemini: [[G]]")).alias("linked"), F.regexp_extract("text", f"{marks[0]}\n(.*)\n{marks[1]}", 1).alias("kept"), said.alias("transcript"))


# --- small operators that had no query ---------------------------------------------------------


@query("SELECT o_orderkey AS id, 't' || o_orderkey AS transcript FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT -o_orderkey, 'orphan' FROM orders WHERE o_orderkey % 5 = 0")
def attach_transcripts(spark, sf_dir):
    calls = view(spark, sf_dir, "orders").selectExpr("o_orderkey as id")
    given = calls.filter("id % 2 = 0").selectExpr("id", "concat('t', id) as transcript").union(calls.filter("id % 5 = 0").selectExpr("-id", "'orphan'"))
    joined, orphans = matching.attach_transcripts(calls, given)
    return joined.union(orphans)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 1000 >= 300")
def finished_files(spark, sf_dir):
    rows = view(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "timestamp'2024-01-01 12:00:00' - make_dt_interval(0, 0, 0, o_orderkey % 1000) as mtime")
    return records.finished(rows, "2024-01-01 12:00:00").select("id")


@query("""SELECT c_custkey AS id, c_mktsegment || ',L9' AS names, CASE c_custkey % 3 WHEN 0 THEN 'e/edited' WHEN 1 THEN ' /formatted' ELSE 'a/asr' END AS body, c_custkey % 2 = 0 AS valid, 'home-me-proj' AS slug, CASE WHEN c_custkey % 4 = 0 THEN 'area' WHEN c_custkey % 4 = 1 THEN 'project' ELSE 'concept' END AS target FROM customer""")
def small_lookups(spark, sf_dir):
    k = F.col("c_custkey")
    body = records.pick_body(F.when(k % 3 == 0, "e").otherwise(""), F.when(k % 3 <= 1, " ").otherwise(""), F.lit("a"))
    target = records.infer_target(F.concat(F.lit("my-"), (k % 4).cast("string")), F.array(F.lit("My 0")), F.array(F.lit("my1"), F.lit("My-0")))
    names = records.names_of(F.array(F.lit("L1"), F.lit("L9")), F.create_map(F.lit("L1"), F.col("c_mktsegment")))
    return view(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(names, ",").alias("names"), F.concat_ws("/", body["body"], body["source"]).alias("body"), records.valid_id(F.when(k % 2 == 0, "a_b-1").otherwise("../x")).alias("valid"), records.project_slug(F.lit("--home-me-proj")).alias("slug"), target.alias("target"))


@query("""SELECT doc_id AS id, 'Big ' || 'Idea' AS title_case, 'T' || doc_id AS title, 'notes of it' AS section, CASE WHEN doc_id % 2 = 0 THEN 'Plan' ELSE 'Sync' END AS clean, TIMESTAMP '2024-03-04 09:30:00' AS met, '2024-01-01 10:00:00' AS bare, DATE '2024-01-02' AS first, CASE WHEN doc_id % 2 = 0 THEN 'raw-src' ELSE 'wispr-meetings' END AS source FROM documents""")
def text_shapes(spark, sf_dir):
    from ..sources import notes as N

    even = F.col("doc_id") % 2 == 0
    body = F.concat(F.lit("intro\n# T"), "doc_id", F.lit("\n## Summary\nnotes of it\n\n## Next\nx"))
    source = N.source_of(F.when(even, "raw/raw-src/a.md").otherwise("raw/wispr/meetings/b.md"))
    return view(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), T.title_case(F.lit("big-idea")).alias("title_case"), T.title(body, F.lit("none")).alias("title"), T.section(body, "Summary", True).alias("section"), T.clean_title(F.when(even, "2024-01-01 — Plan").otherwise("Sync (about 5m)")).alias("clean"),
        D.meeting_date(F.when(even, "2024-03-04 09:30").otherwise("03/04/2024 09:30 AM")).cast("timestamp_ntz").alias("met"), D.without_offset(F.when(even, "2024-01-01T10:00:00.123Z").otherwise("2024-01-01 10:00:00 +02:00")).alias("bare"), D.first_date(F.lit("none"), F.lit("2024-01-02T00:00")).alias("first"), source.alias("source"),
    )


@query("SELECT event_id AS id FROM events WHERE ts::DATE >= DATE '2024-01-20' - 3")
def lookback_rows(spark, sf_dir):
    return merge.since(view(spark, sf_dir, "events").selectExpr("event_id as id", "ts"), "ts", "2024-01-20T10:00:00", 3, "2024-02-01").select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'refined' ELSE 'live' END AS source, doc_id % 2 = 0 AS good FROM documents")
def preferred_transcripts(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "explode(if(doc_id % 2 = 0, array('live', 'refined'), array('live'))) as source")
    return transcripts.prefer(docs, "id", "source", ["refined", "live"]).withColumn("good", F.col("source") == "refined")


@query("SELECT 'c' || c_mktsegment AS dir, 's' || c_custkey AS stem, 'c' || c_mktsegment || '/s' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.vtt' ELSE '.md' END AS sidecar FROM customer")
def sidecar_files(spark, sf_dir):
    files = view(spark, sf_dir, "customer").selectExpr("concat('c', c_mktsegment) as dir", "concat('s', c_custkey) as stem", "explode(if(c_custkey % 2 = 0, array('md', 'vtt', 'mp4'), array('md', 'mp4'))) as ext").withColumn("path", F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext"))
    return payloads.sidecars(files)


@query("""SELECT doc_id AS id, 'plan-' || doc_id AS slug, doc_id % 50 + 1 AS items, 'a,b' AS sources, DATE '2024-01-01' AS first, DATE '2024-01-09' AS latest FROM documents""")
def report_rows(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.lit("| # | Keywords |\n|---|---|\n| 1 | Plan; x | 2024-01-01 | 2024-01-09 | "), d % 50 + 1, F.lit(" | a, b | `plan-"), d, F.lit("` | x |\nother"))
    rows = view(spark, sf_dir, "documents").select(d.alias("id"), F.explode(payloads.report_rows(text)).alias("r"))
    return rows.select("id", "r.slug", F.col("r.items").cast("long").alias("items"), F.array_join("r.sources", ",").alias("sources"), "r.first", "r.latest")


@query("SELECT type, string_agg(name, ',' ORDER BY lower(name)) AS names FROM (SELECT p_type AS type, min(p_brand) || p_size AS name FROM part WHERE p_size % 2 = 1 GROUP BY p_type, p_size) GROUP BY type")
def entity_index(spark, sf_dir):
    rows = view(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type"), "p_size").agg(F.concat(F.min("p_brand"), "p_size").alias("name"), (F.col("p_size") % 2).alias("mention_count"))
    return people.entity_index(rows).select("type", F.array_join("names", ",").alias("names"))


@query("SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1")
def richest_with_notes(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    both = rows.selectExpr("conv_id as id", "n", "0 as ordinal", "'' as notes").union(rows.selectExpr("conv_id", "n - 1", "1", "'kept'"))
    return segments.keep_richest(both, "id", "n", "ordinal", "notes").filter("notes = 'kept'").select("id", "n")


# --- pages of services ---------------------------------------------------------------------------


@query("""SELECT 'm' || doc_id AS id, 't' || doc_id % 9 AS thread, CASE WHEN doc_id % 3 = 0 THEN 'plain ' || doc_id WHEN doc_id % 3 = 1 THEN 'given' ELSE 'deep' END AS body, 'next' AS next_page FROM documents""")
def mail_pages(spark, sf_dir):
    part = F.expr("base64(encode(concat('plain ', doc_id), 'UTF-8'))")
    page = F.concat(
        F.lit('{"nextPageToken": "next", "threads": [{"id": "t'), F.col("doc_id") % 9, F.lit('", "messages": [{"id": "m'), "doc_id", F.lit('", "textBody": "'), F.when(F.col("doc_id") % 3 == 1, "given").otherwise(""),
        F.lit('", "payload": {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/html", "body": {"data": ""}}, {"mimeType": "multipart/x", "parts": [{"mimeType": "text/plain", "body": {"data": "'),
        F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(part, "=", "")).when(F.col("doc_id") % 3 == 2, "ZGVlcA").otherwise(""), F.lit('"}}]}]}}]}]}'),
    )
    rows = pages.mail(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), page.alias("text")))
    return rows.select("id", "thread", F.coalesce("decoded", "plain").alias("body"), "next_page")


@query("SELECT 'L' || doc_id AS id, 'n' || doc_id AS name FROM documents WHERE doc_id % 4 < 3")
def label_pages(spark, sf_dir):
    k = F.col("doc_id") % 4
    entry = F.concat(F.lit('{"'), F.when(k == 0, "id").otherwise("labelId"), F.lit('": "L'), "doc_id", F.lit('", "'), F.when(k == 1, "displayName").when(k == 3, "title").otherwise("name"), F.lit('": "n'), "doc_id", F.lit('"}'))
    return pages.label_names(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.when(k == 2, F.concat(F.lit("["), entry, F.lit("]"))).otherwise(F.concat(F.lit('{"labels": ['), entry, F.lit("]}"))).alias("text")))


@query("SELECT doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN 'c1' ELSE 'c2' END AS cursor, doc_id::VARCHAR AS id FROM documents")
def board_pages(spark, sf_dir):
    k = F.col("doc_id") % 3
    items = F.concat(F.lit('[{"id": '), "doc_id", F.lit("}]"))
    text = F.when(k == 0, F.concat(F.lit('{"nextCursor": "c1", "items": '), items, F.lit("}"))).when(k == 1, F.concat(F.lit('{"data": {"cursor": "c2", "items_page": {"items": '), items, F.lit("}}}"))).otherwise(F.concat(F.lit('{"data": {"nextCursor": "c2", "items": '), items, F.lit("}}")))
    return pages.board(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), text.alias("text"))).select("page", "cursor", F.try_variant_get("item", "$.id", "string").alias("id"))


@query("""SELECT conv_id AS page, turn, role AS sender FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, -1, 'malformed JSON' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 1""")
def chat_pages(spark, sf_dir):
    """Even conversations answer with arrays, odd ones with text, and some not at all."""
    item = F.to_json(F.expr("named_struct('ts', concat('1.', turn), 'username', role, 'text', text)"))
    rows = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("m"))
    text = F.when(F.col("conv_id") % 5 == 1, "{").when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"messages": ['), F.array_join("m", ", "), F.lit("]}"))).otherwise('{"messages": "=== Message at x ==="}')
    got = rows.select(F.col("conv_id").alias("page"), text.alias("text"))
    even = got.filter("page % 2 = 0 and page % 5 <> 1").union(got.filter("page % 2 = 0 and page % 5 = 1").join(rows.selectExpr("conv_id as page", "m"), "page").select("page", F.concat(F.lit('{"messages": ['), F.array_join("m", ", "), F.lit("]}"))))
    _, messages = pages.chat(even.union(got.filter("page % 2 = 1")))
    found = pages.chat_messages(messages, even.select("page", F.lit("c").alias("channel"), F.lit("channel").alias("kind")).withColumn("page", F.col("page")))
    named = messages.select("page", F.try_variant_get("m", "$.ts", "string").alias("ts"), F.try_variant_get("m", "$.username", "string").alias("sender"))
    assert set(found.columns) >= {"channel", "ts", "username", "text"}
    return named.select("page", F.substring("ts", 3, 9).cast("long").alias("turn"), "sender").union(pages.malformed(got).select("page", F.lit(-1).cast("long"), "error"))


@query("SELECT CASE WHEN doc_id % 3 = 1 THEN 'D' || doc_id ELSE 'd' || doc_id END AS id, 'N' AS name, CASE doc_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'peeled' ELSE 'inner' END AS text FROM documents WHERE doc_id % 7 <> 0")
def document_pages(spark, sf_dir):
    k = F.col("doc_id") % 3
    named = F.when(F.col("doc_id") % 7 == 0, '"title": "N"').when(k == 1, F.concat(F.lit('"url": "https://x/d/D'), "doc_id", F.lit('/edit", "title": "N"'))).otherwise(F.concat(F.lit('"file_id": "d'), "doc_id", F.lit('", "name": "N"')))
    body = F.when(k == 0, '"markdown": "plain"').when(k == 1, '"content": {"result": "peeled"}').otherwise('"result": "{\\"result\\": \\"inner\\"}"')
    entry = F.concat(F.lit("{"), named, F.lit(", "), body, F.lit("}"))
    text = F.when(k == 0, F.concat(F.lit('{"docs": ['), entry, F.lit("]}"))).when(k == 1, F.concat(F.lit("["), entry, F.lit("]"))).otherwise(entry)
    return pages.docs(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), text.alias("text"))).select("id", "name", "text")


@query("SELECT c_custkey AS page, c_custkey::VARCHAR AS call, CASE WHEN c_custkey % 3 = 2 THEN 'T' || c_custkey END AS transcript FROM customer")
def call_pages(spark, sf_dir):
    k = F.col("c_custkey") % 3
    call = F.concat(F.lit('{"metaData": {"id": "'), "c_custkey", F.lit('"}}'))
    said = F.concat(F.lit('"callTranscripts": [{"callId": "T'), "c_custkey", F.lit('", "transcript": []}]'))
    inner = F.concat(F.lit('{"calls": ['), call, F.lit("]}"))
    text = F.when(k == 0, F.concat(F.lit("[["), call, F.lit("]]"))).when(k == 1, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), inner.alias("text"))).alias("content")))).otherwise(F.concat(F.lit('{"result": {"calls": ['), call, F.lit("], "), said, F.lit("}}")))
    found, given = pages.calls(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), text.alias("text")))
    return found.select("page", F.try_variant_get("call", "$.metaData.id", "string").alias("call")).join(given.selectExpr("page", "id as transcript"), "page", "left")


@query("""SELECT c_custkey AS id, '[plain one, "a: b", "42", "yes", c' || c_custkey || ']' AS inline, 'k:' || chr(10) || '- a' || chr(10) || '- ''[[b]]''' AS block, '"x: y"' AS scalar, '"q \\"z\\" w"' AS quoted FROM customer""")
def yaml_emitters(spark, sf_dir):
    values = F.array(F.lit("plain one"), F.lit("a: b"), F.lit("42"), F.lit("yes"), F.concat(F.lit("c"), "c_custkey"))
    return view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.yaml_inline_list(values).alias("inline"), T.yaml_block("k", F.array(F.lit("a"), F.lit("[[b]]"))).alias("block"), T.yaml_scalar(F.lit("x: y")).alias("scalar"), T.yaml_quoted(F.lit('q "z"\nw')).alias("quoted"))


@query("SELECT count(*) AS n FROM orders")
def request_batches(spark, sf_dir):
    return pages.batches(view(spark, sf_dir, "orders").selectExpr("o_orderkey as id")).agg(F.sum(F.size("ids")).cast("long").alias("n"))
