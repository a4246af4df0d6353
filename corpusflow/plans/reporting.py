"""Queries of pages, reports and what completes the capture operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..operators import audit, knowledge, matching, meetings, merge, pages, records, reports, segments, threads
from ..session import arrow_uri, shared_dir
from ..sources import frontmatter as fm
from ..sources import notes as N
from ..sources import payloads, readers, transcripts
from ..sources.views import view
from . import catalogue
from .catalogue import query


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- pages ---------------------------------------------------------------------------------


@query("""SELECT conv_id AS session, '# me-proj · 2024-01-01 00:00 session' AS title, count(*) AS turns, '- `/f0`' AS files FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def session_pages(spark, sf_dir):
    events = view(spark, sf_dir, "conversations").selectExpr("conv_id as session", "turn as line", "timestamp'2024-01-01' as ts", "role", "text", "'/f0' as file")
    found = segments.sessions(events).withColumn("started", F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("ended", F.col("started"))
    page = reports.session_page(records.project_slug(F.lit("-me-proj")), records.project_path(F.lit("-me-proj")))
    rows = found.select("session", page.alias("page"))
    return rows.select("session", F.regexp_extract("page", "(?m)^(# .*)$", 1).alias("title"), F.regexp_extract("page", "(?m)^turn_count: (.*)$", 1).cast("long").alias("turns"), F.regexp_extract("page", "(?m)^(- `.*)$", 1).alias("files"))


@query("""SELECT doc_id AS id, '---' || chr(10) || 'date: 2024-01-01' || chr(10) || 'id: c' || doc_id || chr(10) || 'type: raw-distill' || chr(10) || 'resource_note: "[[my-note]]"' || chr(10) || 'source_session: ' || CASE WHEN doc_id % 2 = 0 THEN '"null"' ELSE 's' END || chr(10) || 'topic: top' || chr(10) || '---' || chr(10) || chr(10) || '# Distill capture · my-note' || chr(10) || chr(10) || '## Exchange (redacted)' || chr(10) || chr(10) || 'say password=REDACTED' || chr(10) AS record,
    '---' || chr(10) || 'date: 2024-01-01' || chr(10) || 'id: c' || doc_id || chr(10) || 'type: distilled-resource' || chr(10) || 'source_capture_id: "[[c' || doc_id || ']]"' || chr(10) || 'topic: top' || chr(10) || '---' || chr(10) || chr(10) || '# My Note' || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || '<s>' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'mine' ELSE '' END || chr(10) || '<e>' || chr(10) AS note FROM documents""")
def capture_pages(spark, sf_dir):
    k, one = F.col("doc_id"), F.lit
    cid = F.concat(one("c"), k)
    record = reports.capture_record(cid, one("2024-01-01"), one("top"), one("my-note"), one("say password: x \n"), F.when(k % 2 == 1, "s"))
    note = reports.resource_note(cid, one("2024-01-01"), one("top"), one("my-note"), one("body \n"), F.when(k % 3 == 0, "mine"), "<s>", "<e>")
    return view(spark, sf_dir, "documents").select(k.alias("id"), record.alias("record"), note.alias("note"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Ada-Vale' ELSE 'Bo' END AS file, c_custkey % 2 = 0 AS dossier, CASE WHEN c_custkey % 2 = 0 THEN 'Ada Vale' ELSE 'Bo' END AS title, CASE WHEN c_custkey % 3 = 0 THEN '- (none yet)' ELSE 'kept' END AS region, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE '2024-01-02' END AS seen FROM customer""")
def person_and_entity_pages(spark, sf_dir):
    rows = view(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "if(c_custkey % 2 = 0, 'Ada-Vale', 'Bo') as file", "'Ada' as name", "'a@x' as email", "'x' as company", "'x.example' as domain", "if(c_custkey % 2 = 0, 1, 3) as new_tier", "1L as mention_count", "date'2024-01-02' as last_seen",
        "'org' as type", "'X' as canonical_id", "'about' as description", "cast(null as date) as first_seen", "if(c_custkey % 3 = 0, null, 'kept') as kept",
    )
    entity = rows.withColumn("last_seen", F.when(F.col("id") % 3 != 0, F.col("last_seen"))).select("id", reports.entity_page("<s>", "<e>").alias("entity"))
    pages = rows.select("id", "file", reports.person_page("<dossier>\n").alias("page")).join(entity, "id")
    return pages.select("id", "file", F.contains("page", F.lit("<dossier>")).alias("dossier"), F.regexp_extract("page", "(?m)^# (.*)$", 1).alias("title"), F.regexp_extract("entity", "<s>\n(.*)\n<e>", 1).alias("region"), F.regexp_extract("entity", "(?m)^last_mention: (.*)$", 1).alias("seen"))


@query("""SELECT '- ' || event_type || ': ' || count(*) AS line FROM events GROUP BY event_type""")
def last_run_lines(spark, sf_dir):
    counts = view(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    report = reports.last_run("ingest", counts, "event_type")
    return report.select(F.explode(F.filter(F.split("report", "\n"), lambda x: F.startswith(x, F.lit("- ")))).alias("line"))


# --- calls, transcripts ----------------------------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS id, 'Intro@0:hi|Section@9:' AS outline, 'price' AS topics, 'risk (2)' AS trackers, CASE WHEN c_custkey % 2 = 0 THEN 'Acme' ELSE '' END AS accounts, 'won' AS outcome FROM customer")
def call_content_parts(spark, sf_dir):
    call = F.parse_json(F.to_json(F.expr("""named_struct('metaData', named_struct('id', c_custkey, 'started', '2024-01-01T10:00:00Z'),
        'content', named_struct('outline', array(named_struct('section', 'Intro', 'startTime', 0, 'items', array(named_struct('text', 'hi'), named_struct('text', ' '))), named_struct('section', ' ', 'startTime', 9, 'items', array(named_struct('text', '')))), 'topics', array(named_struct('name', 'price', 'duration', 5), named_struct('name', 'none', 'duration', 0)),
            'trackers', array(named_struct('name', 'risk', 'count', 2), named_struct('name', 'no', 'count', 0)), 'callOutcome', named_struct('name', 'won')),
        'context', array(named_struct('objects', array(named_struct('objectType', if(c_custkey % 2 = 0, 'Account', 'Deal'), 'fields', array(named_struct('name', 'Name', 'value', 'Acme'), named_struct('name', 'Id', 'value', '7')))))))""")))
    found = meetings.call_records(view(spark, sf_dir, "customer").select(call.alias("call")))
    outline = F.array_join(F.transform("outline", lambda s: F.concat(s["section"], F.lit("@"), s["start"].cast("string"), F.lit(":"), F.array_join(s["items"], ","))), "|")
    return found.select("id", outline.alias("outline"), *[F.array_join(c, ",").alias(c) for c in ("topics", "trackers", "accounts")], "outcome")


@query(r"SELECT conv_id::VARCHAR AS id, turn * 2 AS start, CASE role WHEN 'user' THEN 'Ada' ELSE 'Unknown speaker' END AS speaker, trim(regexp_replace(text || ' more', '\s+', ' ', 'g')) AS text FROM conversations")
def call_segments(spark, sf_dir):
    mono = F.expr("named_struct('speakerId', role, 'sentences', array(named_struct('start', turn * 2000 + 999, 'text', text), named_struct('start', 0, 'text', 'more')))")
    rows = view(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id").cast("string"))
    whole = rows.groupBy("id").agg(F.collect_list(mono).alias("transcript")).withColumn("callId", F.col("id"))
    answer = F.when(F.col("id").cast("long") % 2 == 0, F.to_json(F.struct(F.array(F.struct("callId", "transcript")).alias("callTranscripts")))).otherwise(F.to_json("transcript"))
    calls = whole.select("id", F.parse_json(answer).alias("monologues"), F.create_map(F.lit("user"), F.lit("Ada")).alias("names"))
    return meetings.call_segments(calls).select("id", "start", "speaker", "text")


@query("SELECT o_orderkey AS id, 'late' AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'given' WHEN o_orderkey % 3 = 1 THEN 'early' END AS transcript FROM orders UNION ALL SELECT -1 - o_orderkey, NULL, 'given' FROM orders WHERE o_orderkey % 3 = 0")
def call_merge(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    early = orders.selectExpr("o_orderkey as id", "0 as ordinal", "'early' as title", "if(o_orderkey % 3 = 1, 'early', null) as transcript")
    late = orders.selectExpr("o_orderkey as id", "1 as ordinal", "'late' as title", "cast(null as string) as transcript")
    given = orders.filter("o_orderkey % 3 = 0").selectExpr("explode(array(o_orderkey, -1 - o_orderkey)) as id", "'given' as transcript")
    joined, orphans = meetings.merge_calls(early.union(late), given)
    return joined.select("id", "title", "transcript").union(orphans.select("id", F.lit(None).cast("string"), "transcript"))


@query("SELECT c_custkey AS id, unnest([1, 2])::BIGINT AS pos, unnest(['Ada: a b', 'Bo: c']) AS line FROM customer")
def spoken_lines(spark, sf_dir):
    text = "WEBVTT\n\n00:01.000 --> 00:02.000\nAda: a\n\n00:02.000 --> 00:03.000\n<v Ada>b</v>\n\n00:03.000 --> 00:04.000\nBo: c\n"
    return meetings.spoken_lines(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(text).alias("text"))).withColumn("pos", F.col("pos").cast("long"))


# --- vault ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, 'Seg' || lower(replace(c_mktsegment, ' ', '')) AS entity FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) NOT LIKE 'build%'")
def org_mentions(spark, sf_dir):
    """A meeting's people by their companies; the companies of one segment are a client."""
    c = view(spark, sf_dir, "customer")
    crm = c.selectExpr("concat('P', c_custkey) as stem", "concat('seg', lower(replace(c_mktsegment, ' ', ''))) as company")
    meetings_ = view(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "array(concat('[[P', o_custkey, '|x]]'), '[[Nobody]]', 'none') as participants")
    known = crm.selectExpr("concat('Seg', substr(company, 4)) as entity", "'org' as type").distinct()
    return knowledge.org_mentions(meetings_, crm, _frame(spark, [("b", "segBuild", [])], "entity string, key string, aliases array<string>"), known)


@query("SELECT DISTINCT 't' || doc_id % 7 AS slug FROM documents WHERE doc_id % 4 < 2")
def discovered_threads(spark, sf_dir):
    return knowledge.discover_threads(view(spark, sf_dir, "v_notes"), ["20 - Projects", "30 - Areas"])


@query("SELECT rel, note_date + 3 AS due FROM v_notes WHERE rel LIKE '20 - Projects/%' AND doc_id % 3 <> 1 ORDER BY due, rel LIMIT 25")
def open_project_tasks(spark, sf_dir):
    return audit.open_tasks(audit.tasks(view(spark, sf_dir, "v_notes")), "20 - Projects").select("rel", "due")


@query("SELECT rel, 't' || doc_id % 7 AS tagged FROM v_notes WHERE note_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND doc_id % 7 = 3")
def week_and_tag_tables(spark, sf_dir):
    """Notes of a week that carry a thread's tag in their frontmatter."""
    notes = N.with_frontmatter(view(spark, sf_dir, "v_notes"))
    tagged = audit.Table(audit.in_week(notes, "2024-01-10")).where(F.array_contains(fm.values(F.col("fm"), "tags"), "thread/t3"))
    return tagged.table("rel", F.lit("t3").alias("tagged"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'inbox' END AS folder, CASE WHEN c_custkey % 3 = 0 THEN 'Ada' END AS owner FROM customer")
def board_context(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    routed = matching.route(c.selectExpr("c_custkey as id", "'k' as kind", "if(c_custkey % 2 = 0, 'x', 'y') as value"), _frame(spark, [(1, 0, "k", "x", "a")], "tier int, ordinal int, kind string, value string, folder string"), "inbox")
    return matching.with_board(routed, c.filter("c_custkey % 3 = 0").selectExpr("c_custkey as id", "'i' as item"), _frame(spark, [("i", "Ada", "won")], "item string, owner string, stage string")).select("id", "folder", "owner")


@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN DATE '2024-01-02' WHEN 1 THEN DATE '2024-01-03' ELSE DATE '2020-05-05' END AS emerge, CASE doc_id % 3 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-01-03' ELSE '2020-05-05' END AS evidence, CASE doc_id % 3 WHEN 0 THEN DATE '2024-01-04' ELSE DATE '2020-05-05' END AS lint FROM documents""")
def note_dates(spark, sf_dir):
    """Three orders of keys, one of which takes what is no date."""
    k = F.col("doc_id") % 3
    text = F.when(k == 0, "---\ndate: soon\ntimestamp: no\nstarted: 2024-01-02T10:00\nlast_evidence: 2024-01-04\n---\n").when(k == 1, "---\nstarted: 2024-01-03\n---\n").otherwise("---\nx: y\n---\n")
    f, mtime = fm.parse(text), F.lit("2020-05-05 10:00:00").cast("timestamp")
    rows = view(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("id"), N.note_date(f, mtime).alias("emerge"), N.evidence_date(f, mtime).alias("evidence"), N.note_date(f, mtime, N.LINT_KEYS).alias("lint"))


@query("""SELECT event_id AS id, TIMESTAMP '2001-01-01' + INTERVAL 1 SECOND * (event_id % 1000) AS core, CASE WHEN event_id % 2 = 0 THEN '2024-01-01 06:00:00' ELSE 'odd' END AS local, CASE WHEN event_id % 100 = 0 OR event_id % 100 > 24 THEN '' ELSE (event_id % 100) || 'h 00m' END AS span FROM events""")
def clocks(spark, sf_dir):
    k = F.col("event_id")
    return view(spark, sf_dir, "events").select(k.alias("id"), D.core_data(k % 1000).cast("timestamp_ntz").alias("core"), D.legacy_utc(F.when(k % 2 == 0, "2024-01-01T12:00:00Z").otherwise("odd"), "America/Chicago").alias("local"), D.meeting_duration(k % 100 * 3600).alias("span"))


@query("SELECT slug FROM (SELECT DISTINCT 'x' || doc_id % 9 AS slug FROM documents) ORDER BY slug LIMIT 5")
def capped_worklist(spark, sf_dir):
    slugs = view(spark, sf_dir, "documents").selectExpr("concat('x', doc_id % 9) as slug").distinct()
    return threads.rollout(slugs.withColumn("rank", F.col("slug")), 5).filter("wave = 'now'").select("slug")


@query("""SELECT c_custkey AS id, 'A b' AS month, DATE '2024-03-04' AS day, 'my-book-1' AS book, 'ab…' AS clip FROM customer""")
def small_texts(spark, sf_dir):
    return view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("A b").alias("month"), T.month_line(F.when(F.col("c_custkey") % 2 == 0, "Mar 4, 2024").otherwise("Mar 4, 2024 ")).alias("day"), T.book_slug(F.lit(" My Book: 1!")).alias("book"), T.clip(F.lit(" abcd "), 3).alias("clip"))


# --- files -------------------------------------------------------------------------------------------


def _folder(spark, files, name: str) -> str:
    """files (rel, text) as a folder of the shared one, each row a file of its own."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    uri = arrow_uri(spark, root)

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{top}/{rel}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{top}/{rel}") as f:
                    f.write(text.encode())
            yield batch

    files.select("rel", "text").mapInArrow(run, "rel string, text string").write.format("noop").mode("overwrite").save()
    return root


@query("SELECT rel, CASE WHEN rel LIKE 'raw/%' THEN source ELSE folder END AS source, note_date AS day, stem AS title FROM v_notes")
def vault_scan(spark, sf_dir):
    """All documents as files of a vault, among others that a scan leaves out."""
    vault = view(spark, sf_dir, "v_notes").select("rel", "text")
    odd = _frame(spark, [(r, "x") for r in ("raw/README.md", ".obsidian/a.md", "raw/.hidden.md", "raw/a.txt", "90 - Attachments/b.md", "AGENTS.md")], "rel string, text string")
    notes = N.scan(spark, _folder(spark, vault.unionByName(odd), "vault"), attachments="90 - Attachments", root_files=("AGENTS.md",))
    return notes.select("rel", N.source_of(F.col("rel")).alias("source"), N.note_date(F.col("fm"), F.col("mtime")).alias("day"), "title")


@query("SELECT 's' || conv_id AS session, count(*) FILTER (role IN ('user', 'assistant')) AS turns FROM conversations GROUP BY conv_id")
def session_files(spark, sf_dir):
    line = F.to_json(F.expr("named_struct('type', role, 'content', text)"))
    rows = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda p: p["x"]), "\n").alias("text"))
    root = _folder(spark, rows.select(F.concat(F.lit("p/s"), "conv_id", F.lit(".jsonl")).alias("rel"), "text"), "sessions")
    return payloads.session_lines(spark, root).groupBy("session").agg(F.count_if(F.col("role").isin("user", "assistant")).alias("turns"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '{bad' END AS error, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS name FROM customer")
def json_files(spark, sf_dir):
    files = view(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey"), F.lit(".json")).alias("rel"), F.when(F.col("c_custkey") % 2 == 0, "{bad").otherwise(F.to_json(F.struct(F.col("c_name").alias("title")))).alias("text"))
    got = payloads.json_files(spark, _folder(spark, files, "json"))
    return got.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("id"), F.when(F.col("error").isNotNull(), "{bad").alias("error"), payloads.first_of(F.col("value"), ["$.name", "$.title"]).alias("name"))


@query("SELECT conv_id AS id, turn, CASE WHEN conv_id % 2 = 0 THEN 'refined' ELSE 'live' END AS source, CASE WHEN role = 'user' THEN 'Ada' ELSE 'Speaker 2 (remote)' END AS speaker FROM conversations")
def ndjson_transcripts(spark, sf_dir):
    """Both files of even conversations say something; the refined one of odd ones has a header alone."""
    line = F.to_json(F.expr("named_struct('text', concat('t', turn), 'speaker', named_struct('id', if(role = 'user', 1, 1001), 'name', '', 'source', 'mic'))"))
    rows = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    head = F.lit('{"meta": {}}\nno json\n{"text": " "}\n')
    files = rows.select(F.col("conv_id").alias("id"), F.lit("live").alias("source"), F.concat(head, "text").alias("text")).union(rows.select("conv_id", F.lit("refined"), F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(head)))
    names = transcripts.speaker_map(F.lit('{"people": {"u": {"name": " Ada "}}, "assignments": {"1": {"consensus": "", "mic": "u"}, "1001": {}}}'))
    found = transcripts.ndjson(files)
    return found.select("id", F.substring("text", 2, 9).cast("long").alias("turn"), "source", F.coalesce(F.try_element_at(names, "speaker_id"), transcripts.speaker_label(F.col("speaker_id"), F.col("name"), F.col("side"))).alias("speaker"))


@query("SELECT c_custkey AS id, unnest([0, 1]) AS pos, unnest(['Ada', 'Unknown speaker']) AS speaker, unnest(['hi', 'x y']) AS text, unnest([CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END])::BIGINT AS start FROM customer")
def transcript_dispatch(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, "WEBVTT\nAda: hi\n\nx y").otherwise("WEBVTT\n\n00:01.000 --> 00:02.000\nAda: hi\n\n00:02.000 --> 00:03.000\nx y\n")
    return transcripts.any_text(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))).select("id", "pos", "speaker", "text", "start")


_XML = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def _docx(paragraphs: list[str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", _XML.format("".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)))
    return out.getvalue()


@query("SELECT conv_id AS id, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE 'Sync ' || conv_id END AS title, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE count(*) END AS turns, conv_id % 4 = 3 AS failed FROM conversations GROUP BY conv_id")
def docx_transcripts(spark, sf_dir):
    """A DOCX file for each conversation; every fourth one is no archive, and stops nothing."""
    rows = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    root = f"{shared_dir(spark)}/docx-{uuid.uuid4().hex}"
    uri = arrow_uri(spark, root)

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = [f"Sync {k}", "May 1, 2024", "25m", "Ada started transcription"] + [x for i in range(n) for x in (f"Ada Vale  0:{i % 60:02d}", f"said {i}")]
                with store.open_output_stream(f"{top}/{k}.docx") as f:
                    f.write(b"no archive" if k % 4 == 3 else _docx(lines))
            yield batch

    rows.mapInArrow(run, "conv_id long, n long").write.format("noop").mode("overwrite").save()
    found = readers.docx(spark, root)
    return found.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("id"), "title", F.size("turns").cast("long").alias("turns"), F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id AS id, 'v' || doc_id AS fenced, CASE WHEN doc_id % 2 = 0 THEN 'v' || doc_id END AS loose, 'x: y' AS flat, 'last' AS probed FROM documents")
def frontmatter_dialects(spark, sf_dir):
    k = F.col("doc_id")
    text = F.concat(F.lit("---\nkey: v"), k, F.lit("\nurl: x: y\n---\nurl: last\n"))
    bare = F.concat(F.when(k % 2 == 0, "---\n").otherwise("+++\n"), F.lit("key: v"), k, F.lit("\n---"))
    return view(spark, sf_dir, "documents").select(
        k.alias("id"), fm.scalar(fm.parse(text), "key").alias("fenced"), fm.scalar(fm.parse(bare, "loose"), "key").alias("loose"),
        fm.scalar(fm.parse(text, "flat"), "url").alias("flat"), F.try_element_at(fm.probe(text, ["url"]), F.lit("url")).alias("probed"),
    )


@query("SELECT item_id AS id, text AS question FROM benchmark UNION ALL SELECT -1, 'what next'")
def query_log(spark, sf_dir):
    log = view(spark, sf_dir, "benchmark").selectExpr("item_id as id", "text as question")
    return pages.append_log(log, id=F.lit(-1), question=F.lit("what next"))


@query(f"""WITH {catalogue._TAGS}, a AS (SELECT slug, count(DISTINCT rel) FILTER (note_date >= DATE '2024-01-14' - 7) AS files, max(note_date) AS latest FROM g GROUP BY slug), w AS (SELECT * FROM v_notes WHERE note_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14')
    SELECT 'notes' AS what, count(*) AS n FROM w UNION ALL SELECT 'meetings', count(*) FILTER (doc_id % 5 = 0) FROM w UNION ALL SELECT 'tasks completed', count(*) FROM v_notes WHERE doc_id % 3 = 1 AND note_date + 3 BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
    UNION ALL SELECT 'threads active', count(*) FILTER (files >= 2) FROM a UNION ALL SELECT 'threads stalled', count(*) FILTER (files < 2 AND latest <= DATE '2024-01-14' - 14) FROM a""")
def week_by_the_numbers(spark, sf_dir):
    notes = view(spark, sf_dir, "v_notes")
    tags = notes.select("rel", F.col("note_date").alias("day"), F.explode(F.array_distinct(T.extract(F.col("text"), T.THREAD_TAG))).alias("slug"))
    return audit.week_numbers(notes, audit.tasks(notes), threads.activity(tags, "2024-01-14"), "2024-01-14", F.col("doc_id") % 5 == 0)


@query("""WITH n AS (SELECT event_type, min(ts)::DATE AS first, max(ts) AS newest FROM events GROUP BY 1), t AS (SELECT max(ts)::DATE + 3 AS today FROM events)
    SELECT event_type, strftime(least(today - 7, newest::DATE - 1), '%Y-%m-%d') AS healed, strftime(today - 7, '%Y-%m-%d') AS plain, strftime(date_trunc('second', newest) + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S+00:00') AS next, event_type AS kept,
    ((newest::DATE - first + 30) // 30)::BIGINT AS windows FROM n, t""")
def cursor_rules(spark, sf_dir):
    """What a run leaves as its cursor for each type of event, where the next one begins, and in how many requests."""
    events = view(spark, sf_dir, "events")
    types = events.groupBy("event_type").agg(F.to_date(F.min("ts")).alias("first"), F.max("ts").alias("newest"))
    rule = lambda f, kind: F.udf(f, kind)
    day = lambda c: c.cast("date").cast("string")
    rows = types.crossJoin(F.broadcast(events.agg(F.date_add(F.to_date(F.max("ts")), 3).alias("today"))))  # one row
    stamp = F.date_format("newest", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        "event_type", rule(lambda t, n: merge.heal_window(t, 7, n), "string")(day(F.col("today")), day(F.col("newest"))).alias("healed"), rule(lambda t: merge.heal_window(t, 7, None), "string")(day(F.col("today"))).alias("plain"),
        rule(lambda n: merge.next_cursor(n, "x"), "string")(stamp).alias("next"), rule(lambda o: merge.next_cursor(None, o), "string")("event_type").alias("kept"),
        rule(lambda a, b: len(payloads.windows(a, b)), "long")(day(F.col("first")), day(F.col("newest"))).alias("windows"),
    )
