"""Queries of the vault operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, knowledge, pages, people, search
from ..sources import frontmatter as fm
from ..sources import notes as N
from ..sources.views import view
from . import catalogue
from .catalogue import query


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- evidence ----------------------------------------------------------------------------

_VOCABULARY = ["the-best:", '  include: ["mit license", "onth"]', "  exclude: [all rights]  # not those", "license:", "  include: []", "zz-none:"]
_RAW = r"""n AS (SELECT doc_id, rel, source, note_date, 'Doc ' || doc_id || chr(10) || substr(coalesce(text, ''), 1, 2500) AS w FROM (SELECT doc_id, 'raw/' || source || '/Doc ' || doc_id || '.md' AS rel, source, DATE '2024-01-01' + (doc_id % 30)::INT AS note_date, text FROM documents)),
    t AS (SELECT 'the-best' AS thread, '(?i)(^|[^\p{L}\p{N}_])(the-best|the best|mit license|onth)($|[^\p{L}\p{N}_])' AS yes, '(?i)(^|[^\p{L}\p{N}_])all rights($|[^\p{L}\p{N}_])' AS no UNION ALL SELECT 'license', '(?i)(^|[^\p{L}\p{N}_])license($|[^\p{L}\p{N}_])', NULL UNION ALL SELECT 'zz-none', '(?i)(^|[^\p{L}\p{N}_])(zz-none|zz none)($|[^\p{L}\p{N}_])', NULL),
    h AS (SELECT thread, rel AS path, source, note_date FROM n, t WHERE regexp_matches(w, yes) AND (no IS NULL OR NOT regexp_matches(w, no))),
    c AS (SELECT *, row_number() OVER (PARTITION BY thread, source ORDER BY note_date DESC, path) AS k FROM h), g AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY note_date DESC, path) AS rank FROM c WHERE k <= 5)"""


def _raw_notes(spark, sf_dir):
    return view(spark, sf_dir, "documents").selectExpr("concat('raw/', source, '/Doc ', doc_id, '.md') as path", "source", "concat('Doc ', doc_id) as title", "text as body", "date_add(date'2024-01-01', cast(doc_id % 30 as int)) as date", "doc_id as mtime")


def _terms(spark):
    words = knowledge.vocabulary(_VOCABULARY)
    return _frame(spark, [(k, v["include"], v["exclude"]) for k, v in words.items()], "thread string, include array<string>, exclude array<string>")


@query(f"WITH {_RAW} SELECT thread, path, rank FROM g WHERE rank <= 20")
def raw_evidence(spark, sf_dir):
    return knowledge.gather_raw(_raw_notes(spark, sf_dir), _terms(spark)).select("thread", "path", F.col("rank").cast("long").alias("rank"))


def _para(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").filter("doc_id % 40 = 0")
    notes = docs.selectExpr("concat('20 - Projects/P ', doc_id, '.md') as path", "if(doc_id % 80 = 0, array('thread/license', 'x'), array('y')) as tags", "if(doc_id % 80 = 40, 'see #thread/the-best.', 'none') as text", "'t' as title", "repeat('w ', 900) as body", "date_add(date'2024-02-01', cast(doc_id % 7 as int)) as date", "doc_id as mtime")
    return knowledge.gather_para(notes, _terms(spark))


@query("SELECT CASE WHEN doc_id % 80 = 0 THEN 'license' ELSE 'the-best' END AS thread, '20 - Projects/P ' || doc_id || '.md' AS path, 1001::BIGINT AS n FROM documents WHERE doc_id % 40 = 0")
def para_evidence(spark, sf_dir):
    """Every fortieth document stands for a note of the vault that carries a thread's tag."""
    return _para(spark, sf_dir).select("thread", "path", F.length("excerpt").cast("long").alias("n"))


@query(f"""WITH {_RAW}, e AS (SELECT thread, path, 'raw' AS kind, g.note_date AS d, doc_id AS m FROM g JOIN n ON rel = path WHERE rank <= 20 UNION ALL SELECT CASE WHEN doc_id % 80 = 0 THEN 'license' ELSE 'the-best' END, '20 - Projects/P ' || doc_id || '.md', 'para', DATE '2024-02-01' + (doc_id % 7)::INT, doc_id FROM documents WHERE doc_id % 40 = 0),
    x AS (SELECT thread, count(*) AS n, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last, coalesce(max(kind) FILTER (kind = 'para'), '') AS sources, substr(sha1(string_agg(path || ':' || m, chr(10) ORDER BY path || ':' || m)), 1, 16) AS fingerprint FROM e GROUP BY thread)
    SELECT t.thread, coalesce(n, 0) AS n, first, last, coalesce(sources, '') AS sources, coalesce(fingerprint, 'da39a3ee5e6b4b0d') AS fingerprint, CASE WHEN t.thread = 'license' THEN 'changed' ELSE 'new' END AS status FROM (SELECT unnest(['the-best', 'license', 'zz-none']) AS thread) t LEFT JOIN x USING (thread)""")
def evidence_bundles(spark, sf_dir):
    stored = _frame(spark, [("license", "0")], "thread string, fingerprint string")
    found = knowledge.evidence_bundle(_para(spark, sf_dir), knowledge.gather_raw(_raw_notes(spark, sf_dir), _terms(spark)), stored, _terms(spark))
    return found.select("thread", "n", "first", "last", F.array_join("sources", ",").alias("sources"), "fingerprint", "status")


@query(r"SELECT 'Doc ' || doc_id AS stem, source FROM documents WHERE regexp_matches('Doc ' || doc_id || chr(10) || substr(coalesce(text, ''), 1, 2000), '(?i)(^|[^\p{L}\p{N}_])license($|[^\p{L}\p{N}_])') ORDER BY source, 'raw/' || source || '/Doc ' || doc_id || '.md' LIMIT 10")
def related_sources(spark, sf_dir):
    notes = _raw_notes(spark, sf_dir).withColumn("stem", F.col("title"))
    return knowledge.related_sources(notes, r"(?iU)\blicense\b").select("stem", "source")


# --- people, entities ----------------------------------------------------------------------


def _attendees(spark, sf_dir):
    return view(spark, sf_dir, "v_meetings").selectExpr("concat(local_part, '@', domain) as email", "meeting_date as date")


@query(f"""WITH {catalogue._PEOPLE}, f AS (SELECT *, replace(name, ' ', '-') || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN '-' || upper(company[1]) || company[2:] ELSE '' END AS file, CASE WHEN mention_count >= 8 THEN 1 WHEN mention_count >= 3 THEN 2 ELSE 3 END AS tier FROM n),
    o AS (SELECT *, file LIKE 'Customer1%' AS there, CASE WHEN file LIKE '%7' OR length(file) % 2 = 0 THEN 2 ELSE 3 END AS old FROM f)
    SELECT email, file, CASE WHEN there THEN 'update' ELSE 'create' END AS action, CASE WHEN there THEN least(old, tier) ELSE tier END AS new_tier, there AND old <> least(old, tier) AS transition, CASE WHEN there THEN least(old, tier) = 1 ELSE tier = 1 END AS dossier, CASE WHEN there THEN 'company' ELSE '' END AS fills FROM o""")
def people_plan(spark, sf_dir):
    found = people.extract(_attendees(spark, sf_dir))
    old = people.resolve_collisions(found).filter("file like 'Customer1%'").selectExpr("file", "if(file like '%7' or length(file) % 2 = 0, '2', 'contact') as tier", "'x@y' as email", "'' as company", "'d' as domain")
    return knowledge.people_plan(found, old).select("email", "file", "action", "new_tier", "transition", "dossier", F.array_join("fills", ",").alias("fills"))


@query("""SELECT c_custkey AS id, '---' || chr(10) || 'tier: 1' || chr(10) || 'tags: [person]' || chr(10) || 'last_seen: 2024-01-01' || chr(10) || '---' || chr(10) || '# A' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '<d>' || chr(10) || '## Bio' || chr(10) ELSE chr(10) || chr(10) || '<d>' END AS text FROM customer""")
def people_page_refresh(spark, sf_dir):
    head = F.lit("---\ntier: 3\ntags: [person]\n---\n")
    body = knowledge.insert_dossier(F.when(F.col("c_custkey") % 2 == 0, "# A\n## Bio\n").otherwise("# A \n"), "<d>", "<d>")
    return view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), knowledge.refresh_person(F.concat(head, body), {"tier": F.lit("1"), "last_seen": F.lit("2024-01-01")}).alias("text"))


@query("""SELECT 'Client ' || n_nationkey AS name, 'client' AS type, 'Client-' || n_nationkey AS canonical_id FROM nation UNION ALL SELECT 'Area ' || r_regionkey, 'area', 'Area-' || r_regionkey FROM region
    UNION ALL SELECT DISTINCT 'Seg' || lower(replace(c_mktsegment, ' ', '')), 'org', 'Seg' || lower(replace(c_mktsegment, ' ', '')) FROM customer UNION ALL SELECT 'Widget', 'product', 'widget'""")
def entity_discovery(spark, sf_dir):
    notes = view(spark, sf_dir, "nation").selectExpr("concat('20 - Projects/Clients/Client-', n_nationkey, '/meetings/x.md') as rel").union(view(spark, sf_dir, "region").selectExpr("concat('30 - Areas/Area-', r_regionkey, '/y.md')")).union(_frame(spark, [("30 - Areas/.hidden/z.md",), ("30 - Areas/loose.md",)], "rel string"))
    crm = view(spark, sf_dir, "customer").selectExpr("concat('seg', lower(replace(c_mktsegment, ' ', ''))) as company", "concat(c_custkey, '@x') as email").union(_frame(spark, [("Client 7, Inc.", "a@x"), ("other", ""), ("aka", "b@x")], "company string, email string"))
    seeds, aliases = _frame(spark, [("product", "Widget", "widget", "d")], "type string, name string, canonical_id string, description string"), _frame(spark, [("AKA", "Client-3")], "alias string, client string")
    return knowledge.discover_entities(notes, crm, seeds, aliases).select("name", "type", "canonical_id")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'update' ELSE 'create' END AS action, CASE WHEN p_partkey % 4 = 0 THEN 'mine ' || p_partkey END AS kept FROM part")
def entity_apply(spark, sf_dir):
    part = view(spark, sf_dir, "part").selectExpr("p_partkey as id")
    old = part.filter("id % 2 = 0").select("id", F.concat(F.lit("x\n<s>\n"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("mine "), "id")).otherwise(" "), F.lit("\n<e>\ny")).alias("text"))
    return knowledge.entity_apply(part, old, "<s>", "<e>")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'client' WHEN doc_id % 4 = 1 THEN 'org' WHEN doc_id % 4 = 2 THEN 'product' END AS listed FROM documents WHERE doc_id % 4 < 3""")
def entity_page_tables(spark, sf_dir):
    d = F.col("doc_id") % 4
    notes = view(spark, sf_dir, "documents").select("doc_id", F.when(d == 0, "20 - Projects/Clients/acme/a.md").otherwise("20 - Projects/Clients/acmeco/a.md").alias("rel"), F.when(d == 1, F.array(F.lit("Big Org"))).otherwise(F.array(F.lit("Big Organ"))).alias("links"), F.when(d == 2, "the Widget x").otherwise("widget").alias("text"))
    kind = F.when(knowledge.entity_table("client", "", "acme"), "client").when(knowledge.entity_table("org", "", "Big Org"), "org").when(knowledge.entity_table("product", "Widget", "widget"), "product")
    return audit.Table(notes.withColumn("fm", F.create_map().cast("map<string, array<string>>"))).where(kind.isNotNull()).table("doc_id", kind.alias("listed")).select(F.col("doc_id").alias("id"), "listed")


@query("SELECT doc_id AS id, 'C' || doc_id % 5 AS entity FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, 'C' || doc_id % 4 FROM documents WHERE doc_id % 2 = 0")
def project_mentions(spark, sf_dir):
    notes = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "if(doc_id % 3 = 0, concat('20 - Projects/Clients/C', doc_id % 5, '/x.md'), 'raw/x.md') as rel", "if(doc_id % 2 = 0, concat('[[C', doc_id % 4, ' portal]]'), null) as project")
    return knowledge.project_mentions(notes, _frame(spark, [(f"C{i}",) for i in range(5)], "entity string"))


# --- guards --------------------------------------------------------------------------------


@query("SELECT 'e' || doc_id AS name FROM documents WHERE doc_id % 3 = 0 UNION SELECT 'id' || doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT 'Area ' || doc_id % 7 FROM documents WHERE doc_id % 3 = 1 UNION SELECT 'P' || doc_id || '-X' FROM documents WHERE doc_id % 3 = 2")
def guard_lookups(spark, sf_dir):
    d = F.col("doc_id") % 3
    rel = F.when(d == 0, F.concat(F.lit("wiki/entities/e"), "doc_id", F.lit(".md"))).when(d == 1, F.concat(F.lit("30 - Areas/Area "), F.col("doc_id") % 7, F.lit("/n.md"))).otherwise(F.concat(F.lit("50 - CRM/People/P"), "doc_id", F.lit("-X.md")))
    notes = view(spark, sf_dir, "documents").select(rel.alias("rel"), F.regexp_extract(rel, r"([^/]*)\.md$", 1).alias("stem"), F.concat(F.lit("---\ncanonical_id: id"), "doc_id", F.lit("\n---\n")).alias("text"))
    notes = N.with_frontmatter(notes)
    return knowledge.known_entities(notes).union(knowledge.person_names(notes)).distinct()


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '2024-01-0' || (doc_id % 9 + 1) WHEN 1 THEN '2024-02-01' ELSE '2024-03-03' END AS day FROM documents")
def observation_dates(spark, sf_dir):
    d = F.col("doc_id") % 3
    report = F.when(d == 0, F.concat(F.lit("---\ngenerated_at: 2024-01-0"), F.col("doc_id") % 9 + 1, F.lit("T10:00\nwindow_end: 2024-02-01\n---\n"))).when(d == 1, "---\nwindow_end: 2024-02-01\n---\n").otherwise("# no frontmatter")
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), knowledge.observation_date(report, "2024-03-03").alias("day"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def quiet_tasks(spark, sf_dir):
    tasks = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "if(doc_id % 4 = 0, '30 - Areas/Quiet/x.md', '30 - Areas/Quieter/x.md') as rel", "concat('- [ ] t', if(doc_id % 3 = 0, ' #journal/day', ' #journals'), if(doc_id % 5 = 0, ' #later', '')) as text")
    return knowledge.no_nudge(tasks, ("30 - Areas/Quiet",), ("#journal", "later")).select("id")


@query("SELECT doc_id AS id, 'own-' || doc_id AS slug FROM documents WHERE doc_id % 5 >= 3")
def organic_threads(spark, sf_dir):
    k = F.col("doc_id") % 5
    rel = F.when(k == 0, "20 - Projects/AGENTS.md").when(k == 1, "60 - Meta/x.md").otherwise("20 - Projects/n.md")
    text = F.concat(F.when(k == 2, "---\ngenerated_by: weekly\n---\n").otherwise("---\ntype: x\n---\n"), F.lit("## Our morning report\n#thread/old\n## Notes\n#thread/own-"), "doc_id", F.lit("\n### Active threads\n- #thread/older\n## End"))
    notes = knowledge.organic(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), rel.alias("rel"), text.alias("text")))
    return notes.select("id", F.explode(T.extract(F.col("text"), T.THREAD_TAG)).alias("slug"))


@query("SELECT 'm' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def known_meetings(spark, sf_dir):
    o = view(spark, sf_dir, "orders")
    notes = o.filter("o_orderkey % 3 = 0").selectExpr("concat(if(o_orderkey % 2 = 0, '', repeat('x', 4096)), '---\nmeeting_id: \"m', o_orderkey, '\"\n---') as text")
    return knowledge.duplicates_by_id(o.selectExpr("concat('m', o_orderkey) as id"), notes)


# --- notes -----------------------------------------------------------------------------------


@query("""SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'no frontmatter' WHEN 1 THEN 'not retained' WHEN 2 THEN 'no link' WHEN 3 THEN 'no note' WHEN 4 THEN 'no content' ELSE 'converted' END AS status, CASE WHEN doc_id % 6 = 5 THEN 'over ' || doc_id END AS overview, CASE WHEN doc_id % 6 = 5 THEN 'k1,k2' END AS keywords FROM documents""")
def linked_summaries(spark, sf_dir):
    k = F.col("doc_id") % 6
    link = F.when(k == 2, "").otherwise(F.concat(F.lit('meeting_note: "[[Note '), "doc_id", F.lit(']]"\n')))
    text = F.when(k == 0, "none").otherwise(F.concat(F.lit("---\ntranscript_status: "), F.when(k == 1, "summary").otherwise("retained"), F.lit("\n"), link, F.lit("---\n")))
    docs = view(spark, sf_dir, "documents")
    notes = docs.filter("doc_id % 6 >= 4").select(F.concat(F.lit("Note "), "doc_id").alias("stem"), F.concat(F.lit("x/"), "doc_id").alias("rel"), F.when(k == 5, F.concat(F.lit("---\nkeywords: [k1, k2]\n---\n## Summary\nover "), "doc_id", F.lit("\n"))).otherwise("---\na: b\n---\n## Summary\n\n").alias("text"))
    found = knowledge.linked_summaries(docs.select(F.col("doc_id").alias("id"), text.alias("text")), notes)
    done = F.col("status") == "converted"
    return found.select("id", "status", F.when(done, F.col("overview")).alias("overview"), F.when(done, F.array_join("keywords", ",")).alias("keywords"))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'done' ELSE 'migrate' END AS status, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'a1@x,b@x,zz@x' ELSE '' END AS emails, CASE WHEN doc_id % 4 = 1 THEN '[[P-b]],[[P-a]]' ELSE '' END AS participants, CASE WHEN doc_id % 4 = 1 THEN 'zz@x' ELSE '' END AS unmatched FROM documents""")
def attendee_migration(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "---\ndate: x\nparticipants: []\n---\n").when(k == 1, "---\ndate: x\nattendees:\n- A1@x\n- B@x\n- nobody\n- zz@x\n---\n").when(k == 2, "---\nattendees: [nobody]\n---\n").otherwise("---\ndate: x\n---\n")
    meetings = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fm.parse(text).alias("fm"))
    found = knowledge.migration(meetings, _frame(spark, [("a1@x", "P-b"), ("B@X", "P-a")], "email string, slug string"))
    return found.select("id", "status", F.array_join("attendee_emails", ",").alias("emails"), F.array_join("participants", ",").alias("participants"), F.array_join("unmatched", ",").alias("unmatched"))


@query("""SELECT doc_id AS id, '---' || chr(10) || CASE WHEN doc_id % 3 < 2 THEN 'date: d' || chr(10) || 'attendee_emails:' || chr(10) || '- a@x' || chr(10) || 'participants:' || chr(10) || '- ''[[A]]''' || chr(10) || 'k: v' ELSE 'k: v' || chr(10) || 'attendee_emails:' || chr(10) || '- a@x' || chr(10) || 'participants:' || chr(10) || '- ''[[A]]''' END || chr(10) || '---' || chr(10) || 'body' AS text FROM documents""")
def migrated_pages(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, "---\ndate: d\nattendees:\n- a@x\n- b\nk: v\n---\nbody").when(k == 1, "---\ndate: d\nattendees: [a@x]\nk: v\n---\nbody").otherwise("---\nk: v\nattendees:\n  - a@x\n---\nbody")
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), knowledge.migrated(text, F.array(F.lit("a@x")), F.array(F.lit("[[A]]"))).alias("text"))


@query("""SELECT doc_id AS id, '---' || chr(10) || 'type: x' || chr(10) || 'tags: ' || CASE doc_id % 3 WHEN 0 THEN '[a, thread/t]' WHEN 1 THEN '[thread/t]' ELSE '[a, thread/t]' END || chr(10) || '---' || chr(10) || 'b' AS text FROM documents""")
def tagged_pages(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.concat(F.lit("---\ntype: x\ntags: "), F.when(k == 0, "[a]").when(k == 1, "[]").otherwise("a"), F.lit("\n---\nb"))
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fm.add_tag(text, "thread/t").alias("text"))


@query("""SELECT doc_id AS id, '---' || chr(10) || 'title: T' || doc_id || chr(10) || '---' || chr(10) || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'mine' ELSE 'none yet' END AS text, '# B' || chr(10) || chr(10) || '*A*' || chr(10) || chr(10) || '## Key ideas' || chr(10) || chr(10) || '- i' || chr(10) AS book FROM documents""")
def kept_regions(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    new = docs.select(F.col("doc_id").alias("id"), pages.frontmatter(title=F.concat(F.lit("T"), "doc_id"), none=F.lit(None).cast("string")).alias("head"), F.lit(None).cast("string").alias("tail"))
    old = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("x\n<s>\nmine\n<e>\n").alias("text"))
    kept = pages.keep_region(new, old, "id", "<s>", "<e>", "none yet")
    none = F.array().cast("array<string>")
    book = pages.book_note(F.lit("B"), F.lit("A"), F.lit(""), F.array(F.lit("i")), none)
    return kept.select("id", F.regexp_replace(F.regexp_replace("text", "\n<e>$", ""), "<s>\n", "").alias("text"), book.alias("book"))


@query("""SELECT doc_id AS id, 'a' || chr(10) || '## Plan' || chr(10) || chr(10) || 'new $1' || chr(10) || chr(10) || '## End' || chr(10) AS text, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE NULL END AS probed FROM documents""")
def replaced_sections(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 0, "a\n## Plan\nold\n\n## End\n").otherwise("a\n## Plan\n## End\n")
    head = F.when(F.col("doc_id") % 2 == 0, 'meeting_id: y\nmeeting_id: "x"\n').otherwise("none\n")
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.replace_section(body, "Plan", F.lit("new $1")).alias("text"), F.try_element_at(fm.probe(head, ["meeting_id"]), F.lit("meeting_id")).alias("probed"))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing required field: body' WHEN 2 THEN 'topic must be kebab-case;tags must be a list' ELSE 'a capture must be a JSON object' END AS errors, 'distill-' || substr(sha1('top/t' || doc_id), 1, 10) AS capture FROM documents""")
def capture_specs(spark, sf_dir):
    k = F.col("doc_id") % 4
    spec = F.when(k == 0, '{"topic": "top", "title": "a-b", "body": "x", "exchange": "y", "tags": ["a"]}').when(k == 1, '{"topic": "top", "title": "a", "body": " ", "exchange": "y"}').when(k == 2, '{"topic": "Top x", "title": "a", "body": "b", "exchange": "y", "tags": "a"}').otherwise("[1")
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(knowledge.capture_errors(spec), ";").alias("errors"), knowledge.capture_id(F.lit("top"), F.concat(F.lit("t"), "doc_id")).alias("capture"))


# --- search and lint --------------------------------------------------------------------------


@query(f"WITH {catalogue._RANKED} SELECT layer, count(*) AS n FROM h WHERE hits > 0 GROUP BY layer UNION ALL SELECT 'hub', 1")
def research_matched(spark, sf_dir):
    """The uncapped number of matches of each layer, and the pages that a term names."""
    notes = N.with_frontmatter(view(spark, sf_dir, "v_notes").select("rel", "stem", "source", "text"))
    hub = N.with_frontmatter(_frame(spark, [("wiki/concepts/license.md", "license", "wiki", "---\nevidence_count: 4\n---\n"), ("wiki/synthesis/other.md", "other", "wiki", "x")], "rel string, stem string, source string, text string"))
    found = knowledge.research(notes.unionByName(hub), terms=catalogue._TERMS)
    return found["matched"].union(found["hubs"].filter("evidence = '4'").groupBy().agg(F.lit("hub").alias("layer"), F.count(F.lit(1)).alias("n")))


@query(r"""SELECT doc_id AS id, len([x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '(?i)license|the|onth')]) AS lines FROM documents""")
def matching_lines(spark, sf_dir):
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), search.hits(F.coalesce("text", F.lit("")), catalogue._TERMS, "lines").alias("lines"))


@query(f"""WITH {catalogue._TAGS}, k AS (SELECT regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS key, * FROM g), w AS (SELECT key, count(DISTINCT rel) FILTER (rel NOT LIKE '40 - %') AS n FROM k WHERE key <> 't3' GROUP BY key),
    s AS (SELECT key, count(DISTINCT slug) AS n FROM (SELECT key, slug FROM k UNION SELECT 't3', 'T_3' UNION SELECT 'aaabbb', 'aaa-bbb' UNION SELECT 'aaabbb', 'aaa-Bbb') GROUP BY key)
    SELECT 'work' AS "check", count(*) AS n FROM w WHERE n >= 3 UNION ALL SELECT 'thin', count(*) FROM w WHERE n < 3 UNION ALL SELECT 'duplicates', count(*) FROM s WHERE n > 1 UNION ALL SELECT 'overlaps', 0 UNION ALL SELECT 'hollow', 2""")
def lint_counts(spark, sf_dir):
    synthesis, concepts = _frame(spark, [("T_3", "1")], "slug string, evidence_count string"), _frame(spark, [("aaa-bbb", None)], "slug string, evidence_count string")
    return knowledge.lint(view(spark, sf_dir, "v_notes"), synthesis, concepts, _frame(spark, [("aaa-Bbb",)], "slug string"), ("40 - ",))["counts"]


_UNITS = "w_items AS (SELECT item_id // 2 AS item_id, first_value(source) OVER (PARTITION BY item_id // 2 ORDER BY length(source), source, item_id) AS source, item_date, title, body FROM v_items)"


@query(f"WITH {_UNITS}, {catalogue._MENTIONS.replace('v_items', 'w_items')} SELECT slug, count(DISTINCT item_id) AS items, count(DISTINCT source) AS sources FROM m GROUP BY slug")
def emerge_grouped(spark, sf_dir):
    """Documents 2n and 2n + 1 stand for two records of one event."""
    items = view(spark, sf_dir, "v_items").selectExpr("item_id as rec", "source", "item_date as date", "title", "body", "array(concat('e:', item_id div 2)) as tokens")
    order = [f"src{i}" for i in range(30)]
    return knowledge.emerge_grouped(items, order, top=None, min_items=1, min_sources=1, body_chars=None).select("slug", "items", "sources")


@query("SELECT entity, n FROM (SELECT 'b' || p_brand AS entity, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, entity LIMIT 50")
def top_entities(spark, sf_dir):
    found = people.entity_mentions(view(spark, sf_dir, "part").selectExpr("p_partkey as meeting", "concat('b', p_brand) as entity", "cast(null as date) as date"), view(spark, sf_dir, "part").selectExpr("concat('b', p_brand) as entity").distinct())
    return found.orderBy(F.desc("mention_count"), "entity").limit(50).select("entity", F.col("mention_count").alias("n"))


@query("""SELECT lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) AS canonical, count(*) AS people FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""")
def org_discovery(spark, sf_dir):
    crm = view(spark, sf_dir, "customer").selectExpr("concat(c_custkey, '@x') as email", "if(c_custkey % 2 = 0, c_mktsegment, concat(lower(c_mktsegment), '.')) as company")
    return people.discover_orgs(crm, _frame(spark, [("b", "Build-Ing, Inc.", [])], "entity string, key string, aliases array<string>")).select("canonical", "people")
