"""All queries of the library and the SQL each one is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..operators import audit, emergence, index, matching, merge, pages, people, records, search, segments, threads
from ..sources import frontmatter as fm
from ..sources import html, payloads, transcripts
from ..sources import notes as N
from ..session import arrow_uri, shared_dir
from ..sources.views import duck, view
from ..streaming import ingest, polling

TODAY = "2024-01-31"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """The modules that register queries of their own."""
    from . import capture, knowledge, reporting  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return {k: duck(v) for k, v in _SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern emergence over all documents; at the least thresholds, so that a small corpus
    has patterns too."""
    return _emerged(spark, sf_dir, min_items=1, min_sources=1)


# --- emergence -------------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_items").selectExpr("item_id as unit", "source as unit_source", "item_date as date", "title", "body")


def _emerged(spark: SparkSession, sf_dir: str, **law) -> DataFrame:
    return emergence.emerge(_items(spark, sf_dir), body_chars=None, **law).drop("source_list")


def _kebab(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"


def _marked(x: str) -> str:
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)', '‹\1›', 'g')"


_BARE = "replace(replace(x, '‹', ''), '›', '')"
_NOISE = ", ".join(f"'{x}'" for x in T.NOISE)
_MENTIONS = rf"""
    t AS (SELECT item_id, source, item_date, title || chr(10) || coalesce(body, '') AS t FROM v_items),
    c AS (
        SELECT item_id, source, item_date, {_kebab(_BARE)} AS slug FROM (SELECT *, unnest(regexp_extract_all({_marked("t")}, '‹[A-Z][a-zA-Z0-9]+›(?:[ -]‹[A-Z][a-zA-Z0-9]+›){{1,3}}')) AS x FROM t)
        UNION ALL SELECT item_id, source, item_date, {_BARE} FROM (SELECT *, unnest(regexp_extract_all({_marked("lower(t)")}, '‹[a-z][a-z0-9]+›(?:-‹[a-z0-9]+›){{1,4}}')) AS x FROM t)
        UNION ALL SELECT item_id, source, item_date, {_kebab("replace(x, '/', '-')")} FROM (SELECT *, unnest(regexp_extract_all(lower(t), '(?:^|\s)#([a-z][\p{{L}}\p{{N}}_/-]*)', 1)) AS x FROM t) WHERE NOT regexp_matches(x, '^(thread|client|status|area|project)/')
        UNION ALL SELECT item_id, source, item_date, {_kebab("x")} FROM (SELECT *, unnest(regexp_extract_all(t, '\[\[([^\]|#]+?)(?:\|[^\]]+)?\]\]', 1)) AS x FROM t) WHERE NOT regexp_matches(trim(x), '^\d{{4}}-\d{{2}}-\d{{2}}')),
    m AS (SELECT DISTINCT * FROM c WHERE length(slug) >= 5 AND NOT regexp_full_match(slug, '[0-9]+') AND slug NOT IN ({_NOISE})),
    e AS (SELECT slug, count(DISTINCT item_id) AS items, count(DISTINCT source) AS sources, min(item_date) AS first, max(item_date) AS latest FROM m GROUP BY slug)"""


@query(f"WITH {_MENTIONS} SELECT *, items * (1.0 + (sources - 1) * 0.5)::DOUBLE AS score FROM e WHERE items >= 3 AND sources >= 2 ORDER BY score DESC, items DESC, slug LIMIT 25")
def emerge_ranked(spark, sf_dir):
    return _emerged(spark, sf_dir)


@query(f"WITH {_MENTIONS} SELECT slug, count(DISTINCT item_id) AS items, count(DISTINCT source) AS sources FROM m WHERE item_date >= DATE '2024-01-31' - 14 GROUP BY slug")
def emerge_window_counts(spark, sf_dir):
    return emergence.emerge(_items(spark, sf_dir), today=TODAY, window_days=14, top=None, min_items=1, min_sources=1, body_chars=None).select("slug", "items", "sources")


@query(f"WITH {_MENTIONS}, best AS (SELECT slug, items, first, latest, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM m WHERE m.slug = e.slug) AS sources FROM e WHERE items >= 3 AND e.sources >= 2 ORDER BY items * (1.0 + (e.sources - 1) * 0.5) DESC, items DESC, slug LIMIT 25) SELECT slug, items, sources, first::DATE AS first, latest::DATE AS latest FROM best")
def patterns_report(spark, sf_dir):
    """The ranked patterns as a report, and its rows read again."""
    best = emergence.emerge(_items(spark, sf_dir), body_chars=None)
    report = pages.patterns_report(best, [F.desc("score"), F.desc("items"), "slug"])
    rows = report.select(F.explode(payloads.report_rows(F.col("report"))).alias("r"))
    return rows.select("r.slug", F.col("r.items").cast("long").alias("items"), F.array_join("r.sources", ",").alias("sources"), "r.first", "r.latest")


@query(f"""WITH {_MENTIONS}, deny AS (SELECT DISTINCT regexp_replace(lower(text[1:40]), '[^a-z0-9]', '', 'g') AS k FROM (SELECT 'MIT License' AS text UNION ALL SELECT 'Doc 1'))
    SELECT slug, count(DISTINCT item_id) AS items FROM m WHERE regexp_replace(slug, '[^a-z0-9]', '', 'g') NOT IN (SELECT k FROM deny) GROUP BY slug""")
def emerge_denied(spark, sf_dir):
    deny = emergence.deny_set(known=spark.createDataFrame([("MIT License",), ("Doc 1",)], "name string"))
    return emergence.mentions(_items(spark, sf_dir), deny, None).groupBy("slug").agg(F.countDistinct("unit").alias("items"))


@query("""WITH RECURSIVE l AS (SELECT doc_id AS rec, source, unnest(list_distinct([x for x in string_split(text, chr(10)) if length(x) >= 40])) AS token FROM documents),
    s AS (SELECT token FROM l GROUP BY token HAVING count(*) > 1), e AS (SELECT DISTINCT rec, min(rec) OVER (PARTITION BY token) AS hub FROM l WHERE token IN (SELECT token FROM s)),
    n AS (SELECT rec AS a, hub AS b FROM e UNION SELECT hub, rec FROM e),
    r AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), c AS (SELECT a AS rec, least(min(b), a) AS lead FROM r GROUP BY a)
    SELECT doc_id AS rec, coalesce(lead, doc_id) AS lead, count(*) OVER (PARTITION BY coalesce(lead, doc_id)) AS size FROM documents LEFT JOIN c ON doc_id = rec""")
def record_components(spark, sf_dir):
    """Records that share a long line, directly or through others, are one unit."""
    docs = view(spark, sf_dir, "documents")
    lines = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) >= 40))
    records = docs.select(F.col("doc_id").alias("rec"), F.lit("doc").alias("source"), F.transform(lines, F.sha1).alias("tokens"))
    units = emergence.group_records(records, ["doc"]).select("rec", F.col("unit").alias("lead"))
    return units.join(units.groupBy("lead").agg(F.count(F.lit(1)).alias("size")), "lead").select("rec", "lead", "size")


# --- notes, frontmatter, links ---------------------------------------------------------


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_frontmatter(view(spark, sf_dir, "v_notes"))


@query(r"""SELECT doc_id, regexp_extract(v_notes.text, '(?m)^type: (.*)$', 1) AS kind, CAST(regexp_extract(v_notes.text, '(?m)^date: (.*)$', 1) AS DATE) AS day, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang,
    'doc,thread/t' || (doc_id % 7) AS tags, 'ada.lovelace' || (doc_id % 11) || '@acme.example,bob+x@mail.' || v_notes.source || '.example' AS attendees, stem AS title FROM v_notes JOIN documents USING (doc_id)""")
def frontmatter_fields(spark, sf_dir):
    f = F.col("fm")
    return _notes(spark, sf_dir).select(
        "doc_id", fm.scalar(f, "type").alias("kind"), F.to_date(fm.scalar(f, "date")).alias("day"), fm.scalar(f, "lang").alias("lang"),
        F.array_join(fm.values(f, "tags"), ",").alias("tags"), F.array_join(fm.values(f, "attendees"), ",").alias("attendees"), "title",
    )


@query(r"""WITH l AS (SELECT stem, CASE WHEN doc_id % 10 <> 0 THEN 'Doc ' || (doc_id - 1) ELSE 'Missing ' || (doc_id % 13) END AS target FROM v_notes)
    SELECT doc_id, rel FROM v_notes WHERE stem NOT IN (SELECT target FROM l WHERE stem <> target)""")
def orphans(spark, sf_dir):
    notes = view(spark, sf_dir, "v_notes")
    return audit.orphans(notes, N.links(notes)).select("doc_id", "rel")


@query(r"""WITH l AS (SELECT stem, CASE WHEN doc_id % 10 <> 0 THEN 'Doc ' || (doc_id - 1) ELSE 'Missing ' || (doc_id % 13) END AS target FROM v_notes)
    SELECT target, count(DISTINCT stem) AS files, min(stem) AS example FROM l WHERE target NOT IN (SELECT stem FROM v_notes) GROUP BY target""")
def broken_links(spark, sf_dir):
    notes = view(spark, sf_dir, "v_notes")
    return audit.broken_links(N.links(notes), notes)


@query(r"""SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN 'Doc ' || (doc_id - 1) ELSE 'Missing ' || (doc_id % 13) END AS cited, doc_id % 10 <> 0 AND doc_id - 1 IN (SELECT doc_id FROM v_notes) AS resolved FROM v_notes""")
def citation_gate(spark, sf_dir):
    notes = view(spark, sf_dir, "v_notes")
    return search.citations(notes.select(F.col("doc_id").alias("id"), "text"), notes)


@query(r"""WITH l AS (SELECT folder, CASE WHEN doc_id % 10 <> 0 THEN 'Doc ' || (doc_id - 1) ELSE 'Missing ' || (doc_id % 13) END AS target FROM v_notes)
    SELECT stem, note_date, (DATE '2024-02-20' - note_date)::INTEGER AS age FROM v_notes WHERE folder LIKE 'raw/%' AND DATE '2024-02-20' - note_date >= 30
    AND stem NOT IN (SELECT target FROM l WHERE folder NOT LIKE 'raw/%') AND stem <> 'Doc 3' ORDER BY age DESC, stem LIMIT 50""")
def stale_raw(spark, sf_dir):
    notes = view(spark, sf_dir, "v_notes")
    raw = F.startswith("folder", F.lit("raw/"))
    wiki = spark.createDataFrame([("page", "Doc 3")], "stem string, mentioned string")
    return audit.stale(notes.filter(raw).select("stem", "note_date"), N.links(notes.filter(~raw)), wiki, "2024-02-20").select("stem", "note_date", "age")


@query("SELECT rel, CASE WHEN doc_id % 5 = 0 THEN 'meeting' ELSE 'raw-doc' END AS type, CASE WHEN doc_id % 5 = 0 THEN 'participants,title' ELSE 'lang' END AS missing FROM v_notes WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def fm_violations(spark, sf_dir):
    rules = {"meeting": ("type", "date", "title", "participants"), "raw-doc": ("type", "date", "lang")}
    return audit.violations(_notes(spark, sf_dir), rules).withColumn("missing", F.array_join("missing", ","))


@query("SELECT folder, count(*) AS n FROM v_notes GROUP BY folder HAVING count(*) > 20")
def inbox_overflow(spark, sf_dir):
    return audit.overflow(view(spark, sf_dir, "v_notes"))


@query("""SELECT rel, doc_id % 3 = 1 AS done, note_date + 3 AS due, CASE WHEN doc_id % 3 = 1 THEN note_date + 3 END AS completed,
    doc_id % 3 <> 1 AND note_date + 3 < DATE '2024-01-20' AS overdue FROM v_notes""")
def task_lists(spark, sf_dir):
    found = audit.tasks(view(spark, sf_dir, "v_notes"))
    late = F.coalesce(~F.col("done") & (F.col("due") < F.lit("2024-01-20").cast("date")), F.lit(False))
    return found.select("rel", "done", "due", "completed", late.alias("overdue"))


@query("SELECT count(*) AS n, min(note_date + 3) AS first, max(note_date + 3) AS last FROM v_notes WHERE doc_id % 3 = 1 AND note_date + 3 BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'")
def tasks_completed_in_week(spark, sf_dir):
    done = audit.completed_in_week(audit.tasks(view(spark, sf_dir, "v_notes")), "2024-01-17")
    return done.agg(F.count(F.lit(1)).alias("n"), F.min("completed").alias("first"), F.max("completed").alias("last"))


@query("SELECT note_date, stem FROM v_notes WHERE folder = '20 - Projects' AND doc_id % 11 = 4 ORDER BY note_date DESC, stem LIMIT 20")
def dataview_table(spark, sf_dir):
    mine = F.array_contains(fm.values(F.col("fm"), "attendees"), "ada.lovelace4@acme.example")
    return audit.Table(_notes(spark, sf_dir)).from_("20 - Projects").where(mine).sort(F.desc("note_date"), "stem").limit(20).table("note_date", "stem")


# --- threads ---------------------------------------------------------------------------

_TAGS = r"g AS (SELECT rel, source, note_date, unnest(list_distinct(regexp_extract_all(text, '#thread/([A-Za-z0-9_-]+)', 1))) AS slug FROM v_notes)"


@query(f"WITH {_TAGS} SELECT slug, count(DISTINCT rel) AS files, count(DISTINCT rel) FILTER (rel NOT LIKE '40 - %') AS evidence, count(DISTINCT source) FILTER (rel NOT LIKE '40 - %') AS n_sources, max(note_date) FILTER (rel NOT LIKE '40 - %') AS latest FROM g GROUP BY slug")
def thread_evidence(spark, sf_dir):
    return threads.evidence(view(spark, sf_dir, "v_notes"), ("40 - ",)).withColumn("n_sources", F.size("sources").cast("long")).drop("sources")


@query(f"""WITH {_TAGS}, k AS (SELECT regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS key, * FROM g)
    SELECT arg_min(slug, lpad((1000 - length(slug))::VARCHAR, 4, '0') || slug) AS slug, count(DISTINCT rel) FILTER (rel NOT LIKE '40 - %') AS evidence, max(note_date) FILTER (rel NOT LIKE '40 - %') AS latest,
    CASE WHEN count(DISTINCT rel) FILTER (rel NOT LIKE '40 - %') >= 3 THEN 'missing' ELSE 'thin' END AS status, count(DISTINCT slug) - 1 AS n_variants, count(DISTINCT source) FILTER (rel NOT LIKE '40 - %') AS n_sources, NULL::VARCHAR AS dup_of FROM k WHERE key <> 't3' GROUP BY key""")
def thread_worklist(spark, sf_dir):
    pages = spark.createDataFrame([("T_3",), ("other-page",)], "slug string")
    return threads.worklist(view(spark, sf_dir, "v_notes"), pages, ("40 - ",)).withColumn("n_variants", F.size("variants").cast("long")).withColumn("n_sources", F.size("sources").cast("long")).drop("variants", "sources")


@query(f"""WITH {_TAGS}, a AS (SELECT slug, count(DISTINCT rel) FILTER (note_date >= DATE '2024-01-31' - 7) AS files, max(note_date) AS latest FROM g GROUP BY slug)
    SELECT *, CASE WHEN files >= 2 THEN 'active' WHEN latest <= DATE '2024-01-31' - 14 THEN 'stalled' ELSE 'quiet' END AS state FROM a""")
def thread_activity(spark, sf_dir):
    tags = view(spark, sf_dir, "v_notes").select("rel", F.col("note_date").alias("day"), F.explode(F.array_distinct(T.extract(F.col("text"), T.THREAD_TAG))).alias("slug"))
    return threads.activity(tags, TODAY)


@query("SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key, 2::BIGINT AS n FROM part GROUP BY 1")
def duplicate_slugs_exact(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    slugs = part.select(F.lit("thread").alias("kind"), T.kebab(F.col("p_name")).alias("slug")).union(part.select(F.lit("page"), F.replace("p_name", F.lit(" "), F.lit(""))))
    return threads.duplicate_slugs(slugs).select("key", "n")


@query("""WITH s AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') AS slug FROM part), t AS (SELECT slug, unnest(string_split(slug, '-')) AS token FROM s), f AS (SELECT DISTINCT slug, token FROM t WHERE length(token) >= 3)
    SELECT x.slug AS a, y.slug AS b, string_agg(x.token, ',' ORDER BY x.token) AS shared FROM f x JOIN f y ON x.token = y.token AND x.slug < y.slug GROUP BY ALL""")
def token_overlap_pairs(spark, sf_dir):
    slugs = view(spark, sf_dir, "part").select(T.kebab(F.col("p_name")).alias("slug"))
    return threads.token_overlap(slugs).withColumn("shared", F.array_join("shared", ","))


_SHARED = """s AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') AS slug FROM part), f AS (SELECT DISTINCT slug, token FROM (SELECT slug, unnest(string_split(slug, '-')) AS token FROM s) WHERE length(token) >= 3),
    p AS (SELECT x.slug AS a, y.slug AS b, string_agg(x.token, ',' ORDER BY x.token) AS shared FROM f x JOIN f y ON x.token = y.token AND x.slug < y.slug GROUP BY ALL)"""


@query(f"WITH {_SHARED}, n AS (SELECT token, count(*) AS members FROM f GROUP BY 1 HAVING count(*) > 1) SELECT token, slug, members, (members * (members - 1) // 2)::BIGINT AS links, (SELECT count(*) FROM p) AS total FROM f JOIN n USING (token)")
def token_overlap_classes(spark, sf_dir):
    slugs = view(spark, sf_dir, "part").select(T.kebab(F.col("p_name")).alias("slug"))
    return threads.token_classes(slugs).crossJoin(F.broadcast(threads.overlaps_total(slugs).withColumnRenamed("n", "total")))  # one row


@query(f"WITH {_SHARED} SELECT * FROM p ORDER BY a, b LIMIT 25")
def token_overlap_first(spark, sf_dir):
    slugs = view(spark, sf_dir, "part").select(T.kebab(F.col("p_name")).alias("slug"))
    return threads.first_overlaps(slugs).withColumn("shared", F.array_join("shared", ","))


@query("SELECT doc_id, quality::VARCHAR AS evidence_count FROM documents LEFT JOIN labels USING (doc_id) WHERE quality <= 1 OR (quality IS NULL AND source = 'src1')")
def hollow_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "documents").join(view(spark, sf_dir, "labels"), "doc_id", "left")
    pages = pages.select("doc_id", F.when(F.col("source") == "src1", "concept").otherwise("synthesis").alias("kind"), F.col("quality").cast("string").alias("evidence_count"))
    return threads.hollow(pages).select("doc_id", "evidence_count")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id % 7, source ORDER BY item_date DESC, title) AS k FROM v_items)
    SELECT item_id % 7 AS thread, item_id, row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_date DESC, title) AS rank FROM r WHERE k <= 5 QUALIFY rank <= 20""")
def evidence_top_k(spark, sf_dir):
    items = view(spark, sf_dir, "v_items").selectExpr("item_id % 7 as thread", "item_id", "source", "item_date as date", "title as path")
    return threads.top_evidence(items).select("thread", "item_id", F.col("rank").cast("long"))


@query("""WITH f AS (SELECT item_id % 7 AS thread, substr(sha1(string_agg(title || ':' || item_date, chr(10) ORDER BY title || ':' || item_date)), 1, 16) AS fingerprint, count(*) AS n FROM v_items GROUP BY 1)
    SELECT *, CASE thread WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'current' END AS status FROM f""")
def change_status(spark, sf_dir):
    now = threads.fingerprints(view(spark, sf_dir, "v_items").selectExpr("item_id % 7 as thread", "title as path", "item_date as mtime"))
    stored = now.filter("thread <> 0").withColumn("fingerprint", F.when(F.col("thread") == 1, "0").otherwise(F.col("fingerprint")))
    return threads.change_status(now, stored).select("thread", "fingerprint", "n", "status")


@query(f"""WITH {_MENTIONS}, p AS (SELECT slug, count(DISTINCT item_id) AS items, count(DISTINCT source) FILTER (source IN ('src0', 'src1', 'src2', 'src3')) AS work, count(DISTINCT item_date) AS runs FROM m GROUP BY slug)
    SELECT slug, items, runs, CASE WHEN (work >= 2 OR items >= 5) AND runs >= 2 THEN 'auto' WHEN work >= 2 OR items >= 5 THEN 'pending' ELSE 'review' END AS bucket FROM p""")
def promotion_classify(spark, sf_dir):
    found = emergence.mentions(_items(spark, sf_dir), None, None)
    runs = threads.runs(threads.observe(found.select("slug", F.col("date").alias("obs_date")).limit(0), found.select("slug", F.col("date").alias("obs_date"))))
    patterns = found.groupBy("slug").agg(F.countDistinct("unit").alias("items"), F.collect_set("unit_source").alias("source_list")).join(runs, "slug")
    return threads.classify(patterns, ("src0", "src1", "src2", "src3")).select("slug", "items", "runs", "bucket")


@query(f"""WITH {_MENTIONS}, p AS (SELECT slug, count(DISTINCT item_id) AS items FROM m GROUP BY slug)
    SELECT slug, items, CASE WHEN row_number() OVER (ORDER BY items DESC, slug) <= 8 THEN 'now' ELSE 'later' END AS wave FROM p""")
def capped_rollout(spark, sf_dir):
    found = emergence.mentions(_items(spark, sf_dir), None, None).groupBy("slug").agg(F.countDistinct("unit").alias("items"))
    ranked = found.withColumn("rank", F.struct((-F.col("items")).alias("n"), "slug"))
    return threads.rollout(ranked).select("slug", "items", "wave")


@query("""WITH s AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') AS slug FROM part UNION SELECT unnest(['misc', 'wrap-up', 'nation-3', 'ada-hale', 'zed']))
    SELECT slug, CASE WHEN slug IN ('misc', 'wrap-up', 'zed', 'small-ring') THEN 'noise' WHEN slug = 'nation-3' THEN 'entity' WHEN slug = 'ada-hale' OR slug = 'red-widget' THEN 'person' END AS guard FROM s""")
def promotion_guard(spark, sf_dir):
    slugs = view(spark, sf_dir, "part").select(T.kebab(F.col("p_name")).alias("slug")).union(spark.createDataFrame([("misc",), ("wrap-up",), ("nation-3",), ("ada-hale",), ("zed",)], "slug string")).distinct()
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    return threads.guard(slugs, one("Small Ring"), view(spark, sf_dir, "nation").select("n_name"), one("Red Widget"), ("ada",))


# --- people and entities ---------------------------------------------------------------


def _attendees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_meetings").selectExpr("concat(local_part, '@', domain) as email", "meeting_date as date")


_PEOPLE = r"""p AS (SELECT lower(local_part || '@' || domain) AS email, count(*) AS mention_count, max(meeting_date) AS last_seen FROM v_meetings GROUP BY 1),
    q AS (SELECT *, regexp_replace(split_part(email, '@', 1), '\d+$', '') AS local FROM p),
    n AS (SELECT *, upper(split_part(local, '.', 1)[1]) || split_part(local, '.', 1)[2:] || ' ' || upper(split_part(local, '.', 2)[1]) || split_part(local, '.', 2)[2:] AS name,
          regexp_replace(split_part(split_part(email, '@', 2), '.', 2), '[^a-z0-9]', '', 'g') AS company FROM q)"""


@query(f"WITH {_PEOPLE} SELECT email, name, lower(replace(name, ' ', '-')) AS slug, company, mention_count, last_seen, CASE WHEN mention_count >= 8 THEN 1 WHEN mention_count >= 3 THEN 2 ELSE 3 END AS tier FROM n")
def people_mentions(spark, sf_dir):
    return people.extract(_attendees(spark, sf_dir)).drop("domain")


@query(f"WITH {_PEOPLE} SELECT email, replace(name, ' ', '-') || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN '-' || upper(company[1]) || company[2:] ELSE '' END AS file FROM n")
def people_collisions(spark, sf_dir):
    return people.resolve_collisions(people.extract(_attendees(spark, sf_dir))).select("email", "file")


@query(f"WITH {_PEOPLE} SELECT email, least(CASE WHEN mention_count >= 8 THEN 1 WHEN mention_count >= 3 THEN 2 ELSE 3 END, CASE WHEN email LIKE 'customer1%' THEN 1 ELSE 3 END) AS tier FROM n")
def people_tiers(spark, sf_dir):
    found = people.extract(_attendees(spark, sf_dir))
    old = found.filter("email like 'customer1%'").select("email", F.lit(1).alias("tier"))
    return people.keep_tier(found, old).select("email", "tier")


@query("""WITH m AS (SELECT DISTINCT o_orderkey AS meeting, 'Nation ' || c_nationkey AS entity, cast(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey
    UNION SELECT DISTINCT l_orderkey, 'Brand ' || p_brand, cast(o_orderdate AS DATE) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE regexp_matches(p_name, '(?i)widget|bolt')),
    k AS (SELECT 'Nation ' || n_nationkey AS entity FROM nation UNION SELECT 'Brand ' || p_brand FROM part UNION SELECT 'Nobody')
    SELECT entity, count(meeting) AS mention_count, min(day) AS first_seen, max(day) AS last_seen FROM k LEFT JOIN m USING (entity) GROUP BY entity""")
def entity_mentions(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    orders = v("orders").selectExpr("o_orderkey as meeting", "o_custkey", "cast(o_orderdate as date) as date")
    by_person = orders.join(v("customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("meeting", "concat('Nation ', c_nationkey) as entity", "date")
    seeds = spark.createDataFrame([("seed", "(?i)widget|bolt")], "entity string, pattern string")
    hit = people.seed_matches(v("part").selectExpr("p_partkey as id", "p_name as text"), seeds).select(F.col("id").alias("p_partkey"))
    by_seed = v("lineitem").join(v("part").join(hit, "p_partkey", "left_semi"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("meeting")).selectExpr("meeting", "concat('Brand ', p_brand) as entity", "date")
    known = v("nation").selectExpr("concat('Nation ', n_nationkey) as entity").union(v("part").selectExpr("concat('Brand ', p_brand)")).union(spark.createDataFrame([("Nobody",)], "entity string")).distinct()
    return people.entity_mentions(by_person.union(by_seed), known)


@query("""WITH c AS (SELECT DISTINCT lower(c_mktsegment) AS company FROM customer UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) || 'co' FROM part),
    e AS (SELECT unnest(['Household Goods', 'AUTO', 'mach', 'red', 'Small-co, Inc.', 'BLUECO', 'tan']) AS key, unnest([2, 2, 2, 2, 2, 2, 1]) AS kind), k AS (SELECT company, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS a, key, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS b, kind FROM c, e),
    j AS (SELECT company, key, CASE WHEN kind = 1 THEN 1 WHEN a = b THEN 2 ELSE 3 END AS rank FROM k WHERE kind = 1 AND a = 'redco' OR kind = 2 AND length(a) >= 4 AND length(b) >= 4 AND (starts_with(a, b) OR starts_with(b, a)))
    SELECT company, arg_min(key, rank || key) AS entity FROM j GROUP BY company""")
def org_prefix_match(spark, sf_dir):
    names = view(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("company")).union(view(spark, sf_dir, "part").selectExpr("concat(split(lower(p_name), ' ')[0], 'co')"))
    keys = ["Household Goods", "AUTO", "mach", "red", "Small-co, Inc.", "BLUECO"]
    entities = spark.createDataFrame([(k, k, []) for k in keys] + [("tan", "tan", ["Red-Co"])], "entity string, key string, aliases array<string>")
    return people.prefix_match(names, entities)


@query("SELECT 'Customer ' || o_custkey % 50 AS person, count(*) AS notes FROM orders GROUP BY 1 ORDER BY notes DESC, person LIMIT 10")
def contributors_topn(spark, sf_dir):
    return people.contributors(view(spark, sf_dir, "orders").selectExpr("array(concat('Customer ', o_custkey % 50)) as participants"))


@query("""WITH a AS (SELECT doc_id AS id, 0 AS pos, 'src' || (doc_id % 9) AS slug FROM documents UNION ALL SELECT doc_id, 1, source FROM documents UNION ALL SELECT doc_id, 2, 'nobody' FROM documents),
    k AS (SELECT DISTINCT source AS slug FROM documents), f AS (SELECT id, slug, min(pos) AS pos FROM a JOIN k USING (slug) GROUP BY 1, 2) SELECT id, string_agg(slug, ',' ORDER BY pos) AS participants FROM f GROUP BY id""")
def link_participants(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    mails = docs.selectExpr("doc_id as id", "array(concat('Some One <SRC', doc_id % 9, '@x.example>'), concat(source, '@x.example'), 'nobody@x.example') as addresses")
    known = docs.select(F.concat("source", F.lit("@x.example")).alias("email"), F.col("source").alias("slug")).distinct()
    return people.link_participants(mails, known).withColumn("participants", F.array_join("participants", ","))


# --- matching and routing --------------------------------------------------------------


@query("""WITH j AS (SELECT a.event_id AS id, b.event_type AS source, b.event_id AS match, abs(epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts)))::BIGINT AS gap FROM events a JOIN events b
    ON b.event_type <> 'signup' AND b.ts BETWEEN a.ts - INTERVAL 602 SECOND AND a.ts + INTERVAL 602 SECOND WHERE a.event_type = 'signup' AND abs(epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts))) <= 600)
    SELECT id, source, arg_min(match, gap * 1000000000 + match) AS match, min(gap) AS gap FROM j GROUP BY 1, 2""")
def nearest_within_10min(spark, sf_dir):
    rows = view(spark, sf_dir, "v_records").selectExpr("event_id as id", "source", "ts as start")
    return matching.nearest_within(rows.filter("source = 'signup'"), rows.filter("source <> 'signup'"), 600)


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, event_type AS kind, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), l AS (SELECT id, t, row_number() OVER (ORDER BY id) AS k FROM e WHERE kind = 'signup'),
    c AS (SELECT l.k, r.id, abs(r.t - l.t) AS gap FROM l JOIN e r ON r.kind = 'purchase' AND r.t BETWEEN l.t - 120 AND l.t + 120),
    s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS m UNION ALL
        SELECT k + 1, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END, m FROM (SELECT s.k, s.used, arg_min(c.id, c.gap * 1000000000 + c.id) AS m FROM s LEFT JOIN c ON c.k = s.k + 1 AND NOT list_contains(s.used, c.id) WHERE s.k < (SELECT count(*) FROM l) GROUP BY s.k, s.used))
    SELECT l.id AS left_id, s.m AS right_id FROM s JOIN l USING (k) WHERE s.m IS NOT NULL""")
def greedy_merge(spark, sf_dir):
    rows = view(spark, sf_dir, "v_records").selectExpr("event_id as id", "source", "ts as start", "event_id as ordinal")
    return matching.greedy_pairs(rows.filter("source = 'signup'"), rows.filter("source = 'purchase'"), 120)


_RULES = [(1, 0, "domain", "building", "clients/building"), (1, 1, "domain", "machinery", "clients/machinery"), (2, 0, "priority", "1-URGENT", "urgent"), (2, 1, "priority", "2-HIGH", "high"), (3, 0, "status", "F", "closed")]


@query("""SELECT meeting_id AS id, CASE WHEN domain LIKE '%.building.%' OR domain LIKE '%.machinery.%' THEN 1 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 WHEN o_orderstatus = 'F' THEN 3 END AS tier,
    CASE WHEN domain LIKE '%.building.%' THEN 'clients/building' WHEN domain LIKE '%.machinery.%' THEN 'clients/machinery' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderpriority = '2-HIGH' THEN 'high' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'inbox' END AS folder FROM v_meetings""")
def priority_routing(spark, sf_dir):
    m = view(spark, sf_dir, "v_meetings")
    items = m.selectExpr("meeting_id as id", "inline(array(named_struct('kind', 'domain', 'value', split(domain, '[.]')[1]), named_struct('kind', 'priority', 'value', o_orderpriority), named_struct('kind', 'status', 'value', o_orderstatus)))")
    return matching.route(items, spark.createDataFrame(_RULES, "tier int, ordinal int, kind string, value string, folder string"), "inbox")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS tier, CASE WHEN c_custkey % 3 = 0 THEN 'mail ' || c_custkey % 7 ELSE 'name ' || c_custkey % 5 END AS item FROM customer
    WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def exact_then_substring_match(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    titles = c.selectExpr("c_custkey as id", "if(c_custkey % 2 = 0, concat('Call: Red Widget', c_custkey % 5, ' review'), 'Red Widget6x') as title")
    emails = c.filter("c_custkey % 3 = 0").selectExpr("c_custkey as id", "posexplode(array('none@x.example', concat('m', c_custkey % 7, '@x.example'))) as (pos, email)")
    items = spark.createDataFrame([(f"mail {i}", f"m{i}@x.example", "") for i in range(7)] + [(f"name {i}", None, f"red widget{i}") for i in range(5)], "item string, email string, name string")
    return matching.match_items(titles, emails, items)


@query("""WITH o AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS target FROM orders GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT c_custkey, cast(o_orderdate AS DATE) AS day, target FROM customer JOIN o ON c_custkey = o_custkey""")
def exactly_one_link(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").selectExpr("o_custkey as c_custkey", "cast(o_orderdate as date) as day", "o_orderkey as target")
    left = view(spark, sf_dir, "customer").select("c_custkey").join(orders.select("c_custkey", "day").distinct(), "c_custkey")
    return matching.exactly_one(left, orders, ["c_custkey", "day"])


@query("SELECT CASE WHEN c_nationkey NOT IN (3, 7) THEN 'not_owner' ELSE 'private' END AS reason, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 7) OR c_acctbal < 0 GROUP BY 1")
def privacy_gate_counts(spark, sf_dir):
    calls = view(spark, sf_dir, "customer").selectExpr("c_custkey", "array(concat('N', c_nationkey, '@me.example')) as emails", "c_acctbal < 0 as private")
    return matching.privacy_gate(calls, ["n3@me.example", "n7@me.example"])[1]


@query("SELECT coalesce(a.c_custkey, b.s_suppkey) AS id, coalesce(nullif(CASE WHEN a.c_custkey % 2 = 0 THEN '' ELSE a.c_name END, ''), b.s_name) AS name, coalesce(a.c_acctbal, b.s_acctbal) AS balance FROM customer a FULL JOIN supplier b ON c_custkey = s_suppkey")
def merge_sides(spark, sf_dir):
    a = view(spark, sf_dir, "customer").selectExpr("c_custkey as id", "if(c_custkey % 2 = 0, '', c_name) as name", "c_acctbal as balance")
    return matching.merge_sides(a, view(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance"), "id")


# --- search ----------------------------------------------------------------------------

_TERMS = ["license", "the", "onth"]
_RANKED = r"""h AS (SELECT rel, stem, CASE WHEN rel LIKE 'raw/%' THEN 'raw' ELSE 'para' END AS layer, source, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '(?i)license'))))
      + (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '(?i)the')))) + (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '(?i)onth')))) AS hits FROM v_notes),
    s AS (SELECT *, round(hits * CASE WHEN layer = 'raw' THEN 1.0 ELSE 2.0 END, 2)::DOUBLE AS score FROM h WHERE hits > 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY layer, CASE WHEN layer = 'raw' THEN source END ORDER BY score DESC, hits DESC, rel) AS k FROM s)"""


@query(f"WITH {_RANKED} SELECT rel, stem, layer, hits, score FROM c WHERE layer <> 'raw' OR k <= 5 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY score DESC, hits DESC, rel) <= CASE layer WHEN 'raw' THEN 15 ELSE 12 END")
def research_search(spark, sf_dir):
    return search.search(view(spark, sf_dir, "v_notes"), _TERMS)


@query(f"WITH {_RANKED} SELECT rel, stem, layer, hits, score FROM c WHERE layer <> 'raw' OR k <= 5 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY score DESC, hits DESC, rel) <= CASE layer WHEN 'raw' THEN 15 ELSE 12 END")
def indexed_search(spark, sf_dir):
    """The same from an inverted index, made in three deltas, of which the last replaces what the first had of it."""
    import uuid

    path, notes = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", view(spark, sf_dir, "v_notes").withColumnRenamed("doc_id", "id")
    index.add(notes.filter("id % 2 = 0").withColumn("text", F.when(F.col("id") % 4 == 0, "the license of once").otherwise(F.col("text"))), path, 0)
    index.add(notes.filter("id % 2 = 1"), path, 1)
    index.add(notes.filter("id % 4 = 0"), path, 2)
    return index.search(notes, path, _TERMS)


@query(r"""WITH q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\-]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\-]+'), 1) AS i FROM benchmark),
    f AS (SELECT item_id, trim(w, '''-') AS w, min(i) AS i FROM q WHERE length(trim(w, '''-')) >= 3 AND trim(w, '''-') NOT IN (""" + ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS) + """) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f) SELECT item_id, string_agg(w, ',' ORDER BY k) AS terms FROM r WHERE k <= 8 GROUP BY 1""")
def question_terms(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.question_terms(F.col("text")), ",").alias("terms"))


# --- sessions and segments -------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + INTERVAL 100 SECOND * turn AS ts, CASE WHEN conv_id % 7 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN conv_id % 3 = 0 AND turn <= 1 THEN '' ELSE text END AS text,
        CASE WHEN turn % 2 = 0 THEN '/f' || turn % 5 END AS file FROM conversations),
    g AS (SELECT conv_id AS session, min(ts) AS started, max(ts) AS ended, count(*) FILTER (role IN ('user', 'assistant')) AS turns, (100 * (max(turn) - min(turn)) // 60)::BIGINT AS minutes, trim(replace(arg_min(text, turn) FILTER (role = 'user' AND text <> ''), chr(10), ' ')) AS p,
        trim(replace(arg_max(text, turn) FILTER (role = 'assistant'), chr(10), ' ')) AS a, coalesce(string_agg(DISTINCT file, ',' ORDER BY file), '') AS files FROM c GROUP BY conv_id)
    SELECT session, started, ended, turns, minutes, files, coalesce(CASE WHEN length(p) > 200 THEN substr(p, 1, 199) || '…' ELSE p END, '') AS first_prompt, coalesce(CASE WHEN length(a) > 200 THEN substr(a, 1, 199) || '…' ELSE a END, '') AS last_answer
    FROM g WHERE turns > 0 OR p IS NOT NULL""")
def session_summary(spark, sf_dir):
    events = view(spark, sf_dir, "conversations").selectExpr(
        "conv_id as session", "turn as line", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, 100 * turn) as ts", "if(conv_id % 7 = 0, 'tool', role) as role",
        "if(conv_id % 3 = 0 and turn <= 1, '', text) as text", "if(turn % 2 = 0, concat('/f', turn % 5), null) as file",
    )
    return segments.sessions(events).withColumn("files", F.array_join("files", ",")).select("session", "started", "ended", "turns", "minutes", "files", "first_prompt", "last_answer")


@query("""WITH m AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
    SELECT conv_id AS id, island::BIGINT AS island, min(role) AS speaker, min(turn) AS start, string_agg(text, ' ' ORDER BY turn) AS text FROM i GROUP BY 1, 2""")
def speaker_islands(spark, sf_dir):
    return segments.speaker_islands(view(spark, sf_dir, "conversations").selectExpr("conv_id as id", "turn as pos", "role as speaker", "text"))


@query("SELECT source, arg_max(doc_id, n_chars * 100000000 - doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def keep_richest(spark, sf_dir):
    return segments.keep_richest(view(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) FILTER (doc_id % 3 = 0) AS lang FROM documents GROUP BY source")
def later_wins(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").selectExpr("source", "doc_id", "if(doc_id % 3 = 0, lang, '') as lang")
    return segments.later_wins(docs, "source", "doc_id", "lang")


@query("WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    return segments.ordered_distinct(view(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


# --- merge policies --------------------------------------------------------------------


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "source", "sha1(coalesce(text, '')) as hash")
    return docs, docs.filter("id % 3 <> 0").withColumn("hash", F.when(F.col("id") % 3 == 1, "old").otherwise(F.col("hash")))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'insert' ELSE 'unchanged' END AS action, count(*) AS n FROM documents GROUP BY 1")
def merge_insert_only(spark, sf_dir):
    return merge.counters(merge.insert_only(*_batch(spark, sf_dir), "id"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'unchanged' END AS action FROM documents")
def merge_by_hash(spark, sf_dir):
    return merge.by_value(*_batch(spark, sf_dir), "id", "hash").select("id", "action")


@query("SELECT doc_id AS id, source, sha1(coalesce(text, '')) AS hash FROM documents")
def merge_applied(spark, sf_dir):
    """The table after a merge: every row as the batch has it."""
    new, old = _batch(spark, sf_dir)
    return merge.apply(merge.by_value(new, old, "id", "hash"), old, "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'unchanged' WHEN o_orderkey % 5 = 0 THEN 'insert' ELSE 'update' END AS action FROM orders")
def merge_by_stamp(spark, sf_dir):
    new = view(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "cast(o_orderdate as string) as stamp")
    old = new.filter("id % 2 = 0 or id % 5 <> 0").withColumn("stamp", F.when(F.col("id") % 2 == 0, F.col("stamp")))
    return merge.by_value(new, old, "id", "stamp").select("id", "action")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 4 = 3 THEN 'conflict' WHEN n_chars < 300 THEN CASE WHEN doc_id % 4 = 0 THEN 'stub-written' ELSE 'no-content' END
    WHEN doc_id % 4 = 0 THEN 'fresh' WHEN doc_id % 4 = 1 THEN 'already-current' ELSE 'enriched' END AS status FROM documents""")
def record_state_machine(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "doc_id % 11 <> 0 as valid", "n_chars >= 300 as has_content", "sha1(coalesce(text, '')) as hash")
    old = docs.filter("id % 4 <> 0").selectExpr("id", "element_at(array('summary', 'stub', 'other'), cast(id % 4 as int)) as kind", "hash")
    return merge.record_states(docs, old).select("id", "status")


@query("SELECT event_type, max(ts) - INTERVAL 24 HOUR AS cursor FROM events GROUP BY 1")
def cursor_high_water(spark, sf_dir):
    return merge.high_water(view(spark, sf_dir, "events"), "ts", by=("event_type",))


# --- functions -------------------------------------------------------------------------


@query(r"""WITH a AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' sk-' || sha1(doc_id::VARCHAR) WHEN 1 THEN ' ghp_' || substr(sha1(doc_id::VARCHAR), 1, 36) || ' Password: x' || doc_id WHEN 2 THEN ' password=REDACTED' ELSE '' END AS t0 FROM documents),
    b AS (SELECT *, regexp_replace(t0, 'sk-[A-Za-z0-9]{20,}', 'sk-REDACTED', 'g') AS t1 FROM a), c AS (SELECT *, regexp_replace(t1, 'ghp_[A-Za-z0-9]{36}', 'ghp_REDACTED', 'g') AS t2 FROM b),
    d AS (SELECT *, regexp_replace(t2, 'AKIA[0-9A-Z]{16}', 'AKIA_REDACTED', 'g') AS t3 FROM c), e AS (SELECT *, regexp_replace(t3, 'xoxb-[A-Za-z0-9-]{30,}', 'xoxb-REDACTED', 'g') AS t4 FROM d),
    f AS (SELECT *, regexp_replace(t4, 'Bearer [A-Za-z0-9._-]{30,}', 'Bearer REDACTED', 'g') AS t5 FROM e), g AS (SELECT *, regexp_replace(t5, '(?i)password\s*[=:]\s*\S+', 'password=REDACTED', 'g') AS t6 FROM f),
    h AS (SELECT *, regexp_replace(t6, '(?i)api[_-]?key\s*[=:]\s*\S+', 'api_key=REDACTED', 'g') AS t7 FROM g)
    SELECT doc_id, (t0 <> t1)::INT + (t1 <> t2)::INT + (t2 <> t3)::INT + (t3 <> t4)::INT + (t4 <> t5)::INT + (t5 <> t6)::INT + (t6 <> t7)::INT AS n, sha1(t7) AS text FROM h""")
def redact_counts(spark, sf_dir):
    t = F.expr("concat(coalesce(text, ''), case doc_id % 4 when 0 then concat(' sk-', sha1(cast(doc_id as string))) when 1 then concat(' ghp_', substr(sha1(cast(doc_id as string)), 1, 36), ' Password: x', doc_id) when 2 then ' password=REDACTED' else '' end)")
    r = T.redact(t)
    return view(spark, sf_dir, "documents").select("doc_id", r["n"].cast("int").alias("n"), F.sha1(r["text"]).alias("text"))


@query(rf"""SELECT p_partkey, {_kebab("p_name || ' _ (New)'")} AS kebab, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS fuzzy, trim(regexp_replace(lower(p_brand || '  ' || p_type), '[^a-z0-9-]+', '-', 'g'), '-') AS plain FROM part""")
def slug_variants(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", T.kebab(F.concat("p_name", F.lit(" _ (New)"))).alias("kebab"), T.fuzzy_key(F.col("p_name")).alias("fuzzy"), T.plain_slug(F.concat("p_brand", F.lit("  "), "p_type")).alias("plain"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents)""")
def excerpts(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.coalesce("text", F.lit("")), 120).alias("excerpt"))


@query("""SELECT o_orderkey, CASE WHEN m < 60 THEN m || 'm' ELSE printf('%dh %02dm', m // 60, m % 60) END AS human, printf('%02d:%02d', m // 60, m % 60) AS clock, week AS iso_week, monday
    FROM (SELECT o_orderkey, (o_orderkey % 200 + 1)::BIGINT AS m, printf('%d-W%02d', isoyear(o_orderdate), weekofyear(o_orderdate)) AS week, date_trunc('week', o_orderdate)::DATE AS monday FROM orders)""")
def durations_and_weeks(spark, sf_dir):
    m = F.col("o_orderkey") % 200 + 1
    return view(spark, sf_dir, "orders").select("o_orderkey", D.duration(m).alias("human"), D.minutes_text(m).alias("clock"), D.iso_week(F.col("o_orderdate")).alias("iso_week"), D.monday(F.col("o_orderdate")).alias("monday"))


@query("SELECT event_id, timezone('America/Chicago', timezone('UTC', ts)) AS local, date_trunc('second', ts) AS utc FROM events")
def tz_convert(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", D.to_local(F.col("ts"), "America/Chicago").cast("timestamp_ntz").alias("local"), D.iso_utc(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).cast("timestamp_ntz").alias("utc"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '"' || c_name || '"' WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE '"a: b"' END AS scalar, '[' || lower(c_mktsegment) || ', "x,y"]' AS list FROM customer""")
def yaml_render(spark, sf_dir):
    value = F.expr("case c_custkey % 3 when 0 then c_name when 1 then lower(c_mktsegment) else 'a: b' end")
    return view(spark, sf_dir, "customer").select("c_custkey", T.yaml_str(value).alias("scalar"), T.yaml_list(F.array(F.lower("c_mktsegment"), F.lit("x,y"))).alias("list"))


# --- parsers ---------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM s""")
def html_strip(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", html.strip(F.col("html")).alias("text"))


@query()
def html_to_markdown(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("markdown"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).alias("said")).filter("said <> ''")
    return rows.filter(~F.col("said").rlike("<|&|=== Message"))


_SAID = r"""s AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS said FROM conversations), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM s WHERE said <> '' AND NOT regexp_matches(said, '<|&|=== Message'))"""


def _joined(rows: DataFrame, line) -> DataFrame:
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("p"))
    return parts.select(F.col("conv_id").alias("id"), F.array_join(F.transform("p", lambda p: p["x"]), "\n").alias("text"))


@query(f"WITH {_SAID} SELECT conv_id AS id, pos, turn * 61 AS start, CASE WHEN turn % 2 = 0 THEN role ELSE 'Ada ' || role END AS speaker, said AS text FROM t")
def vtt_parse(spark, sf_dir):
    clock = lambda s: F.format_string("%02d:%02d:%02d.000", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    start = F.col("turn") * 61
    body = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(": "), "said")).otherwise(F.concat(F.lit("<v Ada "), "role", F.lit(">"), "said", F.lit("</v>")))
    files = _joined(_turns(spark, sf_dir), F.concat(clock(start), F.lit(" --> "), clock(start + 5), F.lit("\n"), body, F.lit("\n")))
    return transcripts.vtt(files.withColumn("text", F.concat(F.lit("WEBVTT\n\n"), "text"))).select("id", F.col("pos").cast("long"), "start", "speaker", "text")


@query(f"WITH {_SAID} SELECT conv_id AS id, '17.' || turn AS ts, CASE turn % 3 WHEN 0 THEN 'U' || turn WHEN 1 THEN 'U0EX' ELSE '' END AS sender_id, CASE turn % 3 WHEN 0 THEN 'Jo ' || role WHEN 1 THEN 'Vale' ELSE 'unknown' END AS sender, CASE WHEN turn % 3 = 1 THEN '<@U0EX|Vale> ' ELSE '' END || said AS text FROM t")
def chat_block_parse(spark, sf_dir):
    t = F.col("turn")
    head = F.when(t % 3 == 0, F.concat(F.lit("from Jo "), "role", F.lit(" (U"), t, F.lit(") "))).otherwise(F.lit(""))
    block = F.concat(F.lit("=== Message "), head, F.lit("at 2024-01-01 ===\nMessage TS: 17."), t, F.lit("\n"), F.when(t % 3 == 1, "<@U0EX|Vale> ").otherwise(""), "said", F.lit("\n"))
    return transcripts.chat(_joined(_turns(spark, sf_dir), block)).drop("pos")


@query(f"WITH {_SAID} SELECT conv_id AS id, turn * 7 AS start, 'Speaker ' || role AS speaker, said AS text FROM t")
def transcript_turns(spark, sf_dir):
    line = F.concat(F.lit("["), D.offset_text(F.col("turn") * 7), F.lit("] Speaker "), "role", F.lit(":\n"), "said")
    return transcripts.turns(_joined(_turns(spark, sf_dir), line)).select("id", "start", "speaker", "text")


# --- streams ---------------------------------------------------------------------------


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup_available_now(spark, sf_dir):
    """Events read twice as a stream and settled by key: each counts once."""
    import uuid

    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    for copy in range(2):
        source.write.parquet(f"{out}/in/copy={copy}")
    stream = ingest.available(spark, f"{out}/in", source.schema, files_per_batch=1)
    ingest.run(stream, ingest.upsert_into(spark, f"{out}/table", "event_id", None), f"{out}/checkpoint")
    return ingest.latest(spark, f"{out}/table", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'u' || user_id % 50 AS slug, count(DISTINCT ts::DATE) AS runs FROM events GROUP BY 1")
def ledger_runs(spark, sf_dir):
    """Days on which something was seen, by a ledger on a stream that is stopped, started again and given old rows."""
    import uuid

    out, source = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", view(spark, sf_dir, "events")
    rows = source.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("slug"), F.to_date("ts").cast("string").alias("day"))
    for run, part in enumerate((rows.filter(F.col("day") < "2024-01-15"), rows)):
        part.write.parquet(f"{out}/in/run={run}")
        stream = ingest.available(spark, f"{out}/in", rows.schema).select("slug", "day")
        ingest.ledger_into(spark, stream, f"{out}/table", f"{out}/checkpoint")
    return ingest.latest(spark, f"{out}/table", "slug")


@query("SELECT event_type, count(*) AS n, max(ts) - INTERVAL 24 HOUR AS cursor FROM events GROUP BY 1")
def polled_service_cursor(spark, sf_dir):
    """A service that has the older half of the events at the first poll, all at the second, and nothing new at the
    third: each event counts once, and the cursor is what the next request will begin at."""
    import uuid

    out, source = f"{shared_dir(spark)}/poll-{uuid.uuid4().hex}", view(spark, sf_dir, "events")
    half = source.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    columns = "event_id long, ts timestamp_ntz, event_type string"
    for poll, part in enumerate((source.filter(F.col("ts") <= half), source.filter(F.col("ts") > half), None)):
        if part is not None:
            part.select("event_id", "ts", "event_type").write.parquet(f"{out}/service/poll={poll}")
        stream = polling.poll(spark, arrow_uri(spark, f"{out}/service"), columns, "ts", window_hours=24 * 7)
        ingest.run(stream, ingest.upsert_into(spark, f"{out}/table", "event_id", None), f"{out}/checkpoint")
    seen = ingest.latest(spark, f"{out}/table", "event_id")
    counts = seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(merge.high_water(seen, "ts", by=("event_type",)), "event_type")


# --- records ---------------------------------------------------------------------------


@query("""SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src2') THEN 'team/' || source WHEN doc_id % 5 IN (1, 4) THEN 'first' WHEN doc_id % 5 = 0 THEN 'by-path' ELSE '_unrouted' END AS route,
    CASE WHEN source IN ('src1', 'src2') THEN 'domain' WHEN doc_id % 5 IN (0, 1, 4) THEN 'label' ELSE 'unrouted' END AS tier FROM documents""")
def mail_routing(spark, sf_dir):
    mails = view(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat('Some One <a@', upper(source), '>') as sender", "array('x', element_at(array('clients/acme', 'other/beta', 'y', 'z', 'clients/acme'), cast(doc_id % 5 as int) + 1), if(doc_id % 5 = 4, 'Beta', 'w')) as labels")
    domains = spark.createDataFrame([("src1", "team/src1"), ("SRC2", "team/src2")], "domain string, route string")
    labels = spark.createDataFrame([(0, "team/Beta", "first"), (1, "Clients/Acme", "by-path"), (2, "beta", "later")], "ordinal int, label string, route string")
    return records.route_mail(mails, domains, labels)


@query("SELECT doc_id AS id, 'E' || source AS entity FROM documents WHERE doc_id % 4 = 3 UNION SELECT doc_id, 'Projects' FROM documents WHERE doc_id % 4 = 0")
def path_mentions(spark, sf_dir):
    notes = view(spark, sf_dir, "v_notes")
    entities = notes.selectExpr("concat('E', source) as entity", "upper(source) as folder").distinct().union(spark.createDataFrame([("Projects", "20 - projects")], "entity string, folder string"))
    return records.path_mentions(notes.selectExpr("doc_id as id", "rel"), entities)


@query("""WITH o AS (SELECT *, o_orderstatus <> 'P' AS seg, o_totalprice > 100000 AS ai, o_orderpriority = '3-MEDIUM' AS is_file, unnest([true, false]) AS include FROM orders)
    SELECT o_orderkey AS id, include, CASE WHEN is_file THEN 'file' WHEN ai THEN CASE WHEN include AND seg THEN 'full' ELSE 'pointer' END ELSE 'only-content' END AS policy,
    CASE WHEN is_file OR NOT ai THEN seg ELSE include AND seg END AS included FROM o""")
def transcript_policy(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "3-MEDIUM", "file").otherwise("api")
    both = [orders.select(F.col("o_orderkey").alias("id"), F.lit(x).alias("include"), records.transcript_policy(kind, F.col("o_totalprice") > 100000, x, F.col("o_orderstatus") != "P").alias("p")) for x in (True, False)]
    return both[0].union(both[1]).select("id", "include", "p.policy", "p.included")


@query("SELECT conv_id AS id, turn, CASE role WHEN 'user' THEN 'Ada' WHEN 'assistant' THEN 'Bo' ELSE 'Unknown speaker' END AS speaker FROM conversations")
def speaker_names(spark, sf_dir):
    segs = view(spark, sf_dir, "conversations").selectExpr("conv_id as id", "turn", "role as speaker_id")
    speakers = segs.select("id", "speaker_id").distinct().selectExpr("id", "speaker_id", "inline(case speaker_id when 'user' then array(named_struct('source', 'llm', 'name', 'No'), named_struct('source', 'user', 'name', 'Ada')) when 'assistant' then array(named_struct('source', 'consensus', 'name', 'Bo'), named_struct('source', 'mic', 'name', 'Nobody')) else array(named_struct('source', 'user', 'name', '')) end)")
    return records.speaker_names(segs, speakers).select("id", "turn", "speaker")


@query("SELECT p_partkey AS id, substr(sha1(replace(p_name, ' ', '-') || '|' || p_size), 1, 10) AS rid, p_type || ' (' || p_size || ')' AS tracker FROM part WHERE p_size > 0")
def record_ids(spark, sf_dir):
    part = view(spark, sf_dir, "part").filter("p_size > 0")
    calls = part.selectExpr("p_partkey as id", "array('') as key_points", "array('x') as highlights", "array(named_struct('name', p_type, 'duration', 0)) as topics", "array(named_struct('name', p_type, 'count', p_size), named_struct('name', 'none', 'count', 0)) as trackers")
    ids = part.select(F.col("p_partkey").alias("id"), records.record_id(F.col("p_name"), F.col("p_size")).alias("rid"))
    return ids.join(records.call_content(calls).select("id", F.array_join("trackers", ",").alias("tracker")), "id")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS attendees FROM events GROUP BY 1")
def attendee_lists(spark, sf_dir):
    rows = view(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.lit("n").alias("name"), F.upper("event_type").alias("email"))).alias("pairs"))
    return rows.select("user_id", F.lower(F.array_join(F.transform(records.attendees(F.col("pairs")), lambda x: x["email"]), ",")).alias("attendees"))


@query("""WITH b AS (SELECT event_id, epoch_ms(ts) AS ms FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'local' ELSE 'raw' END AS title FROM b
    WHERE (timezone('America/Chicago', timezone('UTC', make_timestamp(ms * 1000))))::DATE = DATE '2024-01-10'""")
def calendar_union(spark, sf_dir):
    events = view(spark, sf_dir, "events").selectExpr("event_id", "unix_millis(cast(ts as timestamp)) as ms")
    local, raw = events.filter("event_id % 2 = 0").withColumn("title", F.lit("local")), events.withColumn("title", F.lit("raw"))
    return records.calendar(local, raw, "2024-01-10", "America/Chicago").select("event_id", "title")


@query("SELECT c_custkey AS id, k AS name, v AS value FROM (SELECT c_custkey, unnest(['name', 'segment']) AS k, unnest([c_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END]) AS v FROM customer) WHERE v <> ''")
def column_rows(spark, sf_dir):
    items = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))).alias("columns"))
    return records.column_rows(items)


@query("WITH c AS (SELECT doc_id AS item, CASE WHEN n_chars < 60 THEN 0 ELSE 1 END AS level, n_chars AS rank FROM documents) SELECT item, level FROM c QUALIFY level = 0 OR row_number() OVER (ORDER BY level, rank, item) <= 3")
def needs_attention(spark, sf_dir):
    return records.attention(view(spark, sf_dir, "documents").selectExpr("doc_id as item", "if(n_chars < 60, 0, 1) as level", "n_chars as rank")).select("item", "level")
