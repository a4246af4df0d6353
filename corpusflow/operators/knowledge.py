"""Operators over a vault of notes: evidence, people and entity plans, search, migration, guards."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources import frontmatter as fm
from . import emergence, people as P
from . import search as S
from . import patterns, threads

# --- evidence of a thread ----------------------------------------------------------------

#: The order of sources, notes of the vault first.
SOURCE_ORDER = ("para", "fireflies", "gemini", "teams", "zoom", "gong", "gmail", "slack", "monday", "github", "claude-history", "wispr")
RAW_WINDOW, RAW_EXCERPT, PARA_EXCERPT = 2500, 600, 1000


def vocabulary(lines: Iterable[str]) -> dict[str, dict[str, list[str]]]:
    """slug -> include and exclude terms. A slug's line ends with a colon, its lists are inline and
    indented; # begins a comment. A malformed line is an error: a thread whose entry were dropped
    would find nothing."""
    out: dict[str, dict[str, list[str]]] = {}
    slug = None
    for n, raw in enumerate(lines, 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, colon, value = (x.strip() for x in line.strip().partition(":"))
        if line[0] not in " \t":
            if not line.endswith(":"):
                raise ValueError(f"line {n}: a slug and a colon expected, not {raw!r}")
            slug = line[:-1].strip()
            out[slug] = {"include": [], "exclude": []}
        elif slug is None or not colon or key not in ("include", "exclude") or not (value[:1] == "[" and value[-1:] == "]"):
            raise ValueError(f"line {n}: include or exclude with an inline list below a slug expected, not {raw!r}")
        else:
            out[slug][key] = [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip().strip("'\"")]
    return out


def word_list(lines: Iterable[str]) -> set[str]:
    """One word a line in lower case; # begins a comment."""
    return {w for line in lines if (w := line.split("#", 1)[0].strip().lower())}


def thread_patterns(terms: DataFrame) -> DataFrame:
    """terms (thread, include: array, exclude: array) -> (thread, yes, no, terms): patterns of whole words in
    any case: the slug, with hyphens and with blanks, and the included terms alike; the excluded ones.
    Terms of fewer than four letters don't count; no is null without any. terms: those of yes."""
    spread = lambda c: F.flatten(F.transform(c, lambda x: F.array(F.lower(F.trim(x)), F.replace(F.lower(F.trim(x)), F.lit("-"), F.lit(" ")))))
    pattern = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(F.transform(c, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|"), F.lit(r")\b")))
    long = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: F.length(x) >= 4)))
    none = F.array().cast("array<string>")
    yes = long(F.concat(spread(F.array("thread")), spread(F.coalesce("include", none))))
    no = long(F.transform(F.coalesce("exclude", none), lambda x: F.lower(F.trim(x))))
    return terms.select("thread", pattern(yes).alias("yes"), pattern(no).alias("no"), yes.alias("terms"))


def gather_raw(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """notes (path, source, title, body, date, mtime), terms as of thread_patterns -> (thread, path, source,
    date, title, excerpt, mtime, rank): raw notes that name a thread in their title or the first
    characters of their body and none of its excluded terms; the newest five of each source, the
    newest twenty of all. A thread is tried only on notes with one of its terms."""
    rows = notes.withColumn("__w", T.term_window(F.col("title"), F.col("body"), RAW_WINDOW))
    known = thread_patterns(terms).filter("yes is not null")
    found = patterns.join(rows, "__w", known, F.col("terms"), F.expr("__w rlike yes and (no is null or not __w rlike no)"))
    return threads.top_evidence(found.select("thread", "path", "source", "date", "title", T.excerpt(F.col("body"), RAW_EXCERPT).alias("excerpt"), "mtime"))


def gather_para(notes: DataFrame, slugs: DataFrame) -> DataFrame:
    """notes (path, folder tags: array, text, title, body, date, mtime) of the vault's own folders that carry
    a thread's tag, in their text or frontmatter: (thread, path, source para, date, title, excerpt, mtime)."""
    tags = F.array_distinct(F.concat(T.extract(F.col("text"), T.THREAD_TAG_LOWER), F.transform(F.filter("tags", lambda t: F.startswith(t, F.lit("thread/"))), lambda t: F.substring(t, 8, 1 << 10))))
    rows = notes.withColumn("thread", F.explode(tags)).join(slugs.select("thread"), "thread", "left_semi")
    return rows.select("thread", "path", F.lit("para").alias("source"), "date", "title", T.excerpt(F.col("body"), PARA_EXCERPT).alias("excerpt"), "mtime")


def evidence_bundle(para: DataFrame, raw: DataFrame, stored: DataFrame, slugs: DataFrame) -> DataFrame:
    """Of each thread: (thread, n, first, last, sources in their fixed order, fingerprint, status against
    stored (thread, fingerprint)). A thread without evidence has n 0 and the fingerprint of nothing."""
    both = para.select("thread", "path", "source", "date", "mtime").unionByName(raw.select("thread", "path", "source", "date", "mtime"))
    line = F.when(F.col("path").isNotNull(), F.concat_ws(":", "path", F.col("mtime").cast("string")))
    day = F.nullif(F.col("date").cast("string"), F.lit(""))
    got = slugs.select("thread").distinct().join(both, "thread", "left").groupBy("thread").agg(
        F.count("path").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.collect_set("source").alias("seen"),
        F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")), 1, 16).alias("fingerprint"),
    )
    order = F.array(*[F.lit(x) for x in SOURCE_ORDER])
    return threads.change_status(got.withColumn("sources", F.filter(order, lambda x: F.array_contains("seen", x))).drop("seen"), stored)


def related_sources(notes: DataFrame, pattern: str, most: int = 10) -> DataFrame:
    """The first raw notes by source and path that match: (stem, date, source)."""
    hit = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, 2000)).rlike(pattern)
    return notes.filter(hit).orderBy("source", "path").limit(most).select("stem", "date", "source")


# --- people ------------------------------------------------------------------------------


def people_plan(found: DataFrame, existing: DataFrame) -> DataFrame:
    """found as of people.extract, existing (file, tier as text, email, company, domain) -> found with
    file, action (create or update), collision, old_tier, new_tier, transition, dossier, the fields
    that an update fills: those the page lacks, and writes. A page's tier is never lowered; a tier that is no number is 3.

    A file is one page: of several rows for one in existing the one with the best tier stands for it. Several people
    keep one file where their companies agree as well; each has a row of the plan, and ``writes`` tells the one whose page it
    is: named most often, of those the last seen, then the one with the least address."""
    named = P.resolve_collisions(found)
    mine = W.partitionBy("file").orderBy(F.desc("mention_count"), F.desc_nulls_last("last_seen"), "email")
    named = named.withColumn("writes", F.row_number().over(mine) == 1)
    tier = F.coalesce(F.col("tier").try_cast("int"), F.lit(3)).alias("old_tier")
    pages = existing.select("file", tier, *[F.col(c).alias(f"__{c}") for c in ("email", "company", "domain")]).groupBy("file").agg(F.min(F.struct("old_tier", "__email", "__company", "__domain")).alias("page"))
    rows = named.join(pages.select("file", "page.*", F.lit(True).alias("there")), "file", "left")
    new = F.when(F.col("there"), F.least("old_tier", "tier")).otherwise(F.col("tier"))
    lacking = F.filter(F.array(*[F.when(F.col("there") & (F.coalesce(F.col(f"__{c}"), F.lit("")) == ""), F.lit(c)) for c in ("email", "company", "domain")]), lambda x: x.isNotNull())
    return rows.select(
        *named.columns, F.when(F.col("there"), "update").otherwise("create").alias("action"), F.array_contains(F.split("file", "-"), F.initcap("company")).alias("collision"), "old_tier", new.alias("new_tier"),
        F.coalesce(F.col("there") & (F.col("old_tier") != new), F.lit(False)).alias("transition"), ((new == 1) & (F.coalesce("old_tier", F.lit(3)) != 1)).alias("dossier"), lacking.alias("fills"),
    )


def insert_dossier(body: Column, block: str, mark: str) -> Column:
    """body with a block before its first section, or at its end; one that has it stays."""
    at = F.locate("\n## ", body)
    put = F.when(at > 0, F.concat(F.substring(body, F.lit(1), at), F.lit(block + "\n"), F.substring(body, at + 1, F.length(body)))).otherwise(F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n\n" + block)))
    return F.when(body.contains(mark), body).otherwise(put)


def refresh_person(text: Column, fields: dict[str, Column]) -> Column:
    """A person's page with the managed fields of its frontmatter set; all other lines stay."""
    for k, v in fields.items():
        text = fm.set_scalar(text, k, v)
    return text


# --- entities ----------------------------------------------------------------------------


def folder_names(notes: DataFrame, root: str) -> DataFrame:
    """(name) of the folders right below root, but hidden ones."""
    depth = len(root.strip("/").split("/"))
    parts = F.split("rel", "/")
    rows = notes.filter(F.startswith("rel", F.lit(root.strip("/") + "/"))).filter(F.size(parts) > depth + 1)
    return rows.select(parts[depth].alias("name")).filter(~F.startswith("name", F.lit("."))).distinct()


def discover_entities(notes: DataFrame, people: DataFrame, seeds: DataFrame, aliases: DataFrame, clients: str = "20 - Projects/Clients", areas: str = "30 - Areas") -> DataFrame:
    """(name, type, canonical_id, description): clients and areas (folders), organisations (companies of
    people with an address that are no client), products and technologies. seeds (type, name, canonical_id,
    description); aliases (alias, client)."""
    c = folder_names(notes, clients).select(F.regexp_replace("name", "[-_]", " ").alias("name"), F.lit("client").alias("type"), F.col("name").alias("canonical_id"), F.concat(F.lit(f"Client engagement (project root: `{clients}/"), "name", F.lit("/`).")).alias("description"))
    a = folder_names(notes, areas).select(F.replace("name", F.lit("-"), F.lit(" ")).alias("name"), F.lit("area").alias("type"), F.col("name").alias("canonical_id"), F.concat(F.lit(f"Personal area of responsibility (folder: `{areas}/"), "name", F.lit("/`).")).alias("description"))
    named = people.filter("trim(company) <> '' and trim(email) <> ''").groupBy(F.trim("company").alias("company")).agg(F.count(F.lit(1)).alias("n"))
    known = c.select(F.col("canonical_id").alias("entity"), F.col("canonical_id").alias("key")).join(aliases.groupBy(F.col("client").alias("entity")).agg(F.collect_set("alias").alias("aliases")), "entity", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    orgs = named.join(P.prefix_match(named.select("company"), known).select("company"), "company", "left_anti").withColumn("name", T.title_case_company(F.col("company")))
    first = orgs.groupBy("name").agg(F.min(F.struct("company", "n")).alias("o"))
    o = first.select("name", F.lit("org").alias("type"), F.col("name").alias("canonical_id"), F.concat(F.lit("Organization surfaced from "), F.col("o.n").cast("string"), F.lit(" CRM person record(s) with `company: "), "o.company", F.lit("`.")).alias("description"))
    return c.unionByName(a).unionByName(o).unionByName(seeds.select("name", "type", "canonical_id", "description"))


def entity_apply(pages: DataFrame, existing: DataFrame, start: str, end: str) -> DataFrame:
    """pages (id, text without the editable region), existing (id, text) -> (id, action, kept): create or
    update, and the old page's region where it has one."""
    from .pages import between

    old = existing.select("id", F.trim(between(F.col("text"), start, end)).alias("kept"), F.lit(True).alias("there"))
    return pages.join(old, "id", "left").select("id", F.when(F.col("there"), "update").otherwise("create").alias("action"), F.nullif("kept", F.lit("")).alias("kept"))


def entity_table(kind: str, name: str, canonical: str, clients: str = "20 - Projects/Clients", areas: str = "30 - Areas") -> Column:
    """Which notes (rel, links: array, text) an entity's page lists, by its type."""
    if kind in ("client", "area"):
        return F.startswith("rel", F.lit(f"{clients if kind == 'client' else areas}/{canonical}/"))
    return F.array_contains("links", canonical) if kind == "org" else F.contains("text", F.lit(name))


def org_mentions(meetings: DataFrame, people: DataFrame, clients: DataFrame, known: DataFrame) -> DataFrame:
    """meetings (id, participants: array of links), people (stem, company), clients (entity, key, aliases),
    known (entity, type) -> (id, entity): organisations of a meeting's people. A company that is a
    client counts for the client and so not here; the others by their title-cased name."""
    named = meetings.select("id", F.explode("participants").alias("p")).select("id", F.regexp_extract("p", r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", 1).alias("stem")).filter("stem <> ''")
    firms = people.filter("trim(company) <> ''").select("stem", F.trim("company").alias("company"))
    client = P.prefix_match(firms.select("company"), clients)
    entity = firms.join(client, "company", "left").select("stem", F.coalesce("entity", T.title_case_company(F.col("company"))).alias("entity"))
    orgs = known.filter("type = 'org'").select("entity")
    return named.join(entity, "stem").join(orgs, "entity", "left_semi").select("id", "entity").distinct()


def discover_threads(notes: DataFrame, folders: Iterable[str]) -> DataFrame:
    """(slug) of the thread tags in the notes (rel, text) of these folders."""
    keep = F.lit(False)
    for f in folders:
        keep |= F.startswith("rel", F.lit(f.rstrip("/") + "/"))
    return notes.filter(keep).select(F.explode(F.array_distinct(T.extract(F.col("text"), T.THREAD_TAG_LOWER))).alias("slug")).distinct()


def project_mentions(notes: DataFrame, clients: DataFrame, root: str = "20 - Projects/Clients") -> DataFrame:
    """notes (id, rel, project), clients (entity) -> (id, entity): a client's folder is in the path, or its
    id inside the project."""
    below = F.regexp_extract("rel", rf"(?:^|/){root}/([^/]+)/", 1)
    by_path = notes.select("id", below.alias("entity")).filter("entity <> ''").join(clients.select("entity"), "entity", "left_semi")
    named = patterns.join(notes.filter("project <> ''").select("id", "project"), "project", clients.select("entity"), F.array("entity"), F.contains("project", F.col("entity")))
    return by_path.select("id", "entity").union(named.select("id", "entity")).distinct()


# --- guards ------------------------------------------------------------------------------


def known_entities(notes: DataFrame, entity_folder: str = "wiki/entities", roots: tuple[str, ...] = ("20 - Projects/Clients", "30 - Areas")) -> DataFrame:
    """(name) of what is an entity already: pages (their name and canonical id) and folders."""
    pages = notes.filter(F.startswith("rel", F.lit(entity_folder + "/")))
    out = pages.select(F.col("stem").alias("name")).union(pages.select(fm.scalar(F.col("fm"), "canonical_id")))
    for r in roots:
        out = out.union(folder_names(notes, r))
    return out.filter("name is not null").distinct()


def person_names(notes: DataFrame, folder: str = "50 - CRM/People") -> DataFrame:
    return notes.filter(F.startswith("rel", F.lit(folder + "/"))).select(F.col("stem").alias("name")).distinct()


def observation_date(report: Column, today: str) -> Column:
    """When a report was made: its frontmatter's generated_at, else window_end, else today."""
    f = fm.parse(report)
    return F.coalesce(F.substring(T.first_filled(fm.scalar(f, "generated_at"), fm.scalar(f, "window_end")), 1, 10), F.lit(today))


def no_nudge(tasks: DataFrame, folders: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """tasks (rel, text) without those of quiet folders and those that carry a quiet tag or one below it."""
    keep = F.lit(True)
    for f in folders:
        keep &= ~F.startswith("rel", F.lit(f.strip("/") + "/"))
    found = F.regexp_extract_all("text", F.lit(r"(?U)#([\w/-]+)"), F.lit(1))
    quiet = [t.lstrip("#") for t in tags]
    if quiet:
        keep &= ~F.exists(found, lambda x: x.isin(*quiet) | x.rlike("^(?:" + "|".join(map(re.escape, quiet)) + ")/"))
    return tasks.filter(keep)


#: Parts of paths and names of files that list threads rather than speak of them.
REGISTRY_FOLDERS = ("raw", "60 - Meta", "wiki", "Dashboards", "Templates")
REGISTRY_FILES = ("AGENTS.md", "Thread-Review-Queue.md", "Emerging-Patterns.md")


def organic(notes: DataFrame, folders: tuple[str, ...] = REGISTRY_FOLDERS, files: tuple[str, ...] = REGISTRY_FILES) -> DataFrame:
    """notes (rel, text) that may tell of a thread's activity: neither registries nor generated ones, and
    without the sections that earlier reports put into them."""
    parts = F.split("rel", "/")
    inside = F.slice(parts, F.lit(1), F.size(parts) - 1)
    listed = F.arrays_overlap(inside, F.array(*[F.lit(f) for f in folders])) | F.element_at(parts, -1).isin(*files)
    made = F.map_contains_key(fm.parse(F.col("text")), "generated_by")
    own = F.regexp_replace(F.regexp_replace("text", r"(?msi)^## (?:\w+ )?morning report$.*?(?=^## |\z)", ""), r"(?ms)^### Active threads$.*?(?=^#{1,3} |\z)", "")
    return notes.filter(~listed & ~F.coalesce(made, F.lit(False))).withColumn("text", own)


def duplicates_by_id(incoming: DataFrame, notes: DataFrame, key: str = "meeting_id", first: int = 4096) -> DataFrame:
    """incoming (id) that a note (text) has in its first characters, as a line of its frontmatter."""
    head = F.substring("text", 1, first)
    ids = notes.select(F.explode(F.regexp_extract_all(head, F.lit(rf'{key}: "?([^"\s]+)'), F.lit(1))).alias("id")).distinct()
    return incoming.join(ids, "id", "left_semi")


# --- linking notes -------------------------------------------------------------------------


def linked_summaries(records: DataFrame, notes: DataFrame) -> DataFrame:
    """records (id, text with frontmatter), notes (stem, text) -> (id, status, overview, actions, keywords):
    what a record's note, named by a link in its frontmatter, can give it. status: converted, or why not."""
    f = fm.parse(F.col("text"))
    link = F.nullif(F.regexp_extract(fm.scalar(f, "meeting_note"), r"\[\[(.+?)\]\]", 1), F.lit(""))
    rows = records.select("id", fm.block(F.col("text")).isNotNull().alias("fenced"), fm.scalar(f, "transcript_status").alias("kept"), link.alias("stem"))
    first = notes.groupBy("stem").agg(F.min(F.struct("rel", "text"))["text"].alias("note"))
    got = rows.join(first, "stem", "left")
    body = fm.body(F.col("note"))
    overview, actions, words = T.section(body, "Summary"), T.section(body, "Action Items"), fm.values(fm.parse(F.col("note")), "keywords")
    empty = (overview == "") & (actions == "") & (F.size(words) == 0)
    status = (
        F.when(~F.col("fenced"), "no frontmatter").when(~F.col("kept").eqNullSafe(F.lit("retained")), "not retained").when(F.col("stem").isNull(), "no link")
        .when(F.col("note").isNull(), "no note").when(empty, "no content").otherwise("converted")
    )
    return got.select("id", status.alias("status"), overview.alias("overview"), actions.alias("actions"), words.alias("keywords"))


def migration(meetings: DataFrame, people: DataFrame) -> DataFrame:
    """meetings (id, fm), people (email, slug) -> (id, status, attendee_emails, participants, unmatched):
    the plan of a migration from attendees to participants. Those that have participants are done."""
    raw = F.transform(fm.values(F.col("fm"), "attendees"), lambda e: F.lower(F.trim(e)))
    rows = meetings.select("id", F.when(F.col("fm").isNull(), "no frontmatter").when(F.map_contains_key("fm", "participants"), "done").otherwise("migrate").alias("status"), F.filter(raw, lambda e: e.contains("@")).alias("emails"))
    each = rows.filter("status = 'migrate'").select("id", F.posexplode("emails").alias("pos", "email")).join(people.select(F.lower(F.trim("email")).alias("email"), "slug"), "email", "left")
    part = lambda c, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", c)))), lambda x: x[c])
    got = each.groupBy("id").agg(part("slug", F.col("slug").isNotNull()).alias("participants"), part("email", F.col("slug").isNull()).alias("unmatched"))
    none = F.array().cast("array<string>")
    out = rows.join(got, "id", "left")
    return out.select("id", "status", F.when(F.col("status") == "migrate", F.col("emails")).otherwise(none).alias("attendee_emails"), F.transform(F.coalesce("participants", none), lambda s: F.concat(F.lit("[["), s, F.lit("]]"))).alias("participants"), F.coalesce("unmatched", none).alias("unmatched"))


def migrated(text: Column, emails: Column, participants: Column) -> Column:
    """A page's text with the list fields put in after its date, or at the block's end, and attendees out."""
    bare = F.regexp_replace(text, r"(?m)\A((?s:---\n.*?))^attendees:(?:[ \t]*\n(?:(?:[ \t]+\S|[ \t]*-[ \t])[^\n]*\n)*|[^\n]*\n)", "$1")
    literal = F.regexp_replace(F.concat(T.yaml_block("attendee_emails", emails), F.lit("\n"), T.yaml_block("participants", participants)), r"([\\$])", r"\\$1")
    dated = F.regexp_replace(bare, F.lit(r"(?m)\A((?s:---\n(?:(?!---\n).*?\n)??))(date:[^\n]*\n)"), F.concat(F.lit("$1$2"), literal, F.lit("\n")))
    plain = F.regexp_replace(bare, F.lit(r"(?s)\A(---\n.*?\n)---\n"), F.concat(F.lit("$1"), literal, F.lit("\n---\n")))
    return F.when(fm.block(text).isNull(), text).when(fm.block(bare).rlike(r"(?m)^date:"), dated).otherwise(plain)


# --- search, lint, captures --------------------------------------------------------------


def research(notes: DataFrame, question: str | None = None, terms: list[str] | None = None, **caps) -> dict[str, DataFrame]:
    """A question's answer material: hubs (kind, stem, rel, evidence: pages a term names), ranked (capped by
    layer), matched (layer, n: uncapped). notes (rel, stem, source, text, fm). Terms are those
    given or the question's own; a question without usable ones is an error."""
    if not terms:
        one = notes.sparkSession.range(1).select(T.question_terms(F.lit(question or "")).alias("t"))
        terms = one.first()["t"]
    if not terms:
        raise ValueError("no usable search terms")
    hits = notes.filter(S.hits(F.col("text"), terms) > 0)
    layer = S.layer(F.col("rel"))["layer"]
    hub = notes.withColumn("kind", layer).filter("kind in ('synthesis', 'concept', 'entity')")
    slugs = notes.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(T.kebab(F.col("term")).alias("slug"), T.fuzzy_key(F.col("term")).alias("key"))
    named = F.when(F.col("kind") == "entity", F.array_contains(F.lit([r["key"] for r in slugs.collect()]), T.fuzzy_key(F.col("stem")))).otherwise(F.col("stem").isin(*[r["slug"] for r in slugs.collect()]))
    counts = T.first_filled(fm.scalar(F.col("fm"), "evidence_count"), fm.scalar(F.col("fm"), "mention_count"))
    return {
        "hubs": hub.filter(named).select("kind", "stem", "rel", F.coalesce(counts, F.lit("?")).alias("evidence")),
        "ranked": S.search(notes, terms, **caps),
        "matched": hits.groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("n")),
    }


def lint(notes: DataFrame, synthesis: DataFrame, concepts: DataFrame, entities: DataFrame, admin: tuple[str, ...] = (), most_pairs: int = 25) -> dict[str, DataFrame]:
    """The findings of a lint run: work (missing), thin, duplicates, overlaps (the first ``most_pairs``),
    overlaps_total, hollow, counts. synthesis and concepts (slug, evidence_count as text), entities (slug)."""
    work = threads.worklist(notes, synthesis, admin)
    tags = threads.evidence(notes, admin).select(F.lit("thread").alias("kind"), "slug")
    slugs = tags.union(synthesis.select(F.lit("synthesis"), "slug")).union(concepts.select(F.lit("concept"), "slug")).union(entities.select(F.lit("entity"), "slug"))
    pages = synthesis.select(F.lit("synthesis").alias("kind"), "slug", "evidence_count").union(concepts.select(F.lit("concept"), "slug", "evidence_count"))
    found = {"work": work.filter("status = 'missing'"), "thin": work.filter("status = 'thin'"), "duplicates": threads.duplicate_slugs(slugs), "hollow": threads.hollow(pages)}
    counts = threads.overlaps_total(slugs.select("slug")).select(F.lit("overlaps").alias("check"), "n")
    for name, df in found.items():
        counts = counts.unionByName(df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")))
    return found | {"overlaps": threads.first_overlaps(slugs.select("slug"), most_pairs), "counts": counts}


def capture_errors(spec: Column) -> Column:
    """What is wrong with a capture's JSON: missing fields, names that are no kebab case, tags that are
    no list; an empty array for a good one."""
    v = F.try_parse_json(spec)
    get = lambda k: F.trim(F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")))
    missing = [F.when(get(k) == "", F.lit(f"missing required field: {k}")) for k in ("topic", "title", "body", "exchange")]
    odd = [F.when((get(k) != "") & ~get(k).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(f"{k} must be kebab-case")) for k in ("topic", "title")]
    tags = F.try_variant_get(v, "$.tags", "variant")
    listed = F.when(F.coalesce(~F.schema_of_variant(tags).rlike("^(ARRAY|VOID)"), F.lit(False)), F.lit("tags must be a list"))
    whole = F.when(~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), F.array(F.lit("a capture must be a JSON object")))
    return F.coalesce(whole, F.filter(F.array(*missing, *odd, listed), lambda x: x.isNotNull()))


def capture_id(topic: Column, title: Column) -> Column:
    return F.concat(F.lit("distill-"), F.substring(F.sha1(F.concat(topic, F.lit("/"), title)), 1, 10))


def emerge_grouped(records: DataFrame, order: list[str], **law) -> DataFrame:
    """Emergence over units: records (rec, source, tokens, date, title, body) that tell of one event, by the
    ids they share, count once, and for the source of their lead."""
    units = emergence.group_records(records.select("rec", "source", "tokens"), order)
    items = records.join(units, "rec").select("unit", "unit_source", "date", "title", "body")
    return emergence.emerge(items, **law)
