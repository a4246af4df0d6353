"""Records of meetings, mails and boards: lookups, policies, ids, flattened payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def finished(rows: DataFrame, now: str, seconds: int = 300, mtime: str = "mtime") -> DataFrame:
    """Without files that changed in the last seconds: they are still being written."""
    return rows.filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(mtime) >= seconds)


def transcript_policy(kind: Column, has_content: Column, include: bool, has_segments: Column) -> Column:
    """struct(policy, included): what becomes of a transcript. A file's own is kept; a record with
    content of its own points to it, unless transcripts are asked for; one without has nothing else."""
    included = (
        F.when(kind == "file", has_segments).when(has_content, has_segments & F.lit(include)).otherwise(has_segments)
    )
    policy = F.when(kind == "file", "file").when(has_content & included, "full").when(has_content, "pointer").otherwise("only-content")
    return F.struct(policy.alias("policy"), included.alias("included"))


def names_of(ids: Column, names: Column) -> Column:
    """Ids as display names of a map; an id without one stays."""
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(names, x), x))


def speaker_names(segments: DataFrame, speakers: DataFrame, unknown: str = "Unknown speaker") -> DataFrame:
    """segments (id, speaker_id, ...) with speaker by speakers (id, speaker_id, source, name):
    the name of the best source, consensus before user, mic and llm."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("consensus", "user", "mic", "llm")]), F.col("source"))
    best = speakers.filter("name is not null and name <> ''").groupBy("id", "speaker_id").agg(F.min(F.struct(F.when(rank > 0, rank).otherwise(9), "name"))["name"].alias("speaker"))
    return segments.join(best, ["id", "speaker_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(unknown)))


def route_mail(mails: DataFrame, domains: DataFrame, labels: DataFrame, default: str = "_unrouted", names: DataFrame | None = None) -> DataFrame:
    """mails (id, sender, labels: array of names), domains (domain, route), labels (ordinal,
    label, route) -> (id, route, tier): by the sender's domain, else by the first of the label routes
    that any of the mail's labels has, else default. Labels are equal if their last parts are, in
    any case, so a nested label meets a flat route and the other way round. names (id, name): of
    labels that are ids; one without a name stays."""
    last = lambda c: F.element_at(F.split(F.lower(F.trim(c)), "/"), -1)
    sender = mails.select("id", F.regexp_extract(T.extract_email(F.col("sender")), "@(.*)$", 1).alias("domain"))
    by_domain = sender.join(domains.select(F.lower("domain").alias("domain"), "route"), "domain").select("id", F.struct(F.lit(1).alias("tier"), F.lit(0).alias("ordinal"), "route").alias("hit"))
    named = mails.select("id", F.explode("labels").alias("label"))
    if names is not None:
        named = named.join(names.select(F.col("id").alias("label"), F.col("name").alias("__name")), "label", "left").select("id", F.coalesce("__name", "label").alias("label"))
    named = named.select("id", last(F.col("label")).alias("last"))
    by_label = named.join(labels.select(last(F.col("label")).alias("last"), F.col("ordinal").cast("int").alias("ordinal"), "route"), "last").select("id", F.struct(F.lit(2).alias("tier"), "ordinal", "route").alias("hit"))
    best = by_domain.union(by_label).groupBy("id").agg(F.min("hit").alias("hit"))
    tier = F.when(F.col("hit").isNull(), "unrouted").when(F.col("hit.tier") == 1, "domain").otherwise("label")
    return mails.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("hit.route", F.lit(default)).alias("route"), tier.alias("tier"))


def path_mentions(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """notes (id, rel), entities (entity, folder) -> (id, entity): an entity's folder is one of
    the path's. An equi join on the path's parts, no nested loop."""
    parts = notes.select("id", F.explode(F.array_distinct(F.split(F.lower("rel"), "/"))).alias("part"))
    return parts.join(entities.select("entity", F.lower("folder").alias("part")), "part").select("id", "entity").distinct()


def infer_target(slug: Column, areas: Column, projects: Column) -> Column:
    """area, project or concept: a folder of that name, hyphens apart, in this order."""
    key = T.fuzzy_key(slug)
    has = lambda names: F.exists(names, lambda n: T.fuzzy_key(n) == key)
    return F.when(has(areas), "area").when(has(projects), "project").otherwise("concept")


def pick_body(edited: Column, formatted: Column, raw: Column) -> Column:
    """struct(body, source): the first filled of three."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    source = F.when(filled(edited), "edited").when(filled(formatted), "formatted").when(filled(raw), "asr")
    return F.struct(T.first_filled(edited, formatted, raw).alias("body"), source.alias("source"))


def record_id(title: Column, start: Column, length: int = 10) -> Column:
    """A short stable id of a title and a start."""
    return F.substring(F.sha1(F.concat_ws("|", T.slugify(title), start.cast("string"))), 1, length)


def valid_id(c: Column) -> Column:
    """Safe as a file's name: no separators, no dots at the start."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_][A-Za-z0-9._=+-]*$"), F.lit(False))


def safe_uuid(c: Column) -> Column:
    """Opaque ids with / + = as a file's name."""
    return F.url_encode(c)


def project_slug(c: Column) -> Column:
    """-home-me-proj -> home-me-proj."""
    return F.replace(F.regexp_replace(c, "^-+", ""), F.lit("/"), F.lit("-"))


def project_path(c: Column) -> Column:
    """-home-me-proj -> /home/me/proj."""
    return F.concat(F.lit("/"), F.replace(F.regexp_replace(c, "^-+", ""), F.lit("-"), F.lit("/")))


def column_rows(items: DataFrame, columns: str = "columns", most: int = 200) -> DataFrame:
    """items (id, columns: map) -> (id, name, value): filled columns, values cut to most."""
    rows = items.select("id", F.explode(columns).alias("name", "value"))
    return rows.withColumn("value", T.truncate(F.col("value"), most)).filter("value <> ''")


def call_content(calls: DataFrame) -> DataFrame:
    """calls (id, key_points, highlights, topics: array<struct<name, duration>>, trackers:
    array<struct<name, count>>) -> the texts of a record: points, highlights apart from next
    steps, topics that were talked about, trackers that were hit as "name (n)"."""
    step = lambda x: x.rlike("(?i)next step|action item")
    return calls.select(
        "id", F.filter("key_points", lambda x: F.trim(x) != "").alias("points"),
        F.filter("highlights", lambda x: ~step(x)).alias("highlights"), F.filter("highlights", step).alias("next_steps"),
        F.transform(F.filter("topics", lambda t: t["duration"] > 0), lambda t: t["name"]).alias("topics"),
        F.transform(F.filter("trackers", lambda t: t["count"] > 0), lambda t: F.concat(t["name"], F.lit(" ("), t["count"].cast("string"), F.lit(")"))).alias("trackers"),
    )


def attendees(pairs: Column) -> Column:
    """array<struct<name, email>>: one for each email, or name where there is none; sorted by
    email, blank ones last."""
    key = lambda p: F.when(F.coalesce(p["email"], F.lit("")) != "", F.lower(p["email"])).otherwise(F.concat(F.lit("~"), F.lower(F.coalesce(p["name"], F.lit("")))))
    keyed = F.transform(pairs, lambda p: F.struct(key(p).alias("k"), p["name"].alias("name"), p["email"].alias("email")))
    seen = F.aggregate(keyed, F.slice(keyed, 1, 0), lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.array_append(a, x)))
    return F.transform(F.array_sort(seen), lambda x: F.struct(x["name"].alias("name"), x["email"].alias("email")))


def calendar(local: DataFrame, raw: DataFrame, day: str, zone: str) -> DataFrame:
    """local (event_id, ms, title), raw (event_id, ms, title) -> the day's events in a zone,
    each once, local ones first."""
    both = local.withColumn("__o", F.lit(0)).unionByName(raw.withColumn("__o", F.lit(1)))
    start = F.from_utc_timestamp(F.timestamp_millis("ms"), zone)
    rows = both.withColumn("start", start).filter(F.to_date("start") == F.lit(day).cast("date"))
    return rows.withColumn("__k", F.row_number().over(W.partitionBy("event_id").orderBy("__o"))).filter("__k = 1").select("event_id", "start", "title")


def attention(candidates: DataFrame, least: int = 3) -> DataFrame:
    """candidates (item, level, rank), level 0 the most pressing: all of level 0, and as many of
    the next levels, in order, as make ``least``. A filter and a top-k, no sort of all rows."""
    first = candidates.orderBy("level", "rank", "item").limit(least)
    return candidates.filter("level = 0").unionByName(first.filter("level <> 0"))
