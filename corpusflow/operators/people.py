"""People and entities from attendees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import patterns

#: Local parts that are no person.
ROLES = ("accounting", "billing", "support", "info", "hello", "team", "admin", "office", "sales", "contact", "noreply", "no-reply")


def tier(mentions: Column) -> Column:
    """1 from eight mentions on, 2 from three, else 3."""
    return F.when(mentions >= 8, 1).when(mentions >= 3, 2).otherwise(3)


def extract(attendees: DataFrame) -> DataFrame:
    """attendees (email, date), a row for each mention -> (email, name, slug, domain,
    company, mention_count, last_seen, tier). A person named twice in one note counts twice."""
    local = F.substring_index("email", "@", 1)
    rows = attendees.withColumn("email", T.normalize_email(F.col("email"))).filter("email is not null")
    rows = rows.filter(~local.isin(*ROLES)).groupBy("email").agg(F.count(F.lit(1)).alias("mention_count"), F.max("date").alias("last_seen"))
    rows = rows.withColumn("name", T.derive_name(local)).withColumn("domain", F.regexp_extract("email", "^[^@]*@(.*)$", 1))
    return rows.withColumn("slug", T.person_slug(local)).withColumn("company", T.company_short(F.col("domain"))).withColumn("tier", tier(F.col("mention_count")))


def resolve_collisions(people: DataFrame) -> DataFrame:
    """people with file: the slug with capitals, and the company behind it where several people
    share one."""
    file = T.person_file(F.col("slug"))
    n = F.count(F.lit(1)).over(W.partitionBy(file))
    return people.withColumn("file", F.when(n > 1, F.concat_ws("-", file, F.nullif(F.initcap("company"), F.lit("")))).otherwise(file))


def keep_tier(people: DataFrame, existing: DataFrame) -> DataFrame:
    """Never demote: the better of the old tier and the new one."""
    old = existing.select("email", F.col("tier").alias("old"))
    return people.join(old, "email", "left").withColumn("tier", F.least("tier", F.coalesce("old", "tier"))).drop("old")


def link_participants(messages: DataFrame, people: DataFrame) -> DataFrame:
    """messages (id, addresses: array, sender first) -> (id, participants: array of slugs in
    order of first appearance)."""
    rows = messages.select("id", F.posexplode("addresses").alias("pos", "address")).withColumn("email", T.extract_email(F.col("address")))
    known = rows.join(people.select("email", "slug"), "email").groupBy("id", "slug").agg(F.min("pos").alias("pos"))
    return known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"]).alias("participants"))


def prefix_match(companies: DataFrame, entities: DataFrame, least: int = 4) -> DataFrame:
    """companies (company), entities (entity, key, aliases) -> (company, entity): an alias,
    else an equal key, else one being the other's prefix, both with ``least`` letters or more;
    ties go to the least entity. All are compared by their letters a-z and digits alone.

    The prefix join is an equi join on the first ``least`` letters, not a nested loop."""
    c = companies.select("company", T.fuzzy_key(F.col("company")).alias("ckey")).distinct()
    names = entities.select("entity", T.fuzzy_key(F.col("key")).alias("ekey"), F.lit(2).alias("rank")).union(entities.select("entity", F.explode("aliases"), F.lit(1)).select("entity", T.fuzzy_key(F.col("col")), F.lit(1)))
    long = (F.length("ckey") >= least) & (F.length("ekey") >= least)
    exact = c.join(names, F.col("ckey") == F.col("ekey")).filter((F.col("rank") == 1) | long).select("company", "entity", "rank")
    near = F.startswith("ckey", F.col("ekey")) | F.startswith("ekey", F.col("ckey"))
    prefix = c.join(names.filter("rank = 2"), (F.substring("ckey", 1, least) == F.substring("ekey", 1, least)) & long & near).select("company", "entity", F.lit(3).alias("rank"))
    best = exact.union(prefix).groupBy("company").agg(F.min(F.struct("rank", "entity")).alias("m"))
    return best.select("company", F.col("m.entity").alias("entity"))


def seed_matches(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """texts (id, text), seeds (entity, pattern) -> (id, entity) of the patterns that match. A pattern is tried
    only on texts with one of the literals it requires; one without any, on each text."""
    given = seeds.select("entity", "pattern").withColumn("literals", F.udf(patterns.required, "array<string>")("pattern"))
    return patterns.join(texts, "text", given, F.col("literals"), F.expr("text rlike pattern")).select("id", "entity").distinct()


def entity_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions (meeting, entity, date), any number for each pair -> (entity, mention_count,
    first_seen, last_seen) of known entities; an undated meeting counts without a date."""
    once = mentions.join(entities.select("entity"), "entity", "left_semi").dropDuplicates(["meeting", "entity"])
    found = once.groupBy("entity").agg(F.count(F.lit(1)).alias("mention_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return entities.select("entity").join(found, "entity", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0).cast("long")))


def discover_orgs(people: DataFrame, clients: DataFrame) -> DataFrame:
    """(canonical, people, name): companies of people that match no client, spellings merged."""
    rows = people.filter("email is not null and company is not null").select("company", T.fuzzy_key(F.col("company")).alias("canonical")).filter("canonical <> ''")
    grouped = rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("people"), F.min("company").alias("name"))
    known = prefix_match(grouped.select(F.col("name").alias("company")), clients).select(F.col("company").alias("name"))
    return grouped.join(known, "name", "left_anti").select("canonical", "people", T.title_case_company(F.col("name")).alias("name"))


def contributors(notes: DataFrame, top: int = 10) -> DataFrame:
    """notes (participants: array) -> the people named most often."""
    return notes.select(F.explode("participants").alias("person")).groupBy("person").agg(F.count(F.lit(1)).alias("notes")).orderBy(F.desc("notes"), "person").limit(top)


def entity_index(entities: DataFrame) -> DataFrame:
    """entities (type, name, mention_count) -> (type, names): mentioned ones, by lower-case name."""
    seen = entities.filter("mention_count > 0")
    return seen.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))), lambda x: x["name"]).alias("names"))
