"""Threads: evidence, work lists, change detection, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Sources of work and of the owner alone, and slugs that are never threads.
WORK_SOURCES = ("fireflies", "wispr-meetings", "gemini", "teams", "zoom", "gong", "gmail", "slack", "monday", "github")
SELF_SOURCES = ("claude-history", "wispr")
NOISE_SLUGS = (
    "wrap-up", "wrapup", "follow-up", "followup", "next-steps", "action-items", "catch-up", "check-in", "checkin", "touch-base",
    "kick-off", "stand-up", "standup", "one-on-one", "sync-up", "recap", "to-do", "todo", "misc", "general", "update", "updates",
    "meeting", "notes", "agenda", "debrief",
)


def evidence(notes: DataFrame, admin: tuple[str, ...] = ()) -> DataFrame:
    """notes (rel, source, note_date, text) -> (slug, files, evidence, sources, latest);
    files below an admin prefix list threads and are no evidence."""
    is_admin = F.lit(False)
    for a in admin:
        is_admin |= F.startswith("rel", F.lit(a))
    tags = notes.select("rel", "source", "note_date", is_admin.alias("admin"), F.explode(F.array_distinct(T.extract(F.col("text"), T.THREAD_TAG))).alias("slug"))
    own = ~F.col("admin")
    return tags.groupBy("slug").agg(
        F.countDistinct("rel").alias("files"), F.countDistinct(F.when(own, F.col("rel"))).alias("evidence"),
        F.array_sort(F.collect_set(F.when(own, F.col("source")))).alias("sources"), F.max(F.when(own, F.col("note_date"))).alias("latest"),
    )


def worklist(notes: DataFrame, pages: DataFrame, admin: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Threads without a synthesis page (pages: slug), spellings merged: (slug, evidence, sources,
    latest, status, dup_of, variants). The slug is the longest spelling, then the first; dup_of is
    the first page that shares a token with it."""
    tags = notes.select("rel", "source", "note_date", F.explode(F.array_distinct(T.extract(F.col("text"), T.THREAD_TAG))).alias("slug")).withColumn("key", T.fuzzy_key(F.col("slug")))
    keep = F.lit(True)
    for a in admin:
        keep &= ~F.startswith("rel", F.lit(a))
    got = tags.groupBy("key").agg(
        F.min(F.struct((-F.length("slug")).alias("n"), "slug"))["slug"].alias("slug"), F.array_sort(F.collect_set("slug")).alias("all"),
        F.countDistinct(F.when(keep, F.col("rel"))).alias("evidence"), F.max(F.when(keep, F.col("note_date"))).alias("latest"),
        F.array_sort(F.collect_set(F.when(keep, F.col("source")))).alias("sources"),
    )
    done = pages.select(T.fuzzy_key(F.col("slug")).alias("key")).distinct()
    words = lambda c: F.explode(T.tokens(F.col(c))).alias("token")
    shared = got.select("slug", words("slug")).join(pages.select(F.col("slug").alias("page"), words("slug")), "token").groupBy("slug").agg(F.min("page").alias("dup_of"))
    open_ = got.join(done, "key", "left_anti").join(shared, "slug", "left")
    return open_.select("slug", "evidence", "sources", "latest", "dup_of", F.when(F.col("evidence") >= least, "missing").otherwise("thin").alias("status"), F.array_remove("all", F.col("slug")).alias("variants"))


def top_evidence(items: DataFrame, per_source: int = 5, total: int = 20) -> DataFrame:
    """items (thread, source, date, path): the newest per_source of each source, then the
    newest total of each thread; ties by path. Adds rank."""
    newest = [F.desc("date"), F.asc("path")]
    capped = items.withColumn("__k", F.row_number().over(W.partitionBy("thread", "source").orderBy(*newest))).filter(F.col("__k") <= per_source)
    return capped.withColumn("rank", F.row_number().over(W.partitionBy("thread").orderBy(*newest))).filter(F.col("rank") <= total).drop("__k")


def fingerprints(files: DataFrame) -> DataFrame:
    """files (thread, path, mtime) -> (thread, fingerprint, first, last, n)."""
    line = F.concat_ws(":", "path", F.col("mtime").cast("string"))
    return files.groupBy("thread").agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")), 1, 16).alias("fingerprint"), F.min("mtime").alias("first"), F.max("mtime").alias("last"), F.count(F.lit(1)).alias("n"))


def change_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """current with status: new, changed or current, against stored (thread, fingerprint)."""
    old = stored.select("thread", F.col("fingerprint").alias("__old"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("fingerprint"), "changed").otherwise("current")
    return current.join(old, "thread", "left").withColumn("status", status).drop("__old")


def observe(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    """The ledger (slug, obs_date) with new observations; replays add nothing."""
    return ledger.unionByName(seen).distinct()


def runs(ledger: DataFrame) -> DataFrame:
    return ledger.distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("runs"))


def classify(patterns: DataFrame, work: tuple[str, ...] = WORK_SOURCES) -> DataFrame:
    """patterns (slug, items, source_list, runs) with bucket: auto (two work sources or five
    items, seen in two runs), pending (not yet seen twice), review."""
    meets = (F.size(F.array_intersect("source_list", F.array(*[F.lit(x) for x in work]))) >= 2) | (F.col("items") >= 5)
    return patterns.withColumn("bucket", F.when(meets & (F.col("runs") >= 2), "auto").when(meets, "pending").otherwise("review"))


def guard(slugs: DataFrame, suppress: DataFrame, entities: DataFrame, people: DataFrame, first_names: tuple[str, ...] = ()) -> DataFrame:
    """slugs (slug) with guard: noise, entity, person or null, the first that holds. The
    others are one-column frames of names, compared without marks; people of two words also
    give the name parts that make a two-word slug a person."""
    key = T.squash(F.col("slug"))
    flag = lambda df, name: df.select(T.squash(F.col(df.columns[0])).alias("__k")).distinct().withColumn(name, F.lit(True))
    out = slugs.withColumn("__k", key)
    for df, name in ((suppress, "__s"), (entities, "__e"), (people, "__p")):
        out = out.join(flag(df, name), "__k", "left")
    parts = people.select(F.explode(F.split(F.lower(F.col(people.columns[0])), r"[\s-]+")).alias("part")).distinct()
    a, b = F.split("slug", "-")[0], F.try_element_at(F.split("slug", "-"), F.lit(2))
    out = out.withColumn("__a", a).withColumn("__b", b)
    for c in ("__a", "__b"):
        out = out.join(parts.withColumnRenamed("part", c).withColumn(f"{c}n", F.lit(True)), c, "left")
    two = F.col("slug").rlike("^[a-z]{2,}-[a-z]{2,}$")
    named = F.col("__a").isin(*first_names) | F.col("__b").isin(*first_names) if first_names else F.lit(False)
    noisy = F.col("__s") | F.col("slug").isin(*NOISE_SLUGS) | F.col("__k").isin(*[n.replace("-", "") for n in NOISE_SLUGS]) | (~F.col("slug").contains("-") & (F.length("slug") < 6))
    person = F.col("__p") | (two & (named | (F.col("__an") & F.col("__bn"))))
    label = F.when(noisy, "noise").when(F.col("__e"), "entity").when(person, "person")
    return out.withColumn("guard", label).select(*slugs.columns, "guard")


def rollout(auto: DataFrame, cap: int = 8, order: str = "rank") -> DataFrame:
    """auto (slug, ...) with wave: now for the first cap rows in order, later for the rest. The
    first ones are a top-k of cap rows, which is broadcast."""
    first = auto.orderBy(order, "slug").limit(cap).select("slug", F.lit(True).alias("__now"))
    return auto.join(F.broadcast(first), "slug", "left").withColumn("wave", F.when(F.col("__now"), "now").otherwise("later")).drop("__now")


def activity(mentions: DataFrame, today: str, active_days: int = 7, stalled_days: int = 14, least: int = 2) -> DataFrame:
    """mentions (slug, rel, day) -> (slug, files, latest, state): active with least files in
    the last days; stalled if nothing came for stalled_days; else quiet."""
    day = F.lit(today).cast("date")
    recent = F.col("day") >= F.date_sub(day, active_days)
    got = mentions.groupBy("slug").agg(F.countDistinct(F.when(recent, F.col("rel"))).alias("files"), F.max("day").alias("latest"))
    return got.withColumn("state", F.when(F.col("files") >= least, "active").when(F.col("latest") <= F.date_sub(day, stalled_days), "stalled").otherwise("quiet"))


def duplicate_slugs(slugs: DataFrame) -> DataFrame:
    """slugs (kind, slug) -> (key, variants, n) where several spellings share a key."""
    got = slugs.groupBy(T.fuzzy_key(F.col("slug")).alias("key")).agg(F.array_sort(F.collect_set("slug")).alias("variants"))
    return got.withColumn("n", F.size("variants").cast("long")).filter("n > 1")


def _tokens(slugs: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """(slug, tokens: sorted array): of each key the least spelling."""
    rep = slugs.groupBy(T.fuzzy_key(F.col("slug")).alias("key")).agg(F.min("slug").alias("slug"))
    return rep.select("slug", F.array_sort(F.array_distinct(T.tokens(F.col("slug"), generic))).alias("tokens"))


def token_overlap(slugs: DataFrame, generic: tuple[str, ...] = T.GENERIC_TOKENS) -> DataFrame:
    """slugs (slug) -> (a, b, shared): pairs a < b that share tokens; joined on the tokens,
    so only pairs that share one are made. The answer is all such pairs: a token that n slugs share
    gives n squared / 2 of them. ``token_classes``, ``overlaps_total`` and ``first_overlaps`` tell what they
    hold together without making them."""
    t = _tokens(slugs, generic).select("slug", F.explode("tokens").alias("token"))
    pairs = t.select(F.col("slug").alias("a"), "token").join(t.select(F.col("slug").alias("b"), "token"), "token").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("token")).alias("shared"))


def token_classes(slugs: DataFrame, generic: tuple[str, ...] = T.GENERIC_TOKENS) -> DataFrame:
    """(token, slug, members, links): a row a slug and token that others share; all pairs of a token's members
    overlap, links is their number. It grows with the slugs, not with their pairs."""
    t = _tokens(slugs, generic).select("slug", F.explode("tokens").alias("token"))
    n = t.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return t.join(n, "token").select("token", "slug", "members", F.expr("members * (members - 1) div 2").alias("links"))


def overlaps_total(slugs: DataFrame, generic: tuple[str, ...] = T.GENERIC_TOKENS, most_tokens: int = 14) -> DataFrame:
    """One row (n): how many pairs share a token, by inclusion and exclusion over the sets of tokens that slugs have: a
    set of k tokens that m slugs hold adds or takes m (m - 1) / 2 pairs. Tokens that no other slug has are left out
    first; pairs with a slug of more than ``most_tokens`` others, whose sets are too many, are joined on their tokens."""
    rows = _tokens(slugs, generic)
    shared = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1").select("token")
    t = rows.select("slug", F.explode("tokens").alias("token")).join(shared, "token").groupBy("slug").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    bits = F.expr("sequence(1L, shiftleft(1L, size(tokens)) - 1)")
    picked = F.filter("tokens", lambda x, i: F.call_function("getbit", F.col("mask"), i) == 1)
    sets = t.filter(F.size("tokens") <= most_tokens).select("tokens", F.explode(bits).alias("mask")).select(picked.alias("part"))
    few = sets.groupBy("part").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    signed = F.sum(F.when(F.size("part") % 2 == 1, 1).otherwise(-1) * F.expr("m * (m - 1) div 2"))
    long = t.filter(F.size("tokens") > most_tokens)
    others = t.withColumn("long", F.size("tokens") > most_tokens)
    a = long.select(F.col("slug").alias("a"), F.explode("tokens").alias("token"))
    b = others.select(F.col("slug").alias("b"), "long", F.explode("tokens").alias("token"))
    direct = a.join(b, "token").filter("a < b or (a > b and not long)").select("a", "b").distinct().agg(F.count(F.lit(1)).alias("n"))
    return few.agg(F.coalesce(signed, F.lit(0)).alias("n")).unionByName(direct).agg(F.sum("n").cast("long").alias("n"))


def first_overlaps(slugs: DataFrame, most: int = 25, generic: tuple[str, ...] = T.GENERIC_TOKENS) -> DataFrame:
    """The first ``most`` rows of token_overlap by a and b. Of a token's pairs the first ones are those of its first
    member with the next ones, so ``most`` + 1 members of each token are enough: ranks are bounded before the shuffle."""
    rows = _tokens(slugs, generic)
    t = rows.select("slug", "tokens", F.explode("tokens").alias("token"))
    head = t.withColumn("__k", F.row_number().over(W.partitionBy("token").orderBy("slug"))).filter(F.col("__k") <= most + 1)
    b = head.select(F.col("slug").alias("b"), F.col("tokens").alias("__b"), "token")
    pairs = head.select(F.col("slug").alias("a"), F.col("tokens").alias("__a"), "token").join(b, "token").filter("a < b")
    return pairs.select("a", "b", F.array_intersect("__a", "__b").alias("shared")).distinct().orderBy("a", "b").limit(most)


def hollow(pages: DataFrame) -> DataFrame:
    """pages (kind, slug, evidence_count as text): those with one piece of evidence or less,
    and concepts without a count."""
    n = F.col("evidence_count").try_cast("int")
    return pages.filter((n <= 1) | (n.isNull() & (F.col("kind") == "concept")))
