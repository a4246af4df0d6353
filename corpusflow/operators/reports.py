"""Pages of records and reports as text: columns of a frame, or one row for a report of some hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import frontmatter, table_row


def lines(*parts: Column | str) -> Column:
    """Parts one below the other; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def listing(df: DataFrame, row: Column, order: list, empty: str) -> DataFrame:
    """(text): a line for each row of a small frame, in order, or what stands for none."""
    keyed = df.select(F.struct(*[F.col(c).alias(f"k{i}") if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"), row.alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda r: r["row"]), "\n")
    return keyed.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty)).alias("text"))


def report(head: dict[str, str], title: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row: frontmatter, a title, and a section for each (heading, frame of one text)."""
    spark = sections[0][1].sparkSession
    parts = None
    for i, (heading, df) in enumerate(sections):
        row = df.select(F.lit(i).alias("i"), F.concat(F.lit(f"## {heading}\n\n"), "text").alias("part"))
        parts = row if parts is None else parts.unionByName(row)
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda r: r["part"]), "\n\n").alias("body"))
    top = spark.range(1).select(frontmatter(**{k: F.lit(v) for k, v in head.items()}).alias("head")).first()["head"]
    return body.select(F.concat(F.lit(f"{top}\n# {title}\n\n"), "body", F.lit("\n")).alias("report"))


def counts_table(counts: DataFrame, name: str = "check") -> DataFrame:
    """(text): a table of (name, n)."""
    rows = listing(counts, table_row(F.col(name), F.col("n")), [name], "| — | 0 |")
    return rows.select(F.concat(F.lit("| Check | Count |\n|---|---|\n"), "text").alias("text"))


def lint_report(found: dict[str, DataFrame], today: str) -> DataFrame:
    """The dashboard of knowledge.lint's findings; what is capped says how many more there are."""
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    dup = F.when(F.col("dup_of").isNotNull(), F.concat(F.lit("possible dup of "), code("dup_of")))
    merged = F.when(F.size("variants") > 0, F.concat(F.lit("merged variants: "), F.array_join("variants", ", ")))
    note = F.concat_ws(" · ", dup, merged)
    table = lambda df, head, row: listing(df, row, [(-F.col("evidence")), "slug"], "").select(F.when(F.col("text") == "", "_none_").otherwise(F.concat(F.lit(head), "text")).alias("text"))
    work = table(found["work"], "| Slug | Evidence | Sources | Note |\n|---|---|---|---|\n", table_row(code("slug"), F.col("evidence"), F.array_join("sources", ", "), note))
    thin = table(found["thin"], "| Slug | Evidence | Note |\n|---|---|---|\n", table_row(code("slug"), F.col("evidence"), F.coalesce(dup, F.lit(""))))
    pairs = listing(found["overlaps"], F.concat(F.lit("- "), code("a"), F.lit(" ~ "), code("b"), F.lit("  (shared: "), F.array_join("shared", ", "), F.lit(")")), ["a", "b"], "_none_")
    more = found["counts"].filter("check = 'overlaps'").select(F.col("n").alias("total"))
    shown = found["overlaps"].agg(F.count(F.lit(1)).alias("shown"))
    pairs = pairs.withColumn("j", F.lit(1)).join(more.withColumn("j", F.lit(1)), "j").join(shown.withColumn("j", F.lit(1)), "j")  # one row each
    pairs = pairs.select(F.concat("text", F.when(F.col("total") > F.col("shown"), F.concat(F.lit("\n- _… and "), (F.col("total") - F.col("shown")).cast("string"), F.lit(" more_"))).otherwise(F.lit(""))).alias("text"))
    groups = listing(found["duplicates"], F.concat(F.lit("- "), F.array_join("variants", " / ")), ["key"], "_none_")
    hollow = listing(found["hollow"], F.concat(F.lit("- "), code("slug"), F.lit(" ("), F.coalesce("evidence_count", F.lit("none")), F.lit(")")), ["slug"], "_none_")
    head = {"type": "dashboard-wiki-lint", "generated_by": "lint", "generated_at": today}
    return report(head, f"Wiki Lint — {today}", [("Summary", counts_table(found["counts"])), ("Synthesis work-list", work), ("Tagged but too thin", thin), ("Duplicate slugs", groups), ("Possible duplicate topics", pairs), ("Hollow pages", hollow)])


def review_queue(auto: DataFrame, deferred: DataFrame, pending: DataFrame, review: DataFrame, filtered: DataFrame, today: str, mode: str) -> DataFrame:
    """The queue of promotions: auto and deferred (slug), pending (slug, source_list), review (slug, items,
    source_list, first, latest, target), filtered (slug, guard)."""
    code = F.concat(F.lit("`"), "slug", F.lit("`"))
    where = {"person": "add to CRM instead", "entity": "link to existing entity"}
    advice = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in where.items() for x in kv]), F.col("guard")), F.lit("procedural noise"))
    rows = listing(review, table_row(code, F.array_join("source_list", ", "), F.col("items"), F.concat_ws(" → ", "first", "latest"), F.col("target")), [(-F.col("items")), "slug"], "")
    table = rows.select(F.when(F.col("text") == "", "_Queue empty — nothing awaiting your call._").otherwise(F.concat(F.lit("| Slug | Sources | Items | Span | Suggested |\n|---|---|---|---|---|\n"), "text")).alias("text"))
    head = {"type": "dashboard-thread-review-queue", "generated_at": today, "mode": mode}
    return report(head, "Thread Review Queue", [
        ("Auto-graduated this run", listing(auto, F.concat(F.lit("- "), code), ["slug"], "- _(none this run)_")), ("Deferred by per-run cap", listing(deferred, F.concat(F.lit("- "), code), ["slug"], "- _(none)_")),
        ("Pending", listing(pending, F.concat(F.lit("- "), code, F.lit(" · sources: "), F.array_join("source_list", ", ")), ["slug"], "- _(none)_")), ("Awaiting your call", table),
        ("Filtered by guards", listing(filtered, F.concat(F.lit("- "), code, F.lit(" — **"), "guard", F.lit("** ("), advice, F.lit(")")), ["slug"], "- _(none)_")),
    ])


def last_run(title: str, counts: DataFrame, name: str = "action") -> DataFrame:
    """One row: the counters of a run as a list."""
    return listing(counts, F.concat(F.lit("- "), name, F.lit(": "), F.col("n").cast("string")), [name], "- nothing: 0").select(F.concat(F.lit(f"# {title} — last run\n\n"), "text", F.lit("\n")).alias("report"))


def session_page(project: Column, path: Column) -> Column:
    """A session's page, of the columns of segments.sessions with started and ended as text."""
    files = F.when(F.size("files") > 0, F.concat(F.lit("- `"), F.array_join("files", "`\n- `"), F.lit("`"))).otherwise(F.lit("_(none)_"))
    head = F.concat(
        frontmatter(type=F.lit("raw-session"), session_id=F.col("session"), project=project, project_path=path, started=F.col("started"), ended=F.col("ended"), duration_minutes=F.col("minutes"), turn_count=F.col("turns")),
    )
    title = F.concat(F.lit("# "), project, F.lit(" · "), F.coalesce(F.replace(F.substring("started", 1, 16), F.lit("T"), F.lit(" ")), F.lit("unknown")), F.lit(" session"))
    quote = lambda c: F.concat(F.lit("> "), F.col(c))
    return lines(head, title, "", "## First prompt", "", quote("first_prompt"), "", "## Last assistant turn", "", quote("last_answer"), "", "## Files touched", "", files, "")


def capture_record(capture: Column, day: Column, topic: Column, title: Column, exchange: Column, session: Column) -> Column:
    """The source record of a capture: what was said, secrets replaced."""
    head = frontmatter(date=day, id=capture, type=F.lit("raw-distill"), resource_note=F.concat(F.lit("[["), title, F.lit("]]")), source_session=F.coalesce(session, F.lit("null")), topic=topic)
    return lines(head, F.concat(F.lit("# Distill capture · "), title), "", "## Exchange (redacted)", "", T.redact(F.regexp_replace(exchange, r"\s+$", ""))["text"], "")


def resource_note(capture: Column, day: Column, topic: Column, title: Column, body: Column, kept: Column, start: str, end: str) -> Column:
    """The note of a capture with an editable region, whose old content is kept."""
    head = frontmatter(date=day, id=capture, type=F.lit("distilled-resource"), source_capture_id=F.concat(F.lit("[["), capture, F.lit("]]")), topic=topic)
    return lines(head, F.concat(F.lit("# "), T.title_case(title)), "", T.redact(F.regexp_replace(body, r"\s+$", ""))["text"], "", "## Notes", "", start, F.coalesce(kept, F.lit("")), end, "")


def person_page(dossier: str) -> Column:
    """A new person's page, of the columns of knowledge.people_plan; a dossier only for the first tier."""
    head = frontmatter(type=F.lit("person"), name=F.col("name"), email=F.col("email"), company=F.col("company"), domain=F.col("domain"), tier=F.col("new_tier"), mention_count=F.col("mention_count"), last_seen=F.col("last_seen").cast("string"))
    return lines(head, F.concat(F.lit("# "), F.replace("file", F.lit("-"), F.lit(" "))), "", F.when(F.col("new_tier") == 1, F.lit(dossier)), "## Bio", "", "## Open Threads", "-", "", "## Notes", "")


def entity_page(start: str, end: str, default: str = "- (none yet)") -> Column:
    """An entity's page, of (name, type, canonical_id, description, first_seen, last_seen, mention_count, kept)."""
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    head = frontmatter(type=F.lit("wiki-entity"), entity_name=F.col("name"), entity_type=F.col("type"), canonical_id=F.col("canonical_id"), first_mention=day("first_seen"), last_mention=day("last_seen"), mention_count=F.col("mention_count"))
    return lines(head, F.concat(F.lit("# "), "name"), "", F.concat(F.lit("*"), "description", F.lit("*")), "", "## Related", "", start, F.coalesce("kept", F.lit(default)), end, "")
