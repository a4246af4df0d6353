"""Pages of captures by forms: which fields, facts and sections a page of a kind has, in which order.

A form is data; ``page`` makes a column of it, over rows whose columns have the names of the form's fields. Columns that
rows lack are left out with their line, so one form serves records of an interface and of files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .captures import filled


@dataclass(frozen=True)
class Form:
    kind: str
    fields: tuple[str, ...]  # "key", or "key:style" with style text, list or flag
    facts: tuple[tuple[str, str], ...]  # (label, column) of the lines below the title
    sections: tuple[tuple[str, str, str], ...]  # (heading, column, style: text, bullets, tasks)
    silence: str = "_(transcript file had no speech)_"


_SAID = ("transcript_available:flag", "transcript_included:flag", "transcript_policy", "transcript_segments")
# The keys of each kind of page and their order, labels and headings.
FORMS = {
    "zoom": Form(
        "raw-zoom-meeting",
        ("zoom_id", "zoom_meeting_number", "title:text", "date", "timestamp", "timestamp_local:text", "date_source", "input", "source_file:text", "source_hash", "duration:text", "host_email", "attendee_emails:list", "participants:list", "has_summary:flag", "next_steps", "summary_doc_url", "recording_url", *_SAID),
        (("Duration", "duration"), ("Participants", "participants"), ("Attendees", "attendee_emails"), ("Source", "source_line")),
        (("Summary", "summary", "text"), ("Next steps", "steps", "tasks"), ("Notes", "notes", "text")),
    ),
    "teams": Form(
        "raw-teams-meeting",
        ("teams_meeting_id", "title:text", "date", "timestamp", "date_source", "source_file:text", "source_hash", "duration:text", "participants:list", "transcript_segments", "has_notes:flag"),
        (("Duration", "duration"), ("Speakers", "participants"), ("Source", "source_line")),
        (("Notes", "notes", "text"),),
    ),
    "gemini": Form(
        "raw-gemini-meeting",
        ("gemini_doc_id", "title:text", "date", "timestamp", "timestamp_local:text", "source_modified_at", "doc_url", "duration:text", "attendee_emails:list", "participants:list", "has_quick_notes:flag", "has_decisions:flag", "next_steps", "transcript_available:flag", "transcript_included:flag", "transcript_segments"),
        (("Duration", "duration"), ("Participants", "participants"), ("Attendees", "attendee_emails"), ("Source", "source_line")),
        (("Quick notes", "quick_notes", "text"), ("Summary", "summary", "text"), ("Decisions", "decisions", "text"), ("Next steps", "steps", "tasks"), ("Details", "details", "text")),
    ),
    "gong": Form(
        "raw-gong-call",
        ("gong_call_id", "title:text", "date", "timestamp", "timestamp_local:text", "date_source", "input", "source_file:text", "source_hash", "call_url", "duration:text", "direction", "scope", "system", "is_private:flag", "attendee_emails:list", "participants:list", "external_domains:list", "topics:list", "trackers:list", "call_outcome:text", "crm_accounts:list", "has_brief:flag", "next_steps", *_SAID),
        (("Duration", "duration"), ("Internal", "internal"), ("External", "external"), ("Speakers", "speakers"), ("Attendees", "attendee_emails"), ("Topics", "topics"), ("Outcome", "call_outcome"), ("Source", "source_line")),
        (("Brief", "brief", "text"), ("Key points", "points", "bullets"), ("Next steps", "steps", "tasks"), ("Highlights", "highlights_text", "text"), ("Outline", "outline_text", "text"), ("Notes", "notes", "text")),
    ),
    "wispr": Form(
        "raw-wispr-meeting",
        ("wispr_meeting_id", "title:text", "date", "timestamp", "source_modified_at", "duration:text", "participants:list", "speakers_resolved:list", "transcript_source", "transcript_segments", "refine_status:text", "has_notes:flag", "calendar_event_id:text", "audio_path:text"),
        (("Duration", "duration"), ("Participants", "participants"), ("Source", "source_line")),
        (("Summary", "summary", "text"), ("Notes", "notes", "text")),
    ),
}
# The key of a linked record's id, and the source's name.
LINKS = {"fireflies": ("fireflies_id", "Fireflies"), "wispr": ("wispr_meeting_id", "Wispr"), "gemini": ("gemini_doc_id", "Gemini"), "teams": ("teams_meeting_id", "Teams"), "zoom": ("zoom_id", "Zoom")}
UNDATED = "> Start time unknown: neither name nor content carried a date, so the date is the file's and cross-linking was skipped."


def _value(c: Column, style: str) -> Column:
    if style == "text":
        return T.yaml_quoted(c.cast("string"))
    if style == "list":
        return T.yaml_inline_list(F.coalesce(c, F.array().cast("array<string>")))
    if style == "flag":
        return F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")
    return F.coalesce(c.cast("string"), F.lit(""))


def page(rows: DataFrame, form: Form | str) -> Column:
    """The page of each row. Besides the form's columns: links (map of source -> struct<id, note>), transcript (text; empty or
    null: ``pointer``, where to find it, or a line that nothing was said), ingested_at. Title, date and lists may be null."""
    form = FORMS[form] if isinstance(form, str) else form
    kinds = dict(rows.dtypes)
    has = lambda c: c in kinds
    lines = [F.lit(f"type: {form.kind}")]
    for f in form.fields:
        key, _, style = f.partition(":")
        if has(key):
            line = F.concat(F.lit(f"{key}: "), _value(F.col(key), style))
            lines.append(F.when(filled(F.col(key)), line) if key == "source_file" else line)
    notes = []
    if has("links"):
        for source, (key, label) in LINKS.items():
            link = F.try_element_at("links", F.lit(source))
            lines += [F.when(link.isNotNull(), F.concat(F.lit(f"{key}: "), link["id"])), F.when(filled(link["note"]), F.concat(F.lit(f"{source}_note: "), T.yaml_quoted(link["note"])))]
            notes.append(F.when(filled(link["note"]), F.concat(F.lit(f"> Also captured by {label}: "), link["note"])))
    if has("ingested_at"):
        lines.append(F.concat(F.lit("ingested_at: "), F.col("ingested_at").cast("string")))
    text = lambda c: F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
    facts = [F.when(filled(text(c)), F.concat(F.lit(f"**{label}:** "), text(c))) for label, c in form.facts if has(c)]
    parts = [F.concat(F.lit("# "), F.concat_ws(" — ", F.nullif(F.col("date").cast("string"), F.lit("")), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("(untitled)"))))]
    parts.append(F.nullif(F.concat_ws("  \n", *facts), F.lit("")))
    parts += notes
    if has("date_source"):
        parts.append(F.when(F.col("date_source") == "file-mtime", UNDATED))
    for heading, c, style in form.sections:
        if has(c):
            mark = {"bullets": "- ", "tasks": "- [ ] "}.get(style)
            body = F.when(F.size(c) > 0, F.concat(F.lit(mark), F.array_join(c, "\n" + mark))) if mark else F.nullif(F.trim(c), F.lit(""))
            parts.append(F.concat(F.lit(f"## {heading}\n\n"), body))
    if has("transcript"):
        pointer = F.nullif(F.col("pointer"), F.lit("")) if has("pointer") else F.lit(None).cast("string")
        parts.append(F.concat(F.lit("## Transcript\n\n"), F.coalesce(F.nullif(F.trim("transcript"), F.lit("")), pointer, F.lit(form.silence))))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.concat_ws("\n\n", *parts), F.lit("\n"))


#: What stands for a memo's words where there are none.
NO_WORDS = "_(no transcript — recorded audio only; it can be added in a later run that retries stubs)_"


def memo_page(memo: DataFrame) -> Column:
    """memo (id, title, date, seconds, audio_path, source, transcript, ingested_at), as memo_states gives source and transcript,
    -> its page: the date, then the other keys in the order of the alphabet; secrets in the words are struck out. A
    deferred memo has none (null)."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("(untitled memo)"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = {"date": empty("date"), "audio_path": empty("audio_path"), "duration_seconds": F.coalesce(F.round("seconds").cast("long").cast("string"), F.lit("null")), "ingested_at": empty("ingested_at"), "memo_id": empty("id"), "title": title, "transcript_source": empty("source"), "type": F.lit("raw-voice-memo")}
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in keys.items()]), F.lit("\n---\n\n# "))
    words = F.coalesce(F.nullif(T.redact(F.coalesce("transcript", F.lit("")))["text"], F.lit("")), F.lit(NO_WORDS))
    whole = F.concat(head, F.concat_ws(" — ", title, F.nullif(empty("date"), F.lit(""))), F.lit("\n\n"), words, F.lit("\n"))
    return F.when(F.col("source") != "deferred", whole)
