"""Pages of meetings and memos, whole."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import forms


def test_call_page(spark):
    rows = spark.sql("""select '77' as gong_call_id, 'Plan "A": go' as title, date'2024-03-04' as date, 'file-mtime' as date_source, 'call.vtt' as source_file, '1h 00m' as duration, true as is_private,
        array('a@x.example', 'b: c') as attendee_emails, array('Ada') as participants, array('Ada') as internal, cast(array() as array<string>) as external, array('Price') as topics, '' as call_outcome, 2 as next_steps,
        'Short.' as brief, array('p1', 'p2') as points, array('do it') as steps, ' ' as notes, map('zoom', named_struct('id', 'z9', 'note', '[[Z note]]'), 'teams', named_struct('id', 't1', 'note', '')) as links, '' as transcript, 'Not kept here.' as pointer, '2024-03-05' as ingested_at""")
    assert rows.select(forms.page(rows, "gong")).first()[0] == (
        '---\ntype: raw-gong-call\ngong_call_id: 77\ntitle: "Plan \\"A\\": go"\ndate: 2024-03-04\ndate_source: file-mtime\nsource_file: "call.vtt"\nduration: "1h 00m"\nis_private: true\n'
        'attendee_emails: ["a@x.example", "b: c"]\nparticipants: [Ada]\ntopics: [Price]\ncall_outcome: ""\nnext_steps: 2\nteams_meeting_id: t1\nzoom_id: z9\nzoom_note: "[[Z note]]"\ningested_at: 2024-03-05\n---\n\n'
        '# 2024-03-04 — Plan "A": go\n\n**Duration:** 1h 00m  \n**Internal:** Ada  \n**Attendees:** a@x.example, b: c  \n**Topics:** Price\n\n> Also captured by Zoom: [[Z note]]\n\n' + forms.UNDATED + "\n\n"
        "## Brief\n\nShort.\n\n## Key points\n\n- p1\n- p2\n\n## Next steps\n\n- [ ] do it\n\n## Transcript\n\nNot kept here.\n"
    )


@pytest.mark.parametrize("name", sorted(forms.FORMS))
def test_rows_of_nulls(spark, name):
    form = forms.FORMS[name]
    kinds = {"list": "array<string>", "flag": "boolean", "bullets": "array<string>", "tasks": "array<string>"}
    columns = {f.partition(":")[0]: kinds.get(f.partition(":")[2], "string") for f in form.fields} | {c: kinds.get(style, "string") for _, c, style in form.sections} | {"transcript": "string", "date": "string", "title": "string"}
    rows = spark.range(1).select(*[F.lit(None).cast(k).alias(c) for c, k in columns.items()])
    text = rows.select(forms.page(rows, name)).first()[0]
    assert text.startswith(f"---\ntype: {form.kind}\n") and "# (untitled)\n\n## Transcript\n\n" + form.silence in text
    assert [line.split(":")[0] for line in text.split("---")[1].strip().split("\n")] == ["type", *[f.partition(":")[0] for f in form.fields if not f.startswith("source_file")]]


def test_memo_page(spark):
    rows = spark.createDataFrame([("m1", " Idea ", "2024-01-02", 61.6, "/a.m4a", "native", "words password: hunter2"), ("m2", None, None, None, None, "none", None), ("m3", "x", None, None, None, "deferred", None)], "id string, title string, date string, seconds double, audio_path string, source string, transcript string").withColumn("ingested_at", F.lit("now"))
    one, two, three = [r[0] for r in rows.select(forms.memo_page(rows)).collect()]
    assert one == "---\ndate: 2024-01-02\naudio_path: /a.m4a\nduration_seconds: 62\ningested_at: now\nmemo_id: m1\ntitle: Idea\ntranscript_source: native\ntype: raw-voice-memo\n---\n\n# Idea — 2024-01-02\n\nwords password=REDACTED\n"
    assert two == f"---\ndate: \naudio_path: \nduration_seconds: null\ningested_at: now\nmemo_id: m2\ntitle: (untitled memo)\ntranscript_source: none\ntype: raw-voice-memo\n---\n\n# (untitled memo)\n\n{forms.NO_WORDS}\n" and three is None
