"""Plans of meetings where ids or texts of many records meet."""

from corpusflow.operators import meetings
from corpusflow.plans import capture


def test_records_whose_ids_share_eight_digits(spark):
    """sha1 of both ids begins with the same eight digits; only one of them has a page."""
    rows = spark.sql("select id, 'api' as input, 'Sync' as title, timestamp'2024-01-01 10:00:00' + make_dt_interval(n) as start, 60L as duration, 's' as summary, false as said, '' as notes, 0L as ordinal, '' as emails from values ('m126284', 0), ('m204655', 1) as v(id, n)")
    others = spark.createDataFrame([], "source string, id long, start timestamp")
    known = spark.createDataFrame([("m126284", "old.md", "0")], "id string, file string, hash string")
    plan = meetings.ingest(capture._records(spark, None, rows).drop("ordinal"), others, known)
    got = {r.id: (r.id8, r.action, r.file) for r in plan.collect()}
    digits = got["m126284"][0]
    assert got == {"m126284": (digits, "update", "old.md"), "m204655": (digits, "insert", f"2024-01-02-sync-{digits}.md")}


def test_entries_are_worked_out_once(spark):
    """Neither the records nor their cues read the JSON again; rows without a transcript share no key."""
    plan = capture.meeting_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_get" not in plan and "parse_json" not in plan


def test_entries_of_odd_kinds(spark):
    """Keys that are no texts, people as texts, objects or nothing, a summary as text, and entries in envelopes."""
    said = '{"meeting_start_time": "2024-01-01T10:00:00Z", "uuid": 7, "topic": {"a": 1}, "participants": ["Al", "b@x.example", {"user_name": "Cy", "user_email": "C@x.example"}, null, 3], "summary": "{\\"summary_overview\\": \\"over\\"}"}'
    pages = spark.createDataFrame([(1, f'{{"result": {{"meetings": [{said}]}}}}'), (2, "[1, null, {}]"), (3, "no JSON")], "page long, text string")
    found, bad = meetings.from_entries(meetings.entries(pages))
    (r,) = found.collect()
    assert (r.id, r.title, r.participants, r.emails, r.summary) == ("7", '{"a":1}', ["Al", "Cy", "3"], ["b@x.example", "c@x.example"], "over")
    assert [(b.page, b.pos) for b in bad.collect()] == [(2, 2)]
