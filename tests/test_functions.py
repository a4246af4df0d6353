"""Functions, parsers, readers and policies on small inputs."""

import datetime as dt
import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions import times as D
from corpusflow.operators import audit, emergence, matching, merge, pages, people, search, segments, threads
from corpusflow.sources import frontmatter as fm
from corpusflow.sources import html, notes, payloads, readers, transcripts
from corpusflow.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.kebab, "  Foo_Bar  Baz!! ", "foo-bar-baz"), (T.fuzzy_key, "Foo-Bar 1", "foobar1"), (T.squash, "Foo-Bar_é x", "foobaréx"), (T.slugify, "Über Foo:  bar - baz", "über-foo-bar-baz"),
        (T.plain_slug, "A  b--c!", "a-b--c"), (T.title_case, "my-slug", "My Slug"), (T.title_case_company, "acme", "Acme"), (T.title_case_company, "ACMe", "ACMe"),
        (T.extract_email, 'Ada <ADA@x.example>', "ada@x.example"), (T.extract_email, "hi bob@y.example there", "bob@y.example"), (T.normalize_email, " A@B.c ", "a@b.c"), (T.normalize_email, "nobody", None),
        (T.derive_name, "jane.doe42", "Jane Doe"), (T.company_short, "mail.acme.io", "acme"), (T.company_short, "a.co.uk", "co"), (T.person_slug, "jane_o'doe7", "jane-odoe"), (T.person_file, "jane-odoe", "Jane-Odoe"), (T.derive_name, "42", "42"),
        (T.clean_title, "2024-01-02 - Sync (1h 15m)", "Sync"), (lambda c: T.truncate(c, 5), "abc\ndefg", "abc …"), (lambda c: T.excerpt(c, 8), "# T\nhello   world", "hello wo…"),
        (T.yaml_str, "a: b", '"a: b"'), (T.yaml_str, "plain", "plain"), (T.yaml_str, "true", '"true"'), (lambda c: T.redact(c)["text"], "api_key = abc Bearer " + "x" * 30, "api_key=REDACTED Bearer REDACTED"),
        (lambda c: T.section(c, "Summary"), "## Summary\nx\ny\n## Next\nz", "x\ny"), (lambda c: T.section(c, "Summary", True), "## Summary\nx", ""),
        (lambda c: T.replace_section(c, "A", F.lit("n$1")), "## A\nold\n## B\nb", "## A\n\nn$1\n\n## B\nb"), (T.demote_headings, "# a\n```\n# b\n```\n## c", "## a\n```\n# b\n```\n### c"),
        (lambda c: F.array_join(T.question_terms(c), ","), "What's the Acme-Roadmap status, and why Acme?", "what's,acme-roadmap,acme"), (lambda c: F.array_join(T.tokens(c), ","), "the-ledger-in-line", "ledger,line"),
        (lambda c: F.array_join(T.candidates(c), ","), "#Topic/x #thread/y [[My Note|n]] [[2024-01-01]] Foo Bar and some-token", "topic-x,my-note,foo-bar,some-token"),
        (D.clock_seconds, "1:02:03", 3723), (D.iso_utc, "2024-01-01T10:00:00.5+02:00", dt.datetime(2024, 1, 1, 8)), (D.without_offset, "2024-01-01T10:00:00.123Z", "2024-01-01 10:00:00"),
        (D.meeting_date, "2024-03-04 09:30", dt.datetime(2024, 3, 4, 9, 30)), (D.apple_date, "Friday, March 1, 2024 at 10:00:00", dt.datetime(2024, 3, 1, 10)), (lambda c: D.offset_minutes(c, F.lit("2024-07-01 12:00:00").cast("timestamp"), "America/Chicago"), "nst", -210), (lambda c: D.offset_minutes(c, F.lit("2024-07-01 12:00:00").cast("timestamp"), "America/Chicago"), "XYZ", -300),
        (html.strip, "<p>a&amp;b<script>x</script> <b>c</b></p>", "a&b c"), (payloads.base64url, "aGk_", "hi?"),
    ],
)
def test_scalar(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("minutes", "want"), [(75, "1h 15m"), (60, "1h 00m"), (5, "5m"), (0, "")])
def test_duration(spark, minutes, want):
    assert one(spark, minutes, D.duration, "long") == want


def test_frontmatter(spark):
    text = "---\ntitle: 'A: b'\ntags: [x, \"y\"]\n# no\nempty:\nlist:\n- one\n  - two\nlast: v\ntitle: B\n---\n# H\nbody"
    got = one(spark, text, fm.parse)
    assert got == {"tags": ["x", "y"], "empty": [], "list": ["one", "two"], "last": ["v"], "title": ["B"]}
    assert one(spark, "no block", fm.parse) == {} and one(spark, "---\na: b\n---", fm.parse) == {} and one(spark, None, fm.parse) == {}
    assert one(spark, "---\na: b\n---", lambda c: fm.parse(c, "loose")) == {"a": ["b"]}
    assert one(spark, "---\n- k: v\nurl: 'http://x'\n---\n", lambda c: fm.parse(c, "flat")) == {"- k": ["v"], "url": ["http://x"]}
    assert one(spark, 'x: "1"\nbody\nx: 2', lambda c: fm.probe(c, ["x", "y"])) == {"x": "2"}
    assert one(spark, "---\na: b\n---\nt", lambda c: fm.set_scalar(c, "a", F.lit("$z"))) == "---\na: $z\n---\nt"
    assert one(spark, "---\na: b\n---\nt", lambda c: fm.set_scalar(c, "c", F.lit("d"))) == "---\na: b\nc: d\n---\nt"
    for before, after in (
        ("---\ntags: [a]\n---\n", "---\ntags: [a, t]\n---\n"), ("---\ntags:\n- a\n---\n", "---\ntags:\n- t\n- a\n---\n"), ("---\ntags: a\n---\n", "---\ntags: [a, t]\n---\n"),
        ("---\nx: 1\n---\n", "---\nx: 1\ntags: [t]\n---\n"), ("plain", "---\ntags: [t]\n---\n\nplain"), ("---\ntags: [t]\n---\n", "---\ntags: [t]\n---\n"), ("---\ntags: []\n---\n", "---\ntags: [t]\n---\n"),
    ):
        assert one(spark, before, lambda c: fm.add_tag(c, "t")) == after


def test_scan(spark, tmp_path):
    for name, text in {"raw/gmail/a b.md": "---\ndate: 2024-01-02T03\n---\n# T\nx", "README.md": "r", ".hidden.md": "h", ".git/c.md": "c", "raw/wispr/meetings/m.md": "m", "20 - P/n.md": "[[a b#s|x]]"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = notes.scan(spark, str(tmp_path))
    rows = {r.rel: r for r in found.select("rel", "stem", "title", notes.source_of(F.col("rel")).alias("source"), notes.note_date(F.col("fm"), F.col("mtime")).alias("day")).collect()}
    assert set(rows) == {"raw/gmail/a b.md", "raw/wispr/meetings/m.md", "20 - P/n.md"}
    assert rows["raw/gmail/a b.md"].title == "T" and rows["raw/gmail/a b.md"].day == dt.date(2024, 1, 2) and rows["raw/wispr/meetings/m.md"].source == "wispr-meetings"
    assert [tuple(r) for r in notes.links(found).collect()] == [("n", "a b")] and notes.in_folders(found, ["20 - P"]).count() == 1


def test_records_of_one_call_are_one_unit(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [("a", "fireflies", ["fireflies:1"]), ("b", "zoom", ["zoom:9", "fireflies:1"]), ("c", "gong", ["gong:5", "zoom:9"]), ("d", "slack", ["d"]), ("e", "teams", ["zoom:7"]), ("f", "gemini", ["zoom:7"])]
    got = {r.rec: (r.unit, r.unit_source) for r in emergence.group_records(spark.createDataFrame(rows, "rec string, source string, tokens array<string>"), ["fireflies", "gemini", "teams", "zoom", "gong"]).collect()}
    assert got == {"a": ("a", "fireflies"), "b": ("a", "fireflies"), "c": ("a", "fireflies"), "d": ("d", "slack"), "e": ("f", "gemini"), "f": ("f", "gemini")}


def test_nearest_within(spark):
    rows = [(1, "12:00")]
    others = [("x", 10, "11:57"), ("x", 11, "12:30"), ("x", 12, "12:03"), ("y", 20, "12:10"), ("z", 30, "12:11")]
    at = lambda t: dt.datetime(2024, 1, 1, *map(int, t.split(":")))
    left = spark.createDataFrame([(i, at(t)) for i, t in rows] + [(2, None)], "id long, start timestamp")
    right = spark.createDataFrame([(s, i, at(t)) for s, i, t in others], "source string, id long, start timestamp")
    assert {(r.id, r.source, r.match) for r in matching.nearest_within(left, right, 600).collect()} == {(1, "x", 10), (1, "y", 20)}


def test_greedy_pairs(spark):
    import random

    r = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    left, right = ([(i, base + dt.timedelta(seconds=r.randint(0, 40000))) for i in range(n)] for n in (150, 120))
    used, want = set(), set()
    for i, t in left:
        near = sorted((abs((u - t).total_seconds()), j) for j, u in right if j not in used and abs((u - t).total_seconds()) <= 120)
        if near:
            used.add(near[0][1])
            want.add((i, near[0][1]))
    a = spark.createDataFrame([(i, t, i) for i, t in left], "id long, start timestamp, ordinal long")
    assert {tuple(x) for x in matching.greedy_pairs(a, spark.createDataFrame(right, "id long, start timestamp"), 120).collect()} == want


def test_transcripts(spark):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:04.000\nAda Vale: hello\nthere\n\n00:00:05.000 --> 00:01:09.500\n<v Bo>one <i>two</i></v>\n<v Cy>three</v>\n\n2\n00:02:00.000 --> 00:02:01.000\njust words\n"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [(r.pos, r.start, r.speaker, r.text) for r in transcripts.vtt(df).orderBy("pos").collect()] == [(0, 1, "Ada Vale", "hello there"), (1, 5, "Bo", "one two"), (2, 5, "Cy", "three"), (3, 120, "Unknown speaker", "just words")]
    assert transcripts.vtt_duration(df).first().seconds == 121
    chat = "=== Message from Ada (U1) at 10 ===\nMessage TS: 1.1\nhi\n\n=== Message at 11 ===\nMessage TS: 1.2\n<@U0A|Bo Vale> yo\n=== Message at 12 ===\nMessage TS: 1.3\nplain\n"
    got = transcripts.chat(spark.createDataFrame([(1, chat)], "id long, text string")).orderBy("pos").collect()
    assert [(r.ts, r.sender_id, r.sender, r.text) for r in got] == [("1.1", "U1", "Ada", "hi"), ("1.2", "U0A", "Bo Vale", "<@U0A|Bo Vale> yo"), ("1.3", "", "unknown", "plain")]
    got = transcripts.turns(spark.createDataFrame([(1, "[0:05] Ada: hi\nmore\nBo (1:02): yo"), (2, "no turns here")], "id long, text string")).orderBy("id", "turn").collect()
    assert [(r.id, r.start, r.speaker, r.text) for r in got] == [(1, 5, "Ada", "hi more"), (1, 62, "Bo", "yo"), (2, None, "Unknown speaker", "no turns here")]
    got = transcripts.tabs(spark.createDataFrame([(1, "pre\n# A\nx\u000by\n# B\n")], "id long, text string")).orderBy("tab").collect()
    assert [(r.title, r.body) for r in got] == [(None, "pre"), ("A", "x\ny"), ("B", "")]


def test_html_markdown():
    assert html.to_markdown("<h1>T</h1><p>a <b>bold</b> <a href='u'>link</a></p><ul><li>x<ol><li>y</li></ol></li></ul><script>no</script>") == "# T\na **bold** [link](u)\n- x\n    1. y"
    assert html.to_markdown('<ul class="checklist"><li class="checked">a</li><li class="unchecked">b</li><li>c</li></ul><div><br></div><div>d</div>') == "- [x] a\n- [ ] b\n- c\n\nd" and html.to_markdown(None) is None


def test_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"result": json.dumps({"items": [{"id": 1, "name": ""}, {"id": 2, "title": "t"}]})}))
    (tmp_path / "b.json").write_text("{not json")
    got = payloads.json_files(spark, str(tmp_path))
    assert got.filter("error is not null").count() == 1
    text = spark.read.text(str(tmp_path / "a.json"), wholetext=True)
    rows = payloads.records(text.select(payloads.unwrap(F.col("value")).alias("value")), "$.items")
    assert [r[0] for r in rows.select(payloads.first_of(F.col("record"), ["$.name", "$.title"])).collect()] == [None, "t"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.jsonl").write_text("\n".join([json.dumps({"type": "user", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}), "bad", json.dumps({"type": "tool_use", "name": "Edit", "input": {"file_path": "/f"}}), json.dumps({"type": "tool_use", "name": "Bash", "input": {"path": "/g"}}), json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:10:59Z", "message": {"content": [{"type": "text", "text": "done"}, "x", {"type": "other"}]}})]))
    r = segments.sessions(payloads.session_lines(spark, str(tmp_path / "s"))).first()
    assert (r.session, r.turns, r.minutes, r.first_prompt, r.last_answer, r["files"]) == ("x", 2, 10, "hello", "done x", ["/f"])
    assert payloads.windows("2024-01-01", "2024-02-15") == [("2024-01-01", "2024-01-30"), ("2024-01-31", "2024-02-15")]
    at = lambda s: one(spark, s, lambda c: payloads.name_date(c, F.lit("2020-01-01").cast("timestamp")))
    assert at("GMT20240102-030405_x.mp4").start == dt.datetime(2024, 1, 2, 3, 4, 5) and at("call 2024-05-06.txt").date_source == "day" and at("x").date_source == "mtime"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table recs (id integer, zdate real, zpath text)")
        db.execute("create table other (a text)")
        db.executemany("insert into recs values (?, ?, ?)", [(i, i * 1.5, f"p{i}") for i in range(100)])
    readers.register(spark)
    df = spark.read.format("sqlite_file").option("path", path).load()
    assert df.filter("id >= 90 and zpath is not null").count() == 10 and df.count() == 100
    assert spark.read.format("sqlite_file").options(path=path, table="recs", where="id % 2 = 0").load().count() == 50


def test_replayed_pages(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "page_0.json").write_text(json.dumps({"items": [{"id": 1}], "next_page_token": 1}))
    (tmp_path / "calls" / "page_1.json").write_text(json.dumps({"items": [{"id": 2}]}))
    (tmp_path / "none").mkdir()
    readers.register(spark)
    assert sorted(r.item for r in spark.read.format("replayed_pages").option("path", str(tmp_path)).load().collect()) == ['{"id": 1}', '{"id": 2}']
    answers, slept = [(429, {"retry_after": 100}), (200, {"items": [1]})], []
    assert list(readers.paged(lambda q: answers.pop(0), {}, "items", "c", sleep=slept.append)) == [1] and slept == [60.0]
    with pytest.raises(OSError):
        list(readers.paged(lambda q: (500, {}), {}, "items", "c", sleep=lambda s: None))


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r>{x}</w:r></w:p>" for x in ("<w:t>Sync</w:t>", "<w:t>May 1, 2024</w:t>", "<w:t>25m</w:t>", "<w:t>Ada started transcription</w:t>", "<w:t>Ada Vale</w:t><w:tab/><w:t>0:03</w:t>", "<w:t>meet at 3:00 please</w:t>", "<w:t>Bo  1:10</w:t>", "<w:t>ok</w:t>"))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    a, b = readers.docx(spark, str(tmp_path)).orderBy("path").collect()
    assert (a.title, a.duration, [(t.speaker, t.start, t.text) for t in a.turns]) == ("Sync", "25m", [("Ada Vale", 3, "meet at 3:00 please"), ("Bo", 70, "ok")]) and b.error


def test_rules_frame(spark):
    text = "domains:\n  - domain: acme.example\n    folder: clients/acme\n  - domain: x\n    folder: y # note\n"
    assert [tuple(r) for r in readers.rules_frame(spark, text).collect()] == [("acme.example", "clients/acme"), ("x", "y")]
    with pytest.raises(ValueError):
        readers.rules_frame(spark, "!!", strict=True)


def test_policies_are_idempotent(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "id long, hash string")
    old = spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], "id long, hash string")
    assert {(r.id, r.action) for r in merge.insert_only(new, old, "id").collect()} == {(1, "unchanged"), (2, "unchanged"), (3, "insert")}
    batch = new.distinct()
    after = merge.apply(merge.by_value(batch, old, "id", "hash"), old, "id")
    assert {tuple(r) for r in after.collect()} == {(1, "a"), (2, "b"), (3, "c"), (9, "z")}
    assert {r.action for r in merge.by_value(batch, after, "id", "hash").collect()} == {"unchanged"}


def test_cursors():
    assert merge.heal_window("2024-01-31", 7, "2024-01-10") == "2024-01-09" and merge.heal_window("2024-01-31", 7, None) == "2024-01-24"
    assert merge.next_cursor("2024-01-01T00:00:00Z", None) == "2024-01-01T00:00:01+00:00" and merge.next_cursor(None, "c") == "c"
    with pytest.raises(ValueError):
        merge.next_cursor("2024-01-01", None)


def test_pages(spark):
    ranked = spark.createDataFrame([("foo-bar", 3, ["a", "b"], "2024-01-01", "2024-01-05")], "slug string, items int, source_list array<string>, first string, latest string")
    report = pages.patterns_report(ranked, ["slug"])
    r = report.select(payloads.report_rows(F.col("report"))[0].alias("r")).first().r
    assert (r.slug, r["items"], r.sources, r.latest) == ("foo-bar", 3, ["a", "b"], dt.date(2024, 1, 5))
    new = spark.createDataFrame([("p", "head", "tail"), ("q", "h", "t")], "slug string, head string, tail string")
    old = spark.createDataFrame([("p", "x\n<s>\nmine\n<e>\ny")], "slug string, text string")
    assert {r.slug: r.text for r in pages.keep_region(new, old, "slug", "<s>", "<e>", "new").collect()} == {"p": "head\n\n<s>\nmine\n<e>\n\ntail", "q": "h\n\n<s>\nnew\n<e>\n\nt"}


def test_search_layers(spark):
    rows = [(f"raw/s{i % 2}/n{i}.md", f"n{i}", f"s{i % 2}", "acme " * (i + 1)) for i in range(14)] + [("wiki/synthesis/a.md", "a", "wiki", "Acme"), ("zzz.md", "z", "zzz", "acme")]
    df = spark.createDataFrame(rows, "rel string, stem string, source string, text string")
    got = search.search(df, ["acme"]).collect()
    assert sum(r.layer == "raw" for r in got) == 10 and {r.layer for r in got} == {"raw", "synthesis", "other"}
    assert one(spark, "a acme\nACME acme\nb", lambda c: search.hits(c, ["acme"], "lines")) == 2
    assert search.hubs(["foo bar"], spark.createDataFrame([("c", "foo-bar")], "kind string, slug string")).count() == 1


def test_people_and_index(spark):
    assert one(spark, 8, people.tier, "int") == 1 and one(spark, 3, people.tier, "int") == 2 and one(spark, 2, people.tier, "int") == 3
    df = spark.createDataFrame([("org", "beta", 1), ("org", "Alpha", 2), ("org", "none", 0)], "type string, name string, mention_count long")
    assert people.entity_index(df).first().names == ["Alpha", "beta"]
    orgs = people.discover_orgs(spark.createDataFrame([("a@x", "acme"), ("b@x", "Acme"), ("c@y", "clientco")], "email string, company string"), spark.createDataFrame([("c", "Client Co", [])], "entity string, key string, aliases array<string>"))
    assert [tuple(r) for r in orgs.collect()] == [("acme", 2, "Acme")]


def test_guard_and_table(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "n string")
    got = threads.guard(spark.createDataFrame([("misc",), ("big-plan",), ("ada-vale",), ("acme-co",)], "slug string"), names("zz"), names("Acme Co"), names("Ada Hill", "Bo Vale"))
    assert {r.slug: r.guard for r in got.collect()} == {"misc": "noise", "big-plan": None, "ada-vale": "person", "acme-co": "entity"}
    df = spark.createDataFrame([("a/x", 1), ("b/y", 2)], "rel string, n int")
    assert [r.n for r in audit.Table(df).from_("a/", "b/").sort(F.desc("n")).limit(1).table("n").collect()] == [2]


def test_stream_ledger(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "slug string, day string"
    for i, rows in enumerate(([("a", "d1"), ("a", "d1"), ("b", "d1")], [("a", "d2"), ("b", "d1")])):
        spark.createDataFrame(rows, schema).write.mode("append").json(str(tmp_path / "in"))
        stream = ingest.available(spark, str(tmp_path / "in"), schema, "json")
        q = ingest.ledger(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        got: list = []
        q.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).start().awaitTermination()
        assert sorted(got) == ([("a", 1), ("b", 1)] if i == 0 else [("a", 2)])
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_reports(spark):
    from corpusflow.operators import knowledge, reports

    frame = spark.createDataFrame
    notes = frame([(f"20 - P/{i}.md", "20 - P", dt.date(2024, 1, i), f"#thread/{t}") for i, t in enumerate(("alpha-beta", "alpha-beta", "alpha-beta", "thin-one", "done-it"), 1)], "rel string, source string, note_date date, text string")
    found = knowledge.lint(notes, frame([("done-it", "1")], "slug string, evidence_count string"), frame([("gamma-alpha", None)], "slug string, evidence_count string"), frame([("alphabeta",)], "slug string"), most_pairs=0)
    text = reports.lint_report(found, "2024-02-01").first().report
    assert text.startswith("---\ntype: dashboard-wiki-lint\n") and "| `alpha-beta` | 3 | 20 - P |" in text and "| `thin-one` | 1 |" in text and "- alpha-beta / alphabeta" in text and "- `done-it` (1)" in text
    assert "more_" in text and "| hollow | 2 |" in text
    slugs = frame([("a-b", ["gmail", "slack"], 3, "2024-01-01", "2024-01-02", "concept", "person")], "slug string, source_list array<string>, items int, first string, latest string, target string, guard string")
    queue = reports.review_queue(slugs.limit(0), slugs, slugs, slugs, slugs, "2024-02-01", "plan").first().report
    assert "- _(none this run)_" in queue and "- `a-b` · sources: gmail, slack" in queue and "| `a-b` | gmail, slack | 3 | 2024-01-01 → 2024-01-02 | concept |" in queue and "**person** (add to CRM instead)" in queue


def test_vocabulary_is_strict():
    from corpusflow.operators import knowledge

    assert knowledge.vocabulary(["# c", "a-b:", "  include: ['x y', z]"]) == {"a-b": {"include": ["x y", "z"], "exclude": []}} and knowledge.word_list(["Ada # x", "", "#"]) == {"ada"}
    for bad in (["a-b"], ["  include: [x]"], ["a:", "  include: x"], ["a:", "  other: [x]"]):
        with pytest.raises(ValueError):
            knowledge.vocabulary(bad)


def test_unfinished_deltas_are_not_read(spark, tmp_path):
    from corpusflow.streaming import ingest

    each = ingest.upsert_into(spark, f"file://{tmp_path}/t", "id", "stamp")
    for n, rows in enumerate([[(1, "a"), (2, "a")], [(2, "b"), (3, "a"), (3, "a")], [(1, "a")]]):
        each(spark.createDataFrame(rows, "id long, stamp string"), n)
    assert sorted(map(tuple, ingest.latest(spark, f"file://{tmp_path}/t", "id").collect())) == [(1, "a"), (2, "b"), (3, "a")]
    assert spark.read.parquet(f"file://{tmp_path}/t/v=1").count() == 2 and spark.read.schema("id long, stamp string").parquet(f"file://{tmp_path}/t/v=2").count() == 0
    (tmp_path / "t" / "v=1" / "_SUCCESS").unlink()
    assert sorted(map(tuple, ingest.latest(spark, f"file://{tmp_path}/t", "id").collect())) == [(1, "a"), (2, "a")]


def test_sqlite_takes_predicates(spark, tmp_path):
    from corpusflow.sources import readers

    path = str(tmp_path / "p" / "h.db")
    (tmp_path / "p").mkdir()
    with sqlite3.connect(path) as db:
        db.execute("create table history (id integer, app text, date real)")
        db.executemany("insert into history values (?, ?, ?)", [(i, f"a{i % 3}", i / 2) for i in range(100)])
    db.close()
    assert readers.discover([str(tmp_path / "none"), str(tmp_path)], "h.db") == path and readers.discover([str(tmp_path)], "x.db") is None
    rows = readers.sqlite(spark, path, "history", [("id", ">=", 10), ("app", "=", "a1"), ("date", "<", 20.0), ("app", "<>", "it's")], partitions="3")
    assert sorted(r.id for r in rows.filter("id % 2 = 0").collect()) == [i for i in range(10, 40) if i % 3 == 1 and i % 2 == 0] and rows.count() == 10
    with pytest.raises(ValueError):
        readers.sqlite(spark, path, "history", [("id", "or 1 =", 1)])


def test_configs(spark):
    from corpusflow.sources import configs

    mail = ["# c", "label_routes:", '  - { label: "A, B/c", route: "r1" }', '  - {label: "", route: x}', "domain_routes:", "  acme.example: clients/acme", "  none.example:"]
    domains, labels = configs.mail_routes(spark, mail)
    assert [tuple(r) for r in domains.collect()] == [("acme.example", "clients/acme")] and [tuple(r) for r in labels.collect()] == [(0, "A, B/c", "r1")]
    routes, dm = configs.channel_routes(spark, ['dm_route: "direct"', "channel_routes:", '- { channel: "general", route: "team" }'])
    assert dm == "direct" and [tuple(r) for r in routes.collect()] == [("general", "team")]
    assert configs.repositories(["owner: me", "repos:", "  - name: a", "    enabled: false", "  - name: b", "    enabled: true", "  - name: c"]) == ("me", ["b", "c"])
    boards = configs.board_routes(spark, ["other: x", "monday_routes:", "  leads:", '    folder: "20 - P"', "    tags: [a, 'b c']", "  empty:"]).collect()
    assert [tuple(r) for r in boards] == [("leads", "20 - P", ["a", "b c"])]
    entities, patterns, aliases = configs.seeds(spark, '{"products": [{"name": "W", "canonical_id": "w", "patterns": ["wid"]}], "client_aliases": {"aka": "c"}}')
    assert entities.first().type == "product" and patterns.first().pattern == "(?i)wid" and aliases.count() == 1 and configs.read([]) == {}
