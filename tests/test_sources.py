import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from graphlog.functions.literals import quote, typed, unquote
from graphlog.functions.text import transform
from graphlog.operators import access, registry
from graphlog.plans import views
from graphlog.sources import documents, rows, sinks
from graphlog.sources.rows import Field
from graphlog.storage import scratch_path


def landed(spark, *docs):
    return spark.createDataFrame([(f"d{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc string, value string")


PEOPLE = [Field("name", "$.name", required=True), Field("email", "$.email", "lowercase"), Field("type", "$.type.name", required=False)]


def test_mapping_missing_null_and_nested(spark):
    doc = {"data": [
        {"name": "Ann", "email": "A@X.org", "type": {"name": "w"}}, {"name": None, "email": None}, {"email": "b"}, {"name": 'q"\\\n', "email": 5},
    ]}
    mapped = rows.map_rows(rows.explode_rows(landed(spark, doc, "not json", {"other": 1}), "$.data[*]"), PEOPLE)
    good, bad = rows.split_errors(mapped)
    got = {r.position: r for r in good.collect()}
    assert got[0].properties == {"name": '"Ann"', "email": '"a@x.org"', "type": '"w"'}
    assert got[1].properties == {}
    assert got[3].properties == {"name": json.dumps('q"\\\n'), "email": '"5"'}
    assert got[0].source_hash == hashlib.sha256(b"email=a@x.org\nname=Ann\ntype=w").hexdigest()
    assert got[1].source_hash == hashlib.sha256(b"email=\nname=\ntype=").hexdigest()
    (letter,) = bad.collect()
    assert (letter.reason, letter.detail, json.loads(letter.raw_payload)) == ("MAPPING_ERROR", "no value at $.name", {"email": "b"})
    assert {r.doc for r in rows.failed_documents(landed(spark, doc, "not json", {"other": 1}), "$.data[*]").collect()} == {"d1", "d2"}


@pytest.mark.parametrize("name,text,want", [
    ("iso8601-date", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"), ("iso8601-date", " 2024-01-02T03:04:05.120+02:00 ", "2024-01-02T01:04:05.120Z"),
    ("iso8601-date", "2024-01-02T03:04:05", None), ("iso8601-date", "2024-01-02", "2024-01-02"), ("iso8601-date", "02.01.2024", None),
    ("iso8601-date", "2024-13-02", None), ("parse-int", " 42 ", "42"), ("parse-int", "4.2", None), ("parse-int", "99999999999999999999", None),
    ("parse-decimal", "+1.50", "1.50"), ("parse-decimal", ".5", "0.5"), ("parse-decimal", "x", None), ("TRIM", " a ", "a"), ("none", " a ", " a "),
    ("sha256", "a", hashlib.sha256(b"a").hexdigest()), ("lowercase", None, None),
])
def test_transforms(spark, name, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(transform(name, F.col("t")).cast("string")).first()[0]
    assert got == want


@pytest.mark.parametrize("text,want", [
    ("2024-01-02T03:04:05.1Z", "2024-01-02T03:04:05.100Z"), ("2024-01-02T03:04:05.000Z", "2024-01-02T03:04:05Z"),
    ("2024-01-02T03:04:05.00045Z", "2024-01-02T03:04:05.000450Z"), ("2024-01-02T03:04:05.45Z", "2024-01-02T03:04:05.450Z"),
    ("2024-01-02T00:00:00.123456+01:00", "2024-01-01T23:00:00.123456Z"), ("2000-01-01T00:00:00.120001Z", "2000-01-01T00:00:00.120001Z"),
])
def test_instants_have_no_three_or_six_digits(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(transform("iso8601-date", F.col("t"))).first()[0]
    assert got == want


@pytest.mark.parametrize("text,want", [
    ("-1.5e-3", "-1.5e-3"), ("-.5", "-0.5"), ("5.", "5"), ("5.e3", "5e3"), ("+.5E+2", "0.5E+2"), ("1.2.3", None), (".", None), ("-", None),
])
def test_decimals_in_any_spelling(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(transform("parse-decimal", F.col("t"))).first()[0]
    assert got == want


def test_mapped_literals_of_odd_values(spark):
    odd = ["Ab", " Ab ", "", " ", 'Q"\\\n\t\x01 ', "É/<é>\x7f", 5, -1.5, True, {"A": 'X"'}, ["B", None]]
    kinds = {"lowercase": str.lower, "uppercase": str.upper, "trim": lambda t: t.strip(" "), "sha256": lambda t: hashlib.sha256(t.encode()).hexdigest()}
    fields = [Field(k, "$.v", k) for k in kinds] + [Field("none", "$.v")]
    mapped = rows.map_rows(rows.explode_rows(landed(spark, [{"v": v} for v in odd])), fields).collect()
    for r in mapped:
        value = odd[r.position]
        text = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
        want = {k: f(text) for k, f in kinds.items()} | {"none": value}
        assert {k: json.loads(v) for k, v in r.properties.items()} == want and r.error is None
        lines = [f"{k}={want[k] if k != 'none' else text}" for k in sorted(want)]
        assert r.source_hash == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert len(mapped) == len(odd)


def test_mapping_is_compiled_and_makes_only_what_is_asked(spark):
    fields = [Field("name", "$.name", "trim", required=True), Field("at", "$.at", "iso8601-date")]
    mapped = rows.map_rows(rows.explode_rows(landed(spark, {"data": [{"name": "a"}]}), "$.data[*]"), fields)
    good, bad = rows.split_errors(mapped)
    for df, made in ((good.select("properties"), {"map_from_entries"}), (good.select("source_hash"), {"sha2"}), (bad.select("detail"), set())):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "from_json(" not in plan
        assert plan.count("date_format(") == 1
        assert {name for name in ("map_from_entries", "sha2") if f"{name}(" in plan} == made


def test_unknown_transform_is_refused():
    with pytest.raises(ValueError):
        transform("rot13", None)


def test_second_run_without_changes_gives_nothing(spark):
    doc = {"data": [{"name": "Ann", "email": "a"}, {"name": "Bob", "email": "b"}]}
    mapped = rows.split_errors(rows.map_rows(rows.explode_rows(landed(spark, doc), "$.data"), PEOPLE))[0]
    tagged = mapped.withColumn("model_id", F.lit("t0")).withColumn("type", F.lit("person"))
    none = spark.createDataFrame([], "model_id string, type string, node string, seq bigint, props map<string,string>")
    first = rows.classify(tagged, none, ["name"])
    assert {r.operation for r in first.collect()} == {"CREATE"} and first.count() == 2
    stored = first.select("model_id", "type", F.concat(F.lit("n"), "position").alias("node"), F.col("position").cast("bigint").alias("seq"), F.col("properties").alias("props"))
    assert rows.classify(tagged, stored, ["name"]).count() == 0
    changed = {"data": [{"name": "Ann", "email": "new"}, {"name": "Cyd"}]}
    again = rows.split_errors(rows.map_rows(rows.explode_rows(landed(spark, changed), "$.data"), PEOPLE))[0]
    again = again.withColumn("model_id", F.lit("t0")).withColumn("type", F.lit("person"))
    assert {(r.operation, r.node) for r in rows.classify(again, stored, ["name"]).collect()} == {("UPDATE", "n0"), ("CREATE", None)}


def paragraphs(text, overlap):
    out, start, before = [], 0, None
    spots = [m.span() for m in re.finditer(r"\n{2,}", text)] + [(len(text), len(text))]
    for a, b in spots:
        part = text[start:a]
        if part.strip():
            out.append(((before[-overlap:] if overlap and before is not None else "") + part, start, len(part)))
            before = part
        start = b
    return out


@pytest.mark.parametrize("overlap", [0, 3, 50])
def test_paragraphs(spark, overlap):
    texts = ["one\n\ntwo\n\n\n\nthree", "\n\n \n\nlead", "single", "", "  ", "tail\n\n", "a\nb\n\nc", "ab\n\n\n" * 1500 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = documents.paragraph_chunks(docs, overlap).orderBy("id", "chunk_index").collect()
    for i, text in enumerate(texts):
        assert [(r.text, r.char_offset, r.char_length) for r in got if r.id == i] == paragraphs(text, overlap)


def test_sentences_cover_the_text(spark):
    text = 'First one. Second? "Third!" See e.g. the 3.5 bit.\nNew line\nwith more! and.  so on'
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    got = documents.sentence_chunks(docs, 0).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["First one. ", "Second? ", '"Third!" ', "See e.g. the 3.5 bit.\n", "New line\nwith more! ", "and.  so on"]
    assert "".join(r.text for r in got) == text and [r.char_offset for r in got][:2] == [0, 11]
    assert documents.sentence_chunks(docs, 4).filter("chunk_index = 1").first().text == "ne. Second? "


def test_folder_scan_and_changes(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.md").write_text("äpfel", encoding="utf-8")
    (tmp_path / "sub" / "deep" / "b.md").write_text("two")
    (tmp_path / "sub" / "c.txt").write_text("no")
    (tmp_path / "big.md").write_text("x" * 2000)
    docs, large = documents.scan_folder(spark, str(tmp_path), max_bytes=1000)
    assert {r.path: r.text for r in docs.collect()} == {"a.md": "äpfel", "sub/deep/b.md": "two"}
    (letter,) = large.collect()
    assert letter.reason == "FILE_TOO_LARGE" and json.loads(letter.raw_payload) == {"path": "big.md", "size": 2000}
    (tmp_path / "sub" / "odd.md").write_bytes(b"ok \xff\xfe")
    docs, bad = documents.scan_folder(spark, str(tmp_path), max_bytes=1000)
    assert {r.reason: json.loads(r.raw_payload)["path"] for r in bad.collect()} == {"FILE_TOO_LARGE": "big.md", "IO_ERROR": "sub/odd.md"}
    for glob, want in (("*.md", {"a.md"}), ("sub/*.md", set()), ("sub/**/*.md", {"sub/deep/b.md"}), ("sub/?.txt", {"sub/c.txt"})):
        assert {r.path for r in documents.scan_folder(spark, str(tmp_path), glob, 1000)[0].collect()} == want
    seen = documents.changed_documents(docs, spark.createDataFrame([], "path string, content_hash string")).select("path", "content_hash")
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    (tmp_path / "a.md").write_text("changed")
    fresh, _ = documents.scan_folder(spark, str(tmp_path), max_bytes=1000)
    assert [r.path for r in documents.changed_documents(fresh, seen).collect()] == ["a.md"]


def test_responses(spark):
    body = json.dumps([{"typeSlug": "person", "name": "Ann", "properties": {"age": 3, "nick": "A"}, "confidence": 0.9, "sourceSpan": {"offset": 1, "length": 2}}])
    docs = [(1, body), (2, f"```json\n{body}\n```  "), (3, "```\n[]\n```"), (4, "{}"), (5, "nonsense"), (6, body[:-3])]
    found, bad = documents.parse_responses(spark.createDataFrame(docs, "id int, response string"))
    got = documents.extracted_properties(found).orderBy("id").collect()
    assert [(r.id, r.type, r.name) for r in got] == [(1, "person", "Ann"), (2, "person", "Ann")]
    assert got[0].properties == {"name": '"Ann"', "age": "3", "nick": '"A"'}
    assert {r.id for r in bad.collect()} == {4, 5, 6}


def test_outcomes_and_status(spark):
    runs = spark.createDataFrame(
        [("r1", "c", 1, False), ("r2", "c", 2, False), ("r3", "c", 3, True), ("r4", "c", 4, False), ("r5", "d", 5, False), ("r6", "d", 6, False)],
        "run_id string, connector_id string, poll_at int, unchanged boolean",
    )
    results = [("r1", "committed"), ("r1", "mapped_error"), ("r2", "mapped_error"), ("r4", "rejected"), ("r5", "committed"), ("r5", "rejected")]
    out = rows.run_outcomes(runs, spark.createDataFrame(results, "run_id string, status string"))
    assert {r.run_id: r.outcome for r in out.collect()} == {"r1": "PARTIAL", "r2": "FAILED", "r3": "NO_CHANGE", "r4": "FAILED", "r5": "PARTIAL", "r6": "SUCCESS"}
    got = {r.connector_id: r for r in rows.sync_status(out).collect()}
    assert (got["c"].last_outcome, got["c"].last_success_at, got["c"].events_processed, got["c"].dlq_count) == ("FAILED", 3, 1, 3)


def test_event_log_prunes_months(spark):
    import datetime as dt

    events = spark.createDataFrame([("t0", i, dt.datetime(2024, 1 + i % 3, 5)) for i in range(9)], "model_id string, seq bigint, event_time timestamp")
    path = scratch_path(spark)
    sinks.write_events(events, path)
    stored = sinks.read_events(spark, path)
    span = sinks.event_span(F.lit("2024-02-01").cast("timestamp"), F.lit("2024-03-01").cast("timestamp"))
    wanted = stored.filter(span)
    assert wanted.count() == 3
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan


def test_literals_round_trip(spark):
    texts = ['plain', 'q"uote', 'back\\slash', 'new\nline', 'ünï', '']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", quote(F.col("t")).alias("j"), unquote(quote(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and json.loads(r.j) == r.t for r in got)
    cast = spark.createDataFrame([("42", '"2024-01-02"', '"x"')], "i string, d string, s string")
    row = cast.select(typed(F.col("i"), "INTEGER"), typed(F.col("d"), "date"), typed(F.col("s"), "integer"), typed(F.col("s"), None)).first()
    assert (row[0], str(row[1]), row[2], row[3]) == (42, "2024-01-02", None, "x")


def test_aliases_and_acl(spark):
    held = spark.createDataFrame([("t0", "p", {"old": "1", "new": "2", "x": "3"}), ("t0", "p", {"old": "1"}), ("t1", "p", {"old": "1"})], "model_id string, type string, payload map<string,string>")
    names = spark.createDataFrame([("t0", "p", "old", "mid", 1), ("t0", "p", "old", "new", 2), ("t0", "p", "new", "newer", 0)], "model_id string, type string, old_slug string, current_slug string, changed_at int")
    got = [r.payload for r in registry.rename_properties(held, names.filter("old_slug = 'old'")).collect()]
    assert sorted(sorted(g.items()) for g in got) == [[("new", "1")], [("new", "2"), ("x", "3")], [("old", "1")]]
    props = spark.createDataFrame(
        [("t0", "p", "salary", ["ADMIN"], ["ADMIN"]), ("t0", "p", "name", [], None)],
        "model_id string, type string, property string, read_roles array<string>, write_roles array<string>",
    )
    nodes = spark.createDataFrame([("t0", "p", {"salary": "1", "name": "2", "free": "3"})], "model_id string, type string, props map<string,string>")
    assert access.filter_properties(nodes, props, ["USER"]).first().props == {"name": "2"}
    assert access.filter_properties(nodes, props, ["ADMIN"]).first().props == {"salary": "1", "name": "2"}
    assert access.filter_properties(nodes, props, []).first().props == {"name": "2"}
    assert access.check_writes(nodes, props, ["USER"], "props").first().denied == ["salary"]


def test_views_refresh_only_when_the_version_moves(spark):
    nodes = spark.createDataFrame(
        [("t0", "n1", "doc", {"size": "5", "title": '"x"'}, False), ("t0", "n2", "doc", {"size": '"big"'}, False), ("t0", "n3", "doc", {}, True), ("t1", "n4", "doc", {}, False)],
        "model_id string, node string, type string, props map<string,string>, tombstoned boolean",
    ).selectExpr("*", "now() AS created_at", "now() AS updated_at", "'a' AS created_by", "1L AS seq")
    reg = spark.sql("SELECT 't0' AS model_id, 'doc' AS type, p AS property, d AS data_type, CAST(x AS TIMESTAMP) AS deprecated_at FROM VALUES ('size','INTEGER',NULL), ('title','STRING',NULL), ('old','STRING',now()) AS v(p,d,x)")
    types = spark.sql("SELECT 't0' AS model_id, 'doc' AS type, true AS exposed, 2L AS schema_version")
    record = views.refresh_views(spark, nodes, types, reg)
    name = views.view_name("t0", "doc")
    view = spark.table(name)
    assert record == {name: 2} and name.startswith("v_t0_doc_") and view.columns[-2:] == ["size", "title"]
    assert {r.node: r.size for r in view.collect()} == {"n1": 5, "n2": None}
    alike = [("a", "b_c"), ("a_b", "c"), ("a-b", "c"), ("a", "B_c")]
    assert len({views.view_name(*x) for x in alike}) == 4
    spark.catalog.dropTempView(name)
    assert views.refresh_views(spark, nodes, types, reg, record) == record
    assert not spark.catalog.tableExists(name)
    with pytest.raises(Exception):
        views.typed_view(nodes, [("size", "integer")], "t0", "doc", strict=True).collect()


def test_published_versions_switch_when_complete(spark):
    root = scratch_path(spark)
    assert sinks.publish(spark.range(3), root) == 1
    assert sinks.publish(spark.range(5), root) == 2
    assert sinks.read_published(spark, root).count() == 5
    from pathlib import Path

    Path(f"{root}/version=3").mkdir()
    assert sinks.read_published(spark, root).count() == 5 and sinks.publish(spark.range(7), root) == 4


def test_a_written_folder_has_one_file_for_each_row_and_nothing_else(spark, tmp_path):
    rows = [("1", "a"), ("1", "b"), ("2", "é\nf"), ("x/y", ""), (None, None)]
    documents.write_folder(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1), str(tmp_path / "out"), "doc_id")
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(files) == 5 and {p.suffix for p in files} == {".txt"}  # no checksum files
    found, _ = documents.scan_folder(spark, str(tmp_path / "out"), "**/*.txt", 100)
    got = sorted((r.path.split("/")[0], r.text) for r in found.collect())
    assert got == [("doc_id=1", "a\n"), ("doc_id=1", "b\n"), ("doc_id=2", "é\nf\n"), ("doc_id=__HIVE_DEFAULT_PARTITION__", "\n"), ("doc_id=x%2Fy", "\n")]


def test_a_folder_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "_ENTRIES", 3)  # several rounds
    monkeypatch.setattr(documents, "_FOLDERS", 2)
    monkeypatch.setattr(documents, "_HELD", 4)
    top = tmp_path / "top"
    want = {f"{a}/{b}/{c}.txt": f"{a}{b}{c}" for a in "pqrst" for b in ("u", "v w") for c in "xyz"}
    want |= {"x.txt": "é", f"p{top}/x.txt": "1", "_a=1/x.txt": "2", "_metadata/x.txt": "3", "q/a%20:b#.txt": "4", "l/x.txt": "pux"}
    for path, text in want.items():
        if not path.startswith("l/"):
            (top / path).parent.mkdir(parents=True, exist_ok=True)
            (top / path).write_text(text, encoding="utf-8")
    (top / "l").symlink_to("p/u")
    want |= {"l/y.txt": "puy", "l/z.txt": "puz"}
    (top / "gone.txt").symlink_to("nowhere")
    (top / "r" / "long.txt").write_text("x" * 101)
    (top / "r" / "other.md").write_text("x")
    for path in ("_h.txt", ".h.txt", "_metadata.txt", "_h/x.txt", ".h/x.txt", "r/h.txt._COPYING_"):
        (top / path).parent.mkdir(exist_ok=True)
        (top / path).write_text("hidden")
    (top / "r" / "empty.txt").write_text("")
    for folder in (str(top), f"file:{top}/", f"file://{top}"):
        found, bad = documents.scan_folder(spark, folder, "**/*.txt", 100)
        rows = found.collect()
        assert len(rows) == len(want) and {r.path: r.text for r in rows} == want
        assert all(r.size == len(r.text.encode()) and r.mtime == (top / r.path).stat().st_mtime_ns // 10**6 for r in rows)
        assert [json.loads(r.raw_payload) for r in bad.collect()] == [{"path": "r/long.txt", "size": 101}]
        # the driver has no list of the files
        assert not [f for df in (found, bad) for f in df.inputFiles() if not f.endswith(".parquet")]


def test_a_file_that_differs_from_its_checksum_file_is_an_error(spark, tmp_path):
    spark.createDataFrame([("abc" * 400,)], "text string").coalesce(1).write.text(str(tmp_path / "out"))
    (text,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"]
    assert (text.parent / f".{text.name}.crc").exists()
    assert [r.text for r in documents.scan_folder(spark, str(tmp_path / "out"), "*.txt")[0].collect()] == ["abc" * 400 + "\n"]
    text.write_text("abd" * 400 + "\n")
    with pytest.raises(Exception, match="checksum"):
        documents.scan_folder(spark, str(tmp_path / "out"), "*.txt")[0].collect()
