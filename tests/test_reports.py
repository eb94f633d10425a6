"""Reports, model outputs, labels, suites, layout and bookkeeping against literal rows and plain rules."""

import datetime
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenza.functions import labels
from evidenza.operators import answers, layout, ledger, reports, retrieval, suites
from evidenza.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def checked(spark, rule, *payloads):
    """Error and value of each payload."""
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    out = [r.x for r in spark.createDataFrame(rows, "i int, j string").select("i", rule(F.col("j")).alias("x")).orderBy("i").collect()]
    return [(x.error, x.value.asDict(True) if hasattr(x.value, "asDict") else x.value) for x in out]


def test_answers(spark):
    good = {"answer": " a ", "suggestions": ["x", 1, " ", " y "] + ["z"] * 9, "risk_level": "severe"}
    bad = [None, "no json", "[]", {"answer": 5}, {"answer": " "}, {"answer": "a", "suggestions": "x"}]
    got = checked(spark, answers.answer, good, {"answer": "a", "suggestions": None, "risk_level": "low"}, *bad)
    assert got[0] == (None, {"answer": "a", "suggestions": ["x", "y", "z", "z", "z"], "risk_level": "unknown"})
    assert got[1] == (None, {"answer": "a", "suggestions": [], "risk_level": "low"})
    assert all(error and value is None for error, value in got[2:])


def test_report_items(spark):
    row = lambda name, value=1.0, **more: {"name": name, "value": value, **more}
    good = {"items": [row("a  b", unit="U"), row("A b", unit="u"), row("姓名", value="x"), row("c", 2, reference_low=1, reference_high=3.5)]}
    bad = ["x", row(""), row("n" * 61), row("a", "1"), row("a", True), row("a", unit=3), row("a", unit="u" * 25), row("a", reference_low=3, reference_high=2), row("a", reference_low="1")]
    got = checked(spark, answers.report_items, good, {}, *[{"items": [x]} for x in bad])
    assert got[0][0] is None
    assert [(x["name"], x["value"], x["unit"], x["reference_low"], x["reference_high"]) for x in got[0][1]] == [("a b", 1.0, "U", None, None), ("c", 2.0, "", 1.0, 3.5)]
    assert got[1] == (None, []) and all(error and value is None for error, value in got[2:])


def test_analyses_and_summaries(spark):
    a = {"overall_assessment": "fine", "risk_level": "low", "key_findings": [{"title": "t", "content": "c"}], "lifestyle_advice": ["walk", "", 3, "sleep"], "disclaimer": "d"}
    changes = [{"disclaimer": ""}, {"overall_assessment": "```x"}, {"overall_assessment": "Keep the ORIGINAL report"}, {"key_findings": [1]}, {"key_findings": [{"title": "t"}]}, {"warning_signs": "x"}, {"normal_overview": 1}, {"follow_up_advice": ["```"]}]
    got = checked(spark, answers.analysis, a, *[{**a, **x} for x in changes])
    assert got[0][0] is None and got[0][1]["lifestyle_advice"] == ["walk", "sleep"] and got[0][1]["normal_overview"] == ""
    assert all(error and value is None for error, value in got[1:])
    rows = spark.createDataFrame([(0, json.dumps(a)), (1, json.dumps({**a, "key_findings": None}))], "i int, j string")
    text, bare = (r.x for r in rows.select("i", reports.analysis_summary(answers.analysis(F.col("j"))["value"]).alias("x")).orderBy("i").collect())
    assert text == "【综合评价】\nfine\n\n【重点关注】\n1. t\nc\n\n【生活方式建议】\n1. walk\n2. sleep\n\n【风险等级】\n低\n\n【说明】\nd"
    assert reports.NONE_FOUND in bare


def test_interpreted(spark):
    schema = "report_id int, position int, name string, value double, unit string, low double, high double, status string"
    rows = [(1, 0, "a", 9.0, "u", 1.0, 5.0, "x"), (1, 1, "b", 2.0, "u", None, None, "x"), (1, 2, " ocr PENDING", 1.0, "", None, None, "x"), (2, 0, "OCR pending", None, "", None, None, "unknown"), (4, 0, "c", 2.0, "u", 1.0, 5.0, "x")]
    items, all_reports = spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (2,), (3,), (4,)], "report_id int")
    a = json.dumps({"overall_assessment": "o", "risk_level": "medium", "disclaimer": "d"})
    told = spark.createDataFrame([(4, a), (1, "{}")], "report_id int, j string").select("report_id", answers.analysis(F.col("j"))["value"].alias("analysis"))
    got = {r.report_id: r for r in reports.interpreted(all_reports, items, told).collect()}
    assert [(got[i].status, got[i].risk_level, got[i].n_items, got[i].n_abnormal) for i in (1, 2, 3, 4)] == [("completed", "unknown", 2, 1), ("rejected", None, 0, 0), ("rejected", None, 0, 0), ("completed", "medium", 1, 0)]
    assert "- a：偏高，结果 9.0 u\n- 另有 1 项" in got[1].summary and got[2].summary is None and got[4].summary.startswith("【综合评价】\no")
    filled = reports.with_placeholder(all_reports, items).filter("report_id = 3").collect()
    assert [(r.name, r.value, r.status) for r in filled] == [("OCR pending", None, "unknown")]
    chosen, warned = reports.model_or_rules(all_reports, items.filter("report_id = 1"), items.filter("report_id IN (1, 4)").withColumn("name", F.lit("rule")))
    assert sorted((r.report_id, r.name) for r in chosen.collect()) == [(1, " ocr PENDING"), (1, "a"), (1, "b"), (4, "rule")]
    assert sorted(r.report_id for r in warned.filter("warning IS NOT NULL").collect()) == [2, 3, 4]
    asked = [one(spark, reports.knowledge_question(F.lit("n"), F.lit(s))) for s in ("high", "low", "normal")]
    assert asked == ["n 偏高 健康意义", "n 偏低 健康意义", "n 检查结果 参考范围 健康意义"]


def test_context_is_reached_in_order(spark):
    hits = [(1, i, r, (i * 3 + r) % 16) for i in range(8) for r in range(3)]
    kept, cited = reports.context(spark.createDataFrame(hits, "report_id int, item int, rank int, chunk_id int"), 12)
    seen, items = [], {}
    for _, item, _, chunk in hits:
        if len(seen) < 12 or item in items:
            items.setdefault(item, []).append(chunk)
        if chunk not in seen and len(seen) < 12:
            seen.append(chunk)
    assert [r.chunk_id for r in kept.orderBy("place").collect()] == seen
    assert {r.item: list(r.citations) for r in cited.collect()} == items


def test_labels(spark):
    tags = ["age_adult", "condition_hypertension", "allergy_nuts", "med_x", "bmi_normal", "condition_"]
    assert one(spark, labels.tag_labels(F.array(*map(F.lit, tags)))) == ["成人", "慢病:高血压", "过敏:nuts", "用药:x", "bmi_normal", "慢病:"]
    text = "姓 名 张三\n  a \t b \r\n\n电话 1 c"
    assert one(spark, labels.without_identities(F.lit(text))) == "a b\nc"
    assert one(spark, labels.profile_block(F.lit(" "), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))) == labels.NO_PROFILE
    assert one(spark, labels.profile_block(F.lit("p"), F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.array(F.lit("k")))) == labels.PROFILE + "p\n画像标签：a、b\n画像关键词：k\n\n"
    assert one(spark, labels.passages_block(F.array(F.struct(*[F.lit(x).alias(n) for n, x in (("article_title", "A"), ("section_title", "S"), ("source_url", "U"), ("content", "C"))])))) == "[资料1]\narticle_title: A\nsection_title: S\nsource_url: U\ncontent: C"
    assert one(spark, labels.display_tags(F.lit("c"), F.array(F.lit("t"), F.lit("c")))) == ["c", "t"]
    assert [one(spark, labels.shown_name(F.lit(n), F.lit("me@x.org"))) for n in (None, " ", "N")] == ["me", "me", "N"]
    assert one(spark, labels.message_content(F.lit('{"choices": [{"message": {"content": "hi"}}]}'))) == "hi"
    assert one(spark, labels.data_url(F.lit(b"ab"))) == "data:image/jpeg;base64,YWI=" and one(spark, labels.data_url(F.lit(b""))) is None


def chunk(**change):
    text = change.get("content", "text")
    row = {"chunk_id": "a", "document_id": "d", "pdf_page": 1, "chunk_index": 0, "chunk_count": 1, "article_title": "t", "section_title": "s", "source_url": "u", "category": "c", "content": text, "content_hash": hashlib.sha256(text.encode()).hexdigest(), "tags": ["t"], "searchable": True}
    return {**row, **change}


def test_suites(spark):
    schema = "chunk_id string, document_id string, pdf_page int, chunk_index int, chunk_count int, article_title string, section_title string, source_url string, category string, content string, content_hash string, tags array<string>, searchable boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    frame = lambda *rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    reasons = lambda *rows, **more: [sorted(r.reasons) for r in suites.chunk_suite(frame(*rows), **more).orderBy("chunk_id", "chunk_index").collect()]
    assert reasons(chunk()) == [[]]
    assert reasons(chunk(content=" ")) == [["content"]] and reasons(chunk(tags=None, searchable=None)) == [["searchable", "tags"]]
    assert reasons(chunk(content_hash="0" * 64)) == [["content_hash"]] and reasons(chunk(category="汉" * 43)) == [["category_bytes"]]
    assert reasons(chunk(chunk_count=3), chunk(chunk_id="b", chunk_index=2, chunk_count=3)) == [["page_count", "page_indexes"]] * 2
    assert reasons(chunk(chunk_count=2), chunk(chunk_index=1, chunk_count=2)) == [["unique"]] * 2
    assert reasons(chunk(), max_chars=3, max_page=0, url=F.lit("v")) == [["length", "pdf_page", "url"]]
    assert suites.good_rows(suites.chunk_suite(frame(chunk()))).count() == 1
    with pytest.raises(Exception, match="chunks: content"):
        suites.good_rows(suites.chunk_suite(frame(chunk(content=" "))), "chunks").collect()

    wanted = {"model_name": "m", "embedding_dimension": 4, "normalized": True, "chunk_count": 2, "source_chunk_count": 2, "selected_start_index": 0, "selected_end_index": 2, "input_sha256": "h"}
    said = lambda m: suites.manifest_suite(spark.read.json(spark.sparkContext.parallelize([json.dumps(m)])), "m", 4, 2, "h").first().reasons
    assert said(wanted) == [] and said({**wanted, "chunk_count": 3}) == ["chunk_count"] and said({k: v for k, v in wanted.items() if k != "normalized"}) == ["normalized"]

    chunks = spark.createDataFrame([("a", "d", "h", 1, "c" * 200)], "chunk_id string, document_id string, content_hash string, pdf_page int, category string")
    vector = lambda h: spark.createDataFrame([("a", h, 1, [1.0])], "chunk_id string, content_hash string, pdf_page int, embedding array<float>")
    assert [len(r.category) for r in suites.records(chunks, vector("h"), "m").collect()] == [128]
    with pytest.raises(Exception, match="differ"):
        suites.records(chunks, vector("x"), "m").collect()
    rows = chunks.withColumn("model_name", F.lit("old"))
    assert suites.same_in_stores(chunks, rows, "m").first().reasons == ["model_name"]
    for bad in ({"document_id": "x"}, {"model_name": 'a" or 1'}):
        with pytest.raises(ValueError):
            suites.vector_filter(rows, **bad)
    assert suites.vector_filter(rows, model_name="old").count() == 1

    uploads = spark.createDataFrame([("/a/b.PDF", 5), ("c.txt", 0), ("d.png", 16 << 20)], "path string, length long")
    assert [r.reasons for r in suites.upload_suite(uploads).collect()] == [[], ["suffix", "empty"], ["size"]]
    forms = spark.createDataFrame([(" A@x.org ", "abcdefg1", "ok"), ("a@org", "abcdefgh", "x")], "email string, password string, question string")
    assert [(r.email, r.reasons) for r in suites.form_suite(forms).collect()] == [("a@x.org", []), ("a@org", ["email", "password", "question"])]
    people = spark.createDataFrame([(None, "400"), ("29", "x")], "height_cm string, weight_kg string")
    assert [r.reasons for r in suites.profile_suite(people).collect()] == [[], ["height_cm", "weight_kg"]]


def test_layout_chunks(spark, tmp_path):
    rows = [("text", "p" * 30), ("title", "One"), ("text", "aaaa"), ("text", "b" * 25), ("h3", "Deep"), ("text", "c"), ("heading", "Two"), ("text", "d\n\n" + "e" * 9)]
    blocks = [{"type": k, "text": t, "page_idx": i, "bbox": [0, 0, 1, i]} for i, (k, t) in enumerate(rows)]
    blocks[4]["text_level"] = 3
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "content_list.json").write_text(json.dumps({"content_list": []}))
    (tmp_path / "d" / "a.json").write_text("not json")
    (tmp_path / "d" / "b.json").write_text(json.dumps([*blocks, {"content": ["x", "y"], "page_no": 0}, 5]))
    (tmp_path / "d" / "c.json").write_text(json.dumps([{"text": "other"}]))
    read = files.layout_blocks(spark, str(tmp_path / "d")).orderBy("ordinal")
    assert [(r.kind, r.text, r.page) for r in read.collect()] == [(k, t, i + 1) for i, (k, t) in enumerate(rows)] + [("text", "x\ny", 1)]
    got = layout.layout_chunks(read.filter("ordinal < 8").withColumns({"document_id": F.lit("d"), "title": F.lit("T")}), 10).orderBy("section", "position").collect()
    assert [(r.heading_path, r.content, r.page_start, r.page_end, len(r.boxes)) for r in got] == [
        (["T"], "p" * 10, 1, 1, 1), (["T"], "p" * 10, 1, 1, 1), (["T"], "p" * 10, 1, 1, 1),
        (["T", "One"], "aaaa", 3, 4, 2), (["T", "One"], "b" * 10, 4, 4, 1), (["T", "One"], "b" * 10, 4, 4, 1), (["T", "One"], "b" * 5, 4, 4, 1),
        (["T", "One", "Deep"], "c", 6, 6, 1), (["T", "One", "Two"], "d", 8, 8, 1), (["T", "One", "Two"], "e" * 9, 8, 8, 1),
    ]
    assert got[3].content_hash == hashlib.sha256("d|T > One|3|aaaa".encode()).hexdigest()


def test_decoding_and_scans(spark):
    raw = spark.createDataFrame([(b"a 1",), ("血糖 2".encode("gb18030"),), (b"\xff\xff 3",), (b"none",), (None,)], "content binary")
    got = [r.text for r in files.decoded(raw).collect()]
    assert got[:2] == ["a 1", "血糖 2"] and "3" in got[2] and got[3:] == ["", ""]
    scans = spark.createDataFrame([(1, [" a ", "b", "", "c"], [0.4, None, 0.9], [[1.0]])], "page int, texts array<string>, scores array<double>, boxes array<array<double>>")
    assert [(r.line, r.score, r.box) for r in files.scan_lines(scans).collect()] == [("b", 1.0, None), ("c", 1.0, None)]


def test_ledger(spark, tmp_path):
    path, at = str(tmp_path / "runs"), datetime.datetime(2025, 1, 1)
    assert ledger.read_or_empty(spark, path, ledger.RUNS).count() == 0
    first, second = (ledger.begin_run(spark, path, d, "m", at) for d in "ab")
    ledger.complete_run(spark, path, first, at + datetime.timedelta(hours=1), 5)
    got = {r.run_id: r for r in ledger.runs(ledger.read_or_empty(spark, path, ledger.RUNS)).collect()}
    assert (got[first].state, got[first].n_chunks, got[first].document_id, got[second].state, got[second].ended) == ("success", 5, "a", "running", None)

    table = str(tmp_path / "table")
    for n in (3, 4):
        ledger.write_version(spark.range(n), table, at + datetime.timedelta(days=n))
    assert ledger.read_version(spark, table).count() == 4
    seed = spark.createDataFrame([(1,)], "k long")
    assert [ledger.seeded(spark, str(tmp_path / "seed"), "k long", seed).count() for _ in range(2)] == [1, 1]
    event = ledger.audit_events(seed, F.lit("u"), "row.add", F.lit(at), "k").first()
    assert (event.user_id, event.action, event.detail) == ("u", "row.add", '{"k":1}')
    owned = spark.createDataFrame([(1, "u"), (2, "v")], "k int, user_id string")
    assert [ledger.by_key(owned, "k", 2, user).count() for user in (None, "v", "u")] == [1, 1, 0]
    assert one(spark, ledger.ordered_union(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("c")))) == ["b", "a", "c"]
    assert [r.id for r in ledger.positions(spark.range(5), 1, 3, "id").orderBy("id").collect()] == [1, 2]
    pace = ledger.page_pace(spark.createDataFrame([("d", at, at + datetime.timedelta(seconds=s)) for s in (1, 3)], "document_id string, began timestamp, ended timestamp")).first()
    assert (pace.n_pages, pace.mean_seconds) == (2, 2.0)
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert ledger.file_digest(spark, str(tmp_path / "f.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    m = ledger.manifest_row(spark.range(2), spark.range(2), "m", 4, 0, 2, "h", "cpu")
    assert suites.manifest_suite(m, "m", 4, 2, "h").first().reasons == []
    vectors = lambda *rows: spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    assert ledger.upserted_vectors(vectors(("a", [1.0, 0.0])), vectors(("a", [0.0, 1.0])), 2).first().embedding == [0.0, 1.0]
    with pytest.raises(Exception, match="norm"):
        ledger.upserted_vectors(vectors(("a", [1.0, 0.0])), vectors(("b", [3.0, 1.0])), 2).collect()


def test_embedding_and_reranking(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, ""), (3, None)], "k int, said string")
    got = retrieval.embedded(texts, "said", retrieval.hashing_encoder(64), 64, "q: ").orderBy("k").collect()
    assert np.allclose([np.linalg.norm(r.embedding) for r in got], 1) and got[1].embedding == got[2].embedding != got[0].embedding
    with pytest.raises(Exception, match="finite"):
        retrieval.embedded(texts, "said", lambda: lambda said: np.zeros((len(said), 16)), 16).collect()
    hits = spark.createDataFrame([(1, "q", 10, "aa", 1), (1, "q", 11, "a", 2)], "question_id int, question string, chunk_id int, content string, rank int")
    assert [(r.chunk_id, r.score) for r in retrieval.reranked(hits, None, 5).orderBy("rank").collect()] == [(10, 0.0), (11, 0.0)]
    shortest = lambda questions, contents: [-len(c) for c in contents]
    assert [r.chunk_id for r in retrieval.reranked(hits, shortest, 1).collect()] == [11]


def test_searches_equal_plain_rules(spark):
    """Several batches of questions, repeated and empty terms, null columns, ties; each pair by substring tests."""
    said = ["ab cd ab", "", None, "zz", "cd", "x1 ab cd"]
    questions = spark.createDataFrame([(i, q, ["t"] if i % 2 else None) for i, q in enumerate(said)], "question_id int, question string, tags array<string>")
    held = [(i, "AB" if i % 3 else None, "s cd" if i % 4 == 0 else "s", "k", "x ab cdab" if i % 2 else "cd", ["t", "t"] if i % 5 == 0 else None, i != 7) for i in range(24)]
    chunks = spark.createDataFrame(held, "chunk_id int, title string, section string, category string, content string, chunk_tags array<string>, searchable boolean")
    words = lambda q: [w for w in q.split() if len(w) >= 2]
    low = lambda x: (x or "").lower()

    def best(score, k):
        out = set()
        for i, q in enumerate(said):
            worth = sorted((-score(i, q, c), c[0]) for c in held if c[6] and q is not None and score(i, q, c) > 0)
            out |= {(i, c, -s) for s, c in worth[:k]}
        return out

    lexical = lambda i, q, c: sum(8 * (w in low(c[1])) + 9 * (w in low(c[2])) + 3 * (w in low(c[4])) for w in set(words(q)))
    got = retrieval.lexical_search(questions, chunks, 5, batch=2)
    assert {(r.question_id, r.chunk_id, r.score) for r in got.collect()} == best(lexical, 5)

    def fallback(i, q, c):
        hay = " ".join(low(x) for x in (*c[1:5], " ".join(c[5] or [])) if x is not None)
        return 4 * (q in hay) + 2 * sum(w in hay for w in words(q)) + 0.5 * (i % 2 == 1 and c[5] is not None)

    got = {(r.question_id, r.chunk_id, r.score) for r in retrieval.fallback_search(questions, chunks, 5, batch=2).collect() if said[r.question_id] is not None}
    assert got == best(fallback, 5)
