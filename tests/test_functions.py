import hashlib
import re
import uuid

from pyspark.sql import functions as F

from evidenza.functions import health, text
from evidenza.operators import chunking, dialogue, profile, retrieval, tables
from evidenza.operators.stores import Stores, Table
from evidenza.sources import files
from evidenza.streaming.ingest import page_stream, upsert_stream


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "c string").select(column(F.col("c"))).collect()]


def test_golden_lines(spark):
    # The lines and what they parse to.
    cases = {
        "WBC 6.28 10^9/L 3.5-9.5": ("白细胞计数", 6.28, "10^9/L", 3.5, 9.5, "normal"),
        "HGB 168 g/L 130-175": ("血红蛋白", 168.0, "g/L", 130.0, 175.0, "normal"),
        "GLU 7.2 mmol/L 3.9-6.1": ("葡萄糖", 7.2, "mmol/L", 3.9, 6.1, "high"),
        "3. ALT <5 U/L 0-40": ("丙氨酸氨基转移酶", 5.0, "U/L", 0.0, 40.0, "low"),
        "Name 4.5": ("Name", 4.5, "", None, None, "unknown"),
    }
    cases |= {
        "2. TC 4.1 mmol/L 0-5.2 3.1-5.7": ("总胆固醇", 4.1, "mmol/L 0-5.2", 3.1, 5.7, "normal"),
        "PLT >300 10^9/L 100-300": ("血小板计数", 300.0, "10^9/L", 100.0, 300.0, "high"),
        "X 10^9 7 u": ("X 10^", 9.0, "7 u", None, None, "unknown"),
        "UA: 350 H umol/L 200~420": ("尿酸", 350.0, "umol/L", 200.0, 420.0, "normal"),
        "Item 5 " + "u" * 25: ("Item", 5.0, "", None, None, "unknown"),
        "no number": None,
        "12 3.5-9.5": None,
    }
    got = values(spark, health.parse_line, *cases)
    assert [x and tuple(x) for x in got] == list(cases.values())
    assert values(spark, health.metadata_name, "电 话", "WBC") == [True, False]


def test_cleaning_and_identity(spark):
    assert values(spark, text.clean_chunk, "a　 b\r\n\n  c\td ") == ["a b\nc d"]
    assert values(spark, text.clean_report, " a \n\n\n\nb") == ["a \n\nb"]
    assert values(spark, text.clean_scan, "中 文  a  b") == ["中文 a b"]
    assert values(spark, text.slug, " Type 2 Diabetes! ") == ["type_2_diabetes"]
    assert values(spark, text.uuid5, "x", "") == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("x", "")]
    assert values(spark, text.confidence, None, "0.25", "x") == [1.0, 0.25, 0.0]
    assert values(spark, lambda c: text.string_list(c), '["a"]', "{", None) == [["a"], [], []]


def test_status_edges(spark):
    rows = spark.createDataFrame([(3.5, 3.5, 9.5), (9.5, 3.5, 9.5), (9.6, 3.5, 9.5), (None, 1.0, 2.0), (1.0, 2.0, 1.0), (float("nan"), 1.0, 2.0)], "v double, l double, h double")
    c = [F.col(x) for x in "vlh"]
    assert [r[0] for r in rows.select(health.status(*c)).collect()] == ["normal", "normal", "high", "unknown", "unknown", "unknown"]
    assert [r[0] for r in rows.select(health.near_boundary(*c)).collect()] == [True, True, False, False, False, False]


def test_ages(spark):
    born = ["2024-07-01", "2007-07-01", "2007-06-30", "1960-06-30", "", "x", "2030-01-01"]
    age = lambda c: health.age_tag(health.age(c, F.lit("2025-06-30").cast("date")))
    assert values(spark, age, *born) == ["age_newborn", "age_child", "age_adult", "age_older_adult", None, None, "age_newborn"]


def test_chunks_cover_and_fit(spark):
    body = "\n".join(f"Line {i} end " + "word " * (i % 90) for i in range(120)) + "\n" + "。".join("字" * 300 for _ in range(6)) + "x" * 2000
    rows = spark.createDataFrame([("d", 1, "T", body), ("d", 2, "T", "short"), ("d", 3, None, None)], "document_id string, page int, title string, text string")
    got = chunking.chunked(rows).collect()
    long = sorted((r for r in got if r.page == 1), key=lambda r: r.chunk_index)
    assert all(len(r.content) <= 800 and r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() for r in got)
    assert [r.chunk_index for r in long] == list(range(long[0].chunk_count)) and len({r.chunk_id for r in got}) == len(got)
    together = "\n".join(r.content for r in long)
    assert all(f"Line {i} end" in together for i in range(120))
    assert [r.content for r in got if r.page == 2] == ["T\nshort"] and not [r for r in got if r.page == 3]


def assert_chunks_follow_rules(text, title, chunks):
    """Each chunk is the end of the one before and whole units; where it ends follows from target, most and what comes next."""
    used = len(title) + 1 if title else 0
    most = 800 - used if used < 800 else 800
    if len(text) <= most:
        assert chunks == [text]
        return
    units = [w for s in re.split(r"\n|(?<=[。！？；])", text) for line in [s.strip()] for i in range(0, len(line), most) if (w := line[i : i + most].strip())]
    if most < 100:  # chunks are single units, and equal ones are one
        assert chunks == list(dict.fromkeys(units)) and max(map(len, units)) <= most
        return
    # Every way to read a chunk as a tail of the last one and units that follow; some way through all chunks follows the rules.
    before, reached = "", {0}
    for n, chunk in enumerate(chunks):
        assert len(chunk) <= most
        leads = {before[-r:].strip() for r in range(1, min(100, most - 1) + 1)} | {""}
        ends = set()
        for at in reached:
            for end in range(at + 1, len(units) + 1):
                new = "\n".join(units[at:end])
                if not (chunk == new or chunk.endswith("\n" + new)):
                    continue
                closed = len(chunk) >= min(600, most) or end == len(units) or len(chunk) + 1 + len(units[end]) > most
                early = end - at > 1 and len(chunk) - len(units[end - 1]) - 1 >= min(600, most)
                if chunk[: -len(new)].removesuffix("\n") in leads and closed and not early:
                    ends.add(end)
        assert ends, (n, chunk, len(title))
        before, reached = chunk, ends
    assert len(units) in reached


def test_chunks_equal_plain_rules(spark):
    import random

    r = random.Random(1)
    rows = [(n, "T" * n, "\n".join("".join(r.choice("abcdef ") for _ in range(r.choice((3, 60, 300, 790, 790)))).strip() or "x" for _ in range(12))) for n in (0, 1, 50, 300, 798, 799, 800, 900) for _ in range(4)]
    pages = [("d", i, t, "\n".join(" ".join(line.split()) for line in x.split("\n"))) for i, (_, t, x) in enumerate(rows)]
    got = {}
    for c in chunking.chunked(spark.createDataFrame(pages, "document_id string, page int, title string, text string")).collect():
        got.setdefault(c.page, {})[c.chunk_index] = c.content
    for _, i, t, x in pages:
        said = [got[i][j] for j in sorted(got[i])]
        assert all(c.startswith(f"{t}\n") for c in said if t)
        assert_chunks_follow_rules(x, t, [c[len(t) + 1 if t else 0 :] for c in said])


def test_two_columns_and_rows(spark):
    columns = [(1, float(x), float(t), x + 30.0, t + 8.0) for x in (5, 60) for t in (110, 120, 130, 140)]
    # One spanning line at the top, one below the columns, and a wide line that doesn't cross the middle.
    spanning = [(1, 0.0, 100.0, 100.0, 108.0), (1, 10.0, 300.0, 90.0, 308.0), (1, 1.0, 150.0, 49.0, 158.0)]
    plain = [(2, 50.0, 5.0, 60.0, 9.0), (2, 1.0, 5.0, 9.0, 9.0), (2, 1.0, 1.0, 9.0, 3.0)]
    schema = "page int, left double, top double, right double, bottom double"
    df = spark.createDataFrame(columns + spanning + plain, schema).withColumns({"width": F.when(F.col("page") == 1, 100.0).otherwise(0.0), "height": F.lit(400.0)})
    got = [(r.page, r.left, r.top) for r in chunking.reading_order(df).orderBy("page", "position").collect()]
    want = [(0.0, 100.0), *[(5.0, t) for t in (110.0, 120.0, 130.0, 140.0)], (1.0, 150.0), *[(60.0, t) for t in (110.0, 120.0, 130.0, 140.0)], (10.0, 300.0)]
    assert got == [(1, *x) for x in want] + [(2, 1.0, 1.0), (2, 1.0, 5.0), (2, 50.0, 5.0)]
    boxes = spark.createDataFrame([(1, 0.0, 20.0, 9.0, "b"), (1, 4.0, 24.0, 0.0, "a"), (1, 13.0, 33.0, 5.0, "c"), (1, 40.0, 42.0, 0.0, "d")], "page int, top double, bottom double, left double, text string")
    rows = chunking.row_clusters(boxes)
    # The mean centre is 12 after two lines; the third lies 11 away, within 0.6 of a mean height of 20.
    assert sorted((r.top, r.row) for r in rows.collect()) == [(0.0, 1), (4.0, 1), (13.0, 1), (40.0, 2)]
    assert sorted((r.row, r.text) for r in chunking.row_texts(rows).collect()) == [(1, "a c b"), (2, "d")]


def test_scan_lines_and_page_text(spark):
    assert values(spark, text.effective_line, "- 12 -", "—7", "12", "", "a 12") == [False, False, False, False, True]
    assert values(spark, text.clean_scan, "中\u1680文\ufeff a\u205fb\nc ") == ["中文 a b\nc"]
    assert values(spark, text.clean_body, "a\ra\n- 3 -\na\nb \nb\na") == ["a\nb\na"]
    assert values(spark, text.picked_title, "x\n12\nTitle here\nmore") == ["Title here"]
    page = spark.createDataFrame([("T", "T\nbody", " ", "fig", "s"), (" ", "", None, "", "PDF第4页\nfound")], "title string, body string, tab string, fig string, search string")
    title = text.section_title(F.col("title"), F.lit(4))
    got = [r[0] for r in page.select(text.page_text(title, *[F.col(c) for c in ("body", "tab", "fig", "search")])).collect()]
    assert got == ["body\n\nfig", "found"]
    assert [r[0] for r in page.select(text.page_tags(F.lit(4), F.lit("m"), F.nullif(F.col("title"), F.lit(" ")))).collect()] == [["source:msd", "pdf_page:4", "model:m", "printed_page:T"], ["source:msd", "pdf_page:4", "model:m"]]


def test_upserts_keep_one_row_a_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], [F.desc("v")]).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(tuple(r) for r in tables.insert_absent(old, new, ["k"], [F.col("v")]).collect()) == [(1, "a"), (2, "b"), (3, "w")]
    assert tables.upsert(old, new, ["k"]).count() == 3


def test_lenient_lines(spark, tmp_path):
    import pytest

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n[1]\n3\n{"k": 2}\n')
    assert sorted(r.k for r in files.jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k"\n')
    with pytest.raises(Exception, match="not JSON"):
        files.jsonl_lenient(spark, str(tmp_path / "b.jsonl"), "k int").collect()


def test_red_flags_and_policy(spark):
    assert values(spark, dialogue.has_red_flag, "Sudden CHEST PAIN", "我胸痛", "fine") == [True, True, False]


def test_hydration_fails_on_a_missing_row(spark):
    import pytest

    ids, rows = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no row for 2"):
        tables.hydrated(ids, rows, "k", "v").collect()
    assert tables.missing_columns(rows, {"k": "int", "v": "int", "w": "int"}) == ["v", "w"]


def test_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n[1]\n{"k": "x"\n{"k": 2}\n')
    good, bad = files.jsonl_strict(spark, str(tmp_path / "a.jsonl"), "k int")
    assert sorted(r.k for r in good.collect()) == [1, 2] and bad.count() == 2
    np.savez(tmp_path / "e.npz", embeddings=np.eye(2, 4, dtype="float32"), chunk_ids=["a", "b"], content_hashes=["x", "y"], pdf_pages=np.array([1, 2]))
    assert [(r.chunk_id, r.pdf_page, len(r.embedding)) for r in files.embedding_bundle(spark, str(tmp_path / "e.npz")).orderBy("ordinal").collect()] == [("a", 1, 4), ("b", 2, 4)]
    (tmp_path / "l.json").write_text('{"content_list": [{"type": "text", "text": "t", "page_idx": 0}, {"block_type": "x", "content": "", "page_no": 3}]}')
    assert [(r.kind, r.text, r.page) for r in files.layout_blocks(spark, str(tmp_path / "l.json")).collect()] == [("text", "t", 1)]
    assert [r.k for r in files.rows_in_order(good, "k", [2, 9, 1]).collect()] == [2, 1]


def test_stream_upsert(spark, tmp_path):
    source, stores = tmp_path / "in", Stores(spark, str(tmp_path / "out"), {"pages": Table("k int, v int", ["k"])}, 4)
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text(f'{{"k": 1, "v": {i}}}\n{{"k": {i + 5}, "v": 9}}\n')
        q = upsert_stream(page_stream(spark, str(source), "k int, v int"), stores, "pages", "v", str(tmp_path / "cp"))
        q.awaitTermination()
    assert stores.state()["number"] == 2
    assert sorted(tuple(r) for r in stores.read("pages").collect()) == [(1, 1), (5, 9), (6, 9)]


def test_profile_keywords(spark):
    none = []
    rows = [
        (1, ["age_adult", "smoking_current", "bmi_obesity", "x"], ["慢性 过敏性鼻炎", "糖尿病"], ["青霉素"], ["unknown", None, " "], none, ["头痛、发热", "头痛"], "current", "none", None, "good", "x"),
        (2, None, None, none, none, none, none, None, None, None, None, None),
    ]
    fields = ["chronic_conditions", "allergies", "current_medications", "family_history", "recent_symptoms"]
    schema = "k int, tags array<string>, " + ", ".join(f"{f} array<string>" for f in fields) + ", " + ", ".join(f"{f} string" for f in profile.HABITS)
    got = [tuple(r) for r in profile.profile_keywords(spark.createDataFrame(rows, schema), "k").orderBy("rank").collect()]
    want = [
        ("慢性 过敏性鼻炎", "condition", 2.2), ("糖尿病", "condition", 2.2), ("头痛", "symptom", 2.1), ("头痛、发热", "symptom", 2.1), ("青霉素", "allergy", 1.8),
        ("不饮酒", "lifestyle", 1.3), ("当前吸烟", "lifestyle", 1.3), ("睡眠良好", "lifestyle", 1.3), ("成人", "demographic", 1.1), ("肥胖", "derived", 1.0),
    ]
    assert [(k, c, s) for _, _, k, c, s, _ in got] == want and [r[1] for r in got] == list(range(1, 11))
    assert {r[2]: r[5] for r in got}["当前吸烟"] == "profile_tags"


def test_vector_search_in_batches(spark):
    import numpy as np
    import pytest

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, v[5].tolist())], "chunk_id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(20)], "question_id long, vector array<double>")
    for batch in (1000, 7):
        got = {}
        for r in retrieval.vector_search(asked, vectors, 4, batch).collect():
            got.setdefault(r.question_id, {})[r.rank] = r.chunk_id
        for q in range(20):
            ids = sorted([*range(300), 301], key=lambda i: (-round(float(v[5 if i == 301 else i] @ v[q]), 6), i))[:4]
            assert [got[q][n] for n in (1, 2, 3, 4)] == ids
    with pytest.raises(Exception, match="finite and not zero"):
        retrieval.vector_search(spark.createDataFrame([(1, [0.0] * 6)], "question_id long, vector array<double>"), vectors).collect()


def test_names_units_and_digits_of_scans(spark):
    from evidenza.functions import health, text

    names = {"1. WBC": "白细胞计数", "序号 12 GLU H": "葡萄糖", "X: ↑": "X", "x H:": "x", "H": "", "１２、Y": "、Y", "GLU-H": "GLU-H", "a H H": "a H", "": "", "  - b /": "b", "z" * 70: "z" * 60, "lo": "", "Hi x": "Hi x"}
    units = {"mmol/L H": "mmol/L", " ↑ g/L": "g/L", "：U/L，": "U/L", "x" * 25: "", "": "", "L": "", "10^9/L l": "10^9/L"}
    for given, of in ((names, health.item_name), (units, health.item_unit)):
        rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", of(F.col("t")).alias("x")).collect()
        assert {r.t: r.x for r in rows} == given
    lines = spark.createDataFrame([("血糖 ７.２ mmol/L 3.9－６.1",)], "t string")
    got = lines.select(health.parse_line(F.col("t")).alias("x"), health.candidate_line(F.lit("血糖 ７２")).alias("c")).first()
    assert (got.x.name, got.x.value, got.x.unit, got.x.low, got.x.high, got.x.status, got.c) == ("血糖", 7.2, "mmol/L", 3.9, 6.1, "high", True)
    numbers = [0.0, 1.0, 5.25, 1e7, 12345678.9, 0.0001, 0.00012, 0.001, 1e15, 1e16, 1.5e16, 1e-5, 1.5e-7, -0.0002, -1e8, 123456789012345.6, 1e22, 1e-10]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", text.number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == {x: repr(x) for x in numbers}
