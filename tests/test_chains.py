"""Page records to chunks and report texts to summaries, on literal rows."""

from pyspark.sql import functions as F

from evidenza.operators import chains, retrieval

REPORT = """姓名：张三 12
项目 结果 单位 参考范围 3
1. GLU：７.20 mmol/L 3.9-6.1 ↑
GLU 7.2 mmol/L 3.9-6.1
WBC 9.9 10^9/L 4-10
2、 TG 1.0 mmol/L 0-1.7
尿酸 0.0001 mmol/L 1-2
CREA 70 umol/L
"""


def test_report_chain(spark):
    texts = spark.createDataFrame([("r", REPORT), ("none", "no numbers here"), ("null", None)], "report_id string, text string")
    chunks = spark.createDataFrame([(1, "葡萄糖", "偏高"), (2, "白细胞计数", "参考"), (3, "尿酸", ""), (4, "其他", "健康")], "chunk_id long, title string, content string").withColumn("section", F.lit(""))
    out = chains.report_chain(texts, lambda asked, k: retrieval.lexical_search(asked, chunks, k))
    items = {(r.report_id, r.name): (r.value, r.unit, r.low, r.high, r.status) for r in out["items"].collect()}
    assert items["r", "葡萄糖"] == (7.2, "mmol/L", 3.9, 6.1, "high") and items["r", "尿酸"][-1] == "low"
    assert items["none", "OCR pending"][-1] == items["null", "OCR pending"][-1] == "unknown" and len(items) == 7
    assert items["r", "肌酐"][2:] == (None, None, "unknown")
    targets = [(r.item, r.name, r.status, r.is_near) for r in out["targets"].orderBy("item").collect()]
    assert targets == [(1, "葡萄糖", "high", False), (2, "尿酸", "low", False), (3, "白细胞计数", "normal", True)]
    context = [(r.place, r.chunk_id) for r in out["context"].orderBy("place").collect()]
    assert [c for _, c in context][0] == 1 and [p for p, _ in context] == list(range(1, len(context) + 1)) and {c for _, c in context} == {1, 2, 3, 4}
    assert {r.item: r.citations[0] for r in out["citations"].collect()} == {1: 1, 2: 3, 3: 2}
    said = {r.report_id: r for r in out["summaries"].collect()}
    assert (said["r"].status, said["r"].n_items, said["r"].n_abnormal, said["r"].risk_level) == ("completed", 5, 2, "unknown")
    assert "- 葡萄糖：偏高，结果 7.2 mmol/L\n- 尿酸：偏低，结果 0.0001 mmol/L\n- 另有 1 项" in said["r"].summary
    assert said["none"].status == said["null"].status == "rejected" and said["none"].summary is None


def test_repeated_items_are_looked_up_once(spark):
    from evidenza.operators import reports

    items = spark.createDataFrame([("r", i, "A", 9.0, "u", 1.0, 2.0) for i in range(9)] + [("r", 10, "B", 9.0, "u", 1.0, 2.0)], "report_id string, position int, name string, value double, unit string, low double, high double")
    got = reports.targets(items, "report_id", [F.col("position")], identity=chains.IDENTITY)
    assert sorted((r["rank"], r.name) for r in got.collect()) == [(1, "A"), (2, "B")]


def test_page_chain(spark):
    schema = "document_id string, pdf_page int, printed_page string, title string, body_text string, table_text string, figure_text string, search_text string, searchable boolean"
    rows = [
        ("d", 1, "i", "Title", "Title\nbody  text", "a table", None, "x", True), ("d", 2, None, None, None, None, None, "only search", True), ("d", 3, None, "T", "body", None, None, None, False),
        ("d", 4, None, "T", " ", "", None, "\n", True), ("d", 5, "", "Long", "\n".join("w" * 300 + str(i) for i in range(8)), None, None, None, True), ("e", 1, None, "T", None, None, None, None, None),
    ]
    chunks, counts = chains.chunked_pages(spark.createDataFrame(rows, schema), "model")
    got = {}
    for r in chunks.collect():
        got.setdefault(r.pdf_page, []).append(r)
    assert set(got) == {1, 2, 5}
    # A chunk drops blank lines, so parts come one below the other.
    assert [r.content for r in got[1]] == ["Title\nbody text\na table"] and got[1][0].tags == ["source:msd", "pdf_page:1", "model:model", "printed_page:i"]
    assert [(r.section_title, r.content, r.tags) for r in got[2]] == [("PDF第2页", "PDF第2页\nonly search", ["source:msd", "pdf_page:2", "model:model"])]
    assert sorted(r.chunk_index for r in got[5]) == list(range(got[5][0].chunk_count)) and len(got[5]) > 1 and all(len(r.content) <= 800 and r.content.startswith("Long\n") for r in got[5])
    said = {r.document_id: (r.n_pages, r.n_processable, r.n_skipped, r.n_with_chunks, r.n_chunks) for r in counts.collect()}
    assert said == {"d": (5, 3, 2, 3, 2 + len(got[5])), "e": (1, 0, 1, 0, 0)}


def test_lines_are_parsed_once(spark):
    """No plan of the chain holds the parser's patterns more often than one parse does, nor runs before it is asked for."""
    import re

    from evidenza.functions import health
    from evidenza.operators import reports

    texts = spark.createDataFrame([("r", REPORT)], "report_id string, text string").repartition(2)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    count = lambda df: len(re.findall("filter\\(array\\(transform", plan(df)))
    items = chains.report_items(texts)
    one = plan(texts.select(health.parse_line(F.col("text")).alias("i"))).count(health.RANGE)
    assert 0 < plan(items).count(health.RANGE) <= one and count(items) == 1
    assert count(chains.report_targets(items)) == 1 and count(reports.interpreted(texts, items)) == 1


def test_chunks_take_page_columns_along(spark):
    """Chunks are not joined with pages, texts go through one Python step, and its batches are small whatever Spark's are."""
    from evidenza.operators import chunking

    n = 2 * chunking.PAGES + 7
    pages = spark.range(n, numPartitions=1).select(
        F.lit("d").alias("document_id"), F.col("id").cast("int").alias("pdf_page"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("printed_page"), F.lit("T").alias("title"),
        F.repeat(F.lit("word "), F.when(F.col("id") % 3 == 0, 400).otherwise(1)).alias("body_text"), F.lit(None).cast("string").alias("table_text"), F.lit(None).cast("string").alias("figure_text"),
        F.lit("x").alias("search_text"), F.lit(True).alias("searchable"),
    )
    chunks = chains.chunked_pages(pages, "m")[0]
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    rows = chunks.collect()
    assert {r.pdf_page for r in rows} == set(range(n)) and all(r.printed_page == (None if r.pdf_page % 2 else str(r.pdf_page)) for r in rows)
    assert all(sum(r.pdf_page == p for r in rows) == rows_of for p, rows_of in {r.pdf_page: r.chunk_count for r in rows}.items())
