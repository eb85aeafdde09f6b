import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pagequern.extract.page import extract as extract_one
from pagequern.functions import urls as U
from pagequern.operators import pages as P
from pagequern.plans import registry
from pagequern.sources import files, web

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_evaluation_without_shuffle_and_with_pushdown(spark):
    found = P.extract(spark.read.parquet(f"{SF}/pages.parquet")).where("url LIKE 'https://a%'").select("page_id", "title", "author")
    plan = plan_of(found)
    assert plan.count("ArrowEvalPython [") == 1 and "Exchange" not in plan and "StringStartsWith(url,https://a)" in plan


def test_unused_extraction_is_pruned(spark):
    plan = plan_of(P.extract(spark.read.parquet(f"{SF}/pages.parquet")).select("url"))
    assert "Python" not in plan and "html" not in plan.partition("ReadSchema")[2]


def test_batch_equals_single_pages(spark):
    rows = [(1, "https://a.example/", "<title>x</title><p>y"), (2, None, None), (3, "u", "")]
    got = P.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert [(r.title, r.content, r._error) for r in got] == [(e["title"], e["content"], None) for e in (extract_one(h, u) for _, u, h in rows)]


def test_nodes_contain_by_pre_and_post(spark):
    df = spark.createDataFrame([(1, "<div><p>ab <a href=x>cd</a></p></div>")], "page_id bigint, html string")
    n = {r.tag: r for r in P.nodes(df).collect()}
    assert n["div"].pre < n["a"].pre and n["div"].post > n["a"].post and n["a"].parent == n["p"].pre
    assert (n["p"].text_bytes, n["p"].link_bytes, n["a"].attrs) == (5, 2, {"href": "x"})


def test_sql_functions(spark):
    P.register_functions(spark)
    row = spark.sql("SELECT html_to_markdown('<p>a <b>b</b></p>') m, html_to_text('<p>a</p>') t, bbcode_to_html('[b]x[/b]') b, size(conversation_messages('', 'https://claude.ai/c')) n").first()
    assert tuple(row) == ("a **b**", "a", "<strong>x</strong>", 0)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_html_files_and_requests(spark, tmp_path):
    (tmp_path / "general--site.example.html").write_text("<p>a")
    (tmp_path / "x--other.html").write_text('<!-- {"url":"https://b.example/c"} -->\n<p>b')
    assert {r.url for r in files.read_html_files(spark, str(tmp_path)).collect()} == {"https://site.example", "https://b.example/c"}
    bodies = spark.createDataFrame([('{"html":"<p>x","url":"https://a.example"}',), ("{}",), ('{"html":""}',), ("nonsense",)], "value string")
    assert [r.error is None for r in files.parse_requests(bodies).collect()] == [True, False, False, False]
    files.write_json(spark.createDataFrame([(1, "a")], "page_id int, word_count string"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"pageId": 1, "wordCount": "a"}


def test_fetch_source(spark):
    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(b"<p>hi")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(web.FetchSource)
    read = lambda **o: {r.page_id: (r.html, r.error) for r in spark.read.format("pagequern_fetch").options(urls=json.dumps([f"{base}/ok", f"{base}/no", "ftp://x"]), **o).load().collect()}
    assert read(allowPrivate="true") == {0: ("<p>hi", None), 1: (None, "http: 404"), 2: (None, "blocked: not http or https")}
    assert read()[0] == (None, "blocked: private address")
    server.shutdown()


def test_guards_agree(spark):
    urls = ["http://10.1.2.3/", "https://example.com", "http://localhost", "http://[::1]/", "http://172.32.0.1/", "http://100.100.0.1/", "file:///x", "https://x.internal/", "http://[fe80::1]/", "http://8.8.8.8"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(U.may_be_fetched(F.col("url"))).collect()

    def allowed(url):
        try:
            web.check_address(url)
        except web.FetchError:
            return False
        return True

    assert [r[0] for r in got] == list(map(allowed, urls))


def test_event_counts_of_many_unordered_files(spark, tmp_path):
    from collections import Counter
    from datetime import datetime, timedelta, timezone

    import pyarrow as pa
    import pyarrow.parquet as pq

    from pagequern.plans.page_streams import stream_event_counts

    (tmp_path / "events.parquet").mkdir()
    begin, want = datetime(2024, 1, 1, tzinfo=timezone.utc), Counter()
    for n in range(130):
        hour = n * 37 % 130
        times = [begin + timedelta(hours=hour, minutes=m) for m in (0, 20, 59)]
        if hour + 1 <= 129 + 59 / 60 - 2:
            want[f"{times[0]:%Y-%m-%d %H:%M}", "a"] += 3
        table = {"event_id": pa.array(range(3), pa.int64()), "ts": pa.array(times, pa.timestamp("us", "UTC")), "user_id": pa.array([1] * 3, pa.int64()), "event_type": ["a"] * 3, "value": [1.0] * 3, "props": [""] * 3}
        pq.write_table(pa.table(table), tmp_path / "events.parquet" / f"part-{n:03}.parquet")
    got = {(r.hour, r.event_type): r.n_events for r in stream_event_counts(spark, str(tmp_path)).collect()}
    assert got == want


def test_small_tables_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(400).selectExpr("id AS page_id", "repeat('x', 2000) AS html").coalesce(1).write.parquet(f"{tmp_path}/one")
    dealt = P.spread(spark.read.parquet(f"{tmp_path}/one"))
    counts = dealt.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(counts) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in counts) < 200
    spark.range(400).repartition(16).write.parquet(f"{tmp_path}/many")
    assert "Exchange" not in plan_of(P.spread(spark.read.parquet(f"{tmp_path}/many")))


def test_requests_by_their_own_options(spark):
    bodies = [('{"html":"<body><p>x","options":{"markdown":true}}',), ('{"html":"<body><p>x","options":{"separate_markdown":true,"debug":null}}',), ('{"html":"<body><p>x"}',), ('{"html":5.5}',), ("",), (None,)]
    got = P.extract_requests(files.parse_requests(spark.createDataFrame(bodies, "value string"))).collect()
    page = "<html><head></head><body><p>x</p></body></html>"
    assert [(r.content, r.content_markdown) for r in got[:3]] == [("x", None), (page, "x"), (page, None)]
    assert all(r.content is None and r.error for r in got[4:])


def test_trees_of_deep_pages(spark):
    df = spark.createDataFrame([(1, "<div>" * 5000 + "x"), (2, None)], "page_id bigint, html string")
    found = P.nodes(df).where("page_id = 1").agg(F.count("*"), F.max("depth"), F.max("text_bytes")).first()
    assert found[0] == 5003 and found[1] < 600 and found[2] == 1
