"""Importers, exporters and streams over small files."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keepstone.sources import exports, imports
from keepstone.streaming import activity


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "x.jsonl", '{"content": "a longer text", "tags": ["t"]}\nnot json\n{"content": "abc"}\n{"content": "another one", "priority": 0.9}\n')
    got = imports.read_jsonl(spark, p).collect()
    assert [(r["content"], r["tags"], r["priority"]) for r in got] == [("a longer text", ["t"], 0.5), ("another one", [], 0.9)]


def test_json_array_and_csv(spark, tmp_path):
    p = put(tmp_path / "x.json", json.dumps([{"content": "first text", "tags": ["a"]}, {"content": "x"}]))
    assert [r["content"] for r in imports.read_json_array(spark, p).collect()] == ["first text"]
    p = put(tmp_path / "x.csv", 'content,category\n"a text, with comma",news\nabc,x\nplain text,\n')
    assert [(r["content"], r["tags"]) for r in imports.read_csv(spark, p, tag="category").orderBy("content").collect()] == [("a text, with comma", ["news"]), ("plain text", [])]


def test_markdown_round_trip_and_known_ids(spark, tmp_path):
    m = spark.createDataFrame([(1, "body of one", ["a", "b"], "src", 0.7), (2, "body of two", [], "src", 0.5)], "id long, content string, tags array<string>, source string, priority double")
    for r in exports.markdown(m).collect():
        put(tmp_path / "md" / r["name"], r["body"])
    got = imports.read_markdown(spark, str(tmp_path / "md"), spark.createDataFrame([("2",)], "id string")).collect()
    assert [(r["id"], r["content"], r["tags"], r["priority"]) for r in got] == [("1", "body of one", ["a", "b"], 0.7)]


def test_logseq_and_notion(spark, tmp_path):
    put(tmp_path / "l" / "p.md", "tags:: x, [[y]]\n- first point\n  - second point\n")
    got = imports.read_logseq(spark, str(tmp_path / "l")).first()
    assert got["content"] == "first point\nsecond point" and got["tags"] == ["x", "y"]
    put(tmp_path / "n" / "p.md", "# My Page 0123456789abcdef0123456789abcdef\n\nTags: Big Idea, b\n\n\n\nThe body of the page.\n")
    got = imports.read_notion(spark, str(tmp_path / "n")).first()
    assert got["l3"] == "My Page 0123456789abcdef0123456789abcdef" and got["tags"] == ["notion", "Big Idea", "b"]


def test_chats(spark, tmp_path):
    node = lambda role, text: {"message": {"author": {"role": role}, "content": {"parts": [text]}}}
    p = put(tmp_path / "c.json", json.dumps([{"title": "T", "mapping": {"1": node("assistant", "an answer of some length"), "2": node("user", "a question of some length"), "3": {"message": None}}}]))
    assert [(r["title"], r["content"]) for r in imports.read_chat_mapping(spark, p).collect()] == [("T", "an answer of some length")]
    p = put(tmp_path / "d.json", json.dumps([{"name": "N", "chat_messages": [{"sender": "assistant", "text": "a reply of some length"}, {"sender": "human", "text": "a question of some length"}]}, {"name": "M", "messages": [{"role": "AI", "content": [{"text": "part one"}, {"text": "part two"}]}]}]))
    assert {r["content"] for r in imports.read_chat_messages(spark, p).collect()} == {"a reply of some length", "part one\npart two"}


def test_pack(spark):
    data = imports.pack_bytes({"id": 1}, b"body")
    assert imports.unpack_bytes(data) == ({"id": 1}, b"body") and imports.unpack_bytes(data[:-1]) is None and imports.unpack_bytes(b"x") is None
    broken = bytearray(data)
    broken[12] ^= 1
    assert imports.unpack_bytes(bytes(broken)) is None


def test_html_and_commands(spark):
    d = spark.createDataFrame([("<html><head><title>T</title></head><body><nav>menu</nav><p>Hi &amp; bye &lt;x&gt;</p><script>x()</script></body></html>",)], "html string")
    assert d.select(imports.html_text(F.col("html"))).first()[0] == "Hi & bye <x>"
    c = spark.createDataFrame([("ls",), ("ls -la | grep x",), ("git commit -m x",), ("cd src",), ("ls --all -l",)], "c string")
    assert [r["c"] for r in c.where(imports.interesting_command(F.col("c"))).collect()] == ["ls -la | grep x", "git commit -m x", "ls --all -l"]


def test_main_contents_of_pages(spark):
    rows = [
        ("u1", '<html><head><title> T </title><meta property="article:published_time" content="2024-03-05T10:00"></head><body><div class="ad">buy this now</div><article><h1>Head</h1><p>The story &amp; more</p></article><div>other things</div></body></html>'),
        ("u2", "<html><body><p>No article in this page</p><time datetime='2023-01-02'>then</time></body></html>"),
        ("u3", "<p>short</p>"),
    ]
    got = {r["url"]: r for r in imports.web_pages(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got.keys() == {"u1", "u2"}
    assert (got["u1"]["title"], got["u1"]["content"], got["u1"]["tags"], got["u1"]["source"]) == ("T", "Head The story & more", ["web", "imported", "date:2024-03-05"], "web:T")
    assert (got["u2"]["title"], got["u2"]["content"], got["u2"]["tags"]) == ("u2", "No article in this page then", ["web", "imported", "date:2023-01-02"])


def test_training_formats(spark):
    m = spark.createDataFrame([(1, "c1", "l1", ["f1", "f2"], ["t"]), (2, "c2", "", ["f3"], []), (3, "c3", "l3", ["f4"], ["t", "u"])], "id long, content string, l3 string, l2 array<string>, tags array<string>")
    assert [json.loads(r["line"])["messages"][1]["content"] for r in exports.fine_tuning(m, "Tell me: ").orderBy("id").collect()] == ["Tell me: l1", "Tell me: l3"]
    assert {r["tag"]: r["answer"] for r in exports.questions_by_tag(m).collect()} == {"t": "f1 f2 f4", "general": "f3"}


def run_stream(spark, frame, made, tmp_path, mode="append"):
    src = str(tmp_path / "src")
    frame.coalesce(1).write.parquet(src)
    q = made(spark.readStream.schema(frame.schema).parquet(src)).writeStream.outputMode(mode).format("memory").queryName("out" + tmp_path.name.replace("-", "_")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out" + tmp_path.name.replace("-", "_")).collect()


def test_debounced_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a.py", t), ("a.py", t + timedelta(seconds=0.4)), ("a.py", t + timedelta(seconds=1.5)), ("b.py", t), ("c.exe", t)]
    got = run_stream(spark, spark.createDataFrame(rows, "path string, ts timestamp"), lambda s: activity.debounced(activity.file_events(s)), tmp_path)
    assert sorted((r["path"], r["ts"]) for r in got) == [("a.py", t), ("a.py", t + timedelta(seconds=1.5)), ("b.py", t)]


def test_head_changes_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("r", t + timedelta(seconds=i), h) for i, h in enumerate("aabbc")]
    got = run_stream(spark, spark.createDataFrame(rows, "repo string, ts timestamp, head string"), activity.head_changes, tmp_path)
    assert [(r["old"], r["new"]) for r in got] == [("a", "b"), ("b", "c")]


def test_notion_databases_are_handed_on_in_batches(spark, tmp_path):
    rows = "".join(f'"Row {i}","a long note of {i},\nand a second line"\n' for i in range(1_200))
    for k in range(2):
        put(tmp_path / f"n/d{k}.csv", "Name,Note\n" + rows)
    put(tmp_path / "n/p.md", "# Page\nsome text that is long enough")
    d = imports.read_notion(spark, str(tmp_path / "n"))
    assert d.where("l3 = 'Page'").count() == 1
    assert d.where("l3 = 'Row 7'").select("content").collect()[1]["content"] == "# Row 7\n**Note**: a long note of 7,\nand a second line"
    assert d.count() == 2_401
    assert "MapInPandas" not in d._jdf.queryExecution().toString()  # a frame for each row before


def test_arrays_are_cut_into_files(spark, tmp_path):
    path = str(tmp_path / "a")
    for n in (0, 1, 9, 10, 11, 35):
        d = spark.range(n).coalesce(1).select(F.to_json(F.struct(F.concat(F.lit("content "), F.col("id").cast("string")).alias("content"))).alias("line"))
        exports.write_arrays(d, path, most=10)
        files = [json.loads(f.read_text()) for f in (tmp_path / "a").glob("part-*")]
        assert [len(f) for f in files if f] and max(map(len, files)) <= 10 if n else not any(files)
        assert sorted(x["content"] for f in files for x in f) == sorted(f"content {i}" for i in range(n))
        assert imports.read_json_array(spark, path).count() == n
