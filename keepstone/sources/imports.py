"""Readers of foreign formats. Each gives content, tags, source, priority and what the format adds."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions.context import bound

NO_TAGS = "array<string>"
#: Rows of a database that are handed on at once.
ROWS = 5_000
_FIELD = pa.struct([("key", pa.string()), ("value", pa.string())])


def _tags(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(NO_TAGS))


def _rows(d: DataFrame, source: str, least: int = 5) -> DataFrame:
    return d.where(F.length("content") >= least).select("content", _tags(F.col("tags")).alias("tags"), F.coalesce("source", F.lit(source)).alias("source"), F.coalesce("priority", F.lit(0.5)).alias("priority"))


_RECORD = "content string, tags array<string>, source string, priority double"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; broken lines and contents under five characters are left out."""
    d = spark.read.text(path).select(F.from_json("value", _RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return _rows(d.withColumn("content", F.trim("content")), "jsonl")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array of objects, or one object, in each file."""
    return _rows(spark.read.schema(_RECORD).json(path, multiLine=True), "json")


def read_csv(spark: SparkSession, path: str, content: str = "content", tag: str | None = None, source: str | None = None) -> DataFrame:
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    tags = F.array_compact(F.array(F.nullif(F.trim(F.col(tag)), F.lit("")))) if tag else F.lit(None).cast(NO_TAGS)
    return _rows(d.select(F.trim(F.col(content)).alias("content"), tags.alias("tags"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"), F.lit(None).cast("double").alias("priority")), "csv")


def frontmatter(text: Column) -> tuple[Column, Column]:
    """The block between two lines of three dashes at the beginning, and the rest."""
    whole = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    has = text.rlike(whole)
    return F.when(has, F.regexp_extract(text, whole, 1)).otherwise(""), F.btrim(F.when(has, F.regexp_extract(text, whole, 2)).otherwise(text), F.lit(" \t\r\n"))


def header(block: Column, key: str) -> Column:
    v = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.when(v != "", F.regexp_replace(v, r"^[\"']|[\"']$", ""))


def header_list(block: Column, key: str) -> Column:
    inner = F.regexp_replace(header(block, key), r"[\[\]\"']", "")
    return F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda t: t != "")


def read_markdown(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """One memory a file with its frontmatter's id, tags, source and priority; ids in ``known`` (id) are left out."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    block, body = frontmatter(F.col("value"))
    d = t.select(header(block, "id").alias("id"), body.alias("content"), _tags(header_list(block, "tags")).alias("tags"), F.coalesce(header(block, "source"), F.lit("markdown")).alias("source"), F.coalesce(header(block, "priority").try_cast("double"), F.lit(0.5)).alias("priority"))
    d = d.where(F.length("content") >= 5)
    return d if known is None else d.join(known, "id", "left_anti")


def read_logseq(spark: SparkSession, path: str) -> DataFrame:
    """Pages of bullets; a line ``tags:: a, b`` gives the tags."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    lines = F.split("value", r"\r?\n")
    tags = F.regexp_extract("value", r"(?m)^\s*-?\s*tags::[ \t]*(.*)$", 1)
    kept = F.filter(F.transform(F.filter(lines, lambda x: ~x.rlike(r"^\s*-?\s*[\w-]+::")), lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s?", ""))), lambda x: x != "")
    d = t.select(F.array_join(kept, "\n").alias("content"), F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(F.regexp_replace(x, r"[\[\]#]", ""))), lambda x: x != "").alias("tags"), F.lit("logseq").alias("source"), F.lit(0.5).alias("priority"))
    return d.where(F.length("content") >= 5)


def _notion_pages(files: DataFrame) -> DataFrame:
    """Pages of (value): the first heading is the abstract; block ids, empty links and callout marks go; tags come from up to five properties."""
    whole = F.btrim("value", F.lit(" \t\r\n"))
    lines = F.split(whole, r"\r?\n")
    title = F.coalesce(F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), 0), F.lit(""))
    body = F.regexp_replace(whole, r"\n[a-f0-9]{32}\n", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"\[([^\]]*)\]\(\)", "$1"), "(?m)^[\U0001f4a1\U0001f4cc\u26a0\ufe0f\u2139\U0001f525]\\s*", "")
    found = F.slice(F.regexp_extract_all(body, F.lit(r"(?m)^\w+:\s*.+$"), F.lit(0)), 1, 5)
    wanted = F.filter(found, lambda x: F.lower(F.regexp_extract(x, r"^(\w+):", 1)).isin("tags", "category", "type", "status"))
    tags = F.flatten(F.transform(wanted, lambda x: _cut(F.regexp_replace(x, r"^\w+:\s*", ""))))
    return files.select(F.trim(F.substring(title, 3, 1 << 30)).alias("l3"), F.btrim(body, F.lit(" \t\r\n")).alias("content"), F.concat(F.array(F.lit("notion")), tags).alias("tags"))


def _cut(listed: Column) -> Column:
    return F.filter(F.transform(F.split(listed, ","), lambda t: F.trim(t)), lambda t: t != "")


def _notion_rows(rows: DataFrame) -> DataFrame:
    """Rows of a database as (fields: array of (key, value)): names head them, tags and categories are tags, others are listed."""
    some = F.filter("fields", lambda f: F.trim(f["value"]) != "")
    is_title = lambda f: F.lower(f["key"]).isin("name", "title")
    is_tag = lambda f: F.lower(f["key"]).isin("tags", "category")
    titles = F.reverse(F.transform(F.filter(some, is_title), lambda f: F.trim(f["value"])))
    told = F.transform(F.filter(some, lambda f: ~is_title(f) & ~is_tag(f)), lambda f: F.concat(F.lit("**"), f["key"], F.lit("**: "), F.trim(f["value"])))
    text = F.array_join(F.concat(F.transform(titles, lambda t: F.concat(F.lit("# "), t)), told), "\n")
    tags = F.flatten(F.transform(F.filter(some, is_tag), lambda f: _cut(f["value"])))
    return rows.select(F.coalesce(F.get(titles, 0), F.lit("")).alias("l3"), text.alias("content"), F.concat(F.array(F.lit("notion")), tags).alias("tags"))


def read_notion(spark: SparkSession, path: str) -> DataFrame:
    """Pages (.md) and databases (.csv, one memory a row) of an export: a folder, or zip archives, each unpacked by one task. Contents of 20 characters at least."""
    read = spark.read.option("recursiveFileLookup", "true")
    files = read.format("binaryFile").option("pathGlobFilter", "*.{md,csv,zip}").load(path).select("path", "content")

    def members(parts: Iterator[pa.RecordBatch], kind: str) -> Iterator[bytes]:
        for b in parts:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name.endswith(kind):
                    yield data.as_py()
                elif name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                        yield from (z.read(n) for n in z.namelist() if n.endswith(kind))

    def pages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in members(parts, ".md"):
            yield pa.RecordBatch.from_arrays([pa.array([body.decode("utf-8", "replace")], pa.string())], ["value"])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in members(parts, ".csv"):
            told = csv.DictReader(io.TextIOWrapper(io.BytesIO(body), "utf-8", "replace", newline="\n"))
            for some in batched(told, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([[(k, v or "") for k, v in row.items() if k] for row in some], pa.list_(_FIELD))], ["fields"])

    md = files.where("NOT endswith(path, '.csv')").mapInArrow(pages, "value string")
    database = files.where("NOT endswith(path, '.md')").mapInArrow(rows, "fields array<struct<key: string, value: string>>")
    out = _notion_pages(md).unionByName(_notion_rows(database))
    return out.select("l3", "content", "tags", F.lit("notion").alias("source"), F.lit(0.5).alias("priority")).where(F.length("content") >= 20)


_CHAT = "title string, mapping map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>"


def read_chat_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Exports of conversations as a mapping of nodes: the assistant's messages of ten characters at least."""
    c = spark.read.schema(_CHAT).json(path, multiLine=True)  # one file is one task, its conversations are rows
    m = c.select("title", F.explode(F.map_values("mapping")).alias("n")).where(F.col("n.message.author.role") == "assistant")
    return m.select(F.trim(F.array_join("n.message.content.parts", "\n")).alias("content"), F.array().cast(NO_TAGS).alias("tags"), F.coalesce("title", F.lit("")).alias("title"), F.lit("chat").alias("source"), F.lit(0.5).alias("priority")).where(F.length("content") >= 10)


_MESSAGE = "struct<sender:string,role:string,text:string,content:string>"


def read_chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Exports of conversations as lists of messages; contents are texts or lists of parts with a text."""
    c = spark.read.schema(f"name string, chat_messages array<{_MESSAGE}>, messages array<{_MESSAGE}>").json(path, multiLine=True)  # one file is one task
    m = c.select("name", F.explode(F.coalesce("chat_messages", "messages")).alias("m")).where(F.lower(F.coalesce("m.sender", "m.role")).isin("assistant", "ai"))
    parts = F.from_json("m.content", "array<struct<text:string>>")
    body = F.coalesce(F.col("m.text"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), F.col("m.content"))
    return m.select(F.trim(body).alias("content"), F.array().cast(NO_TAGS).alias("tags"), F.coalesce("name", F.lit("")).alias("title"), F.lit("chat").alias("source"), F.lit(0.5).alias("priority")).where(F.length("content") >= 10)


def _bare(html: Column) -> Column:
    """Html without scripts, styles, heads, menus, footers and comments."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head|nav|footer)\b.*?</\1>", " "), r"(?s)<!--.*?-->", " ")


def _visible(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles, heads, menus and tags go, blanks are joined."""
    return _visible(_bare(html))


#: Tags that begin or end a block of text.
BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|aside|header|article|main|blockquote|pre|form|figure|body|html)\b[^>]*>"
#: Words of dense blocks in all that make them the content of a page.
DENSE = 25
LINK = r"(?is)<a\b[^>]*>(.*?)</a\s*>"


def _n_words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def dense_text(html: Column) -> Column:
    """The blocks of a page that are content by their length, their share of links and their neighbours', a line each.

    The rule is the decision tree of Kohlschütter, Fankhauser and Nejdl (Boilerplate detection using shallow text features, 2010) on
    words and the share of words in links of a block, the one before and the one after. Missing neighbours have no words.
    """
    cut = F.transform(F.split(_bare(html), BLOCK), lambda b: F.struct(_visible(b).alias("t"), _n_words(_visible(F.array_join(F.regexp_extract_all(b, F.lit(LINK), F.lit(1)), " "))).alias("l")))
    cut = F.transform(F.filter(cut, lambda b: b["t"] != ""), lambda b: F.struct(b["t"].alias("t"), _n_words(b["t"]).alias("n"), (b["l"] / _n_words(b["t"])).alias("d")))

    def kept(x: Column) -> Column:
        def content(b: Column, i: Column) -> Column:
            words = lambda j: F.coalesce(F.get(x, j)["n"], F.lit(0))
            linked = F.coalesce(F.get(x, i - 1)["d"], F.lit(0.0)) > 0.555556
            alone = (b["n"] > 16) | (words(i + 1) > 15) | (words(i - 1) > 4)
            after_links = (b["n"] > 40) | (words(i + 1) > 17)
            return (b["d"] <= 0.333333) & F.when(linked, after_links).otherwise(alone)

        return F.array_join(F.transform(F.filter(x, content), lambda b: b["t"]), "\n")

    return bound(cut, kept)


#: What holds the main content of a page, and where a page tells its date.
MAIN = r"(?is)<(?:main|article)\b[^>]*>(.*)</(?:main|article)\s*>"
DATED = r"(?is)(?:<meta\b[^>]*(?:published_time|[\"'](?:date|dc\.date|pubdate)[\"'])[^>]*content=[\"']|<time\b[^>]*datetime=[\"'])(\d{4}-\d{2}-\d{2})"


def main_text(html: Column) -> Column:
    """The visible text of a page's main part or article; without one its dense blocks, and if those have few words all of it."""
    inner = F.regexp_extract(html, MAIN, 1)
    dense = bound(F.when(inner == "", dense_text(html)), lambda t: F.when(F.size(F.split(t, r"\s")) > DENSE, t))
    return F.when(inner != "", html_text(inner)).otherwise(F.coalesce(dense, html_text(html)))


def web_pages(pages: DataFrame, least: int = 10) -> DataFrame:
    """One memory for each page (url, html) with ten characters or more: its date is a tag, its title (else the url) names the source."""
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.col("url"))
    day = F.regexp_extract("html", DATED, 1)
    tags = F.array_compact(F.array(F.lit("web"), F.lit("imported"), F.when(day != "", F.concat(F.lit("date:"), day))))
    d = pages.select("url", title.alias("title"), main_text(F.col("html")).alias("content"), tags.alias("tags")).where(F.length("content") >= least)
    return d.select("url", "title", "content", "tags", F.concat(F.lit("web:"), F.substring("title", 1, 100)).alias("source"), F.lit(0.5).alias("priority"))


# Commands that tell nothing by themselves; fixed values.
TRIVIAL_COMMANDS = "cd ls ll la clear exit quit pwd echo cat cls dir history whoami date true false : fg bg jobs popd pushd dirs type which alias unalias set unset export source .".split()


def interesting_command(command: Column) -> Column:
    """Whether a shell command is worth keeping: five characters, and not a trivial one (whatever its path) unless it pipes, redirects or has two options."""
    c = F.btrim(command, F.lit(" \t\r\n"))
    words = F.split(c, r"\s+")
    base = F.element_at(F.split(F.element_at(words, 1), "/"), -1)
    options = F.size(F.filter(F.slice(words, 2, F.size(words)), lambda w: F.startswith(w, F.lit("-"))))
    return (F.length(c) >= 5) & (~base.isin(TRIVIAL_COMMANDS) | c.rlike("[|<>]") | (options >= 2))


_PDF_STREAM = re.compile(rb"(\d+)\s+\d+\s+obj\b((?:(?!endobj).)*?)stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_PAGE = re.compile(rb"/Type\s*/Page\b(.*?)endobj", re.S)
_PDF_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\\.|[^\]])*\]\s*TJ|T\*|-?[\d.]+\s+-?[\d.]+\s+T[dD]", re.S)
_PDF_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return out.decode("utf-16-be", "replace")[1:] if out.startswith(b"\xfe\xff") else out.decode("latin-1")


def pdf_pages(data: bytes) -> list[str]:
    """Text that the content streams of a PDF's pages show in simple encodings; pages in the order of the file.

    Streams are plain or deflated; fonts with encodings of their own and encrypted files are beyond it.
    """
    streams = {}
    for number, head, body in _PDF_STREAM.findall(data):
        with contextlib.suppress(zlib.error):
            streams[number] = zlib.decompress(body) if b"/FlateDecode" in head else body
    pages = []
    for page in _PDF_PAGE.findall(data):
        at = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        text = ""
        for number in re.findall(rb"(\d+)\s+\d+\s+R", at[1]) if at else ():
            for shown in _PDF_SHOWN.findall(streams.get(number, b"")):
                strings = _PDF_STRING.findall(shown) if shown[:1] in b"([" else ()
                text += "".join(map(_pdf_string, strings)) if strings else "\n"
            text += "\n"
        pages.append(re.sub(r"\n+", "\n", text).strip())
    return pages


def read_pdf(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """One memory for each page with ten characters or more; its number is a tag. One file is one task's row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            for name, data in zip(d["path"], d["content"], strict=True):
                pages = [(i, t) for i, t in enumerate(pdf_pages(bytes(data)), 1) if len(t) >= 10]
                if pages:
                    yield pd.DataFrame({"content": [t for _, t in pages], "tags": [[*(tags or []), f"page:{i}"] for i, _ in pages], "source": [name.rsplit("/", 1)[-1]] * len(pages)})

    return files.mapInPandas(run, "content string, tags array<string>, source string").withColumn("priority", F.lit(0.5))


MAGIC, VERSION = b"\x89NPK", 1
_HEADER = struct.Struct("<4sBBI")


def pack_bytes(record: dict, body: bytes) -> bytes:
    """Magic, version, flags and length of the JSON head; the head; the compressed body; a CRC of all before."""
    head = json.dumps(record, ensure_ascii=False, sort_keys=True).encode()
    data = _HEADER.pack(MAGIC, VERSION, 0, len(head)) + head + zstandard.ZstdCompressor().compress(body)
    return data + struct.pack("<I", zlib.crc32(data))


def unpack_bytes(data: bytes) -> tuple[dict, bytes] | None:
    """The head and the body; None if magic, length or CRC are wrong."""
    if len(data) < _HEADER.size + 4 or not data.startswith(MAGIC) or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        return None
    _, _, _, n = _HEADER.unpack_from(data)
    try:
        return json.loads(data[_HEADER.size : _HEADER.size + n]), zstandard.ZstdDecompressor().decompress(data[_HEADER.size + n : -4])
    except (ValueError, zstandard.ZstdError):
        return None


def compressed(content: Column | str, level: int = 3) -> Column:
    """The whole text as zstd bytes; null for a null."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=level)
        for s in parts:
            yield s.map(lambda t: None if t is None else press.compress(t.encode()))

    return run(content)


def expanded(packed: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdDecompressor()
        for s in parts:
            yield s.map(lambda b: None if b is None else press.decompress(bytes(b)).decode())

    return run(packed)


def encode_pack(record: Column | str, content: Column | str) -> Column:
    """Packed form of a JSON text (the record) and a content."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for head, body in parts:
            yield pd.Series([pack_bytes(json.loads(h), (b or "").encode()) for h, b in zip(head, body, strict=True)])

    return run(record, content)


def decode_pack(packed: Column | str) -> Column:
    """record and content of packed bytes; nulls where they are damaged."""

    @F.pandas_udf("struct<record: string, content: string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [unpack_bytes(bytes(x)) if x is not None else None for x in s]
            yield pd.DataFrame({"record": [json.dumps(g[0], ensure_ascii=False, sort_keys=True) if g else None for g in got], "content": [g[1].decode() if g else None for g in got]})

    return run(packed)
