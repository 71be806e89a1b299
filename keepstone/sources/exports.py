"""Writers: each gives a DataFrame of lines or files; write_lines() puts lines into text files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JSONL_FIELDS = ("id", "content", "l3", "tags", "source", "priority", "namespace", "memory_type", "created_at")
#: Objects of a file that holds an array; one task reads it.
ARRAY = 5_000

def jsonl(memories: DataFrame) -> DataFrame:
    have = [c for c in JSONL_FIELDS if c in memories.columns]
    return memories.select("id", F.to_json(F.struct(*have)).alias("line"))


def fine_tuning(memories: DataFrame, prefix: str, system: str = "You are a helpful assistant with access to stored memories.") -> DataFrame:
    """Three messages for each memory with an abstract and a content; what the user asks begins with the prefix."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    m = F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(prefix), "l3")), message("assistant", F.col("content")))
    return memories.where("coalesce(l3, '') <> '' AND coalesce(content, '') <> ''").select("id", F.to_json(F.struct(m.alias("messages"))).alias("line"))


def instructions(memories: DataFrame, prefix: str) -> DataFrame:
    """An instruction, which begins with the prefix, and its output for each memory with an abstract."""
    return memories.where("coalesce(l3, '') <> ''").select("id", F.to_json(F.struct(F.concat(F.lit(prefix), "l3").alias("instruction"), F.lit("").alias("input"), F.col("content").alias("output"))).alias("line"))


def questions_by_tag(memories: DataFrame) -> DataFrame:
    """tag, question and answer: all facts (l2) of the memories whose first tag it is, in the order of ids."""
    tag = F.coalesce(F.get("tags", 0), F.lit("general"))
    facts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "l2"))), lambda x: x["l2"]))
    return memories.groupBy(tag.alias("tag")).agg(F.array_join(facts, " ").alias("answer"), F.count("*").alias("n")).select("tag", F.concat(F.lit("What do you know about "), "tag", F.lit("?")).alias("question"), "answer", "n")


def labelled_texts(memories: DataFrame) -> DataFrame:
    return memories.select("id", F.col("content").alias("text"), F.coalesce(F.get("tags", 0), F.lit("general")).alias("label"))


def markdown(memories: DataFrame) -> DataFrame:
    """name and body of a file for each memory, with frontmatter."""
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("id").cast("string")), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), F.concat(F.lit("source: "), F.coalesce("source", F.lit(""))), F.concat(F.lit("priority: "), F.col("priority").cast("string")), F.lit("---"))
    return memories.select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.concat(head, F.lit("\n\n"), "content", F.lit("\n")).alias("body"))


def logseq(memories: DataFrame) -> DataFrame:
    bullets = F.array_join(F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    return memories.select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("tags:: "), F.array_join("tags", ", "), F.lit("\n"), bullets, F.lit("\n")).alias("body"))


def age(created: Column, now: Column) -> Column:
    """Minutes, hours or days as 5m, 3h, 2d; of times ahead of now days below zero."""
    s = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1_000_000
    unit = lambda d, u: F.concat(F.floor(s / d).cast("string"), F.lit(u))
    return F.when((s >= 0) & (s < 3600), unit(60, "m")).when((s >= 0) & (s < 86400), unit(3600, "h")).otherwise(unit(86400, "d"))


def age_in_days(created: Column, now: Column) -> Column:
    """Whole days as 2d, whatever the age."""
    return F.concat(F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000).cast("string"), F.lit("d"))


def context(memories: DataFrame, now: Column, tags: int = 20, recent: int = 20, important: int = 10, aged: Callable[[Column, Column], Column] = age) -> DataFrame:
    """section, pos and text: frequent tags, recent memories with ages, contents of the most important ones. Few rows."""
    t = memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(tags)
    a = t.select(F.lit("tags").alias("section"), (-F.col("n")).cast("double").alias("pos"), F.concat("tag", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
    r = memories.orderBy(F.desc("created_at"), F.desc("id")).limit(recent).select(F.lit("recent").alias("section"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).cast("double").alias("pos"), F.concat(F.lit("["), aged(F.col("created_at"), now), F.lit("] "), F.substring("content", 1, 80)).alias("text"))
    p = memories.orderBy(F.desc("priority"), "id").limit(important).select(F.lit("facts").alias("section"), (-F.col("priority")).alias("pos"), F.substring("content", 1, 200).alias("text"))
    return a.unionByName(r).unionByName(p)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def obsidian(memories: DataFrame) -> DataFrame:
    """name and body of a note for each memory (with l3): frontmatter of id, tags, priority, source, time and abstract, then the content."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    fields = [field("id", F.col("id").cast("string")), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), field("priority", F.col("priority").cast("string")), field("source", F.col("source")), field("created_at", created), field("l3_abstract", F.col("l3"))]
    return memories.select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.concat_ws("\n", F.lit("---"), *fields, F.lit("---"), F.lit(""), F.col("content")).alias("body"))


def write_files(files: DataFrame, path: str) -> int:
    """One file for each row of (name, body) in a folder; the number of files.

    Executors write each body into a folder for its name; the driver then only renames, in any file system that Spark knows.
    """
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    files.select("name", F.col("body").alias("value")).write.partitionBy("name").text(draft)
    fs, n = at(draft).getFileSystem(conf), 0
    unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in fs.listStatus(at(draft)):
        if folder.isDirectory():
            name = unescaped(folder.getPath().getName().split("=", 1)[1])
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.delete(at(f"{path}/{name}"), False)
                    fs.rename(part.getPath(), at(f"{path}/{name}"))
                    n += 1
    fs.delete(at(draft), True)
    return n


def write_arrays(objects: DataFrame, path: str, column: str = "line", most: int = ARRAY) -> None:
    """JSON texts as files that each hold one array: one for each partition, and more where it has more than ``most`` objects.

    An array is a line for each object and one for its end, and Spark's writer begins a file after so many.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for d in parts:
            lines = []
            for x in d[column]:
                lines += ["]"] if n and n % most == 0 else []
                lines.append(("[" if n % most == 0 else ", ") + x)
                n += 1
            yield pd.DataFrame({"value": lines}, dtype=object)
        yield pd.DataFrame({"value": ["]" if n else "[]"]})

    objects.select(column).mapInPandas(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", most + 1).text(path)


def json_array(memories: DataFrame, path: str) -> None:
    """One array of objects in the order of ids: sorted over all partitions and written as lines which, in the order
    of the files, are the array. Brackets are lines of their own; each object but the first begins with a comma."""
    have = [c for c in JSONL_FIELDS if c in memories.columns]
    rows = memories.select("id", F.to_json(F.struct(*have)).alias("j"))
    first = rows.agg(F.min("id").alias("m")).first()["m"]
    lines = rows.select(F.lit(1).alias("k"), "id", F.when(F.col("id") == first, F.col("j")).otherwise(F.concat(F.lit(", "), "j")).alias("value"))
    ends = memories.sparkSession.createDataFrame([(0, "["), (2, "]")], "k int, value string").withColumn("id", F.lit(None).cast(rows.schema["id"].dataType))
    lines.unionByName(ends).repartitionByRange("k", "id").sortWithinPartitions("k", "id").select("value").write.mode("overwrite").text(path)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """A copy of each table below a folder."""
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")


def backups(spark: SparkSession, path: str) -> DataFrame:
    """name, modified and bytes of the tables that were copied below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(name.alias("name")).agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"))


def restore(spark: SparkSession, path: str, target: str, names: list[str], safety: str | None = None) -> dict[str, DataFrame]:
    """Bring copied tables back to a folder, after what is there was copied to ``safety``."""
    if safety:
        backup({n: spark.read.parquet(f"{target}/{n}") for n in names}, safety)
    for n in names:
        spark.read.parquet(f"{path}/{n}").write.mode("overwrite").parquet(f"{target}/{n}")
    return {n: spark.read.parquet(f"{target}/{n}") for n in names}
