"""Merkle fixity audit of WARC records: hash trees over ordered offset ranges, compared from the root down.

Records stand in the order of a digest of their key, so a tree over fixed ranges of that order has
leaves of bounded size, and each node covers one range of offsets. Each replica's tree is built
from its own records alone. Roots are compared first; below nodes that differ their children
are; only records under leaves that differ are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import at_most, stash

#: Records under a leaf at most on average, and children under each other node (a digit of the key's digest).
LEAF_RECORDS, FANOUT = 64, 16
#: Leaves that are broadcast at most (8 bytes each); beyond that joins shuffle.
BROADCAST_LEAVES = 100_000


def key_digest(page_id: Column, url: Column) -> Column:
    """Digest of a record's key: its name and its place in the order."""
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))


def warc_record(url: Column, page_id: Column, html: Column) -> Column:
    """A WARC/1.1 response record as text; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    ident = key_digest(page_id, url)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), ident, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """One entry for each (page_id, url): ident, copies, bytes of all copies, and a digest of them.

    Repeated rows are summed up before they are shuffled. Their digest covers the sums of the pieces
    of all copies' hashes as large integers (240 bits), so it doesn't depend on order, and equal copies don't cancel.
    """
    d = pages.select(F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"), warc_record(F.col("url"), F.col("page_id"), F.col("html")).alias("r"))
    d = d.select("page_id", "url", F.octet_length("r").cast("long").alias("n"), F.sha2("r", 256).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    g = d.groupBy("page_id", "url").agg(F.count("*").alias("copies"), F.sum("n").alias("n_bytes"), F.min("h").alias("h"), *pieces)
    digest = F.when(F.col("copies") == 1, F.col("h")).otherwise(F.sha2(F.concat_ws(":", "copies", "h", *[F.col(f"s{i}").cast("string") for i in range(4)]).cast("binary"), 256))
    return g.select("page_id", "url", key_digest(F.col("page_id"), F.col("url")).alias("ident"), "copies", "n_bytes", digest.alias("digest"))


def depth_for(records: int) -> int:
    """Levels of nodes under the root that bring leaves down to LEAF_RECORDS records on average."""
    depth = 0
    while FANOUT**depth * LEAF_RECORDS < records:
        depth += 1
    return depth


def leaf_of(ident: Column, depth: int) -> Column:
    return F.conv(F.substring(ident, 1, depth), 16, 10).cast("long") if depth else F.lit(0).cast("long")


def build_tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels (node, hash, n_bytes) of a replica's tree, the root first; no rows for an empty replica.

    A leaf's hash covers the offset in the leaf, the length and the digest of its records in order;
    any other node's covers its children's numbers and hashes.
    """
    inside = F.sort_array(F.collect_list(F.struct("ident", "n_bytes", "digest")))  # of one leaf
    laid = F.aggregate(
        "inside", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("told")), lambda a, x: F.struct((a["at"] + x["n_bytes"]).alias("at"), F.concat(a["told"], F.concat_ws(":", a["at"].cast("string"), x["n_bytes"].cast("string"), x["digest"]), F.lit(";")).alias("told"))
    )
    leaves = records.groupBy(leaf_of(F.col("ident"), depth).alias("node")).agg(inside.alias("inside")).select("node", laid.alias("x"))
    levels = [stash(leaves.select("node", F.sha2(F.col("x.told").cast("binary"), 256).alias("hash"), F.col("x.at").alias("n_bytes")), "tree", narrow=True)]
    for _ in range(depth):
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))  # FANOUT at most
        told = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ";")
        up = levels[0].groupBy(F.floor(F.col("node") / FANOUT).alias("parent")).agg(children.alias("children"), F.sum("n_bytes").alias("n_bytes"))
        levels.insert(0, stash(up.select(F.col("parent").alias("node"), F.sha2(told.cast("binary"), 256).alias("hash"), "n_bytes"), "tree", narrow=True))
    return levels


def offsets(tree: list[DataFrame]) -> DataFrame:
    """Where each leaf of a replica begins (node, start): from the root down, after the bytes of the earlier children."""
    starts = tree[0].select("node", F.lit(0).cast("long").alias("start"))
    earlier = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # FANOUT rows
    for level in tree[1:]:
        own = level.withColumn("parent", F.floor(F.col("node") / FANOUT)).withColumn("o", F.coalesce(F.sum("n_bytes").over(earlier), F.lit(0)))
        up = starts.select(F.col("node").alias("parent"), F.col("start").alias("base"))
        starts = stash(own.join(up, "parent").select("node", (F.col("base") + F.col("o")).alias("start")), "starts", narrow=True)
    return starts


def differing_leaves(one: list[DataFrame], other: list[DataFrame]) -> DataFrame | None:
    """Leaves (leaf) whose hashes differ or that one replica lacks; None if the roots agree.

    Only children of nodes that differ are looked at.
    """
    wanted = None
    for a, b in zip(one, other, strict=True):
        a, b = a.select("node", "hash"), b.select(F.col("node").alias("node_b"), F.col("hash").alias("hash_b"))
        if wanted is not None:
            a = a.join(wanted, F.floor(a["node"] / FANOUT) == wanted["leaf"], "left_semi")
            b = b.join(wanted, F.floor(b["node_b"] / FANOUT) == wanted["leaf"], "left_semi")
        both = a.join(b, F.col("node") == F.col("node_b"), "full_outer").where(~F.col("hash").eqNullSafe(F.col("hash_b")))
        wanted = stash(both.select(F.coalesce("node", "node_b").alias("leaf")), "differing", narrow=True)
        if not wanted.limit(1).count():
            return None
    return wanted


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Compare two replicas of a table of pages (page_id, url, html) through their trees.

    Returns for each (page_id, url): page_id, url, n_copies and n_bytes in the first replica,
    rec_offset (in the first replica, in the order of the key's digest) and leaf (long), status: intact, corrupt, missing (from the second) or extra (only there).
    Null ids and urls are keys like others (a null url equals an empty one); null html is an empty
    body; rows of one key are one entry of several copies, compared as a whole; other columns aren't
    looked at. Two empty replicas give an empty table.
    """
    a, b = stash(manifest(one), "manifest", narrow=True), stash(manifest(other), "manifest", narrow=True)
    depth = depth_for(max(a.count(), b.count()))
    trees = build_tree(a, depth), build_tree(b, depth)
    differing = differing_leaves(*trees)
    leaf = leaf_of(F.col("ident"), depth).alias("leaf")
    mine = a.select("ident", "page_id", "url", F.col("copies").alias("n_copies"), "n_bytes", "digest", leaf)
    plain = ["ident", "page_id", "url", "n_copies", "n_bytes", "leaf"]
    if differing is None:
        out = mine.select(*plain, F.lit("intact").alias("status"))
    else:
        d = F.broadcast(differing) if at_most(differing, BROADCAST_LEAVES) else differing
        theirs = b.select(F.col("ident").alias("ident_b"), F.col("page_id").alias("page_b"), F.col("url").alias("url_b"), F.col("digest").alias("digest_b"), leaf_of(F.col("ident"), depth).alias("leaf")).join(d, "leaf", "left_semi").drop("leaf")
        both = mine.join(d, "leaf", "left_semi").join(theirs, F.col("ident") == F.col("ident_b"), "full_outer")
        status = F.when(F.col("digest").isNull(), "extra").when(F.col("digest_b").isNull(), "missing").when(F.col("digest") == F.col("digest_b"), "intact").otherwise("corrupt")
        known = F.col("ident").isNotNull()
        looked = both.select(
            F.coalesce("ident", "ident_b").alias("ident"), F.when(known, F.col("page_id")).otherwise(F.col("page_b")).alias("page_id"), F.coalesce("url", "url_b").alias("url"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), leaf_of(F.coalesce("ident", "ident_b"), depth).alias("leaf"), status.alias("status")
        )
        out = mine.join(d, "leaf", "left_anti").select(*plain, F.lit("intact").alias("status")).unionByName(looked)
    before = Window.partitionBy("leaf").orderBy("ident").rowsBetween(Window.unboundedPreceding, -1)  # the records of one leaf
    starts = offsets(trees[0]).select(F.col("node").alias("leaf"), "start")
    out = out.withColumn("o", F.coalesce(F.sum("n_bytes").over(before), F.lit(0))).join(starts, "leaf", "left")
    return out.select("page_id", "url", "n_copies", "n_bytes", (F.coalesce("start", F.lit(0)) + F.col("o")).alias("rec_offset"), "leaf", "status")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica for audit drills: by a hash of the id some pages have a changed byte, some are cut, some are lost."""
    h = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    body = F.coalesce("html", F.lit(""))
    html = F.when(h == "00", F.concat(F.lit("\x7f"), F.substring(body, 2, 1 << 30))).when(h == "01", F.substring(body, 1, F.floor(F.length(body) / 2).cast("int"))).otherwise(F.col("html"))
    return pages.withColumn("html", html).where(h != "02")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(pages, damaged_replica(pages))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS h FROM pages
),
r AS (
  SELECT page_id, url, h, html, CASE h WHEN '00' THEN chr(127) || substr(html, 2) WHEN '01' THEN substr(html, 1, CAST(floor(length(html) / 2) AS INT)) ELSE html END AS other,
    octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || url)
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || repeat(chr(13) || chr(10), 2) || html || repeat(chr(13) || chr(10), 2))) AS n
  FROM p
),
g AS (
  SELECT page_id, url, count(*) AS n_copies, CAST(sum(n) AS BIGINT) AS n_bytes, min(h) AS h, bool_or(html <> other) AS changed FROM r GROUP BY page_id, url
),
o AS (SELECT *, md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || url) AS ident, greatest(0, CAST(ceil(log2(count(*) OVER () / 64) / 4) AS INT)) AS depth FROM g),
p2 AS (SELECT *, sum(n_bytes) OVER (ORDER BY ident ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT page_id, url, n_copies, n_bytes, CAST(coalesce(before, 0) AS BIGINT) AS rec_offset, CASE WHEN depth = 0 THEN 0 ELSE CAST('0x' || substr(ident, 1, depth) AS BIGINT) END AS leaf,
  CASE WHEN h = '02' THEN 'missing' WHEN changed THEN 'corrupt' ELSE 'intact' END AS status
FROM p2
"""
