"""Merkle manifest of a dataset: a tree of digests over each group's documents, and one over the groups.

Each document's place in its group comes from histograms of the digits of its id, and not from a
sort of all rows: the fine histogram counts the ids that differ in their last digit only, coarser
ones are sums of it, and running sums within a parent's 256 digits add up to the place. A place,
written in base fan-out, is the key of a leaf in a trie; a node's children are the keys that are
longer by one digit. Blocks of leaves that share a prefix are reduced at once, longest prefixes
first, so that a shuffle takes several levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import stash
from keepstone.operators.ordered import placed

#: Leaves of a block that one task reduces: the largest power of the fan-out up to this.
BLOCK = 256
#: Rows of a cell of the histogram that are put in order in one task; larger cells are split by further digits.
CELL = 4096
#: Hex characters of a sorting key: 2 for null ids, 16 for the id, 64 for the leaf and 64 for what is found now. A digit has two.
FINE, KEY = 16, 146
LOWEST = -(1 << 63)


def joined(*digests: Column | str) -> Column:
    """H: the digest of texts, one after the other."""
    return F.sha2(F.concat(*digests).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value that can't be confused with what follows it: its length in bytes, a colon, itself; nulls are a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return joined(*[field(v) for v in values])


def _key() -> Column:
    """Hex text whose order is that of id (nulls first), leaf, found."""
    flipped = F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(LOWEST))), 16, "0")
    ident = F.when(F.col("id").isNull(), F.lit("0" * 18)).otherwise(F.concat(F.lit("01"), flipped))
    return F.concat(ident, "leaf", F.coalesce("found", "leaf"))


def _offsets(cells: DataFrame, depth: int, parents: DataFrame | None) -> DataFrame:
    """cells (g, cell, n) with ``first``: the place in g of the first row of each cell. parents: the cells of one digit less."""
    within = Window.partitionBy("g", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    out = cells.withColumn("parent", F.substring("cell", 1, depth - 2)).withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    if parents is not None:
        above = parents.select("g", F.col("cell").alias("parent"), F.col("first").alias("base"))
        out = out.join(above, ["g", "parent"]).withColumn("first", F.col("first") + F.col("base"))
    return out.select("g", "cell", "n", "first")


def _repeat(rows: DataFrame, size: int = CELL) -> DataFrame:
    """Rows (place of the first copy, number of copies) as often as they occur, in bounded pieces dealt over the tasks."""
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {size}")))).repartition("g", "place", "piece")
    places = F.sequence(F.col("place") + F.col("piece") * size, F.col("place") + F.least((F.col("piece") + 1) * size, F.col("copies")) - 1)
    return pieces.withColumn("place", F.explode(places)).drop("piece", "copies")


def _crowded(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Places of rows in cells that repeated ids have filled: equal rows are counted once, cells split by digits of the digests."""
    keys = ["g", "key", "id", "leaf", "found"]
    left = stash(rows.join(cells.select("g", "cell", "first"), ["g", "cell"]).groupBy(*keys, "first").agg(F.count("*").alias("copies")), "manifest-crowded")
    done: list[DataFrame] = []
    depth = FINE
    while True:
        depth += 2
        here = left.withColumnRenamed("first", "base").withColumn("cell", F.substring("key", 1, depth))
        within = Window.partitionBy("g", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        split = here.groupBy("g", "cell", "base").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).withColumn("parent", F.substring("cell", 1, depth - 2))
        split = split.select("g", "cell", "rows", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"))
        here = stash(here.drop("base").join(split, ["g", "cell"]), "manifest-crowded")
        ready = here.where(F.col("rows") <= (CELL if depth < KEY else F.col("rows")))
        before = Window.partitionBy("g", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        done.append(ready.select(*keys, "copies", (F.col("first") + F.coalesce(F.sum("copies").over(before), F.lit(0))).alias("place")))
        left = here.where(F.col("rows") > CELL).select(*keys, "copies", "first")
        if depth >= KEY or left.isEmpty():
            break
    return _repeat(reduce(DataFrame.unionByName, done)).drop("key")


def places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The place of each leaf in its group by id, then digest; and the groups' sizes (g, n).

    leaves: g string, id long, leaf and found string, which can be read twice with the same result.
    """
    rows = leaves.withColumn("key", _key())
    ends = rows.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    a, b = (ends["a"] or "")[:FINE], (ends["b"] or "")[:FINE]
    shared = next((i for i in range(0, len(a), 2) if a[i : i + 2] != b[i : i + 2]), FINE - 2)
    rows = rows.withColumn("cell", F.substring("key", 1, FINE))
    fine = stash(rows.groupBy("g", "cell").agg(F.count("*").alias("n")), "manifest-cells", narrow=True)
    above = None
    for depth in range(shared + 2, FINE + 1, 2):
        here = fine if depth == FINE else fine.groupBy("g", F.substring("cell", 1, depth).alias("cell")).agg(F.sum("n").alias("n"))
        above = _offsets(here, depth, above)
    cells = stash(above, "manifest-cells", narrow=True)
    sizes = fine.groupBy("g").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("g", "cell").orderBy("key")
    calm = rows.join(cells.where(F.col("n") <= CELL).select("g", "cell", "first"), ["g", "cell"]).withColumn("place", F.col("first") + F.row_number().over(ranked) - 1)
    out = calm.select("g", "id", "leaf", "found", "place")
    crowded = cells.where(F.col("n") > CELL)
    if not crowded.isEmpty():
        out = out.unionByName(_crowded(rows, crowded).select(*out.columns))
    return out, sizes


def _digits(fanout: int) -> int:
    """Levels of a block."""
    d = 1
    while fanout ** (d + 1) <= BLOCK:
        d += 1
    return d


def _height(n: Column, fanout: int) -> Column:
    """Levels above the leaves: the digits of the last place in base fan-out."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.conv((n - 1).cast("string"), 10, fanout)))


def _levels(digests: Column, steps: Column, fanout: int) -> Column:
    """The digests of a block and of the nodes above them, one array a level."""

    def up(x: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(x, i * fanout + 1, F.lit(fanout)), "").cast("binary"), 256))

    steps = F.slice(F.sequence(F.lit(1), F.lit(_digits(fanout))), F.lit(1), steps)
    return F.aggregate(steps, F.array(digests), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


def _others(place: Column, fanout: int) -> Column:
    """What stands to the left and to the right in the run of a block's node, level by level. Reads the column ``levels``."""
    steps = F.slice(F.sequence(F.lit(0), F.lit(_digits(fanout) - 1)), F.lit(1), F.size("levels") - 1)

    def at(level: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(fanout)), level)).cast("int")
        first = F.floor(own / fanout).cast("int") * fanout
        nodes = F.get(F.col("levels"), level)
        left = F.array_join(F.slice(nodes, first + 1, own - first), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(nodes, own + 2, first + fanout - own - 1), "").alias("right"))

    return F.transform(steps, at)


def grow(nodes: DataFrame, sizes: DataFrame, fanout: int, payload: tuple[str, ...] = ()) -> list[DataFrame]:
    """Trees over nodes (g, place, digest): a table of blocks for each round, (g, block, levels, payload arrays).

    sizes: g, n. The nodes of a block share all but the last digits of their places; the digest
    at the top of a block is a node of the next round.
    """
    digits = _digits(fanout)
    width = fanout**digits
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds: list[DataFrame] = []
    while True:
        members = F.sort_array(F.collect_list(F.struct("place", "digest", *payload)))
        blocks = nodes.groupBy("g", F.expr(f"place div {width}").alias("block")).agg(members.alias("m")).join(sizes, "g")
        steps = F.greatest(F.lit(0), F.least(F.lit(digits), _height(F.col("n"), fanout) - digits * len(rounds)))
        blocks = blocks.select("g", "block", _levels(F.col("m.digest"), steps, fanout).alias("levels"), *[F.col(f"m.{p}").alias(p) for p in payload])
        rounds.append(stash(blocks, "manifest-blocks", narrow=bool(rounds)))
        most = -(-most // width)
        if most <= 1:
            return rounds
        nodes, payload = tops(rounds[-1]).withColumnRenamed("block", "place"), ()


def tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("g", "block", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))


def ways(rounds: list[DataFrame], fanout: int) -> DataFrame:
    """(g, block, way): what stands beside the way from each block of the first round up to the root."""
    width = fanout ** _digits(fanout)
    way = rounds[-1].select("g", "block", F.array().cast("array<struct<left:string,right:string>>").alias("way"))
    for blocks in reversed(rounds[1:]):
        both = blocks.join(way, ["g", "block"])
        nodes = F.transform(F.sequence(F.lit(0), F.size(F.get("levels", F.lit(0))) - 1), lambda i: F.struct((F.col("block") * width + i).alias("block"), F.concat(_others(i, fanout), F.col("way")).alias("way")))
        way = both.select("g", F.inline(nodes))
    return way


def manifest(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """Proofs of all leaves, and whether what is found now still folds to the root.

    leaves: group string (null is a group of its own), id long, leaf string (the recorded digest),
    found string (the digest of the record as found now; null where it is the recorded one).
    Returns id, leaf, subroot, root, proof_sha256 string, folded_root string, verified boolean.

    Leaves of a group ascend by id (null ids first; equal ids by digest; equal rows each have a
    leaf of their own), groups by name (null first, bytewise). A group of one has its leaf for a
    subroot. An empty table gives no rows. No text is read here, and no task holds more than
    a block, a cell of CELL rows or a parent's 256 digits.
    """
    if not 2 <= fanout <= 36:
        raise ValueError("the fan-out is from 2 to 36")
    named = F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("group")))
    kept = stash(leaves.select(named.alias("g"), F.col("id").cast("long").alias("id"), "leaf", "found"), "manifest-leaves")
    ranked, sizes = places(kept)
    sizes = stash(sizes, "manifest-sizes", narrow=True)
    rounds = grow(ranked.withColumnRenamed("leaf", "digest"), sizes, fanout, ("id", "found"))
    # the tree over the groups' roots
    subroots = tops(rounds[-1]).select(F.col("g").alias("name"), F.col("digest").alias("subroot"))
    over = stash(placed(subroots, ["name"]).select("name", "subroot", "place"), "manifest-groups", narrow=True)
    one = F.lit("all").alias("g")
    top = grow(over.select(one, "place", F.col("subroot").alias("digest")), over.agg(F.count("*").alias("n")).select(one, "n"), fanout)
    width = fanout ** _digits(fanout)
    root = tops(top[-1]).select(F.col("digest").alias("root"))  # one row
    above = ways(top, fanout).join(top[0], ["g", "block"]).select("way", "levels", F.posexplode(F.get("levels", F.lit(0))).alias("i", "subroot"), "block")
    above = above.select((F.col("block") * width + F.col("i")).alias("place"), F.concat(_others(F.col("i"), fanout), F.col("way")).alias("over"))
    groups = stash(over.join(above, "place").join(F.broadcast(root)).select(F.col("name").alias("g"), "subroot", "root", "over"), "manifest-groups", narrow=True)

    below = rounds[0].join(ways(rounds, fanout), ["g", "block"]).join(groups, "g").withColumn("up", F.concat("way", "over"))

    def leaf(i: Column) -> Column:
        return F.struct(F.get("id", i).alias("id"), F.get(F.get("levels", F.lit(0)), i).alias("leaf"), F.get("found", i).alias("found"), _others(i, fanout).alias("own"))

    rows = below.select("subroot", "root", "up", F.inline(F.transform(F.sequence(F.lit(0), F.size("id") - 1), leaf)))
    rows = rows.withColumn("way", F.concat("own", "up"))
    proof = F.sha2(F.array_join(F.transform("way", lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)
    folded = F.aggregate("way", F.coalesce("found", "leaf"), lambda acc, x: joined(x["left"], acc, x["right"]))
    return rows.select("id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, by language, and what it says once one document in seven has another n_chars."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    after = [(F.col("n_chars").cast("decimal(20,0)") + 1) if i == 3 else c for i, c in enumerate(before)]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = d.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf_digest(*before).alias("leaf"), F.when(changed, leaf_digest(*after)).alias("found"))
    return manifest(leaves).withColumnRenamed("id", "doc_id")


#: crc is the rule of CRC-32 over the decimal digits; nodes, the levels of the trees by halving places.
OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (
  SELECT d.*, CASE WHEN doc_id IS NULL THEN NULL ELSE
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
      lambda c, b: xor(crc.t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) END AS sum
  FROM documents d, crc
),
parts AS (
  SELECT doc_id, lang, sum,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS was,
    coalesce(length(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || (CAST(n_chars AS HUGEINT) + 1), '-') AS now,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM docs
),
leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(head || was || tail) AS leaf,
    sha256(head || CASE WHEN sum % 7 = 0 THEN now ELSE was END || tail) AS found
  FROM parts
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS lvl, place, leaf AS h, n FROM ranked
  UNION ALL
  SELECT g, lvl + 1, place // 2, sha256(h || coalesce(mate, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY place) AS mate FROM nodes WHERE n > 1) WHERE place % 2 = 0
),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS (
  SELECT 0 AS lvl, place, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, sha256(h || coalesce(mate, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY place) AS mate FROM over WHERE n > 1) WHERE place % 2 = 0
),
walk AS (
  SELECT r.g, r.place AS leaf_at, r.doc_id, r.leaf, r.found, 0 AS lvl, r.place AS at, r.found AS acc, '' AS proof FROM ranked r
  UNION ALL
  SELECT w.g, w.leaf_at, w.doc_id, w.leaf, w.found, w.lvl + 1, w.at // 2,
    CASE WHEN s.h IS NULL THEN sha256(w.acc) WHEN w.at % 2 = 0 THEN sha256(w.acc || s.h) ELSE sha256(s.h || w.acc) END, w.proof || coalesce(s.h, '')
  FROM walk w JOIN nodes m ON m.g = w.g AND m.lvl = w.lvl AND m.place = w.at AND m.n > 1
    LEFT JOIN nodes s ON s.g = w.g AND s.lvl = w.lvl AND s.place = xor(w.at, 1)
),
up AS (
  SELECT w.g, w.leaf_at, w.doc_id, w.leaf, r.subroot, 0 AS lvl, r.place AS at, w.acc, w.proof
  FROM walk w JOIN nodes m ON m.g = w.g AND m.lvl = w.lvl AND m.place = w.at AND m.n = 1 JOIN subroots r ON r.g = w.g
  UNION ALL
  SELECT u.g, u.leaf_at, u.doc_id, u.leaf, u.subroot, u.lvl + 1, u.at // 2,
    CASE WHEN s.h IS NULL THEN sha256(u.acc) WHEN u.at % 2 = 0 THEN sha256(u.acc || s.h) ELSE sha256(s.h || u.acc) END, u.proof || coalesce(s.h, '')
  FROM up u JOIN over m ON m.lvl = u.lvl AND m.place = u.at AND m.n > 1 LEFT JOIN over s ON s.lvl = u.lvl AND s.place = xor(u.at, 1)
)
SELECT u.doc_id, u.leaf, u.subroot, m.h AS root, sha256(u.proof) AS proof_sha256, u.acc AS folded_root, u.acc = m.h AS verified
FROM up u JOIN over m ON m.lvl = u.lvl AND m.place = u.at AND m.n = 1
"""
