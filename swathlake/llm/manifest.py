"""A Merkle manifest of a table: digests of rows, trees of them by group, and proofs that a row belongs to the root.

Trees are made level by level: a parent's row holds its preimage, the concatenated hashes of its eight children. A leaf
joins the preimages of all its ancestors: what is left of each without the leaf's own 64 characters are its siblings, and
a replacement put there, hashed, is what the next preimage takes. Preimages go down the tree from the root, so that only
the last join has a row a leaf.

Leaves are numbered without a task that holds a whole group: ranges of (group, id) are sorted, and what stands before a
range in its group comes from a table with a row a range and group.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, drop_written, written

#: Children of a node, as a power of two, and characters of a digest.
BITS, HEX = 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """A written table: leaves with tree (the group's number, from 0, null first), size (the group's rows) and pos (the row's place in it, from 0)."""
    keys = [group, *order]
    x = leaves.withColumn("place", F.monotonically_increasing_id())  # rows with equal keys spread over ranges
    x = x.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place").drop("place")
    x = written(x.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "manifest-leaves")
    counts = written(x.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")), "manifest-counts")
    groups = counts.groupBy(F.col(group).alias("g")).agg(F.sum("rows").alias("size")).withColumn("tree", F.row_number().over(Window.orderBy("g")).cast("long") - 1)  # a row a group
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("before", before).join(groups, F.col(group).eqNullSafe(F.col("g"))).select(F.col(group).alias("g"), F.col("part").alias("p"), "first", "before", "tree", "size")
    spans = written(spans, "manifest-spans")
    out = x.join(_small(spans), F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    out = written(out.select(*leaves.columns, "tree", "size", (F.col("at") - F.col("first") + F.col("before")).alias("pos")), "manifest-numbered")
    drop_written(x, counts, spans)
    return out


def parents(nodes: DataFrame) -> DataFrame:
    """tree, size, pos, preimage, hash of the level above nodes (tree, size, pos, hash); trees of one node have none."""
    child = F.struct("pos", "hash").alias("child")
    x = nodes.where("size > 1").select("tree", "size", F.shiftright("pos", BITS).alias("pos"), child)
    x = x.groupBy("tree", "size", "pos").agg(F.array_sort(F.collect_list("child")).alias("c"))  # eight children at most
    x = x.withColumn("preimage", F.concat_ws("", F.transform("c", lambda c: c["hash"])))
    return x.select("tree", F.shiftright(F.col("size") + ((1 << BITS) - 1), BITS).alias("size"), "pos", "preimage", F.sha2("preimage", 256).alias("hash"))


def climbed(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The levels of parents above nodes, each a written table; `largest` is the size of the largest tree."""
    levels, below = [], nodes
    while largest > 1:
        below = written(parents(below), "manifest-level")
        levels.append(below)
        largest = -(-largest >> BITS)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the one node that remains of each tree."""
    out = nodes.where("size = 1").select("tree", "hash")
    for x in levels:
        out = out.unionByName(x.where("size = 1").select("tree", "hash"))
    return out


def ancestors(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """nodes with `path`: the preimages of their ancestors, from the parent to the root."""
    above = None
    for x in (*reversed(levels), nodes):
        own = F.array(F.col("preimage")) if x is not nodes else F.array().cast("array<string>")
        if above is None:
            x = x.withColumn("path", own)
        else:
            a = above.select(F.col("tree").alias("t"), F.col("pos").alias("p"), F.col("path").alias("up"))
            x = x.join(a, (F.col("tree") == F.col("t")) & (F.shiftright("pos", BITS) == F.col("p")), "left").drop("t", "p")
            x = x.withColumn("path", F.concat(own, F.coalesce("up", F.array().cast("array<string>")))).drop("up")
        above = x
    return above


def _slotted(path: Column, pos: Column) -> Column:
    """The preimages with the place (from 1) of the node's own hash in each."""
    at = lambda k: F.call_function("shiftright", pos, (k * BITS).cast("int")) % (1 << BITS)
    return F.transform(path, lambda p, k: F.struct(p.alias("preimage"), (at(k) * HEX + 1).cast("int").alias("at")))


def siblings(slotted: Column) -> Column:
    """All siblings' hashes, level by level: the preimages less the node's own."""
    return F.concat_ws("", F.transform(slotted, lambda s: F.overlay(s["preimage"], F.lit(""), s["at"], F.lit(HEX))))


def folded(leaf: Column, slotted: Column) -> Column:
    """The root that a leaf's hash leads to: it takes its place in each preimage, which is hashed."""
    return F.aggregate(slotted, leaf, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["at"], F.lit(HEX)), 256))


def prove(leaves: DataFrame, group: str, order: Sequence[str], leaf: str, shown: str) -> DataFrame:
    """leaves with subroot, root, proof_sha256, folded_root and verified: the tree of each group's leaves by the given order, then the tree of the groups' roots.

    shown: a column with the leaf that is checked against the manifest, null where it is the original. Equal rows may
    take each other's places. Groups may hold any share of all rows.
    """
    x = numbered(leaves, group, [*order, leaf]).withColumnRenamed(leaf, "hash")
    count, largest = x.agg(F.coalesce(F.max("tree"), F.lit(-1)) + 1, F.coalesce(F.max("size"), F.lit(0))).first()
    levels = climbed(x.select("tree", "size", "pos", "hash"), largest)
    sub = tops(x, levels).select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("pos"), "hash")
    sub = written(sub, "manifest-subroots")
    high = climbed(sub, count)
    top = written(tops(sub, high).select(F.col("hash").alias("root")), "manifest-root")  # one row
    sub = ancestors(sub, high).join(F.broadcast(top), F.lit(True)).select(F.col("pos").alias("s"), F.col("hash").alias("subroot"), "root", _slotted(F.col("path"), F.col("pos")).alias("high"))
    out = ancestors(x, levels).join(_small(written(sub, "manifest-subroots")), F.col("tree") == F.col("s"))
    slots = F.concat(_slotted(F.col("path"), F.col("pos")), F.col("high"))
    out = out.withColumn("slots", slots).withColumn("proof_sha256", F.sha2(siblings(F.col("slots")), 256)).withColumn("folded_root", folded(F.coalesce(shown, "hash"), F.col("slots")))
    rest = [c for c in leaves.columns if c not in (leaf, shown)]
    return out.select(*rest, F.col("hash").alias(leaf), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered(text: Column) -> Column:
    """text with A-Z, and no other letters, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    Rows whose unsigned crc32(decimal doc_id) 3 divides are tampered with: their text is lowered before they are checked.
    Nulls stay null in every column, a null id is never tampered with; ids ascend null first, rows of one id by their
    leaf. Repeated rows each have their leaf. An empty table gives none. Other columns are not read.
    """
    fields = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(tampered & F.col("text").isNotNull(), digest(*fields[:-1], lowered(F.col("text"))))
    leaves = written(docs.select("doc_id", "lang", digest(*fields).alias("leaf"), other.alias("other")), "manifest-digests")
    out = prove(leaves, "lang", ["doc_id"], "leaf", "other")
    drop_written(leaves)  # what is proved is read from the numbered leaves
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents and what every row, a third of them tampered with, proves to be."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def _oracle(levels: int = 8, high: int = 3) -> str:
    """DuckDB SQL for up to 8^levels rows a group and 8^high groups."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    row = lambda text: "sha256(" + " || ".join(map(field, [*FIELDS[:-1], text])) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    out = [
        "t AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))",
        f"d AS (SELECT doc_id, lang, {row('text')} AS h, CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 THEN {row(lower)} END AS o FROM documents, t)",
        "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents))",
        "x0 AS (SELECT d.doc_id, h, o, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang)",
    ]

    def tier(x: str, y: str, count: int) -> str:
        for k in range(count):
            out.append(f"{x}{k + 1} AS (SELECT tree, pos // 8 AS pos, string_agg(h, '' ORDER BY pos) AS pre, sha256(string_agg(h, '' ORDER BY pos)) AS h, (n + 7) // 8 AS n FROM {x}{k} WHERE n > 1 GROUP BY tree, pos // 8, n)")
        out.append(f"{y} AS (" + " UNION ALL ".join(f"SELECT tree, h FROM {x}{k} WHERE n = 1" for k in range(count + 1)) + ")")

    tier("x", "s", levels)
    out.append("y0 AS (SELECT 0 AS tree, tree AS pos, h, count(*) OVER () AS n FROM s)")
    tier("y", "r", high)
    body = "SELECT x0.doc_id, x0.h AS leaf, s.h AS subroot, r.h AS root, x0.pos AS pos, x0.tree AS tree, '' AS sib, coalesce(x0.o, x0.h) AS f FROM x0 JOIN s ON x0.tree = s.tree, r"
    for x, count, tree, pos in (("x", levels, "tree", "pos"), ("y", high, "0", "tree")):
        for k in range(1, count + 1):
            at = f"(b.{pos} // {8 ** (k - 1)}) % 8 * 64"
            body = f"SELECT b.* REPLACE (CASE WHEN p.pre IS NULL THEN sib ELSE sib || left(p.pre, CAST({at} AS BIGINT)) || substr(p.pre, {at} + 65) END AS sib, CASE WHEN p.pre IS NULL THEN f ELSE sha256(left(p.pre, CAST({at} AS BIGINT)) || f || substr(p.pre, {at} + 65)) END AS f) FROM ({body}) b LEFT JOIN {x}{k} p ON p.tree = {'b.tree' if x == 'x' else '0'} AND p.pos = b.{pos} // {8**k}"
    return "WITH " + ",\n     ".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM ({body})"


ORACLE = _oracle()
