"""N-gram Jaccard join by parity sketches, pigeonhole keys per size band, and exact verification.

A set's sketch hashes its shingles to k cells and XORs their hashes in each, so two sketches differ in at most as many
cells as the sets differ in members. Links bound that: with sizes in one band, a linked pair differs in at most d
members, hence agrees in at least k - d cells. k = d + 1 + e: a set with at most e empty cells leaves those out and still
shares a filled one with every partner. Equal keys meet first through the member whose keys are the most common, the
likeliest original of a group of copies; the links found there join components, and only members of different components
that still share a key are paired, behind a bit sketch whose Hamming distance is another lower bound. A pair that shares
many keys is told at the smallest of them. Every pair is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import _ranges, drop_written, join_split, mix, semi_by_id, shingle_hashes, signed, slices, text_bytes, word_hashes, written

BAND_RATIO = 0.6
#: Bits of a set's sketch: the power of two above its size, within these.
SKETCH_BITS = (512, 8192)
#: Bits of the filter of shared keys (4 MB, of this size for any input).
FILTER_BITS = 1 << 25
#: Members of one key that one task pairs with as many others.
CHUNK = 512
#: Members of which a task holds the sketches side by side, and pairs that it compares at once.
AT_ONCE, BLOCK = 8192, 1 << 16
#: Smallest keys of a member that are carried along: when two members share one of these, the smallest tells their pair.
FIRST_KEYS = 8


def band_table(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower size bounds of the bands, and for each band's scheme the cells k (0: links in it are equal sets) and the allowance e."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, math.ceil(low[-1] / BAND_RATIO)))
    cells, spare = [], []
    for a, b in zip(low, low[1:], strict=False):
        d = (100 - percent) * (b - 1) // percent
        e = int(1.3 * (d + 1) * math.exp(-a / (d + 1))) + 3
        cells.append(d + 1 + e if d else 0)
        spare.append(e)
    return np.array(low[:-1]), np.array(cells), np.array(spare)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and n + 1 offsets."""
    h, _, _, at = word_hashes(data, offsets)
    s, s_at = shingle_hashes(h, at, words)
    parts = [np.unique(s[a:b]) for a, b in zip(s_at, s_at[1:], strict=False)]
    return np.concatenate(parts) if parts else s, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _reduce(f: np.ufunc, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """f over each row; 0 for empty rows."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = f.reduceat(x, at[:-1][full])
    return out


def names(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit name of each row's set."""
    with np.errstate(over="ignore"):
        return mix(_reduce(np.bitwise_xor, mix(s), at) ^ mix(_reduce(np.add, s, at) + np.diff(at).astype(np.uint64)))


def bit_sketches(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parities of the members' bits, for each row in as many bits as its size asks for."""
    n = np.diff(at)
    bits = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *(int(x).bit_length() - 1 for x in SKETCH_BITS)))
    base = np.concatenate([[0], np.cumsum(bits // 64)])
    out = np.zeros(base[-1], np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    bit = s & (bits[row] - 1).astype(np.uint64)
    np.bitwise_xor.at(out, base[row] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return [out[p:q].tobytes() for p, q in zip(base, base[1:], strict=False)]


def folded(sketches: list[bytes]) -> np.ndarray:
    """(rows, words): sketches of different lengths folded to the shortest one's; parities add."""
    least = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), least), np.uint64)
    for k, x in enumerate(sketches):
        v = np.frombuffer(x, np.uint64)
        out[k] = v if len(v) == least else np.bitwise_xor.reduce(v.reshape(-1, least), axis=0)
    return out


def pigeonhole_keys(s: np.ndarray, at: np.ndarray, percent: int, table=None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows' sets and their rows."""
    low, cells, spare = table or band_table(percent)
    n = np.diff(at)
    band = np.searchsorted(low, n, "right") - 1
    row = np.repeat(np.arange(len(n)), n)
    keys, rows = [], []
    for step in (0, 1):  # the set's own band, then the one below where a partner can be small enough for it
        j = band - step
        ok = (j >= 0) & (n > 0)
        if step:
            ok &= 100 * (low[np.maximum(band, 0)] - 1) >= percent * n
        k = np.where(ok, cells[np.maximum(j, 0)], 0)
        if not k.sum():
            continue
        base = np.concatenate([[0], np.cumsum(k)])
        use = k[row] > 0
        t, r = s[use], row[use]
        cell = ((t >> np.uint64(32)) * k[r].astype(np.uint64)) >> np.uint64(32)
        value = np.zeros(base[-1], np.uint64)
        np.bitwise_xor.at(value, base[r] + cell.astype(np.int64), mix(t))
        owner = np.repeat(np.arange(len(n)), k)
        number = np.arange(base[-1]) - base[owner]
        filled = value != 0
        few = np.bincount(owner[~filled], minlength=len(n)) <= spare[np.maximum(j, 0)]
        keep = filled | ~few[owner]
        label = (j[owner].astype(np.uint64) << np.uint64(40)) | number.astype(np.uint64)
        keys.append(mix(value ^ mix(label))[keep])
        rows.append(owner[keep])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node (null for empty sets), sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, at = distinct_shingles(*text_bytes(b.column("text")), words)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(signed(names(s, at)), mask=n == 0), pa.array(bit_sketches(s, at), pa.binary())],
                ["doc_id", "n", "node", "sketch"],
            )

    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long, sketch binary")


def _keys(docs: DataFrame, words: int, percent: int, only=None) -> DataFrame:
    """(key, node) of all documents; with `only`, a broadcast filter, just keys whose bit is set in it. A batch's equal sets count once."""
    table = band_table(percent)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, at = distinct_shingles(*text_bytes(b.column("text")), words)
            node = names(s, at)
            key, row = pigeonhole_keys(s, at, percent, table)
            first = np.zeros(len(node), bool)
            first[np.unique(node, return_index=True)[1]] = True
            keep = first[row]
            if only is not None:
                bit = key & np.uint64(FILTER_BITS - 1)
                keep &= (only.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[keep])), pa.array(signed(node[row[keep]]))], ["key", "node"])

    return docs.mapInArrow(make, "key long, node long")


def key_filter(shared: DataFrame):
    """Broadcast bit array, of FILTER_BITS for any input, of the keys in `shared`."""
    bit = f"(key & {FILTER_BITS - 1})"
    words = shared.groupBy(F.expr(f"shiftright({bit}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return shared.sparkSession.sparkContext.broadcast(out)


def _near(distance: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `total` members together can link at this distance or more."""
    return distance * (100 + percent) <= (100 - percent) * total


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and the sketches' Hamming distance leave."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for i in np.flatnonzero(ok):
                u, v = folded([x.column("sa")[i].as_py(), x.column("sb")[i].as_py()])
                ok[i] = _near(np.bitwise_count(u ^ v).sum(), na[i] + nb[i], percent)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of nodes whose whole sets link."""
    need = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "verify")
    ids = nodes.join(need, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, at = distinct_shingles(*text_bytes(b.column("text")), words)
            yield pa.RecordBatch.from_arrays([pa.array(signed(names(s, at))), pa.array([s[p:q].tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())], ["node", "members"])

    texts = semi_by_id(docs, written(ids, "verify"), "doc_id").mapInArrow(make, "node long, members binary").join(need, "node", "left_semi").dropDuplicates(["node"])
    texts = written(texts, "members")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for p, q in zip(x.column("ma"), x.column("mb"), strict=True):
                u, v = (np.frombuffer(y.as_buffer(), np.uint64) for y in (p, q))
                both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = pairs.join(texts.withColumnsRenamed({"node": "a", "members": "ma"}), "a").join(texts.withColumnsRenamed({"node": "b", "members": "mb"}), "b")
    out = written(x.mapInArrow(check, "a long, b long"), "verified")
    drop_written(texts, need)
    return out


def _across(members: DataFrame, nodes: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of members of one key in different components. Members of a large key are dealt into chunks, and each pair of chunks is one row of work."""
    m = members.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = m.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("size")).where("p <> q")
    open_keys = open_keys.select("key", F.ceil(F.col("size") / CHUNK).cast("long").alias("chunks"))
    m = written(m.join(open_keys, "key"), "open")
    firsts = m.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST_KEYS).alias("firsts"))
    m = m.join(nodes.select("node", "n", "sketch").join(firsts, "node"), "node")
    row = F.collect_list(F.struct("node", "root", "n", "sketch", "firsts")).alias("rows")
    small = m.where("chunks = 1").groupBy("key").agg(row).withColumn("others", F.when(F.lit(False), F.col("rows")))
    large = m.where("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).groupBy("key", "chunks", "chunk").agg(row)
    large = written(large, "chunks")
    left = large.select("key", F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"), F.col("rows").alias("others"))
    work = small.unionByName(left.join(large.select("key", "chunk", "rows"), ["key", "chunk"]).select("key", "rows", "others"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size = np.cumsum(sum(x.column(c).value_lengths().fill_null(0).to_numpy() for c in ("rows", "others")))
            at = 0
            while at < x.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
                part = x.slice(at, to - at)
                one, two = _pairs(part.column("rows"), part.column("others"), percent, part.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])
                at = to

    return work.mapInArrow(pair, "a long, b long").distinct()


def _pairs(rows: pa.ListArray, others: pa.ListArray, percent: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, the smaller first, of members of different components that may link, of each row's members with its others, or among themselves where those are null. All rows at once, in blocks.

    Keys below one that both carry are carried by both, so the smallest carried key that two share is the smallest they
    share at all: other keys leave the pair to it. Pairs that share none of the carried ones are told by each key.
    """
    sides = [dict(zip(("node", "root", "n", "sketch", "firsts"), x.flatten().flatten(), strict=True)) for x in (rows, others)]
    node, root, n = (np.concatenate([x[c].to_numpy() for x in sides]) for c in ("node", "root", "n"))
    firsts = np.concatenate([_padded(x["firsts"]) for x in sides])
    raw = [text_bytes(x["sketch"]) for x in sides]
    words = np.concatenate([x for x, _ in raw]).view(np.uint64)
    begin = np.concatenate([raw[0][1][:-1], raw[0][1][-1] + raw[1][1][:-1]]) // 8
    width = np.concatenate([np.diff(x) for _, x in raw]) // 8
    mine, theirs = (x.value_lengths().fill_null(0).to_numpy().astype(np.int64) for x in (rows, others))
    row, alone = np.repeat(np.arange(len(mine)), mine), others.is_null().to_numpy(zero_copy_only=False)
    end = np.where(alone, np.cumsum(mine), mine.sum() + np.cumsum(theirs))
    first = np.where(alone[row], np.arange(len(row)) + 1, end[row] - theirs[row])
    many = end[row] - first
    out, part = [np.zeros((2, 0), np.int64)], (np.cumsum(many) - many) // BLOCK
    for k in np.flatnonzero(np.diff(part, prepend=-1)):
        to = int(np.searchsorted(part, part[k], "right"))
        p, q = np.repeat(np.arange(k, to), many[k:to]), _ranges(first[k:to], many[k:to])
        ok = (root[p] != root[q]) & (node[p] != node[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
        p, q = p[ok], q[ok]
        ok = _near(_distances(words, begin, width, p, q), n[p] + n[q], percent)
        p, q = p[ok], q[ok]
        told = firsts[p][:, :, None] == firsts[q][:, None, :]
        ok = ~(told & (firsts[p] < key[row[p]][:, None])[:, :, None]).any((1, 2))
        x, y = node[p[ok]], node[q[ok]]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def _distances(words: np.ndarray, begin: np.ndarray, width: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Hamming distances of the sketches p and q, which lie one after another in `words`, the longer of two folded to the other's length; parities add."""
    out, least = np.zeros(len(p), np.int64), np.minimum(width[p], width[q])
    for w in np.unique(least).tolist():
        mine = np.flatnonzero(least == w)
        used, place = np.unique(np.concatenate([p[mine], q[mine]]), return_inverse=True)
        x = np.empty((len(used), w), np.uint64)
        for v in np.unique(width[used]).tolist():
            own = width[used] == v
            x[own] = np.bitwise_xor.reduce(words[begin[used[own]][:, None] + np.arange(v)].reshape(-1, v // w, w), axis=1)
        i, j = place[: len(mine)], place[len(mine) :]
        step = max(BLOCK // w, 1)
        for k in range(0, len(mine), step):
            out[mine[k : k + step]] = np.bitwise_count(x[i[k : k + step]] ^ x[j[k : k + step]]).sum(1)
    return out


def _padded(firsts: pa.ListArray) -> np.ndarray:
    """(rows, FIRST_KEYS), short lists filled with the largest value."""
    out = np.full((len(firsts), FIRST_KEYS), np.iinfo(np.int64).max)
    n = firsts.value_lengths().to_numpy()
    out[np.arange(FIRST_KEYS) < n[:, None]] = firsts.flatten().to_numpy()
    return out


def classes(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id: the smallest id reachable over links 100 |A and B| >= percent |A or B|.

    Null and empty texts have no shingles and link with nothing. Repeated rows each get a row; rows of one id with
    different texts are documents of their own that share their id. A null id stays null, and names no class unless the
    whole class has none. Empty tables stay empty; other columns are not read.
    """
    if not 60 < percent <= 100:  # a partner of a set is then in its own size band or the one below
        raise ValueError("percent must be above 60 and 100 at most")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(_sets(docs, words), "sets")
    nodes = written(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("size")), "nodes")
    shared = _keys(docs, words, percent).groupBy("key").agg(F.min("node").alias("p"), F.max("node").alias("q"), F.count("*").alias("size")).where("p <> q")
    shared = written(shared.select("key", "size"), "shared")
    bits = key_filter(shared)
    members = written(_keys(docs, words, percent, bits).join(shared, "key").distinct(), "members")
    weights = members.groupBy("node").agg(F.struct(F.sum("size").alias("weight"), "node").alias("central"))
    leads = members.join(weights, "node").groupBy("key").agg(F.max("central").alias("central")).select("key", F.col("central.node").alias("lead"))
    star = members.join(leads, "key").where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    star = written(_plausible(star, nodes, percent), "pairs")
    drop_written(shared)
    links = _verified(star, docs, nodes, words, percent)
    root = written(components(links), "root")
    rest = _across(members.select("key", "node"), nodes, root, percent)
    rest = written(rest.join(star, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, docs, nodes, words, percent))
        root = written(components(links), "root")
    whole = written(nodes.select("node", "rep", "size").join(root, "node", "left").select("node", "rep", F.col("size").alias("copies"), F.coalesce("root", "node").alias("root")), "whole")
    smallest = written(whole.groupBy("root").agg(F.min("rep").alias("smallest"), F.count("*").alias("size")), "smallest")
    named = written(join_split(whole, smallest, "root").select("node", "smallest", F.col("copies").alias("size")), "named")
    some = join_split(sets.where("node is not null").select("doc_id", "n", "node"), named, "node").select("doc_id", "n", "smallest")
    none = sets.where("node is null").select("doc_id", "n", F.col("doc_id").alias("smallest"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
                               ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])) END AS s FROM w),
     e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
     r AS (SELECT doc_id, n, h, row_number() OVER (PARTITION BY doc_id ORDER BY f, h) AS p
           FROM (SELECT *, count(*) OVER (PARTITION BY h) AS f FROM e)),
     c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.h = y.h AND x.doc_id < y.doc_id
           WHERE x.p <= x.n - CAST(ceil(0.85 * x.n) AS BIGINT) + 1 AND y.p <= y.n - CAST(ceil(0.85 * y.n) AS BIGINT) + 1
             AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
     l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
           WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
     g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     t AS (WITH RECURSIVE t(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT g.a, t.c FROM t JOIN g ON g.b = t.d WHERE t.c < g.a)
           SELECT d, min(c) AS c FROM t GROUP BY d)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, t.c AS component_id FROM s JOIN t ON t.d = s.doc_id"""
