"""Near-duplicate passages by compact windows.

For each of HASHES hash functions, the Cartesian tree over the hashes of a document's 5-word shingles gives its compact
windows (l, c, r): every stretch inside [l, r] that holds c has its minimum there. Stretches that are alike share
minima, so windows meet by the hash at c. Equal minima are linked through the smallest document that holds them, alone
and together with the words after or before, so that a short common line doesn't hide a longer passage. Windows that met
are joined as intervals: where those of two hash functions take in one stretch of LEAST_WORDS in both documents, it has
both minima in common and is a candidate, and each is verified on the words around it, lined up.
Alike stretches have an exact run of RUN shingles in common, which holds a minimum of the first hash function with its
context on one side. So holders of such a context that stay unlinked to the smallest one are compared with every other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .jaccard import FILTER_BITS, key_filter
from .shared import _ranges, anti_by_id, drop_written, mix, semi_by_id, shingle_hashes, signed, slices, text_bytes, word_hashes, written

SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
HASHES = 3
#: Shingles of an exact run that any two alike stretches share: of LEAST_WORDS words, a changed word leaves so many on one side.
RUN = 20
#: Shingles before or after c that a context takes in, so that a run of RUN holds one of the two; words on either side of an anchor that verification reads; anchors nearer than STEP on a diagonal are one.
CONTEXT, REACH, STEP, GAP = RUN // 2, 56, 32, 8
#: Shingles on either side of c up to which a window's bounds are kept, more than twice what verification reads.
WIDE = 127
#: Holders of a context that one task compares with as many others, and pairs that it compares at once.
CHUNK, AT_ONCE = 512, 1 << 15
#: Pairs for each of the tasks that compare them.
PAIRS = 100_000


def _window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every window of `size`, by doubling."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def centres(v: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The c of all compact windows that span `least` or more, in order, without building the trees: a node spans so many just where it is the minimum of a stretch of `least`. Values count by their first 40 bits, equal ones from the left."""
    if len(v) < least:
        return np.zeros(0, np.int64)
    n = np.diff(at)
    place = np.minimum(_ranges(np.zeros(len(n), np.int64), n), (1 << 24) - 1).astype(np.uint64)
    x = (v & ~np.uint64((1 << 24) - 1)) | place
    low = _window_minima(x, least)
    room = np.repeat(at[1:], n) - np.arange(len(v)) >= least  # the stretch that begins here ends in its row
    low = np.where(room[: len(low)], low, 0)
    padded = np.zeros(len(v) + least - 1, np.uint64)
    padded[least - 1 : least - 1 + len(low)] = low
    high = ~_window_minima(~padded, least)  # the greatest of the minima of the stretches that hold a place
    return np.flatnonzero((high == x) & (high > 0))


def compact_windows(v: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of the rows' Cartesian trees that span `least` or more; r is exclusive, the leftmost minimum counts.

    A node ends before its nearest ancestors on either side, which span more than it does, so the trees are built over
    `centres` alone, with one stack, in time that follows their number.
    """
    c = centres(v, at, least)
    row = np.searchsorted(at, c, "right") - 1
    begin, end = at[row], at[row + 1]
    place = np.minimum(c - begin, (1 << 24) - 1).astype(np.uint64)
    l, r, stack, inside = begin.tolist(), end.tolist(), [], -1
    for k, (x, m, i) in enumerate(zip(((v[c] & ~np.uint64((1 << 24) - 1)) | place).tolist(), c.tolist(), row.tolist(), strict=True)):
        if i != inside:
            stack, inside = [], i
        while stack and stack[-1][0] > x:
            r[stack.pop()[1]] = m
        if stack:
            l[k] = stack[-1][2] + 1
        stack.append((x, k, m))
    return np.array(l, np.int64), c, np.array(r, np.int64)


def _held(bits, key: np.ndarray) -> np.ndarray:
    """Whether a broadcast filter of keys has them."""
    bit = key & np.uint64(FILTER_BITS - 1)
    return (bits.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _first(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One place of each key of a row."""
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(row[order]) != 0)
    return order[new]


def _ends(key: np.ndarray, c: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The places of a key, of those within RUN words of each other (a line said over and over) the first, the last and one for each STEP words between, which verification covers."""
    order = np.lexsort((c, key, row))
    k, at, i = key[order], c[order], row[order]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (at[1:] - at[:-1] > RUN)
    begin = np.flatnonzero(new[:-1])
    step = (at - np.repeat(at[begin], np.diff(np.append(begin, len(at))))) // STEP
    keep = new[:-1] | new[1:]
    keep[1:] |= step[1:] != step[:-1]
    return np.sort(order[keep])


def _occurrences(docs: DataFrame, only=None) -> DataFrame:
    """key, doc_id; with `only`, a broadcast filter of keys: also the word position of c, its window, and the contexts after and before. Of the first hash function also windows of RUN.

    `span` holds a window's shingles before c, those from c on (both WIDE at most) and the hash function, in 7, 7 and 2 bits.
    """
    least = LEAST_WORDS - SHINGLE + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words, _, _, word_at = word_hashes(*text_bytes(b.column("text")))
            n_words = np.diff(word_at)
            s, at = shingle_hashes(words, word_at, SHINGLE)
            short = n_words < LEAST_WORDS
            row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            parts = []
            for h in range(HASHES):
                v = mix(s ^ mix(np.array([h + 1], np.uint64))[0])
                size = least if h else RUN
                if only is None:
                    c = centres(v, at, size)
                    span = np.zeros(len(c), np.int32)
                else:
                    l, c, r = compact_windows(v, at, size)
                    span = (np.minimum(c - l, WIDE) << 9 | np.minimum(r - c, WIDE) << 2 | h).astype(np.int32)
                row = row_of[c]
                ok = ~short[row]
                c, row, span = c[ok], row[ok], span[ok]
                key = mix(v[c] + np.uint64(h))
                if only is not None:
                    ok = _held(only, key)
                    key, c, row, span = key[ok], c[ok], row[ok], span[ok]
                parts.append((key, c, row, span))
            key, c, row, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            told = _ends(key, c, row) if only is not None else _first(key, row)
            key, c, row, span = key[told], c[told], row[told], span[told]
            doc = b.column("doc_id").take(pa.array(row))
            if only is None:
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), doc], ["key", "doc_id"])
                continue
            after, before = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(1, CONTEXT + 1):
                    j = np.minimum(c + k, at[row + 1] - 1)
                    after = (after + s[j]) * np.uint64(0xD6E8FEB86659FD93)
                    j = np.maximum(c - k, at[row])
                    before = (before + s[j]) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), doc, pa.array(span), pa.array((c - at[row]).astype(np.int32)), pa.array(signed(mix(after ^ key))), pa.array(signed(mix(before ^ ~key)))], ["key", "doc_id", "span", "at", "after", "before"])

    return docs.mapInArrow(make, "key long, doc_id long" + (", span int, at int, after long, before long" if only is not None else ""))


def _lead(groups: DataFrame, *also: str) -> DataFrame:
    """(g, lead): the smallest (doc_id, at, also) of each group that more than one document is in, written, so that a hot group's rows are split in the join with it."""
    lead = groups.groupBy("g").agg(F.min(F.struct("doc_id", "at", *also)).alias("lead"), F.max("doc_id").alias("last")).where(F.col("lead.doc_id") != F.col("last"))
    return written(lead.select("g", "lead"), "leads")


def _agreeing(pair: np.ndarray, at: np.ndarray, span: np.ndarray, other_at: np.ndarray, other_span: np.ndarray) -> np.ndarray:
    """Which links, sorted by (pair, at), have another one of their pair and of another hash function so that in both documents one stretch of LEAST_WORDS lies in both windows and holds both minima."""
    least = LEAST_WORDS - SHINGLE + 1
    sides = [[z.astype(np.int32) for z in (c, c - (s >> 9), c + (s >> 2 & WIDE))] for c, s in ((at, span), (other_at, other_span))]
    h = span & 3

    def meet(x, y) -> np.ndarray:
        ok = h[x] != h[y]
        for c, l, r in sides:
            begin, end = np.maximum(l[x], l[y]), np.minimum(r[x], r[y])
            ok &= (begin <= np.minimum(c[x], c[y])) & (end > np.maximum(c[x], c[y])) & (end - begin >= least)
        return ok

    out = np.zeros(len(at), bool)
    for d in range(1, min(5, len(at))):  # most links meet one of the next few
        x, y = slice(None, -d), slice(d, None)
        ok = meet(x, y) & (pair[x] == pair[y])
        out[x] |= ok
        out[y] |= ok
    place = pair * (1 << 32) + at
    rest = np.flatnonzero(~out)
    low = np.searchsorted(place, place[rest] - (span[rest] >> 9))
    n = np.searchsorted(place, place[rest] + (span[rest] >> 2 & WIDE)) - low
    for k in range(0, len(rest), 1024):  # a place has few links, so that the blocks' pairs are bounded
        mine = n[k : k + 1024]
        x, y = np.repeat(rest[k : k + 1024], mine), _ranges(low[k : k + 1024], mine)
        ok = meet(x, y)
        out[x[ok]] = out[y[ok]] = True
    return out


def _candidates(occurrences: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(doc_id, at, other, other_at): one anchor for each STEP words of a diagonal where windows of two hash functions meet as intervals, on whatever diagonals, as inserted and deleted words move the rest to others. `spent` gets the tables that nothing needs when the result is written."""
    found = None
    wide = F.shiftright("span", 9) + F.shiftright("span", 2).bitwiseAND(WIDE) >= LEAST_WORDS - SHINGLE + 1
    for group in ("key", "after", "before"):
        o = occurrences.where(wide).select(F.col(group).alias("g"), "doc_id", "at", "span")
        lead = F.col("lead")
        spent.append(_lead(o, "span"))
        p = o.join(spent[-1], "g").where(F.col("doc_id") != lead["doc_id"]).select("doc_id", lead["doc_id"].alias("other"), "at", "span", lead["at"].alias("other_at"), lead["span"].alias("other_span"))
        found = p if found is None else found.unionByName(p)
    names = found.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links come sorted; those that later ones may still meet wait for them."""
        open_ = np.zeros((7, 0), np.int64)  # the columns, and whether a link has met another

        def told(x: np.ndarray) -> pa.RecordBatch:
            doc, other, at, _, other_at, _, _ = x[:, x[6] > 0]
            same = [at // STEP, at - other_at, other, doc]
            order = np.lexsort(same)
            new = np.ones(len(order), bool)
            new[1:] = np.any([np.diff(c[order]) != 0 for c in same], axis=0)
            first = order[new]
            return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first].astype(np.int32)), pa.array(other[first]), pa.array(other_at[first].astype(np.int32))], ["doc_id", "at", "other", "other_at"])

        for b in batches:
            if not b.num_rows:
                continue
            new = np.stack([*(b.column(c).to_numpy().astype(np.int64) for c in names), np.zeros(b.num_rows, np.int64)])
            x = np.concatenate([open_, new], axis=1)
            x = x[:, np.concatenate([[True], (np.diff(x[:6]) != 0).any(0)])]  # links by key and by contexts may be the same
            pair = np.cumsum(np.concatenate([[0], (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)]))
            x[6] |= _agreeing(pair, *x[2:6])
            wait = (pair == pair[-1]) & (x[2] > x[2, -1] - WIDE)
            open_ = x[:, wait]
            yield told(x[:, ~wait])
        yield told(open_)

    return found.repartition("doc_id", "other").sortWithinPartitions(*names).mapInArrow(join, "doc_id long, at int, other long, other_at int")


def _unlinked(occurrences: DataFrame, held: DataFrame) -> DataFrame:
    """(g, doc_id, at, open, root): who holds the contexts of the first hash function's minima, of contexts where `held` leaves a holder unlinked to the smallest one, itself or over others; those holders are open. Documents that links lead between have one root."""
    first = occurrences.where("span & 3 = 0")
    runs = first.select(F.col("after").alias("g"), "doc_id", "at").unionByName(first.select(F.col("before").alias("g"), "doc_id", "at"))
    lead = written(runs.groupBy("g").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead <> last").select("g", "lead"), "leads")
    links = runs.join(lead, "g").where("doc_id <> lead")
    h = held.select("doc_id", F.col("other").alias("lead"), "begin", "end").distinct()
    apart = written(links.join(h, [links["doc_id"] == h["doc_id"], links["lead"] == h["lead"], h["begin"] <= links["at"], h["end"] > links["at"]], "left_anti").select("g", "doc_id", "at", "lead"), "unlinked")
    # a place in a passage of another document is linked if that leads to the smallest holder
    classes = written(components(held.select(F.xxhash64("doc_id").alias("a"), F.xxhash64("other").alias("b"))), "classes")
    mine, theirs = classes.select(F.col("node").alias("n1"), F.col("root").alias("r1")), classes.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
    apart, spent = apart.join(mine, F.xxhash64("doc_id") == F.col("n1"), "left").join(theirs, F.xxhash64("lead") == F.col("n2"), "left"), apart
    apart = written(apart.select("g", "doc_id", "at", F.coalesce(F.col("r1") == F.col("r2"), F.lit(False)).alias("met")), "unlinked")
    inside = held.select("doc_id", "begin", "end").unionByName(held.select(F.col("other").alias("doc_id"), (F.col("begin") - F.col("diagonal")).alias("begin"), F.col("other_end").alias("end"))).distinct()
    linked, drop = apart.where("met"), [lead, spent, classes, apart]
    apart = linked.join(inside, [linked["doc_id"] == inside["doc_id"], inside["begin"] <= linked["at"], inside["end"] > linked["at"]], "left_anti").unionByName(apart.where("not met")).drop("met")
    apart = written(apart, "unlinked")
    members = runs.join(apart.select("g").distinct(), "g", "left_semi")
    out = members.join(apart.withColumn("open", F.lit(True)), ["g", "doc_id", "at"], "left").select("g", "doc_id", "at", F.coalesce("open", F.lit(False)).alias("open"))
    root = F.coalesce("r1", F.xxhash64("doc_id")).alias("root")
    out = written(out.join(mine, F.xxhash64("doc_id") == F.col("n1"), "left").select("g", "doc_id", "at", "open", root), "members")
    drop_written(*drop, apart)
    return out


def _compared(members: DataFrame, stretches: DataFrame) -> DataFrame:
    """Rows as of _verified for members as of _unlinked, each open one compared with every other of its context, in blocks of CHUNK by CHUNK; of a block's links those that join documents, and between joined ones those in line that reach open places."""
    chunks = lambda c: F.greatest(F.ceil(c / CHUNK), F.lit(1)).cast("int")
    counted = members.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("m"))
    tasks = 1 + min(int(counted.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]) // PAIRS, 1 << 14)
    size = counted.select("g", chunks(F.col("n")).alias("all"), chunks(F.col("m")).alias("asking"))
    dealt = lambda k: F.pmod(F.xxhash64("doc_id", "at"), F.col(k)).cast("int")
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    m = members.join(size, "g").join(stretches.select("doc_id", "at", "first", "words"), ["doc_id", "at"])
    ask = m.where("open").withColumn("i", dealt("asking")).withColumn("j", numbers("all")).withColumn("asks", F.lit(True))
    told = m.withColumn("j", dealt("all")).withColumn("i", numbers("asking")).withColumn("asks", F.lit(False))
    columns = ["g", "i", "j", "asks", "doc_id", "at", "open", "root", "first", "words"]
    blocks = ask.select(columns).unionByName(told.select(columns)).repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j", "asks", "doc_id", "at")

    def block_pairs(x: pa.RecordBatch):
        """Rows of pairs (one that asks, one that is told) of each block, AT_ONCE or a little more together."""
        key = np.stack([x.column(c).to_numpy().astype(np.int64) for c in ("g", "i", "j")])
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(0)]))
        asks = x.column("asks").to_numpy(zero_copy_only=False)
        end = np.append(begin[1:], len(asks))
        block = np.repeat(np.arange(len(begin)), end - begin)
        asked = np.add.reduceat((~asks).astype(np.int64), begin)
        who = np.flatnonzero(asks)
        n = asked[block[who]]
        part = (np.cumsum(n) - n) // AT_ONCE
        for k in np.flatnonzero(np.concatenate([[True], np.diff(part) != 0])) if len(who) else ():
            to = int(np.searchsorted(part, part[k], "right"))
            yield np.repeat(who[k:to], n[k:to]), _ranges(begin[block[who[k:to]]], n[k:to]), block

    def compare(x: pa.RecordBatch) -> pa.RecordBatch:
        doc, at, first, root = (x.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "at", "first", "root"))
        is_open = x.column("open").to_numpy(zero_copy_only=False)
        words, there = _around(x.column("words"), at - first)
        # a run of RUN shingles that holds the anchor
        near = words[:, REACH - RUN + 1 : REACH + RUN + SHINGLE - 1].copy()
        near[~there[:, REACH - RUN + 1 : REACH + RUN + SHINGLE - 1]] = 0
        shingles = _shingled_rows(words, there)
        bits, least, different = _sketches(shingles)
        mid, out, node, joined = RUN - 1, [], None, None
        ends = _run_ends(near, mid)
        for p, q, block in block_pairs(x):
            if node is None:
                node, place = (np.unique(np.stack(z), axis=1, return_inverse=True)[1].reshape(-1) for z in ([block, root], [block, doc, at]))
                joined, due = np.arange(len(doc)), np.zeros(len(doc), bool)
                due[place[is_open]] = True
            for one, other in ends:
                ok = np.flatnonzero((one[p] == one[q]) | (other[p] == other[q]))
                p, q = p[ok], q[ok]
            # of two open ones the greater asks
            ok = (doc[p] > doc[q]) | (doc[p] < doc[q]) & ~is_open[q]
            p, q = p[ok], q[ok]
            same = near[p] == near[q]
            run = np.logical_and.accumulate(same[:, mid::-1], axis=1).sum(1) + np.logical_and.accumulate(same[:, mid:], axis=1).sum(1) - 1
            ok = np.flatnonzero(run >= RUN + SHINGLE - 1)
            ok = ok[np.bitwise_count(bits[p[ok]] & bits[q[ok]]).sum(1) >= np.maximum(least[p[ok]], least[q[ok]])]
            ok = ok[np.lexsort((doc[p[ok]], at[q[ok]], doc[q[ok]], block[p[ok]]))]  # the first ones join most, and what is joined is not asked again
            p, q = p[ok], q[ok]
            for k in range(0, len(p), 512):
                a, b = p[k : k + 512], q[k : k + 512]
                apart = joined[node[a]] != joined[node[b]]
                for shifted, ask in ((True, apart), (False, ~apart & (due[place[a]] | due[place[b]]))):
                    i, j = np.where(doc[a] > doc[b], a, b)[ask], np.where(doc[a] > doc[b], b, a)[ask]
                    hits = verify_all(words[i], there[i], words[j], there[j], shifted, (shingles, i, j, different)) if len(i) else []
                    for i, j, h in zip(i.tolist(), j.tolist(), hits, strict=True):  # noqa: B020
                        if h is not None and (joined[node[i]] != joined[node[j]] or due[place[i]] or due[place[j]]):
                            joined[joined == joined[node[i]]] = joined[node[j]]
                            due[place[i]] = due[place[j]] = False
                            out.append((doc[i], doc[j], first[i] + h[0] - first[j] - h[2], first[i] + h[0], first[i] + h[1], first[j] + h[3]))
        cols = np.array(out, np.int64).reshape(-1, 6).T
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "other", "diagonal", "begin", "end", "other_end"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted; the last one of a batch waits for its rest."""
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            key = np.stack([x.column(c).to_numpy().astype(np.int64) for c in ("g", "i", "j")])
            cut = int(np.argmax((key == key[:, -1:]).all(0)))
            if cut:
                yield compare(x.slice(0, cut))
            rest = x.slice(cut)
        if rest is not None:
            yield compare(rest)

    return blocks.mapInArrow(make, "doc_id long, other long, diagonal long, begin long, end long, other_end long")


def _run_ends(near: np.ndarray, mid: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of hashes of the words just before column mid and of those from it on, of which rows have one of each pair in common where they have an exact run of RUN shingles over mid: a run with fewer than `left` words before mid has the rest of its words from mid on. A context holds after mid or before it what is left of either pair."""
    whole, context = RUN + SHINGLE - 1, CONTEXT + SHINGLE - 1

    def hashed(w: np.ndarray) -> np.ndarray:
        h = np.zeros(len(w), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(w.shape[1]):
                h = (h + w[:, k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        return h

    return [(hashed(near[:, mid - left : mid]), hashed(near[:, mid : mid + whole - left + 1])) for left in ((whole - context) // 2, context + 1)]


def _rest(docs: DataFrame, occurrences: DataFrame, held: DataFrame) -> DataFrame:
    """`held` and what it leaves out: the links of those that the smallest holder of a context does not link."""
    members = _unlinked(occurrences, held)
    if members.isEmpty():
        drop_written(members)
        return held
    stretches = _stretches(docs, members.select("doc_id", "at"))
    more = written(_compared(members, stretches), "linked")
    drop_written(members, stretches)
    return held.unionByName(more)


def _stretches(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, at, words, first): 32-bit hashes of the words around each wanted anchor of a document, and the first one's position."""
    wanted = written(anchors.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("ats")), "anchors")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words, _, _, at = word_hashes(*text_bytes(b.column("text")))
            small = (words >> np.uint64(32)).astype("<u4")
            row, anchor, first, out = [], [], [], []
            for i, ats in enumerate(b.column("ats").to_pylist()):
                mine = small[at[i] : at[i + 1]]
                for a in ats:
                    p = max(0, a - REACH)
                    row.append(i)
                    anchor.append(a)
                    first.append(p)
                    out.append(mine[p : a + SHINGLE + REACH].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(anchor, pa.int32()), pa.array(first, pa.int32()), pa.array(out, pa.binary())], ["doc_id", "at", "first", "words"])

    d = semi_by_id(docs, wanted.select("doc_id"), "doc_id")
    out = written(d.join(wanted, "doc_id").mapInArrow(make, "doc_id long, at int, first int, words binary"), "stretches")
    drop_written(wanted)
    return out


def _shingled(w: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of 32-bit word hashes."""
    h = np.zeros(max(len(w) - SHINGLE + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h + w[k : k + len(h)]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h


def _chain(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The longest run of pairs (p, q), x[p] = y[q], that ascends in both."""
    where: dict[int, list[int]] = {}
    for q, v in enumerate(y):
        where.setdefault(v, []).append(q)
    tails, nodes = [], []
    for p, v in enumerate(x):
        for q in reversed(where.get(v, ())):
            k = bisect_left(tails, q)
            node = (p, q, nodes[k - 1] if k else None)
            if k < len(tails):
                tails[k], nodes[k] = q, node
            else:
                tails.append(q)
                nodes.append(node)
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int] | None:
    """Begin and end in a and in b of the longest alike stretches: shingles in line, whatever the diagonals, end on both sides, and the sets have a Jaccard similarity of SIMILARITY."""
    x, y = _shingled(a).tolist(), _shingled(b).tolist()
    n = LEAST_WORDS - SHINGLE + 1
    if len(set(x).intersection(y)) < SIMILARITY * n:
        return None
    pairs = np.array(_chain(x, y), np.int64).reshape(-1, 2)
    p, q, m = pairs[:, 0], pairs[:, 1], np.arange(1, len(pairs) + 1)
    u, v, common = (z[None, :] - z[:, None] + 1 for z in (p, q, m))
    s, t = np.nonzero((u >= n) & (v >= n) & (common >= SIMILARITY * (u + v - common)))
    for k in np.argsort(s - t, kind="stable"):
        e, f = slice(p[s[k]], p[t[k]] + 1), slice(q[s[k]], q[t[k]] + 1)
        g, h = set(x[e]), set(y[f])
        if len(g & h) >= SIMILARITY * len(g | h):
            return int(e.start), int(e.stop) + SHINGLE - 1, int(f.start), int(f.stop) + SHINGLE - 1
    return None


def _stretch(same: np.ndarray, k: int) -> tuple[int, int] | None:
    """The longest stretch of a diagonal, in words, around word k whose shingles in line give a Jaccard similarity of SIMILARITY, ends included; None where there is none of LEAST_WORDS."""
    n = len(same) - SHINGLE + 1
    if n < LEAST_WORDS - SHINGLE + 1:
        return None
    full = np.ones(n, bool)
    for d in range(SHINGLE):
        full &= same[d : d + n]
    # common shingles c of n on each side have similarity c / (2 n - c)
    f = np.concatenate([[0.0], np.cumsum(full - 2 * SIMILARITY / (1 + SIMILARITY))])
    k = min(k, n - 1)
    starts, ends = np.flatnonzero(full[: k + 1]), np.flatnonzero(full[max(k - SHINGLE + 1, 0) :]) + max(k - SHINGLE + 1, 0)
    if not len(starts) or not len(ends):
        return None
    best = np.maximum.accumulate(f[ends + 1][::-1])[::-1]  # falls with the end, so the last end that reaches is found by bisection
    last = len(ends) - np.searchsorted(best[::-1], f[starts] - 1e-9, "left") - 1
    size = np.where(last >= 0, ends[np.maximum(last, 0)] - starts + SHINGLE, 0)
    j = int(size.argmax())
    return (int(starts[j]), int(starts[j] + size[j])) if size[j] >= LEAST_WORDS else None


def verify(a: np.ndarray, b: np.ndarray, i: int, j: int, shifted: bool = True) -> tuple[int, int, int, int] | None:
    """Begin and end in a and in b of the stretches around the anchor a[i] = b[j] that are alike.

    Along the diagonal the match may go on over at most GAP differing words in a row, and must have a Jaccard similarity
    of SIMILARITY in shingles; exact runs of LEAST_WORDS hold as they are where nothing longer does; else words may be
    inserted or deleted, and the two stretches are lined up, if `shifted`. None otherwise.
    """
    lo, hi = -min(i, j), min(len(a) - i, len(b) - j)
    if hi <= 0:
        return None
    same = a[i + lo : i + hi] == b[j + lo : j + hi]
    if not same[-lo]:
        return None
    bad = np.flatnonzero(~same)
    k = int(np.searchsorted(bad, -lo))
    begin, end = int(bad[k - 1]) + 1 if k else 0, int(bad[k]) if k < len(bad) else len(same)
    exact = (begin, end) if end - begin >= LEAST_WORDS else None
    ok = np.flatnonzero(same)
    cut = np.flatnonzero(np.diff(ok) > GAP + 1)
    c = int(np.searchsorted(cut, int(np.searchsorted(ok, -lo))))
    p, q = int(ok[cut[c - 1] + 1] if c else ok[0]), int(ok[cut[c]] if c < len(cut) else ok[-1]) + 1
    found = exact
    if q - p > end - begin:
        longer = _stretch(same[p:q], -lo - p)
        if longer and (exact is None or longer[1] - longer[0] > end - begin):
            found = p + longer[0], p + longer[1]
    if found is None and q - p >= LEAST_WORDS:
        x, y = (set(_shingled(z).tolist()) for z in (a[i + lo + p : i + lo + q], b[j + lo + p : j + lo + q]))
        if len(x & y) >= SIMILARITY * len(x | y):
            found = p, q
    if found:
        p, q = found[0] + lo, found[1] + lo
        return i + p, i + q, j + p, j + q
    return _aligned(a, b) if shifted else None


def _around(words: pa.Array, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, REACH + SHINGLE + REACH) words with the anchor, word `offset` of each row, in column REACH, and which of them there are."""
    a = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u4") if len(a) and at[-1] > at[0] else np.zeros(0, "<u4")
    n = np.diff(at) // 4
    out, there = np.zeros((len(a), 2 * REACH + SHINGLE), np.uint32), np.zeros((len(a), 2 * REACH + SHINGLE), bool)
    row, column = np.repeat(np.arange(len(a)), n), _ranges(REACH - offset, n)
    out[row, column], there[row, column] = flat, True
    return out, there


def verify_all(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, shifted: bool = True, shingles: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None] | None = None) -> list[tuple[int, int, int, int] | None]:
    """verify() for rows of words around an anchor in column REACH, with what there is of them: all rows at once where a run or a whole stretch decides, else row by row. `shingles` holds _shingled_rows(), which of them are a's and b's, and how many different ones each has, where they are made already."""
    same = (a == b) & ra & rb
    n, width = same.shape
    if shingles and shingles[3] is not None:
        # rows with few different shingles have few in common, so that no stretches line up: only those whose line has a stretch are asked
        many = np.minimum(*(shingles[3][k] for k in shingles[1:3])) >= SIMILARITY * (LEAST_WORDS - SHINGLE + 1)
        ask = np.flatnonzero(same[:, REACH] & (many | (_same_within(same, *_limits(same))[1] >= LEAST_WORDS)))
        out: list = [None] * n
        if len(ask):
            for k, h in zip(ask.tolist(), verify_all(a[ask], ra[ask], b[ask], rb[ask], shifted, (shingles[0], shingles[1][ask], shingles[2][ask], None)), strict=True):
                out[k] = h
        return out
    run = lambda x: np.logical_and.accumulate(x, axis=1).sum(1)
    begin, end = REACH + 1 - run(same[:, REACH::-1]), REACH + run(same[:, REACH:])
    p, q = _limits(same)
    full = np.logical_and.reduce([same[:, d : width - SHINGLE + 1 + d] for d in range(SHINGLE)])
    column = np.arange(full.shape[1])
    inside = full & (column >= p[:, None]) & (column + SHINGLE <= q[:, None])
    s, t = inside.argmax(1), full.shape[1] - 1 - inside[:, ::-1].argmax(1)
    m, common = t - s + 1, inside.sum(1)
    whole = inside.any(1) & (s <= REACH) & (t + SHINGLE > REACH) & (m + SHINGLE - 1 >= LEAST_WORDS) & (common * (1 + SIMILARITY) >= 2 * SIMILARITY * m)
    exact = end - begin >= LEAST_WORDS
    done = same[:, REACH] & (whole | exact & (m + SHINGLE - 1 <= end - begin))
    out = [None] * n
    first = ra.argmax(1), rb.argmax(1)
    for k in np.flatnonzero(done).tolist():
        x, y = (int(s[k]), int(t[k]) + SHINGLE) if whole[k] else (int(begin[k]), int(end[k]))
        out[k] = (x - int(first[0][k]), y - int(first[0][k]), x - int(first[1][k]), y - int(first[1][k]))
    rest = np.flatnonzero(same[:, REACH] & ~done)
    if len(rest):
        in_line = _any_in_line(full[rest])
        x, y = (shingles[0][k[rest]] for k in shingles[1:3]) if shingles else (_shingled_rows(a[rest], ra[rest]), _shingled_rows(b[rest], rb[rest]))
        alike, distinct = _common(x, y)
        # where all that is common is in line, and no stretch of the line is alike, other lines have nothing to add
        more = exact[rest] | (alike >= SIMILARITY * (LEAST_WORDS - SHINGLE + 1)) & ((alike > full[rest].sum(1)) | in_line)
        # too few different shingles in common: no stretches line up, and what repeats shingles is alike on its own line or not at all
        sure = exact[rest] | in_line | (distinct >= SIMILARITY * (LEAST_WORDS - SHINGLE + 1))
        ask = np.flatnonzero(more & ~exact[rest] & ~in_line)
        met = _alike_in_line(x[ask], y[ask], same[rest[ask]], p[rest[ask]], q[rest[ask]])
        sure[ask] |= met
        ask = ask[~met]
        ask = ask[sure[ask]]
        more[ask] = _may_line_up(x[ask], y[ask]) if shifted else False  # nothing but other lines is left for these
        rest = rest[more & sure]
    for k in rest.tolist():
        out[k] = verify(a[k][ra[k]], b[k][rb[k]], REACH - int(first[0][k]), REACH - int(first[1][k]), shifted)
    return out


def _common(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows of shingle hashes have in common: how many equal ones lie side by side when sorted together, repeats in a row too, and how many different ones are in both."""
    z = np.sort(np.concatenate([x & ~np.uint64(1), y], axis=1), axis=1)  # of equal ones those of x come first
    equal = ((z[:, 1:] ^ z[:, :-1]) <= 1) & (z[:, 1:] > 1)
    return equal.sum(1), (equal & (z[:, 1:] != z[:, :-1])).sum(1)


def _alike_in_line(x: np.ndarray, y: np.ndarray, same: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the words [p, q) of both rows, from the first equal word to the last, are LEAST_WORDS or more and have a Jaccard similarity of SIMILARITY in different shingles."""
    p, size = _same_within(same, p, q)
    out = size >= LEAST_WORDS
    x, y, p, q = x[out], y[out], p[out], (p + size)[out]
    column = np.arange(x.shape[1])
    inside = (column >= p[:, None]) & (column + SHINGLE <= q[:, None])
    x, y = np.where(inside, x, 0), np.where(inside, y, 0)
    sizes = 0
    for z in (np.sort(x, axis=1), np.sort(y, axis=1)):
        sizes = sizes + (z[:, :1] > 0).sum(1) + ((z[:, 1:] != z[:, :-1]) & (z[:, 1:] > 0)).sum(1)
    common = _common(x, y)[1]
    out[out] = common >= SIMILARITY * (sizes - common)
    return out


def _limits(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each row's stretch around column REACH, which ends where more than GAP words in a row differ."""
    total = np.concatenate([np.zeros((len(same), 1), np.int16), np.cumsum(same, axis=1, dtype=np.int16)], axis=1)
    empty = total[:, GAP + 1 :] == total[:, : -GAP - 1]  # [k, k + GAP + 1) has no match
    left, right = empty[:, : REACH - GAP][:, ::-1], empty[:, REACH + 1 :]
    p = np.where(left.any(1), REACH - left.argmax(1), 0)
    q = np.where(right.any(1), REACH + 1 + right.argmax(1), same.shape[1])
    return p, q


def _same_within(same: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first equal word of [p, q) of each row, and how many words it is from there to the last one's end."""
    column = np.arange(same.shape[1])
    ok = same & (column >= p[:, None]) & (column < q[:, None])
    first = ok.argmax(1)
    return first, ok.shape[1] - ok[:, ::-1].argmax(1) - first


def _sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2048 bits of the shingles of each row, how many of them every row must share that has an alike stretch: what is common there, less what repeats in the row or falls on one bit; and how many different shingles it has."""
    n = LEAST_WORDS - SHINGLE + 1
    out = np.zeros((len(x), 2049), bool)
    out[np.arange(len(x))[:, None], np.where(x > 0, x >> np.uint64(53), np.uint64(2048)).astype(np.int64)] = True
    bits = np.packbits(out[:, :2048], axis=1).view(np.uint64)
    z = np.sort(x, axis=1)
    different = (z[:, :1] > 0).sum(1) + ((z[:, 1:] != z[:, :-1]) & (z[:, 1:] > 0)).sum(1)
    again = (x > 0).sum(1) - different
    common = np.minimum(SIMILARITY * (n - again), 2 * SIMILARITY / (1 + SIMILARITY) * n - again)
    return bits, common - (different - np.bitwise_count(bits).sum(1)), different


def _may_line_up(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether both rows of each pair have a stretch of LEAST_WORDS of whose shingles a share of SIMILARITY is in the other row, and one of them such a stretch of the share that the shorter of two stretches that line up has."""
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), 128):
        equal = (x[k : k + 128, :, None] == y[k : k + 128, None, :]) & (x[k : k + 128, :, None] > 0)
        mine, theirs = equal.any(2), equal.any(1)
        out[k : k + 128] = _any_in_line(mine, SIMILARITY) & _any_in_line(theirs, SIMILARITY) & (_any_in_line(mine) | _any_in_line(theirs))
    return out


def _any_in_line(full: np.ndarray, share: float = 2 * SIMILARITY / (1 + SIMILARITY)) -> np.ndarray:
    """Whether rows of common shingles in line have a stretch of LEAST_WORDS that begins and ends with one and of which `share` are common, by default what gives a Jaccard similarity of SIMILARITY."""
    far = LEAST_WORDS - SHINGLE
    f = np.cumsum(full - share, axis=1)
    before = np.concatenate([np.zeros((len(f), 1)), f[:, :-1]], axis=1)
    least = np.minimum.accumulate(np.where(full, before, np.inf), axis=1)
    return (full[:, far:] & (f[:, far:] - least[:, : full.shape[1] - far] >= -1e-9)).any(1)


def _shingled_rows(w: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of rows of words, 0 where there is none."""
    n = w.shape[1] - SHINGLE + 1
    h, ok = np.zeros((len(w), n), np.uint64), np.ones((len(w), n), bool)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h + w[:, k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            ok &= there[:, k : k + n]
    return np.where(ok, h | np.uint64(1), 0)


def _verified(pairs: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc_id, other, diagonal, begin, end, other_end) of the candidates that hold; the diagonal is the one they begin on."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                x = batch.slice(k, 4096)
                doc, at, first, other, o_at, o_first = (x.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "at", "first", "other", "other_at", "other_first"))
                hits = verify_all(*_around(x.column("words"), at - first), *_around(x.column("other_words"), o_at - o_first))
                keep = np.array([h is not None for h in hits], bool)
                h = np.array([h for h in hits if h is not None], np.int64).reshape(-1, 4).T
                f, g = first[keep], o_first[keep]
                cols = doc[keep], other[keep], f + h[0] - g - h[2], f + h[0], f + h[1], g + h[3]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "other", "diagonal", "begin", "end", "other_end"])

    mine = stretches.select("doc_id", "at", "first", "words")
    theirs = stretches.select(F.col("doc_id").alias("other"), F.col("at").alias("other_at"), F.col("first").alias("other_first"), F.col("words").alias("other_words"))
    return pairs.join(mine, ["doc_id", "at"]).join(theirs, ["other", "other_at"]).mapInArrow(make, "doc_id long, other long, diagonal long, begin long, end long, other_end long")


def _held_links(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """_verified() of written candidates, written under a name; the candidates and the words around them are deleted then."""
    ends = pairs.select("doc_id", "at").unionByName(pairs.select(F.col("other").alias("doc_id"), F.col("other_at").alias("at")))
    stretches = _stretches(docs, ends)
    out = written(_verified(pairs, stretches), name)
    drop_written(pairs, stretches)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, begin, end, other_id, other_begin, other_end): words [begin, end) of a document that repeat in another as its words [other_begin, other_end), with words replaced, inserted or deleted.

    Passages have LEAST_WORDS words or more. Every document with a passage that another has is in some row, on either
    side, not every pair of them. Documents equal to another as a whole appear once, against the smallest id of their
    text. Ids are whole numbers. Null and short texts and rows without an id have no passages; repeats inside one document
    don't count; rows of one id are one document, of which the smallest text counts. Empty tables give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    def digested(d: DataFrame) -> DataFrame:
        return d.select("doc_id", F.md5("text").alias("m"), F.xxhash64("text").alias("x"))

    digests = written(digested(docs), "digests")
    repeated = written(digests.distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        first = semi_by_id(docs, repeated, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = anti_by_id(docs, repeated, "doc_id").unionByName(written(first, "firsts"))
        digests = written(digested(docs), "digests")
    firsts = written(digests.groupBy("m", "x").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("m", "x", "rep"), "firsts")
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
    counted = semi_by_id(docs, firsts.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("rep"), words.alias("n")).distinct()
    firsts = written(firsts.join(counted, "rep"), "firsts")
    copies = written(digests.join(firsts, ["m", "x"]).where("doc_id <> rep").select("doc_id", "rep", "n").distinct(), "copies")
    unique = anti_by_id(docs, copies.select("doc_id").distinct(), "doc_id")
    shared = written(_occurrences(unique).groupBy("key").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q")).where("p <> q").select("key"), "shared")
    bits = key_filter(shared)
    drop_written(shared)
    occurrences = written(_occurrences(unique, bits), "occurrences")
    spent: list[DataFrame] = []
    pairs = written(_candidates(occurrences, spent), "candidates")
    drop_written(*spent)
    held = _held_links(unique, pairs, "held")
    held = _rest(unique, occurrences, held)
    drop_written(occurrences)
    w = Window.partitionBy("doc_id", "other", "diagonal").orderBy("begin", "end")
    fresh = (F.col("begin") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("long")
    held = held.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    held = held.groupBy("doc_id", "other", "diagonal", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("other_end").alias("other_end"))
    whole = copies.where(F.col("n") >= LEAST_WORDS).select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), F.col("rep").alias("other_id"), F.lit(0).cast("long").alias("other_begin"), F.col("n").alias("other_end"))
    return held.select("doc_id", "begin", "end", F.col("other").alias("other_id"), (F.col("begin") - F.col("diagonal")).alias("other_begin"), "other_end").unionByName(whole)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
