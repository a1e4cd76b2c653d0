"""SimHash near-dedup: every pair of distinct fingerprints within the radius is found.

A fingerprint has 128 bits over all words of the whole text: each distinct word, again
where it comes 2, 4, 8... times, and each distinct pair of neighbouring words at a
quarter of a word's weight, so that counts and order are read too.  Equal fingerprints
are grouped first and count once.

Up to ``DIRECT`` distinct fingerprints are compared pair by pair, in tiles of neighbouring
population counts; since the counts of two fingerprints differ by at most their
distance, tile pairs, and rows within a pair, whose counts differ by more than the
radius are skipped.  More are compared where they may be near only: of two fingerprints
within 22 bits one of eight 16-bit blocks differs by 2 bits at most (the last by 1), so
each block is a table of cells, and a cell is compared with those within that many bits.
No cell is capped, and both ways are exact: they find the same links.  A part of the
pairs is still compared, 3 % at full blocks, so the time stays quadratic, of far fewer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, even_slots, fresh, materialise, mix, type_of, words

RADIUS = 22
WORD_WEIGHT, PAIR_WEIGHT = 4, 1
TILE, MAX_TILE, TILES, PARTITIONS = 32768, 262144, 64, 1 << 14
DIRECT, BLOCKS, PART, MAX_PART, CELL = 1 << 16, 8, 1 << 17, 3 << 18, 16
SIFT, SETTLE = 1 << 15, 1 << 20
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _sorted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value) rows in order, and how often a value has come in its text so far."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    return doc, h, np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h)))) + 1


def _tally(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each text and bit: features with the bit less those without; features are sorted by text."""
    out = np.zeros((n, 128), np.int32)
    if not len(h):
        return out
    count = np.bincount(doc, minlength=n)
    within = np.arange(len(h)) - np.concatenate(([0], np.cumsum(count)))[doc]
    cut = np.flatnonzero(within % 255 == 0)  # at most 255 features fit a byte-wide counter
    bits = np.empty((len(h), 2), np.uint64)
    bits[:, 0], bits[:, 1] = mix(h), mix(h + np.uint64(0x9E3779B97F4A7C15))
    lanes = np.add.reduceat(_SPREAD[bits.view(np.uint8)], cut, axis=0).view(np.uint8).astype(np.int32)
    owner = doc[cut]
    head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    out[owner[head]] = 2 * np.add.reduceat(lanes, head, axis=0)
    return out - count[:, None].astype(np.int32)


def fingerprints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints of a text column, and which texts have one (those with a word)."""
    w = words(col)
    n = len(w.ptr) - 1
    some = np.diff(w.ptr) > 0
    if not len(w.hashes):
        return np.zeros((n, 2), np.uint64), some
    doc, h, times = _sorted(w.doc, w.hashes)
    keep = (times & (times - 1)) == 0
    total = WORD_WEIGHT * _tally(doc[keep], mix(h[keep] + times[keep].astype(np.uint64) * np.uint64(0x517CC1B727220A95)), n)
    at = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    if len(at):
        doc, h, times = _sorted(w.doc[at], mix(w.hashes[at] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[at + 1]))
        total += PAIR_WEIGHT * _tally(doc[times == 1], h[times == 1], n)
    return np.packbits(total > 0, axis=1).view(np.uint64), some


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, h1, h2 of every row with a word; equal texts of one id are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fp, ok = fingerprints(b.column("text"))
            kept = [b.column(c).filter(pa.array(ok)) for c in ("doc_id", "body")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(fp[ok, i].view(np.int64)) for i in (0, 1))], ["doc_id", "body", "h1", "h2"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), "text").where("text is not null")
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, body long, h1 long, h2 long")


def compare(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For tiles of (h1, h2, popcount, documents) sorted by popcount: the smallest row linked with each row, by transitive closure, and the documents within the radius of each.

    Rows of ``b`` (None: ``a`` with itself) follow those of ``a`` in the numbering.
    """
    own = b is None
    b = a if own else b
    base = 0 if own else len(a[0])
    label = np.arange(len(a[0]) + (0 if own else len(b[0])))
    links = np.zeros(len(label), np.int64)
    lo = np.searchsorted(b[2], a[2] - radius, side="left")
    hi = np.searchsorted(b[2], a[2] + radius, side="right")
    b1, b2 = b[0], b[1]
    xor, bits = np.empty(len(b1), np.uint64), np.empty(len(b1), np.uint8)
    for i in range(len(a[0])):
        s, e = (max(lo[i], i + 1) if own else lo[i]), hi[i]
        if s >= e:
            continue
        x, d = xor[: e - s], bits[: e - s]
        np.bitwise_xor(b1[s:e], a[0][i], out=x)
        np.bitwise_count(x, out=d)
        if d.min() > radius:
            continue
        near = np.flatnonzero(d <= radius)
        near = s + near[d[near] + np.bitwise_count(b2[s:e][near] ^ a[1][i]) <= radius]
        if len(near):
            links[i] += b[3][near].sum()
            links[base + near] += a[3][i]
            one = np.unique(np.append(label[base + near], label[i]))
            if len(one) > 1:
                label[np.isin(label, one[1:])] = one[0]
    return label, links


def quotas(radius: int) -> list[int]:
    """For each block the bits that may differ: of two fingerprints within ``radius``, some block differs by its quota at most.

    Were every block over its quota, the distance would be at least the sum of quota + 1, which is radius + 1.
    """
    return [(radius + 1) // BLOCKS + (b < (radius + 1) % BLOCKS) - 1 for b in range(BLOCKS)]


def _key(h1: np.ndarray, h2: np.ndarray, block: int, bits: int) -> np.ndarray:
    """The low ``bits`` of a 16-bit block."""
    half = h1 if block < BLOCKS // 2 else h2
    return ((half >> np.uint64(16 * (block % (BLOCKS // 2)))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, where each row points to the first of its component, after links a - b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, root := label[label]):
            label = root


def compare_block(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, block: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``compare``, for (h1, h2, documents) in any order, of the links that ``block`` is the first to find; the row that stands for a component is any of its rows.

    A block finds a link if its keys differ by its quota at most; over all blocks each link is found once.
    """
    own = b is None
    quota = quotas(radius)
    masks = np.arange(1 << bits)
    masks = masks[np.bitwise_count(masks) <= quota[block]]
    place = [np.argsort(_key(t[0], t[1], block, bits), kind="stable") for t in ((a,) if own else (a, b))]
    a = tuple(c[place[0]] for c in a)
    b = a if own else tuple(c[place[1]] for c in b)
    base = 0 if own else len(a[0])
    label, links = np.arange(len(a[0]) + (0 if own else len(b[0]))), np.zeros(len(a[0]) + (0 if own else len(b[0])), np.int64)
    from_a, from_b = (np.searchsorted(_key(t[0], t[1], block, bits), np.arange((1 << bits) + 1)) for t in (a, b))
    xor, odd, even, near = np.empty(SIFT, np.uint64), np.empty(SIFT, np.uint8), np.empty(SIFT, np.uint8), np.empty(SIFT, bool)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    n_edges = 0

    def settle() -> None:
        """Of the links found so far, count those that no block before this one finds, and join their rows."""
        nonlocal label, n_edges
        i, j = (np.concatenate(x) for x in zip(*edges, strict=True))
        x1, x2 = a[0][i] ^ b[0][j], a[1][i] ^ b[1][j]
        new = j > i if own else np.ones(len(i), bool)
        for c in range(block):
            new &= np.bitwise_count(_key(x1, x2, c, bits)).astype(np.int64) > quota[c]
        i, j = i[new], j[new]
        np.add.at(links, i, b[2][j])
        np.add.at(links, base + j, a[2][i])
        label = _join(label, i, base + j)
        edges.clear()
        n_edges = 0

    for k in np.flatnonzero(np.diff(from_a)) if len(masks) else ():
        cells = masks ^ k
        if own:
            cells = cells[cells >= k]
        lo = from_b[cells]
        size = from_b[cells + 1] - lo
        end = np.cumsum(size)
        at = np.repeat(lo - end + size, size) + np.arange(end[-1])
        for c in range(0, len(at), SIFT):
            col = at[c : c + SIFT]
            y1, y2, step = b[0][col], b[1][col], SIFT // len(col)
            for s in range(from_a[k], from_a[k + 1], step):
                x1, x2 = (h[s : min(s + step, from_a[k + 1]), None] for h in a[:2])
                n = len(x1) * len(col)
                x, d, e = (t[:n].reshape(len(x1), -1) for t in (xor, odd, even))
                np.bitwise_count(np.bitwise_xor(x1, y1, out=x), out=d)
                np.bitwise_count(np.bitwise_xor(x2, y2, out=x), out=e)
                np.less_equal(np.add(d, e, out=d), radius, out=near[:n].reshape(len(x1), -1))
                eight = np.packbits(near[:n])
                some = np.flatnonzero(eight)
                if len(some):
                    which, bit = np.nonzero(np.unpackbits(eight[some, None], axis=1))
                    row, found = np.divmod(8 * some[which] + bit, len(col))
                    edges.append((s + row, col[found]))
                    n_edges += len(row)
                    if n_edges > SETTLE:
                        settle()
    if edges:
        settle()
    spot = np.concatenate([place[0], *(base + x for x in place[1:])])
    out_label, out_links = np.empty_like(label), np.empty_like(links)
    out_label[spot], out_links[spot] = spot[label], links
    return out_label, out_links


def _tiles(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their tile, and the table of tiles (tile, least and greatest population count, and of the first half).

    Collected: one count for each pair of half population counts, 65 x 65 rows at any input size.
    """
    spark = nodes.sparkSession
    cells = nodes.groupBy("p1", "p2").count().collect()
    n = sum(r["count"] for r in cells)
    size = min(MAX_TILE, max(TILE, n // TILES))
    rows, box, fill = [], [], size
    for p, p1, count in sorted((r["p1"] + r["p2"], r["p1"], r["count"]) for r in cells):
        parts = -(-count // size)
        if parts > 1 or fill + count > size:
            box += [[p, p, p1, p1] for _ in range(parts)]
            fill = 0 if parts == 1 else size
        fill += count
        box[-1] = [box[-1][0], p, min(box[-1][2], p1), max(box[-1][3], p1)]
        rows.append((p1, p - p1, len(box) - parts, parts))
    at = spark.createDataFrame(rows, "p1 int, p2 int, first int, parts int")
    number = (F.col("first") + F.pmod(F.xxhash64("h1", "h2"), F.col("parts"))).cast("int")
    tiled = nodes.join(F.broadcast(at), ["p1", "p2"]).select(number.alias("tile"), "node", "h1", "h2", "n", (F.col("p1") + F.col("p2")).alias("p"))  # 65 x 65 rows
    return tiled, spark.createDataFrame([(k, *x) for k, x in enumerate(box)], "tile long, lo int, hi int, lo1 int, hi1 int")


def tile_pairs(tiles: DataFrame, radius: int, most: int = PARTITIONS) -> tuple[DataFrame, int]:
    """(slot, i, j) of the tile pairs that can hold a link, and the number of partitions; the slots hash to one partition each, evenly."""
    spark, t = tiles.sparkSession, tiles.count()
    n = max(1, min(most, t * (t + 1) // 2))
    b = tiles.toDF("j", "lo_", "hi_", "lo1_", "hi1_")
    gap = lambda lo, hi: F.greatest(F.col(f"{lo}_") - F.col(hi), F.col(lo) - F.col(f"{hi}_"))
    pairs = tiles.withColumnRenamed("tile", "i").withColumn("j", F.explode(F.sequence("i", F.lit(t - 1)))).join(b, "j").where((gap("lo", "hi") <= radius) & (gap("lo1", "hi1") <= radius))
    pairs = pairs.select(F.pmod(F.expr("j * (j + 1) div 2 + i"), F.lit(n)).alias("part"), "i", "j")
    slots = spark.createDataFrame(list(enumerate(even_slots(spark, n))), "part long, slot long")
    return pairs.join(slots, "part").select("slot", "i", "j"), n


def _near(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v, links): within a tile pair, v the smallest node linked with u (u itself where none is), and the documents within the radius of u."""
    tiled, tiles = _tiles(nodes)
    pairs, n = tile_pairs(tiles, radius)
    side = lambda c: tiled.join(pairs, tiled["tile"] == pairs[c]).select("slot", "i", "j", F.lit(c).alias("side"), "node", "h1", "h2", "n", "p")
    rows = side("i").union(side("j").where("i < j"))

    def run(t: pa.Table) -> pa.Table:
        second = pc.equal(t.column("side"), "j").to_numpy(zero_copy_only=False)
        h1, h2, p, count, node = (t.column(c).to_numpy() for c in ("h1", "h2", "p", "n", "node"))
        order = np.lexsort((node, p, second))
        h1, h2, p, count, node, k = h1.view(np.uint64)[order], h2.view(np.uint64)[order], p[order].astype(np.int64), count[order], node[order], int((~second).sum())
        tile = lambda s: (h1[s], h2[s], p[s], count[s])
        label, links = compare(tile(slice(0, k)), tile(slice(k, None)) if second.any() else None, radius)
        u = np.flatnonzero(links)
        return pa.table({"u": node[u], "v": node[label[u]], "links": links[u]})

    return rows.repartition(max(1, n), "slot").groupBy("slot", "i", "j").applyInArrow(run, "u long, v long, links long")


def _near_by_blocks(nodes: DataFrame, count: int, radius: int) -> DataFrame:
    """As ``_near``, v any one node of u's component, for ``count`` nodes: their parts are compared pair by pair, once for each block."""
    spark = nodes.sparkSession
    size = min(MAX_PART, max(PART, -(-count // 3)))
    parts = -(-count // size)
    bits = min(16, max(1, (size // CELL - 1).bit_length()))
    jobs = [(b, i, j) for b in range(BLOCKS) for j in range(parts) for i in range(j + 1)]  # 8 x 19 x 20 / 2 at 14 million nodes
    n = min(PARTITIONS, len(jobs))
    slots = even_slots(spark, n)
    pairs = F.broadcast(spark.createDataFrame([(slots[k % n], *x) for k, x in enumerate(jobs)], "slot long, block int, i int, j int"))
    parted = nodes.select(F.pmod(F.xxhash64("h1", "h2"), F.lit(parts)).cast("int").alias("part"), "node", "h1", "h2", "n")
    side = lambda c: parted.join(pairs, parted["part"] == pairs[c]).select("slot", "block", "i", "j", F.lit(c == "j").alias("second"), "node", "h1", "h2", "n")
    rows = side("i").union(side("j").where("i < j"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        second = t.column("second").to_numpy()
        h1, h2, count, node = (t.column(c).to_numpy() for c in ("h1", "h2", "n", "node"))
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        a, b = ((h1[s], h2[s], count[s]) for s in (~second, second))
        label, links = compare_block(a, b if key[2].as_py() < key[3].as_py() else None, key[1].as_py(), bits, radius)
        node, u = np.concatenate([node[~second], node[second]]), np.flatnonzero(links)
        return pa.table({"u": node[u], "v": node[label[u]], "links": links[u]})

    return rows.repartition(n, "slot").groupBy("slot", "block", "i", "j").applyInArrow(run, "u long, v long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node but those: alternating large and small stars."""
    norm = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    edges = materialise(norm(edges), "edges")
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = norm(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, materialise(norm(small), "edges")
        discard(old)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges


def _members(sig: DataFrame, radius: int) -> DataFrame:
    """(doc_id, body, group_id, links, kept) of every signature whose group has two documents or more."""
    pop = lambda c: F.bit_count(c).cast("int")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body"))
    same = sig.groupBy("h1", "h2").agg(head.alias("head"), F.count("*").alias("n"))
    nodes = materialise(same.withColumns({"p1": pop("h1"), "p2": pop("h2"), "node": F.monotonically_increasing_id()}), "distinct")
    count = nodes.count()
    near = materialise(_near(nodes, radius) if count <= DIRECT else _near_by_blocks(nodes, count, radius), "near")
    stars = components(near.select("u", "v"))
    linked = near.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.join(linked, "node", "left").join(stars.select(F.col("u").alias("node"), "v"), "node", "left").where("links > 0 or n > 1").withColumn("v", F.coalesce("v", "node"))
    first = known.groupBy("v").agg(F.min("head").alias("first"))
    known = known.join(first, "v").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))
    out = materialise(sig.join(known, ["h1", "h2"]).select("doc_id", "body", F.col("first.doc_id").alias("group_id"), "links", kept.alias("kept")), "members")
    discard(nodes, near, stars)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, links, kept) for every document with a near copy.

    A document is a doc_id with a text: repeated rows of both are one, one id with two
    texts is two.  ``links`` counts the other documents within ``radius`` bits, copies
    included; groups are the connected components of such links, and group_id is the
    smallest doc_id in the group (of an id with several texts, the same for the groups
    that it heads).  One document of each group is kept: that of the smallest id, of its
    texts that of the smallest hash.  Null texts and texts without a word have no
    fingerprint and never appear; rows with a null id do, after all others.  Ids may be
    of any type that can be ordered.  Whole texts are read, of any length.  An empty
    table gives an empty result; other columns are ignored.
    """
    sig = materialise(signatures(docs).distinct(), "signatures")
    out = _members(sig, radius)
    discard(sig)
    return out.select("doc_id", "group_id", "links", "kept")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without all but one of each near-duplicate group; all their columns.

    Documents are told apart by id and text as in ``near_duplicates``, rows with a null
    id too; of a document that is kept and comes several times one row stays.  Null
    texts and texts without a word stay, repeated or not; an empty table stays empty.
    """
    rows = materialise(signatures(docs), "rows")
    sig = materialise(rows.distinct(), "signatures")
    body, gone_id, gone_body = (fresh(docs, x) for x in ("__body", "__gone_id", "__gone_body"))
    gone = _members(sig, radius).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body))
    hashed = docs.withColumn(body, F.xxhash64("text"))
    same = lambda i, b: hashed["doc_id"].eqNullSafe(F.col(i)) & (hashed[body] == F.col(b)) & hashed["text"].isNotNull()
    left = hashed.join(gone.hint("merge"), same(gone_id, gone_body), "left_anti")  # it grows with the documents: never broadcast
    again = materialise(rows.groupBy("doc_id", "body").count().where("count > 1").select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body)), "repeated")
    discard(rows, sig)
    if not again.isEmpty():
        twice = left.join(again, same(gone_id, gone_body), "left_semi").dropDuplicates(["doc_id", body])
        left = left.join(again, same(gone_id, gone_body), "left_anti").unionByName(twice)
    return left.drop(body)


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
