"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges, exact confirmation.

A document's set is that of its distinct word shingles, as 64-bit hashes. One hash of each shingle serves all
BINS of the sketch: its top bits name the bin, and a bin holds its smallest hash. An empty bin takes the value
of the bin that the first successful draw of a fixed random sequence points at (optimal densification).
Bands of ROWS bins are bucket keys; two sets of similarity s share a band's key with probability about s**ROWS,
so of pairs at 0.8 some 2e-9 share none of the 51 bands.

Documents of equal sets, by the SHA-256 of the whole sorted set, are one class from the start, named by the number of
one of its rows. A bucket gives a star: an edge from its smallest class to each other one, so edges are linear in the
bucket's size, and all edges are confirmed on full sets. A star can miss a link between two of its leaves. So where,
after the confirmed links have been merged into components, a bucket of three or more classes still spans several
components, the classes of the cluster that such buckets form are set against each other in blocks of bounded bytes,
across components only, and confirmed on full sets as well. Nothing is capped.

Buckets, hubs and classes that hold a large share of all rows are met by spread_join(), which broadcasts their few
keys; the set of a centre of many edges goes to as many tasks as its edges fill.

Defined results: null texts and texts without words have empty sets and are linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows are copies of each other; rows are told apart by number, so texts
that share an id, or have none, are linked only if they are alike; a component's id is its smallest one that is not
null; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, NULL_ID, discard, fresh, ident, mixed, numbered, restored, shingles, shuffle_width, spread_join, steps, utf8, words, written

BIN_BITS = 8
BINS = 1 << BIN_BITS
ROWS = 5
BANDS = BINS // ROWS
#: Draws for an empty bin; a bin that none serves takes the next occupied one. Matters for sets of up to three shingles only.
DRAWS = 400
#: Bytes and number of the sets of a block, about; two blocks meet in one row.
BLOCK_BYTES = 8 << 20
BLOCK_SETS = 256


def sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BINS values for each (non-empty) sorted set."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    cell = owner * BINS + (flat >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.ones(len(flat), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    out, full = np.zeros(n * BINS, dtype=np.uint64), np.zeros(n * BINS, dtype=bool)
    out[cell[first]], full[cell[first]] = flat[first], True
    occupied = full.copy()
    empty = np.flatnonzero(~full)
    for draw in range(DRAWS):
        if not len(empty):
            return out.reshape(n, BINS)
        at = (mixed((empty % BINS).astype(np.uint64) * np.uint64(DRAWS) + np.uint64(draw) + np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        source = empty - empty % BINS + at
        hit = occupied[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    for turn in range(1, BINS):
        source = empty - empty % BINS + (empty + turn) % BINS
        hit = occupied[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out.reshape(n, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB), (len(sketch), 1))
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + sketch[:, r : BANDS * ROWS : ROWS])
    return key


_SIGNATURE = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNATURE = "row bigint, n bigint, digest binary, bands array<bigint>"


def _signatures(width: int):
    """Of (row, text): the size of the set, its SHA-256 (null if it is empty) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                h, _, _, counts = words(data, offsets[a : b + 1])
                flat, sizes = shingles(h, counts, width)
                some = sizes > 0
                ends = np.concatenate(([0], np.cumsum(sizes))).tolist()
                digests = [hashlib.sha256(flat[x:y]).digest() if y > x else None for x, y in zip(ends, ends[1:])]
                keys = band_keys(sketches(flat, sizes[some])).view(np.int64)
                at = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), lists], schema=_SIGNATURE)

    return run


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                h, _, _, counts = words(data, offsets[a : b + 1])
                flat, sizes = shingles(h, counts, width)
                ends = np.concatenate(([0], np.cumsum(sizes))).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([flat[x:y].tobytes() for x, y in zip(ends, ends[1:])], pa.binary())], schema=schema)

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    rows.append((a, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PAIR)

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets meet the threshold. A leaf b is in few pairs; a centre a can be in very many: its set then goes to as many tasks as its pairs fill."""
    total = pairs.count()
    least = max(2, int(total * HOT_SHARE) + 1)
    # Fewer than 1 / HOT_SHARE centres have so many pairs, and their parts are fewer than twice that.
    hot = pairs.groupBy("a").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("a", F.ceil(F.col("_n") / least).cast("bigint").alias("_parts"))
    left = pairs.join(F.broadcast(hot), "a", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("b"), "_parts"), F.lit(0)))
    left = left.drop("_parts").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")).join(F.broadcast(hot), "a", "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_parts") - 1, F.lit(0)))))
    both = left.join(right, ["a", "_part"]).select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id of its connected component.

    Alternating large-star and small-star rounds over edge tables in shared storage; minima meet as partial
    aggregates, and the edges of a hub stay where they are, its minimum being broadcast. Stops when a round changes no
    edge.
    """

    def minima(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = state(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).select("u", F.least("u", "m").alias("m"), "n")
        larger = spread_join(both.filter("v > u"), low, ["u"], "n", 2 * last[0])
        large = written(larger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        # u is the larger end here and points at few minima, so that no end is a hub.
        low = minima(large).select("u", "m")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.filter("u <> v").distinct(), "edges")
        discard(before, large)
        now = state(edges)
        if now == last:
            break
        last = now
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    out = found.union(found.select(F.col("component").alias("id"), "component").distinct())
    out.spent = [edges]
    return out


def block_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Which sets of two blocks meet the threshold, as a boolean matrix, from products of their incidence matrices over common elements."""
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    row_a, row_b = np.repeat(np.arange(len(sets_a)), size_a), np.repeat(np.arange(len(sets_b)), size_b)
    common = np.intersect1d(flat_a, flat_b)
    shared = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
    if len(common):
        places = []
        for flat, row in ((flat_a, row_a), (flat_b, row_b)):
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            hit = common[at] == flat
            order = np.argsort(at[hit], kind="stable")
            places.append((at[hit][order], row[hit][order]))
        for lo in range(0, len(common), columns):
            parts = []
            for (at, row), n in zip(places, shared.shape):
                x, y = np.searchsorted(at, (lo, lo + columns))
                m = np.zeros((n, min(columns, len(common) - lo)), dtype=np.float32)
                m[row[x:y], at[x:y] - lo] = 1
                parts.append(m)
            shared += parts[0] @ parts[1].T
    inter = np.rint(shared).astype(np.int64)
    return 100 * inter >= percent * (size_a[:, None] + size_b[None, :] - inter)


def _linked_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(i)[k].as_py() for i in (0, 1))
                hit = block_links([np.frombuffer(x["set"], np.uint64) for x in a], [np.frombuffer(x["set"], np.uint64) for x in b], percent)
                hit &= np.array([x["component"] for x in a])[:, None] != np.array([x["component"] for x in b])[None, :]
                i, j = np.nonzero(hit)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([a[x]["id"] for x in i], pa.int64()), pa.array([b[x]["id"] for x in j], pa.int64())], schema=_PAIR)

    return run


def across(stars: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """Confirmed links between leaves of stars that span several components.

    Classes that such stars connect make a cluster. Those outside the cluster's largest component are its queries, set
    against all of the cluster in blocks of about BLOCK_BYTES; blocks whose sizes rule the threshold out are not set
    against each other, nor is the largest component against itself. spent: gets the tables that the result reads.
    """
    of_leaf, of_centre = comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), comp.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    s = stars.filter("members > 2").join(of_leaf, "b", "left").join(of_centre, "a", "left")
    open_keys = s.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("key").distinct()
    # A key that is open has one row for each member, so weights are the members.
    open_keys = open_keys.join(stars.groupBy("key").agg(F.count("*").alias("n")), "key")
    open_stars = written(spread_join(stars.select("key", "a", "b"), open_keys, ["key"], "n", stars.count()).select("a", "b").distinct(), "open")
    if open_stars.isEmpty():
        return open_stars
    clusters = components(open_stars)
    members = written(clusters.withColumnRenamed("component", "cluster").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    discard(*clusters.spent)
    largest = members.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    # Sizes of one band or of neighbouring ones can meet the threshold, others can't.
    band = F.floor(F.log(F.octet_length("set") / 8) / F.lit(float(-np.log(percent / 100)) * (1 + 1e-9)) if percent < 100 else F.octet_length("set")).cast("int")
    laid = sets.join(members.join(largest, "cluster"), "id").select("id", "component", "set", "cluster", band.alias("band"), (F.col("component") != F.col("major")).alias("asks"))
    laid = written(laid, "laid")
    group = ["cluster", "band", "asks"]
    fill = F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.octet_length("set")) / BLOCK_BYTES)
    counts = laid.groupBy(*group).agg(fill.alias("fill"), F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil("fill").cast("bigint"))
    # Joined by broadcast, sets of a large cluster are dealt by their parts and not by the cluster alone.
    dealt = spread_join(laid, counts, group, "n", laid.count()).withColumn("part", part)
    blocks = dealt.groupBy("cluster", "band", "asks", "part").agg(F.collect_list(F.struct("id", "component", "set")).alias("block"))
    blocks = written(blocks, "blocks")
    spent += [open_stars, members, laid, blocks]
    asking = blocks.filter("asks").withColumn("against", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    every = blocks.select("cluster", F.col("band").alias("against"), F.col("asks").alias("also"), F.col("part").alias("other"), F.col("block").alias("others"))
    # Two blocks of queries meet once.
    once = ~F.col("also") | (F.col("band") < F.col("against")) | ((F.col("band") == F.col("against")) & (F.col("part") <= F.col("other")))
    met = asking.join(every, ["cluster", "against"]).filter(once)
    # The join leaves a cluster's meetings in one task; they are dealt out again one by one.
    dealt = met.repartition(4 * shuffle_width(stars.sparkSession), F.xxhash64("cluster", "band", "part", "against", "also", "other"))
    return dealt.select("block", "others").mapInArrow(_linked_blocks(percent), "a bigint, b bigint")


def classified(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """rows: (row, id, text). Per row: row, id, n (size of its set), component_id, stays (one row of each component)."""
    sig = written(rows.select("row", "text").mapInArrow(_signatures(width), SIGNATURE), "signatures")
    ids = rows.select("row", "id")
    # Ids that are null come last, then the smallest row that has the id.
    named = sig.select("row", "n", "digest").join(ids, "row").withColumn("first", F.struct((F.col("id") == NULL_ID).alias("none"), "id", "row"))
    named = written(named, "named")
    classes = named.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("first").alias("first"), F.count("*").alias("members"))
    classes = written(classes, "classes")
    bands = written(sig.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "bands"), "bands")
    discard(sig)
    keyed = bands.select("id", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    centre = F.min(F.struct(F.col("id").alias("a"), F.col("n").alias("na"))).alias("c")
    buckets = keyed.groupBy("key").agg(centre, F.count("*").cast("int").alias("members")).filter("members > 1").select("key", "c.a", "c.na", "members")
    met = spread_join(keyed, buckets, ["key"], "members", BANDS * bands.count())
    stars = written(met.filter("id <> a").select("key", "a", "na", F.col("id").alias("b"), F.col("n").alias("nb"), "members"), "stars")
    discard(bands)
    ends = stars.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = written(rows.select("row", "text").join(ends, "row", "left_semi").mapInArrow(_sets(width), "id bigint, set binary"), "sets")
    near = F.least("na", "nb").cast("bigint") * 100 >= F.greatest("na", "nb").cast("bigint") * percent
    pairs = written(stars.filter(near).select("a", "b").distinct(), "pairs")
    links = written(confirmed(pairs, sets, percent), "links")
    comp = written(components(links), "components")
    spent: list[DataFrame] = []
    more = written(across(stars, comp, sets, percent, spent), "more")
    discard(*spent, pairs)
    if not more.isEmpty():
        past, comp = comp, written(components(links.union(more)), "components")
        discard(past)
    discard(stars, sets, links, more)
    joined = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = joined.groupBy("component").agg(F.min("first").alias("leader"), F.count("*").alias("n"))
    of_class = written(spread_join(joined, firsts, ["component"], "n", classes.count()).select("digest", "members", "leader"), "leaders")
    discard(classes, comp)
    some = spread_join(named.filter("n > 0"), of_class, ["digest"], "members", named.count())
    out = some.select("row", "id", "n", F.col("leader.id").alias("component_id"), (F.col("leader.row") == F.col("row")).alias("stays"))
    out = out.union(named.filter("n = 0").select("row", "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("stays")))
    out.spent = [named, of_class]
    return out


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id, kept (whether the row's id is that of its component)."""
    rows = numbered(docs.select(ident(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "near-rows")
    found = classified(rows, width, percent)
    out = found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("id")).alias("kept"))
    out = restored(out, key, "component_id")
    out.spent = [rows, *found.spent]
    return out


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns as they were: the first that has the component's id."""
    row = fresh(docs, "_row")
    rows = numbered(docs, "near-rows", row)
    found = classified(rows.select(F.col(row).alias("row"), ident(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), width, percent)
    out = rows.join(found.filter("stays").select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)
    out.spent = [rows, *found.spent]
    return out
