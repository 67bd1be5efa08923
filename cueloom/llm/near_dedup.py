"""Near-duplicate groups: SetSketch registers, banding, joint likelihood, exact verification, components.

A shingle sends arrivals of a Poisson process to random registers, so its values are exponentially
spaced and each register keeps the least of them, truncated to 16 bits on a logarithmic scale. Sketches
of parts merge by taking minima, and equal registers mean similar sets. Bands of registers propose
candidates, the joint likelihood of two sketches sets aside pairs that can't be similar enough, and
full sets decide. Texts with equal sets are one class from the start; a class has one representative.

In a bucket of a band each member is first compared with the bucket's pivot alone, then, where its
component is another, with the bucket's member of most links. Buckets that still hold several
components are joined with themselves across components, on what tells each text from most of the
texts around it, under bounds that exact counts give, so that no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, GOLDEN, HOT_ROWS, HOT_SHARE, frequent_keys, mix64, release, settled, spread_join
from .words import SPACED, STEP, Words, in_slices

REGISTERS = 240
#: The most likely that bands miss a pair at the threshold; it sets how many registers a band has.
MISS = 1e-8
BASE = 1.0005
_OFFSET = math.ceil(4 / math.log(BASE))
#: Orders in which buckets choose their pivots: a text has about so many different ones in the buckets of a group, whatever the number of bands.
PIVOTS = 3
#: About so many rows of a shingle meet as many others in one cell of the last join.
CELL_ROWS = 2048
#: A graph's edges are worked on by so many tasks, and one more for each GRAPH_ROWS of them.
GRAPH_TASKS, GRAPH_ROWS = 6, 100_000
#: Shingles of over one in so many of a cluster's sets are its centre.
CENTRE = 2
#: Twice the log likelihood ratio at which a pair is set aside: over six standard deviations.
CUT = 40.0


def band_rows(threshold: float, m: int = REGISTERS) -> int:
    """The most registers in a band with which the m // rows bands miss a pair at the threshold with probability MISS at most."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (m // r) <= MISS)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of k words, sorted, one text after another, and how many each text has.

    A text with fewer words, but some, has its whole sequence as one shingle. A long text is taken in steps.
    """
    if len(words) == 1 and len(words.hash) > STEP:
        h = np.empty(0, np.uint64)
        for lo in range(0, len(words.hash), STEP):
            h = np.union1d(h, words.windows(k, lo, lo + STEP)[0])
        return h, np.array([len(h)])
    h, whole = words.windows(k)
    text = words.text_of()
    at = np.flatnonzero(whole)
    hashes, owner = [h[at]], [text[at]]
    n = np.diff(words.first)
    for c in range(1, k):
        if len(short := np.flatnonzero(n == c)):
            hashes.append(mix64(words.windows(c)[0][words.first[short]] ^ np.uint64(c)))
            owner.append(short)
    h, owner_ = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, owner_))
    h, owner_ = h[order], owner_[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner_[1:] != owner_[:-1])
    return h[new], np.bincount(owner_[new], minlength=len(words))


def minima(h: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """For each set (counts of hashes, one set after another) the least arrival in each of m registers; infinite for an empty set."""
    if len(counts) == 1 and len(h) > STEP:  # minima of parts merge
        return np.min([minima(h[at : at + STEP], np.array([len(h[at : at + STEP])]), m) for at in range(0, len(h), STEP)], 0)
    low = np.full(len(counts) * m, np.inf)
    owner = np.repeat(np.arange(len(counts)), counts)
    x, live, t = np.zeros(len(h)), h, 0
    while len(live):
        t += 1
        with np.errstate(over="ignore"):
            u = mix64(live + np.uint64(t) * GOLDEN)
            slot = (mix64(u ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(m)).astype(np.int64)
        x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / m
        np.minimum.at(low, owner * m + slot, x)
        if t < 8 or t % 8 == 0:  # an element whose time is past its set's largest minimum is done
            sets, inverse = np.unique(owner, return_inverse=True)
            on = x < low.reshape(-1, m)[sets].max(1)[inverse]
            x, live, owner = x[on], live[on], owner[on]
    return low.reshape(-1, m)


def truncated(low: np.ndarray) -> np.ndarray:
    """Registers of 16 bits: the least arrival on a scale of powers of BASE."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(-np.log(low) / math.log(BASE)) + _OFFSET, 0, 65535).astype("<u2")


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest Jaccard similarity of pairs of register rows of sets of known sizes, and whether `at` or more is plausible."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    grid = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = np.maximum(p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(p(np.maximum(v - u * j, 0)), 1e-12)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    all_ = likelihood(grid)
    best = all_.argmax(1)
    j = grid[np.arange(len(grid)), best]
    lost = all_.max(1) - likelihood(np.minimum(np.full((len(grid), 1), at), grid[:, -1:]))[:, 0]
    return j, (j >= at) | (2 * lost <= CUT)


def sketches(docs: DataFrame, k: int, m: int = REGISTERS) -> DataFrame:
    """doc_id, n (size of the shingle set), digest (of the set; null if it is empty), registers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, words in in_slices(b.column(1), SPACED):
                h, n = shingles(words, k)
                ends, raw = np.concatenate(([0], 8 * np.cumsum(n))).tolist(), h.astype("<u8").tobytes()
                digest = [hashlib.blake2b(raw[x:y], digest_size=16).digest() if y > x else None for x, y in zip(ends, ends[1:], strict=False)]
                regs = [r.tobytes() for r in truncated(minima(h, n, m))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(words)), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "regs"])
        release()

    return rows.mapInArrow(run, "doc_id long, n long, digest binary, regs binary")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and sorted shingle hashes of the documents in ids (id); of rows that share an id, the one whose digest ids has."""
    n = ids.count()
    picked = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(picked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, words in in_slices(b.column(1), SPACED):
                h, size = shingles(words, k)
                ends, raw = np.concatenate(([0], 8 * np.cumsum(size))).tolist(), h.astype("<u8").tobytes()
                sets, wanted = [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], b.column(2).slice(at, len(words)).to_pylist()
                right = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, wanted, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(words)).filter(right), pa.array(sets, pa.binary()).filter(right)], names=["id", "hashes"])
        release()

    return settled(rows.mapInArrow(run, "id long, hashes binary").dropDuplicates(["id"]))


def _plausible(pairs: DataFrame, hot: DataFrame | None, reps: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b), with these ids in many, with the likeliest similarity j, without those that can't reach num/den by their sizes or, plausibly, by their registers."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    sized = spread_join(spread_join(pairs, side("a"), "a", hot), side("b"), "b", hot)
    sized = sized.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                regs = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(len(part), -1) for c in (3, 5)]
                j, ok = similarity(*regs, part.column(2).to_numpy().astype(float), part.column(4).to_numpy().astype(float), num / den)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(j).filter(keep)], names=["a", "b", "j"])
        release()

    return settled(sized.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(run, "a long, b long, j double"))


def _verified(pairs: DataFrame, hot: DataFrame | None, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b), with these ids in many, whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                both = np.sort(np.concatenate((np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common >= num * (len(both) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    both = spread_join(spread_join(pairs.select("a", "b"), side("a"), "a", hot), side("b"), "b", hot)
    return settled(both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long"))


def _with_least(edges: DataFrame, nodes: int, bound: int, parts: int) -> DataFrame:
    """edges (u, v) with m, the least v of each u: broadcast, if there are few nodes, or else that of a node with more than `bound` edges, of which there are few."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if nodes <= BROADCAST_IDS // 4:
        return edges.join(F.broadcast(least.select("u", "m").coalesce(parts)), "u")
    hot = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return edges.join(hot, "u").unionByName(cold)


def _graph_size(edges: DataFrame, parts: int) -> tuple[int, int, bool]:
    """How many edges (u, v) and nodes there are, and whether all are stars: each u has one v, which is no u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(parts)
    n, ids, loose = nodes.agg(F.sum("up"), F.count("*"), F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
    return n or 0, ids, not loose


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """id, comp (the least id that is reachable) of every id in links (a, b), `n` at most, by large and small stars in turn.

    Tables of edges are written by about a task for each GRAPH_ROWS, whatever the number of shuffle
    partitions: rounds of a small graph are many small jobs.
    """
    parts = GRAPH_TASKS + (links.count() if n is None else n) // GRAPH_ROWS
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), parts)
    while True:
        n, nodes, done = _graph_size(edges, parts)
        if done:
            break
        parts, bound = GRAPH_TASKS + n // GRAPH_ROWS, max(HOT_ROWS, 2 * n // HOT_SHARE)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settled(_with_least(both, nodes, bound, parts).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), parts)
        star = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = settled(_with_least(large, nodes, bound, parts).select(star.alias("e")).select("e.*").where("u <> v").distinct(), parts)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _across(pairs: DataFrame, hot: DataFrame | None, comp: DataFrame) -> DataFrame:
    """The pairs, with these ids in many, whose ends aren't in one component yet."""
    of = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"c_{x}"))
    both = spread_join(spread_join(pairs, of("a"), "a", hot, "left"), of("b"), "b", hot, "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def _open_buckets(members: DataFrame, comp: DataFrame, hot: DataFrame | None) -> DataFrame:
    """bucket, id, comp of the buckets whose members are in several components."""
    placed = settled(members.select("bucket", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return settled(spread_join(placed, several, "bucket", hot, "left_semi"))


def _clusters(open_: DataFrame, hot: DataFrame | None) -> DataFrame:
    """id, comp, cluster of open_ (bucket, id, comp), these buckets in many: components that share a bucket, directly or by others, are one cluster."""
    least = open_.groupBy("bucket").agg(F.min("comp").alias("lo"))
    met = spread_join(open_.select("bucket", "comp").distinct(), least, "bucket", hot).select(F.col("comp").alias("a"), F.col("lo").alias("b"))
    ids = settled(open_.select("id", "comp").distinct())
    of = components(met, open_.count()).select(F.col("id").alias("comp"), F.col("comp").alias("cluster"))
    return spread_join(ids, of, "comp", frequent_keys(ids, "comp"), "left").withColumn("cluster", F.coalesce("cluster", "comp"))


def _differences(sets: DataFrame, ids: DataFrame, often: DataFrame | None) -> DataFrame:
    """id, d, hashes: how each set of ids (id, cluster), with these clusters in many, differs from its cluster's centre, the shingles of over a CENTRE-th of the cluster's sets.

    What two sets of a cluster don't share is what their differences don't share. Where a cluster is a
    crowd of edited copies, differences are small and mostly of one set alone, whereas a set's
    own shingles are nearly all those of the crowd.
    """
    sizes = ids.groupBy("cluster").agg(F.count("*").alias("size"))
    placed = settled(spread_join(ids.select("id", "cluster"), sizes, "cluster", often).join(sets, "id"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, size, s in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2), strict=True):
                h = np.frombuffer(s.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c)), pa.array(np.full(len(h), size)), pa.array(h)], names=["cluster", "size", "h"])

    shared = placed.select("cluster", "size", "hashes").mapInArrow(each, "cluster long, size long, h long").groupBy("cluster", "h").agg(F.count("*").alias("df"), F.first("size").alias("size"))
    centres = shared.where(CENTRE * F.col("df") > F.col("size")).groupBy("cluster").agg(F.collect_list("h").alias("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, raw = [], []
            for c, s, centre in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                of = centre.values.to_numpy() if centre.is_valid else np.empty(0, np.int64)
                h = np.setxor1d(np.frombuffer(s.as_buffer(), "<i8"), of, assume_unique=True).view(np.uint64)
                h = mix64(h ^ mix64(np.array([c]))[0])  # one shingle is another in each cluster
                d.append(len(h))
                raw.append(h.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.int64()), pa.array(raw, pa.binary())], names=["id", "d", "hashes"])
        release()

    return settled(spread_join(placed.select("id", "cluster", "hashes"), centres, "cluster", often, "left").select("id", "cluster", "hashes", "centre").mapInArrow(run, "id long, d long, hashes binary"))


def _central(ids: DataFrame, often: DataFrame | None, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ids (id, comp, n, cluster, d), with these clusters in many: each set with the most central one of its cluster, where differences from the centre are few enough even if they share nothing.

    Two such sets are linked. If any two are, both are with the most central one, so these pairs stand for all.
    """
    far = ids.withColumn("far", (den + num) * F.col("d") - (den - num) * F.col("n"))
    near = far.groupBy("cluster").agg(F.min(F.struct("far", "id", "comp")).alias("mid"))
    both = spread_join(far.select("id", "comp", "cluster", "far"), near, "cluster", often)
    both = both.where((F.col("comp") != F.col("mid.comp")) & (F.col("far") + F.col("mid.far") <= 0))
    return both.select(F.greatest("id", "mid.id").alias("a"), F.least("id", "mid.id").alias("b"))


def _crossing(sets: DataFrame, ids: DataFrame, num: int, den: int, size: str = "n") -> DataFrame:
    """Pairs (a, b) of ids (id, comp, n) in different components that may be similar enough: a superset of those that are and share something in sets.

    sets holds the sets themselves or their differences from a set, `size` is how many hashes of each. Sets
    that are similar enough differ in (den - num) / (den + num) of the sum of their n at most. With
    hashes in one order, rarest first, all that two sets have before they first meet is such a difference: so
    one of them meets the other within half of that, and the other within the whole; and what is left
    of both bounds what they can share. Hashes of one set alone come first and meet nothing. The rows
    of a hash that many sets meet in are dealt over a square of cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.frombuffer(s.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h)], names=["id", "h"])

    each = sets.select("id", "hashes").join(ids.select("id"), "id", "left_semi").mapInArrow(run, "id long, h long")
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    per = each.join(often, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared")).join(ids.select("id", "comp", "n", F.col(size).alias("d")), "id")
    alone = F.col("d") - F.size("shared")
    first = F.floor(F.col("n") * (den - num) / num) + 1 - alone
    rare = per.where(first > 0).select("id", "comp", "n", "d", alone.alias("alone"), F.posexplode(F.slice("shared", 1, first.cast("int"))).alias("i", "s"))
    rare = settled(rare.select("id", "comp", "n", "d", F.col("s.h").alias("h"), (F.col("alone") + F.col("i")).alias("before")))
    whole, half = _in_cells(rare, rare.where(2 * num * F.col("before") <= (den - num) * F.col("n")), "h")
    one, two = (side.select(*(F.col(c).alias(c if c in ("h", "cell") else f"{c}_{x}") for c in side.columns)) for side, x in ((whole, "a"), (half, "b")))
    apart = F.col("d_a") + F.col("d_b") - 2 * F.least(F.col("d_a") - F.col("before_a"), F.col("d_b") - F.col("before_b"))
    similar = ((den + num) * apart <= (den - num) * (F.col("n_a") + F.col("n_b"))) & (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    both = one.join(two, ["h", "cell"]).where((F.col("comp_a") != F.col("comp_b")) & (F.struct("before_a", "id_a") > F.struct("before_b", "id_b")) & similar)
    return both.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def _in_cells(one: DataFrame, two: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """one and two (a part of one), with the cells in which each row of one meets each row of two that has its key, once.

    A key with over CELL_ROWS rows has a square of cells, so many to a side that about CELL_ROWS rows
    of each table meet in one: a row is repeated once for each CELL_ROWS rows of its key, and no more.
    """
    hot = frequent_keys(one, key, bound=CELL_ROWS)
    if hot is None:
        return one.withColumn("cell", F.lit(0)), two.withColumn("cell", F.lit(0))
    g = F.coalesce(F.col("__salts"), F.lit(1))
    own, other = F.pmod(F.xxhash64("id"), g).cast("int"), F.sequence(F.lit(0), g - 1)

    def placed(side: DataFrame, cell) -> DataFrame:
        return side.join(hot, side[key] == hot["__key"], "left").withColumn("cell", F.explode(F.transform(other, cell))).drop("__key", "__salts")

    return placed(one, lambda x: own * g + x), placed(two, lambda x: x * g + own)


def near_groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, m: int = REGISTERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id = component_id).

    Documents are linked whose sets of k-word shingles have den * intersection >= num * union. Words
    are [^\\x20\\x09-\\x0D]+ with A-Z lowered; fewer than k words are one shingle; a null or blank text
    has none and is linked with nothing. Rows that share a doc_id are nodes that share a name: each
    gets the least component of any of them by its own text. A row with a null doc_id can't be named:
    it links nothing, its component is null and it is kept. Extra columns are ignored.
    """
    all_ = settled(sketches(docs, k, m))
    named = all_.where("doc_id is not null and n > 0")
    reps = settled(named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    rows = band_rows(num / den, m)
    bands = F.transform(F.sequence(F.lit(0), F.lit(m // rows - 1)), lambda i: F.xxhash64(i, F.substring("regs", 2 * rows * i + 1, F.lit(2 * rows))))
    banded = reps.select("id", F.explode(bands).alias("bucket"))
    pivots = settled(banded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(PIVOTS))), "id"))["id"].alias("pivot"), F.count("*").alias("size")).where("size > 1"))
    hot = frequent_keys(pivots, "bucket", n=reps.count() * (m // rows), size="size")
    members = settled(spread_join(banded, pivots.select("bucket", "pivot"), "bucket", hot))
    sets = _sets(docs, settled(members.select("id").distinct().join(reps.select("id", "digest"), "id")), k)

    # with the pivot of each bucket: first each text's likeliest one, then the others that this hasn't brought together
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    asked = settled(members.where("id <> pivot").select(*ordered("id", "pivot")).distinct())
    often = frequent_keys(asked, "a", "b")
    pairs = _plausible(asked, often, reps, num, den)
    first = settled(pairs.groupBy("a").agg(F.max_by("b", F.struct("j", -F.col("b"))).alias("b")))
    links = _verified(first, often, sets, num, den)
    star = links.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    links = links.unionByName(_verified(_across(pairs.join(first, ["a", "b"], "left_anti"), often, star), often, sets, num, den))
    comp = components(links)

    # with the member of most links in each bucket that still has several components
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    open_ = _open_buckets(members, comp, hot)
    hubs = open_.join(degree, "id", "left").groupBy("bucket").agg(F.max_by(F.struct("id", "comp"), F.struct(F.coalesce("links", F.lit(0)), -F.col("id"))).alias("hub"))
    to_hub = spread_join(open_, hubs, "bucket", hot).where(F.col("comp") != F.col("hub.comp")).select(*ordered("id", F.col("hub.id"))).distinct().join(pairs, ["a", "b"], "left_anti")
    asked = settled(to_hub)
    often = frequent_keys(asked, "a", "b")
    found = _verified(_plausible(asked, often, reps, num, den), often, sets, num, den)
    if not found.isEmpty():
        links = links.unionByName(found)
        comp = components(links)

    # all others across components, by the rarest differences from their cluster's centre that similar sets must share
    open_ = _open_buckets(members.where("id <> pivot"), comp, hot)
    if not open_.isEmpty():
        ids = settled(_clusters(open_, hot).join(reps.select("id", "n"), "id"))
        often = frequent_keys(ids, "cluster")
        differences = _differences(sets, ids, often)
        ids = settled(ids.join(differences.select("id", "d"), "id"))
        crossing = _crossing(differences, ids, num, den, "d").unionByName(_central(ids, often, num, den)).distinct()
        asked = settled(crossing.join(pairs, ["a", "b"], "left_anti"))
        often = frequent_keys(asked, "a", "b")
        found = _verified(_plausible(asked, often, reps, num, den), often, sets, num, den)
        if not found.isEmpty():
            comp = components(links.unionByName(found))

    groups = reps.select("digest", "id").join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    named = spread_join(named.select("doc_id", "n", "digest"), groups, "digest", frequent_keys(named, "digest"))
    alone = all_.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("comp"))
    out = named.select("doc_id", "n", "comp").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("comp")).alias("kept"))
