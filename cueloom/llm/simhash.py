"""SimHash near-duplicate groups by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into parts of correlated bits. With thresholds t_i whose sum is
`most` - parts + 1, a pair that differs in `most` bits at most differs in t_i bits at most in some part
i; t_i = -1 leaves a part out. Each fingerprint gets the thresholds that a dynamic program finds
cheapest on the candidate counts that histograms of all fingerprints predict for it, probes its parts
in these radii, and candidates are verified on all bits.

Buckets of many fingerprints (dense clusters) are never paired. Their members are compared with one
pivot; what that leaves in several components meets in midpoints: fingerprints a and b differ in three
bits at most if and only if a value lies within one flipped bit of one and within two of the other.
All that lie within two flips of a value are linked with one that lies within one flip, so links grow
with the number of fingerprints, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, frequent_keys, gather, settled, spread_join
from .near_dedup import GRAPH_ROWS, GRAPH_TASKS, components
from .words import SPACED, Words, eights, in_slices

BITS = 64
SEED = 42
#: Shingles that are hashed together.
STEP = 1 << 18
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of raw[start:end] for many places at once; raw has eight more bytes at its end."""
    loads, n, at = eights(raw), end - start, start.copy()
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed + P5, np.uint64)
        long = np.flatnonzero(n >= 32)
        if len(long):
            acc = [np.full(len(long), seed + k, np.uint64) for k in (P1 + P2, P2, np.uint64(0), np.uint64(0) - P1)]
            live, here = np.arange(len(long)), at[long]
            while len(live):
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], loads[here[live] + 8 * i])
                here[live] += 32
                live = live[end[long[live]] - here[live] >= 32]
            whole = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                whole = (whole ^ _round(np.uint64(0), a)) * P1 + P4
            h[long], at[long] = whole, here
        h += n.astype(np.uint64)
        left = end - at
        for i in range(3):  # words of eight bytes
            if len(j := np.flatnonzero(left >= 8 * (i + 1))):
                h[j] = _rotl(h[j] ^ _round(np.uint64(0), loads[at[j] + 8 * i]), 27) * P1 + P4
        at, left = at + left // 8 * 8, left % 8
        if len(j := np.flatnonzero(left >= 4)):
            h[j] = _rotl(h[j] ^ (loads[at[j]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
            at[j] += 4
        left = left % 4
        for i in range(3):
            if len(j := np.flatnonzero(left > i)):
                h[j] = _rotl(h[j] ^ raw[at[j] + i].astype(np.uint64) * P5, 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, eight bytes of padding, and where each word begins."""
    n = words.end - words.start + 1
    starts = np.cumsum(n) - n
    raw = np.full(int(n.sum()) + 8, 32, np.uint8)
    raw[: len(raw) - 8] = gather(words.raw, words.start, n)  # the byte after a word is white, or the next text's
    raw[starts + n - 1] = 32
    return raw, starts


def votes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set (counts of hashes, one set after another) in how many each bit is set: eight counters of a byte in a word, for 255 hashes at most."""
    full = counts[counts > 0]
    pieces = -(-full // 255)
    of = np.repeat(np.arange(len(full)), pieces)
    cut = (np.cumsum(full) - full)[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first = np.cumsum(pieces) - pieces
    out = np.zeros((len(counts), BITS), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), cut)
        out[counts > 0, bit::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out


def simhash(words: Words, k: int = 3) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles, repeats included; 0 for a text without words."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    if not count.sum():
        return np.zeros(len(words), np.uint64)
    raw, starts = _joined(words)
    at = np.repeat(words.first[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))  # each shingle's first word
    last = at + np.minimum(np.repeat(n, count), k) - 1
    stop = starts[last] + words.end[last] - words.start[last]
    h = np.concatenate([xxh64(raw, starts[at[i : i + STEP]], stop[i : i + STEP]) for i in range(0, len(at), STEP)])
    sets = (2 * votes(h, count) > count[:, None]).astype(np.uint8)
    return np.packbits(sets, axis=1, bitorder="little").view("<u8").ravel()


def few(n: int) -> int:
    """Tasks for a table of `n` narrow rows, whatever the number of shuffle partitions: small tables in many files cost more to write and read than their rows."""
    return GRAPH_TASKS + n // GRAPH_ROWS


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and fp, the fingerprint of its text as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, words in in_slices(b.column(1), SPACED):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(words)), pa.array(simhash(words, k).view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


# ---- parts of correlated bits


def _bits(fp: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each fingerprint."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> np.ndarray:
    """How strongly each two bits of all fingerprints are correlated (0 to 1), from counts that tasks add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        n = 0
        for b in batches:
            for at in range(0, len(b), 1 << 16):
                x = _bits(b.column(0).slice(at, 1 << 16).to_numpy()).astype(np.float32)  # sums up to 65,536 are exact
                both += (x.T @ x).astype(np.int64)
                n += len(x)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(BITS * BITS + 1)), "n": pa.array(np.append(both.ravel(), n))})

    counts = np.zeros(BITS * BITS + 1)
    for place, n in fps.select("fp").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).coalesce(GRAPH_TASKS).collect():  # 4,097 rows
        counts[place] = n
    n = max(counts[-1], 1)
    p = counts[:-1].reshape(BITS, BITS) / n
    one = np.diag(p)
    spread = np.sqrt(np.maximum(np.outer(one * (1 - one), one * (1 - one)), 1e-12))
    return np.abs(p - np.outer(one, one)) / spread


def grouped(corr: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in parts of about equal size: each begins with the two most correlated bits that are left and takes on the bit most correlated with it."""
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - i)
        free = corr[np.ix_(left, left)] - 2 * np.eye(len(left))
        part = [left[j] for j in np.unravel_index(free.argmax(), free.shape)]
        left = [b for b in left if b not in part]
        while len(part) < size:
            part.append(left.pop(int(corr[np.ix_(part, left)].sum(0).argmax())))
        out.append(sorted(part))
    return out


#: The most bits that one histogram covers (2 ** SPAN counts); counts of a wider part are predicted from the histograms of its pieces.
SPAN = 16


def pieces(part: list[int]) -> list[list[int]]:
    n = -(-len(part) // SPAN)
    return [list(map(int, x)) for x in np.array_split(np.array(part), n)]


def values(bits: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits in these places as one number for each fingerprint."""
    return bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))


def histograms(fps: DataFrame, places: list[list[int]]) -> list[np.ndarray]:
    """For each list of places how many of all fingerprints have each value there: 2 ** SPAN counts for each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(p), np.int64) for p in places]
        for b in batches:
            bits = _bits(b.column(0).to_numpy())
            for s, p in zip(sums, places, strict=True):
                s += np.bincount(values(bits, p), minlength=len(s))
        for i, s in enumerate(sums):
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(np.full(len(some), i)), "value": pa.array(some), "n": pa.array(s[some])})

    out = [np.zeros(1 << len(p)) for p in places]
    for b in fps.select("fp").mapInArrow(run, "piece long, value long, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).coalesce(GRAPH_TASKS).toArrow().to_batches():
        piece, value, n = (c.to_numpy() for c in b.columns)
        for i in range(len(places)):
            out[i][value[piece == i]] = n[piece == i]
    return out


def by_distance(counts: np.ndarray, most: int) -> np.ndarray:
    """For each value how many fingerprints have one that differs in exactly 0, 1, ... most bits: counts of flips, bit by bit."""
    out = np.zeros((most + 1, len(counts)), np.float64)
    out[0] = counts
    at = np.arange(len(counts))
    for bit in range(len(counts).bit_length() - 1):
        out[1:] += out[:-1, at ^ (1 << bit)]
    return out


class Allocation:
    """Thresholds for the parts of each fingerprint: the cheapest by predicted counts whose sum is most - parts + 1."""

    #: What a probe costs, counted in candidates: it is a row that is shuffled.
    PROBE = 2.0

    def __init__(self, parts: list[list[int]], counts: list[np.ndarray], most: int):
        self.parts, self.most = parts, most
        self.pieces = [pieces(p) for p in parts]
        n = max(counts[0].sum(), 1)
        tables = iter([by_distance(c / n, most) for c in counts])
        self.tables = [[next(tables).astype(np.float32) for _ in p] for p in self.pieces]
        self.n = n
        self.masks = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(p)), r)], np.int64) for r in range(most + 1)] for p in parts]

    def candidates(self, bits: np.ndarray, i: int) -> np.ndarray:
        """How many fingerprints are predicted within 0, 1, ... most bits of each in part i."""
        total = None
        for places, table in zip(self.pieces[i], self.tables[i], strict=True):
            here = table[:, values(bits, places)]
            if total is None:
                total = here
            else:  # distances of pieces add up
                total = np.stack([sum(total[j] * here[e - j] for j in range(e + 1)) for e in range(self.most + 1)])
        return self.n * np.cumsum(total, 0)

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(threshold of each part for each fingerprint, cost), by a dynamic program over the parts and the sum of t + 1 so far."""
        whole = self.most + 1  # the sum of t_i + 1 over all parts
        best = np.full((whole + 1, len(bits)), np.inf)
        best[0] = 0
        chosen = []
        for i in range(len(self.parts)):
            cost = np.concatenate((np.zeros((1, len(bits))), self.candidates(bits, i) + self.PROBE * np.cumsum([len(m) for m in self.masks[i]])[:, None]))
            options = np.stack([[best[s - t] + cost[t] if t <= s else np.full(len(bits), np.inf) for t in range(whole + 1)] for s in range(whole + 1)])
            chosen.append(options.argmin(1))
            best = options.min(1)
        out, s, each = np.empty((len(self.parts), len(bits)), np.int64), np.full(len(bits), whole), np.arange(len(bits))
        for i in reversed(range(len(self.parts))):
            t = chosen[i][s, each]
            out[i] = t - 1
            s = s - t
        return out, best[whole]

    def signatures(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, fp, probe): one row for each part of each fingerprint, and one for each value that it probes."""
        bits = _bits(fp)
        t, _ = self.thresholds(bits)
        keys, of, probe = [], [], []
        for i, part in enumerate(self.parts):
            own = values(bits, part) | (i << BITS // 2 + 1)
            keys.append(own)
            of.append(np.arange(len(fp)))
            probe.append(np.zeros(len(fp), bool))
            for r, masks in enumerate(self.masks[i]):
                who = np.flatnonzero(t[i] >= r)
                keys.append((own[who, None] ^ masks).ravel())
                of.append(np.repeat(who, len(masks)))
                probe.append(np.ones(len(who) * len(masks), bool))
        return np.concatenate(keys), fp[np.concatenate(of)], np.concatenate(probe)


#: Numbers of parts that are weighed against each other: more parts mean fewer probes and more candidates. A part has 32 bits at most.
PARTS = (2, 3, 4)


def allocated(fps: DataFrame, most: int) -> Allocation:
    """The number of parts with the least predicted cost over all fingerprints, and its tables."""
    corr = correlations(fps)
    groups = [grouped(corr, m) for m in PARTS]
    cut = [[x for part in g for x in pieces(part)] for g in groups]
    counts = iter(histograms(fps, [x for c in cut for x in c]))
    choices = [Allocation(g, [next(counts) for _ in c], most) for g, c in zip(groups, cut, strict=True)]
    sent = fps.sparkSession.sparkContext.broadcast(choices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(sent.value))
        for b in batches:
            for at in range(0, len(b), STEP // 16):
                bits = _bits(b.column(0).slice(at, STEP // 16).to_numpy())
                sums += [a.thresholds(bits)[1].sum() for a in sent.value]
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(sums))), "cost": pa.array(sums)})

    costs = dict(fps.select("fp").mapInArrow(run, "i long, cost double").groupBy("i").agg(F.sum("cost")).coalesce(GRAPH_TASKS).collect())
    return choices[min(range(len(choices)), key=lambda i: costs.get(i, 0))]


# ---- links and components


#: A bucket with more fingerprints is dense: its members aren't compared with each other. A member of a smaller one meets half of DENSE
#: others, each a comparison of two longs in the join; one of a dense bucket makes up to 2,146 rows for midpoints.
DENSE = 1024
#: Fingerprints whose midpoints one task makes.
FLIPPED = 512


def flips(fp: Column, radius: int) -> Column:
    """All values that differ from fp in `radius` bits at most."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return F.transform(F.lit(np.array(masks, np.uint64).view(np.int64)), lambda m: fp.bitwiseXOR(m))


def _close(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _dense_components(dense: DataFrame, links: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, comp of `links` and of the links with pivots; links (a, b) between these components), for the members (key, fp) of dense buckets."""
    parts = few(dense.count())
    pivots = dense.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp"), "fp"))["fp"].alias("pivot"))
    star = settled(dense.join(pivots, "key").where((F.col("fp") != F.col("pivot")) & _close("fp", "pivot", most)).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), parts)
    comp = settled(components(links.unionByName(star)))
    placed = settled(dense.join(comp.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), parts)
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", "n").alias("main"), F.count("*").alias("comps"))
    open_ = settled(placed.join(sizes.where("comps > 1"), "key").groupBy("fp", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("minor")), parts)
    # of a pair in two components, one at least isn't in its bucket's main one: that one flips more bits
    lo, hi, n = most // 2, most - most // 2, open_.count()
    dealt = open_.repartition(GRAPH_TASKS + n // FLIPPED)
    fp = F.col("fp")
    anchor = dealt.select("fp", "comp", F.explode(flips(fp, lo)).alias("v")).groupBy("v").agg(F.min(F.struct("fp", "comp")).alias("at"))
    anchor = F.broadcast(anchor.coalesce(GRAPH_TASKS)) if n * (BITS + 1) ** lo <= BROADCAST_IDS // 4 else anchor
    flipped = dealt.select("fp", "comp", F.explode(F.when(F.col("minor"), flips(fp, hi)).otherwise(flips(fp, lo))).alias("v"))
    met = flipped.join(anchor, "v").where(F.col("comp") != F.col("at.comp"))
    crossing = settled(met.select(F.col("comp").alias("a"), F.col("at.comp").alias("b")).distinct(), few(n))
    return comp, crossing


def fingerprint_components(fps: DataFrame, most: int, dense_from: int = DENSE) -> DataFrame:
    """id, comp (the least id that is reachable) of those of the fingerprints (fp, distinct) that are linked with another."""
    sent = fps.sparkSession.sparkContext.broadcast(allocated(fps, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), STEP // 64):
                key, fp, probe = sent.value.signatures(b.column(0).slice(at, STEP // 64).to_numpy())
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(fp), "probe": pa.array(probe)})

    rows = settled(fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean"))
    parts = few(rows.count())
    sizes = rows.where("not probe").groupBy("key").agg(F.count("*").alias("n"))
    dense_keys = settled(sizes.where(F.col("n") > dense_from).select("key"), parts)
    some = dense_keys.count()
    listed = F.broadcast(dense_keys) if some <= BROADCAST_IDS else dense_keys
    thin = rows.join(listed, "key", "left_anti") if some else rows
    index, probes = thin.where("not probe").select("key", F.col("fp").alias("b")), thin.where("probe").select("key", F.col("fp").alias("a"))
    links = settled(probes.join(index, "key").where((F.col("a") > F.col("b")) & _close("a", "b", most)).select("a", "b").distinct(), parts)
    if some:
        dense = settled(rows.join(listed, "key", "left_semi").select("key", "fp").distinct(), parts)
        comp, crossing = _dense_components(dense, links, most)
        if crossing.isEmpty():
            return comp
        links = comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(crossing)
    return components(links)


def simhash_groups(docs: DataFrame, k: int = 5, most: int = 3, dense_from: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id that links reach, itself included).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a bit is set if it is in over half of the XXH64 of
    the text's k-word shingles, repeats included (fewer than k words are one shingle). A null or blank
    text has the fingerprint zero, which is linked like any other. Fingerprints that differ in `most`
    bits at most are linked. Rows without a doc_id link others, but name no component: one without any
    doc_id has a null component_id. Repeated rows are kept; extra columns are ignored; no rows give none.
    """
    rows = settled(fingerprints(docs, k))
    n = rows.count()
    fps = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), few(n))
    comp = settled(fps.join(fingerprint_components(fps, most, dense_from).withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), few(n))
    names = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = spread_join(comp, names, "comp", frequent_keys(comp, "comp")).select("fp", "component_id")
    out = spread_join(rows, named, "fp", frequent_keys(rows, "fp", n=n)).coalesce(few(n))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
