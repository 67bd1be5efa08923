"""SimHash groups, conversation repair and the Merkle manifest, against brute force and on odd input."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cueloom.llm import common, merkle, repair, simhash
from cueloom.llm.queries import QUERIES
from cueloom.llm.words import SPACED, in_slices

from ..conftest import SMALL

# ---- SimHash


def test_xxh64_is_the_library_s():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(600))
    start = np.array([rng.randrange(400) for _ in range(2000)])
    end = start + np.array([rng.randrange(0, 130) for _ in range(2000)])
    got = simhash.xxh64(np.frombuffer(raw + b" " * 8, np.uint8), start, end)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a:b], seed=42) for a, b in zip(start, end, strict=True)]


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \t\n", "one", "one TWO", "a b c", "a  b\nc", "É é 😀 ß", "x y " * 5000, "w" * 100_000, "\x00 \x1c\x85 z"]
    got = [f for _, words in in_slices(pa.array(texts, pa.string()), SPACED) for f in simhash.simhash(words)]
    assert got == [fingerprint(t) for t in texts]


def linked(fps, most=3):
    """The least index that links reach, for each fingerprint."""
    at = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    return at


@pytest.mark.parametrize("dense_from", [64, 2])
@pytest.mark.parametrize("most", [3, 2])
def test_components_of_clusters(spark, dense_from, most):
    """Clusters that touch at three and four bits, in buckets that count as dense and that don't."""
    rng = random.Random(7)
    fps = [0, (1 << 64) - 1]
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(30):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    fps += [rng.getrandbits(64) for _ in range(100)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    comp = {r.id & (1 << 64) - 1: r.comp & (1 << 64) - 1 for r in simhash.fingerprint_components(df, most, dense_from).collect()}
    want = linked(fps, most)
    groups = lambda of: sorted(sorted(x for x in fps if of[x] == c) for c in set(of.values()))
    assert groups({x: comp.get(x, x) for x in fps}) == groups({x: fps[w] for x, w in zip(fps, want, strict=True)})


@pytest.mark.parametrize("broadcast", [common.BROADCAST_IDS, 0])
def test_small_tables_of_fingerprints_take_few_files(spark, monkeypatch, broadcast):
    """No table is written by a task for each shuffle partition, with and without dense buckets; midpoints that are too many to broadcast, made by several tasks, give the same components."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = list(dict.fromkeys(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for _ in range(300)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    files, write = [], simhash.settled
    monkeypatch.setattr(simhash, "settled", lambda *a: files.append(len((out := write(*a)).inputFiles())) or out)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(simhash, "FLIPPED", 16)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        comp = {r.id & (1 << 64) - 1: r.comp & (1 << 64) - 1 for r in simhash.fingerprint_components(df, 3, 8).collect()}
        docs = spark.createDataFrame([(i, f"word{i} and {i % 7}") for i in range(300)], "doc_id long, text string").repartition(3)
        assert simhash.simhash_groups(docs).rdd.getNumPartitions() < 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 8 and max(files) < 16
    want = linked(fps)
    groups = lambda of: sorted(sorted(x for x in fps if of[x] == c) for c in set(of.values()))
    assert groups({x: comp.get(x, x) for x in fps}) == groups({x: fps[w] for x, w in zip(fps, want, strict=True)})


def test_op11_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_simhash"](spark, SMALL).collect()}
    fps = [fingerprint(d.text) for d in docs]
    comp = linked(fps)
    for d, f, c in zip(docs, fps, comp, strict=True):
        least = min(x.doc_id for x, y in zip(docs, comp, strict=True) if y == c)
        assert got[d.doc_id][1:] == (f"{f:016x}", least)


def test_simhash_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (None, ""), (None, "alone here"), (4, "a b c d"), (4, "a b c d"), (4, "q r s t u v"), (5, "a b c d")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], "doc_id long, text string, fp long, key long, comp string, least long")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in simhash.simhash_groups(docs, k=3).collect())
    name = lambda t: f"{fingerprint(t):016x}"
    zero, abcd = "0" * 16, name("a b c d")
    want = [(1, zero, 1), (2, zero, 1), (3, zero, 1), (0, zero, 1), (0, name("alone here"), 0), (4, abcd, 4), (4, abcd, 4), (4, name("q r s t u v"), 4), (5, abcd, 4)]
    assert got == sorted(want)
    assert simhash.simhash_groups(docs.limit(0), k=3).count() == 0


def test_thresholds_sum_up_and_cost_the_least():
    """Each fingerprint's thresholds add up to most - parts + 1, and no other choice is cheaper."""
    import itertools

    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64) ^ np.uint64(0x5A5A)
    bits = simhash._bits(fps)
    for m in simhash.PARTS:
        parts = simhash.grouped(np.eye(64), m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and max(map(len, parts)) <= 32
        places = [x for p in parts for x in simhash.pieces(p)]
        counts = [np.bincount(simhash.values(bits, p), minlength=1 << len(p)).astype(float) for p in places]
        a = simhash.Allocation(parts, counts, 3)
        t, cost = a.thresholds(bits)
        assert (t.sum(0) == 3 - m + 1).all() and t.min() >= -1
        each = [np.concatenate((np.zeros((1, 200)), a.candidates(bits, i) + a.PROBE * np.cumsum([len(x) for x in a.masks[i]])[:, None])) for i in range(m)]
        for choice in itertools.product(range(5), repeat=m):
            if sum(choice) == 4:
                assert (sum(e[c] for e, c in zip(each, choice, strict=True)) >= cost - 1e-6).all()


def test_correlated_bits_share_a_part(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        x = rng.getrandbits(64)
        for b in range(0, 32):  # bits 2b and 63 - 2b are equal
            x = x & ~(1 << 63 - 2 * b) | (x >> 2 * b & 1) << 63 - 2 * b
        rows.append((x - (1 << 64) if x >> 63 else x,))
    corr = simhash.correlations(spark.createDataFrame(rows, "fp long"))
    parts = simhash.grouped(corr, 4)
    assert all(next(p for p in parts if 2 * b in p) is next(p for p in parts if 63 - 2 * b in p) for b in range(32))


# ---- conversation repair


def repaired(rows):
    """(cost, audit, text) by search over whole strings: a heap of (cost, labels, rows read, roles)."""
    seen, kind = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kind.append(2 if not bare or (role, text) in seen else 0 if bare[-1] in ".!?" else 1)
        seen.add((role, text))
    ok = re.compile(r"(s?(ua)*u?)?")
    heap, least = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if least and cost > least[0]:
            return least
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            least = min(least or (1 << 60,), (cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
        more = [(cost + 3, audit + "I", i, roles + r[0], (*out, (r, ""))) for r in ("user", "assistant") if len(roles) <= 2 * len(rows) + 2]
        if i < len(rows):
            role, text = rows[i]
            more.append((cost + 4, audit + "D", i + 1, roles, out))
            if kind[i] < 2:
                extra = 3 * kind[i]
                if role:
                    more.append((cost + extra, audit + "K", i + 1, roles + role[0], (*out, (role, text))))
                more += [(cost + 3 + extra, audit + "R", i + 1, roles + r[0], (*out, (r, text))) for r in ("user", "assistant")]
        for m in more:
            if ok.fullmatch(m[3]):
                heapq.heappush(heap, m)
    return least


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "s", ""]), rng.choice(["a.", "b!", "c?", "d", "", " \n", "e. ", "f.\n"])) for _ in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: hashlib.sha256(f"{r[0]}\n{r[1]}".encode()).hexdigest())


@pytest.mark.parametrize("block", [4096, 2])
def test_repair_against_search(spark, monkeypatch, block):
    """Costs, label strings and repaired texts are those of a search, with conversations in one block and in many."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    convs = {c: random_rows(rng, rng.randrange(1, 7)) for c in range(120)}
    convs[None] = [("user", "a."), ("user", "b.")]
    table = [(c, t, *r, "x", 1) for c, rows in convs.items() for t, r in enumerate(rows)]
    rng.shuffle(table)
    done = repair.Repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string, key string, pos long"))
    got = {r.conv_id: r for r in done.report().collect()}
    turns = {}
    for r in sorted(done.turns().collect(), key=lambda r: (str(r.conv_id), r.pos, r.seq)):
        turns.setdefault(r.conv_id, []).append(r)
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        cost, audit, text = repaired(rows)
        assert (got[c].cost, got[c].audit) == (cost, audit), rows
        assert got[c].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert "".join(t.edit for t in turns[c]) == audit
        assert "\n".join(f"{t.role}:{t.text}" for t in turns[c] if t.edit != "D") == text
        initials = [r[:1] for r, _ in rows]
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def test_repair_counts(spark):
    rows = [
        (1, None, "user", None), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, 7, None, "y."),
        (2, None, "user", "a."), (3, 0, "user", "q."), (3, 1, "assistant", "r."),
    ]
    got = {r.conv_id: r for r in repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).report().collect()}
    assert got[1][1:7] == (3, 1, 1, 1, 3, got[1].cost)
    assert got[2][1:8] == (0, 0, 0, 0, 0, 3, "KI") and got[3][1:8] == (0, 0, 0, 0, 0, 0, "KK")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.Repair(empty).report().count() == 0 and repair.Repair(empty).turns().count() == 0


def test_one_long_conversation(spark):
    """All rows in one conversation, over several blocks; distances and labels stay linear."""
    n = 3 * repair.BLOCK + 5
    rows = spark.range(n).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    r = repair.Repair(rows).report().collect()[0]
    assert (r.cost, r.audit, r.illegal, r.gaps) == (3, "K" * n + "I", 0, 0)


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Hi. {c} {t}!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        want += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert got == sorted(want, key=str)


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root and, for each node, its siblings level by level, as the rule says it."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, p in zip(proofs, at, strict=True):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proof.append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], proofs


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("block", [4096, 16])
def test_manifest_against_the_rule(spark, monkeypatch, block):
    """Sources of 1, 15, 16, 17, 256, 257 and 600 documents, one of null; blocks of one level and of three."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "DEPTH", {4096: 3, 16: 1}[block])
    sizes = {None: 3, "": 1, "Z": 15, "a": 16, "é": 17, "b": 256, "c": 257, "d": 600}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7919 % 10_007, [None, "", f"Text É {i}"][min(i % 9, 2)], [None, "en"][i % 2], s, None if i % 5 == 0 else i, 1, "x"))
            i += 1
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos long, digest string")
    got = {r.doc_id: r for r in merkle.document_manifest(docs, {"text": F.lower("text")}).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.folded(F.col("received"), F.col("proof"))).collect()}
    assert len(got) == len(rows)
    order = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted((r[0], h(*map(field, (r[0], r[3], r[2], r[4], r[1]))), r) for r in rows if r[3] == s) for s in order}
    tops = {s: climb([x[1] for x in leaves[s]]) for s in order}
    root, over = climb([tops[s][0] for s in order])
    for s, up in zip(order, over, strict=True):
        for (i, leaf, row), proof in zip(leaves[s], tops[s][1], strict=True):
            r = got[i]
            assert (r.source, r.leaf, r.subroot, r.root) == (s, leaf, tops[s][0], root)
            assert [tuple(p) for p in r.proof] == proof + up
            assert r.back == root and (r.other == root) == (not row[1] or row[1] == row[1].lower())


def test_manifest_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.document_manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.document_manifest(spark.createDataFrame([(None, None, None, None, None)], schema)).collect()
    leaf = h("-----")
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in one] == [(leaf, leaf, leaf, [])]
    again = merkle.document_manifest(spark.createDataFrame([(1, "a", "e", "s", 1)] * 3, schema)).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len({str(r.proof) for r in again}) == 3 and all(r.back == r.root for r in again)


def test_ranked(spark):
    """Places in groups, of which one has nearly all rows, null among them."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "a", None, "b"]), rng.choice([None, *range(40)]), i) for i in range(2000)]
    got = common.ranked(spark.createDataFrame(rows, "g string, k long, i long"), ["g"], ["k", "i"]).collect()
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.pos)] == [r[2] for r in want]
        assert {r.n for r in got if r.g == g} == {len(want)}
