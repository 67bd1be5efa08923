"""Each training-data operator against SQL, a brute-force version, an exact round trip or held-out labels."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueloom.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, near_dedup, secrets, token_planes, toxicity, warc
from cueloom.llm import words as words_module
from cueloom.llm.queries import QUERIES, SQL

from ..conftest import SF, SMALL

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


def odd_docs(spark, extra="digest string, n long, comp long, key long, bucket long, regs string, bin long"):
    """Nulls, blanks, repeats, a long text, and columns whose names operators use themselves."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (6, "x"), (7, "z9 " * 40_000), (8, "é 😀 <|endoftext|>\x00 token: abcdef12")]
    more = [x.split() for x in extra.split(", ")]
    return spark.createDataFrame([(i, t, "en", *(("q" if k == "string" else 1) for _, k in more)) for i, t in rows], f"doc_id long, text string, lang string, {extra}")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    def rows(df):
        return sorted(tuple(map(repr, r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))

    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).df()
    assert rows(got) == rows(want)


# ---- toxicity


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("i​diöt") == toxicity.fold("Ｉdiot")
    assert toxicity.fold("$tupid") == toxicity.fold("5tupid") == toxicity.fold("stupid")
    assert toxicity.fold("cost$ 5") != toxicity.fold("costs 5")


def test_exception_phrases_and_word_starts():
    f = toxicity.fold
    a = toxicity.Lexicon({f("trash"): 2.0}, {f("trash can")}).automaton()
    n = lambda t: len(list(toxicity.matches(a, f(t))))
    assert (n("trash and a trash can"), n("untrash"), n("trash cannot")) == (1, 0, 1)


def test_matches_against_a_naive_matcher():
    rng = random.Random(4)
    for _ in range(300):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
        entries = {word(): float(rng.randint(1, 9)) for _ in range(4)}
        spared = {f"{word()} {word()}" for _ in range(3)} | {word() for _ in range(2)} - set(entries)
        text = " ".join(word() for _ in range(30))
        starts = [i for i in range(len(text)) if i == 0 or text[i - 1] == " "]
        free = [(i, i + len(p)) for p in spared for i in starts if text.startswith(p, i) and text[i + len(p) : i + len(p) + 1] in ("", " ")]
        want = [(i, i + len(e), w) for e, w in entries.items() for i in starts if text.startswith(e, i) and not any(a <= i and i + len(e) <= b for a, b in free)]
        assert sorted(toxicity.matches(toxicity.Lexicon(entries, spared).automaton(), text)) == sorted(want)


def test_toxicity_held_out(spark):
    got = QUERIES["op1_toxicity"](spark, LARGER).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{LARGER}/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert set(got.held_out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]) == {True}
    held = both[both.held_out]
    caught, right = held.predicted[held.toxic == 1], held.toxic[held.predicted == 1]
    assert len(caught) > 10 and caught.mean() > 0.7 and right.mean() > 0.8  # recall and precision
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()


def test_toxicity_edges(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), toxicity.Lexicon()).count() == 0


# ---- decontamination


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame([(1, "Alpha beta", "x"), (2, " ".join(f"w{i}" for i in range(12)), "x"), (3, None, "x"), (None, "q", "x"), (4, "...", "x"), (1, "Alpha beta", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, "x ALPHA, beta! y alpha beta"), (2, "z " + " ".join(f"w{i}" for i in range(11)) + " z"), (3, None), (4, ""), (5, "alphabeta"), (None, "alpha beta")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, [tuple(s) for s in got[1].hit_spans]) == (6, 4, 1, [(1, 2), (4, 5)])
    assert (got[2].n_hit, got[2].n_items) == (11, 1) and got[None].n_hit == 2
    assert not any(got[i].contaminated for i in (3, 4, 5))
    spans = {r.doc_id: r.text for r in decontaminate.clean_documents(docs, bench, remove="spans").collect()}
    assert spans[1] == "x ! y " and spans[5] == "alphabeta" and spans[3] is None
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {3, 4, 5}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd_docs(spark), bench).count() == odd_docs(spark).count()


def test_large_benchmark_in_parts_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, decontaminate.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2000)
    assert sorted(map(str, decontaminate.decontaminate(docs, bench).collect())) == whole


# ---- chat format


def test_chat_round_trip():
    said = ["", "<|im_end|>", "<\\|x|>", "a<\\\\|b", "<|", "|", "é\n<|im_start|>user\n", "\\n", "<<||>>"]
    roles = ["user", "assistant", "a\nb", "\\", "<|im_end|>", "", "\\n", "system", "assistant"]
    out, begin, end = chat_format.assemble([r.encode() for r in roles], [t.encode() for t in said])
    for r, t, o, a, b in zip(roles, said, out.to_pylist(), begin, end, strict=True):
        assert chat_format.parse(o) == [(r.encode(), t.encode())]
        assert chat_format.unescape(o[a:b]).decode() == (t if r == "assistant" else "")
    assert chat_format.parse(b"".join(out.to_pylist())) == [(r.encode(), t.encode()) for r, t in zip(roles, said, strict=True)]


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, None, "y"), (2, None, "assistant", "z")]
    conv = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(conv)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (3, 2, 1, 1)
    assert got[1].loss_sha256 == hashlib.sha256(b"xx").hexdigest()
    assert chat_format.conversation_digests(chat_format.format_turns(conv.limit(0))).count() == 0


# ---- near duplicates


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {p for v in by.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_near_groups(spark, duck, k, num, den):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(60)]
    rows = texts(duck)[:120]
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(90):  # one group of near copies of all degrees
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((10_000 + i, " ".join(w)))
    want = brute_groups(rows, k, num, den)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_a_shingle_of_many_sets_is_dealt_over_few_rows(spark, monkeypatch):
    """Each row meets each other row of its key once, and is repeated once for each CELL_ROWS rows of it, not for each 64."""
    one = spark.range(1000).select(F.lit(7).alias("h"), "id").unionByName(spark.range(30).select((F.col("id") % 10).cast("int").alias("h"), "id")).cache()
    for rows, times in ((2048, 1), (400, 3)):
        monkeypatch.setattr(near_dedup, "CELL_ROWS", rows)
        a, b = near_dedup._in_cells(one, one.where("id % 3 = 0"), "h")
        assert a.where("h = 7").count() == 1003 * times and a.where("h <> 7").count() == 27
        met = a.select("h", "cell", F.col("id").alias("x")).join(b.select("h", "cell", F.col("id").alias("y")), ["h", "cell"]).groupBy("h").count()
        had = one.join(one.where("id % 3 = 0").select("h", F.col("id").alias("y")), "h").groupBy("h").count()
        assert sorted(map(tuple, met.collect())) == sorted(map(tuple, had.collect()))


def test_near_misses_across_components(spark, monkeypatch):
    """Edited copies of one text, most of them too far from each other, each a component of its own: all links are among the pairs, whatever the cells."""
    rng = random.Random(9)
    base = rng.sample(range(10**6), 60)
    sets = {i: sorted({*base, *rng.sample(range(10**6), 3)} - {*rng.sample(base, rng.randint(1, 6))}) for i in range(300)}
    near = {(a, b) for a in sets for b in range(a) if 100 * len(both := {*sets[a]} & {*sets[b]}) >= 85 * (len(sets[a]) + len(sets[b]) - len(both))}
    assert 0 < len(near) < 300 * 299 // 4
    hashed = spark.createDataFrame([(i, bytearray(np.array(h, "<i8").tobytes())) for i, h in sets.items()], "id long, hashes binary")
    ids = spark.createDataFrame([(i, i, len(h)) for i, h in sets.items()], "id long, comp long, n long")
    found = {}
    for rows in (2048, 50):
        monkeypatch.setattr(near_dedup, "CELL_ROWS", rows)
        got = [tuple(r) for r in near_dedup._crossing(hashed, ids, 85, 100).collect()]
        found[rows] = set(got)
        assert len(got) == len(found[rows]) and near <= found[rows] and all(a > b for a, b in got)
    assert found[2048] == found[50]


def test_differences_from_a_centre_lose_no_link(spark):
    """Clusters of edited copies from close to far: links by what differences share, and by the most central set, give the components of all links."""
    rng = random.Random(4)
    sets, cluster = {}, {}
    for c in range(3):
        base = rng.sample(range(10**6), 80)
        for i in range(100 * c, 100 * c + 100 - 98 * (c == 2)):
            n = rng.randint(0, 9)
            sets[i] = sorted({*base, *rng.sample(range(10**6), n)} - {*rng.sample(base, n)})
            cluster[i] = 100 * c
    near = {(a, b) for a in sets for b in sets if a > b and 100 * len(both := {*sets[a]} & {*sets[b]}) >= 85 * (len(sets[a]) + len(sets[b]) - len(both))}
    hashed = spark.createDataFrame([(i, bytearray(np.array(h, "<i8").tobytes())) for i, h in sets.items()], "id long, hashes binary")
    ids = spark.createDataFrame([(i, i, len(h), cluster[i]) for i, h in sets.items()], "id long, comp long, n long, cluster long")
    for often in (None, near_dedup.frequent_keys(ids, "cluster", bound=30)):
        differences = near_dedup._differences(hashed, ids, often)
        sized = ids.join(differences.select("id", "d"), "id")
        central = {tuple(r) for r in near_dedup._central(sized, often, 85, 100).collect()}
        shared = {tuple(r) for r in near_dedup._crossing(differences, sized, 85, 100, "d").collect()}
        assert central <= near and len(central) < len(sets)
        graph = lambda pairs: sorted(map(tuple, near_dedup.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()))
        assert graph(central | shared & near) == graph(near)


def test_near_misses_of_a_crowd_are_few(spark, monkeypatch):
    """A crowd of texts that are too far from each other, each with nine words of 300 changed: pairs that are asked about after the pivots and hubs don't grow with its square."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(300), 9):
            w[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    asked, plausible = [], near_dedup._plausible
    monkeypatch.setattr(near_dedup, "_plausible", lambda pairs, *rest: asked.append(pairs.count()) or plausible(pairs, *rest))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 3, 85, 100)
    assert len(asked) < 3 or asked[2] < 400


def test_near_edges(spark):
    got = [tuple(r) for r in near_dedup.near_groups(odd_docs(spark), 3, 85, 100).collect()]
    assert len(got) == odd_docs(spark).count()
    assert [r for r in got if r[0] == 5] == [(5, 5, 4, False)] and [r for r in got if r[0] == 4] == [(4, 5, 4, True)] * 2
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {0} and all(r[3] for r in got if r[0] in (None, 1, 2, 3, 6, 7, 8))
    assert near_dedup.near_groups(odd_docs(spark).limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 900, dtype=np.uint64)
    both = np.concatenate((a[:600], b))
    low = near_dedup.minima(np.concatenate((a, both)), np.array([len(a), len(both)]))
    union = np.unique(np.concatenate((a, both)))
    assert np.array_equal(np.minimum(low[0], low[1]), near_dedup.minima(union, np.array([len(union)]))[0])
    r = near_dedup.truncated(low)
    j, ok = near_dedup.similarity(r[:1], r[1:], np.array([900.0]), np.array([1500.0]), 0.85)
    assert abs(j[0] - 600 / 1800) < 0.12 and not ok[0]
    assert (1 - 0.85 ** near_dedup.band_rows(0.85)) ** (near_dedup.REGISTERS // near_dedup.band_rows(0.85)) <= near_dedup.MISS


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.comp for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_components_of_a_small_graph_take_few_tasks(spark, monkeypatch):
    """No stage has a task for each shuffle partition; nodes that are too many to broadcast give the same components."""
    links = spark.createDataFrame([(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(12)] + [(12, 1100), (2001, 2000), (2001, 2002)], "a long, b long")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    context = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("small graph", "")
        found = near_dedup.components(links)
        of = context.statusTracker()
        stages = [of.getStageInfo(s) for j in of.getJobIdsForGroup("small graph") for s in of.getJobInfo(j).stageIds]
        assert stages and max(s.numTasks for s in stages if s) < 64
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: 0 for i in [*range(1, 13), *range(1000, 1200)]} | {2001: 2000, 2002: 2000}
    assert {r.id: r.comp for r in found.collect()} == want
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert {r.id: r.comp for r in near_dedup.components(links).collect()} == want


# ---- exact duplicates


def test_exact_edges(spark):
    rows = [(1, None), (2, " "), (3, "a b"), (4, "ab"), (5, "a  b"), (6, "a b"), (None, "a   b"), (5, "a  b"), (7, "")]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, digest string, n_chars long")
    got = exact_dedup.exact_dedup(docs, k=2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].keep_id is None and by[3].group_size == 5 and by[None].kept  # the longest text stays, though it has no id
    assert by[1].keep_id == by[7].keep_id == 2 and by[6].kept
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_misra_gries_keeps_the_frequent():
    rng = random.Random(5)
    stream = [rng.choice("abc") if rng.random() < 0.6 else str(rng.random()) for _ in range(5000)]
    counts: dict = {}
    for at in range(0, len(stream), 100):
        counts = exact_dedup.misra_gries(counts, dict(Counter(stream[at : at + 100])), 9)
    real = Counter(stream)
    assert len(counts) <= 9 and set("abc") <= set(counts)
    assert all(real[x] - len(stream) / 10 <= counts[x] <= real[x] for x in "abc")


# ---- secrets


def strong_spans(t):
    a = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_base(spark, duck):
    rng = random.Random(2)
    bits = ["token", "SECRET", "api_key", "ApiKey", "passwd", "password", "=", ":", " ", '"', "AKIA", "A" * 17, "0af" * 9, "abcdef", "é", "😀", "\n", "."]
    rows = texts(duck) + [(20_000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = strong_spans(t or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3)), t
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in want).encode()).hexdigest(), t


def test_weak_parts_need_their_complement(spark):
    blob = "Zx9" * 14
    rows = [(1, f'é client_id: "abc123" then {blob} and https://api.example.com/v1'), (2, f"{blob} https://a.example.com"), (3, f"user_name=bob_x {'x ' * 300} {blob}"), (4, "AKIA" + "B" * 16 + " " + blob), (4, "AKIA" + "B" * 16 + " " + blob), (None, "client_id: abcd password = hunter22"), (5, None), (6, "token = " + blob)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key long")
    got = sorted((str(r.doc_id), r.spans) for r in secrets.scan_secrets(docs).collect())
    assert got == sorted([("1", "ident:2:20,blob:27:69,endpoint:74:100"), ("2", ""), ("3", ""), ("4", "access:0:20,blob:21:63"), ("4", "access:0:20,blob:21:63"), ("None", "ident:0:15,assign:16:35"), ("5", ""), ("6", "assign:0:50")])
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


# ---- tokens


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers").path


ALPHABET = ["\x01", *"aeiou stn'\n\té中😀 0123.,<|>́​ \x1c\x85　ΣSσİ", "<|endoftext|>", "the", " in", "'ll", "aaaa" * 70, "xyz" * 100]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_is_the_library(vocab):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(vocab("byte_bpe_50k.json")), bpe.Bpe(vocab("byte_bpe_50k.json"))
    ours.store.limit = 300  # words are forgotten again and again
    for at in range(0, 3000, 100):
        some = random_texts(100, at)
        ids, n = ours.encode(some)
        for t, x, back in zip(some, np.split(ids, np.cumsum(n)[:-1]), ours.decode(ids, n), strict=True):
            e = theirs.encode(t, add_special_tokens=False).ids
            assert e == list(x) and theirs.decode(e, skip_special_tokens=False) == back


def test_bpe_query(spark, duck, vocab):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r) for r in QUERIES["op8_bpe_encode_decode"](spark, SMALL).collect()}
    for i, x in texts(duck):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    odd = odd_docs(spark)
    back = bpe.bpe_decode(bpe.bpe_encode(odd, vocab("byte_bpe_50k.json")), vocab("byte_bpe_50k.json"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())


def test_encoder_is_the_library(vocab):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(vocab("word_bpe_49k.json")), token_planes.Encoder(vocab("word_bpe_49k.json"))
    e.known.limit = 300  # words are forgotten again and again
    for at in range(0, 3000, 100):
        some = random_texts(100, at + 7) + ["", "the A. a. LONGWORDOFSEVERALLETTERS longwordofseveralletters longwordofseveralletterS"]
        done = 0
        for lo, w in words_module.in_slices(pa.array(some, pa.string()), e.kind):
            ids, n = e.encode(w, 2)
            for x, got in zip(some[lo : lo + len(w)], np.split(ids, np.cumsum(n)[:-1]), strict=True):
                assert t.encode(x, add_special_tokens=False).ids + [2] == list(got)
                done += 1
        assert done == len(some)


def test_words_of_equal_hashes_are_told_apart():
    known = words_module.KnownWords(100)
    ((_, w),) = words_module.in_slices(pa.array(["a b a cc longer-word longer-wore b"]), words_module.EXACT)
    w.hash[:] = 5
    learn = lambda new: (np.array([hash(x) % 1000 for x in new], np.int32), np.ones(len(new), np.int32))
    for _ in range(2):
        assert known.ids(known.numbers(w, learn))[0].tolist() == [hash(w.word(j)) % 1000 for j in range(7)]


def test_word_hashes_are_not_fooled_by_repetition():
    rise = lambda flip: "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(2048))
    ((_, w),) = words_module.in_slices(pa.array([rise(0), rise(1)]), words_module.SPACED)
    assert w.hash[0] != w.hash[1]


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_words_against_patterns(monkeypatch, step):
    monkeypatch.setattr(words_module, "STEP", step)
    rng = random.Random(1)
    bits = ["a", "B", " ", "\n", "é", "0", ".", "longerword12", "\x00", "Z" * 30]
    for _ in range(100):
        some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 8))]
        for kind, pattern in ((words_module.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (words_module.SPACED, rb"[^\x20\x09-\x0D]+")):
            ((_, w),) = words_module.in_slices(pa.array(some, pa.string()), kind)
            want = [re.findall(pattern, t.encode().lower()) for t in some]
            assert [[w.word(j) for j in range(w.first[i], w.first[i + 1])] for i in range(len(w))] == want
            assert len(set(w.hash.tolist())) == len({x for t in want for x in t})


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 16384, 16385, 40000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        docs, counts, back = token_planes.unpack(token_planes.pack([1, None], np.array([n, 0]), ids, bits))
        assert docs == [1, None] and list(counts) == [n, 0] and np.array_equal(back, ids)


def test_token_files(spark, duck, vocab):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(vocab("word_bpe_49k.json")), 0
    got = {r.doc_id: tuple(r) for r in QUERIES["op7_token_planes"](spark, SMALL).collect()}
    for i, x in texts(duck):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = odd_docs(spark)
    rows = token_planes.read_tokens(token_planes.token_files(odd, vocab("word_bpe_49k.json"), 2, file_ids=10)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i or 0))
    assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(rows))
    assert token_planes.read_tokens(token_planes.token_files(odd.limit(0), vocab("word_bpe_49k.json"), 2)).count() == 0


# ---- WARC


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_warc(spark, duck):
    rows = duck.execute("SELECT page_id, url, html FROM pages ORDER BY 1").fetchall()
    rows += [(90_001, None, None), (90_002, "http://x/é \r\n", ""), (None, "u", "a\r\n\r\nWARC/1.1\r\n"), (90_004, "x", "a\r\n\r\nWARC/1.1\r\n"), (90_003, "x", "a\r\n\r\nWARC/1.1\r\n"), (90_003, "x", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, digest string, first long")
    got = warc.capture_histories(pages).collect()
    first: dict = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        b, w = (h or "").encode(), first[h or ""]
        same = i is None or w == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else w))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    keys = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.page_id for r in QUERIES["op9_warc"](spark, SMALL).collect()} == {r[0] for r in rows if r[0] is not None and r[0] < 90_000}


def test_warc_dates_keep_the_order_of_pages(spark, monkeypatch):
    ids = [-(1 << 63), -60_000_000_000, -1, 0, 1, 2_999_999_999, 3_000_000_001, 200_000_000_000, (1 << 63) - 1]
    stamps = [warc.stamp(i) for i in ids]
    assert stamps == sorted(stamps) and len(set(stamps)) == len(ids) and all(len(x) == 20 for x in stamps)
    monkeypatch.setattr(warc, "RANGE_ROWS", 2)
    pages = spark.createDataFrame([(i, "http://x/", f"page {i}") for i in reversed(ids)], "page_id long, url string, html string")
    index = warc.capture_histories(pages)
    assert index.rdd.getNumPartitions() == len(ids) // 2 + 1
    assert [r.page_id for r in index.collect()] == ids


def test_warc_order_of_urls_with_escapes(spark):
    urls = ["http://x/z", "http://x/é", "http://x/a b", "http://x/a!b", "http://x/{y}", "http://x/b", "http://ö.x/", "http://p.x/", None]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    path = warc.shared_dir(spark)
    warc.write_warc(warc.first_captures(pages).coalesce(1), path)
    runs: dict = {}
    for r in warc.read_warc(spark, path).orderBy("run", "seq").collect():
        runs.setdefault(r.run, []).append((r.url_key, r.ts, r.page_id))
    assert all(r == sorted(r) for r in runs.values()) and sum(map(len, runs.values())) == len(urls)
    keys = [(r.url_key, r.ts, r.page_id) for r in warc.capture_histories(pages).collect()]
    assert keys == sorted(keys) and len(keys) == len(urls)


# ---- language


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(4):
        lengths, k = [int(x) for x in rng.integers(1, 7, 3)], 3
        e, m, f = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k)), rng.normal(size=k)
        got, at = language_id.marginals(e, np.array(lengths), m, f), 0
        for n in lengths:
            z = np.zeros((n, k))
            for path in itertools.product(range(k), repeat=n):
                s = math.exp(f[path[0]] + sum(e[at + i, p] for i, p in enumerate(path)) + sum(m[a, b] for a, b in itertools.pairwise(path)))
                for i, p in enumerate(path):
                    z[i, p] += s
            assert np.allclose(z / z.sum(1, keepdims=True), got[at : at + n])
            at += n


def test_marginals_of_long_sequences_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([100, 1, 33, 64, 65])
    e, m, f = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    a = language_id.marginals(e, lengths, m, f)
    monkeypatch.setattr(language_id, "SEGMENT", 200)
    assert np.allclose(a, language_id.marginals(e, lengths, m, f))


def test_language_held_out_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = language_id.learn(docs.where(~language_id.held_out()), sample_docs=60)
    got = language_id.identify(docs, crf).withColumn("held_out", language_id.held_out()).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    mixed = spark.createDataFrame([(1, "The and of tion the with that is de la los que una para las y der die und das mit von"), (2, None), (3, "123 ²!")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.identify(mixed, crf, spans=True).collect()}
    assert [s.lang for s in rows[1].spans] == ["en", "es", "de"]
    assert (rows[2].lang_pred, rows[2].score, rows[3].lang_pred) == ("und", 0.0, "und")
    odd = odd_docs(spark)
    assert language_id.identify(odd, crf).count() == odd.count()
    assert language_id.known_language(odd, crf).columns == odd.columns
    none = language_id.learn(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 1)
    monkeypatch.setattr(language_id, "FEATURE_BITS", 12)
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} text", f"l{i % 70:02}") for i in range(210)], "doc_id long, text string, lang string")
    taken: list = []
    monkeypatch.setattr(language_id, "fit", lambda texts, fit=language_id.fit: taken.append(texts) or fit(texts))
    assert language_id.learn(docs, sample_docs=2).languages == [f"l{i:02}" for i in range(70)]
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 100)
    language_id.learn(docs, sample_docs=2)
    assert list(map(len, taken)) == [140, 70]


# ---- long texts


def test_secrets_with_very_many_matches(spark):
    n = 40_000
    r = secrets.scan_secrets(spark.createDataFrame([(1, "token=abcdef " * n)], "doc_id long, text string")).first()
    assert r.n_assign == n and r.base_sha256 == hashlib.sha256(",".join(f"assign:{13 * i}:{13 * i + 12}" for i in range(n)).encode()).hexdigest()


def test_words_of_a_text_of_50_mb():
    text = "lorem ipsum dolor " * 2_800_000
    ((_, w),) = words_module.in_slices(pa.array([text]), words_module.SPACED)
    h, n = near_dedup.shingles(w, 3)
    assert len(w.hash) == 8_400_000 and list(n) == [3] == [len(h)] and len(np.unique(w.hash)) == 3


def test_long_texts_in_steps_give_the_same(vocab, monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["ab", "cd", "ef", "gh.", "xyz", "don't", "42"]) for _ in range(3000))
    coder, whole = bpe.Bpe(vocab("byte_bpe_50k.json")), None
    crf = language_id.fit([(" ".join(rng.choice(w) for _ in range(60)), lang) for lang, w in (("a", ["ab", "cd"]), ("b", ["ef", "xyz"])) for _ in range(5)])
    ((_, w),) = words_module.in_slices(pa.array([text]), words_module.SPACED)
    for size in (1 << 20, 500):
        for module, name in ((bpe, "PIECE"), (language_id, "PIECE"), (near_dedup, "STEP"), (decontaminate, "STEP")):
            monkeypatch.setattr(module, name, size)
        h, n = near_dedup.shingles(w, 3)
        ids, counts = coder.encode([text])
        lang, score, words_, spans = language_id.Labeller(crf).label([text], True)
        mask, items = decontaminate.Windows([("1", " ".join(text.split()[700:712]))]).ready().hits(next(words_module.in_slices(pa.array([text]), words_module.ALNUM))[1])
        got = h.tolist(), near_dedup.minima(h, n).tolist(), ids.tolist(), coder.decode(ids, counts), lang, [round(x, 9) for x in score], words_, spans, mask.tolist(), items
        whole = whole or got
        assert got == whole and got[3] == [text] and items == {0: {"1"}}
