"""Brute force, properties and edge cases of the training-data operators."""

import random
import re
import time
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import defects, entities, graph, languages, leakage, neargroups, overlap, packing, sampling, splitting, tokens, words
from corpusmill.llm.fmindex import FMIndex, suffix_order
from corpusmill.llm.queries import ORACLES, QUERIES

CLASH = {"id": "clash", "text": "clash", "cls": 1, "token": 2, "salt": 3, "node": 4, "root": 5}


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_distinct_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    assert got and len(set(map(repr, got))) == len(got)


# ---------------------------------------------------------------- words


def brute_words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def shingles(text, n=3, least=20):
    w = brute_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= least else set()


def test_words_of_odd_texts():
    import pyarrow as pa

    texts = ["", None, "a", "A-b_c9 é x", "  ", "z" * 5_000_000, "ab", "ab", "日本 x1"]
    low = [t.lower() if t else t for t in texts]
    raw, offs = words.column_bytes(pa.array(low))
    starts, ends, first = words.word_spans(raw, offs)
    got = [[bytes(raw[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [brute_words(t) for t in texts]
    h = words.word_hashes(raw, starts, ends)
    flat = [w for r in got for w in r]
    assert len(set(h.tolist())) == len(set(flat)) and h[flat.index("ab")] == h[flat.index("ab") + 1]


def make_texts(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w) if rng.random() > 0.1 else rng.choice([None, "", "Short one", "W1! " * 30]))
    return out


def near(a, b, t=0.7):
    return bool(a and b) and len(a & b) >= t * len(a | b) - 1e-12


def test_near_groups_against_brute_force(spark):
    rng = random.Random(3)
    n = 160
    p, d = make_texts(rng, n), make_texts(rng, n)
    df = spark.createDataFrame([(i * 3 + 1, a, b) for i, (a, b) in enumerate(zip(p, d))], "sample_id bigint, prompt string, description string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for col in (p, d):
        s = [shingles(t) for t in col]
        for i in range(n):
            for j in range(i):
                if near(s[i], s[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    size = Counter(find(i) for i in range(n))
    want = {(i * 3 + 1, find(i) * 3 + 1) for i in range(n) if size[find(i)] > 1}
    got = neargroups.near_groups(df.repartition(5), "sample_id", ["prompt", "description"], 0.7, 3, 20)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40
    assert neargroups.near_groups(df.filter("sample_id < 0"), "sample_id", ["prompt"]).count() == 0
    assert neargroups.near_groups(df.withColumn("prompt", F.lit(None).cast("string")), "sample_id", ["prompt"]).count() == 0


def test_hot_copies_cost_a_link_each(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.range(3000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"v{i}x"), "id") for i in range(30)])).alias("prompt"))
    got = neargroups.near_groups(df, "sample_id", ["prompt"])
    assert got.count() == 1000 and got.select("group_id").distinct().count() == 1


def test_boilerplate_of_single_texts_stays_linear(spark):
    n = 100_000
    common = " ".join(f"word{i}" for i in range(16))
    own = F.concat_ws(" ", *[F.concat(F.lit(f"v{i}x"), "id") for i in range(6)])
    df = spark.range(n).select(F.col("id").alias("sample_id"), F.concat_ws(" ", F.lit(common), own, F.when(F.col("id") % 2 == 0, F.lit("even more words of it"))).alias("prompt"))
    began = time.monotonic()
    # 14 of 20 shingles are common, less than what 0.7 asks for; five texts are repeated
    got = neargroups.near_groups(df.union(df.filter("sample_id < 5").withColumn("sample_id", F.col("sample_id") + n)), "sample_id", ["prompt"], 0.7, 3, 20)
    assert {tuple(r) for r in got.collect()} == {(i + k, i) for i in range(5) for k in (0, n)}
    assert time.monotonic() - began < 120


@pytest.mark.parametrize("hot", [3, 20, 1000])
def test_crowded_shingles_lose_no_link(spark, hot):
    rng = random.Random(12)
    base = [[f"c{k}w{i}" for i in range(40)] for k in range(4)]
    texts = []
    for i in range(240):
        w = list(base[i % 4 if i % 3 else 0])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(40)] = f"u{rng.randrange(30)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id bigint, prompt string")
    s = [shingles(t) for t in texts]
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(240):
        for j in range(i):
            if near(s[i], s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    size = Counter(map(find, range(240)))
    want = {(i, find(i)) for i in range(240) if size[find(i)] > 1}
    assert {tuple(r) for r in neargroups.near_groups(df, "sample_id", ["prompt"], 0.7, 3, 20, hot=hot).collect()} == want


def test_cross_split_pairs_against_brute_force(spark):
    rng = random.Random(8)
    p = make_texts(rng, 160)
    split = [rng.choice(["train", " Train", "TRAINING", "valid", "dev", "Test", "testing ", None, "other"]) for _ in p]
    df = spark.createDataFrame(list(enumerate(p)), "sample_id bigint, prompt string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    m = spark.createDataFrame([(i, s, "x") for i, s in enumerate(split)] * 2, "sample_id bigint, split string, prompt string")
    side = [None if s is None or s == "other" else s.strip().lower().startswith("train") for s in split]
    s = [shingles(t) for t in p]
    want = {(j, i) for i in range(len(p)) for j in range(i) if side[i] is not None and side[j] is not None and side[i] != side[j] and near(s[i], s[j])}
    got = overlap.cross_split_pairs(df, m)
    assert {tuple(r) for r in got.collect()} == want and want
    links = Counter(i for pair in want for i in pair)
    rows = overlap.cross_split_links(df, m).collect()
    assert {r["sample_id"]: r["links"] for r in rows} == links
    assert all(r["class_id"] == min(i for i in range(len(p)) if side[i] is not None and s[i] == s[r["sample_id"]]) for r in rows)
    before = overlap.HOT_POSTINGS
    try:
        overlap.HOT_POSTINGS = 3
        assert {tuple(r) for r in overlap.cross_split_pairs(df, m).collect()} == want
    finally:
        overlap.HOT_POSTINGS = before
    report = overlap.overlap_report(got, df.withColumn("dataset", F.lit("d")), m)
    assert report.agg(F.sum("pairs")).first()[0] == len(want)
    assert overlap.cross_split_pairs(df, m.filter("sample_id < 0")).count() == 0


# ---------------------------------------------------------------- union-find and splits


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 400
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)], "loops": [(1, 1), (None, 2), (7, 7), (9, 8), (8, 9)]}[shape]
    rng.shuffle(edges)
    nodes, roots = graph.local_roots(*np.array([e for e in edges if None not in e]).T)
    counts = Counter(roots.tolist())
    want = {(int(a), int(b)) for a, b in zip(nodes, roots) if counts[b] > 1}
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {tuple(r) for r in graph.groups(df.repartition(6)).collect()} == want
    assert graph.groups(df.filter("u < -1")).count() == 0
    assert {tuple(r) for r in graph.components(df.repartition(6), hot=5).collect()} == {(a, b) for a, b in want if a != b}


@pytest.mark.parametrize("hub", [0, 200_000])
def test_no_task_holds_a_star(spark, monkeypatch, hub):
    worst = []
    real = graph.cut

    def spy(df):
        kept = real(df)
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        worst.append(max(sizes, default=0))
        return kept

    monkeypatch.setattr(graph, "cut", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.components(spark.range(1, 200_000).select(F.lit(hub).alias("u"), F.col("id").alias("v")), hot=1000)
        assert got.count() in (199_999, 200_000) and got.select("root").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(worst) < 3 * 200_000 / 8


def test_equal_settings_of_one_plan(spark):
    members = spark.createDataFrame([(i, i % 70, "ab"[i % 2]) for i in range(700)], "node bigint, root bigint, family string")
    shares = {"train": 0.5, "valid": 0.2, "test": 0.3}
    settings = [{"setting": 1, "family": "a", "seed": 4, **shares}, {"setting": 2, "family": "a", "seed": 5, **shares}, {"setting": 3, "family": "b", "seed": None, **shares}, {"setting": 4, "family": "none", "seed": 1, **shares}]
    got = entities.assign_groups(members, settings)
    counts = {(r["setting"], r["split"]): r["count"] for r in got.groupBy("setting", "split").count().collect()}
    assert set(counts) == {(s, n) for s in (1, 2, 3) for n in shares} and all(abs(n - 350 * shares[k[1]]) <= 10 for k, n in counts.items())
    sides = {(r["setting"], r["root"]): r["split"] for r in got.collect()}
    assert any(sides[1, r] != sides[2, r] for r in range(0, 70, 2))


def test_contests_however_spelt(spark):
    ids = ["Arborjudge/1018/D", "arborjudge-1018-E", " Arborjudge/00001018/A", "Arborjudge 1018B", "Arborjudge/contest/1018/problem/C2", "1018_A. Loom of X (Arborjudge)", "ARBORJUDGE:1018:A1", "Arborjudge/1019/D", "Kelpforce/1018/D", None, "", "  ", "odd id"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "p string").select(entities.contest_of("p")).collect()]
    assert got == ["arborjudge/1018"] * 7 + ["arborjudge/1019", "kelpforce/1018", None, None, None, None]


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(6)
    key = ["hot" if i % 3 == 0 else f"k{rng.randrange(400)}" if i % 5 else None for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(key)), "sample_id bigint, k string")
    out = entities.group_splits(df, "sample_id", F.col("k"), {"train": 0.7, "valid": 0.1, "test": 0.2}, 1).cache()
    assert out.count() == 3000 and out.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r["split"]: r["count"] / 3000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["valid"] - 0.1) < 0.01
    again = entities.group_splits(df.repartition(9), "sample_id", F.col("k"), {"train": 0.7, "valid": 0.1, "test": 0.2}, 1)
    assert again.exceptAll(out).count() == 0
    assert entities.group_splits(df.filter("sample_id < 0"), "sample_id", F.col("k"), {"train": 1.0}).count() == 0


def test_greedy_counts_follow_the_plain_greedy():
    rng = random.Random(9)
    for _ in range(50):
        sizes = Counter(rng.choice([1, 1, 1, 2, 3, 5, 40]) for _ in range(rng.randrange(1, 200)))
        shares = [0.7, 0.1, 0.2]
        total = sum(s * n for s, n in sizes.items())
        below = [total * p for p in shares]
        for size in sorted(sizes, reverse=True):
            for _ in range(sizes[size]):
                k = max(range(3), key=lambda i: (below[i], -i))
                below[k] -= size
        plan = entities.greedy_counts(list(sizes.items()), shares)
        assert all(sum(plan[s]) == n for s, n in sizes.items())
        mine = [total * p - sum(s * plan[s][i] for s in sizes) for i, p in enumerate(shares)]
        assert max(map(abs, mine)) <= max(map(abs, below)) + max(sizes)
    with pytest.raises(ValueError):
        entities.greedy_counts([(1, 1)], [0.0])


# ---------------------------------------------------------------- sampling


def arrivals(spark, data):
    return spark.createDataFrame(data, "stratum bigint, seed bigint, key string, version string, weight double, size bigint, fraction double")


def test_sample_keeps_its_members(spark):
    rng = random.Random(2)
    data = [(1, 42, f"k{rng.randrange(500)}", f"2027{rng.randrange(1, 10):02d}", 1.0, 60, None) for _ in range(900)]
    data += [(2, 7, f"k{i}", f"2027{1 + i % 9:02d}", 1.0, None, 0.2) for i in range(900)]
    kept = set()
    for month in range(1, 10):
        part = [d for d in data if d[3] <= f"2027{month:02d}"]
        rng.shuffle(part)
        got = {(r["stratum"], r["key"]) for r in sampling.consistent_sample(arrivals(spark, part).repartition(3))[0].collect()}
        assert kept <= got
        kept = got
    assert 120 < sum(s == 2 for s, _ in kept) < 240
    early, state = sampling.consistent_sample(arrivals(spark, data[:300]))
    late, _ = sampling.consistent_sample(arrivals(spark, data[300:]), state)
    assert early.select("stratum", "key").exceptAll(late.select("stratum", "key")).count() == 0


def test_sample_edges(spark):
    odd = [(1, None, "a", "1", None, 5, None), (1, None, None, "1", 1.0, 5, None), (1, None, "b", None, 1.0, 5, None), (1, None, "c", "1", 1.0, 5, None), (3, 1, "d", "1", 1.0, None, None), (4, 1, "e", "1", -2.0, 5, None)]
    assert [r["key"] for r in sampling.consistent_sample(arrivals(spark, odd))[0].collect()] == ["c"]
    assert sampling.consistent_sample(arrivals(spark, []))[0].count() == 0


# ---------------------------------------------------------------- packing and splitting


def test_packing_fills_and_keeps_items(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, None, 1, 3, 700, 2048, 2049, 9000, rng.randrange(1, 1200)]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    out = packing.pack(df.select("doc_id", "n_tokens"), 2048).collect()
    by, per = {}, Counter()
    for r in out:
        by.setdefault(r["container"], []).append(r)
        per[r["doc_id"]] += r["n_tokens"]
    assert per == Counter({i: n for i, n in enumerate(sizes) if n})
    for items in by.values():
        at = 0
        for r in sorted(items, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["n_tokens"]
        assert at <= 2048
    assert sorted(by) == list(range(len(by))) and sum(per.values()) / (2048 * len(by)) > 0.92
    assert all(n == 1 for d, n in Counter(r["doc_id"] for r in out).items() if sizes[d] <= 2048)
    same = packing.pack(df.select("doc_id", "n_tokens").repartition(7), 2048).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, out))
    assert packing.pack(df.select("doc_id", "n_tokens").filter("doc_id < 0"), 2048).count() == 0


def fewest(sizes, capacity):
    """The fewest containers, by trying every container for every item, largest first."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_containers_are_near_the_fewest():
    rng = random.Random(21)
    extra = 0
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(11)]
        used = sum(count for count, _ in packing.pack_patterns(dict(Counter(sizes)), 64))
        extra += used - fewest(sizes, 64)
        assert used <= fewest(sizes, 64) + 1
    assert extra <= 12


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    h = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 129), 60)}
    seen = Counter()
    for count, pattern in packing.pack_patterns(h, 128):
        assert sum(pattern) <= 128
        for n in pattern:
            seen[n] += count
    assert seen == Counter(h)


def long_texts():
    rng = random.Random(7)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "é", "日本", "x1,", "don't"]) for _ in range(rng.randrange(3, 15))) + rng.choice([". ", "? ", ".\n", ".\n\n", ".\r\n\r\n"])
    return ["".join(sentence() for _ in range(400)), "a" * 9000, "。" * 3000, "日本語" * 2000, "😀" * 2500, "def f():\n    return 1\n" * 600, " " * 9000, "short", "", None]


def test_pieces_cover_and_pause(spark):
    texts = long_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"piece": F.lit(1), "letters": F.lit("x"), "chars": F.lit(2)})
    for limit, share in ((512, 0), (512, 64), (256, 16)):
        by = {}
        for r in splitting.split_documents(df, limit, share).collect():
            by.setdefault(r["doc_id"], []).append(r)
        assert set(by) == {i for i, t in enumerate(texts) if t and len(tokens.encode(t)) > limit}
        for i, pieces in by.items():
            end = 0
            for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
                assert r["piece"] == k and r["text"] == texts[i][r["start_char"] : r["end_char"]]
                assert r["start_char"] <= end < r["end_char"] and len(tokens.encode(r["text"])) < limit
                assert (r["overlap_tokens"] == 0) == (k == 0 or share == 0) and share <= r["overlap_tokens"] + (k == 0) * share <= share + 4
                end = r["end_char"]
            assert end == len(texts[i])
        if limit == 512 and not share:
            assert all(texts[0][: r["end_char"]].endswith("\n") for r in by[0][:-1])
    assert splitting.split_documents(df.filter("doc_id < 0"), 512).count() == 0
    with pytest.raises(ValueError):
        splitting.split_documents(df, 20, 10)


def test_pieces_over_the_limit_are_cut_again():
    text = long_texts()[0]
    letters, chars = splitting.boundary_letters(text)
    # ranges far above the limit, as if every piece merged badly
    ranges = splitting.token_ranges(text, letters, chars, np.array([900, len(letters) - 900]), 100, 10, tokens.TOKENIZER)
    assert ranges[0][1] == 0 and ranges[-1][2] == len(letters) and all(a[2] == b[1] and b[0] <= b[1] - 10 for a, b in zip(ranges, ranges[1:]))
    for first, _, end in ranges:
        assert len(tokens.encode(text[chars[first - 1] if first else 0 : chars[end - 1]])) < 100


def test_stretches_change_no_token(monkeypatch):
    rng = random.Random(13)
    mixed = "".join(rng.choice("ab '\n\t.,1é日  ") for _ in range(30000))
    texts = [long_texts()[0] * 3, "a" * 30000, "日本語" * 20000, "don't can't 'so 's's'll " * 2000, "x  \n\n  y\t" * 3000, "ab1234.,;'s" * 4000, mixed]
    enc, _ = tokens.encoder()
    for text in texts:
        whole = enc.encode_ordinary(text)
        for stretch in (50, 1000, 1 << 20):
            monkeypatch.setattr(tokens, "STRETCH", stretch)
            assert tokens.encode(text).tolist() == whole
    for blank in (" " * 20000, "\n" * 20000):
        for text in (blank, "x" + blank, blank + "y", "x" + blank + ".", "x" + blank + " \n\u3000z"):
            assert tokens.encode(text).tolist() == enc.encode_ordinary(text)
    huge = " " * 3_000_000 + "x"
    assert enc.decode(tokens.encode(huge).tolist()) == huge and len(tokens.encode("<|endoftext|>")) > 1


def test_results_do_not_depend_on_settings(spark, small):
    got = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for name in ("p6_splits", "p7_pack"):
                got.setdefault(name, []).append(sorted(map(repr, QUERIES[name](spark, small).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(a == b for a, b in got.values())
    metas = {r[0] for r in spark.read.parquet(f"{small}/split_meta.parquet").select("meta_id").collect()}
    assert {r[0] for r in QUERIES["p6_splits"](spark, small).select("meta_id").distinct().collect()} == metas


# ---------------------------------------------------------------- leakage


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t = np.append(rng.integers(0, 3, 60), 0)
        ends = np.flatnonzero(t == 0)
        key = t.astype(float)
        key[ends] = -1 + np.arange(len(ends)) / 1000
        assert suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: key[i:].tolist())


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    t = np.append(rng.integers(0, 4, 500), 0).astype(np.int32)
    index = FMIndex(t, 4, step=7)
    pats = rng.integers(1, 4, (80, 3))
    which, low, high = index.search(pats)
    found = {int(w): set(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
    for k, p in enumerate(pats):
        assert found.get(k, set()) == {i for i in range(len(t) - 2) if (t[i : i + 3] == p).all()}


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    v = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(v) for _ in range(rng.randrange(5, 60))) for _ in range(30)] + [None, "", "Short."]
    docs = []
    for _ in range(150):
        w = [rng.choice(v + ["zz", "yy"]) for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.5:
            s = brute_words(rng.choice(items))
            a = rng.randrange(len(w) + 1)
            w[a:a] = s[: rng.randrange(1, 40)]
        docs.append(", ".join(w).upper() if rng.random() < 0.5 else " ".join(w))
    docs += [None, "", items[0], items[0]]
    i = spark.createDataFrame([(n, t) for n, t in enumerate(items)], "item_id bigint, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    grams = lambda t: {tuple(w[k : k + 16]) for w in [brute_words(t)] for k in range(len(w) - 15)}
    want = {(a, b) for a, x in enumerate(docs) for b, y in enumerate(items) if grams(x) & grams(y)}
    for size in (32 << 20, 300):
        monkeypatch.setattr(leakage, "QUERY_BYTES", size)
        spans = leakage.leaked_passages(d, i)
        assert {(r["doc_id"], r["item_id"]) for r in spans.collect()} == want and want
    for r in spans.collect():
        w = brute_words(docs[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert len(w) >= 16 and {tuple(w[k : k + 16]) for k in range(len(w) - 15)} <= grams(items[r["item_id"]])
    merged = leakage.removal_spans(spans).collect()
    assert all(a["end_word"] < b["start_word"] for a in merged for b in merged if a["doc_id"] == b["doc_id"] and a["start_word"] < b["start_word"])
    assert leakage.leaked_passages(d, i.filter("item_id < 0")).count() == 0 and leakage.leaked_passages(d.filter("doc_id < 0"), i).count() == 0


# ---------------------------------------------------------------- defects

CODE = "def f(a):\n    total = sum(a)\n    return total\n"
PROMPT = "Write a function that adds up all of the numbers in a list and returns the total to the caller."
CASES = [
    (PROMPT, None, "empty"),
    (PROMPT, "", "empty"),
    (PROMPT, "```python\n```", "empty"),
    (PROMPT, "<code></code> ...", "empty"),
    (PROMPT, CODE, None),
    (PROMPT, "42", None),
    (PROMPT, "print(42)", None),
    (PROMPT, f"Here is the code.\n\n```python\n{CODE}```", None),
    (PROMPT, f"Here is the code.\n\n```python\n{CODE}", "truncated"),
    (PROMPT, f"<code>\n{CODE}", "truncated"),
    (PROMPT, "def f(a):\n    total = sum(a)\n    return tot", "truncated"),
    (PROMPT, "def f(a):\n    return sum(a", "truncated"),
    (PROMPT, "The function walks over the list and then it adds each of the numb", "truncated"),
    (PROMPT, "The function walks over the list and adds each of the numbers (see above).", None),
    (PROMPT, PROMPT, "copy"),
    (PROMPT, "```\n" + PROMPT + "\n```", "copy"),
    (PROMPT, PROMPT + "\n\n" + CODE, None),
    (PROMPT, "The task says: " + PROMPT + " We walk over the list once and keep the running sum in one variable.", None),
    (PROMPT, "You asked:\n> " + PROMPT, "copy"),
    (PROMPT, PROMPT.replace("adds", "cabin").replace("numbers", "oar"), "copy"),
    (PROMPT, "Zuerst lesen wir die Werte ein und sortieren sie, damit wir nur einmal durch die Liste gehen.", "language"),
    (PROMPT, CODE + "# zuerst lesen wir die Werte ein und sortieren sie nach der Liste\n", None),
    ("Schreibe ein Programm, das die Werte der Liste addiert und die Summe ausgibt.", "Zuerst lesen wir die Werte ein und dann bilden wir die Summe der Liste.", None),
    (None, "Zuerst lesen wir die Werte ein und dann bilden wir die Summe der Liste.", None),
    ("", CODE, None),
    (PROMPT, "Lo siento, pero no puedo ayudar con esta tarea.", "refusal"),
    (PROMPT, "I cannot use recursion here, so a loop does the work.\n\n" + CODE, None),
]


LABELLED = {
    "en": ["The function walks over the list and adds each of the numbers, so the result is the sum of all values.", "We sort the values first and then we only have to pass through the list once.", "Every step of the loop keeps the running total in one variable and returns it to the caller."],
    "de": ["Zuerst lesen wir die Werte ein und sortieren sie, damit wir nur einmal durch die Liste gehen müssen.", "Schreibe ein Programm, das die Summe aller Werte der Liste berechnet und am Ende ausgibt.", "Danach zählen wir jede Stelle, an der die Grenze überschritten wird, und bilden dann die Summe."],
    "es": ["Primero leemos los valores y los ordenamos para que solo haya que recorrer la lista una vez.", "Escribe un programa que calcule la suma de todos los valores de la lista y la muestre al final.", "Después contamos cada posición en la que se supera el límite y guardamos el resultado."],
}


def labelled(spark):
    rows = [(t, lang if k % 2 else lang.upper() + " ") for lang, texts in LABELLED.items() for k, t in enumerate(texts * 3)] + [(None, "en"), ("Some text", None), ("Some text", "und"), ("", "de")]
    return spark.createDataFrame(rows, "text string, lang string")


def judged(spark, rows):
    df = spark.createDataFrame(rows, "record_id bigint, problem_id string, prompt string, response string")
    return {r["record_id"]: r["defect"] for r in defects.defective_pairs(df, labelled(spark)).collect()}


def test_defects_of_known_pairs(spark):
    rows = [(i, f"q{i}", p, r) for i, (p, r, _) in enumerate(CASES)]
    rows += [(1000 + k, f"x{k}", PROMPT + f" Number {k}.", f"Regrettably that is not mine to write, whatever {w} it may be.") for k, w in enumerate("abcdefgh")]
    rows = [(i, q, unrelated(i) if i >= 1000 else p, r) for i, q, p, r in rows]
    rows += [(2000 + k, f"x{k}", unrelated(k), "A loop is enough for this.\n\n" + CODE) for k in range(8)]
    df = spark.createDataFrame(rows, "record_id bigint, problem_id string, prompt string, response string").withColumns({"id": F.lit(1), "defect": F.lit("x"), "h": F.lit(2), "error_type": F.lit("refusal")})
    got = {r["record_id"]: r["defect"] for r in defects.defective_pairs(df, labelled(spark)).collect()}
    want = {i: d for i, (_, _, d) in enumerate(CASES) if d} | {1000 + k: "refusal" for k in range(8)}
    assert got == want
    without = {r["record_id"]: r["defect"] for r in defects.defective_pairs(df).collect()}
    assert without == {i: d for i, d in want.items() if d != "language"}
    assert defects.defective_pairs(df.filter("record_id < 0"), labelled(spark)).count() == 0
    assert defects.defective_pairs(df, labelled(spark).filter("lang = 'xx'")).count() == len(without)


def unrelated(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)) + "."


def test_answers_with_one_opening_are_no_refusals(spark):
    tails = ["sorting the numbers and taking the middle one of them.", "walking over the tree from its leaves and adding the weights.", "keeping a queue of open cells and marking those that were seen."]
    # three problems, an opening shared, the answer in the same sentence
    rows = [(i, f"q{i % 3}", unrelated(i % 3), f"We get the answer by {tails[i % 3]}") for i in range(6)]
    # the same, the answer in sentences of its own
    rows += [(10 + i, f"p{i % 3}", unrelated(10 + i % 3), f"This one is not hard at all. It is done by {tails[i % 3].upper()}") for i in range(6)]
    # one problem, three variants of an opening
    rows += [(20 + i, "one", unrelated(20), f"{('The plan is simple', 'The plan is quite simple', 'The plan is very simple')[i % 3]}, we add the numbers of the list.") for i in range(6)]
    # several problem ids, copies of one prompt
    rows += [(30 + i, f"c{i}", unrelated(30), "The plan is short, we take the largest number of the list.") for i in range(6)]
    # short answers that differ in a number
    rows += [(40 + i, f"n{i}", unrelated(40 + i), f"The answer is {i * 7}.") for i in range(8)]
    assert judged(spark, rows) == {}
    # a refusal late in a long text, and one behind a polite sentence that answers share
    polite = "Thanks for the question about Peleham."
    rows += [(50, "z", PROMPT, "Thank you so much for writing. " * 17 + "I cannot help with this and will not write it.")]
    rows += [(60 + i, f"t{i}", unrelated(60 + i), f"{polite} No way that {w} comes from me. Try a book on boats.") for i, w in enumerate("abcdef")]
    rows += [(70 + i, f"t{i}", unrelated(70 + i), f"{polite} It is a loop.\n\n{CODE}") for i in range(6)]
    assert judged(spark, rows) == {50: "refusal"} | {60 + i: "refusal" for i in range(6)}


@pytest.mark.parametrize("rounds", [0, 2])
def test_clusters_against_brute_force(spark, monkeypatch, rounds):
    # sentences that are just near enough, which share few buckets and no head
    monkeypatch.setattr(defects, "HEAD_ROUNDS", rounds)
    rng = random.Random(23)
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnopqrstuvwxy"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 16))] for _ in range(60)]
    texts = {"one two three", "one two", "?", "w x y z", "alone in the dark"}
    while len(texts) < 600:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.add(" ".join(w))
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "h bigint, sentence string")
    grams = [set(defects.opening_grams(t)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if grams[i] and len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j])]
    nodes, roots = graph.local_roots(*np.array(near).T)
    got = {r["h"]: r["cluster"] for r in defects.opening_clusters(df).collect()}
    assert len(set(roots.tolist())) > 20 and got == dict(zip(nodes.tolist(), roots.tolist()))
    assert defects.opening_clusters(df.filter("h < 0")).count() == 0


def test_cluster_recall(spark):
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 14))] for _ in range(25)]
    texts = set()
    while len(texts) < 700:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.add(" ".join(w))
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "h bigint, sentence string")
    cluster = {r["h"]: r["cluster"] for r in defects.opening_clusters(df).collect()}
    grams = [set(defects.opening_grams(t)) for t in texts]
    near_pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j])]
    together = sum(i in cluster and cluster[i] == cluster.get(j) for i, j in near_pairs)
    assert len(near_pairs) > 1000 and together >= 0.9 * len(near_pairs)


def test_very_long_pair():
    text = "word " * 200_000
    assert defects.judge_rows([text], [text]).defect == ["copy"]
    assert defects.judge_rows(["x"], ["(" * 100_000]).defect == ["empty"]


def test_languages_are_told(spark):
    model = languages.LanguageModel.fit(labelled(spark), 100, defects.prose_of)
    assert model.names == ["de", "en", "es"]
    told = [model.names[k] if k >= 0 else None for k in model.tell(["Die Summe aller Werte wird am Ende ausgegeben.", "the sum of all values is returned to the caller", "la suma de todos los valores de la lista", "x = 1", "", None], 6.0, 24)]
    assert told == ["de", "en", "es", None, None, None]
    assert languages.LanguageModel.fit(labelled(spark).filter("lang = 'en'"), 100, defects.prose_of) is None
