"""Operators that compare rows with each other, against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import bucket_refinement, components, coordinate_join, count_tree, islands, members, mixing_tree, voronoi_knn


# ---------------------------------------------------------------- top-k search


def best_by_force(rows, asked, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q in asked:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4, 2048, 16384), (8, 2, 7)])
def test_top_k(spark, sizes):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 4]]) for i in range(160)]
    rows += [(200, None), (201, [1.0, None] + [0.0] * 4), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, [])]
    rows += [(300 + i, [1.0] * 6) for i in range(60)] + [(7, rows[7][1])]  # ties and a repeated row
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, id int, cell string")
    pivots, group, block = sizes
    got = voronoi_knn.top_k(df, F.col("vec_id") % 10 == 0, 5, pivots=pivots, group_queries=group, block_rows=block)
    want = best_by_force(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert voronoi_knn.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert voronoi_knn.top_k(df, F.col("vec_id") < 0).count() == 0


def test_bounds_leave_out_far_cells():
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0]])
    near = {0: [1.0] * 6, 1: [1.0] * 6}
    plan = voronoi_knn.make_plan(pivots, {0: (50, 2.0), 1: (50, 2.0)}, {0: (5, 2.0)}, near, 5, 10, 20)
    assert plan.reach[0, 0] == 0 and plan.reach[0, 1] > 2.0
    assert plan.blocks == [3]


def test_large_products_are_exact():
    a = np.array([[2**40, 3]], dtype=np.int64)
    assert voronoi_knn.products(a, np.array([[2**20 + 1, 5]], dtype=np.int64)).tolist() == [[2**60 + 2**40 + 15]]


# ---------------------------------------------------------------- near duplicates


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components_by_force(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd_docs, odd_rows, no_docs, k, percent):
    rng = random.Random(k)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [edited(base, rng, rng.randrange(9)) for _ in range(40)] + [edited(base, rng, 25) for _ in range(10)]
    other = [f"v{rng.randrange(900)}" for _ in range(150)]
    texts += [edited(other, rng, rng.randrange(4)) for _ in range(12)] + ["a b c d e f g", "a b c d e f g h", "a b", "A  b", "a b c"]
    rows = [(i + 100, t) for i, t in enumerate(texts)] + [(d, t) for d, t, _, _ in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_docs.limit(0).select("doc_id", "text"))
    got = coordinate_join.near_duplicates(docs, k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_force(rows, k, percent)
    assert coordinate_join.near_duplicates(no_docs, k, percent).count() == 0


def test_one_of_each_component_stays(spark, odd_docs, odd_rows):
    kept = [(r.doc_id, r.text) for r in coordinate_join.keep_one(odd_docs, words=5, percent=80).collect()]
    assert coordinate_join.keep_one(odd_docs, words=5, percent=80).columns == odd_docs.columns
    silent = sorted((str(d), str(t)) for d, t, _, _ in odd_rows if not shingles(t, 5))
    assert sorted((str(d), str(t)) for d, t in kept if not shingles(t, 5)) == silent
    spoken = [(d, t) for d, t in kept if shingles(t, 5)]
    assert [d for d, _ in spoken].count(0) == 1 and not {1, 2} & {d for d, _ in spoken}
    assert len(spoken) == len({c for _, n, c in components_by_force([(d, t) for d, t, _, _ in odd_rows], 5, 80) if n and c != "None"})


# ---------------------------------------------------------------- count-vector trees


@pytest.mark.parametrize(("k", "percent", "tree"), [(4, 85, {}), (5, 80, {"groups": 8, "node": 3, "leaf_rows": 5, "leaf_shingles": 2000})])
def test_similar_groups(spark, odd_docs, odd_rows, no_docs, k, percent, tree):
    rng = random.Random(k)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [edited(base, rng, rng.randrange(9)) for _ in range(40)] + [edited(base, rng, n) for n in range(10, 30) for _ in range(3)]
    other = [f"v{rng.randrange(900)}" for _ in range(150)]
    texts += [edited(other, rng, rng.randrange(4)) for _ in range(12)] + ["a b c d e f g", "a b c d e f g h", "a b", "A  b", "a b c"]
    passage = " ".join(f"p{i}" for i in range(60))  # shared by many, similar to none
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(n)) + " " + passage for n in (0, 1, 3, 8, 20, 20, 20, 90, 400)]
    rows = [(i + 100, t) for i, t in enumerate(texts)] + [(d, t) for d, t, _, _ in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_docs.limit(0).select("doc_id", "text"))
    got = count_tree.similar_groups(docs, k, percent, **tree).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_force(rows, k, percent)
    assert count_tree.similar_groups(no_docs, k, percent, **tree).count() == 0


@pytest.mark.parametrize("pages", [members.PAGES, 1])
def test_likely_rows_lose_no_partner(spark, monkeypatch, pages):
    monkeypatch.setattr(members, "PAGES", pages)
    rows = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), F.lit("x").alias("b"))
    keys = rows.where("a IS NULL OR a % 8 = 0")
    got = {r.a for r in members.likely(rows, keys, "a", "b").collect()}
    assert got >= {None, *range(8, 40_000, 8)}
    assert len(got) < (9_000 if pages > 1 else 12_000)
    assert members.likely(rows, keys.limit(0), "a", "b").count() == 0


def test_only_texts_of_candidates_move(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(80)) for _ in range(300)]
    rows = list(enumerate(texts + [edited(texts[0].split(), rng, 1) for _ in range(3)]))
    moved = {}

    def spied(rows, keys, *by):
        out = members.likely(rows, keys, *by)
        moved.setdefault(by, out.count())
        return out

    monkeypatch.setattr(count_tree, "likely", spied)
    got = count_tree.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert sorted(r.component_id for r in got) == sorted([*range(300), 0, 0, 0])
    assert 4 <= moved["v", "body"] < 40


def test_minima_bound_what_is_shared():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(30)]
    for groups in (7, 4096):
        points = islands.count_points(sets, groups)
        bound = islands.shared_counts(points, points)
        for i in range(30):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert bound[i, j] >= both if groups == 7 else bound[i, j] == both


def near_but_apart(rng, n, words=400, edits=14):
    """Copies of one text whose similarity to each other lies just below 85 %."""
    base = [f"w{i}" for i in range(words)]
    return [edited(base, rng, edits) for _ in range(n)]


def test_links_grow_with_a_group_and_not_with_its_pairs(spark):
    rng = random.Random(8)
    sets = [coordinate_join.shingle_hashes(t, 4, coordinate_join.WordHashes()) for t in near_but_apart(rng, 400)]
    one = np.arange(400)
    verified = []
    real = np.intersect1d
    try:
        np.intersect1d = lambda *a, **k: (verified.append(1), real(*a, **k))[1]
        links = islands.tree_links(sets, one, np.zeros(400, dtype=bool), 85)
    finally:
        np.intersect1d = real
    assert len(links) <= 399 and len(verified) <= 2 * 400


def test_compared_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """2,000 copies that lie below the limit of each other, some of which differ from one in a word only."""
    made = {}
    real = coordinate_join.materialise

    def counted(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(coordinate_join, "materialise", counted)
    rng = random.Random(9)
    texts = near_but_apart(rng, 2000, edits=13)
    texts += [t.replace("w7 ", "w8 ", 1) for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in coordinate_join.near_duplicates(docs, 3, 85).collect()}
    assert all(got[2000 + i] == got[i] for i in range(20))
    assert made.get("compared", 0) <= 4 * len(texts)


def test_delta_links_equal_full_sets(spark):
    """Sets near a pivot, compared by what they lack of it and add to it."""
    rng = random.Random(10)
    pivot = set(range(60))
    sets = []
    for i in range(150):
        lacks = set(rng.sample(range(20), rng.randrange(9)))
        sets.append((pivot - lacks) | {100 + rng.randrange(12) for _ in range(rng.randrange(9))})
    rows = []
    for i, own in enumerate(sets):
        lacks, adds = sorted(pivot - own), sorted(own - pivot)
        rows.append((i, i, -1, len(pivot), len(lacks), lacks + [-x for x in adds]))
    fields = "c bigint, comp bigint, pivot bigint, pivot_n bigint, missing bigint, delta array<bigint>"
    got = {(r.a, r.b) for r in coordinate_join._delta_links(spark.createDataFrame(rows, fields), 85).collect()}

    def linked(a, b):
        return 100 * len(a & b) >= 85 * len(a | b)

    wanted = {(i, j) for i in range(150) for j in range(i) if linked(sets[i], sets[j])}
    # both linked with the pivot: one component already
    wanted = {(i, j) for i, j in wanted if not (linked(sets[i], pivot) and linked(sets[j], pivot))}
    assert got == wanted and len(wanted) > 10


def test_match_threshold_rarely_misses():
    t = coordinate_join.match_threshold(48, 85)
    assert sum(math.comb(48, j) * 0.85**j * 0.15 ** (48 - j) for j in range(t)) <= coordinate_join.MISS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 160)] + [(200, 200), (300, 299)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, 300: 299, 299: 299}
    assert components.components(df.limit(0)).count() == 0


# ---------------------------------------------------------------- repeated substrings


def cut_by_force(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def removed(docs, **shape):
    found = bucket_refinement.repeated_substrings(docs, **shape)
    rows = found.documents.join(found.cut.select("r", "n_removed", "n_spans", "kept_sha256"), "r", "left").collect()
    out = []
    for r in rows:
        if r.n_removed is not None:
            out.append((r.n, r.n_removed, r.n_spans, r.kept_sha256))
        else:
            out.append((r.n, r.n, 1, bucket_refinement.EMPTY_SHA) if r.whole else (r.n, 0, 0, r.sha.hex()))
    return out


@pytest.mark.parametrize("shape", [{"length": 40, "run": 24}, {"length": 60, "run": 50}])
def test_repeated_substrings(spark, odd_docs, odd_rows, no_docs, shape):
    rng = random.Random(shape["run"])
    passage = "".join(rng.choice("abcdé ") for _ in range(180))
    texts = []
    for i in range(60):
        own = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(160)))
        lo = rng.randrange(120)
        texts.append(own + passage[lo : lo + rng.randrange(30, 120)] + own[: rng.randrange(60)])
    texts += ["z" * 300, "z" * 45, "xy" * 60, passage, passage, passage[:39], passage[:61], None, ""]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, sha string")
    assert sorted(removed(docs, **shape)) == sorted(cut_by_force(texts, shape["length"]))
    assert sorted(removed(odd_docs, **shape)) == sorted(cut_by_force([t for _, t, _, _ in odd_rows], shape["length"]))
    assert removed(no_docs, **shape) == []


def test_kept_text_is_returned(spark, tmp_path):
    passage = "é" * 150 + "".join(f"{i:03d}" for i in range(100))
    texts = ["ab" + passage + "cd", "x" + passage, "short", None, passage]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bucket_refinement.bucket_refinement(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in rows.items()} == {0: "abcd", 1: "x", 2: "short", 3: "", 4: ""}
    assert all(len(r.text.encode()) == r.n_bytes - r.n_removed for r in rows.values())


def passage_words_by_force(texts, length):
    data = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[s : s + length]) for w in data for s in range(len(w) - length + 1))
    out = []
    for w in data:
        inside = set()
        for s in range(len(w) - length + 1):
            if count[tuple(w[s : s + length])] > 1:
                inside.update(range(s, s + length))
        out.append(len(inside))
    return out


@pytest.mark.parametrize("shape", [(12, 9), (20, 5)])
def test_passages_of_words(spark, odd_docs, odd_rows, no_docs, shape):
    rng = random.Random(shape[0])

    def prose(n):
        return [rng.choice(["a", "bé", "cc", "d,"]) for _ in range(n)]

    passage = prose(90)
    texts = []
    for i in range(60):
        lo = rng.randrange(70)
        own = prose(rng.randrange(40))
        texts.append(rng.choice([" ", "\n", " \t"]).join(own + passage[lo : lo + rng.randrange(8, 60)] + own[: rng.randrange(30)]))
    texts += ["z " * 70, "x y " * 15, " ".join(passage), "  ".join(passage), "\u00a0".join(passage), " ".join(passage[:11]), None, ""]
    texts += texts[:3]

    def counted(docs):
        found = bucket_refinement.repeated_substrings(docs, 40, 24, passage=bucket_refinement.Shape(*shape, words=True))
        rows = found.documents.join(found.cut, "r", "left").collect()
        cut = []
        for r in rows:
            cut.append((r.n, r.n, 1, bucket_refinement.EMPTY_SHA) if r.whole else (r.n, r.n_removed or 0, r.n_spans or 0, r.kept_sha256 or r.sha.hex()))
        return cut, [r.passage_words if r.n_passage_words is None else r.n_passage_words for r in rows]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for df, plain in ((docs, texts), (odd_docs, [t for _, t, _, _ in odd_rows]), (no_docs, [])):
        cut, words = counted(df)
        by_words = passage_words_by_force(plain, shape[0])
        assert sorted(words) == sorted(by_words)
        by_force = cut_by_force(plain, 40)
        assert sorted(zip(cut, words)) == sorted(zip(by_force, by_words))


def test_a_passage_of_short_words_is_counted(spark, tmp_path):
    passage = " ".join(f"w{i % 7}{i}" for i in range(55))
    assert len(passage.encode()) < bucket_refinement.LENGTH
    texts = ["before " + passage, passage + " behind it", "a text of its own " * 3, " ".join(passage.split()[:49]), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bucket_refinement.bucket_refinement(spark, str(tmp_path)).collect()}
    assert {i: r.n_passage_words for i, r in rows.items()} == {0: 55, 1: 55, 2: 0, 3: 0, 4: 0}
    assert all(r.n_removed == 0 and r.text == (texts[i] or "") for i, r in rows.items())


def test_hot_identifiers_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(bucket_refinement, "HOT", 4)
    rows = [(i, 1) for i in range(50)] + [(50 + i, 2 + i // 2) for i in range(40)] + [(99, 77)]
    df = spark.createDataFrame(rows, "r bigint, key bigint")
    repeated = df.groupBy("key").count().withColumnRenamed("count", "m").where("m > 1")
    got = sorted(map(tuple, bucket_refinement._held_twice(df, repeated, "key").collect()))
    assert got == sorted((r, k) for r, k in rows if k != 77)


def test_pieces_of_a_long_text_agree(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    shape, letters = bucket_refinement.Shape(60, 40), bucket_refinement._letters()
    whole = bucket_refinement.runs(data, shape, letters)
    monkeypatch.setattr(bucket_refinement, "PIECE", 700)
    parts = bucket_refinement.runs(data, shape, letters)
    assert [a for a, lo, hi in whole for _ in range(lo, hi + 1)] == [a for a, lo, hi in parts for _ in range(lo, hi + 1)]


# ---------------------------------------------------------------- mixing


def fill(sizes, weights, most):
    """Shares by weight; what exceeds a cap is handed on until nothing does."""
    names = sorted((s for s, _ in sizes if s is not None)) + ([None] if any(s is None for s, _ in sizes) else [])
    size, weight = dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * size[s]}
        if not over:
            return target | share
        target |= {s: most * size[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = [(f"s{i}" if i else None, rng.choice([0, 1, 50, 2000, 10**6])) for i in range(9)]
    want = fill(sizes, (5, 2, 1), 3)
    got = {t.source: t.words for t in mixing_tree.targets(sizes)}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_tree_keeps_quotas():
    quotas = [1000, 0, 7, 123456]
    left = np.array(mixing_tree.splitting_tree(quotas, 16, 1))
    at = {1: np.array(quotas)}
    for node in range(1, 16):
        at[2 * node], at[2 * node + 1] = left[:, node], at[node] - left[:, node]
        assert (at[2 * node] >= 0).all() and (at[2 * node + 1] >= 0).all()
    sums = [at[n].sum() for n in range(16, 32)]
    assert max(sums) - min(sums) <= 1 and sum(sums) == sum(quotas)
    rng = np.random.default_rng(0)
    big = np.array([3 * 10**9, 10**9])
    share = mixing_tree.drawn_left(big, 2 * 10**9, rng)
    assert share.sum() == 2 * 10**9 and (share <= big).all()


@pytest.mark.parametrize("scale", [10**6, 4 * 10**9, 10**11])
def test_tree_draws_by_the_same_law_at_every_size(scale):
    rng, quotas = np.random.default_rng(3), np.array([scale // 2, scale // 8, scale // 10**6, 0, scale // 4])
    total = int(quotas.sum())
    n = total // 2
    draws = np.array([mixing_tree.drawn_left(quotas, n, rng) for _ in range(400 if scale < 10**10 else 60)])
    assert (draws.sum(axis=1) == n).all() and (draws <= quotas).all() and (draws >= 0).all()
    share = quotas / total
    variance = n * share * (1 - share) * (total - n) / (total - 1)
    assert (np.abs(draws.mean(axis=0) - n * share) <= 5 * np.sqrt(variance / len(draws))).all()
    some = variance > 0
    ratio = draws.var(axis=0, ddof=1)[some] / variance[some]
    assert (np.abs(ratio - 1) < 5 * math.sqrt(2 / len(draws))).all()


def test_inversion_equals_numpys_law(monkeypatch):
    """The probabilities of small cases, counted, against binomial coefficients."""
    monkeypatch.setattr(mixing_tree, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(4)
    for good, bad, n in ((5, 7, 4), (3, 0, 2), (0, 6, 3), (9, 2, 10), (4, 4, 8), (6, 3, 0)):
        counts = Counter(mixing_tree.hypergeometric(good, bad, n, rng) for _ in range(4000))
        for k in set(counts) | set(range(n + 1)):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if 0 <= n - k else 0.0
            assert abs(counts[k] / 4000 - p) <= 5 * math.sqrt(p * (1 - p) / 4000)


def test_mix(spark, odd_docs, odd_rows, no_docs):
    plan = mixing_tree.mix(odd_docs, shards=8, block_words=16)
    draws, facts = plan.draws.collect(), plan.sources.collect()
    assert sorted(map(tuple, mixing_tree.mix(odd_docs, shards=8, block_words=16).draws.select("id", "block", "epoch", "shard").collect()), key=str) == sorted(
        ((r.id, r.block, r.epoch, r.shard) for r in draws), key=str
    )
    sizes = Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += len((t or "").encode().split())
    assert {r.source: r.source_size for r in facts} == dict(sizes)
    for f in facts:
        own = [d for d in draws if d.source == f.source]
        assert len(own) == f.quota and abs(sum(d.words for d in own) - f.target) <= 8
    per_shard = Counter(d.shard for d in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert len({(d.row, d.block, d.epoch) for d in draws}) == len(draws)
    taken = Counter()
    for d in draws:
        taken[d.row, d.size] += d.words
    assert all(n <= 3 * size for (_, size), n in taken.items())
    assert mixing_tree.mix(no_docs, shards=4).draws.count() == 0


def test_mixed_documents(spark, odd_docs, no_docs):
    mixed = mixing_tree.mixed_documents(odd_docs, shards=4)
    assert mixed.columns == odd_docs.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    have = Counter((r.doc_id, r.text) for r in odd_docs.collect())
    assert times and all(n <= 3 * have[k] for k, n in times.items())
    assert mixing_tree.mixed_documents(no_docs).count() == 0


def test_mixed_documents_follow_shards_and_places(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('one two three ', id) AS text", "concat('s', id % 3) AS source").coalesce(1)
    draws = mixing_tree.mix(docs, 4, 7, None).draws.collect()
    want = {}
    for d in sorted(draws, key=lambda d: d.shard):
        want.setdefault(d.shard, Counter())[d.id] += 1
    parts = mixing_tree.mixed_documents(docs, 4, 7).rdd.glom().collect()
    parts = [[r.doc_id for r in p] for p in parts if p]
    found = []
    for p in parts:  # whole shards, by number
        while p:
            s = next(s for s, ids in want.items() if s not in found and Counter(p[: ids.total()]) == ids)
            found.append(s)
            assert p[: want[s].total()] != sorted(p[: want[s].total()])
            p = p[want[s].total() :]
    assert sorted(found) == sorted(want) == list(range(4))


def test_op7_counts_draws_by_shard(spark):
    plan = mixing_tree.mixing_tree(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan
