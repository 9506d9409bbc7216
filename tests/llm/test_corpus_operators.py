"""Operators over whole tables, against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, near_dedup, sharding, topk
from test_row_operators import AWKWARD


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


# -- mixing ------------------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    """Water-filling round by round; sizes by source in order."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rest > 3 * sizes[s] * w}
        if not over:
            return target | {s: weight[s] * rest / w for s in open_}
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("counts", [(5, 5, 5), (100, 1, 1, 1), (1, 50, 2, 80, 3), (300,)])
def test_mix_meets_targets(docs, counts):
    names = [None if i == 1 else f"s{i}" for i in range(len(counts))]
    rows = [(1000 * s + i, prose(1000 * s + i, 5 + i % 17), None, names[s]) for s, n in enumerate(counts) for i in range(n)]
    got = mixing.digest(docs(rows, extra=True)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in sorted(rows, key=lambda r: (r[3] is None, r[3] or "")):
        sizes[s] += len(t.split())
    want, taken, source = targets_by_hand(sizes), Counter(), {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] in [k * r["size"] for k in range(4)]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 21 for s in sizes)  # the largest document
    mixed = mixing.mix(docs(rows, extra=True))
    times = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert mixed.columns == docs(rows, extra=True).columns and times == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})
    assert sorted(map(tuple, mixing.digest(docs(rows[::-1])).collect())) == sorted(map(tuple, got))


def test_mix_of_awkward_rows(docs):
    got = mixing.digest(docs([(i, t, None, None) for i, t in AWKWARD])).collect()
    assert len(got) == len(AWKWARD) and sum(r["taken"] for r in got) > 0
    assert mixing.digest(docs([])).count() == 0 == mixing.mix(docs([])).count()
    assert [r["taken"] for r in mixing.digest(docs([(1, "", None, "a"), (2, None, None, "b")])).collect()] == [0, 0]


# -- sharding ----------------------------------------------------------------------------------------------


def shards_hold(got, n, most_apart):
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert len(got) == n and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sums = [sum(r["size"] for r in by[i]) for i in range(8)]
    assert max(sums) - min(sums) <= most_apart, sums


def test_shards_have_nearly_equal_bytes_and_keep_copies_together(docs):
    rows = [(i, prose(i % 900, 30 + i % 50)) for i in range(1200)]
    got = sharding.digest(docs(rows, extra=True)).collect()
    shards_hold(got, len(rows), 2_000)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 7


def test_a_group_of_copies_larger_than_a_shard_is_split(docs):
    rows = [(i, "the same text again" if i % 2 else prose(i, 4)) for i in range(1000)]
    shards_hold(sharding.digest(docs(rows)).collect(), 1000, 150)


def test_shards_come_out_sorted_and_callers_columns_stay(docs):
    rows = [(i, "the same text" if i % 3 == 0 else prose(i, 6)) for i in range(500)]
    keyed = docs(rows).select(sharding.sort_key(F.col("text"), F.col("doc_id")).alias("key"), F.lit(5).alias("size"), *[F.lit("x").alias(c) for c in ("first", "part", "n", "slot")])
    got = sorted(sharding.assign(keyed).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert set(got[0].asDict()) == {"key", "size", "first", "part", "n", "shard", "slot"} and {r["first"] + r["part"] + r["n"] for r in got} == {"xxx"}
    assert [r["key"] for r in got] == sorted(r["key"] for r in got)
    keys = sorted(r["key"] for r in got)
    bounds = keys[20::37]
    found = keyed.select("key", sharding.shard_of(F.col("key"), bounds).alias("s")).collect()
    assert all(r["s"] == sum(b <= r["key"] for b in bounds) for r in found)
    assert sorted(r["shard"] for r in got) == [r["shard"] for r in got]


def test_shards_of_awkward_rows(docs):
    got = sharding.digest(docs(AWKWARD)).collect()
    assert sorted(r["slot"] for r in got) and len(got) == len(AWKWARD)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.digest(docs([])).count() == 0


# -- near duplicates ---------------------------------------------------------------------------------------


def changed(text, seed, edits):
    words, r = text.split(), random.Random(seed)
    for _ in range(edits):
        i = r.randrange(len(words))
        words[i : i + r.choice([0, 1])] = [prose(r.random(), 1)] if r.random() < 0.7 else []
    return " ".join(words)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_banded_alignment_is_the_edit_distance():
    r = random.Random(2)
    for _ in range(600):
        a = [r.randrange(5) for _ in range(r.randint(0, 30))]
        b = [x for x in a if r.random() < 0.9] + [r.randrange(5) for _ in range(r.randint(0, 5))]
        x, y, d, most = np.array(a, np.int32), np.array(b, np.int32), distance(a, b), r.randint(0, 15)
        assert near_dedup.edit_distance_within(x, y, most) == (d if d <= most else None)
        assert near_dedup.bag_distance(x, y) <= d
        assert near_dedup.edit_distance_bits(x, y) == d
        assert near_dedup.alike(x, y) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_long_texts_are_aligned_whole():
    r = np.random.default_rng(5)
    a = r.zipf(1.3, 30_000).astype(np.int32)
    for edits, same in ((5_900, True), (6_100, False)):
        b = a.copy()
        b[r.choice(len(a), edits, replace=False)] = -1 - np.arange(edits)
        assert near_dedup.edit_distance_bits(a, b) == edits and near_dedup.alike(a, b) == same


def test_near_copies_share_a_class_and_others_do_not(docs):
    passage = prose(77, 60)
    rows, group = [], {}
    for g in range(25):
        base = prose(g, 120)
        for k in range(1 + g % 4):
            i = 100 * g + k
            rows.append((i, changed(base, i, 3) if k else base))
            group[i] = g
    for k in range(60):  # one large group of near copies, one of copies
        rows.append((5000 + k, changed(prose(500, 150), k, 3)))
        group[5000 + k] = 500
        rows.append((6000 + k, prose(600, 80)))
        group[6000 + k] = 600
    for k in range(40):  # documents that share a passage only
        rows.append((7000 + k, passage + " " + prose(7000 + k, 120)))
        group[7000 + k] = 7000 + k
    rows.append((9000, prose(600, 80).upper().replace(" ", ", ")))
    group[9000] = 600
    first = {}
    for i, g in sorted(group.items()):
        first.setdefault(g, i)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.digest(docs(rows, extra=True)).collect()}
    assert got == {i: first[g] for i, g in group.items()}
    kept = near_dedup.dedup(docs(rows, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values()) and kept.columns == docs(rows, extra=True).columns


def scattered(n, edits, seed):
    """n words, and the same with as many of them replaced."""
    r = random.Random(seed)
    a = [f"w{r.getrandbits(48)}" for _ in range(n)]
    b = list(a)
    for i in r.sample(range(n), edits):
        b[i] = f"x{r.getrandbits(48)}"
    return " ".join(a), " ".join(b)


@pytest.mark.parametrize("n, edits, least", [(200, 16, 0.99), (200, 30, 0.97), (200, 40, 0.9), (60, 12, 0.9), (40, 8, 0.97), (15, 3, 0.97), (5, 1, 0.97)])
def test_pairs_at_the_stated_similarity_meet(n, edits, least):
    hashed, met = near_dedup.Hasher(), 0
    for seed in range(200):
        a, b = (hashed(near_dedup.words_of(t)) for t in scattered(n, edits, seed))
        assert near_dedup.alike(*((w >> np.uint64(1)).astype(np.int64) for w in (a, b)))
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        met += bool((x == y).any())
    assert met >= least * 200


def test_scattered_changes_are_found_and_more_of_them_are_not(docs):
    rows = [(100 * g + k, t) for g in range(1, 21) for k, t in enumerate(scattered(200, 36, g))]
    rows += [(5000 + 100 * g + k, t) for g in range(1, 11) for k, t in enumerate(scattered(12, 2, 1000 + g))]
    rows += [(9000 + 100 * g + k, t) for g in range(1, 11) for k, t in enumerate(scattered(200, 44, 2000 + g))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.digest(docs(rows)).collect()}
    assert sum(got[i] == i - 1 for i in got if i % 100 and i < 9000) >= 29
    assert all(got[i] == i for i in got if i % 100 == 0 or i >= 9000)


@pytest.mark.parametrize("edits, least", [(10, 1.0), (20, 1.0), (30, 0.95), (40, 0.9)])
def test_links_in_a_crowd_are_those_of_all_pairs(docs, edits, least):
    """Groups around a shared passage, at edit similarities of 0.95 to 0.8: all pairs by brute force against the classes."""
    passage, texts, r = scattered(60, 0, 99)[0].split(), {}, random.Random(edits)
    for g in range(40):
        base = passage + scattered(140, 0, g)[0].split()
        texts[100 * g + 100] = base
        for k in range(1, 3):
            other = list(base)
            for i in r.sample(range(200), edits):
                other[i] = f"y{r.getrandbits(48)}"
            texts[100 * g + 100 + k] = other
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.digest(docs([(i, " ".join(w)) for i, w in texts.items()])).collect()}
    code = {w: n for n, w in enumerate({w for t in texts.values() for w in t})}
    rows = {i: np.array([code[w] for w in t], np.int32) for i, t in texts.items()}
    pairs = [(i, j) for i in rows for j in rows if i < j and near_dedup.alike(rows[i], rows[j])]
    assert len(pairs) >= 80
    assert sum(got[i] == got[j] for i, j in pairs) >= least * len(pairs)
    assert all(got[i] // 100 == i // 100 for i in got)


def test_no_link_at_the_threshold_is_lost(docs):
    """Pairs as far apart as links may be, by words replaced, added and left out: sketches alone leave some of them apart."""
    rows, r = [], random.Random(7)
    for g in range(1, 301):
        n = (5, 6, 10, 14, 60, 60, 60, 200)[g % 8]
        a, b = (t.split() for t in scattered(n, int(0.2 * n + 1e-9) if g % 3 else 0, 7000 + g))
        if g % 3 == 0:  # one text is the other without a fifth of its words
            b = [w for i, w in enumerate(b) if i not in r.sample(range(n), int(0.2 * n + 1e-9))] if n < 60 else [b[i] for i in sorted(r.sample(range(n), n - n // 5))]
        rows += [(100 * g, " ".join(a)), (100 * g + 1, " ".join(b))]
    hashed = near_dedup.Hasher()
    words = {i: (hashed(near_dedup.words_of(t)) >> np.uint64(1)).astype(np.int64) for i, t in rows}
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.digest(docs(rows)).collect()}
    linked = [i for i in words if i % 100 == 0 and near_dedup.alike(words[i], words[i + 1])]
    assert len(linked) > 250 and all(got[i + 1] == i for i in linked)


@pytest.mark.parametrize("least", [0.6, 0.75, 0.8, 0.9])
def test_alike_texts_share_the_kmers_that_they_need(least):
    r = random.Random(int(least * 100))
    for _ in range(2000):
        n = r.randint(2, 40)
        a = [r.randint(0, 3 * n) for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(0, n // 3)):
            i, how = r.randrange(len(b) + 1), r.randint(0, 2)
            b[i : i + (how < 2)] = [r.randint(0, 3 * n)] * (how > 0)
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        if a == b or not b or not near_dedup.alike(x, y, least):
            continue
        shared = {q: len(np.intersect1d(*(near_dedup.labelled_kmers(w.astype(np.uint64), q) for w in (x, y)))) for q in near_dedup.LENGTHS}
        both = [near_dedup.shared_at_least(len(w), least) for w in (x, y)]
        assert any(all(q in need and shared[q] >= need[q] for need in both) for q in near_dedup.LENGTHS)


def test_a_repeated_kmer_changes_no_other(docs):
    a = scattered(100, 0, 11)[0].split()
    b = a[:90] + a[:10]  # some k-mers twice
    x, y = (near_dedup.labelled_kmers(near_dedup.Hasher()(w)) for w in (a, b))
    assert len(np.intersect1d(x, y)) == 88
    met = near_dedup.sketch(near_dedup.Hasher()(a)) == near_dedup.sketch(near_dedup.Hasher()(b))
    assert met.sum() > 10


def test_order_matters(docs):
    words = prose(3, 400).split()
    halves = " ".join(words[200:] + words[:200])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.digest(docs([(1, " ".join(words)), (2, halves)])).collect()}
    assert got == {1: 1, 2: 2}  # nearly the same set of k-mers, but far apart by edits


def test_near_duplicates_of_awkward_rows(docs):
    got = near_dedup.digest(docs(AWKWARD)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(i, i) for i, _ in AWKWARD]))
    kept = near_dedup.dedup(docs([*AWKWARD, (8, "x")])).collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(i) for i in (1, 2, 3, None, 5, 6, 7))
    assert near_dedup.digest(docs([])).count() == 0 == near_dedup.dedup(docs([])).count()


def test_one_row_of_a_class_stays_whatever_the_ids(docs):
    a, b, c, d = (prose(i, 120) for i in range(4))
    rows = [(None, a), (None, a), (None, changed(a, 1, 3)), (1, b), (1, changed(b, 2, 3)), (None, b), (7, c), (7, d), (9, d), (None, ""), (None, None), (11, ""), (11, "")]
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.dedup(docs(rows)).collect()]
    count = lambda *texts: sum(t in texts for _, t in kept)
    assert count(rows[0][1], rows[2][1]) == 1 == count(rows[3][1], rows[4][1])
    assert [i for i, t in kept if t in (rows[3][1], rows[4][1])] == [1]
    assert sorted(map(repr, (x for x in kept if x[1] in (c, d, "", None)))) == sorted(map(repr, [(7, c), (7, d), (None, ""), (None, None), (11, "")]))


def test_components(spark):
    edges = [(b"%d" % a, b"%d" % b) for a, b in [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 8), (6, 6)]]
    got = near_dedup.components(spark.createDataFrame(edges, "node binary, pivot binary")).collect()
    assert {bytes(r["node"]): bytes(r["root"]) for r in got} == {b"2": b"1", b"3": b"1", b"4": b"1", b"5": b"1", b"8": b"7", b"9": b"7"}


# -- top k -------------------------------------------------------------------------------------------------


def top_by_hand(rows, k, asked):
    whole = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if asked(q):
            scores = sorted((-int(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_top_k_is_that_of_plain_search(spark, block):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6) * (r.random(6) < 0.7)]) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(15)]  # ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (None, [1.0] * 6), (305, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' as id", "1 as score")
    got = topk.top_k(df, df.where("vec_id % 10 = 0 or vec_id > 299"), 10, candidates_in_block=block, queries_in_block=block).collect()
    assert sorted(map(tuple, got)) == top_by_hand(rows, 10, lambda q: q % 10 == 0 or q > 299)


def test_top_k_of_little(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.digest(empty).count() == 0
    one = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (1, [2.0]), (100, [1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.digest(one).orderBy("rank").collect()] == [(100, 1, 1, 1024 * 2048), (100, 2, 1, 1024 * 2048)]


def test_many_texts_around_a_frequent_pair_make_few_candidates(docs):
    """Texts that are two words over and over beside words of their own: alike ones are candidates, the crowd is not paired."""
    r, rows = random.Random(5), []
    for g in range(60):
        own = [f"o{r.getrandbits(48)}" for _ in range(60)]
        rows.append((10 * g, " ".join(own[:30] + ["and", "so"] * 60 + own[30:])))
    other = rows[7][1].split()
    for i in r.sample(range(len(other)), 36):
        other[i] = f"y{r.getrandbits(48)}"
    rows.append((71, " ".join(other)))
    d = docs(rows)
    sigs = near_dedup.signatures(d, "doc_id", "text")
    nodes = near_dedup.cut(sigs.select(F.col("id").alias("node"), "id", "text_hash", "digest", "n_words", "sketches"))
    none = near_dedup.settle(nodes.where("false").select("node", F.col("node").alias("root")))
    pairs = [tuple(x) for x in near_dedup.apart(d, nodes, none, "doc_id", "text").collect()]
    assert (71, 70) in pairs and len(pairs) < 30
    assert [tuple(x) for x in near_dedup.missed(d, nodes, none, "doc_id", "text").collect()] == [(71, 70)]


def test_kmers_dealt_into_many_parts_take_no_more_bytes(docs):
    """Each text's k-mers fall apart into more parts as tables grow; what says whose they are must not grow with them. Copies are left out."""
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.getrandbits(20)}" for _ in range(300))) for i in range(200)]
    d = docs([*rows, *[(1000 + i, t) for i, t in rows]])
    nodes = near_dedup.cut(near_dedup.signatures(docs(rows), "doc_id", "text"))
    for parts in (8, 400):
        t = near_dedup._kmers_by_hash(d, nodes, "doc_id", "text", parts, 0.8).toArrow()
        sizes = near_dedup._sizes(t, "keys")
        assert 200 * 298 <= sizes.sum() <= 1.3 * 200 * 298 and sum(t.column(c).nbytes for c in t.column_names) / sizes.sum() < 6.5
        number = near_dedup._from_steps(t.column("texts").to_pylist(), sizes)
        assert len(number) == sizes.sum() and sum(near_dedup._sizes(t, "owners")) <= 1.3 * 200


def test_numbers_in_few_bytes_are_the_same_numbers():
    some = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**35, 2**60, 2**63 - 1, 5, 0], np.int64)
    assert near_dedup._long(near_dedup._short(some)).tolist() == some.tolist() and not len(near_dedup._long(near_dedup._short(some[:0])))
    one, none, two = np.array([3, 3, 2**40]), np.zeros(0, np.int64), np.array([2**50, 2**50 + 1])
    assert near_dedup._from_steps([near_dedup._steps(x) for x in (one, none, two)], np.array([3, 0, 2])).tolist() == [*one, *two]


def test_components_beyond_one_task(spark, monkeypatch):
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(200)], "node bigint, pivot bigint")
    few = sorted(map(tuple, near_dedup.components(edges).collect()))
    monkeypatch.setattr(near_dedup, "ONE_TASK_ROWS", 0)
    assert sorted(map(tuple, near_dedup.components(edges).collect())) == few
