"""The pipeline against the operators' plain versions on a small fixture."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import near_dedup, quality, secrets, sentencepiece_codec as codec
from test_corpus_operators import changed, prose, targets_by_hand
from test_row_operators import AWKWARD, quality_by_hand, verdict_by_hand


def fixture_rows():
    rows = []
    for i in range(30):
        text = prose(i, 120)
        rows.append((10 * i, text, "en", f"s{i % 3}"))
        if i % 5 == 0:
            rows.append((10 * i + 1, changed(text, i, 2), "en", "s1"))
            rows.append((10 * i + 2, text, "en", "s2"))
    rows.append((1000, prose(900, 100) + ' token = "0123456789abcdef0123456789abcdef01234567"', "en", "s0"))
    rows += [(1001, "too short", "en", "s0"), (1002, None, None, None), (1003, prose(901, 90).replace(" ", "$$$ "), "en", "s1")]
    return rows


def test_stages_take_effect(spark, docs, tmp_path):
    docs(fixture_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        seen.append([r.asDict() for r in df.collect()])
    good, unique, masked, mixed, encoded = seen
    assert {r["doc_id"] for r in good} == {r[0] for r in fixture_rows() if r[0] not in (1001, 1002, 1003)}
    assert all(quality_by_hand(r["text"])[0] >= 50 for r in good)
    assert sorted(r["doc_id"] for r in unique) == sorted([*(10 * i for i in range(30)), 1000])
    assert not any(secrets.find_spans(r["text"]) for r in masked) and all(r["n_chars"] == len(r["text"]) for r in masked)
    assert {r["text"] for r in mixed} <= {r["text"] for r in masked} and len(mixed) > 0
    model = codec.load()
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(encoded) == len(mixed) and all(model.decode(np.array(r["ids"])) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in encoded)
    assert all(set(x[0]) == {"doc_id", "text", "lang", "source", "n_chars"} for x in seen[:4])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(repr(r) for r in df.collect())


def mixed_by_hand(rows):
    """How often each of (doc_id, text, source) is taken."""
    size = lambda t: len(re.findall(quality.WORD, t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    target, times = targets_by_hand(sizes), {}
    for s in names:
        keyed = []
        for i, t, _ in (r for r in rows if r[2] == s):
            digest = hashlib.md5(f"{i}\x1f{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
            seen = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
            weight = max(0.05, sum(c.isalpha() for c in seen) / len(seen) if seen else 0.05)
            keyed.append((-math.log((int(digest[:13], 16) + 0.5) / 2**52) / weight, i, size(t)))
        epochs = min(3, int(target[s] / sizes[s])) if sizes[s] else 0
        left, run = target[s] - epochs * sizes[s], 0
        for _, i, n in sorted(keyed):
            run += n
            times[i] = epochs + (left > 0 and run - n / 2 <= left)
    return times


def test_run_is_the_brute_force_pipeline(spark, docs, tmp_path):
    """Every rule on every text, all pairs, all spans, a sort of every source, the library's ids."""
    sentencepiece = pytest.importorskip("sentencepiece")
    rows = [*fixture_rows(), *((2000 + k, t, None, None) for k, (_, t) in enumerate(AWKWARD))]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    good = [(i, t, s) for i, t, _, s in rows if verdict_by_hand(t)]
    words = {i: near_dedup.words_of(t) for i, t, _ in good}
    code = {w: n for n, w in enumerate({w for x in words.values() for w in x})}
    ids = {i: np.array([code[w] for w in x], np.int32) for i, x in words.items()}
    root = {i: i for i in ids}
    for i in sorted(ids):
        for j in sorted(ids):
            if i < j and near_dedup.alike(ids[i], ids[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    unique = [(i, secrets.redact(t, secrets.find_spans(t)), s) for i, t, s in good if root[i] == i]
    times = mixed_by_hand(unique)
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    want = [(i, s, sp.encode(t)) for i, t, s in unique for _ in range(times[i])]
    got = [(r["doc_id"], r["source"], list(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 20


def test_pipeline_of_nothing(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_at_the_threshold_do_not_stay(spark):
    """A text with repeated phrases and its copy without them, and pairs with a fifth of their words replaced: one of each stays."""
    rows = []
    for g in range(100):
        r = random.Random(300 + g)
        a = [f"w{r.getrandbits(40)}" for _ in range(60)]
        b = list(a)
        for i in r.sample(range(60), 12):
            b[i] = f"x{r.getrandbits(40)}"
        if g % 10 == 0:
            b = a[:54] + a[:6]
        rows += [(2 * g, " ".join(a), None, None, 1), (2 * g + 1, " ".join(b), None, None, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, d, "").collect()) == list(range(0, 200, 2))


def test_kmers_that_get_one_number_are_still_two(spark):
    """Two texts at the threshold that meet in no sketch and share just the k-mers that they must, two of which have the same number."""
    r = random.Random(21)
    word = lambda: f"w{r.getrandbits(40)}"
    a = [word() for _ in range(60)]
    a[3:6], a[33:36] = ("elwbmlm", "yegnusr", "rrhyzgi"), ("dwarqtz", "emwnluj", "rzkokab")
    b = list(a)
    for i in range(2, 60, 5):
        b[i] = word()
    x, y = (near_dedup.Hasher()(t) for t in (a, b))
    h = near_dedup._mix(near_dedup.labelled_kmers(x) + np.uint64(3))[[3, 33]]
    assert h[0] != h[1] and h[0] >> np.uint64(32) == h[1] >> np.uint64(32) and h[0] % np.uint64(8) == h[1] % np.uint64(8)
    assert not (near_dedup.sketch(x) == near_dedup.sketch(y)).any()
    d = spark.createDataFrame([(1, " ".join(a), None, None, 1), (2, " ".join(b), None, None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()] == [1]
