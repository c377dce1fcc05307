"""Operators on documents against brute force, and on awkward rows."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from filltape.llm import bpe, near_dedup, packing, quality, shards, substring_dedup, toxicity
from filltape.llm.shingles import shingle_set

WORDS = [f"w{n}" for n in range(400)]
SCHEMA = "doc_id long, text string, Score string, kept int, row string, size double"


def sentence(seed: int, count: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(count))


def texts() -> list[tuple[int | None, str | None]]:
    base, passage = sentence(1, 300), sentence(2, 70)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, sentence(3, 40) + " " + passage),
        (5, passage + "\n" + sentence(4, 40)),
        (6, sentence(5, 5000)),
        (7, ""),
        (8, None),
        (9, " \n\t "),
        (10, "one two"),
        (11, "ONE\ttwo"),
        (12, "a b c d e f g h " * 5),
        (13, "line\nline\nother\n\n\nline # % |"),
        (14, "é ß 你好 \u00a0 x"),
        (None, base),
        (None, None),
        (15, base),
        (15, base),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", None, "r", 1.5) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (4, 1, 0), (6, 1, 1), (7, None, None), (12, 0, 1)],
        "doc_id long, quality int, toxic int",
    )


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_key(rows, key="doc_id"):
    return sorted((tuple(r) for r in rows), key=repr)


def expected_components(rows, percent):
    sets = [(i, set(shingle_set(t, 5).tolist())) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for (a, one), (b, other) in itertools.combinations(sets, 2):
        if one and other and 100 * len(one & other) >= percent * len(one | other):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_dedup.near_duplicates(docs, 85).collect()
    assert len(rows) == len(texts())
    want = expected_components(texts(), 85)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in rows}
    assert (sizes[7], sizes[8], sizes[9], sizes[10], sizes[12]) == (0, 0, 0, 1, 8)


def test_near_duplicates_of_a_hot_group_in_blocks(spark, monkeypatch):
    """Many near copies, cut into blocks, with chains that only the second round joins."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows, base = [], sentence(9, 120).split()
    for i in range(40):
        own = list(base)
        for j in range(i % 4):
            own[(i * 7 + j * 31) % 120] = f"x{i}{j}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    want = expected_components(rows, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    fewest = near_dedup.least_agreements(85)
    agree = rng.random((20_000, near_dedup.HASHES)) < 0.85
    steps = agree.reshape(len(agree), -1, near_dedup.BATCH).sum(2).cumsum(1)
    missed = (steps < np.array(fewest)).any(1).sum()
    assert missed <= 4, "far more than the chosen chance"
    assert near_dedup.band_rows(85) == 8 and near_dedup.band_rows(80) == 6


def test_substring_dedup(docs):
    rows = substring_dedup.substring_dedup(docs).collect()
    assert len(rows) == len(texts())
    seen: dict[tuple, int] = {}
    for i, text in texts():
        own = words(text)
        for p in range(len(own) - 49):
            if i is not None:
                key = tuple(own[p : p + 50])
                seen[key] = min(seen.get(key, i), i)
    want = []
    for i, text in texts():
        own = words(text)
        gone = set()
        for p in range(len(own) - 49):
            if i is not None and seen[tuple(own[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        want.append((i, len(own), " ".join(w for n, w in enumerate(own) if n not in gone)))
    assert by_key((r["doc_id"], r["n_words"], r["kept_text"]) for r in rows) == by_key(want)
    for r in rows:
        assert r["n_words"] - sum(s["length"] for s in r["spans"]) == len(words(r["kept_text"]))
        assert r["row"]["Score"] == "s"


def test_factors_touching_and_apart():
    assert substring_dedup.factors(np.array([], int)) == []
    assert substring_dedup.factors(np.array([0, 1, 51, 102])) == [(0, 101), (102, 50)]


def repeats(own: list[str]) -> int:
    windows = [tuple(own[p : p + 8]) for p in range(len(own) - 7)]
    counts, covered = Counter(windows), set()
    for p, window in enumerate(windows):
        if counts[window] > 1:
            covered.update(range(p, p + 8))
    return len(covered)


def test_quality_counts(docs, labels):
    rows = quality.judge(docs, labels).collect()
    want = []
    for i, text in texts():
        own, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        n, repeated = len(own), repeats(own)
        failed = n < 20 or 100 * repeated > 30 * n
        counts = (sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")))
        want.append((i, n, *counts, len(lines) - len(set(lines)), repeated, failed))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert by_key(tuple(r[c] for c in columns) for r in rows) == by_key(want)
    assert all(r["kept"] <= (not r["base_failed"]) for r in rows)


def test_quality_ratio_separates_and_needs_trust(spark, docs):
    good = [(i, sentence(i, 80)) for i in range(60)]
    bad = [(i, " ".join(f"z{(i * j) % 97}" for j in range(80))) for i in range(60, 90)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    known = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    ratio = {r["doc_id"]: r["llr"] for r in quality.judge(rows, known).collect()}
    assert min(ratio[i] for i in range(60)) > max(ratio[i] for i in range(60, 90))
    none = quality.judge(docs, known.filter("false")).collect()
    assert {r["llr"] for r in none} == {0.0}


def test_toxicity_learns_a_pair_and_families(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1500):
        own = [rng.choice(WORDS) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            own[:4] = [rng.choice(["idiotic", "scummy", "veju" + rng.choice("abcdef")])] * 4
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity.judge(docs, labels).join(labels, "doc_id").collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)


def test_factorization_machine_needs_pairs():
    """Two terms that count together only: no sum of weights can tell them apart."""
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 2, (2000, 2))
    sets = [np.flatnonzero([1, *p]).astype(np.int32) for p in pairs]
    label = pairs.prod(1).astype(float)
    machine = toxicity.fit(sets, label)
    scores = np.array([machine.score(t) for t in sets])
    assert ((scores >= 0.5) == (label == 1)).all()
    assert 0.49 < toxicity.fit(sets[:2], np.array([1.0, 1.0])).score(sets[0]) <= 1


def test_toxicity_awkward_rows(spark, docs, labels):
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (7, 8, 9)}
    assert len(empty) == 1
    none = toxicity.judge(docs, labels.filter("false")).collect()
    assert all(r["predicted"] == 0 for r in none)


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_round_trip(docs, ranks):
    pattern = public_tokenizers.PATTERN
    ids = docs.select("doc_id", "text", bpe.encode(F.col("text"), ranks, pattern).alias("ids"))
    rows = ids.withColumn("decoded", bpe.decode(F.col("ids"), ranks, pattern)).collect()
    encoding = bpe._encoding(ranks.value, pattern)
    for r in rows:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_cuts_change_nothing(ranks):
    encoding = bpe._encoding(ranks.value, public_tokenizers.PATTERN)
    rng = random.Random(1)
    alphabet = [*"ab1 2  \n\t'sé.,!  \x1c\u00a0\u2009", "'ll", " the", "你", " " * 5000]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
        ids = []
        for piece, whole in bpe.pieces(text, rng.randint(1, 8)):
            ids += encoding._encode_single_piece(piece) if whole else encoding.encode_ordinary(piece)
        assert ids == encoding.encode_ordinary(text)
    for text in (" " * 1_500_000 + "x", "a" * 300_000, "é!" * 100_000):
        assert encoding.decode_bytes(bpe.encode_text(encoding, text)) == text.encode()


def test_bucket_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        count = rng.randint(1, 7)
        tops = sorted(rng.sample(range(40), count))
        rows = [rng.randint(1, 5) for _ in tops]
        limit = rng.randint(1, 4)

        def cost(ends, tops=tops, rows=rows):
            return sum(n * min(e for e in ends if e >= t) for t, n in zip(tops, rows, strict=True))

        ends = packing.boundaries(list(zip(tops, rows, strict=True)), limit)
        every = itertools.chain(*(itertools.combinations(tops, k) for k in range(1, limit + 1)))
        assert len(ends) <= limit
        assert cost(ends) == min(cost(c) for c in every if tops[-1] in c)
    assert packing.boundaries([], 3) == []


def test_bucket_boundaries_of_many_lengths_are_optimal():
    """Against the same program without the hull, where all lengths count for themselves."""
    rng = np.random.default_rng(4)
    tops = np.unique(np.round(np.exp(rng.normal(6, 1.5, 3000))).astype(int))
    rows = rng.integers(1, 50, len(tops))
    sums, best = np.concatenate([[0], np.cumsum(rows)]), None
    for _ in range(9):
        if best is None:
            best = np.concatenate([[0], sums[1:] * tops])
            continue
        whole = best[None, :] + (sums[1:, None] - sums[None, :]) * tops[:, None]
        whole[np.arange(len(tops) + 1)[None, :] > np.arange(len(tops))[:, None]] = 1 << 60
        best = np.concatenate([[0], np.minimum(best[1:], whole.min(1))])
    ends = packing.boundaries(list(zip(tops.tolist(), rows.tolist(), strict=True)), 9)
    width = np.array(ends)[np.searchsorted(ends, tops)]
    assert len(ends) <= 9 and (width * rows).sum() == best[-1] and tops.max() > 10_000


@pytest.mark.parametrize("slice_rows", [200_000, 3])
def test_packing(docs, slice_rows, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", slice_rows)
    length = packing.word_count(F.col("text"))
    rows = packing.pack(docs, length, buckets=3, budget=700).collect()
    assert by_key((r["doc_id"], r["length"]) for r in rows) == by_key(
        (i, len(words(t))) for i, t in texts()
    )
    batches = Counter((r["bucket"], r["width"], r["batch"]) for r in rows)
    for (bucket, width, batch), n in batches.items():
        allowed = max(1, 700 // max(width, 1))
        last = max(b for k, _, b in batches if k == bucket)
        assert n == allowed if batch < last else n <= allowed
    for r in rows:
        assert r["padding"] == r["width"] - r["length"] >= 0
    assert len({(r["bucket"], r["batch"], r["place"]) for r in rows}) == len(rows)


def test_cuts_are_contiguous_and_reach_the_least_capacity():
    rng = random.Random(6)
    for _ in range(400):
        sizes = [rng.choice((1, 2, 3, 9, 40)) for _ in range(rng.randint(1, 10))]
        shards_ = rng.randint(1, 5)
        placed = shards.cuts(sizes, shards_)
        loads = Counter()
        for shard, size in zip(placed, sizes, strict=True):
            loads[shard] += size
        assert placed == sorted(placed) and set(placed) == set(range(min(shards_, len(sizes))))
        best = min(
            max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes))))
            for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards_ - 1)
        )
        assert max(loads.values()) == best
    assert shards.cuts([], 3) == []
    assert shards.cuts([100, 1, 1, 1, 1], 3) == [0, 1, 1, 2, 2]
    assert sorted(Counter(shards.cuts([5] * 4, 3)).values()) == [1, 1, 2]
    # One size as large as a third of all leaves the others near equal.
    sizes = [rng.randint(1, 30) for _ in range(4000)]
    sizes[1500] = sum(sizes) // 2
    placed = shards.cuts(sizes, 40)
    loads = [sum(s for s, p in zip(sizes, placed, strict=True) if p == n) for n in range(40)]
    others = sorted(loads)[:-1]
    assert max(loads) <= sizes[1500] + 30 and others[-1] < 1.2 * sum(others) / 39
    assert sorted(others)[1] > 0.8 * sum(others) / 39


@pytest.mark.parametrize(("slice_rows", "cells"), [(1_000_000, 1 << 16), (2, 1 << 16), (2, 2)])
def test_shards(docs, slice_rows, cells, monkeypatch):
    monkeypatch.setattr(shards, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(shards, "CELLS", cells)
    rows = shards.shard(docs, 5).collect()
    want = [
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts()
    ]
    assert by_key((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == by_key(want)
    for shard, n in Counter(r["shard"] for r in rows).items():
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert 0 <= shard < 5 and slots == list(range(n))
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2, 15)}) == 1
    assert {r["shard"] for r in rows} == set(range(5))


@pytest.mark.parametrize("kind", ["near", "repeats", "quality", "toxicity", "packing", "shards"])
def test_empty_table(spark, docs, labels, kind):
    none = docs.filter("false")
    frame = {
        "near": lambda: near_dedup.near_duplicates(none, 85),
        "repeats": lambda: substring_dedup.substring_dedup(none),
        "quality": lambda: quality.judge(none, labels),
        "toxicity": lambda: toxicity.judge(none, labels),
        "packing": lambda: packing.pack(none, packing.word_count(F.col("text"))),
        "shards": lambda: shards.shard(none, 4),
    }[kind]()
    assert frame.collect() == []


def test_toxicity_learns_a_pair_whose_terms_tell_nothing(spark):
    """Both words are as often in toxic texts as any other; only together they are toxic."""
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(4000):
        own = [rng.choice(WORDS) for _ in range(40)]
        kind = i % 100
        # With both words, without any, with one: 11 % toxic texts for each of the words.
        if kind < 2 or 10 <= kind < 26:
            own[0] = "qqa"
        if kind < 2 or 26 <= kind < 42:
            own[1] = "zzb"
        toxic = kind < 2 or 50 <= kind < 59
        if kind >= 50 and toxic:
            own[2] = "scummy"
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels)
    fillers = [sentence(1000 + i, 38) for i in range(100)]

    def share(extra: str) -> float:
        found = [machine.score(toxicity.terms(f"{text} {extra}")) for text in fillers]
        return sum(s >= toxicity.THRESHOLD for s in found) / len(found)

    assert share("qqa zzb") >= 0.95
    assert max(share("qqa w1"), share("w1 zzb"), share("w1 w2")) <= 0.05
    # The factors alone know the pair.
    machine.factors[:] = machine.squares[:] = 0
    assert share("qqa zzb") <= 0.05


def test_toxicity_score_is_the_machine_s_formula():
    """Weights and products of factors, by double loops; no term counts for its text twice."""
    rng = np.random.default_rng(3)
    zero = np.zeros(toxicity.BUCKETS)
    machine = toxicity.Machine(-1.0, zero, np.zeros((toxicity.BUCKETS, 3)), zero)
    kinds = [None, "", "one", "One two THREE threefold", sentence(9, 200), sentence(9, 200)]
    flat, ends = toxicity.term_sets(kinds)
    sets = np.split(flat, ends[1:-1])
    used = np.unique(flat)[::2]
    machine.weights[used] = rng.normal(0, 0.1, len(used))
    machine.factors[used] = rng.normal(0, 0.1, (len(used), 3))
    machine.squares = (machine.factors**2).sum(1)
    found = machine.scores(flat, ends)
    for text, own, score in zip(kinds, sets, found, strict=True):
        assert len(set(own)) == len(own) and list(own) == list(toxicity.terms(text))
        raw = machine.bias + sum(machine.weights[t] for t in own)
        for a, b in itertools.combinations(own, 2):
            raw += machine.factors[a] @ machine.factors[b]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))
    assert found[4] == found[5] and found[0] == found[1]


def test_toxicity_best_partners_against_all_pairs():
    """A planted pair is every term's best partner if no other pair tells; order is fixed."""
    rng = np.random.default_rng(5)
    labels, texts = np.zeros(3000), []
    for i in range(3000):
        own = set(rng.choice(np.arange(2, 60), 20, replace=False))
        own |= {n for n in (0, 1) if rng.random() < 0.3}
        labels[i] = rng.random() < (0.9 if {0, 1} <= own else 0.05)
        texts.append(np.array(sorted(own)))
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    share = np.full(3000, labels.mean())
    parts = [
        toxicity._count_pairs(p, 4, np.concatenate(texts), ends, labels, share, 60)
        for p in range(4)
    ]
    term, partner, sign, gain = toxicity._best_partners(parts)
    best = {t: (p, s) for t, p, s in zip(term, partner, sign, strict=True)}
    assert best[0] == (1, 1) and best[1] == (0, 1)
    both = np.array([{0, 1} <= set(t) for t in texts])
    # What is left of a pair's gain after its two terms is at most all of it.
    n, m = both.sum(), labels[both].sum()
    most = toxicity._gain(np.array([n]), np.array([m]), np.array([labels.mean()]))[0]
    assert toxicity.least_gain(60) <= gain[list(term).index(0)] <= most


def test_near_duplicates_bound_groups_of_apart_classes(spark, monkeypatch):
    """With every class apart, all pairs meet and no group has more than two blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = [(1, i, i % 8, 8, i, i > 0) for i in range(64)]
    parts = spark.createDataFrame(
        rows, "band long, id long, block int, blocks int, part long, apart boolean"
    )
    groups: dict[tuple, list] = {}
    for r in near_dedup.in_pairs_of_blocks(parts).collect():
        groups.setdefault((r["block"], r["slot"]), []).append((r["id"], r["home"]))
    met = {
        (a, b)
        for group in groups.values()
        for (a, one), (b, other) in itertools.combinations(sorted(group), 2)
        if one or other
    }
    assert met == set(itertools.combinations(range(64), 2))
    # Slots are dealt by a hash, so they vary around BLOCK.
    assert max(map(len, groups.values())) <= 32


def test_signatures_of_long_texts_differ():
    rng = np.random.default_rng(1)
    one, other = (
        near_dedup.signature(np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64)))
        for _ in range(2)
    )
    assert (one == other).mean() < 0.05


def test_pipeline_keeps_another_text_of_a_copy_s_id(spark):
    import corpus_pipeline

    base, other = sentence(21, 100), sentence(22, 100)
    rows = [(1, base), (5, base), (5, other), (6, None), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert by_key(left) == by_key([(1, base), (5, other), (6, None), (None, base)])
