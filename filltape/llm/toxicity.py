"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words, and their first four, five and six
characters, which catch inflected and invented forms. Terms are hashed into a fixed
number of buckets. The machine adds a weight per term and a product of factor vectors
per pair of terms, so that two words which are harmless alone can count together.

A first machine is fitted to the terms that tell something alone. Factor vectors that start
near zero hardly move towards a pair whose terms tell nothing alone, so the start is looked
for: all pairs of the sample's terms are counted on the executors, and pairs whose share of
toxic texts differs from what the two terms and that machine give point the factors of their
terms the same way (or opposite ways, if the pair is less toxic). The second machine is
fitted from there, with the terms of all such pairs. A score has no other source than the
weights and factors of the text's terms.

The machine is fitted by the driver on a bounded sample of labelled texts, its size is
bounded by the number of buckets, and every text is scored whole by the executors.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filltape.llm.common import stored

BUCKETS = 1 << 18
FACTORS = 8
#: Labelled rows that are learned from, at most; those with the least hash of their id.
SAMPLE_ROWS = 16_384
#: Terms in fewer sampled texts, or whose share of toxic texts differs from the whole
#: sample's by fewer standard deviations, do not tell anything alone.
MIN_TEXTS, MIN_Z = 4, 3.5
#: Pairs of all those counted that may be chosen by chance, and what the factors of a
#: telling pair add to a score's logit before they are fitted.
PAIR_ERRORS, PAIR_START = 0.1, 3.0
#: Tasks that count pairs, and terms they add up at once.
PAIR_TASKS, PAIR_TERMS = 12, 1 << 20
EPOCHS, BATCH, RATE, L1, L2, SEED = 30, 256, 0.3, 3e-5, 1e-3, 17
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5, 6, 7)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of texts whose terms are found at once; a longer text is alone.
_GROUP_CHARS = 1 << 19


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    squares: np.ndarray

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the texts whose terms are ``flat[ends[i] : ends[i + 1]]``."""
        texts = len(ends) - 1
        owner = np.repeat(np.arange(texts), np.diff(ends))
        told = (self.weights[flat] != 0) | (self.squares[flat] != 0)
        flat, owner = flat[told], owner[told]
        raw = self.bias + np.bincount(owner, self.weights[flat], texts)
        raw -= 0.5 * np.bincount(owner, self.squares[flat], texts)
        for column in self.factors[flat].T:
            raw += 0.5 * np.bincount(owner, column, texts) ** 2
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def score(self, terms: np.ndarray) -> float:
        return float(self.scores(terms, np.array([0, len(terms)]))[0])


def term_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct terms of every text, in order, and where each text's end.

    A beginning counts by how many words of the text have it, in powers of two, alone and
    in relation to the text's length.
    """
    counted = [Counter(_WORD.findall((text or "").lower())) for text in texts]
    words = list(itertools.chain.from_iterable(counted))
    times = np.fromiter(
        itertools.chain.from_iterable(c.values() for c in counted), np.int64, len(words)
    )
    own = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
    total = np.bincount(own, times, len(texts)).astype(np.int64)
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.int64, len(words))
    keys = [own * BUCKETS + hashes % BUCKETS]
    width = _PREFIXES[-1] + 1
    chars = np.array(words, f"U{width}").view(np.uint32).reshape(-1, width).astype(np.uint64)
    start = np.zeros(len(words), np.uint64)
    for size in range(1, width):
        start = (start + chars[:, size - 1] + np.uint64(size)) * _MIX
        if size not in _PREFIXES:
            continue
        longer = np.flatnonzero(chars[:, size])
        if not len(longer):
            break
        # One row per text and beginning: the text is mixed in for this.
        mixed = (start[longer] ^ own[longer].astype(np.uint64)) * _MIX
        order = np.argsort(mixed)
        mixed, longer = mixed[order], longer[order]
        first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        count = np.add.reduceat(times[longer], first)
        text = own[longer[first]]
        hashed = (start[longer[first]] >> np.uint64(24)).astype(np.int64)
        keys.append(text * BUCKETS + (hashed + np.frexp(count)[1]) % BUCKETS)
        many = np.flatnonzero(count > 1)
        share = np.frexp(2000 * count[many] // total[text[many]])[1]
        keys.append(text[many] * BUCKETS + (hashed[many] + 64 + share) % BUCKETS)
    found = np.sort(np.concatenate(keys))
    found = found[np.diff(found, prepend=-1) > 0]
    ends = np.searchsorted(found, np.arange(len(texts) + 1) * BUCKETS)
    return (found % BUCKETS).astype(np.int32), ends


def terms(text: str | None) -> np.ndarray:
    return term_sets([text])[0]


def _grouped(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The term sets of a batch, some texts at a time."""
    group, held = [], 0
    for text in texts:
        text = text.as_py()
        if group and held + len(text or "") > _GROUP_CHARS:
            yield term_sets(group)
            group, held = [], 0
        group.append(text)
        held += len(text or "")
    if group:
        yield term_sets(group)


def _constant(share: float) -> Machine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    empty, zero = np.zeros((BUCKETS, FACTORS), np.float32), np.zeros(BUCKETS, np.float32)
    return Machine(float(np.log(share / (1 - share))), zero, empty, zero)


@dataclass
class Seeds:
    """For every term of a telling pair its best partner, best pairs first.

    ``sign`` is 1 if the two are more toxic together and -1 if they are less.
    """

    term: np.ndarray
    partner: np.ndarray
    sign: np.ndarray


def start_factors(seeds: Seeds, rng: np.random.Generator) -> np.ndarray:
    """Factors of all buckets from which the terms of telling pairs are fitted.

    Linked pairs share a column; columns are dealt in turn to pairs that are not linked.
    """
    start = rng.normal(0, 0.01, (BUCKETS, FACTORS))
    column = np.full(BUCKETS, -1)
    used = 0
    for term, partner, sign in zip(seeds.term, seeds.partner, seeds.sign, strict=True):
        if column[term] < 0 and column[partner] < 0:
            column[term] = used % FACTORS
            start[term, column[term]] = 1
            used += 1
        for one, other in ((term, partner), (partner, term)):
            if column[other] < 0:
                column[other] = column[one]
                start[other, column[one]] = sign * np.sign(start[one, column[one]])
        if column[term] != column[partner] and abs(start[term, column[partner]]) < 0.5:
            start[term, column[partner]] = sign * np.sign(start[partner, column[partner]])
    return start


def _flat(
    texts: list[np.ndarray], kept: np.ndarray, number: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the kept terms of every text in one array, and where each text's end.

    Small arrays that live as long as the whole would leave the driver's heap in pieces
    that are never given back.
    """
    sizes = [np.count_nonzero(kept[t]) for t in texts]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(ends[-1], number.dtype)
    for i, own in enumerate(texts):
        flat[ends[i] : ends[i + 1]] = number[own[kept[own]]]
    return flat, ends


def fit(texts: list[np.ndarray], labels: np.ndarray, seeds: Seeds | None = None) -> Machine:
    """A machine from term sets and 0/1 labels, by AdaGrad with an L1 step on weights.

    Fitted are terms that tell something alone and the terms of ``seeds``, whose factors
    start there. The L1 step keeps terms that say nothing at a weight of exactly 0, so a
    long harmless text does not add up small errors. With labels of one kind only the
    score is constant.
    """
    if not len(texts) or labels.min() == labels.max():
        return _constant(float(labels.mean()) if len(texts) else 0.0)
    share = float(labels.mean())
    machine = _constant(0.5)
    texts_with, marked = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for kind, total in ((labels >= 0, texts_with), (labels > 0, marked)):
        chosen = np.flatnonzero(kind)
        for first in range(0, len(chosen), BATCH):
            some = np.concatenate([texts[i] for i in chosen[first : first + BATCH]])
            total += np.bincount(some, minlength=BUCKETS)
    spread = np.sqrt(np.maximum(texts_with, 1) * share * (1 - share))
    seen = (texts_with >= MIN_TEXTS) & (np.abs(marked - texts_with * share) >= MIN_Z * spread)
    if seeds is not None:
        seen[seeds.term] = True
    kept = np.flatnonzero(seen)
    number = np.zeros(BUCKETS, np.int32)
    number[kept] = np.arange(len(kept))
    flat, ends = _flat(texts, seen, number)
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))
    if seeds is not None:
        v = start_factors(seeds, rng)[kept]
        squares = (v**2).sum(1)
        added = np.zeros(len(texts))
        for i in range(len(texts)):
            own = flat[ends[i] : ends[i + 1]]
            added[i] = 0.5 * abs((v[own].sum(0) ** 2).sum() - squares[own].sum())
        if (added > 0.5).any():
            # A word's beginnings come together, so their products add up.
            v *= (PAIR_START / np.median(added[added > 0.5])) ** 0.5
    gw, gv, bias, gb = np.full(len(kept), 1e-2), np.full(v.shape, 1e-2), float(np.log(share / (1 - share))), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            spans = [flat[ends[i] : ends[i + 1]] for i in batch]
            index = np.concatenate(spans)
            doc = np.repeat(np.arange(len(batch)), [len(s) for s in spans])
            picked = v[index]
            sums = np.stack(
                [np.bincount(doc, picked[:, f], len(batch)) for f in range(FACTORS)], 1
            )
            square = np.bincount(doc, (picked**2).sum(1), len(batch))
            raw = bias + np.bincount(doc, w[index], len(batch))
            raw += 0.5 * ((sums**2).sum(1) - square)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]
            pull = error[doc]
            used, local = np.unique(index, return_inverse=True)
            grad = np.bincount(local, pull) / len(batch)
            gw[used] += grad**2
            rate = RATE / np.sqrt(gw[used])
            moved = w[used] - rate * grad
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
            push = pull[:, None] * (sums[doc] - picked)
            for f in range(FACTORS):
                slope = np.bincount(local, push[:, f]) / len(batch) + L2 * v[used, f]
                gv[used, f] += slope**2
                v[used, f] -= 0.5 * RATE * slope / np.sqrt(gv[used, f])
            slope = float(error.mean())
            gb += slope**2
            bias -= RATE * slope / gb**0.5
    machine.bias = bias
    machine.weights[kept] = w
    machine.factors[kept] = v
    machine.squares = (machine.factors**2).sum(1)
    return machine


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _terms(texts: pa.Array) -> pa.Array:
    found = [np.split(flat, ends[1:-1]) for flat, ends in _grouped(texts)]
    return pa.array(list(itertools.chain.from_iterable(found)), pa.list_(pa.int32()))


def least_gain(terms: int) -> float:
    """Gain from which a pair counts, if all pairs of so many terms are looked at.

    The gain of a pair is its texts times the divergence of its share of toxic texts from
    the expected one; chance exceeds it with a probability of at most ``exp(-gain)``.
    """
    return math.log(max(terms * (terms - 1) / 2, 1) / PAIR_ERRORS)


def _wanted_terms(sample: DataFrame) -> tuple[Broadcast, np.ndarray]:
    """Buckets that reach the driver, and of these the ones whose pairs are counted.

    Wanted are buckets that pass ``MIN_TEXTS`` and ``MIN_Z``, and those in enough toxic
    or clean texts for a pair whose terms tell nothing alone to have the least gain.
    """
    spark = sample.sparkSession
    whole = sample.agg(F.avg("toxic").alias("share"), F.count("*").alias("n")).first()
    mask, paired = np.zeros(BUCKETS, bool), np.empty(0, np.int64)
    if whole["n"] and 0 < whole["share"] < 1:
        share = whole["share"]
        counts = (
            sample.select("toxic", F.explode("terms").alias("term"))
            .groupBy("term")
            .agg(F.count("*").alias("texts"), F.sum("toxic").alias("marked"))
            .filter(F.col("texts") >= MIN_TEXTS)
        )
        found = counts.toArrow()
        term, texts, marked = (found[c].to_numpy() for c in ("term", "texts", "marked"))
        spread = np.sqrt(texts * share * (1 - share))
        mask[term[np.abs(marked - texts * share) >= MIN_Z * spread * (1 - 1e-9)]] = True
        # The least gain falls with the number of terms, which falls with the least gain.
        enough = np.ones(len(term), bool)
        for _ in range(20):
            gain = least_gain(int(enough.sum())) * (1 - 1e-9)
            now = (marked * -math.log(share) >= gain) | ((texts - marked) * -math.log1p(-share) >= gain)
            if (now == enough).all():
                break
            enough = now
        paired = np.sort(term[enough])
        mask[paired] = True
    return spark.sparkContext.broadcast(mask), paired


def _gain(texts: np.ndarray, marked: np.ndarray, expected: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        clean = texts - marked
        gain = np.where(marked > 0, marked * np.log(marked / (texts * expected)), 0)
        return gain + np.where(clean > 0, clean * np.log(clean / (texts * (1 - expected))), 0)


def _count_pairs(
    part: int,
    parts: int,
    flat: np.ndarray,
    ends: np.ndarray,
    labels: np.ndarray,
    scores: np.ndarray,
    terms: int,
) -> tuple[np.ndarray, ...]:
    """Of the pairs that count, of every ``parts``-th first term: each term's best partner.

    The columns are ``term, partner, sign, gain``.

    ``flat`` has the terms of all texts, numbered from 0 and in order in every text. What
    two terms give by themselves lies between the share of the one that tells more, which
    holds for terms that say the same, and both their odds multiplied. The mean score of
    the texts with both may differ; a pair's share has to lie beyond all three.
    """
    share, least = float(labels.mean()), least_gain(terms)
    # Half the bytes of numpy's own choice: a task holds several numbers for each term.
    owner = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(ends))
    order = np.argsort(flat, kind="stable").astype(np.int32)
    texts = np.bincount(flat, minlength=terms)
    shares = (np.bincount(flat, labels[owner], terms) + share) / (texts + 1)
    odds, base = shares / (1 - shares), share / (1 - share)
    strength = np.abs(np.log(odds / base))
    starts = np.concatenate([[0], np.cumsum(texts)])
    found, held = [], 0
    for one in range(part, terms, parts):
        places = order[starts[one] : starts[one + 1]]
        both, marked = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        lengths = ends[owner[places] + 1] - places - 1
        toxic = labels[owner[places]] > 0
        for total, chosen in ((marked, toxic), (both, ~toxic)):
            own, size = places[chosen], lengths[chosen]
            block = np.cumsum(size) // PAIR_TERMS
            for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(block)) + 1):
                if len(cut):
                    rest = np.concatenate([flat[own[i] + 1 : own[i] + 1 + size[i]] for i in cut])
                    total += np.bincount(rest, minlength=terms)
        both += marked
        second = np.flatnonzero(both >= MIN_TEXTS)
        n, m = both[second], marked[second]
        product = odds[one] * odds[second] / base
        product = product / (1 + product)
        single = np.where(strength[second] > strength[one], shares[second], shares[one])
        low, high = np.minimum(product, single), np.maximum(product, single)
        nearest = np.clip(m / n, low, high)
        # The divergence is at most chi squared, which is cheaper.
        far = (m - n * nearest) ** 2 >= least * n * nearest * (1 - nearest)
        far = np.flatnonzero(far & ((m < n * low) | (m > n * high)))
        far = far[_gain(n[far], m[far], nearest[far]) >= least]
        if not len(far):
            continue
        n, m, second = n[far], m[far], second[far]
        given = np.zeros(len(labels))
        given[owner[places]] = scores[owner[places]]
        mean = [given[owner[order[starts[i] : starts[i + 1]]]].sum() for i in second] / n
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        low, high = np.minimum(low[far], mean), np.maximum(high[far], mean)
        gain = _gain(n, m, np.clip(m / n, low, high))
        good = gain >= least
        second, gain, sign = second[good], gain[good], np.where(m > n * mean, 1, -1)[good]
        found.append((np.full(len(second), one), second, sign, gain))
        found.append((second, np.full(len(second), one), sign, gain))
        held += 2 * len(second)
        if held > PAIR_TERMS:
            found = [_best_partners(found)]
            held = len(found[0][0])
    return _best_partners(found)


def _best_partners(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row per term: the partner of the greatest gain, of equal ones the least."""
    if not found:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, float))
    term, partner, sign, gain = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((partner, -gain, term))
    best = order[np.flatnonzero(np.diff(term[order], prepend=-1))]
    return term[best], partner[best], sign[best], gain[best]


def telling_pairs(
    spark: SparkSession,
    texts: list[np.ndarray],
    labels: np.ndarray,
    scores: np.ndarray,
    paired: np.ndarray,
) -> Seeds | None:
    """Pairs of the terms ``paired`` that tell what terms and ``scores`` do not, by tasks.

    Every term of such a pair has one row, so what reaches the driver is bounded by the
    number of terms.
    """
    if len(paired) < 2:
        return None
    place = np.full(BUCKETS, -1, np.int32)
    place[paired] = np.arange(len(paired))
    kind = np.uint16 if len(paired) <= 1 << 16 else np.int32
    flat, ends = _flat(texts, place >= 0, place.astype(kind))
    sent = spark.sparkContext.broadcast((flat, ends, labels, scores))
    del flat
    terms = len(paired)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch["id"].to_pylist():
                columns = _count_pairs(part, PAIR_TASKS, *sent.value, terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["term", "partner", "sign", "gain"]
                )

    parts = spark.range(0, PAIR_TASKS, 1, PAIR_TASKS)
    counted = parts.mapInArrow(count, "term long, partner long, sign long, gain double")
    rows = counted.toArrow()
    sent.destroy()
    best = _best_partners([tuple(rows[c].to_numpy() for c in rows.column_names)])
    if not len(best[0]):
        return None
    order = np.lexsort((best[0], -best[3]))
    term, partner, sign = (column[order] for column in best[:3])
    return Seeds(paired[term], paired[partner], sign)


def _collected(learned: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Term sets and labels of ``toxic, terms``, in one copy and apart from Arrow's memory."""
    rows = learned.select("toxic", "terms").toArrow()
    marks = rows["toxic"].to_numpy().astype(float)
    parts = rows["terms"].chunks
    sizes = [np.diff(part.offsets.to_numpy()) for part in parts]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, int), *sizes]))]).astype(int)
    values = np.concatenate([np.empty(0, np.int32), *(part.flatten().to_numpy() for part in parts)])
    del rows, parts
    # Arrow keeps what it has freed until it is used again, for as long as the driver runs.
    pa.default_memory_pool().release_unused()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)], marks


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fit on labelled rows that are not held out: ``labels`` has ``doc_id, toxic``.

    Null labels are skipped and a document labelled twice has the greater label.
    ``sample_rows`` bounds the rows that are learned from; of these only the terms that
    tell something, alone or perhaps in a pair, reach the driver. Of several texts with
    one id one is learned from.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = stored(
        texts.join(F.broadcast(known), "doc_id")
        .select("doc_id", "toxic", _terms("text").alias("terms"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")),
        "sample",
    )
    wanted, paired = _wanted_terms(sample)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def only_wanted(rows: pa.Array) -> pa.Array:
        kept = [np.asarray(r.values)[wanted.value[np.asarray(r.values)]] for r in rows]
        return pa.array(kept, pa.list_(pa.int32()))

    learned = sample.select("doc_id", "toxic", only_wanted("terms").alias("terms"))
    split, marks = _collected(learned.orderBy(F.xxhash64("doc_id"), "doc_id"))
    machine = fit(split, marks)
    scores = np.array([machine.score(own) for own in split])
    seeds = telling_pairs(docs.sparkSession, split, marks, scores, paired)
    return machine if seeds is None else fit(split, marks, seeds)


def score(docs: DataFrame, machine: Machine, text: Column) -> Column:
    """Score of a text, from 0 to 1; a null text is an empty one and gets the bias' score."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in batches:
            found = [own.scores(flat, ends) for flat, ends in _grouped(batch)]
            yield pa.array(np.concatenate([*found, np.empty(0)]), pa.float64())

    return scores(text)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Defined results: null and empty texts get the score of a text without terms; equal
    texts get equal scores; a null id is not held out; without labels every score is
    close to 0; an empty table gives no rows; other columns are ignored.
    """
    machine = learn(docs, labels, id_col, text_col, sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score(docs, machine, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
