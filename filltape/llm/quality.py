"""Quality rules: counts that need no model, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: one counted over
trusted documents, one over the whole corpus. A document's score is the mean of
``log p_trusted - log p_corpus`` over its n-grams, so long documents are not favoured;
documents below a fixed threshold are rejected, always the same ones.

Both distributions have ``BUCKETS`` cells whatever the size of the corpus. Corpus counts
cover every document. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape.llm.common import SPACE_CHARS, let, words

BUCKETS = 1 << 14
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.1
#: Trusted documents that the target distribution is counted over, at most.
TRUSTED_ROWS = 20_000
#: Counts a bucket, on average, that the trusted distribution borrows from the corpus'. With
#: few trusted documents this pulls ratios towards 0, which keeps documents.
SMOOTHING = 4.0


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(
            F.split(text, "\n"), lambda line: F.length(_without(line, SPACE_CHARS)) > 0
        ),
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
    ).cast("long")


def joined(hashes: Column, step: int) -> Column:
    """Every hash combined with the one ``step`` places on; the last ``step`` have no partner."""
    return let(
        hashes,
        lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)),
    )


def _complete(hashes: Column, width: int) -> Column:
    """Without the last ``width - 1`` places, where no window of ``width`` starts."""
    return let(hashes, lambda h: F.slice(h, 1, F.greatest(F.size(h) - width + 1, F.lit(0))))


def _windows(pairs: Column, width: int) -> Column:
    """A hash of every window of ``width`` words, in order, given ``joined(hashes, 1)``.

    Windows of twice the width come from two of half of it, so a word is hashed
    ``log2(width)`` times and not ``width`` times. The two may overlap.
    """
    spans, span = pairs, 2
    while span < width:
        step = min(span, width - span)
        spans, span = joined(spans, step), span + step
    return _complete(spans, width)


def repeated_words(windows: Column, width: int) -> Column:
    """Words inside windows that occur at least twice, given the windows' hashes.

    Sorting hashes with their places brings equal windows together; the places are then
    sorted and each covers up to the next one. Texts without a repeat skip all that.
    """
    no_repeat = F.size(windows) == F.size(F.array_distinct(windows))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, i: F.coalesce(F.least(F.lit(width), F.get(places, i + 1) - p), F.lit(width)),
        )
        # ``least`` skips a null, so the last place counts in full.
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    def places(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda e, i: F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["h"] == e["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(twice, lambda e: e["p"])), covered)

    ordered = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    )
    return F.when(no_repeat, 0).otherwise(let(ordered, places)).cast("long")


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` (never null), the hashes of its words in order, the input as ``row``."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.transform(words(F.col(text_col)), lambda word: F.xxhash64(word)).alias("hashes"),
        F.struct(*(docs[name] for name in docs.columns)).alias("row"),
    )


def ngrams(hashes: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and word pairs of a text, given ``joined(hashes, 1)`` as ``pairs``."""

    def bucket(hash_: Column) -> Column:
        return F.pmod(hash_, F.lit(buckets)).cast("int")

    return F.concat(F.transform(hashes, bucket), F.transform(_complete(pairs, 2), bucket))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good; of more than ``rows``, those with the least hash."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """One row with ``ratios``, a log ratio per bucket, from ``hashed`` documents.

    ``trusted`` has at most ``TRUSTED_ROWS`` ids and is therefore broadcast. Every count
    is combined on the map side, so a frequent n-gram is one row per task. The trusted
    share of a bucket is smoothed towards its share of the corpus, so without any trusted
    n-gram all ratios are 0.
    """
    marked = docs.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    grams = let(F.col("hashes"), lambda h: ngrams(h, joined(h, 1), buckets))
    # Computed below the explode, which Spark can then compile together with the counting.
    counts = (
        marked.select("good", grams.alias("grams"))
        .select("good", F.explode("grams").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    seen = every.join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    cells = seen.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"),
        F.sum("raw").alias("raw"),
        F.sum("target").alias("target"),
    )

    borrowed = F.lit(smoothing * buckets)

    def ratio(cell: Column) -> Column:
        corpus_share = F.greatest(cell["raw"], F.lit(1)) / F.greatest(F.col("raw"), F.lit(1))
        return F.log((cell["target"] / corpus_share + borrowed) / (F.col("target") + borrowed))

    return cells.select(F.transform("cells", ratio).alias("ratios"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``llr``, ``kept``, its input as ``row``.

    ``labels`` has ``doc_id`` and ``quality`` (1 is trusted). Defined results: a null text
    is empty; an empty text has an ``llr`` of 0 and fails for its number of words; without
    trusted documents every ratio is 0 and only the base rules decide; repeated rows and
    null ids are judged one by one; an empty table gives no rows; other columns only appear inside ``row``.
    """
    rows = hashed(docs, id_col, text_col)
    ratios = log_ratios(rows, trusted_ids(labels, trusted_rows))
    text = F.col("text")

    def ratio(grams: Column) -> Column:
        total = F.aggregate(
            grams, F.lit(0.0), lambda sum_, bucket: sum_ + F.get(F.col("ratios"), bucket)
        )
        return F.when(F.size(grams) == 0, 0.0).otherwise(total / F.size(grams))

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (
            100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]
        )
        fields = [m[name].alias(name) for name in ("n_words", "n_repeat_words", "llr")]
        kept = ~failed & (m["llr"] >= threshold)
        return F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"))

    # One expression from the words to the verdict: a filter on the verdict that moves
    # below the projections takes one copy of it along, and not one per use of a part.
    def measures(h: Column, pairs: Column) -> Column:
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            let(_windows(pairs, WINDOW), lambda w: repeated_words(w, WINDOW)).alias(
                "n_repeat_words"
            ),
            let(ngrams(h, pairs), ratio).alias("llr"),
        )

    measured = let(
        F.col("hashes"),
        lambda h: let(joined(h, 1), lambda pairs: let(measures(h, pairs), judged)),
    )
    counted = rows.withColumn("ratios", ratios.scalar()).select(
        "doc_id",
        F.length(_without(text, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        measured.alias("measured"),
        "row",
    )
    return counted.select(
        "doc_id",
        "measured.n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "measured.n_repeat_words",
        "measured.llr",
        "measured.base_failed",
        "measured.kept",
        "row",
    )
