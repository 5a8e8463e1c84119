"""Text operators: n-grams, TF-IDF, exact reuse, set-similarity join, shared phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallmark.operators.skew import find_hot, join_with_hot
from stallmark.session import cut

#: Words that make no phrase of their own.
STOPWORDS = [
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "with", "by", "of", "from", "as", "is", "are", "was", "were", "it", "this", "that", "all",
    "available", "very", "also", "have", "has", "had", "just", "my", "me", "we", "you", "your", "only", "be", "so", "if", "out", "up", "about", "into", "over",
    "after", "than", "no", "not", "any", "some", "can", "will", "do", "does",
]
MIN_DF, MIN_DOCS, TOP_TERMS = 3, 10, 15
#: Sets with one word in a block from which comparing all with all is split over tasks.
HOT_WORD = 1_000


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; each longer run adds one token to a shorter one."""
    g = tokens
    for k in range(2, n + 1):
        left = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
        g = F.zip_with(F.slice(g, F.lit(1), left), F.slice(tokens, F.lit(k), left), lambda a, b: F.concat(a, F.lit(" "), b))
    return g


def ngram_frequencies(docs: DataFrame, ident: str, tokens: str, sizes: tuple[int, ...] = (1, 2, 3), least_df: int = 2) -> DataFrame:
    """Term and document frequency of n-grams that are not made of stop words only. ``docs`` has one row a document.

    The phrases of a document are sorted in its row and those that stand first in their run carry the document, so one
    shuffle, combined on the map side, counts both.
    """
    t, stop = F.col(tokens), F.array(*map(F.lit, STOPWORDS))

    def sized(n: int) -> Column:
        grams = F.transform(ngrams(t, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("phrase")))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<struct<n:int,phrase:string>>"))

    rows = docs.select(F.explode(F.array(F.array_sort(F.flatten(F.array(*map(sized, sizes)))))).alias("every"))
    marked = F.transform("every", lambda g, i: F.struct(g["n"].alias("n"), g["phrase"].alias("phrase"), F.when(F.get("every", i - 1) == g, 0).otherwise(1).alias("first")))
    rows = rows.select(F.explode(marked).alias("g")).select("g.*")
    rows = rows.filter(F.exists(F.split("phrase", " "), lambda w: ~F.array_contains(stop, w)))
    return rows.groupBy("n", "phrase").agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df")).filter(F.col("df") >= least_df)


def tfidf(docs: DataFrame, group: str, ident: str, tokens: str, top: int = TOP_TERMS) -> DataFrame:
    """Top terms per group: tf = share of all kept tokens of the group, idf = ln((1 + N) / (1 + df)) + 1 over all documents.

    Groups of fewer than MIN_DOCS documents and terms of fewer than MIN_DF documents do not come out; the tokens of such
    terms still count in the total. Rows with a null group form no group but count in N and df.
    """
    stop = F.array(*map(F.lit, STOPWORDS))
    size = docs.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("group_docs")).filter(F.col("group_docs") >= MIN_DOCS)
    w = docs.select(group, F.col(ident).alias("_id"), F.explode(tokens).alias("term"))
    w = w.filter(~F.array_contains(stop, F.col("term")) & (F.length("term") > 1) & ~F.col("term").rlike(r"^\d+$"))
    per = w.groupBy(group, "_id", "term").agg(F.count(F.lit(1)).alias("c"))
    t = per.groupBy(group, "term").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("held"))
    df = t.groupBy("term").agg(F.sum("held").alias("df")).filter(F.col("df") >= MIN_DF)
    total = t.groupBy(group).agg(F.sum("c").alias("total"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    s = t.join(df, "term").join(total, group).join(size, group).join(F.broadcast(n))
    s = s.withColumn("tfidf", F.round(F.col("c") / F.col("total") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1), 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("tfidf"), "term"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.col(group).alias("group_value"), "rank", "term", F.col("c").alias("tf"), "df", "tfidf")


def exact_reuse(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """One row a document whose text others have too: the smallest id of the text and the number of copies."""
    d = docs.filter(F.length(text) > 0)
    first = d.groupBy(F.md5(F.col(text)).alias("text_hash")).agg(F.min(ident).alias("class_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return d.select(F.col(ident).alias("id"), F.md5(F.col(text)).alias("text_hash")).join(first, "text_hash").select("id", "class_id", "copies", "text_hash")


def _word_sets(docs: DataFrame, ident: str, words: str, block: str | None, least: int) -> DataFrame:
    d = docs.select(F.col(ident).alias("id"), (F.col(block) if block else F.lit("")).alias("block"), F.array_sort(F.array_distinct(words)).alias("w"))
    return d.filter(F.size("w") >= least)


def jaccard_classes(docs: DataFrame, ident: str, words: str, block: str | None, pairs: DataFrame, least: int = 3) -> DataFrame:
    """``id``, ``block``, ``class_id``, ``copies``, ``links`` of every document with ``least`` words.

    ``class_id`` is the smallest id with the same words in the block, by which ``pairs`` of ``jaccard_pairs`` name the
    class; ``links`` counts the other documents that reach the threshold, copies included.
    """
    d = cut(_word_sets(docs, ident, words, block, least))
    reps = cut(d.groupBy("block", "w").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    size = reps.select("block", F.col("class_id").alias("other"), "copies")
    both = pairs.select("block", F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("p")).select("block", "p.*")
    far = both.join(size.hint("merge"), ["block", "other"]).groupBy("block", "class_id").agg(F.sum("copies").alias("far"))
    reps = reps.hint("merge").join(far, ["block", "class_id"], "left").select(F.col("block").alias("of"), F.col("w").alias("v"), "class_id", "copies", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return d.hint("merge").join(reps, F.col("block").eqNullSafe(F.col("of")) & (F.col("w") == F.col("v"))).select("id", "block", "class_id", "copies", "links")


def jaccard_pairs(docs: DataFrame, ident: str, words: str, block: str | None, threshold: float, least: int = 3) -> DataFrame:
    """All pairs of different word sets with Jaccard >= threshold inside a block; equal sets are one class.

    Exact prefix-filter join: words are ordered from rare to frequent; two sets that reach the threshold share one of
    their first |x| - ceil(t |x|) + 1 words; pairs are length-filtered before the sets are compared. Rows come out per
    class representative (``a`` < ``b``); ``jaccard_classes`` has the members. No join is broadcast: Catalyst takes sets and
    words for smaller than they are, since it knows neither how far an array is exploded nor how well a file is packed.
    """
    d = _word_sets(docs, ident, words, block, least)
    reps = cut(d.groupBy("block", "w").agg(F.min("id").alias("id")))
    held = reps.filter(F.col("block").isNotNull()).select("block", "id", F.size("w").alias("n"), F.explode("w").alias("t"))
    held = held.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("block", "t")))
    bit = F.pmod(F.xxhash64("t"), F.lit(128)).cast("int")
    lo, hi = (F.bit_xor(F.when(F.shiftright(bit, 6) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("bigint"))) for k in (0, 1))
    ranked = held.groupBy("block", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("w"), lo.alias("lo"), hi.alias("hi"))  # the words of a row
    first = F.slice("w.t", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))
    pre = cut(ranked.select("block", "id", "n", "lo", "hi", F.posexplode(first).alias("at", "t")))
    a, b = (pre.select("block", "t", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "lo", "hi", "at")]) for s in "ab")
    met = join_with_hot(a, b, ["block", "t"], find_hot(pre, ["block", "t"], pre.count(), floor=HOT_WORD), F.col("id_a"), strategy="merge")
    both = F.col("n_a") + F.col("n_b")
    near = (F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))
    # the first word two sets share leaves room for enough more: what follows it in the shorter rest bounds the overlap
    near = near & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= F.lit(threshold / (1 + threshold)) * both - 1e-9)
    # each word flips one bit, so sketches differ in no more bits than the sets differ in words
    apart = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
    near = near & (apart <= F.lit((1 - threshold) / (1 + threshold)) * both + 1e-9)
    cand = met.filter(near).select("block", F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    x = reps.select("block", F.col("id").alias("a"), F.col("w").alias("wa")).hint("merge")
    y = reps.select("block", F.col("id").alias("b"), F.col("w").alias("wb")).hint("merge")
    s = F.size(F.array_intersect("wa", "wb"))
    return cand.join(x, ["block", "a"]).join(y, ["block", "b"]).select("block", "a", "b", (s / (F.size("wa") + F.size("wb") - s)).alias("j")).filter(F.col("j") >= threshold - 1e-12).select("block", "a", "b", F.round("j", 6).alias("jaccard"))


def shared_phrases(docs: DataFrame, ident: str, tokens: str, low: int = 2, high: int = 30) -> DataFrame:
    """Pairs of documents that share a 3- to 5-gram of at least 12 characters held by 2 to 30 documents.

    The band of the posting list is part of the operator's meaning, so a phrase yields at most 435 pairs. The documents of
    a phrase meet in one shuffle, without a join: of each phrase the first ``high`` + 1 rows are looked at, which tell
    whether it lies in the band, and each of its documents is paired with those after it.
    """
    t = F.filter(F.col(tokens), lambda w: F.length(w) >= 2)
    grams = F.flatten(F.array(*[F.when(F.size(t) >= n, ngrams(t, n)).otherwise(F.array().cast("array<string>")) for n in (3, 4, 5)]))
    g = docs.select(F.col(ident).alias("id"), F.explode(F.array_distinct(grams)).alias("phrase")).filter(F.length("phrase") >= 12)
    ordered = Window.partitionBy("phrase").orderBy("id")
    g = g.withColumn("at", F.row_number().over(ordered)).filter(F.col("at") <= high + 1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("df", F.count(F.lit(1)).over(whole)).withColumn("held", F.collect_list("id").over(whole)).filter(F.col("df").between(low, high))
    return g.select(F.col("id").alias("a"), F.explode("held").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("phrases"))
