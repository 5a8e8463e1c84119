"""Mixing sources to target shares of a token budget.

Sampling is Efraimidis-Spirakis: a document of weight w draws the key -ln(u) / w and documents are taken in the order of
their keys. Tokens are summed in that order up to the budget of the source. A source whose budget exceeds what it holds
is first taken whole, up to ``max_repeats`` times, and only the rest is sampled.

The running sum of a source is found without sorting the source in one task: keys are put into bins that sort like them
(the highest bits of the order-preserving integer), the tokens of the bins are summed before anything is ordered, and
only the bin that crosses the budget is looked into, bit by bit, with the next digit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stallmark.llm.percentiles import order_key
from stallmark.session import cut

#: Vocabulary file of a public tokenizer where the session sets no stallmark.tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DIGITS = (48, 34, 20, 0)
#: Texts and characters encoded at once: what an encoding holds besides its ids is many times the text.
SLICE_TEXTS, SLICE_CHARS = 128, 500_000


#: Fixed value: how the byte-level tokenizers of .tiktoken files split a text before they merge.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts; special tokens written in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        e = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    return lambda texts: [len(e) for part in _slices(texts) for e in encode(part, add_special_tokens=False)]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most SLICE_TEXTS texts and SLICE_CHARS characters, a longer text alone."""
    part: list[str] = []
    chars = 0
    for t in texts:
        if part and (len(part) >= SLICE_TEXTS or chars + len(t) > SLICE_CHARS):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


def count_tokens(df: DataFrame, text: str, path: str | None = None, out: str = "tokens") -> DataFrame:
    """Add the number of tokens of a text column under a public tokenizer; null and empty texts have none.

    The vocabulary file is ``path``, else what the session sets as stallmark.tokenizer, else TOKENIZER.
    """
    file = path or df.sparkSession.conf.get("stallmark.tokenizer", TOKENIZER)

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        count = _counter(file)
        for s in batches:
            yield pd.Series(count(s.fillna("").tolist()), index=s.index, dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))


def quality(text: Column) -> Column:
    """Weight in (0, 1]: the share of letters and the variety of words, from built-in expressions only."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(t), r"\s+")
    variety = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{M}]", "")) / F.greatest(F.length(t), F.lit(1))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), variety * letters * 1.25))


def sampling_key(ident: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / w with u in (0, 1) drawn from the identifier and the seed."""
    u = (F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return -F.log(u) / weight


def mix(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", seed: int = 7, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Selection and report.

    ``docs`` has the identifier, the source, ``tokens`` and ``weight``; ``targets`` has ``source``, ``target_share`` and
    ``max_repeats`` and is one row a source (checked to be at most 10,000 rows, so it may be broadcast). ``budget`` is the
    total number of tokens wanted, by default all tokens of the sources with a target. Documents of sources without a
    target are left out, a source without documents is reported with 0. Documents without tokens are never sampled.

    Selection: identifier, source, tokens, ``repeats`` (at least 1). The sampled part of a source is the longest run of
    documents in key order that stays within the budget, so a source falls short by less than one document.
    Report: source, target_share, max_repeats, available, wanted, reached, reached_share, shortfall.
    """
    n = targets.count()
    if n > 10_000:
        raise ValueError("targets must be one row a source, 10,000 at most")
    tg = targets.select(F.col("source").alias("_source"), "target_share", "max_repeats").filter(F.col("_source").isNotNull())
    d = docs.select(F.col(ident).alias("_id"), F.col(source).alias("_source"), "tokens", "weight").filter(F.col("tokens") > 0)
    d = d.join(F.broadcast(tg.select("_source")), "_source", "left_semi")
    d = cut(d.select("_id", "_source", "tokens", order_key(sampling_key(F.col("_id"), F.col("weight"), seed)).alias("key")))
    held = d.groupBy("_source").agg(F.sum("tokens").alias("available"))
    plan = tg.join(F.broadcast(held), "_source", "left").fillna(0, ["available"])
    plan = cut(plan)  # one row a source
    total = budget if budget is not None else (plan.agg(F.sum("available")).first()[0] or 0)
    plan = (
        plan.withColumn("wanted", F.floor(F.col("target_share") * F.lit(total)).cast("bigint"))
        .withColumn("epochs", F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("bigint"), F.expr("wanted div available"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.when((F.col("available") > 0) & (F.col("epochs") < F.col("max_repeats")), F.col("wanted") - F.col("epochs") * F.col("available")).otherwise(F.lit(0)))
    )
    # the cut of each source, found digit by digit: everything below the prefix is taken, what is under it is looked into
    edge = plan.select("_source", F.lit(0).cast("bigint").alias("prefix"), F.col("rest").alias("room"))
    at = 64
    for shift in DIGITS:
        e = F.broadcast(edge.select("_source", "prefix", "room"))
        inside = d.join(e, "_source").filter(F.shiftright("key", at) == F.col("prefix")) if at < 64 else d.join(e, "_source")
        digit = F.shiftright("key", shift) if shift else F.col("key")
        hist = inside.groupBy("_source", digit.alias("prefix")).agg(F.sum("tokens").alias("t"), F.max("room").alias("room"))
        hist = hist.withColumn("before", F.expr("sum(t) over (partition by _source order by prefix) - t"))
        # the first digit that does not fit whole; none if all fit
        crossing = hist.filter(F.col("before") + F.col("t") > F.col("room"))
        edge = cut(crossing.groupBy("_source").agg(F.min_by(F.struct("prefix", (F.col("room") - F.col("before")).alias("room")), "prefix").alias("x")).select("_source", "x.*"))
        at = shift
    limit = edge.select("_source", F.col("prefix").alias("edge"))
    rest = plan.select("_source", "epochs", "rest").join(F.broadcast(limit), "_source", "left")
    chosen = (
        d.join(F.broadcast(rest), "_source")
        .withColumn("repeats", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("key") < F.col("edge"))), 1).otherwise(0))
        .filter(F.col("repeats") > 0)
    )
    got = chosen.groupBy("_source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"))
    report = plan.join(F.broadcast(got), "_source", "left").fillna(0, ["reached"])
    sum_all = F.sum("reached").over(Window.partitionBy(F.lit(1)))  # one row a source
    report = report.select(
        F.col("_source").alias("source"), "target_share", "max_repeats", "available", "wanted", "reached",
        F.when(sum_all > 0, F.col("reached") / sum_all).otherwise(F.lit(0.0)).alias("reached_share"), (F.col("wanted") - F.col("reached")).alias("shortfall"),
    )
    return chosen.select(F.col("_id").alias(ident), F.col("_source").alias(source), "tokens", F.col("repeats").cast("bigint").alias("repeats")), report
