"""Texts that were cut, found with a backward character n-gram model.

The model looks back from a position of a text over its last 1 to 16 characters and says how likely a text or a line is
to be complete there. It is trained on every position of every distinct text: a position counts as complete if the text
or the line ends there, or a sentence (final mark before a blank and no number), otherwise as continued. Longer contexts
refine shorter ones (interpolation), each first over all sources and then within the source, so that chat lines and prose
are told apart. The end of a value is scored by the log-odds of complete against continued, without its own contribution,
and reported as cut below the threshold of its language, which is fitted: the log-odds of the ends of a language fall into
two heaps, and the threshold lies in the emptiest place between them.

Only contexts with which some value ends are counted. A bit map of these, sent to all tasks, sifts the positions before
anything is shuffled (its false hits cost time, never change a count); a position whose short context is not in the map
is not asked for longer ones. The map grows with the number of ends up to MOST_BITS; beyond that the ends are cut into
parts by their last three characters, each with a map and a pass over the texts of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.llm.sifting import bits_for, build, held
from stallmark.operators.skew import balanced_join
from stallmark.session import cut

ORDERS = (1, 2, 3, 4, 6, 8, 10, 13, 16)
#: Where a threshold may lie, how finely the log-odds are counted, the fewest ends of a language that fit a threshold of
#: its own (fewer take that of all languages), and the threshold where nothing can be fitted.
LOWEST, HIGHEST, STEP = -5.0, 1.5, 0.25
ENOUGH = 200
DEFAULT_THRESHOLD = -0.5
STRENGTH = 1.5
#: Bits of the map a key, and the largest map: 2**27 bits are 16 MB.
EACH_BITS, MOST_BITS = 16, 27

#: Marks that stand for left-out text, at the end of a value.
MARK = r"(?:\s*(?:…|\.{3,}|[\[(<]\s*(?:…|\.{2,}|(?:read |see |show )?more|cut|trunc(?:ated)?|cont(?:inue)?d?\.?)\s*[\])>]|(?:read|see|show) more)[\s.…]*)+$"
FINAL = ".!?।॥。！？"
#: A link is one sign to the model, as a digit is any digit: its words say nothing about where texts end.
LINK, LINK_SIGN = r"(?i)\bhttps?://\S+", "\ue000"

_B = np.uint64(0x100000001B3)


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    digit = (a >= 48) & (a <= 57)
    a[digit] = 48
    return a


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _salt(source: str | None, order: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{order}|{source if source is not None else chr(0)}")


def _end_keys(codes: np.ndarray, source: str | None) -> Iterator[tuple[int, int, int, int]]:
    """Order, kind (0 all sources, 1 this source), key and the hash of the last three characters of the context at the end."""
    pad = np.concatenate([np.full(max(ORDERS), 2, dtype=np.uint64), codes])[::-1]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(ORDERS) - 1, _B)]), dtype=np.uint64)
    sums = np.cumsum(pad[: max(ORDERS)] * powers, dtype=np.uint64)
    third = int(_mixed(sums[2:3], _salt("*", 3))[0])
    for order in ORDERS:
        h = sums[order - 1 : order]
        for kind, salt in ((0, _salt("*", order)), (1, _salt(source, order) ^ 0x5BD1E995)):
            yield order, kind, int(_mixed(h, salt).view(np.int64)[0]), third


def _ends(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for i, text, source in zip(pdf["tid"], pdf["body"], pdf["source"]):
            for order, kind, key, third in _end_keys(_codes(text[-max(ORDERS) :]), source):
                rows.append((i, order, kind, key, 0 if order < 3 else third % parts))
        yield pd.DataFrame(rows, columns=["tid", "ord", "kind", "key", "part"])


def _chunks(pdf: pd.DataFrame, chars: int = 400_000) -> Iterator[tuple[list[str], list[str | None]]]:
    texts, sources, n = [], [], 0
    for t, s in zip(pdf["body"], pdf["source"]):
        texts.append(t)
        sources.append(s)
        n += len(t)
        if n > chars:
            yield texts, sources
            texts, sources, n = [], [], 0
    if texts:
        yield texts, sources


def _train(batches: Iterator[pd.DataFrame], table: np.ndarray, bits: int, part: int, parts: int) -> Iterator[pd.DataFrame]:
    final = np.array([ord(c) for c in FINAL], dtype=np.uint64)
    gap = np.full(max(ORDERS), 2, dtype=np.uint64)
    closing = np.array([10, 2], dtype=np.uint64)

    def merged(some: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, c, n = (np.concatenate(x) for x in zip(*some))
        inv, u = pd.factorize(k)
        return u, np.bincount(inv, weights=c), np.bincount(inv, weights=n)

    def frame(some: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        u, c, n = merged(some)
        return pd.DataFrame({"key": u.view(np.int64), "complete": c.astype(np.int64), "n": n.astype(np.int64)})

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for pdf in batches:
        for texts, sources in _chunks(pdf):
            names = {s: i for i, s in enumerate(dict.fromkeys(sources))}
            line = np.concatenate([x for t in texts for x in (gap, _codes(t), closing)])
            lengths = np.array([len(t) for t in texts])
            begin = np.cumsum(lengths + len(gap) + len(closing)) - lengths - len(closing)
            pos = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            src = np.repeat(np.array([names[s] for s in sources]), lengths)
            after, later = line[pos + 1], line[pos + 2]
            blank = (after == 32) | (after == 160) | (after == 9)
            done = (after == 10) | (after == 13) | (np.isin(line[pos], final) & blank & (later != 48))  # 48 stands for every digit
            h, power, j = np.zeros(len(pos), dtype=np.uint64), np.ones(1, dtype=np.uint64), 0
            for order in ORDERS:
                while j < order:
                    h = h + line[pos - j] * power
                    power = (power * _B).astype(np.uint64)
                    j += 1
                if order < 3 and part:
                    continue  # contexts of one and two characters belong to the first part
                key = _mixed(h, _salt("*", order))
                ok = held(table, bits, key)
                if order == 3 and parts > 1:
                    ok &= key % np.uint64(parts) == part
                if order >= 3 or parts == 1:
                    pos, h, src, done, key = pos[ok], h[ok], src[ok], done[ok], key[ok]
                    here, where, what = h, src, done
                else:
                    here, where, what, key = h[ok], src[ok], done[ok], key[ok]
                salts = np.array([(_salt(s, order) ^ 0x5BD1E995) & (2**64 - 1) for s in names], dtype=np.uint64)
                own = _mixed(here ^ salts[where], 0)
                ok = held(table, bits, own)
                for k, c in ((key, what), (own[ok], what[ok])):
                    if len(k):
                        found.append((k, c.astype(np.float64), np.ones(len(k))))
                        size += len(k)
                if not len(pos):
                    break
            if size > 2_000_000:
                found = [merged(found)]
                if len(found[0][0]) > 700_000:
                    yield frame(found)
                    found = []
                size = 0
    if found:
        yield frame(found)


def score_ends(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """``id``, ``source``, ``lang``, ``marked``, ``log_odds`` for every value that is neither null nor blank.

    A value that is nothing but a mark of a cut has log-odds of -10. Values with a final mark are scored like all others.
    ``most_bits`` bounds the bit map of ends, beyond it there are several passes with the same result.
    """
    d = docs.select(F.col(ident).alias("id"), F.col(text).alias("t"), F.col(source).alias("source"), F.col(lang).alias("lang"))
    d = d.withColumn("bare", F.regexp_replace(F.col("t"), r"(?U)\s+$", "")).filter(F.length("bare") > 0)
    d = d.withColumn("body", F.regexp_replace(F.regexp_replace("bare", "(?i)" + MARK, ""), r"(?U)\s+$", ""))
    d = d.withColumn("marked", F.col("body") != F.col("bare")).withColumn("body", F.regexp_replace("body", LINK, LINK_SIGN))
    d = cut(d.select("id", "source", "lang", "marked", "body", F.xxhash64(F.coalesce("source", F.lit("\0")), F.col("body")).alias("tid")))
    distinct = cut(d.filter(F.length("body") > 0).groupBy("tid").agg(F.first("source").alias("source"), F.first("body").alias("body")))
    keys = 2 * len(ORDERS) * distinct.count()
    bits = bits_for(keys, EACH_BITS, most_bits)
    parts = max(1, 1 << int(np.ceil(np.log2(max(1.0, keys * EACH_BITS / 2**most_bits)))))
    ends = cut(distinct.mapInPandas(lambda b: _ends(b, parts), "tid bigint, ord int, kind int, key bigint, part int"))
    counts = None
    for part in range(parts):
        table = docs.sparkSession.sparkContext.broadcast(build(ends.filter(F.col("part") == part).select("key"), bits))
        some = distinct.select("body", "source").mapInPandas(lambda b, t=table, p=part: _train(b, np.frombuffer(t.value, dtype=np.uint8), bits, p, parts), "key bigint, complete bigint, n bigint")
        counts = some if counts is None else counts.unionByName(some)
    counts = counts.groupBy("key").agg(F.sum("complete").alias("complete"), F.sum("n").alias("n"))
    got = balanced_join(ends.select("tid", "ord", "kind", "key"), counts, ["key"], F.col("tid"))
    step = F.struct("ord", "kind", (F.col("complete") - 1).cast("double").alias("c"), (F.col("n") - 1).cast("double").alias("n"))
    path = got.groupBy("tid").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # 2 * len(ORDERS) entries
    p = F.aggregate("steps", F.lit(0.05), lambda acc, s: (s["c"] + F.lit(STRENGTH) * acc) / (s["n"] + F.lit(STRENGTH)))
    scored = path.select("tid", F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p")).select("tid", F.log(F.col("p") / (1 - F.col("p"))).alias("log_odds"))
    scored = cut(scored)
    out = d.select("id", "tid", "source", "lang", "marked").hint("merge").join(scored, "tid", "left")
    return out.select("id", "source", "lang", "marked", F.coalesce("log_odds", F.lit(-10.0)).alias("log_odds"))


def _valley(counts: dict[int, int]) -> float | None:
    """Middle of the emptiest stretch of a histogram (bins of STEP) between LOWEST and HIGHEST; None for too few values."""
    if sum(counts.values()) < ENOUGH:
        return None
    bins = range(round(LOWEST / STEP), round(HIGHEST / STEP))
    smooth = {b: counts.get(b - 1, 0) + 2 * counts.get(b, 0) + counts.get(b + 1, 0) for b in bins}
    least = min(smooth.values())
    runs, run = [], []
    for b in bins:
        if smooth[b] == least:
            run.append(b)
        elif run:
            runs.append(run)
            run = []
    runs += [run] if run else []
    best = max(runs, key=lambda r: (len(r), r[0]))
    return STEP * (best[0] + best[-1] + 1) / 2


def fit_thresholds(scored: DataFrame) -> tuple[dict[str, float], float]:
    """Threshold a language and the one for all other values, fitted to the log-odds of one column of one table.

    Ends are counted in bins of STEP; at most (languages x 200) counts reach the driver, of the 1,000 most frequent languages.
    """
    near = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("log_odds")))
    per = scored.groupBy("lang", F.floor(near / F.lit(STEP)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    size = per.groupBy("lang").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "lang").limit(1_000).select(F.col("lang").alias("known"))
    hist: dict[str | None, dict[int, int]] = {}
    for r in per.join(F.broadcast(size), F.col("lang").eqNullSafe(F.col("known"))).collect():
        hist.setdefault(r.lang, {})[r.bin] = r.n
    every: dict[int, int] = {}
    for h in hist.values():
        for b, n in h.items():
            every[b] = every.get(b, 0) + n
    default = _valley(every)
    default = DEFAULT_THRESHOLD if default is None else default
    return {k: v for k, h in hist.items() if k is not None and (v := _valley(h)) is not None}, default


def find_cut(scored: DataFrame, thresholds: dict[str, float] | None = None, default: float | None = None) -> DataFrame:
    """Add ``cut``: log-odds below the threshold of the language. Thresholds not given are fitted."""
    if thresholds is None:
        scored = cut(scored)
        thresholds, fitted = fit_thresholds(scored)
        default = fitted if default is None else default
    limit = F.lit(DEFAULT_THRESHOLD if default is None else default)
    for k, v in thresholds.items():
        limit = F.when(F.col("lang") == k, v).otherwise(limit)
    return scored.withColumn("cut", F.col("log_odds") < limit)


def rates(flagged: DataFrame) -> DataFrame:
    """Per source: values, cut values and their rate."""
    return flagged.groupBy("source").agg(F.count(F.lit(1)).alias("values"), F.count_if("cut").alias("cut_values")).withColumn("rate", F.col("cut_values") / F.col("values"))
