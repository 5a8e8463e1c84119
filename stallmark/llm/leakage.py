"""Evaluation items that leaked into a corpus, found by winnowing.

Both sides are brought to plain words (lower case, no markup, punctuation or quote marks). Hashes of k consecutive
words are winnowed: of every window of w consecutive hashes the smallest is kept, which guarantees that a shared run of
w + k - 1 words leaves a common fingerprint. With k = 3 and w = 2 every shared run of 4 words does, and 14 words of
which at most two are touched always hold such a run. Hits are then extended: an alignment along the diagonal of the
hits decides whether at least ``span`` consecutive words of the item occur with at most one word in seven replaced or
with a word put in next to it.

An opening that other items share (an instruction) is cut from the items before anything is counted. Training and test
fingerprints are joined by shuffle; a bit map of the test side sifts the training side first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.llm.sifting import bits_for, build, held
from stallmark.operators.skew import find_hot, join_with_hot
from stallmark.session import cut

K, WINDOW, SPAN, EVERY = 3, 2, 14, 7
#: The bit map that sifts documents has at most 2**28 bits (32 MB); more items than it holds well cost time, not results.
MOST_BITS = 28

_MARKUP = regex.compile(r"</?[A-Za-z!?][^<>]*>|&(?:[a-z]{2,8}|#\d{1,6});|https?://\S+", regex.IGNORECASE)
_SENTENCE = regex.compile(r"(?<=[.!?:])\s+")
_JOIN = regex.compile(r"[­​-‏⁠﻿'’‘`´]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def plain_words(text: str | None) -> list[str]:
    """Words of a text without case, markup, punctuation and spacing; none for null."""
    if not text:
        return []
    return _WORD.findall(_JOIN.sub("", _MARKUP.sub(" ", text.lower())))


class Vocabulary:
    """Stable 64-bit hashes of words, remembered within a task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def winnow(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams of a sequence of word hashes; nothing for fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    g = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        g = (g * _M1) ^ (h[i : i + n] * _M2)
        g ^= g >> np.uint64(31)
    if n <= window:
        at = np.array([int(g.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(g, window)
        at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return at, g[at]


def leaked_span(doc: list[str], item: list[str], hits: list[tuple[int, int]], span: int = SPAN, every: int = EVERY) -> int:
    """Longest run of consecutive item words that the document holds, with at most one edit in ``every`` words.

    ``hits`` are (document position, item position) of common fingerprints. Matches are chained: from a hit to the
    next one along the diagonal, a step may replace one word or step over one inserted word.
    """
    best, done = 0, set()
    for dp, ip in sorted(hits):
        if (dp, ip) in done:
            continue
        # to the left, then to the right, greedily with single edits; an edit needs two matching words behind it
        edits: list[int] = []
        right, d, i = ip, dp, ip
        while i < len(item) and d < len(doc):
            if doc[d] == item[i]:
                done.add((d, i))
                d, i, right = d + 1, i + 1, i + 1
            else:
                step = _edit(doc, item, d, i, 1)
                if step is None:
                    break
                edits.append(i)
                d, i = d + step[0], i + step[1]
        left, d, i = ip, dp - 1, ip - 1
        while i >= 0 and d >= 0:
            if doc[d] == item[i]:
                d, i, left = d - 1, i - 1, i
            else:
                step = _edit(doc, item, d, i, -1)
                if step is None:
                    break
                edits.append(i if step[1] else i + 1)
                d, i = d - step[0], i - step[1]
        best = max(best, _longest(left, right, sorted(edits), every))
        if best >= len(item):
            break
    return best


def _edit(doc: list[str], item: list[str], d: int, i: int, way: int) -> tuple[int, int] | None:
    """How far to go in document and item over one edit: replaced (1, 1), inserted (1, 0), both (2, 1), left out (0, 1)."""

    def same(a: int, b: int) -> bool:
        for n in range(2):
            x, y = a + way * n, b + way * n
            if not (0 <= y < len(item)):
                return n > 0
            if not (0 <= x < len(doc)) or doc[x] != item[y]:
                return False
        return True

    for step in ((1, 1), (1, 0), (2, 1)):
        if same(d + way * step[0], i + way * step[1]):
            return step
    return None


def _longest(left: int, right: int, edits: list[int], every: int) -> int:
    """Longest part of [left, right) in which there is at most one edit for each ``every`` words."""
    cuts = [left, *edits, right]
    best = 0
    for a in range(len(cuts) - 1):
        start = cuts[a] if a == 0 else cuts[a] + 1
        for b in range(len(cuts) - 1, a, -1):
            n = cuts[b] - start
            if n <= best:
                break
            if (b - a - 1) * every <= n:
                best = n
                break
    return best


def plain_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``words`` (array<string>) of each item without the opening sentences that other items share.

    An opening counts as shared if the first sentence of two different texts is the same in plain words; that is counted
    over all items, whatever their number. The last sentence of an item always stays. Null ids and texts are left out.
    """
    src = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("t")).dropna().distinct()

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [[" ".join(plain_words(s)) for s in _SENTENCE.split(_MARKUP.sub(" ", t).strip())] for t in pdf["t"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "text_key": pdf["text_key"], "parts": parts})

    s = cut(src.withColumn("text_key", F.xxhash64("t")).mapInPandas(sentences, "item_id bigint, text_key bigint, parts array<string>"))
    shared = s.groupBy(F.col("parts")[0].alias("part")).agg(F.count_distinct("text_key").alias("k")).filter("k > 1").select("part", F.lit(True).alias("shared"))
    each = s.select("item_id", "text_key", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")).join(shared, "part", "left")
    first = each.filter(F.col("shared").isNull() | (F.col("at") == F.col("n") - 1)).groupBy("item_id", "text_key").agg(F.min("at").alias("from"))
    words = F.filter(F.split(F.array_join(F.slice("parts", F.col("from") + 1, F.size("parts")), " "), " "), lambda w: w != "")
    return s.join(first, ["item_id", "text_key"]).select("item_id", words.alias("words"))


def _fingerprints(items: DataFrame) -> DataFrame:
    """``iid``, ``ipos``, ``key`` of the winnowed word runs of items (``iid``, ``words``); ``again`` is the key for a second look."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for pdf in batches:
            out = []
            for iid, words in zip(pdf["iid"], pdf["words"]):
                at, g = winnow(vocabulary.hashes(list(words)))
                out.append(pd.DataFrame({"iid": iid, "ipos": at.astype(np.int32), "key": g.view(np.int64), "again": (g * _M1).view(np.int64)}))
            if out:
                yield pd.concat(out)

    return items.mapInPandas(run, "iid bigint, ipos int, key bigint, again bigint")


def _sift(batches: Iterator[pd.DataFrame], table: np.ndarray, bits: int, least: int) -> Iterator[pd.DataFrame]:
    """Documents with at least ``least`` fingerprints that items may have: words, positions and keys of these."""
    vocabulary = Vocabulary()
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            words = plain_words(text)
            at, g = winnow(vocabulary.hashes(words))
            if len(g) < least:
                continue
            ok = held(table, bits, g)
            ok &= held(table, bits, g * _M1)
            if int(ok.sum()) >= least:
                rows.append((doc_id, " ".join(words), at[ok].astype(np.int32), g[ok].view(np.int64)))
        yield pd.DataFrame(rows, columns=["doc_id", "words", "dpos", "keys"])


def _extend(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [leaked_span(d.split(" "), list(i), [(h["dpos"], h["ipos"]) for h in hits], span) for d, i, hits in zip(pdf["doc_words"], pdf["words"], pdf["hits"])]
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "words": got})
        yield out[out["words"] >= span]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """``doc_id``, ``item_id``, ``words`` (longest leaked run) for every document that holds ``span`` words of an item.

    Null ids and null or empty texts hold nothing. Items shorter than ``span`` words never leak. Documents with one id count as
    one. The corpus is read once, whatever the number of items: a bit map of the items' fingerprints (at most
    2**MOST_BITS bits) sifts the documents, what is left is joined with the fingerprints by shuffle, with hot
    fingerprints and hot items split over tasks.
    """
    it = plain_items(items, item_id, item_text).filter(F.size("words") >= span)
    it = cut(it.withColumn("iid", F.monotonically_increasing_id()))
    fp = cut(_fingerprints(it.select("iid", "words")))
    n = fp.count()
    bits = bits_for(2 * n, 32, MOST_BITS)
    table = docs.sparkSession.sparkContext.broadcast(build(fp.select(F.explode(F.array("key", "again")).alias("key")), bits))
    # 14 words with two edits leave two common fingerprints at least, other demands one
    least = 2 if span >= 2 * EVERY else 1
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).dropna()
    left = d.mapInPandas(lambda b: _sift(b, np.frombuffer(table.value, dtype=np.uint8), bits, least), "doc_id bigint, words string, dpos array<int>, keys array<bigint>")
    left = cut(left.withColumn("did", F.monotonically_increasing_id()))
    hits = left.select("did", F.explode(F.arrays_zip("dpos", "keys")).alias("h")).select("did", "h.dpos", F.col("h.keys").alias("key"))
    hits = cut(hits.join(fp.select("key").distinct().hint("merge"), "key", "left_semi"))
    total = hits.count()
    met = join_with_hot(hits, fp.select("key", "iid", "ipos"), ["key"], find_hot(hits, ["key"], total), F.col("did"))
    pairs = met.groupBy("did", "iid").agg(F.collect_list(F.struct("dpos", "ipos")).alias("hits")).filter(F.size("hits") >= least)
    pairs = cut(pairs)
    pairs = join_with_hot(pairs, it, ["iid"], find_hot(pairs, ["iid"], pairs.count()), F.col("did"))
    pairs = pairs.hint("merge").join(left.select("did", "doc_id", F.col("words").alias("doc_words")), "did")
    found = pairs.select("doc_id", "item_id", "doc_words", "words", "hits").mapInPandas(lambda b: _extend(b, span), "doc_id bigint, item_id bigint, words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))

