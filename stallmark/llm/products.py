"""Listings of the same product, found by bipartite term-pair reinforcement.

A record becomes a set of terms from its title, description, model and brand: codes (a name, letters and a number in one
spelling, of whatever length), and with the code the variant, the kind of accessory, storage, memory, screen and capacity
in one unit each; the words of title and brand. Of several codes in a record the one in its model field names the
product, else the one that most records hold. Records with the same stated attributes are one class, which holds the words that
more than half of its records hold.

Classes that share a code are candidate pairs, whatever else they say; without any code those that share two of their three
rarest words, or any two or more words that outweigh the other words of the lighter class (a word weighs by its rarity). Terms and pairs then reinforce each other. The score of a pair is S / (S + D + REST): S adds the weights of the terms
both hold, D the weights of the attributes in which both state something else. The weight of a term is the mean score of
all pairs of records that hold it, pairs that are no candidates counting as 0; the weight of an attribute is the mean
over its terms. Terms of advertising so lose their weight and codes with an attribute gain it. At convergence the pairs
whose score reaches the threshold are kept and clustered by connected components.

A record that leaves an attribute open joins the products that fit only if these do not contradict each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallmark.llm.canonical import fold, letters, plain
from stallmark.llm.components import connected_components
from stallmark.operators.skew import find_hot, join_with_hot
from stallmark.session import cut, discard, release

MATCH = 0.9
REST = 0.1
TOLERANCE = 0.01
#: Far more rounds than tables need; when they are used up, no result is given.
MOST_ROUNDS = 100
#: Classes with one key, or records in a group, from which comparing all with all is split over tasks.
HOT_KEY = 1_000

_I = regex.IGNORECASE
_UNIT = r"(?:[gmtk]b\b|g\b|gigs?\b|gigabytes?\b|mah\b|cms?\b|inch(?:es)?\b|in\b|lit(?:re|er)s?\b|ltrs?\b|l\b|w\b|v\b|%|rupees\b|rs\b|days?\b|weeks?\b|months?\b|years?\b)"
_VARIANT = r"pro|max|lite|plus|neo|ultra|mini|air|prime|edge|note|se|fe"
_CODE = regex.compile(rf"(?<![\p{{L}}\d])(?:([\p{{L}}]+?)[\s-]*)?([\p{{L}}])[\s-]?(\d{{2,6}})(?!\d)(?![.,-]\d)(?!\s*-?\s*(?:{_UNIT}|[\"”″]))\s*-?\s*({_VARIANT})?(?![\p{{L}}])", _I)
_ACCESSORY = regex.compile(
    r"\b((?:(?:replacement|spare|carry|carrying|back|front|screen|flip|phone|laptop|power|usb|lens|wall|car|ear|protective)[\s-])?"
    r"(?:case|cover|guard|protector|charger|adapter|battery|cable|strap|stand|pouch|sleeve|skin|dock|remote|controller|mount|holder|keyboard|stylus|filter|glass|bag))s?\s+for\s",
    _I,
)
_RAM_BEFORE = regex.compile(r"(?<![\d.])(\d{1,5})\s*(gb|mb|g)\s*(?:ram|memory)\b", _I)
_RAM_AFTER = regex.compile(r"\b(?:ram|memory)\s*[:-]?\s*(\d{1,5})\s*(gb|mb|g)\b(?!\s*(?:ram|memory)\b)", _I)
_STORAGE = regex.compile(r"(?<![\d.])(\d+(?:\.\d+)?)\s*(gb|gigs?|gigabytes?|tb|terabytes?|g)\b(?!\s*(?:ram|memory))", _I)
_SCREEN = regex.compile(r"(?<![\d.])(\d{1,3}(?:\.\d)?)\s*-?\s*(\"|”|inch(?:es)?\b|in\b(?=\s+screen)|cms?\b)", _I)
_CAPACITY = regex.compile(r"(?<![\dOolI.][\s-]?)(\d+(?:\.\d+)?)\s*(lit(?:re|er)s?|ltrs?|l|cu\.?\s*ft)\b", _I)
_WORD = regex.compile(r"[\p{L}][\p{L}\p{M}]+")

#: Attributes: name and code, variant, accessory, storage, memory, screen, capacity.
KINDS = ("ser", "var", "acc", "sto", "ram", "scr", "cap")


def codes(text: str | None) -> list[tuple[str, str, str]]:
    """(name, code, variant) of each code in a text; the name is '' where no word stands before it, the variant '-' where none follows."""
    return [((m[1] or "").lower(), (m[2] + m[3]).lower(), (m[4] or "-").lower()) for m in _CODE.finditer(text or "")]


def attributes(title: str | None, description: str | None) -> dict[str, str]:
    """Accessory ('-' if there is none) and specifications of a record, the latter from the description where the title has none."""
    title = title or ""
    a = _ACCESSORY.search(title)
    out = {"acc": regex.sub(r"[\s-]+", " ", a[1].lower()) if a else "-"}
    if a:  # an accessory has no specifications of its own
        return out
    for text in (title, description or ""):
        got: dict[str, str] = {}
        # "64 GB RAM 8 GB": the memory is the smaller of the two sizes next to the word
        sizes = [(float(m[1]) / (1024 if m[2][0] in "mM" else 1), m) for p in (_RAM_BEFORE, _RAM_AFTER) for m in p.finditer(text)]
        rest = text
        if sizes:
            n, m = min(sizes, key=lambda x: (x[0], x[1].start()))
            got["ram"] = f"{n:g}"
            for size, m in sizes:
                if size == n:
                    rest = rest[: m.start()] + " " * len(m[0]) + rest[m.end() :]
        for m in _STORAGE.finditer(rest):
            got.setdefault("sto", f"{float(m[1]) * (1024 if m[2][0] in 'tT' else 1):g}")
        for m in _SCREEN.finditer(rest):
            n = float(m[1])
            got.setdefault("scr", f"{round(n / 2.54, 1) if m[2].lower().startswith('cm') else n:g}")
        for m in _CAPACITY.finditer(rest):
            n = float(m[1]) * (28.3168 if m[2].lower().startswith("cu") else 1)
            got.setdefault("cap", f"{5 * round(n / 5):g}")
        for k, v in got.items():
            out.setdefault(k, v)
    return out


def words(title: str | None, brand: str | None) -> list[str]:
    """Distinct words of a title without its codes, and of the brand as typed, folded so that spellings meet."""
    out = {f"w={w.lower()}" for w in _WORD.findall(_CODE.sub(" ", title or ""))}
    out |= {f"w={fold(w)}" for w in (letters(t) for t in plain(brand or "").split()) if len(w) > 2}
    return sorted(out)


def extract(df: DataFrame, ident: str, title: str, description: str, model: str, brand: str) -> DataFrame:
    """``id``, ``codes`` (array of ser, code, var, own: in the model field), ``acc`` .. ``cap``, ``words`` for each record; null texts have none."""
    src = df.select(F.col(ident).cast("bigint").alias("id"), *[F.col(c).cast("string").alias(k) for c, k in ((title, "t"), (description, "d"), (model, "m"), (brand, "b"))])
    spec = ("acc", "sto", "ram", "scr", "cap")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, d, m, b in zip(pdf["id"], pdf["t"], pdf["d"], pdf["m"], pdf["b"]):
                a = attributes(t, d)
                found = [{"ser": s, "code": c, "var": v, "own": own} for own, text in ((False, t), (True, m)) for s, c, v in codes(text)]
                rows.append((i, found, *[a.get(k) for k in spec], words(t, b)))
            yield pd.DataFrame(rows, columns=["id", "codes", *spec, "words"])

    return src.mapInPandas(run, f"id bigint, codes array<struct<ser:string,code:string,var:string,own:boolean>>, {', '.join(k + ' string' for k in spec)}, words array<string>")


def classify(rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their class (``id``, ``cid``) and the classes: ``cid``, ``n``, ``code``, the KINDS, ``terms``.

    The code of a record is that of its model field, else the one that most records hold; of its spellings in the record the one with a variant, then
    with the longest name, counts. Records of the same code and attributes are a class, named by the smallest id; without
    a code those with the same attributes and words.
    """
    said = rec.select("id", F.explode("codes").alias("c")).select("id", "c.ser", "c.code", "c.var", "c.own").distinct()
    said = cut(said)
    df = cut(said.groupBy("code").agg(F.count_distinct("id").alias("df")))
    ranked = join_with_hot(said, df, ["code"], find_hot(said, ["code"], said.count()), F.col("id"))
    pick = ranked.groupBy("id").agg(F.max_by(F.struct("code", "var", "ser"), F.struct("own", "df", "code", F.col("var") != "-", F.length("ser"), "var", "ser")).alias("c")).select("id", "c.code", "c.var", "c.ser")
    name = F.when(F.col("ser") != "", F.concat("ser", "code"))
    full = rec.select("id", "acc", "sto", "ram", "scr", "cap", "words").join(pick, "id", "left").withColumn("ser", name)
    stated = F.concat_ws("\x01", F.coalesce("code", F.lit("?")), *[F.coalesce(F.col(k), F.lit("?")) for k in KINDS])
    full = cut(full.withColumn("content", F.xxhash64(stated, F.when(F.col("code").isNull(), F.array_join("words", "\x01")))))
    cls = cut(full.groupBy("content").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n"), *[F.first(k).alias(k) for k in ("code", *KINDS)]))
    total = full.count()
    hot = find_hot(full, ["content"], total)
    member = cut(join_with_hot(full.select("id", "content", "words"), cls.select("content", "cid", "n"), ["content"], hot, F.col("id")).select("id", "cid", "n", "words"))
    common = member.select("cid", "n", F.explode("words").alias("w")).groupBy("cid", "n", "w").agg(F.count(F.lit(1)).alias("k")).filter(2 * F.col("k") > F.col("n")).groupBy("cid").agg(F.array_sort(F.collect_list("w")).alias("words"))
    typed = [F.when(F.col(k).isNotNull(), F.concat(F.col("code"), F.lit(f"|{k}="), F.col(k))) for k in KINDS[1:]] + [F.concat(F.lit("ser="), F.col("ser")), F.concat(F.lit("code="), F.col("code"))]
    typed += [F.when(F.col(k).isNotNull() & (F.col(k) != "-"), F.concat(F.lit(f"{k}="), F.col(k))) for k in KINDS[1:]]
    terms = F.concat(F.when(F.col("code").isNotNull(), F.array_compact(F.array(*typed))).otherwise(F.array().cast("array<string>")), F.coalesce("words", F.array().cast("array<string>")))
    cls = cut(cls.join(common, "cid", "left").withColumn("terms", terms).drop("words", "content"))
    return member.select("id", "cid"), cls


def alike(held: DataFrame) -> DataFrame:
    """``cid_a`` < ``cid_b`` of all classes that share two or more words which outweigh the other words of the lighter class.

    ``held``: ``cid``, ``term``, ``df``, ``w``. With the words of the lighter class from rare to frequent, the first that
    both hold must come while what is left, itself included, weighs more than half; so these words meet all words of the
    others, which loses nothing.
    """
    rest = Window.partitionBy("cid").orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing)
    held = cut(held.withColumn("rest", F.sum("w").over(rest)).withColumn("whole", F.max("rest").over(Window.partitionBy("cid"))))
    light = held.filter(2 * F.col("rest") > F.col("whole") - 1e-9).select("term", F.col("cid").alias("lc"), F.col("whole").alias("lw"))
    heavy = held.select("term", F.col("cid").alias("hc"), F.col("whole").alias("hw"))
    hot = find_hot(held, ["term"], held.count(), floor=HOT_KEY)
    met = join_with_hot(light, heavy, ["term"], hot, F.col("lc"), strategy="merge")
    met = met.filter((F.col("lc") != F.col("hc")) & (F.col("lw") <= F.col("hw") + 1e-9)).select("lc", "hc").distinct()
    words_of = cut(held.groupBy("cid", "whole").agg(F.collect_list(F.struct("term", "w")).alias("ws")))  # the words of a row
    j = met.join(words_of.select(F.col("cid").alias("lc"), F.col("whole"), F.col("ws").alias("l")).hint("merge"), "lc")
    j = j.join(words_of.select(F.col("cid").alias("hc"), F.col("ws.term").alias("h")).hint("merge"), "hc")
    both = F.filter("l", lambda t: F.array_contains("h", t["term"]))
    weight = F.aggregate(both, F.lit(0.0), lambda x, t: x + t["w"])
    return j.filter((F.size(both) >= 2) & (2 * weight > F.col("whole"))).select(F.least("lc", "hc").alias("cid_a"), F.greatest("lc", "hc").alias("cid_b"))


def candidates(cls: DataFrame) -> DataFrame:
    """``cid_a`` < ``cid_b``, ``pairs`` (of records), ``shared`` terms, ``apart`` (attributes that contradict) of the pairs of classes that share a key."""
    df = cls.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    bare = cls.filter(F.col("code").isNull()).select("cid", F.explode("terms").alias("term"))
    held = cut(bare.join(df.hint("merge"), "term").withColumn("w", F.log(1 + F.lit(cls.count()) / F.col("df"))))
    rare = held.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, 3).alias("r"))  # the words of a row
    two = F.filter(F.array(*[F.concat_ws(" ", F.get("r", F.lit(i))["term"], F.get("r", F.lit(j))["term"]) for i, j in ((0, 1), (0, 2), (1, 2))]), lambda k: F.contains(k, F.lit(" ")))
    keys = cut(cls.filter(F.col("code").isNotNull()).select(F.concat(F.lit("code="), "code").alias("key"), "cid").unionByName(rare.select(F.explode(two).alias("key"), "cid")))
    a, b = (keys.withColumnRenamed("cid", f"cid_{s}") for s in "ab")
    met = join_with_hot(a, b, ["key"], find_hot(keys, ["key"], keys.count(), floor=HOT_KEY), F.col("cid_a")).filter(F.col("cid_a") < F.col("cid_b")).select("cid_a", "cid_b")
    met = met.unionByName(alike(held)).distinct()
    x, y = (cls.select(F.col("cid").alias(f"cid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "terms", *KINDS)]) for s in "ab")
    j = met.hint("merge").join(x, "cid_a").hint("merge").join(y, "cid_b")
    apart = F.array_compact(F.array(*[F.when(F.col(f"{k}_a") != F.col(f"{k}_b"), k) for k in KINDS]))
    return j.select("cid_a", "cid_b", (F.col("n_a") * F.col("n_b")).alias("pairs"), F.array_intersect("terms_a", "terms_b").alias("shared"), apart.alias("apart"))


def kind_of(term: Column) -> Column:
    """The attribute a term speaks of with its code, null for all other terms."""
    return F.when(F.startswith(term, F.lit("ser=")), "ser").otherwise(F.nullif(F.regexp_extract(term, r"\|(\w+)=", 1), F.lit("")))


def score_pairs(links: DataFrame, apart: DataFrame, weight: DataFrame, of_kind: dict[str, float], hot: DataFrame | None) -> DataFrame:
    """``cid_a``, ``cid_b``, ``pairs``, ``score`` of all candidate pairs under the given weights."""
    on = join_with_hot(links, weight.select("term", "x"), ["term"], hot, F.col("cid_a"))
    shared = on.groupBy("cid_a", "cid_b").agg(F.sum("x").alias("s"))
    d = sum((F.when(F.array_contains("apart", k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in of_kind.items()), F.lit(0.0))
    s = F.coalesce("s", F.lit(0.0))
    return apart.hint("merge").join(shared, ["cid_a", "cid_b"], "left").select("cid_a", "cid_b", "pairs", (s / (s + d + F.lit(REST))).alias("score"))


def reinforce(cls: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
    """Scores (``cid_a``, ``cid_b``, ``score``) once no weight moves by TOLERANCE, and the number of rounds; raises after MOST_ROUNDS."""
    links = cut(pairs.select("cid_a", "cid_b", F.explode("shared").alias("term")))
    apart = cut(pairs.select("cid_a", "cid_b", "pairs", "apart"))
    held = cls.select(F.explode("terms").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"), F.count(F.lit(1)).alias("classes"))
    weight = held.filter("classes > 1 or n > 1").select("term", (F.col("n") * (F.col("n") - 1) / 2).alias("possible"), "inside", kind_of(F.col("term")).alias("kind"), F.lit(0.5).alias("x"))
    weight = cut(weight)
    hot = find_hot(links, ["term"], links.count())
    of_kind = {k: 0.5 for k in KINDS}
    for done in range(1, MOST_ROUNDS + 1):
        scored = cut(score_pairs(links, apart, weight, of_kind, hot))
        back = links.hint("merge").join(scored.select("cid_a", "cid_b", (F.col("pairs") * F.col("score")).alias("s")), ["cid_a", "cid_b"]).groupBy("term").agg(F.sum("s").alias("s"))
        x = (F.col("inside") + F.coalesce("s", F.lit(0.0)) + 0.5) / (F.col("possible") + 1)
        new = cut(weight.hint("merge").join(back, "term", "left").select("term", "possible", "inside", "kind", F.col("x").alias("old"), x.alias("x")))
        row = new.agg(F.max(F.abs(F.col("x") - F.col("old"))).alias("moved"), *[(F.sum(F.when(F.col("kind") == k, F.col("x") * F.col("possible"))) / F.sum(F.when(F.col("kind") == k, F.col("possible")))).alias(k) for k in KINDS]).first()
        discard(weight)
        weight, was = new, of_kind
        of_kind = {k: 0.5 if row[k] is None else row[k] for k in KINDS}
        if max([row["moved"] or 0.0, *[abs(of_kind[k] - was[k]) for k in KINDS]]) < TOLERANCE:
            return scored, done
        discard(scored)
        if done % 4 == 0:
            release(cls.sparkSession)
    raise RuntimeError(f"weights of terms still move after {MOST_ROUNDS} rounds")


def same_products(df: DataFrame, ident: str = "record_id", title: str = "title", description: str = "description", model: str = "model", brand: str = "brand", match: float = MATCH) -> DataFrame:
    """``id``, ``group_id`` (smallest id of the product) for every record with a non-null id.

    Null texts hold no terms; records of no code that share no two rare or weighty words with others are alone. Repeated ids are one
    record. Empty tables give no rows.
    """
    rec = cut(extract(df.filter(F.col(ident).isNotNull()), ident, title, description, model, brand).dropDuplicates(["id"]))
    member, cls = classify(rec)
    pairs = cut(candidates(cls))
    scored, _ = reinforce(cls, pairs)
    judged = cut(scored.filter(F.col("score") >= match).select("cid_a", "cid_b"))
    # an open attribute may be filled by products that agree in it
    ends = judged.select(F.col("cid_a").alias("cid"), F.col("cid_b").alias("o")).unionByName(judged.select(F.col("cid_b").alias("cid"), F.col("cid_a").alias("o")))
    fits = ends.hint("merge").join(cls.select(F.col("cid").alias("o"), *KINDS), "o").groupBy("cid").agg(*[F.min(k).alias(f"{k}_lo") for k in KINDS], *[F.max(k).alias(f"{k}_hi") for k in KINDS])
    open_ = F.lit(False)
    for k in KINDS[1:]:
        open_ = open_ | (F.col(k).isNull() & (F.col(f"{k}_lo") != F.col(f"{k}_hi")))
    torn = cut(fits.hint("merge").join(cls.select("cid", *KINDS), "cid").filter(open_).select("cid"))
    kept = judged.join(torn.select(F.col("cid").alias("cid_a")).hint("merge"), "cid_a", "left_anti").join(torn.select(F.col("cid").alias("cid_b")).hint("merge"), "cid_b", "left_anti")
    group = connected_components(cls.select("cid"), kept.select("cid_a", "cid_b"))
    return member.hint("merge").join(group.select(F.col("id").alias("cid"), "group_id"), "cid").select("id", "group_id")


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs ``record_a`` < ``record_b`` of records with one group; large groups are split over tasks."""
    groups = cut(groups)
    a, b = (groups.select("group_id", F.col("id").alias(f"record_{s}")) for s in "ab")
    hot = find_hot(groups, ["group_id"], groups.count(), floor=HOT_KEY)
    j = a.hint("merge").join(b, "group_id") if hot is None else join_with_hot(a, b, ["group_id"], hot, F.col("record_a"))
    return j.filter(F.col("record_a") < F.col("record_b")).select("record_a", "record_b")
