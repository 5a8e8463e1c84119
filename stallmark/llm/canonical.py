"""Mapping freely typed values to a list of canonical entries.

A typed value is brought to a plain form (no accents, look-alike digits and signs read as letters, letters of the same
sound written alike). A multi-pattern automaton over the equally folded names and aliases finds every mention embedded
in the value; of overlapping ones the longest wins. What the automaton leaves goes to token-set similarity: the tokens
of the value, also two neighbours taken as one, against the set of tokens of each name. A token of the name counts
1 / (1 + edits) by the nearest token of the value, nothing beyond one or two edits; the similarity is the mean over the
tokens of the name, and more than half of them must be met. An index of all one- and two-letter deletions of the tokens
brings the candidates.

Searching and deciding are two steps. A list of up to NAMES_AT_ONCE names is searched in one automaton; a longer one is cut
by the hash of the folded name, each part reports what it found for each distinct value, and the one decision is made
over all findings. So the size of the parts changes no answer.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.operators.skew import find_hot, join_with_hot
from stallmark.session import cut

NAMES_AT_ONCE = 100_000

_LEET = str.maketrans({"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"})
_SPLIT = regex.compile(r"[\s,;/|()\[\]&:]+|(?<=\s)[-–—](?=\s)")
_SEGMENT = regex.compile(r"[,;/|()]|\s[-–—]\s")
_INNER = regex.compile(r"[^\p{L}\p{N}@$]")
_SOUNDS = ((regex.compile(p), r) for p, r in ((r"ee", "i"), (r"oo", "u"), (r"(?<=[bcdgjklmnprstvwz])h", ""), (r"w", "v"), (r"z", "j"), (r"q", "k"), (r"(.)\1+", r"\1")))
_SOUNDS = tuple(_SOUNDS)

#: Words after a place name that make it the name of a road or quarter.
ROAD_WORDS = frozenset("road rd highway hwy bypass street st marg lane avenue ave cross gali ring expressway".split())
AREA_WORDS = frozenset("layout phase colony extension nagar enclave market sector block vihar township park".split())
#: Words that never name an entry.
GENERIC = frozenset("city district town near only all over any original imported company electronics mobiles mobile more brand by pvt ltd private limited store shop official".split())


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()


def letters(token: str, one: str = "i") -> str:
    """A token as letters: look-alikes read as letters if the token holds letters at all."""
    t = _INNER.sub("", token)
    if sum(c.isalpha() for c in t) < 2:
        return ""
    return "".join(c for c in t.translate(_LEET).replace("1", one) if c.isalpha())


def fold(word: str) -> str:
    for p, r in _SOUNDS:
        word = p.sub(r, word)
    return word


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting once; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def _deletions(word: str, depth: int) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(depth):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def _depth(n: int) -> int:
    return 0 if n < 4 else 1 if n < 7 else 2


@dataclass(frozen=True)
class Name:
    """One name or alias of an entry: its folded form, its plain form, the entry, and the region the entry lies in."""

    key: str
    raw: str
    ref_id: int
    region: str | None = None
    region_code: str | None = None


def name_of(text: str, ref_id: int, region: str | None = None, region_code: str | None = None) -> Name | None:
    raw = " ".join(w for w in (letters(t) for t in _SPLIT.split(plain(text))) if w)
    return Name(" ".join(map(fold, raw.split())), raw, ref_id, region, region_code) if raw else None


@dataclass(frozen=True)
class Token:
    raw: str
    folded: str
    segment: int
    shortened: bool


def tokenise(value: str) -> list[Token]:
    out = []
    for s, part in enumerate(_SEGMENT.split(plain(value))):
        for t in _SPLIT.split(part):
            w = letters(t)
            if w:
                out.append(Token(w, fold(w), s, t.endswith(".") and len(w) >= 4))
    return out


def forms(tokens: list[Token]) -> list[tuple[str, str, bool, int, bool]]:
    """Tokens and joined neighbours that may stand for a token of a name: raw, folded, shortened, position, joined."""
    out = []
    for i, t in enumerate(tokens):
        after = tokens[i + 1].raw if i + 1 < len(tokens) and tokens[i + 1].segment == t.segment else ""
        if t.raw in GENERIC or t.raw in AREA_WORDS or t.raw in ROAD_WORDS or after in AREA_WORDS or (after in ROAD_WORDS and i + 2 < len(tokens)):
            continue
        out.append((t.raw, t.folded, t.shortened, i, False))
        if after and after not in GENERIC and after not in AREA_WORDS and after not in ROAD_WORDS:
            out.append((t.raw + after, fold(t.raw + after), tokens[i + 1].shortened, i, True))
    return out


#: What a part of the list found in a value.
#: mention: start in the folded line, key, names. region: start, key, region. code: region.
#: near: number of the form, key, token of the key (-1: the whole name in one), tokens of the key, cost, names. begun: number of the form, key, names.
Finding = tuple


@dataclass
class Matcher:
    """Searches a part of the list of names."""

    names: list[Name]
    by_fold: dict[str, list[tuple[str, int, str | None]]] = field(default_factory=dict)
    near: dict[str, set[tuple[str, int]]] = field(default_factory=dict)
    starts: dict[str, set[str]] = field(default_factory=dict)
    regions: dict[str, str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        for n in self.names:
            self.by_fold.setdefault(n.key, []).append((n.raw, n.ref_id, n.region))
            if n.region:
                self.regions[" ".join(fold(w) for w in (letters(t) for t in _SPLIT.split(plain(n.region))) if w)] = n.region
            if n.region and n.region_code:
                self.codes[n.region_code.lower()] = n.region
        self.regions.pop("", None)
        auto = ahocorasick.Automaton()
        for key in {*self.by_fold, *self.regions}:
            auto.add_word(f" {key} ", key)
        for key, named in self.by_fold.items():
            raws = {raw for raw, _, _ in named}
            parts = [(-1, {key.replace(" ", ""), *[r.replace(" ", "") for r in raws]})]
            if " " in key:
                parts += [(j, {w, *[r.split()[j] for r in raws]}) for j, w in enumerate(key.split())]
            for j, spelled in parts:
                for form in spelled:
                    for d in _deletions(form, _depth(len(form))):
                        self.near.setdefault(d, set()).add((key, j))
            for form in parts[0][1]:
                for n in range(max(5, -(-len(form) * 11 // 20)), len(form) - 1):
                    self.starts.setdefault(form[:n], set()).add(key)
        auto.make_automaton() if len(auto) else None
        self.auto = auto if len(auto) else None
        self.likely: dict[tuple[str, bool], list[Finding]] = {}
        self.answers: dict[str, tuple[int, float]] = {}

    def resolve(self, value: str) -> tuple[int, float]:
        """Entry and score by this part alone, that is by the whole list where there is one part."""
        got = self.answers.get(value)
        if got is None:
            if len(self.answers) > 200_000:
                self.answers.clear()
            tokens = tokenise(value)
            found = self.mentions(tokens)
            got = decide(tokens, found) if any(f[0] == "mention" for f in found) else None
            if got is None or not got[0]:
                got = decide(tokens, found + self.similar(tokens))
            self.answers[value] = got
        return got

    def mentions(self, tokens: list[Token]) -> list[Finding]:
        if not tokens or self.auto is None:
            return []
        line = f" {' '.join(t.folded for t in tokens)} "
        out: list[Finding] = []
        for end, key in self.auto.iter(line):
            start = end - len(key) - 1
            if key in self.by_fold:
                out.append(("mention", start, key, self.by_fold[key]))
            if key in self.regions:
                out.append(("region", start, key, self.regions[key]))
        out += [("code", i, self.codes[t.raw]) for i, t in enumerate(tokens) if t.raw in self.codes]
        return out

    def similar(self, tokens: list[Token]) -> list[Finding]:
        out: list[Finding] = []
        for at, (w, f, short, _, joined) in enumerate(forms(tokens)):
            out += [("near", at, *c) for c in self._candidates(w, joined)]
            if not joined:
                begun = set().union(*[self.starts.get(g, set()) for g in (w, f)])
                if short:
                    begun |= {k for k in self.by_fold if len(k) > len(f) >= 4 and k.startswith(f)}
                out += [("begun", at, k, self.by_fold[k]) for k in begun]
        return out

    def _candidates(self, w: str, joined: bool) -> list[Finding]:
        """Names with a token near a form: key, token, tokens of the key, cost, names."""
        got = self.likely.get((w, joined))
        if got is not None:
            return got
        f = fold(w)
        spelled = {w, f} | ({fold(w.replace("i", "l", 1))} if w.count("i") == 1 else set())
        keys: set[tuple[str, int]] = set()
        for g in spelled:
            for d in _deletions(g, max(1, _depth(len(g)))):
                keys |= self.near.get(d, set())
        out = []
        for key, j in keys:
            words = key.split()
            k = words[j] if j >= 0 else "".join(words)
            most = 1 if joined else _depth(min(len(k), len(f) + 1))
            n = min(edits(g, k, most) for g in spelled)
            raws = [r.split()[j] if j >= 0 else r.replace(" ", "") for r, _, _ in self.by_fold[key]]
            raw, length = min((edits(w, r, 4), len(r)) for r in raws)
            if raw <= (1 if joined else _depth(min(length, len(w) + 1))):
                n = min(n, raw)
            if n > most or (n > 1 and raw > 3) or (len(f) <= 6 and n and f[:1] != k[:1] and raw > 1):
                continue
            out.append((key, j, len(words), n + (0.25 if joined else 0) + raw / 20, self.by_fold[key]))
        if len(self.likely) > 200_000:
            self.likely.clear()
        self.likely[(w, joined)] = out
        return out


def _one(named: list[tuple[str, int, str | None]], raw: str, region: str | None) -> int:
    """Entry of the nearest spelling; a region decides among entries of one name, then the smallest ref_id."""
    best = min(edits(raw, r, 9) for r, _, _ in named)
    same = sorted({(i, g or "") for r, i, g in named if edits(raw, r, 9) == best})
    if region is not None and len(same) > 1:
        same = [x for x in same if x[1] == region] or same
    return same[0][0]


def decide(tokens: list[Token], found: list[Finding]) -> tuple[int, float]:
    """ref_id and score (1 for an embedded mention, less for similar ones) from all findings of a value, or (0, 0)."""
    names: dict[str, list] = {}
    mention, regions, codes, near, begun = [], [], [], [], {}
    for f in found:
        if f[0] == "mention":
            mention.append((f[1], f[2]))
            names[f[2]] = f[3]
        elif f[0] == "region":
            regions.append((f[1], f[2], f[3]))
        elif f[0] == "code":
            codes.append((f[1], f[2]))
        elif f[0] == "near":
            near.append(f[1:6])
            names[f[2]] = f[6]
        else:
            begun.setdefault(f[1], set()).add(f[2])
            names[f[2]] = f[3]
    starts, at = {}, 0
    for i, t in enumerate(tokens):
        starts[at] = i
        at += len(t.folded) + 1
    entries = {k for _, k in mention}
    spans = [(len(k) + 2, start, "entry", k, None) for start, k in set(mention)] + [(len(k) + 2, start, "region", k, r) for start, k, r in set(regions) if k not in entries]
    taken: list[tuple] = []
    for x in sorted(spans, key=lambda x: (-x[0], x[1])):
        if all(x[1] + x[0] - 1 <= a or x[1] >= a + m - 1 for m, a, *_ in taken):
            taken.append(x)
    region = next((r for *_, kind, _, r in taken if kind == "region"), None)
    if region is None and codes:
        region = min(codes)[1]
    hits = []
    for _, start, kind, key, _ in sorted(taken, key=lambda x: x[1]):
        if kind != "entry" or start not in starts:
            continue
        i = starts[start] + len(key.split()) - 1
        after = tokens[i + 1].raw if i + 1 < len(tokens) and tokens[i + 1].segment == tokens[i].segment else ""
        if not (after in ROAD_WORDS and i + 2 < len(tokens)):
            hits.append((key, tokens[starts[start]].raw))
    if hits:
        exact = [h for h in hits if any(raw == h[1] for raw, _, _ in names[h[0]])]
        key, raw = (exact or hits)[-1]
        return _one(names[key], raw, region), 1.0
    # token-set similarity
    known = {k for _, k, _ in regions}
    every = forms(tokens)
    cost: dict[str, dict[int, tuple[float, int]]] = {}
    size: dict[str, int] = {}
    for form, key, j, n, c in near:
        if every[form][1] in known:
            continue
        size[key] = n
        held = cost.setdefault(key, {}).get(j)
        if held is None or (c, -every[form][3]) < (held[0], -every[held[1]][3]):
            cost[key][j] = (c, form)
    for form, keys in begun.items():
        if len(keys) == 1 and every[form][1] not in known:
            key = next(iter(keys))
            held = cost.setdefault(key, {}).get(-1)
            if held is None or (1.2, -every[form][3]) < (held[0], -every[held[1]][3]):
                cost[key][-1] = (1.2, form)
    ranked = []
    for key, met in cost.items():
        if -1 in met:
            ranked.append((1 / (1 + met[-1][0]), every[met[-1][1]][3], key, every[met[-1][1]][0]))
        parts = [v for j, v in met.items() if j >= 0]
        if len({every[f][3] for _, f in parts}) == len(parts) and 2 * len(parts) > size.get(key, 1) > 1:
            raw = " ".join(every[f][0] for _, f in (met[j] for j in sorted(met) if j >= 0))
            ranked.append((sum(1 / (1 + c) for c, _ in parts) / size[key], max(every[f][3] for _, f in parts), key, raw))
    if not ranked:
        return 0, 0.0
    top = max(r[0] for r in ranked)
    best = [r for r in ranked if r[0] > top - 1e-9]
    last = max(r[1] for r in best)
    best = [r for r in best if r[1] == last]
    if len({r[2] for r in best}) > 1:
        return 0, 0.0
    return _one(names[best[0][2]], best[0][3], region), top


def _rows(canonical: DataFrame, kind: str) -> DataFrame:
    """``ref_id``, ``text``, ``region``, ``code``: one row a name or alias of the kind; null names are left out."""
    c = canonical.filter((F.col("kind") == kind) & F.col("name").isNotNull())
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = c.select(F.col("ref_id").cast("bigint").alias("ref_id"), F.explode(every).alias("text"), F.col("state_name").alias("region"), F.col("state_code").alias("code"))
    return rows.filter(F.length("text") > 0).distinct()


def _parts(rows: DataFrame, most: int) -> list[list[Name]]:
    """The names in parts of about ``most``; a folded form lies in one part with all its names."""
    n = rows.count()
    if n <= most:
        return [[x for x in (name_of(r.text, r.ref_id, r.region, r.code) for r in rows.orderBy("ref_id", "text").collect()) if x]]

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [name_of(t, 0) for t in pdf["text"]]
            yield pdf.assign(key=[k.key if k else "" for k in keys])

    keyed = cut(rows.mapInPandas(folded, "ref_id bigint, text string, region string, code string, key string").filter("key <> ''"))
    parts, out = -(-n // most), []
    for i in range(parts):
        some = keyed.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).orderBy("ref_id", "text").collect()  # about ``most`` rows
        out.append([name_of(r.text, r.ref_id, r.region, r.code) for r in some])
    return out


def map_values(df: DataFrame, ident: str, value: str, canonical: DataFrame, kind: str, at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """``record_id``, ``ref_id`` (0 if no entry is meant), ``score`` for each row whose value is neither null nor blank.

    Rows stay rows: repeated ids and values come out as often as they come in. An empty list maps everything to 0. A list
    of at most ``at_once`` names goes to the tasks whole; a longer one in parts, over distinct values.
    """
    rows = df.select(F.col(ident).cast("bigint").alias("record_id"), F.col(value).alias("value"))
    rows = rows.filter(F.length(F.regexp_replace("value", r"(?U)[\s\p{Cf}]", "")) > 0)
    parts = _parts(_rows(canonical, kind), at_once)
    if len(parts) == 1:
        names = df.sparkSession.sparkContext.broadcast(parts[0])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(names.value)
            for pdf in batches:
                got = [m.resolve(v) for v in pdf["value"]]
                yield pd.DataFrame({"record_id": pdf["record_id"], "value": pdf["value"], "ref_id": [g[0] for g in got], "score": [g[1] for g in got]})

        return rows.mapInPandas(run, "record_id bigint, value string, ref_id bigint, score double")
    values = cut(rows.select("value").distinct())
    found = None
    for part in parts:
        names = df.sparkSession.sparkContext.broadcast(part)

        def search(batches: Iterator[pd.DataFrame], names=names) -> Iterator[pd.DataFrame]:
            m = Matcher(names.value)
            for pdf in batches:
                got = [(t := tokenise(v)) and json.dumps(m.mentions(t) + m.similar(t)) or "[]" for v in pdf["value"]]
                yield pd.DataFrame({"value": pdf["value"], "found": got})

        some = values.mapInPandas(search, "value string, found string")
        found = some if found is None else found.unionByName(some)

    def conclude(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [decide(tokenise(v), [tuple(_tuples(x)) for one in f for x in json.loads(one)]) for v, f in zip(pdf["value"], pdf["found"])]
            yield pd.DataFrame({"value": pdf["value"], "ref_id": [g[0] for g in got], "score": [g[1] for g in got]})

    answers = found.groupBy("value").agg(F.collect_list("found").alias("found")).mapInPandas(conclude, "value string, ref_id bigint, score double")
    rows = cut(rows)
    return join_with_hot(rows, cut(answers), ["value"], find_hot(rows, ["value"], rows.count()), F.col("record_id")).select("record_id", "value", "ref_id", "score")


def _tuples(finding: list) -> list:
    """A finding as it was before it was written: names are tuples."""
    return [[tuple(n) for n in x] if isinstance(x, list) else x for x in finding]
