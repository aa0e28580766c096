"""Column functions over names: normal forms, phonetic code, blocking keys, compatibility, scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import lexicons as lx


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")).astype(object)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def coref_name(text: Column) -> Column:
    """Lower case, without one leading honorific and without punctuation."""
    t = F.regexp_replace(F.trim(text), rf"(?iU)^(?:{'|'.join(lx.COREF_HONORIFICS)})\.?\s+", "")
    return F.trim(F.lower(F.regexp_replace(t, r"(?U)[^\w\s]", "")))


def plain_name(surface: Column, kind: Column) -> Column:
    """Normal form for comparing across documents. Accents must be stripped before (strip_accents)."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(surface), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    roles = sorted((r.lower() for r in lx.ROLES), key=len, reverse=True)
    person = F.regexp_replace(t, rf"^(?:{'|'.join(roles)}) +", "")
    person = F.filter(F.split(person, " "), lambda w: (w != "") & ~w.isin(*lx.HONORIFICS))
    org = words(F.regexp_replace(t, rf"(?:(?:^| )(?:{'|'.join(lx.ORG_SUFFIXES)}))+$", ""))
    fewer = F.filter(org, lambda w: ~w.isin(*lx.ORG_STOPWORDS))
    org = F.when((F.size(org) > 1) & (F.size(fewer) > 0), fewer).otherwise(org)
    return F.when(kind == "PERSON", F.regexp_replace(F.array_join(person, " "), rf"^(?:(?:{'|'.join(lx.TITLE_SHORT)}) )+", "")).otherwise(F.array_join(org, " "))


def surname(name: Column) -> Column:
    return F.try_element_at(words(name), F.lit(-1))


def acronym(name: Column) -> Column:
    return F.when(F.size(words(name)) > 1, F.array_join(F.transform(words(name), lambda w: F.substring(w, 1, 1)), ""))


def phonetic_code(token: Column) -> Column:
    """First letter and three digits; vowels, h, w and y end a run of like letters."""
    t = F.regexp_replace(token, "[^a-z]", "")
    d = F.translate(t, "abcdefghijklmnopqrstuvwxyz", "01230120022455012623010202")
    d = F.replace(F.substring(F.regexp_replace(d, r"([1-6])\1+", "$1"), 2, 1000), F.lit("0"), F.lit(""))
    return F.when(t != "", F.substring(F.concat(F.substring(t, 1, 1), d, F.lit("000")), 1, 4))


def blocking_keys(name: Column, kind: Column) -> Column:
    """Every key under which a name meets others."""
    w, last = words(name), surname(name)
    person = F.array(
        F.concat(F.lit("sur:"), last),
        F.concat(F.lit("phon:"), phonetic_code(last)),
        F.when(F.size(w) > 1, F.concat(F.lit("init:"), F.substring(name, 1, 1), F.lit("_"), last)),
    )
    org = F.concat(
        F.transform(F.filter(w, lambda x: F.length(x) > 3), lambda x: F.concat(F.lit("tok:"), x)),
        F.array(F.concat(F.lit("acr:"), acronym(name)), F.when((F.size(w) == 1) & F.length(name).between(2, 6), F.concat(F.lit("acr:"), name))),
    )
    keys = F.concat(F.array(F.concat(F.lit("full:"), name)), F.when(kind == "PERSON", person).otherwise(org))
    return F.when(name != "", F.sort_array(F.array_distinct(F.array_compact(keys)))).otherwise(F.array().cast("array<string>"))


def is_resolvable(name: Column) -> Column:
    return (F.length(name) >= 3) & ~name.isin(*lx.NOT_NAMES)


def bits(xs: Column) -> Column:
    """64 bits with one for each value of an array: arrays whose bits do not meet have nothing in common."""
    return F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def jaccard(a: Column, b: Column, of_a: Column | None = None, of_b: Column | None = None) -> Column:
    """Shared values by all values of two arrays. of_a and of_b are their bits where they are known, which saves most of the work."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    if of_a is not None:
        some &= of_a.bitwiseAND(of_b) != 0
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def given_name_conflict(a: Column, b: Column, parts: tuple[Column, ...] | None = None) -> Column:
    """Same surname, other given name, neither an initial of the other. parts: see name_compatibility."""
    x, y = parts[:2] if parts else (words(a), words(b))
    f, g = F.get(x, F.lit(0)), F.get(y, F.lit(0))
    initial = lambda p, q: (F.length(p) == 1) & q.startswith(p)
    same = F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))
    return F.coalesce((F.size(x) > 1) & (F.size(y) > 1) & same & (f != g) & ~initial(f, g) & ~initial(g, f), F.lit(False))


def acronym_match(a: Column, b: Column, parts: tuple[Column, ...] | None = None) -> Column:
    x, y, p, q = parts[:4] if parts else (words(a), words(b), acronym(a), acronym(b))
    one = lambda name, w, short: (F.size(w) == 1) & (F.length(name) >= 3) & (name == short)
    return F.coalesce(one(a, x, q), F.lit(False)) | F.coalesce(one(b, y, p), F.lit(False))


def _indel(a: str, b: str) -> float:
    """Similarity by insertions and deletions: twice the longest common subsequence over both lengths, by bit rows."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = masks.get(c, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    lcs = len(a) - row.bit_count()
    return 2 * lcs / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: similarity of two names by their token sets."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, da, db = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not da or not db):
        return 100.0
    join = lambda d: f"{both} {d}".strip()
    scores = [_indel(join(da), join(db))]
    if both:
        scores += [_indel(both, join(da)), _indel(both, join(db))]
    return 100 * max(scores)


class Spellings:
    """token_set_ratio of many pairs at once. Of each different name it keeps the sorted tokens as bit rows; a pair's common
    tokens are masked out of the rows, where they match nothing, so one row a pair holds the longest common subsequence."""

    #: Characters of a name (a row is one word of 64 bits), tokens of a name, different characters, names kept at most; what is beyond is compared alone.
    LONG, TOKENS, LETTERS, KEPT = 63, 8, 64, 16_384

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.letters: dict[str, int] = {}
        self.plain = np.zeros(self.KEPT, bool)
        self.spaces = np.zeros(self.KEPT, np.uint64)
        self.masks = np.zeros((self.KEPT, self.LETTERS), np.uint64)
        self.codes = np.zeros((self.LONG, self.KEPT), np.int64)
        self.tokens = np.full((self.TOKENS, self.KEPT), -1, np.int64)
        self.bits = np.zeros((self.TOKENS, self.KEPT), np.uint64)

    def _add(self, name: str) -> int:
        k = self.at[name] = len(self.at)
        tokens = sorted(set(name.split()))
        text = " ".join(tokens)
        codes = [self.letters.setdefault(c, len(self.letters) + 1) for c in text]
        if len(text) > self.LONG or len(tokens) > self.TOKENS or max(codes, default=0) >= self.LETTERS:
            return k
        self.plain[k] = True
        self.codes[: len(codes), k] = codes
        masks: dict[int, int] = {}
        for i, c in enumerate(codes):
            masks[c] = masks.get(c, 0) | 1 << i
        self.masks[k, list(masks)] = np.array(list(masks.values()), np.uint64)
        self.spaces[k] = masks.get(self.letters.get(" "), 0)
        start = 0
        for i, t in enumerate(tokens):  # a token's bits with the space before it
            self.tokens[i, k] = self.ids.setdefault(t, len(self.ids))
            end = start + len(t) + (i > 0)
            self.bits[i, k] = (1 << end) - (1 << start)
            start = end
        return k

    def index(self, names: list[str]) -> np.ndarray:
        return np.array([k if (k := self.at.get(x)) is not None else self._add(x) for x in names], np.int64)

    def _joined(self, taken: list[np.ndarray], k: np.ndarray) -> np.ndarray:
        """The bits of the taken tokens of names k, joined by single spaces."""
        s = np.zeros(len(k), np.uint64)
        for i, t in enumerate(taken):
            s |= np.where(t, self.bits[i].take(k), np.uint64(0))
        return s & ~(s & (~s + np.uint64(1)) & self.spaces.take(k))

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """0 to 100 for the names numbered a and b, all of them plain."""
        used = lambda t, k: next((i for i in range(self.TOKENS) if not (t[i].take(k) >= 0).any()), self.TOKENS)
        x = [self.tokens[i].take(a) for i in range(used(self.tokens, a))]
        y = [self.tokens[i].take(b) for i in range(used(self.tokens, b))]
        no = np.zeros(len(a), bool)
        same_x, same_y = [no.copy() for _ in x], [no.copy() for _ in y]
        for i, t in enumerate(x):
            for j, u in enumerate(y):
                e = (t == u) & (t >= 0)
                same_x[i] |= e
                same_y[j] |= e
        both = self._joined(same_x, a)
        da, db = self._joined([~s for s in same_x], a), self._joined([~s for s in same_y], b)
        row, flat, base = np.full(len(a), ~np.uint64(0)), self.masks.ravel(), a * self.LETTERS
        for j in range(int(np.bitwise_or.reduce(db, initial=np.uint64(0))).bit_length()):
            m = flat.take(base + self.codes[j].take(b))
            m &= da & (np.uint64(0) - (db >> np.uint64(j) & np.uint64(1)))
            m &= row
            row = (row + m) | (row ^ m)
        n_both, n_a, n_b, lcs = (np.bitwise_count(z).astype(float) for z in (both, da, db, ~row))
        head = np.where(n_both > 0, n_both + 1, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            best = 2 * (head + lcs) / (head + n_a + head + n_b)
            for n in (n_a, n_b):
                best = np.where(n_both > 0, np.maximum(best, 2 * n_both / (n_both + head + n)), best)
        best = np.where((n_both > 0) & ((n_a == 0) | (n_b == 0)), 1.0, best)
        return 100 * np.where((n_both + n_a == 0) | (n_both + n_b == 0), 0.0, best)

    def of(self, a: pa.Array, b: pa.Array) -> np.ndarray:
        a, b = (x.fill_null("").dictionary_encode() for x in (a, b))
        names = [a.dictionary.to_pylist(), b.dictionary.to_pylist()]
        if len(self.at) + sum(map(len, names)) > self.KEPT or len(self.letters) > 4 * self.LETTERS:
            self.__init__()
        if sum(map(len, names)) > self.KEPT:
            half = len(a) // 2
            return np.concatenate([self.of(a[:half].dictionary_decode(), b[:half].dictionary_decode()), self.of(a[half:].dictionary_decode(), b[half:].dictionary_decode())])
        i, j = (self.index(n).take(x.indices.to_numpy()) for n, x in zip(names, (a, b)))
        plain = self.plain.take(i) & self.plain.take(j)
        if plain.all():
            return self.ratios(i, j)
        out = np.empty(len(i))
        out[plain] = self.ratios(i[plain], j[plain])
        for k in np.flatnonzero(~plain):
            out[k] = token_set_ratio(a[int(k)].as_py(), b[int(k)].as_py())
        return out


@F.arrow_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    s = Spellings()
    for a, b in batches:
        yield pa.array(s.of(a, b) / 100)


def name_compatibility(a: Column, b: Column, fuzzy: bool = True, parts: tuple[Column, ...] | None = None) -> Column:
    """1 for equal names, the subset tier for containment and acronyms, else likeness of spelling under a cap.

    parts has words(a), words(b), acronym(a), acronym(b), and the bits of both words where they are known, as they are
    where one name is in many pairs."""
    x, y, _, _, u, v = parts or (words(a), words(b), None, None, F.lit(0), F.lit(0))
    within = lambda p, q, s, t: (s.bitwiseAND(F.bitwise_not(t)) == 0) & (F.size(F.array_except(p, q)) == 0)
    subset = within(x, y, u, v) | within(y, x, v, u)
    rest = F.least(F.lit(lx.NAME_FUZZY), _ratio(a, b)) if fuzzy else F.lit(0.0)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(subset | acronym_match(a, b, parts), lx.NAME_SUBSET).otherwise(rest)


def temporal_proximity(a: Column, b: Column) -> Column:
    days = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86400e6
    return F.coalesce(F.exp(-days / lx.DECAY_DAYS), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors rescaled to 0..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + 1) / 2))).otherwise(0.0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def noisy_or(confidence: Column) -> Column:
    """Aggregate: the chance that any of independent reports holds, capped."""
    return F.least(F.lit(lx.NOISY_CAP), 1 - F.product(1 - clamp(confidence)))


def pair_score(features: dict[str, Column]) -> Column:
    return sum((F.lit(w) * features[k] for k, w in lx.WEIGHTS.items()), F.lit(0.0))


def decision(score: Column, vetoed: Column) -> Column:
    return F.when(vetoed | (score < lx.REVIEW), "no_match").when(score >= lx.MATCH, "match").otherwise("review")


def _two_places(x: Column, before: str, after: str) -> Column:
    """before%.2fafter of a number. Formatting is slow, so the usual case looks the text up: 0 to 1 and not near a tie."""
    up = x * 100 + 0.5
    clear = x.between(0, 1) & (F.abs(up - F.rint(up)) > 1e-6)
    texts = F.array(*[F.lit(f"{before}{k / 100:.2f}{after}") for k in range(101)])
    return F.when(clear, F.get(texts, F.floor(up).cast("int"))).otherwise(F.format_string(f"{before}%.2f{after}", x))


def explanation(features: dict[str, Column], veto: Column) -> Column:
    """The veto, or the positive terms of the score, heaviest first."""
    terms = [F.when(features[k] > 0, _two_places(features[k], f"{k}=", f"x{w:.2f}")) for k, w in sorted(lx.WEIGHTS.items(), key=lambda x: -x[1])]
    return F.coalesce(veto, F.concat_ws(" + ", *terms))
