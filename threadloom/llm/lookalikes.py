"""Problem 3: text that looks the same is made of different characters.

Method: look-alike pairs of strings and code points are joined by union-find into transitive classes; each class
is represented by the member most frequent in the corpus; texts are rewritten greedily, longest match first, by a
multi-pattern automaton until nothing changes.

The pairs come from rules over the Unicode database (canonical and width equivalents, ligatures, blanks,
invisible characters) and from the short table of letters below that have the same shape in Latin, Greek and
Cyrillic type. Letters that only resemble each other (l and I, 0 and O, rn and m) are different letters.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import StageTables

# Letters of the same shape, each written Latin first, then Cyrillic and Greek look-alikes.
SAME_SHAPE = (
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YҮΥ ZΖ "
    "aа cсϲ dԁ eе gց hһ iі jјϳ lӏ oоο pрρ qԛ sѕ vѵν wԝ xх yу "
    "ÏЇΪ ïїϊ ËЁ ëё ĂӐ ăӑ ÄӒ äӓ ÆӔ æӕ ÖӦ öӧ ŸΫ ÜӰ ÿӱ ƏӘ əә"
).split()
# Signs of the same shape.
SAME_SIGN = ("-‐‑", ";;", "··", "'ʹʹ", "ΩΩ", "µμ", "KK", "ÅÅ")
#: Blanks of any width are one blank.
BLANKS = "               　"


def _invisible(cp: int) -> bool:
    """Format characters and variation selectors that leave no ink and no space."""
    if cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return True
    # prepended number signs of Arabic, Syriac and Kaithi script are format characters but visible
    visible = 0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or 0xFFF9 <= cp <= 0xFFFB
    return unicodedata.category(chr(cp)) == "Cf" and not visible


@functools.cache
def lookalike_pairs() -> tuple[tuple[str, str], ...]:
    """Pairs of strings that look the same."""
    pairs = [(w[0], x) for w in (*SAME_SHAPE, *SAME_SIGN) for x in w[1:]]
    pairs += [(" ", b) for b in BLANKS]
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF or 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp <= 0xDFFFF:
            continue
        ch = chr(cp)
        if _invisible(cp):
            pairs.append((ch, ""))
            continue
        d = unicodedata.decomposition(ch)
        if not d:
            continue
        tag, _, rest = d.rpartition(">")
        to = "".join(chr(int(x, 16)) for x in rest.split())
        if not tag:  # canonical: the composed letter and every partly decomposed spelling of it
            pairs.append((ch, unicodedata.normalize("NFD", ch)))
            pairs.append((ch, to))
        elif tag in ("<wide", "<narrow") or tag == "<noBreak" and ch not in BLANKS:
            pairs.append((ch, to))
        elif tag == "<compat" and len(to) > 1 and all(c.isalpha() for c in to) and unicodedata.category(ch)[0] == "L":
            pairs.append((ch, to))  # ligatures and digraph letters
    return tuple(dict.fromkeys((a, b) for a, b in pairs if a != b))


def lookalike_classes(pairs=None) -> list[list[str]]:
    """Transitive classes of the pairs by union-find over strings."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs or lookalike_pairs():
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    classes: dict[str, list[str]] = {}
    for x in parent:
        classes.setdefault(find(x), []).append(x)
    return [sorted(c) for c in classes.values()]


def _strings() -> list[str]:
    return sorted(m for c in lookalike_classes() for m in c if len(m) > 1)


def corpus_counts(texts: DataFrame) -> dict[str, int]:
    """How often each code point and each string of a class stands in the string columns of a table.

    All rows are counted; what comes to the driver is one number for each code point and string, so at most as
    many as Unicode has, whatever the size of the corpus.
    """
    cols = [F.col(c) for c in texts.columns]

    def count(batches):
        strings = _strings()
        total = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        found: dict[str, int] = {}
        for pdf in batches:
            t = "\n".join(x for c in pdf.columns for x in pdf[c] if x)
            cps = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            here = np.bincount(cps, minlength=len(total)) if len(cps) else np.zeros_like(total)
            total += here
            for s in strings:
                if all(here[ord(ch)] for ch in s):
                    n = t.count(s)
                    if n:
                        found[s] = found.get(s, 0) + n
        seen = np.flatnonzero(total)
        seen = seen[(seen < 0xD800) | (seen > 0xDFFF)]
        yield pd.DataFrame({"item": [*(chr(c) for c in seen), *found], "n": [*total[seen].tolist(), *found.values()]})

    return {r["item"]: r["n"] for r in texts.select(*cols).mapInPandas(count, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")).collect()}


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative, for members other than the representative.

    The representative is the most frequent member; a class of invisible characters has the empty string. Ties go
    to the shorter, then to the smaller code points. Members with a character that the corpus lacks need no rule:
    a representative's characters are in the corpus, so no rewriting brings a missing one in.
    """
    out: dict[str, str] = {}
    for members in lookalike_classes():
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), len(m), m))
        out |= {m: best for m in members if m != best and m and all(counts.get(c, 0) for c in m)}
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton, repeated until the text stays as it is."""

    def __init__(self, rules: dict[str, str]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for member, to in rules.items():
            self.auto.add_word(member, (len(member), to))
        if rules:
            self.auto.make_automaton()
        self.empty = not rules

    def once(self, text: str) -> str:
        parts, at = [], 0
        for end, (n, to) in self.auto.iter_long(text):
            parts.append(text[at : end - n + 1])
            parts.append(to)
            at = end + 1
        if not parts:
            return text
        parts.append(text[at:])
        return "".join(parts)

    def __call__(self, text: str | None) -> str | None:
        if text is None or self.empty:
            return text
        # every pass but the last removes an invisible character, shortens the text or moves a letter to its
        # representative for good; marks that an earlier pass brought together compose in the next
        seen = {text}
        while (new := self.once(text)) not in seen:
            seen.add(new)
            text = new
        return new


_built: dict[tuple, tuple] = {}


def _rewriter(items: tuple):
    """The rewriter, and a test that tells texts it may change; both are kept per Python worker."""
    if items not in _built:
        _built.clear()
        rules = dict(items)
        # every member has a character beyond ASCII but for few, so that a text can be told by one character class
        marks = {next((c for c in m if ord(c) > 127), m[0]) for m in rules}
        test = re.compile("[" + "".join(map(re.escape, sorted(marks))) + "]") if marks else re.compile("(?!)")
        _built[items] = Rewriter(rules), test.search
    return _built[items]


def normalise_lookalikes(df: DataFrame, columns: list[str], rules: dict[str, str]) -> DataFrame:
    """df with each of the columns rewritten; null stays null, an empty text empty, other columns as they are."""
    items = tuple(sorted(rules.items()))

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        new, may = _rewriter(items)
        return s.map(lambda t: new(t) if t is not None and may(t) else t).astype(object)

    return df.withColumns({c: rewrite(F.col(c)) for c in columns})


def lookalike_pairs_of_rows(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose columns all look the same while some differ in characters.

    A null column looks like another null only; rows with a null id are left out; a row delivered twice counts
    once. Texts are read twice, for the counts and for the hashes, and never shuffled: what is shuffled is the id
    with a 128-bit hash of the spelling and one of the look.
    """
    texts = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).where("id is not null")
    cols = [f"c{i}" for i in range(len(columns))]
    items = tuple(sorted(rewriting(corpus_counts(texts.select(*cols))).items()))

    def keys(batches):
        new, may = _rewriter(items)
        join = lambda parts: xxhash.xxh3_128_digest("\0".join("n" if t is None else "t" + t for t in parts).encode("utf-8", "surrogatepass"))
        for pdf in batches:
            raw = list(zip(*(pdf[c] for c in cols)))
            look = [tuple(new(t) if t is not None and may(t) else t for t in row) for row in raw]
            spelling = [join(r) for r in raw]
            yield pd.DataFrame({"id": pdf["id"], "raw": spelling, "look": [h if a == b else join(b) for h, a, b in zip(spelling, raw, look)]})

    t = texts.mapInPandas(keys, "id string, raw binary, look binary")
    t = StageTables(df.sparkSession, "looks").write(t, "keys")  # the pass over the texts is done once
    mixed = t.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look")
    t = t.join(mixed, "look").distinct()
    b = t.select("look", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return t.join(b, "look").where("id < id_b and raw <> raw_b").select(F.col("id").alias("id_a"), "id_b").distinct()


def p3_found(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/articles.parquet").select("article_id", "title", "body")
    p = lookalike_pairs_of_rows(a, "article_id", ["title", "body"])
    return p.select(F.col("id_a").alias("article_id_a"), F.col("id_b").alias("article_id_b"))


def p3_normal_form(spark, sf_dir):
    """Each article's title and a fingerprint of its body in the one form, and whether either was changed."""
    a = spark.read.parquet(f"{sf_dir}/articles.parquet").select("article_id", "title", "body").distinct()
    rules = rewriting(corpus_counts(a.select("title", "body")))
    n = normalise_lookalikes(a.withColumns({"t0": F.col("title"), "b0": F.col("body")}), ["title", "body"], rules)
    return n.select(
        "article_id", "title", F.sha1("body").alias("body_sha1"), (~(F.col("title").eqNullSafe(F.col("t0")) & F.col("body").eqNullSafe(F.col("b0")))).alias("changed")
    )


QUERIES = {"p3_found": p3_found, "p3_normal_form": p3_normal_form}
SQL: dict[str, str] = {}
