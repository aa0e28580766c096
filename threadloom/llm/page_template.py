"""Problem 2: the site's own furniture around and inside the story of a web page.

Method: site template removal. A page's lines are its elements: a recurring line that is usually followed by
headlines opens a list subtree, which reaches to the next recurring line and holds the lines between as its items; a
line is a subtree of its own; a line of items between separators has the items as children, a line 'label: value' the
label. Every subtree is hashed with the page's headline, the site's name and numbers left open; the hashes are counted
per host over different pages, and subtrees that recur across many pages of the host are deleted, whatever hangs on
them included. Nothing else is deleted from a page that has a headline of its own; a page without one (a section
front) is template as a whole. One check follows: a sentence inside a list subtree that names whom the story names is
the story going on.

Only hashes are shuffled for the counts; a page's text moves with the short list of its own recurring hashes.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import StageTables

#: A subtree belongs to the template if it stands on at least so many pages of the host and on this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.01
#: The same over all hosts, for hosts with few pages: pages and hosts.
ALL_PAGES, ALL_HOSTS = 12, 3
#: A recurring line opens a list if this share of its followers are headlines.
OPENS = 0.5
#: Capitalised words on this share of the pages are words, not names.
COMMON = 0.01

_SEPARATOR = re.compile(r"\s+[|/·›»>•]\s+|\s{2,}|\s+[-–—]\s+(?=\S+(?:\s+[|/·›»>•-]|$))|\t")
_BULLET = re.compile(r"^(?:[•‣▪◦*·–—-]|\d{1,3}[.)])\s+")
_END = re.compile(r"""[.!?…]["'”’“»›)\]]*$""")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{text}") - (1 << 63)


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", url or "")
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def headline_lines(lines: list[str], title: str | None, source: str | None, url: str | None) -> set[int]:
    """Places of the lines that are the page's headline: the title with or without the site's name after it, or the
    words of the address."""
    want = set()
    t = _squeeze(title or "")
    if t:
        want.add(t.casefold())
        for sep in (" | ", " - ", " – ", " — ", " · ", " :: ", " » "):
            if sep in t:
                head, _, tail = t.rpartition(sep)
                s = _squeeze(source or "").casefold()
                if s and (tail.casefold() in s or s in tail.casefold()):
                    want.add(_squeeze(head).casefold())
    # the name of a section is a title as well, but no headline
    want = {w for w in want if w.count(" ") >= 2}
    found = {i for i, l in enumerate(lines) if _squeeze(l).casefold() in want}
    if found:
        return found
    path = re.sub(r"[?#].*$", "", url or "").rstrip("/").rpartition("/")[2]
    slug = re.sub(r"-?\d+$", "", re.sub(r"\.\w{2,5}$", "", path.lower())).strip("-")
    if slug.count("-") < 2:
        return set()
    return {i for i, l in enumerate(lines) if len(l) > 15 and (_slug(l).startswith(slug) or (slug.startswith(_slug(l)) and _slug(l).count("-") >= 3))}


class Page:
    """The elements of a page with the hashes of their subtrees."""

    def __init__(self, body: str, title: str | None, source: str | None, url: str | None, common: frozenset = frozenset()):
        self.common = common
        self.lines = body.split("\n")
        self.full = [i for i, l in enumerate(self.lines) if l.strip()]
        self.heads = headline_lines(self.lines, title, source, url)
        site = _squeeze(source or "").casefold()
        heads = {_squeeze(self.lines[i]).casefold() for i in self.heads}
        self.text = {i: _squeeze(self.lines[i]) for i in self.full}
        self.sigs: dict[int, list[tuple[str, int]]] = {}
        for i in self.full:
            t = self.text[i].casefold()
            for h in heads:
                if h in t and h != t:
                    t = t.replace(h, "{headline}")
            m = t.replace(site, "{site}") if len(site) > 3 else t
            m = re.sub(r"\d+", "0", m)
            out = [("line", _hash("line", _BULLET.sub("", m) if m[:1] not in "0" else m))]
            parts = [p.strip() for p in _SEPARATOR.split(re.sub(r"\d+", "0", self.lines[i].strip().casefold().replace(site, "{site}") if len(site) > 3 else self.lines[i].strip().casefold()))]
            parts = ["{headline}" if p in heads else p for p in parts if p]
            if len(parts) > 1:
                out += [("child", _hash("line", p)) for p in parts]
            label, colon, value = m.partition(":")
            if colon and 2 < len(label) <= 40 and value.strip() and not value.startswith("//"):
                out.append(("label", _hash("label", label.strip())))
            self.sigs[i] = out

    def followers(self) -> dict[int, int]:
        """Hash of a line -> whether the line after it looks like a headline of another page."""
        out = {}
        for i, j in zip(self.full, self.full[1:]):
            t = _BULLET.sub("", self.text[j])
            out[self.sigs[i][0][1]] = int(j not in self.heads and not _END.search(t) and len(t.split()) >= 4 and not _SEPARATOR.search(self.lines[j].strip()))
        return out

    def names(self, i: int) -> set[str]:
        return {w for w in _WORD.findall(self.text[i]) if w[:1].isupper() and len(w) > 3 and w not in self.common}

    def furniture(self, template: set[int], opens: set[int]) -> set[int]:
        """Places of the lines that belong to recurring subtrees, and of all lines if the page has no headline of its own."""
        heads = {i for i in self.heads if self.sigs[i][0][1] not in template}
        if not heads:
            return set(self.full)
        own: set[str] = set().union(*(self.names(i) for i in heads))
        gone: set[int] = set()
        listed, other, held = False, set(), []
        for i in self.full:
            sig = self.sigs[i]
            line = sig[0][1]
            children = [h for k, h in sig if k == "child"]
            if i in heads:
                listed = False
            elif line in template:
                gone.add(i)
                listed, other, held = line in opens, set(), []
            elif (len(children) > 1 and sum(h in template for h in children) * 2 >= len(children)) or any(k == "label" and h in template for k, h in sig):
                gone.add(i)
            elif not listed:
                own |= self.names(i)
            elif self.resumes(i, own, other):
                # the story goes on after a list inside it; the unpunctuated line before it is its subhead
                listed = False
                own |= self.names(i)
                gone.difference_update(j for j in held if not self.names(j) - own)
            else:
                gone.add(i)
                if not self.sentence(i):
                    other |= self.names(i)
                    held = [i] if not _BULLET.match(self.text[i]) and self.names(i) and not self.names(i) - own else []
        return gone

    def sentence(self, i: int) -> bool:
        return bool(_END.search(self.text[i])) and len(self.text[i].split()) >= 4

    def resumes(self, i: int, own: set[str], other: set[str]) -> bool:
        """The exact check of a line in a list subtree: a sentence that names whom the story names, and not the list."""
        n = self.names(i)
        mine, theirs = len(n & (own - other)), len(n & (other - own))
        return self.sentence(i) and not ((theirs >= mine or not mine) and (theirs or not n & own))


_ARGS = ("body", "title", "source", "url")


def _subtrees(batches):
    for pdf in batches:
        rows = []
        for page, host, *args in zip(pdf["id"], pdf["host"], *(pdf[a] for a in _ARGS)):
            p = Page(*args)
            follow = p.followers()
            for h in {h for s in p.sigs.values() for _, h in s}:
                rows.append((page, host, h, follow.get(h, 0), int(h in follow)))
        yield pd.DataFrame(rows, columns=["id", "host", "sig", "heads", "followed"])


def _furniture(common: frozenset):
    def run(batches):
        for pdf in batches:
            rows = []
            for page, template, opens, *args in zip(pdf["id"], pdf["template"], pdf["opens"], *(pdf[a] for a in _ARGS)):
                p = Page(*args, common)
                gone = p.furniture(set() if template is None else set(template), set() if opens is None else set(opens))
                rows += [(page, i) for i in sorted(gone)]
            yield pd.DataFrame(rows, columns=["id", "line_no"]).astype({"line_no": "int32"})

    return run


def common_words(pages: DataFrame) -> frozenset:
    """Capitalised words on at least COMMON of all pages, so at most 1 / COMMON times the words of a page: they name
    nobody. They are counted over all pages."""
    def words(batches):
        for pdf in batches:
            yield pd.DataFrame({"word": [w for b in pdf["body"] for w in {w for w in _WORD.findall(b) if w[:1].isupper() and len(w) > 3}]})

    n = pages.count()
    w = pages.select("body").mapInPandas(words, "word string").groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r["word"] for r in w.where(F.col("n") >= max(10, COMMON * n)).select("word").collect())


def pages_of(articles: DataFrame, fetch_results: DataFrame) -> DataFrame:
    """(id, body, title, source, url, host) of the articles that a download brought, each once."""
    f = fetch_results.where("article_id is not null").groupBy("article_id").agg(F.min("url").alias("f_url"))
    a = articles.select("article_id", "body", "title", "source", "url").where("body is not null and article_id is not null")
    p = a.join(f, "article_id").select(F.col("article_id").alias("id"), "body", "title", "source", F.coalesce("f_url", "url").alias("url"))
    host = F.lower(F.regexp_replace(F.regexp_extract("url", r"//(?:[^/@?#]*@)?([^/:?#\s]+)", 1), r"^(?i:www\.)", ""))
    # a row delivered again has the same fields; should it differ, each of the two bodies counts
    return p.withColumn("host", F.coalesce(F.nullif(host, F.lit("")), F.col("source"), F.lit(""))).dropDuplicates(["id", "body"])


def template_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the non-blank lines that lie in recurring subtrees of the page's host.

    pages: id, body, title, source, url, host. A page without a headline of its own (a section front, or a story
    whose title and address name no line) has no story, so all its lines are given. A line that recurs nowhere and
    hangs on no recurring list stays, so pages of a host with very few pages keep more. Null titles, sources and urls
    are allowed; a blank body gives no rows. A host's number of pages has no limit: hashes are counted with
    map-side combining.
    """
    keep = StageTables(pages.sparkSession, "pages")
    pages = keep.write(pages, "pages")
    s = keep.write(pages.mapInPandas(_subtrees, "id string, host string, sig long, heads int, followed int"), "subtrees")
    n = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    per = s.groupBy("host", "sig").agg(F.count("*").alias("n"), F.sum("heads").alias("heads"), F.sum("followed").alias("followed"))
    every = per.groupBy("sig").agg(F.sum("n").alias("all_n"), F.count("*").alias("hosts"), F.sum("heads").alias("all_heads"), F.sum("followed").alias("all_followed"))
    every = every.where(F.col("all_n") >= MIN_PAGES)
    t = per.join(every, "sig").join(n, "host").where(
        ((F.col("n") >= MIN_PAGES) & (F.col("n") >= MIN_SHARE * F.col("host_pages"))) | ((F.col("all_n") >= ALL_PAGES) & (F.col("hosts") >= ALL_HOSTS))
    )
    t = t.select("host", "sig", ((F.col("all_followed") > 0) & (F.col("all_heads") >= OPENS * F.col("all_followed"))).alias("opens"))
    of = s.select("id", "host", "sig").join(t, ["host", "sig"])
    of = of.groupBy("id").agg(F.collect_set("sig").alias("template"), F.collect_set(F.when(F.col("opens"), F.col("sig"))).alias("opens"))
    return pages.join(of, "id", "left").select("id", "template", "opens", *_ARGS).mapInPandas(_furniture(common_words(pages)), "id string, line_no int").distinct()


def main_text(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """(id, main): the pages' bodies without the furniture, blank lines squeezed."""
    gone = furniture.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    line = F.transform(F.split("body", "\n", -1), lambda x, i: F.when(~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i.cast("int")) & (F.trim(x) != ""), x))
    return pages.join(gone, "id", "left").select("id", F.array_join(F.array_compact(line), "\n").alias("main"))


def _pages(spark, sf_dir):
    return pages_of(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("articles", "fetch_results")])


def p2_found(spark, sf_dir):
    return template_lines(_pages(spark, sf_dir)).select(F.col("id").alias("article_id"), "line_no")


def p2_main_text(spark, sf_dir):
    """Size of each page's main text."""
    p = _pages(spark, sf_dir)
    m = main_text(p, template_lines(p))
    return m.select(F.col("id").alias("article_id"), F.length("main").alias("main_chars"), F.sha1("main").alias("main_sha1"))


QUERIES = {"p2_found": p2_found, "p2_main_text": p2_main_text}
SQL: dict[str, str] = {}
