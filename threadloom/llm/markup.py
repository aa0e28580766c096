"""Problem 4: HTML, Markdown, wiki and LaTeX markup left in documents.

Method: a recurrent block labeller. A document is a sequence of leaf blocks (lines, cut again where a tag, a command or
a possible formula begins); each leaf has a vector of its tag path, of its hashed words and signs, and of its shape; a
bidirectional LSTM written in numpy reads the whole sequence and labels every leaf with the context of the whole
document. An element is counted where the labeller lets it begin. The grammars convert the leaves that it labels, and
an exact check follows: a labelled document without any sign of the four languages in its labelled leaves has no markup.

The weights beside this file are made by markup_train.py from documents it writes itself.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("plain", "inline", "other", "heading", "list_item", "code", "code_in", "formula", "formula_in")
#: Labels with which an element begins, and the element.
BEGINS = {3: "heading", 4: "list_item", 5: "code_block", 7: "formula"}
WORD_DIMS, PATH_DIMS, SHAPE_DIMS, HIDDEN = 64, 16, 32, 32
INPUT = WORD_DIMS + PATH_DIMS + SHAPE_DIMS
#: Texts without any of these hold no markup of the four languages, so they need no labelling.
TRIGGER = (
    r"(?m)<[A-Za-z/!]|&#?\w+;|\\[A-Za-z\[\](){}$&%#_]|[`~]{2}|`|\$\S|\[\[|\]\]|\]\(|\[https?:|\{\{|\{\||''|\*\*|__|(?<!\w)[*_]\w|\w[*_](?!\w)"
    r"|^[ \t]*(?:#{1,6}|={2,}|-{3,}|[*+-][ \t]|\d{1,9}[.)][ \t]|[>|])|^[*#:;]|^(?: {4}|\t)"
)
_TOKEN = re.compile(r"\\[A-Za-z]+\*?|</?[A-Za-z][A-Za-z0-9]*|<!--|-->|&#?\w+;|[#=*~`$_'|>\[\]{}\\:^-]+|[^\W\d_]+|\d+")
_OPEN = re.compile(r"<(/?)(pre|code|syntaxhighlight|source|script|style|ul|ol|table|blockquote|div|math)\b[^>]*?(/?)>|\\(begin|end)\{(\w+)\*?\}|(\{\||\|\})", re.I)
_START = ("#", "=", "*", "-", "+", ">", "|", "<", "\\", "$", "`", "~", " ", "\t", "{", ":", "[", "&", "'")
_BLOCK_TAG = r"h[1-6]|li|ul|ol|pre|code|math|p|div|script|style|table|tr|blockquote|syntaxhighlight|source"
#: What may be a formula is a leaf of its own; tags of blocks and commands of structure begin one.
_FORMULA = r"\$\$(?=\s*\S)[^$]+?\$\$|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<![\s\\])\$(?![\w$])|\\\((?s:.+?)\\\)|\\\[(?s:.+?)\\\]"
_CUT = re.compile(rf"\n|(?P<formula>{_FORMULA})|(?:<|&lt;)/?(?i:{_BLOCK_TAG})\b|\\(?:item|(?:sub)*section|chapter|(?:sub)?paragraph|begin|end)\b")


def leaves(text: str) -> list[tuple[int, int]]:
    """(start, end) of the leaf blocks in order; together they are the text without its line ends."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        a, b = m.span()
        if text[a] == "\n":
            out.append((at, a))
            at = b
        elif m["formula"]:
            if a > at:
                out.append((at, a))
            out.append((a, b))
            at = b
        elif a > at:
            out.append((at, a))
            at = a
    out.append((at, len(text)))
    return out


@functools.lru_cache(50_000)
def _bucket(token: str) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % WORD_DIMS, 1.0 if h & 0x10000 else -1.0


#: Words of programs keep their form, words of prose are all alike.
_CODE_WORDS = frozenset("select from where def return for if else while import print int var let const function class sum".split())


@functools.lru_cache(50_000)
def _word(token: str) -> str:
    if token[0].isalpha():
        low = token.lower()
        return low if low in _CODE_WORDS else "w" + str(min(len(token), 3)) + ("A" if token[0].isupper() else "a")
    return "0" if token[0].isdigit() else token.lower()[:8]


_NUMBERED = re.compile(r"\s*\d{1,9}[.)]\s")
_SPAN_OPENS, _SPAN_CLOSES = re.compile(r"\$|\\[(\[]"), re.compile(r"\$$|\\[)\]]$")
_MATH_SIGN, _MATH_LETTER = re.compile(r"[\\^_{}=<>+]"), re.compile(r"\$+\s*[A-Za-z]\w?'?\s*\$+")
_BULLET = re.compile(r"[ \t]*[*#+-]+[ \t]*\S")
_EMPHASIS = re.compile(r"(?:^|\W)([*_`'~]{1,3})\S.*\S\1(?:\W|$)")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_START_AT = {c: k for k, c in enumerate(_START)}


def leaf_vectors(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """One row for each leaf: hashed words and signs, tag path, shape."""
    at: list[int] = []
    val: list[float] = []
    path: list[str] = []
    fence, blank_before, size = "", True, len(text)
    for k, (a, b) in enumerate(spans):
        leaf = text[a:b]
        word0, path0, shape0 = k * INPUT, k * INPUT + WORD_DIMS, k * INPUT + WORD_DIMS + PATH_DIMS
        line_start, line_end = a == 0 or text[a - 1] == "\n", b == size or text[b] == "\n"
        for tok in _TOKEN.findall(leaf):
            j, sign = _bucket(_word(tok))
            at.append(word0 + j)
            val.append(sign)
        on = [path0 + zlib.crc32(tag.encode()) % PATH_DIMS for tag in path[-4:] + (["fence"] if fence else [])]
        if line_start:
            on.append(shape0 + 22)
            if blank_before:
                on.append(shape0 + 25)
        if line_end:
            on.append(shape0 + 23)
        body = leaf.strip()
        if not body:
            on.append(shape0 + 19)
        else:
            first, end = leaf[0], body[-1]
            if first in _START_AT:
                on.append(shape0 + _START_AT[first])
            if first == "\t" or leaf[:4] == "    ":
                on.append(shape0 + 24)
            if line_start and _NUMBERED.match(leaf):
                on.append(shape0 + 20)
            at.append(shape0 + 21)
            val.append(min(len(body), 400) / 200)
            if body[0] in "=-*_" and len(body) > 1 and not body.strip(body[0]):
                on.append(shape0 + 26)
            if first in "$\\":
                if _SPAN_OPENS.match(leaf) and _SPAN_CLOSES.search(leaf):
                    on.append(shape0 + 27)
                if _MATH_LETTER.fullmatch(leaf):
                    on.append(shape0 + 28)
                elif _MATH_SIGN.search(leaf[2:-2]):
                    on.append(shape0 + 28)
            if end in ".!?…”\"»":
                on.append(shape0 + 29)
            if line_start and _BULLET.match(leaf):
                on.append(shape0 + 30)
            if ("*" in leaf or "_" in leaf or "`" in leaf or "''" in leaf or "~" in leaf) and _EMPHASIS.search(body):
                on.append(shape0 + 31)
        at += on
        val += [1.0] * len(on)
        if line_start:
            if m := _FENCE.match(leaf):
                fence = "" if fence and m[1].startswith(fence) else fence or m[1][:3]
            blank_before = not body and line_end
        if "<" in leaf or "\\" in leaf or "|" in leaf:
            for close, tag, empty, env, name, table in _OPEN.findall(leaf):
                kind = (tag or name or "wikitable").lower()
                if close or env == "end" or table == "|}":
                    if kind in path:
                        del path[len(path) - 1 - path[::-1].index(kind) :]
                elif not empty and len(path) < 20:
                    path.append(kind)
    out = np.bincount(np.array(at, np.int64), np.array(val), len(spans) * INPUT).astype(np.float32).reshape(len(spans), INPUT)
    words = out[:, :WORD_DIMS]
    words[:] = np.sign(words) * np.log1p(np.abs(words))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Bidirectional LSTM over padded sequences and a linear layer per block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def initial(seed: int = 7) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        w["o"] = rng.normal(0, 0.1, (2 * HIDDEN + INPUT, len(LABELS))).astype(np.float32)
        w["ob"] = np.zeros(len(LABELS), np.float32)
        return w

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (steps, docs, INPUT) in reading order of the direction; a padded step leaves the state as it is."""
        steps, docs, _ = x.shape
        h = np.zeros((docs, HIDDEN), np.float32)
        c = np.zeros_like(h)
        z = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        out = np.empty((steps, docs, HIDDEN), np.float32)
        for t in range(steps):
            a = z[t] + h @ self.w[f"h{d}"]
            i, f, o = (sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((i, f, o, g, c, h, tc, m))
            h = np.where(m, o * tc, h)
            c = np.where(m, c2, c)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if keep is not None else (None, None)
        f = self.run(x, mask, "f", kf)
        b = self.run(x[::-1], mask[::-1], "b", kb)[::-1]
        top = np.concatenate([f, b, x], axis=2)
        if keep is not None:
            keep.update(f=kf, b=kb, top=top)
        return top @ self.w["o"] + self.w["ob"]

    def label(self, docs: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
        """Label of every block of every document; documents of like length are read together."""
        order = sorted(range(len(docs)), key=lambda k: len(docs[k]))
        out: list = [None] * len(docs)
        at = 0
        while at < len(order):
            part = order[at : at + max(1, min(batch, 60_000 // max(1, len(docs[order[min(at + batch, len(order)) - 1]]))))]
            at += len(part)
            x, mask = pad([docs[k] for k in part])
            y = self.logits(x, mask).argmax(2)
            for j, k in enumerate(part):
                out[k] = y[: len(docs[k]), j]
        return out


def pad(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(d) for d in docs)
    x = np.zeros((n, len(docs), INPUT), np.float32)
    mask = np.zeros((n, len(docs)), bool)
    for j, d in enumerate(docs):
        x[: len(d), j] = d
        mask[: len(d), j] = True
    return x, mask


@functools.cache
def trained() -> BiLSTM:
    with np.load(Path(__file__).with_name("markup_weights.npz")) as f:
        return BiLSTM({k: f[k].astype(np.float32) for k in f.files})


# The grammars. Each takes a text and gives the counts of its elements and the clean text.

_HTML_TAG = r"p|div|span|b|i|u|em|strong|a|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|pre|code|table|tr|td|th|thead|tbody|blockquote|script|style|img|section|article|header|footer|figure|figcaption|sup|sub|font|center|small|math|m[a-z]+"
HTML_TAG = re.compile(rf"(?i)</?(?:{_HTML_TAG})(?:\s[^<>]*)?/?>")
_WIKI_OWN = re.compile(r"(?i)</?(?:math|ref|syntaxhighlight|source|pre|nowiki|br|code|sup|sub|references)\b")
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
STRONG = {
    "latex": re.compile(r"\\(?:begin|end|(?:sub)*section\*?|chapter|paragraph|textbf|textit|emph|href|item|cite|ref|label|bf|it|url|footnote|texttt)\b|\\[&%$#_]|\{\\(?:bf|it|em)\b"),
    "wiki": re.compile(r"\[\[[^\[\]\n]+\]\]|'{2,5}[^'\n]+'{2,5}|(?m:^={2,6}[^=\n].*={2,6}\s*$)|\{\{[^{}]+\}\}|(?m:^\{\|)|(?m:^\|\})|\[https?://\S+ [^\]\n]+\]|</?(?:syntaxhighlight|ref|nowiki)\b|(?m:^[*#]{1,6}(?=[^\s*#]))"),
    "markdown": re.compile(r"\]\(\S+?\)|\*\*\S[^*\n]*\*\*|__\S[^_\n]*__|(?<![\w*])\*[^\s*][^*\n]*\*(?![\w*])|(?<![\w_])_[^\s_][^_\n]*_(?![\w_])|(?m:^ {0,3}#{1,6}[ \t]+\S.*$)|(?m:^ {0,3}(?:```|~~~))|`[^`\n]+`|(?m:^> ?\S)|(?m:^\S.*\n(?:={3,}|-{3,})[ \t]*$)|(?m:^\|(?:[ :]*-{2,}[ :]*\|)+)|!\[[^\]\n]*\]\("),
}
_LATEX_MATH = r"equation|align|gather|multline|eqnarray|displaymath|math|flalign"
_DOLLARS = re.compile(r"(?s)(?<!\\)\$\$(?=\s*\S)(.+?)(?<!\\)\$\$")
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
_PAREN = re.compile(r"(?s)(?<!\\)\\\((.+?)\\\)")
_BRACK = re.compile(r"(?s)(?<!\\)\\\[(.+?)\\\]")


def _mathy(s: str) -> bool:
    """What stands between two dollar signs is a formula, not prose between two prices."""
    return bool(re.search(r"[\\^_{}=<>+]", s)) or bool(re.fullmatch(r"\s*[A-Za-z]\w?'?\s*", s))


class Reading:
    def __init__(self) -> None:
        self.n = {"heading": 0, "list_item": 0, "code_block": 0, "formula": 0}
        self.held: list[str] = []

    def hold(self, kind: str, text: str) -> str:
        """Count an element and put it aside, so that nothing later reads inside it."""
        self.n[kind] += 1
        self.held.append(text)
        return f"\x02{len(self.held) - 1}\x03"

    def formulas(self, t: str) -> str:
        t = _DOLLARS.sub(lambda m: self.hold("formula", f"$${m[1].strip()}$$") if _mathy(m[1]) else m[0], t)
        t = _BRACK.sub(lambda m: self.hold("formula", f"$${m[1].strip()}$$"), t)
        t = _PAREN.sub(lambda m: self.hold("formula", f"${m[1].strip()}$"), t)
        return _DOLLAR.sub(lambda m: self.hold("formula", f"${m[1]}$") if _mathy(m[1]) else m[0], t)

    def done(self, t: str) -> str:
        for _ in range(3):
            t = re.sub(r"\x02(\d+)\x03", lambda m: self.held[int(m[1])], t)
        t = re.sub(r"[ \t]+\n", "\n", t)
        return re.sub(r"\n{3,}", "\n\n", t).strip()


def read_html(t: str) -> tuple[dict, str]:
    r = Reading()
    if not HTML_TAG.search(t) and re.search(rf"(?i)&lt;/?(?:{_HTML_TAG})\b", t):
        t = html.unescape(t)
    code = lambda m: "\n" + r.hold("code_block", "```\n" + html.unescape(re.sub(r"<[^>]+>", "", m[1])).strip("\n") + "\n```") + "\n"
    t = re.sub(r"(?is)<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)", code, t)
    t = re.sub(r"(?is)<!--.*?(?:-->|\Z)", "", t)
    t = re.sub(r"(?is)<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", "", t)
    t = re.sub(r"(?is)<code\b[^>]*>([^<]*\n.*?)</code\s*>", code, t)
    math = lambda m: r.hold("formula", "$" + re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", m[1]))).strip() + "$")
    t = re.sub(r"(?is)<math\b[^>]*>(.*?)</math\s*>", math, t)
    t = r.formulas(t)

    def heading(m):
        r.n["heading"] += 1
        return "\n" + "#" * int(m[1]) + " "

    def item(m):
        r.n["list_item"] += 1
        return "\n- "

    t = re.sub(r"(?i)<h([1-6])\b[^>]*>", heading, t)
    t = re.sub(r"(?i)<li\b[^>]*>", item, t)
    t = re.sub(r"(?i)</(?:p|div|h[1-6]|ul|ol|table|blockquote|section|article)\s*>|<br\s*/?>|</tr\s*>", "\n", t)
    t = re.sub(r"(?i)</t[dh]\s*>", " ", t)
    return r.n, r.done(html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", t)))


def read_latex(t: str) -> tuple[dict, str]:
    r = Reading()
    t = re.sub(r"(?s)\\begin\{(verbatim|lstlisting|minted|alltt|Verbatim)(\*?)\}(?:\[[^\]\n]*\])?(?:\{\w+\})?(.*?)\\end\{\1\2\}", lambda m: r.hold("code_block", "```\n" + m[3].strip("\n") + "\n```"), t)
    t = re.sub(r"(?m)(?<!\\)%.*$", "", t)
    t = re.sub(rf"(?s)\\begin\{{({_LATEX_MATH})(\*?)\}}(.*?)\\end\{{\1\2\}}", lambda m: r.hold("formula", f"$${m[3].strip()}$$"), t)
    t = r.formulas(t)

    def heading(m):
        r.n["heading"] += 1
        level = {"part": 1, "chapter": 1, "section": 2, "subsection": 3}.get(m[1], 4)
        return "#" * level + " " + m[2]

    t = re.sub(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", heading, t)

    def item(m):
        r.n["list_item"] += 1
        return "- "

    t = re.sub(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*", item, t)
    t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:cite|ref|label|footnotemark|index)\w*\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\]|\{[^{}]*\})*", "", t)
    t = re.sub(r"\{\\(?:bf|it|em|tt|sc|rm)\s+([^{}]*)\}", r"\1", t)
    for _ in range(3):
        t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"``([^`'\n]+)''", r"“\1”", t)
    t = re.sub(r"\\\\", "\n", t)
    t = re.sub(r"\\([&%$#_{}])", r"\1", t)
    return r.n, r.done(re.sub(r"\\[A-Za-z]+\*? ?", "", t))


def read_wiki(t: str) -> tuple[dict, str]:
    r = Reading()
    t = re.sub(r"(?is)<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1\s*>", lambda m: r.hold("code_block", "```\n" + m[2].strip("\n") + "\n```"), t)
    t = re.sub(r"(?is)<math\b[^>]*>(.*?)</math\s*>", lambda m: r.hold("formula", f"${m[1].strip()}$"), t)
    t = re.sub(r"(?is)<!--.*?-->|<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", "", t)

    def item(m):
        r.n["list_item"] += 1
        return "- "

    t = re.sub(r"(?m)^[*#:;]*[*#][ \t]*(?=\S)", item, t)
    def heading(m):
        r.n["heading"] += 1
        return "#" * len(m[1]) + " " + m[2].strip()

    t = re.sub(r"(?m)^(={1,6})[ \t]*([^=\n](?:.*[^=\n])?)[ \t]*\1[ \t]*$", heading, t)

    t = re.sub(r"(?m)^[:;]+[ \t]*", "", t)
    t = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|File|Image|Datei|Fichier|Archivo):[^\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"\{\{quote\|([^{}]*)\}\}", r"\1", t, flags=re.I)
    t = re.sub(r"\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"(?m)^(?:\{\|.*|\|\}|\|-.*)$\n?", "", t)
    t = re.sub(r"(?m)^[|!] ?", "", t).replace("||", " ")
    return r.n, r.done(html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", re.sub(r"'{2,5}", "", t))))


def read_markdown(t: str) -> tuple[dict, str]:
    r = Reading()
    t = re.sub(r"(?ms)^([ \t]*)(`{3,}|~{3,})[^\n]*\n(.*?)(?:^[ \t]*\2[`~]*[ \t]*$|\Z)", lambda m: r.hold("code_block", f"```\n{m[3].rstrip()}\n```"), t)
    lines, out, k = t.split("\n"), [], 0
    in_list = False
    while k < len(lines):
        line = lines[k]
        indented = re.match(r"(?: {4}|\t)\s*\S", line)
        if indented and not in_list and (k == 0 or not lines[k - 1].strip()):
            end = k
            while end < len(lines) and (re.match(r"(?: {4}|\t)", lines[end]) or not lines[end].strip()):
                end += 1
            while not lines[end - 1].strip():
                end -= 1
            out.append(r.hold("code_block", "```\n" + "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[k:end]) + "\n```"))
            k = end
            continue
        if re.match(r" {0,3}(?:={2,}|-{2,})[ \t]*$", line) and out and out[-1].strip() and k and lines[k - 1].strip() and not re.match(r"\s*[-*+#>|]", lines[k - 1]):
            r.n["heading"] += 1
            out[-1] = ("# " if "=" in line else "## ") + out[-1]
        elif re.match(r" {0,3}(?:([*_-])[ \t]*)(?:\1[ \t]*){2,}$", line):
            out.append("")
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            r.n["heading"] += 1
            out.append(f"{m[1]} {m[2] or ''}")
        elif m := re.match(r"(?:> ?)?([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)", line):
            r.n["list_item"] += 1
            in_list = True
            out.append(m[1] + "- " + line[m.end() :])
        else:
            if line.strip() and not re.match(r"\s", line):
                in_list = False
            out.append(re.sub(r"^ {0,3}> ?", "", line))
        k += 1
    t = "\n".join(out)
    t = re.sub(r"(`+)([^`\n]+)\1", lambda m: m[2].replace("$", "\\$"), t)
    t = r.formulas(t)
    t = re.sub(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", t)
    t = re.sub(r"\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", t)
    for mark in (r"\*\*\*", r"\*\*", r"__", r"\*", r"_"):
        t = re.sub(rf"(?<![\w\\]){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", t)
    t = re.sub(r"(?m)^\|(?:[ :]*-{2,}[ :]*\|)+[ \t]*$\n?", "", t)
    t = re.sub(r"\\([\\`*_{}\[\]()#+.!$&~|<>-])", r"\1", t)
    return r.n, r.done(html.unescape(re.sub(r"</?[A-Za-z][^<>\n]*>", "", t)))


READERS = {"html": read_html, "latex": read_latex, "wiki": read_wiki, "markdown": read_markdown}


def language_of(text: str) -> tuple[str | None, int]:
    """The markup language whose signs are most, and how many there are; none without any sign."""
    tags = len(HTML_TAG.findall(text))
    own = len(_WIKI_OWN.findall(text))
    escaped = 0 if tags else len(re.findall(rf"(?i)&lt;/?(?:{_HTML_TAG})\b", text))
    quotes = re.compile(r"``[^`'\n]+''")  # LaTeX's quotes end as wiki emphasis begins
    n = {k: len(p.findall(quotes.sub("", text))) for k, p in STRONG.items()}
    n["latex"] += len(quotes.findall(text))
    n["html"] = max(0, tags - (own if n["wiki"] or own == tags and re.search(r"<(?:math>|ref|syntax)", text) else 0)) + escaped
    if n["wiki"] == 0 and own and not n["html"]:
        n["wiki"] = own
    r = Reading()
    r.formulas(text)
    entities = len(ENTITY.findall(text))
    best = max(("html", "wiki", "latex", "markdown"), key=lambda k: n[k])
    if n[best]:
        # emphasis by one star or underscore is Markdown's, unless another language has as many signs
        return best, n[best]
    if entities:
        return "html", entities
    if r.n["formula"]:
        return "markdown", r.n["formula"]
    return None, 0


def element_counts(labels: np.ndarray) -> dict[str, int]:
    """How many elements of each kind the labels let begin."""
    return {name: int((labels == k).sum()) for k, name in BEGINS.items()}


def converted(text: str, spans: list[tuple[int, int]], labels: np.ndarray) -> tuple[str | None, str]:
    """Language of the labelled leaves and the text with each run of them converted by the language's grammar.

    None and the text as it is if the labelled leaves show no sign of a language.
    """
    runs: list[list[int]] = []
    last, held = -2, -2
    for k, (a, b) in enumerate(spans):
        if labels[k]:
            if held == k - 1 and runs:
                runs[-1][1] = b
            else:
                runs.append([a, b])
            held = k
        elif held == k - 1 and not text[a:b].strip():  # a blank line parts no run
            held = k
    lang, _ = language_of("\n".join(text[a:b] for a, b in runs)) if runs else (None, 0)
    if lang is None:
        return None, text
    out, last = [], 0
    for a, b in runs:
        out += [text[last:a], READERS[lang](text[a:b])[1]]
        last = b
    return lang, re.sub(r"\n{3,}", "\n\n", "".join([*out, text[last:]])).strip()


def _read(batches):
    net = trained()
    for pdf in batches:
        cut = [leaves(t) for t in pdf["text"]]
        labels = net.label([leaf_vectors(t, c) for t, c in zip(pdf["text"], cut)])
        rows = []
        for i, t, c, y in zip(pdf["id"], pdf["text"], cut, labels):
            lang, clean = converted(t, c, y)
            n = element_counts(y)
            rows.append((i, lang, n["heading"], n["list_item"], n["code_block"], n["formula"], clean))
        yield pd.DataFrame(rows, columns=["id", "language", "heading", "list_item", "code_block", "formula", "clean"])


def clean_markup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, language, heading, list_item, code_block, formula, clean) for each row with a text that may hold markup.

    language is null and the text unchanged where no language's signs are found. Null texts and ids and
    texts without any sign of the four languages are left out; repeated rows give repeated rows; an unclosed code
    block reaches to the end of the text. Other columns are ignored.
    """
    t = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    t = t.where(F.col("text").rlike(TRIGGER))
    return t.mapInPandas(_read, "id string, language string, heading int, list_item int, code_block int, formula int, clean string")


def non_pages(articles: DataFrame, fetch_results: DataFrame) -> DataFrame:
    """Articles that no download brought."""
    f = fetch_results.where("article_id is not null").select("article_id").distinct()
    a = articles.select("article_id", "body").where(F.col("body").rlike(TRIGGER))
    return a.join(f, "article_id", "left_anti").dropDuplicates(["article_id", "body"])


def _articles(spark, sf_dir):
    return non_pages(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("articles", "fetch_results")])


def p4_found(spark, sf_dir):
    d = clean_markup(_articles(spark, sf_dir), "article_id", "body").where("language is not null").drop("clean")
    none = F.array().cast("array<struct<element:string,ordinal:int>>")

    def numbered(kind):
        return F.when(F.col(kind) > 0, F.transform(F.sequence(F.lit(1), F.col(kind)), lambda o: F.struct(F.lit(kind).alias("element"), o.alias("ordinal")))).otherwise(none)

    first = F.array(F.struct(F.lit("markup").alias("element"), F.lit(0).alias("ordinal")))
    each = F.concat(first, *[numbered(k) for k in ("heading", "list_item", "code_block", "formula")])
    return d.select(F.col("id").alias("article_id"), F.explode(each).alias("e")).select("article_id", "e.element", "e.ordinal").distinct()


def p4_languages(spark, sf_dir):
    """Articles and elements by markup language."""
    d = clean_markup(_articles(spark, sf_dir), "article_id", "body").where("language is not null")
    return d.groupBy("language").agg(F.countDistinct("id").alias("articles"), *[F.sum(k).alias(f"{k}s") for k in ("heading", "list_item", "code_block", "formula")])


QUERIES = {"p4_found": p4_found, "p4_languages": p4_languages}
SQL: dict[str, str] = {}
