"""Writes documents in the four languages and in none, labels their leaves, and trains the labeller on them.

python -m threadloom.llm.markup_train [OUT.npz]
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from threadloom.llm.markup import HIDDEN, LABELS, BiLSTM, leaf_vectors, leaves, pad

L = {k: i for i, k in enumerate(LABELS)}
#: What the rest of an element is once it has begun.
_REST = {"heading": "inline", "list_item": "inline", "code": "code_in", "formula": "formula_in"}


def _word(rng):
    w = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiouáéü") for _ in range(rng.randint(1, 4)))
    if rng.random() < 0.02:
        w = "O'" + w
    return w[0].upper() + w[1:] if rng.random() < 0.3 else w


def _sentence(rng):
    if rng.random() < 0.18:  # short lines without an end
        return " ".join(_word(rng) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", ":", "."])
    s = " ".join(_word(rng) for _ in range(rng.randint(5, 18)))
    extras = (
        (f" ${rng.randint(2, 90)} to ${rng.randint(100, 900)}", 0.06), (" R&D", 0.05), (" & Sons", 0.1), (" “wait”", 0.1), (f" {rng.randint(1, 20)}.{rng.randint(0, 9)} per cent", 0.15),
        (f" ${rng.randint(2, 90)} a tonne", 0.04), (" No. 4 on the list", 0.03), (" x < y", 0.01), (" C# and F*", 0.01), (f" snake_{_word(rng)}_case", 0.01), (" l'" + _word(rng), 0.1), (f" #{_word(rng)}", 0.02), (f" 3 * {rng.randint(2, 9)} * 4", 0.01),
    )
    for extra, p in extras:
        if rng.random() < p:
            s += extra
    return s[:1].upper() + s[1:] + rng.choice([".", ".", ".", ".", "?", "!"])


def _tex(rng):
    v = _word(rng).capitalize()[:9]
    return rng.choice([rf"x_{{{v}}}^2 + \sum_{{i=1}}^{{n}} w_i", rf"\Delta_{{{v}}} = a - b", r"r \leq 0.35", r"g = \frac{a}{b}", rf"g_{{{v}}} = \frac{{x_t - x_0}}{{x_0}}", "n", "a + b", rf"\{{{v}\}}", r"\alpha", "E = mc^2"])


class Text:
    """Pieces of a text with what they are."""

    def __init__(self, escaped=False):
        self.t, self.size, self.begin, self.kind, self.escaped = [], 0, {}, [], escaped

    def add(self, text, kind="plain"):
        if self.escaped:
            text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        if text:
            if kind in _REST:
                self.begin[self.size] = L[kind]
                self.kind.append((self.size, self.size + len(text), L[_REST[kind]]))
            else:
                self.kind.append((self.size, self.size + len(text), L[kind]))
            self.t.append(text)
            self.size += len(text)

    def labelled(self):
        text = "".join(self.t)
        spans = leaves(text)
        y = np.zeros(len(spans), int)
        starts = sorted(self.begin)
        at = 0
        for k, (a, b) in enumerate(spans):
            while at < len(starts) and starts[at] < a:
                at += 1
            if at < len(starts) and starts[at] < b:
                y[k] = self.begin[starts[at]]
            elif text[a:b].strip():
                inside = {lab for s, e, lab in self.kind if s < b and a < e}
                y[k] = next((lab for lab in (L["code_in"], L["formula_in"], L["other"], L["inline"]) if lab in inside), 0)
        return text, spans, y


def _formula(rng, lang):
    tex = _tex(rng)
    if lang == "wiki":
        return f"<math>{tex}</math>"
    if lang == "html":
        return rng.choice([f"\\({tex}\\)", f"<math><mi>{_word(rng)[:2]}</mi><mo>=</mo><mn>{rng.randint(1, 9)}</mn></math>", f"<math><msub><mi>x</mi><mn>{rng.randint(1, 9)}</mn></msub></math>", f"<math><mrow><mi>{_word(rng)}</mi><mo>=</mo><mfrac><mi>a</mi><mi>b</mi></mfrac></mrow></math>", f"<math><msup><mi>{_word(rng)}</mi><mn>2</mn></msup></math>"])
    return rng.choice([f"${tex}$", f"${tex}$", f"\\({tex}\\)"])


def _inline(rng, lang, to, share=0.9):
    """A sentence with marks in the running text, formulas among them."""
    words = _sentence(rng).split(" ")
    marks = 0
    while marks == 0 or rng.random() < 0.4:
        x = " ".join(_word(rng) for _ in range(rng.randint(1, 3)))
        forms = {
            "html": [f"<b>{x}</b>", f"<strong>{x}</strong>", f'<a href="https://a.example/t">{x}</a>', f"<em>{x}</em>", f"<EM>{x}</EM>", f'<span style="color:#333">{x}</span>', f"{x}&nbsp;{x}", f"&ldquo;{x}&rdquo;", f"{x}&eacute;{x}", "R&amp;D", "&amp; Sons", "&#8217;s", "<i>" + x + "</i>", "<code>" + x + "</code>"],
            "markdown": [f"**{x}**", f"*{x}*", f"_{x}_", f"*_{x}_*", f"[{x}](https://a.example)", f"`{x}`", f"__{x}__", f"***{x}***"],
            "wiki": [f"'''{x}'''", f"''{x}''", f"[[{x}]]", f"[[{x}|{x}]]", f"[https://a.example {x}]", f"{{{{source|{x}}}}}", f"<ref>{x}</ref>", f'<ref name="{x}">Desk file 3</ref>'],
            "latex": [f"\\textbf{{{x}}}", f"\\emph{{{x}}}", f"\\textit{{{x}}}", f"\\href{{https://a.example}}{{{x}}}", f"{{\\bf {x}}}", "R\\&D", "\\& Sons", "5\\%", f"\\cite{{{x}}}", f"``{x}''"],
        }
        words.insert(rng.randint(0, len(words) - 1), ("f", _formula(rng, lang)) if rng.random() > share else ("m", rng.choice(forms[lang])))
        marks += 1
    for k, w in enumerate(words):
        if k:
            to.add(" ", "inline")
        if isinstance(w, tuple):
            to.add(w[1], "formula" if w[0] == "f" else "inline")
        else:
            to.add(w, "inline")
    if lang == "html" and rng.random() < 0.2:
        to.add("<br/>", "inline")


def _code(rng):
    v = _word(rng).lower()
    return "\n".join(rng.choice([
        ["SELECT sum(%s)" % v, "FROM %s" % v, "WHERE %s > %d AND n <> '*'" % (v, rng.randint(1, 99))], ["for (%s = 0; i < 67; i++) {" % v, "  %s[i] += w[i];" % v, "}"],
        ["$ ./run %s.csv" % v, "# ok", "* rows: %d" % rng.randint(1, 999)], ["def %s_rate(a, b):" % v, "    # share of b", "    if a < b:", "        return a / b * 2", "    return %s" % v], ["- %s: 1" % v, "- b: [x](y)", "", "key = $a + $b$"],
        ["# %s" % v, "* %s" % v, "$a_b$"], ["== %s ==" % v, "* %s" % v, "# %s" % v], ["\\item %s" % v, "\\section{%s}" % v, "\\[x\\]"], ["<li>%s</li>" % v, "<h2>%s</h2>" % v], [v], ["%s = %d" % (v, rng.randint(1, 99)), "print(%s)" % v],
    ]))


def document(rng):
    """(text, leaves, labels) of a document in one language or in none."""
    lang = rng.choice(["html", "markdown", "wiki", "latex", "plain", "plain"])
    d = Text(lang == "html" and rng.random() < 0.25)
    gap = rng.random() < 0.7
    trace = lang != "plain" and rng.random() < 0.3  # marks in few places of a text that is plain otherwise
    br = lambda: rng.choice(["\n", "\n", "\n\n"]) if gap else "\n"
    for part in range(rng.randint(1, 14)):
        if part:
            d.add(br())
        kind = rng.choice(["p", "p", "p", "p", "h", "l", "l", "c", "f", "o"]) if lang != "plain" and not trace else "p"
        x = " ".join(_word(rng) for _ in range(rng.randint(2, 5)))
        if kind == "p" and lang == "plain":
            t = _sentence(rng)
            d.add(rng.choice([t, t, t, t + " " + _sentence(rng), "* * *", "***", "— " + x, "• " + t, "- " + t, "– " + t, "* " + t if rng.random() < 0.05 else t, "\t" + x, "    " + t, x, x.upper(), f"{rng.randint(1, 9)}. {t}", f"{rng.randint(1, 9)}) {t}", f"(Reporting by {x})", f"Updates: https://a.example/live/{rng.randint(1, 999)}", f"{x}: {t}", "> " + x if rng.random() < 0.02 else x, "---", "=====", "Mail: a_b@c_d.example", f"#{_word(rng)} #{_word(rng)}"]))
        elif kind == "p":
            tag = lang == "html" and not trace and rng.random() < 0.6
            opened = rng.choice(["<p>", "<p>", "<div>", '<P CLASS="t">', '<p class="lead">']) if tag else ""
            d.add(opened, "inline")
            for n in range(rng.randint(1, 3)):
                if n:
                    d.add(" ", "inline" if tag else "plain")
                if rng.random() < (0.4 if trace else 0.6):
                    _inline(rng, lang, d, 0.95 if trace else 0.85)
                else:
                    d.add(_sentence(rng), "inline" if tag else "plain")
            d.add(rng.choice(["</" + opened[1] + opened[2:].split(" ")[0].rstrip(">") + ">", ""]) if tag else "", "inline")
        elif kind == "h":
            n = rng.randint(1, 4)
            if lang == "html":
                d.add(rng.choice([f"<h{n}>", f'<H{n} class="x">', f"<h{n} id='s'>"]) + x, "heading")
                d.add(f"</h{n}>", "inline")
            elif lang == "markdown":
                if rng.random() < 0.3:
                    d.add(x, "inline")
                    d.add("\n")
                    d.add(rng.choice("=-") * rng.randint(3, 30), "heading")
                else:
                    d.add("#" * n + " " + x + rng.choice(["", "", " ##", " #"]), "heading")
            elif lang == "wiki":
                e = "=" * (n + 1)
                d.add(rng.choice([f"{e} {x} {e}", f"{e}{x}{e}"]), "heading")
            else:
                d.add(rng.choice([f"\\section{{{x}}}", f"\\subsection*{{{x}}}", f"\\section*{{{x}}}", f"\\subsubsection{{{x}}}"]), "heading")
        elif kind == "l":
            n = rng.randint(1, 6)
            deep = rng.random() < 0.25
            line = rng.random() < 0.6
            if lang == "html":
                tag = rng.choice(["ul", "ol", "UL"])
                d.add(f"<{tag}>" + ("\n" if line else ""), "other")
                for k in range(n):
                    d.add(rng.choice(["<li>", "<li>", '<li class="a">', "<LI>"]), "list_item")
                    _inline(rng, lang, d) if rng.random() < 0.4 else d.add(_sentence(rng), "inline")
                    if deep and k == 0:
                        d.add(rng.choice(["\n", ""]) + "<ul>", "other")
                        d.add("<li>" + _sentence(rng), "list_item")
                        d.add("</ul>", "other")
                    d.add(rng.choice(["</li>", ""]) + ("\n" if line else ""), "inline")
                d.add(f"</{tag}>", "other")
            elif lang == "latex":
                env = rng.choice(["itemize", "enumerate"])
                d.add(f"\\begin{{{env}}}\n", "other")
                for k in range(n):
                    d.add(rng.choice(["  ", ""]))
                    d.add(rng.choice(["\\item ", "\\item ", "\\item[a] "]), "list_item")
                    _inline(rng, lang, d) if rng.random() < 0.4 else d.add(_sentence(rng), "inline")
                    d.add("\n")
                    if deep and k == 0:
                        d.add("  \\begin{itemize}\n", "other")
                        d.add("    ")
                        d.add("\\item " + _sentence(rng), "list_item")
                        d.add("\n")
                        d.add("  \\end{itemize}\n", "other")
                d.add(f"\\end{{{env}}}", "other")
            else:
                mark = rng.choice(["* ", "- ", "+ ", "1. ", "1. ", "2) "] if lang == "markdown" else ["* ", "# ", "*", "#", "** "])
                for k in range(n):
                    if k:
                        d.add("\n")
                    m = f"{k + 1}. " if mark == "1. " else mark
                    if deep and k:
                        m = rng.choice(["  ", "    ", "\t"]) + m if lang == "markdown" else m[0] * 2 + m[1:]
                    d.add(m, "list_item")
                    _inline(rng, lang, d) if rng.random() < 0.4 else d.add(_sentence(rng), "inline")
        elif kind == "c":
            body = _code(rng)
            if lang == "html":
                c = body.replace("<", "&lt;").replace(">", "&gt;")
                d.add(rng.choice([f"<pre><code>{c}</code></pre>", f"<pre>{c}</pre>", f'<pre class="src">\n{c}\n</pre>', f"<pre>\n{c}\n</pre>"]), "code")
            elif lang == "markdown":
                g = rng.choice(["```", "~~~", "````"])
                if rng.random() < 0.3:
                    d.add("\n")
                    d.add("\n".join("    " + b for b in body.split("\n")), "code")
                    d.add("\n")
                else:
                    d.add(rng.choice([f"{g}\n{body}\n{g}", f"{g}python\n{body}\n{g}", f"{g} sql\n{body}\n{g}"]), "code")
            elif lang == "wiki":
                d.add(rng.choice([f"<syntaxhighlight>\n{body}\n</syntaxhighlight>", f"<pre>\n{body}\n</pre>", f'<syntaxhighlight lang="sql">\n{body}\n</syntaxhighlight>', f"<source>\n{body}\n</source>"]), "code")
            else:
                e = rng.choice(["verbatim", "lstlisting"])
                d.add(f"\\begin{{{e}}}" + rng.choice(["", "", "[language=C]"]) + f"\n{body}\n\\end{{{e}}}", "code")
        elif kind == "f":
            tex = _tex(rng)
            wrap = lang == "html" and rng.random() < 0.5
            d.add("<p>" if wrap else ":" if lang == "wiki" and rng.random() < 0.7 else "", "other")
            d.add({"html": rng.choice([f"\\[{tex}\\]", '<math display="block"><mi>g</mi><mo>=</mo><mn>2</mn></math>', f'<math display="block"><mrow><mi>{_word(rng)}</mi><mo>=</mo><mfrac><mi>a</mi><mi>b</mi></mfrac></mrow></math>']), "markdown": rng.choice([f"$${tex}$$", f"$$\n{tex}\n$$", f"\\[{tex}\\]"]), "wiki": f"<math>{tex}</math>", "latex": rng.choice([f"\\[{tex}\\]", f"\\[\n{tex}\n\\]", f"$${tex}$$", f"\\begin{{equation}}\n{tex}\n\\end{{equation}}", f"\\begin{{align*}}\n{tex}\n\\end{{align*}}"])}[lang], "formula")
            d.add("</p>" if wrap else "", "other")
        else:
            t = _sentence(rng)
            v = _word(rng)
            d.add({"html": rng.choice(["<table><tr><td>" + t + "</td><td>37</td></tr></table>", "<table>\n<tr><th>a</th><td>" + x + "</td></tr>\n</table>", "<!-- slot 3 -->", f"<!-- <li> {v} -->", f"<script>if ({v} < 3) {{document.write('<li>{v}</li>')}}</script>", f"<script>track('{v}', {{a: 1 < 2}})</script>", f"<style>.{v}{{width:3px}}</style>", f"<blockquote>{t}</blockquote>", '<div class="body">', "</div>", "<hr>"]),
                 "markdown": rng.choice(["> " + t, "| a | b |\n|---|---|\n| c | 3 |", "---", "***", f"![{x}](https://a.example/i.png)"]),
                 "wiki": rng.choice(["{| class=\"wikitable\"\n|-\n| " + t + " || 15\n|}", "[[Category:" + x + "]]", "{{quote|" + t + "}}", "[[File:a.jpg|thumb|" + x + "]]", "----"]),
                 "latex": rng.choice(["\\begin{tabular}{ll} " + x + " & 6 \\\\ \\end{tabular}", "\\begin{tabular}{ll}\n" + x + " & 6 \\\\\n\\end{tabular}", "\\begin{quote}" + t + "\\end{quote}", "\\begin{quote}\n" + t + "\n\\end{quote}", "% " + x])}[lang], "other")
    return d.labelled()


def _backward(w, x, mask, kept, d, dout):
    """Gradients of one direction; dout is in the direction's own order of steps."""
    g = {k: np.zeros_like(w[k]) for k in (f"x{d}", f"h{d}", f"c{d}")}
    dh = np.zeros((x.shape[1], HIDDEN), np.float32)
    dc = np.zeros_like(dh)
    for t in reversed(range(len(x))):
        i, f, o, u, c, h, tc, m = kept[t]
        dht = dh + dout[t]
        a = np.where(m, dht, 0)
        do = a * tc
        dct = np.where(m, dc, 0) + a * o * (1 - tc * tc)
        da = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - u * u)], axis=1)
        g[f"x{d}"] += x[t].T @ da
        g[f"h{d}"] += h.T @ da
        g[f"c{d}"] += da.sum(0)
        dh = da @ w[f"h{d}"].T + np.where(m, 0, dht)
        dc = dct * f + np.where(m, 0, dc)
    return g


def train(steps: int = 2600, docs: int = 48, seed: int = 1, rate: float = 0.01, say=print) -> dict:
    rng = random.Random(seed)
    w = BiLSTM.initial()
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    net = BiLSTM(w)
    for step in range(1, steps + 1):
        batch = [document(rng) for _ in range(docs)]
        x, mask = pad([leaf_vectors(t, c) for t, c, _ in batch])
        y = np.zeros(mask.shape, int)
        for j, (_, _, lab) in enumerate(batch):
            y[: len(lab), j] = lab
        keep: dict = {}
        z = net.logits(x, mask, keep)
        p = np.exp(z - z.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        dz = p.copy()
        np.put_along_axis(dz, y[..., None], np.take_along_axis(dz, y[..., None], 2) - 1, 2)
        dz *= mask[..., None] / mask.sum()
        g = {"o": np.einsum("tbi,tbo->io", keep["top"], dz), "ob": dz.sum((0, 1))}
        dtop = dz @ w["o"].T
        g |= _backward(w, x, mask, keep["f"], "f", dtop[..., :HIDDEN])
        g |= _backward(w, x[::-1], mask[::-1], keep["b"], "b", dtop[::-1, :, HIDDEN : 2 * HIDDEN])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.999 * m2[k] + 0.001 * v * v
            lr = rate * (1 - step / (steps + 1))
            w[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if step % 50 == 0:
            ok = (z.argmax(2) == y)[mask].mean()
            say(f"step {step}: accuracy {ok:.4f}")
    return w


def accuracy(net: BiLSTM, docs: int = 600, seed: int = 99) -> dict[str, float]:
    """On new documents: share of leaves with the right label, and for each label its recall and precision."""
    rng = random.Random(seed)
    batch = [document(rng) for _ in range(docs)]
    got = np.concatenate(net.label([leaf_vectors(t, c) for t, c, _ in batch]))
    want = np.concatenate([y for _, _, y in batch])
    out = {"all": float((got == want).mean())}
    for name, k in L.items():
        out[name] = round(float((got[want == k] == k).mean()), 4)
        out[name + " precision"] = round(float((want[got == k] == k).mean()), 4)
    return out


if __name__ == "__main__":
    out = Path(sys.argv[1] if len(sys.argv) > 1 else Path(__file__).with_name("markup_weights.npz"))
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in train().items()})
    with np.load(out) as f:
        print("held-out:", accuracy(BiLSTM({k: f[k].astype(np.float32) for k in f.files})))
