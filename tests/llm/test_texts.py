"""Problems 2, 4 and 10."""

import random

import numpy as np

from threadloom.llm import markup, markup_train, page_template, truncation


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


STORY = "Ana Brokov met Luis Tarnek in Velmora on Monday to discuss rail freight and the ferry contract."


def page(n, extra=()):
    k = "abcdefghij"[n] * 2
    head = f"Brokov{k} and Tarnek{k} end quarrel over rail freight"
    text = [f"Brokov{k} told Tarnek{k} that paragraph {j} of the story would be settled in Velmora{k} soon." for j in range(2)]
    return head, "\n".join(["Home | News | Sport | Weather", f"Home > World > {head}", head, "Listen to this article, 3 min", text[0], *extra, "", text[1], "Read more: Something else about Kelvar and Zondin", "More on this topic", f"• Kelvar{k} wins against Zondin{k} in court", f"Kelvar{k} had asked Zondin{k} to wait until the court had heard all of them.", "© 2024 Daily. All rights reserved.", "Back to top"])


def test_page_template(spark):
    data = []
    for k in range(8):
        h, b = page(k, ("Why Tarnekaa hesitates", "• Brokovaa said that Velmoraaa would not wait for another year.") if k == 0 else ())
        data.append((f"a{k}", b, h + (" | Daily" if k % 2 else ""), "Daily", f"https://www.daily.example/world/2024/{page_template._slug(h)}-00{k}"))
    data += [("front", "Home | News | Sport | Weather\nKelvar wins\nBack to top", "World – Daily", "Daily", "https://daily.example/section/world"), ("nobody", None, "t", "Daily", None), ("blank", "\n \n", None, None, None), ("notitle", page(9)[1], None, None, f"https://daily.example/x/{page_template._slug(page(9)[0])}-9"), ("a0", data[0][1], *data[0][2:])]
    a = spark.createDataFrame([(*r, 1) for r in data], "article_id string, body string, title string, source string, url string, host int")
    f = spark.createDataFrame([(i, f"http://daily.example/{i}") for i in ("front", "blank", "nobody")] + [(r[0], r[4]) for r in data if r[0][0] in "an"] + [(None, "x")], "article_id string, url string")
    got = {}
    for i, n in rows(page_template.template_lines(page_template.pages_of(a, f)), "id", "line_no"):
        got.setdefault(i, []).append(n)
    assert got["a1"] == [0, 1, 3, 7, 8, 9, 10, 11, 12] and got["notitle"] == got["a1"] and got["front"] == [0, 1, 2] and "blank" not in got
    assert got["a0"] == [0, 1, 3, 9, 10, 11, 12, 13, 14]  # the subhead and the list stay
    p = page_template.pages_of(a, f)
    main = dict(rows(page_template.main_text(p, page_template.template_lines(p)), "id", "main"))
    assert main["a1"].count("\n") == 2 and main["a1"].startswith("Brokovbb and")
    assert page_template.template_lines(p.limit(0)).count() == 0


def test_labeller_on_new_documents():
    got = markup_train.accuracy(markup.trained(), 300, 1234)
    assert got["all"] > 0.98 and all(got[k] > 0.95 and got[k + " precision"] > 0.95 for k in ("plain", "heading", "list_item", "code", "formula")), got


def test_leaves_cover_the_text():
    rng = random.Random(11)
    for _ in range(60):
        text, spans, y = markup_train.document(rng)
        assert len(spans) == len(y) and all(a <= b for a, b in spans) and "".join(text[a:b] for a, b in spans) == text.replace("\n", "") or "\n" in "".join(text[a:b] for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert markup.leaves("") == [(0, 0)]


def test_without_labels_no_row(spark, monkeypatch):
    """The rows come through the labeller: with every leaf plain nothing is found."""
    monkeypatch.setattr(markup.BiLSTM, "label", lambda self, docs, batch=128: [np.zeros(len(d), int) for d in docs])
    (got,) = markup._read(iter([__import__("pandas").DataFrame({"id": list(DOCS), "text": [v[0] for v in DOCS.values()]})]))
    assert got["language"].isna().all() and not got[["heading", "list_item", "code_block", "formula"]].to_numpy().any()


def test_training_lowers_the_loss_and_gradients_hold():
    said = []
    w = markup_train.train(50, 16, say=said.append)
    assert float(said[-1].split()[-1]) > 0.7 and all(np.isfinite(v).all() for v in w.values())
    # numerical gradient of one weight
    rng = random.Random(1)
    t, cut, lab = markup_train.document(rng)
    x, mask = markup.pad([markup.leaf_vectors(t, cut)])
    w = {k: v.astype(np.float64) for k, v in markup.BiLSTM.initial().items()}
    y = np.array(lab)[:, None]

    def loss(w):
        z = markup.BiLSTM(w).logits(x, mask)
        z = z - z.max(2, keepdims=True)
        return -(np.take_along_axis(z - np.log(np.exp(z).sum(2, keepdims=True)), y[..., None], 2)).mean()

    keep = {}
    z = markup.BiLSTM(w).logits(x, mask, keep)
    p = np.exp(z - z.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    np.put_along_axis(p, y[..., None], np.take_along_axis(p, y[..., None], 2) - 1, 2)
    dtop = (p / len(lab)) @ w["o"].T
    g = markup_train._backward(w, x, mask, keep["f"], "f", dtop[..., : markup.HIDDEN])
    i = np.unravel_index(np.abs(g["hf"]).argmax(), g["hf"].shape)
    e = 1e-3
    up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
    up["hf"][i] += e
    down["hf"][i] -= e
    assert abs((loss(up) - loss(down)) / (2 * e) - g["hf"][i]) < 1e-3 + 0.05 * abs(g["hf"][i])


DOCS = {
    "html": ('<h2 class="x">Why</h2>\n<p>A <b>b</b> &amp; c \\(x_1 = 2\\)</p>\n<ul><li>one<li>two</ul>\n<pre><code># no\n* no\n$a_b$</code></pre>\n<math><mi>g</mi></math><!-- <li> --><script>if (a<li) {}</script>', (1, 2, 1, 2)),
    "markdown": ("# Why\n\nText **b** and $x_{a}^2$ at $4 to $6 a tonne\n\n- one\n  * two\n1. three\n\n```python\n# no\n- no\n```\n\nTitle\n=====\n\n$$\na = b\n$$\n\n    indented\n    code\n\n* * *\n\nend", (2, 3, 2, 2)),
    "wiki": ("== Why ==\n'''b''' [[Velmora|x]]\n* one\n** two\n# three\n<syntaxhighlight>\n== no ==\n* no\n</syntaxhighlight>\n:<math>a_b</math>\n{| class=\"wikitable\"\n|-\n| a || b\n|}", (1, 3, 1, 1)),
    "latex": ("\\section*{Why}\nA \\textbf{b} at \\$5 R\\&D\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\\begin{verbatim}\n\\item no\n\\section{no}\n\\end{verbatim}\n\\[a = b\\] and $r \\leq 1$\n\\begin{equation}\nx = 1\n\\end{equation}", (1, 2, 1, 3)),
}


def test_grammars_count_and_clean():
    for lang, (text, want) in DOCS.items():
        assert markup.language_of(text)[0] == lang
        n, clean = markup.READERS[lang](text)
        assert tuple(n.values()) == want, (lang, n)
        assert not any(x in clean for x in ("<b>", "**b**", "'''", "\\textbf", "[[", "\\begin")), (lang, clean)
        assert "# Why" in clean and "- one" in clean and "```" in clean
    assert markup.language_of("R&D at $4 to $6, “so”")[0] is None


def test_markup_operator(spark):
    data = [(k, v[0]) for k, v in DOCS.items()] + [("n", None), ("e", ""), ("plain", "Nothing & nobody.\n* * *\n— Ana, desk"), ("long", ("<p>word word word</p>\n" * 3000)), (None, "<p>x</p>")]
    df = spark.createDataFrame([(a, b, "l") for a, b in data], "id string, body string, language string")
    got = {r["id"]: r for r in markup.clean_markup(df.unionByName(df.where("id = 'wiki'")), "id", "body").collect()}
    assert all(got[k]["language"] == k and (got[k]["heading"], got[k]["list_item"], got[k]["code_block"], got[k]["formula"]) == DOCS[k][1] for k in DOCS)
    assert "n" not in got and "e" not in got and None not in got and got["long"]["language"] == "html" and ("plain" not in got or got["plain"]["language"] is None)
    assert markup.clean_markup(df.limit(0), "id", "body").count() == 0


def test_truncation(spark):
    rng = random.Random(4)
    w = lambda n: " ".join(rng.choice(["rail", "freight", "talks", "ferry", "budget", "vote"]) for _ in range(n))
    data = [(i, (w(80) + ".")[:300].rstrip(".") , "cut300") for i in range(10)]
    data = [(i, t[:299] + "x", s) for i, t, s in data]
    data += [(100 + i, w(rng.randint(30, 90)) + " ends well.", "fine") for i in range(10)]
    data += [(200 + i, f"{w(30)}.\n\n— Tarnek, Velmora desk", "fine") for i in range(6)]
    data += [(300 + i, f"{w(rng.randint(20, 200))}.\n\nAnd then there was Tarnek…", "fine") for i in range(6)]
    data += [(400, w(30) + " the", "fine"), (401, w(30) + " the […]", "fine"), (402, "It was No.", "fine"), (403, w(9) + ".\n\n(Reporting by A; editing by", "fine"), (404, w(9) + ".\n\n(Reporting by A; editing by B)", "fine"), (405, w(9) + ".\n\n* * *", "fine"), (406, w(9) + ".\n\nContact: a@b.example", None), (407, "“Yes.” \n", "fine")]
    data += [(500, None, "fine"), (501, "", "fine"), (502, "  \n", None), (503, "x" * 50_000 + ".", "fine"), (None, "abc", "fine")]
    data += [(600 + i, (w(40)[:180].rsplit(" ", 1)[0] + "…"), "dots") for i in range(8)]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id int, text string, source string, cap int")
    got = {r["id"]: r for r in truncation.truncated(df).collect()}
    cut = {i for i, r in got.items() if r["cut"]}
    assert cut == set(range(10)) | {400, 401, 402, 403} | set(range(600, 608))
    assert not {500, 501, 502, None} & set(got) and got[0]["cap"] == 300 and got[0]["at_limit"]
    assert truncation.truncated(df.limit(0)).count() == 0


def test_two_limits_of_one_source(spark):
    """Texts cut at 200 characters and at 400 bytes in one source; a signature of no known form is no end there."""
    rng = random.Random(5)
    w = lambda n: " ".join(rng.choice(["rail", "freight", "talks", "ferry", "année"]) for _ in range(n))
    cut = [w(90)[:199] + "x" for _ in range(9)] + [w(200).encode()[:399].decode(errors="ignore") + "x" for _ in range(9)]
    odd = (w(90)[:183] + "\n").ljust(185, "y") + "— Zed, Velmora"
    whole = [w(rng.randint(20, 200)) + " end." for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*cut, *whole, odd[:199]])], "doc_id int, text string, source string")
    got = {r["id"]: r for r in truncation.truncated(df).collect()}
    assert {i for i, r in got.items() if r["cut"]} == set(range(18)) | {78}
    assert all(got[i]["at_limit"] for i in (*range(18), 78)) and {got[i]["cap"] // 100 for i in range(18)} == {2, 4} or {got[i]["cap"] for i in range(9)} == {200}
