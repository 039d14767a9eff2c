import random

import numpy as np
import pytest

from quillspark.llm import markup

PLAIN = ["The archive keeps a list of plain words.", "The editor checks two short reports in the first section.", "Das Museum zeigt den langen Absatz im zweiten Stock.", "Le glossaire remplace une liste de mots simples."]


@pytest.fixture(scope="module")
def model():
    return markup.train(PLAIN)


@pytest.mark.parametrize("text,want", [
    ("<p>The editor checks it.</p>", ["html"]), ("A&nbsp;b and R&amp;D.", ["html"]), ("## Head\n\nText **bold** here.", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("The [[Word|text]] and {{cite|X}}.", ["wiki"]),
    ("== Head ==\nText.", ["wiki"]), ("It is $\\frac{a}{2}$ here.", ["latex"]), ("See it.~\\cite{memo12}", ["latex"]), ("<b>x</b> and **y** and [[z]]", ["html", "markdown", "wiki"]),
    ("It holds for a < b and c > d alike.", []), ("Seats cost $5 in spring and $12 in autumn.", []), ("Ratings of 4* and 5* are rare.", []), ("The file report_final_v2 is kept in C:\\notes\\new.", []), ("The R&D office sits on floor #7.", []),
    ("The code x == y was printed on the ticket.", []), ("The set {a, b} has two elements [sic].", []), ("", []), (None, []),
])
def test_families(model, text, want):
    assert markup.families(text, model) == want


def test_held_out_accuracy(model):
    r = random.Random(99)
    right = total = 0
    for _ in range(400):
        mark = r.random() < 0.5
        s = markup._marked(r, r.choice(PLAIN), PLAIN) if mark else markup._literal(r, r.choice(PLAIN))
        total += 1
        right += bool(markup.families(f"{r.choice(PLAIN)} {s} {r.choice(PLAIN)}", model)) == mark
    assert right / total > 0.93


def test_boosting_beats_the_base():
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = markup.Boosted(x[:600], y[:600]).predict(x[600:])
    assert ((p > 0.5) == y[600:]).mean() > 0.9


def test_hierarchy(model):
    nodes = markup.decode("Text ```\n<b>x</b> **y**\n``` and `[[z]]`.", model)
    assert {n.kind for n in nodes if n.keep} <= {"fence", "code"}


def test_clean(spark):
    text = "# Head\n\nSome *text* with `code` and &amp;.\n\n- one\n- two\n\n```\nx = 1\n```\n\n\\[ a+b \\]\n\n<h2>Sub</h2><ul><li>i</li></ul>\n\n== Wiki ==\n'''b''' [[A|c]]\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    kinds = [(k, s) for k, _, s in markup.blocks(text)]
    assert kinds == [("heading", "Head"), ("text", "Some text with code and &."), ("item", "one"), ("item", "two"), ("code", "x = 1"), ("formula", "a+b"), ("heading", "Sub"), ("item", "i"), ("heading", "Wiki"), ("text", "b c"), ("table", "a | b"), ("table", "1 | 2")]
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "<b>" * 5000, "k")], "article_no long, extract_text string, markup string")
    rows = {r.article_no: r for r in markup.clean_texts(df, "article_no", "extract_text").collect()}
    assert rows[2].clean_text is None and rows[3].clean_text == "" and "x = 1" in rows[1].clean_text and len(rows) == 4
    m = markup.fit(df, "extract_text", "article_no")
    assert {r.markup for r in markup.markup_families(df, m, "article_no", "extract_text").where("article_no = 4").collect()} == {"html"}
    assert markup.markup_families(df.limit(0), m, "article_no", "extract_text").count() == 0


@pytest.mark.parametrize("text,want", [
    ("It holds for a < b and c > d alike.", None), ("It holds for a <b and c> d alike.", None), ("Seats cost $5 in spring and $12 in autumn.", None), ("Ratings of 4* and 5* are rare.", None),
    ("The file report_final_v2 is kept in C:\\notes\\new.", None), ("The R&D office sits on floor #7.", None), ("The code x == y was printed on the ticket.", None), ("The set {a, b} has two elements [sic].", None),
    ("Our template fills `{{title}}` with the heading.", "Our template fills {{title}} with the heading."), ("Use `<br>` or `__ABC__` and `&lt;` there.", "Use <br> or __ABC__ and &lt; there."),
    ("```\n<li>{{x}}</li>\n```", "<li>{{x}}</li>"), ("<p>See <code>a &lt; b</code>.</p>", "See a < b ."), ("See [it](/1) and **bold** text.", "See it and bold text."), ("- one\n- two", "- one\n- two"), ("", ""), (None, None),
])
def test_clean_removes_only_what_the_trees_keep(model, text, want):
    assert markup.clean(text, model) == (text if want is None else want)


def test_flat_trees_agree(model):
    x = markup.features(t := "<p>a **b** [c](/d) $x_1$ `e`</p> 4* & {x}", markup.tree(t))
    f = np.full(len(x), model.base)
    for t in model.trees:
        f += markup.RATE * model._apply(t, x)
    assert np.allclose(model.predict(x), 1 / (1 + np.exp(-f)))


def test_constructs_of_any_length(model):
    for k in (1, 20, 200):
        w = " ".join([PLAIN[0][:-1]] * k)
        for t, want in ((f"See **{w}** here.", "markdown"), (f"See [it](https://a.example/{w.replace(' ', '-')}) now.", "markdown"), (f"The `{w}` here.", "markdown"), (f"The {{{{Infobox|{w}}}}} here.", "wiki"), (f"\\textbf{{{w}}} is here.", "latex")):
            assert markup.families(t, model) == [want], (k, t[:40])


def test_literal_signs_survive_cleaning(model):
    for t in ("It is so if a<b and c>d then stop.", "Use `{{name}}` in the file."):
        assert markup.clean(t, model) in (t, t.replace("`", "")), t
    assert "{{name}}" in markup.clean("Use `{{name}}` in the file.", model)


def test_time_is_linear_in_the_text(model):
    import time

    for unit in ("$a \\[ ", "**a ", "<code> a ", "[a](b ", "((`a "):
        took = []
        for n in (500, 2000):
            began = time.process_time()
            markup.clean(unit * n, model)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, unit
