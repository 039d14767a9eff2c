import numpy as np

from quillspark.llm import reading

EASY = "The cat sat on the mat. We saw the sun. The dog ran home. "
HARD = "A comparative computational analysis continually approximates representative observational categories throughout institutional environments. "


def test_own_prose():
    p = reading.own_prose
    assert p("Abstract—The cat sat. Keywords: cats, mats, sun") == "The cat sat."
    assert p("<p>Background: The cat sat (Smith and Jones 1999).</p><p>RESULTS - It ran ($p < 0.05$).</p>").split() == "The cat sat. It ran.".split()
    assert p("Running title: Cats in Town. The cat sat. © 2015 X Press. All rights reserved.") == "The cat sat."
    assert p("The cat diffe-\nrently sat. doi:10.1/x. https://a.example/1") == "The cat differently sat."
    assert p("Correspondence: Department of X, University of Y. Das Tier schlief.") == "Das Tier schlief."
    assert p("In 5 cases (n = 3) it ran.") == "In 5 cases (n = 3) it ran."
    assert [p(x) for x in (None, "", "n/a", "No abstract", "Abstract not available.", "Zusammenfassung nicht verfügbar.", "[Abstract withheld by institutional publisher]")] == [""] * 7


def test_ease_scale():
    assert reading.ease(EASY, "en") > 100 and reading.ease(HARD, "en") < 0 and reading.ease("", "en") is None
    assert [reading.grade(x) for x in (90, 70, 50, 30, 10, None)] == [1, 2, 3, 4, 5, None]


def test_isotonic_is_the_best_monotone_fit():
    r = np.random.default_rng(3)
    x = r.permutation(40).astype(float)
    y = -x + r.normal(0, 8, 40)
    xs, ys = reading.isotonic(x, y)
    assert (np.diff(ys) < 0).all() and (np.diff(xs) > 0).all()
    fit = ys[np.searchsorted(xs, x)]
    for _ in range(200):  # no other non-increasing step function is nearer
        other = np.sort(fit[np.argsort(x)] + r.normal(0, 2, 40))[::-1]
        assert ((y[np.argsort(x)] - other) ** 2).sum() >= ((y - fit) ** 2).sum() - 1e-9
    assert len(reading.isotonic(np.zeros(5), np.arange(5.0))[0]) == 1


def reader():
    texts = [EASY * i + HARD * j for i in range(6) for j in range(6) if i + j]
    return reading.Reader([("en", t) for t in texts * 2])


def test_levels_are_monotone():
    r = reader()
    got = [r.read(EASY * (6 - k) + HARD * k, "en")[0] for k in range(7)]
    assert got == sorted(got, reverse=True) and got[0] > 80 > 20 > got[-1]
    assert r.hard(HARD, "en") and not r.hard(EASY, "en") and r.read("", "en") is None and r.hard(HARD, "xx")


def test_the_model_decides():
    r = reader()
    texts = [EASY * i + HARD * j for i in range(1, 9) for j in range(5)]
    true = [reading.ease(t, "en") < reading.HARD for t in texts]
    r.levels["en"].band = 0.0  # no exact check at all
    got = [r.hard(t, "en") for t in texts]
    assert sum(a and b for a, b in zip(got, true)) >= 0.9 * max(sum(got), sum(true)) > 0
    r.levels["en"].y = r.levels["en"].y * 0 + 50.0  # without the levels nothing is found
    assert not any(r.hard(t, "en") for t in texts)


def test_surprisals_are_of_distributions():
    t = reading.surprisals([reading.sequence(EASY + HARD, "en")])
    assert np.allclose(np.exp(-t).reshape(4, -1, reading.SYMBOLS).sum(-1), 1)


def test_rare_languages_get_their_exact_ease():
    assert reader().read("Le chat dort. Il pleut.", "fr")[:2] == (reading.ease("Le chat dort. Il pleut.", "fr"), False)


def test_frame(spark):
    rows = [(f"e{i}", EASY * (i + 1), 1) for i in range(10)] + [(f"h{i}", HARD * (i + 1), 1) for i in range(10)] + [("n", None, 1), ("b", " ", 1), ("h1", HARD * 2, 1)]
    df = spark.createDataFrame(rows, "paper_id string, abstract string, grade int")
    r = reading.fit_papers(df)
    assert {x.paper_id for x in reading.hard_papers(df, r).collect()} == {f"h{i}" for i in range(10)}
    lv = {x.paper_id: x for x in reading.levels(df, r, None, "paper_id", "abstract").collect()}
    assert lv["n"].grade is None and lv["e3"].grade < lv["h3"].grade and lv["h3"].surprisal_mean > lv["e3"].surprisal_mean
    assert reading.hard_papers(df.limit(0), reading.fit_papers(df.limit(0))).count() == 0


def test_models_are_of_every_row(spark):
    texts = [EASY * (i % 7) + HARD * (i % 5) + "So it is. " * (i % 3) for i in range(3100)] + [EASY * 500 + HARD * 20, HARD * 300]  # more rows and longer texts than samples held
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "paper_id string, abstract string")
    got = reading.fit_papers(df).levels
    want = reading.Reader([("en", t) for t in texts]).levels["en"]
    assert list(got) == ["en"] and got["en"].rows == sum(map(bool, texts)) and got["en"].edges == want.edges
    assert np.array_equal(got["en"].whole, want.whole) and np.array_equal(got["en"].costs, want.costs) and np.allclose(got["en"].weights, want.weights, atol=1e-6)
    assert abs(got["en"].band - want.band) < 1e-3
    hard = {f"p{i}" for i, t in enumerate(texts) if t and reading.ease(t, "en") < reading.HARD}
    assert {r.paper_id for r in reading.find_hard(df).collect()} == hard


def test_measured_as_the_scale():
    for t in (EASY + HARD, "Donaudampfschifffahrtsgesellschaftskapitän ist 12 Jahre alt. 靴安い靴。", "3. Le chat, l'eau. Il pleut!"):
        for lang in ("en", "de", "fr"):
            assert reading.measure(t, lang)[1] == reading.ease(t, lang)
