from quillspark.llm import language

EN = ["The old mill follows a draft of the report and the people of the town are glad.", "This chapter in the book explains the water level with great patience.", "However, nobody had expected the winter programme to last that long."]
DE = ["Die alte Mühle verfolgt einen Entwurf des Berichts und die Leute der Stadt freuen sich.", "Dieses Kapitel des Buches erklärt den Wasserstand mit großer Geduld.", "Dennoch hatte niemand damit gerechnet, dass das Winterprogramm so lange dauert."]
FR = ["Le vieux moulin suit une ébauche du rapport et les gens de la ville sont contents.", "Ce chapitre du livre explique le niveau de l'eau avec beaucoup de patience.", "Cependant, personne ne s'attendait à ce que le programme d'hiver dure si longtemps."]
ZH = ["旧磨坊在桥边支持了开放时间，但是博物馆描述了冬季节目。", "没有人想到他会来。编辑解释了黑麦面包的做法。"]


def rows():
    out = []
    for i in range(12):
        for k, t in (("en", EN), ("de", DE), ("fr", FR)):
            out.append((k, f"{t[i % 3]} {t[(i + 1) % 3]}"))
        out.append(("zh", ZH[i % 2]))
    out += [("sv", " ".join(EN)), ("sv", " ".join(DE)), ("en", " ".join(DE)), ("de", " ".join(FR))]
    return out


def test_fit_drops_wrong_labels():
    p = language.Profiles.fit(rows(), {"en": 13, "de": 13, "fr": 12, "zh": 12, "sv": 2})
    assert p.langs == ["de", "en", "fr", "zh"]
    assert [p.best(" ".join(x)) for x in (EN, DE, FR, ZH)] == ["en", "de", "fr", "zh"]
    assert p.best("") is None and language.Profiles({}).best("x") is None


def test_documents():
    d = language.Detector(language.Profiles.fit(rows()))
    main, conf, _, langs, seg = d.document(" ".join(EN) + "\n\n" + " ".join(FR))
    assert langs == ["en", "fr"] and 0 < conf <= 1 and [s[2] for s in seg] == ["en", "fr"]
    assert d.document(" ".join(DE) + ' "Cependant."')[3] == ["de"]
    assert d.document(None) == (None, 0.0, None, [], []) == d.document(" 12 … ")


def test_labels(spark):
    raw = [" en", "EN-us", "deu", "und", "", None, "??", "fr_CA", "x-default", "englisch", "zz"]
    df = spark.createDataFrame([(x,) for x in raw], "l string").select("l", language.label_column(language.F.col("l")).alias("k"))
    got = {r.l: r.k for r in df.collect()}
    assert got == {x: language.label(x) for x in raw} and got["deu"] == "de" and got["x-default"] is None


def test_frame(spark):
    data = [(i, t, k, 1) for i, (k, t) in enumerate(rows() * 3)] + [(900, None, "en", 1), (901, "", None, 1), (902, " ".join(DE), "en", 1), (903, " ".join(EN) + " " + " ".join(FR), "en", 1), (904, " ".join(EN), " EN_GB", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, detected int")
    found = language.detect_languages(df, language.fit(df), keep=["lang"])
    got = sorted((r.doc_id, r.lang_code) for r in language.mislabelled(found).where("doc_id >= 900").collect())
    assert got == [(902, "de"), (903, "en"), (903, "fr")]
    empty = df.limit(0)
    assert language.detect_languages(empty, language.fit(empty), keep=["lang"]).count() == 0


def test_profiles_are_of_every_row(spark):
    def same(data, kept):
        df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(data)], "doc_id long, text string, lang string")
        got, want = language.fit(df), language.Profiles.fit([(k, t) for k, t in data if k and t is not None])
        assert got.langs == want.langs == kept and got.index == want.index and (got.rank == want.rank).all()

    long = ("fr", FR[0] + " 12." * 2000 + " " + FR[2])  # more than the passage and the rows of a label that samples held
    data = [(k, f"{t} Nr. {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(10) for k, t in rows()]
    same([*data, long, ("zz", EN[0]), ("en", None), (None, DE[0]), ("de", ""), ("de", "12")], ["de", "en", "fr", "zh"])
    alike = [("aa", EN[0]), ("bb", EN[0]), ("cc", EN[0])] * 6  # labels of one size
    same(alike, language.Profiles.fit(alike).langs)
    same([("en", EN[0])], ["en"])


def test_tally():
    t = language.Tally()
    for text in (EN[0], ZH[0], "L'eau, l'eau."):
        got = {list(t.index)[i] for i in t.ids(text)}
        assert len(t.ids(text)) == len(got) and got == {"", *language.grams(text), *("\n" + w for w in language.text_words(text))}
    t.add("x", t.ids("so so"))
    t.add("x", t.ids("so we"), -1)
    sent = list(t.send(0))
    assert sum(n for _, item, n in sent if item == "\nso") == 0 and ("x", "\nwe", -1) in sent and not list(t.send(1))
