from quillspark.llm import spam

PROSE = "The old mill follows a draft of the report, and the people of the town are glad. This chapter explains the water level. It took 12 days to find the list of repairs."
KEYS = "cheap shoes, best shoes, shoes sale, shoes online, buy shoes, shoes, shoes price, cheap shoes, shoes sale, shoes deal"


def model():
    return spam.Model([PROSE, PROSE + "\n\n" + PROSE, "In the first section, the museum shows two short reports. Nobody had expected it to last."] * 5)


def test_pages():
    m = model()
    flag = lambda t: m.judge(t)[2]
    assert flag(KEYS) and flag("A sentence stands here.\n\n" + KEYS) and flag("Shoes sale shoes online. Best shoes shoes deal. Shoes price new shoes. Cheap shoes shoes offer.")
    assert flag(" ".join(["#ShoesSale #BestShoes #ShoesOnline"] * 4)) and flag("\n".join(f"[cheap shoes](https://a.example/shoes-{i})" for i in range(8)))
    assert flag("\n".join(f"Bike helmet Zax{c}-{i}12 S M L XL sale price" for i, c in enumerate("abcdefgh")))
    assert flag(", ".join(f"shoes Zu{c}a" for c in "bcdfghjklm"))
    assert not flag(PROSE) and not flag("\n".join(f"{i}0 g {w}" for i, w in enumerate("flour sugar butter salt yeast milk eggs honey oats rye".split(), 1)))
    assert not flag("\n".join(f"{i}. {w} of the town .... {i}" for i, w in enumerate("History Maps Songs Names Rules".split(), 1)))
    assert not flag(" ".join(["We read the same game at school, and then we read the same game at home."] * 8))
    assert not flag("\n".join(f"- The editor explains the {w}. https://x.example/{i}" for i, w in enumerate("report map song name rule".split())))
    assert not flag(None) and not flag("") and not flag("shoes shoes")


def test_wide_scripts_and_the_band():
    prose = ["Редакция сравнивает несколько старых версий после долгого разговора. Мастерская собирает уровень воды у моста. Архив проверяет часы работы с самого начала. Справочник заменяет рецепт хлеба и таблицу результатов."] * 5
    m = spam.Model([PROSE, PROSE + "\n\n" + PROSE, *prose] * 5)
    keys = "Обувь дешево, обувь цена, обувь купить, обувь скидка. " * 5
    assert m.is_spam(keys) and m.is_spam("Купить обувь цена обувь. Обувь цена обувь купить обувь. " * 4) and m.is_spam("靴安い靴。靴通販靴。" * 8)
    assert not m.is_spam(prose[0])
    m.low, m.high = 0.0, float("inf")  # only the perplexity separates these
    assert not m.is_spam(keys)


def test_only_abnormal_perplexity_makes_candidates():
    m = model()
    pages = [KEYS, "A sentence stands here.\n\n" + KEYS, " ".join(["#ShoesSale #BestShoes #ShoesOnline"] * 4), "\n".join(f"[cheap shoes](https://a.example/shoes-{i})" for i in range(8))]
    assert all(map(m.is_spam, pages))
    m.low, m.high = 0.0, float("inf")
    assert not any(map(m.is_spam, pages))  # without the band nothing is flagged


def test_trigram_sums_to_one():
    t = model().trigram
    import math

    kinds = [g for (g,) in t.n[0]]
    assert abs(sum(math.exp(-t.cost("D", "C", k)) for k in kinds) + (t.kinds - len(kinds)) * math.exp(-t.cost("D", "C", "unseen")) - 1) < 1e-9


def test_frame(spark):
    df = spark.createDataFrame([(1, KEYS, "x"), (2, PROSE, "x"), (3, None, "x"), (1, KEYS, "x"), (5, KEYS * 400, "x")] + [(10 + i, PROSE, "x") for i in range(30)], "doc_id long, text string, is_spam string")
    got = spam.score_pages(df, spam.fit(df)).where("is_spam").collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 5]
    assert spam.score_pages(df.limit(0), spam.fit(df.limit(0))).count() == 0


def test_model_is_of_every_row(spark):
    texts = [" ".join(w for w in PROSE.split() if (i * len(w)) % 11 != 1) for i in range(3000)] + [PROSE + " Was it so? " * 3000, None, KEYS, ""]  # more rows and longer texts than samples held
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = spam.fit(df), spam.Model(texts)
    assert got.trigram.n == want.trigram.n and got.trigram.c == want.trigram.c and (got.low, got.high) == (want.low, want.high)
    assert [r.doc_id for r in spam.find_spam(df).collect()] == [i for i, t in enumerate(texts) if want.is_spam(t)] == [3002]


def test_possible_leaves_out_no_spam():
    m = model()
    m.low = m.high = float("inf")  # every segment is a candidate
    pages = [KEYS, "A sentence stands here.\n\n" + KEYS, PROSE, KEYS + "\n" + PROSE * 2, "shoes shoes", None] + [" ".join(["#ShoesSale #BestShoes"] * 5)]
    assert [spam.possible(spam.segments(t)) for t in pages if m.is_spam(t)] == [True] * sum(map(m.is_spam, pages)) and not spam.possible(spam.segments(PROSE))
