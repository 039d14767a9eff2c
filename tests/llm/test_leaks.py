import random

from quillspark.llm import leaks

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


def brute(doc, item):
    """All windows by full alignment: item words from each start, cheapest way to each length."""
    d, t = leaks.words(doc), leaks.words(item)
    for i in range(len(d)):
        for j in range(len(t)):
            if d[i] != t[j]:
                continue
            cost = {(i, j): 0}
            frontier = [(i, j)]
            while frontier:
                nxt = {}
                for x, y in frontier:
                    c = cost[x, y]
                    if d[x] == t[y] and y - j + 1 >= leaks.LEAST and c * leaks.ERRORS <= y - j + 1:
                        return True
                    for x2, y2, e in ((x + 1, y + 1, 0 if x + 1 < len(d) and y + 1 < len(t) and d[x + 1] == t[y + 1] else 1), (x + 1, y, 1)):
                        if x2 < len(d) and y2 < len(t) and c + e <= 8 and cost.get((x2, y2), 99) > c + e:
                            cost[x2, y2] = c + e
                            nxt[x2, y2] = 1
                frontier = list(nxt)
    return False


def test_against_brute_force():
    r = random.Random(5)
    items = [(i, " ".join(r.choices(WORDS, k=40))) for i in range(6)]
    index = leaks.Index(items)
    seen = 0
    for turn in range(120):
        k, item = r.choice(items)
        n = r.randint(14, 34)
        a = r.randint(0, 40 - n)
        part = item.split()[a:a + n]
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(part))
            part[at:at + r.choice((0, 1))] = [r.choice(WORDS)]
        doc = " ".join([*r.choices(WORDS, k=15), *part, *r.choices(WORDS, k=15)])
        got = k in index.scan(doc)
        assert got == brute(doc, item), (turn, doc, item)
        seen += got
    assert 20 < seen < 110


def test_normalisation_and_frame(spark):
    item = " ".join(f"Wort{i}é" for i in range(30))
    docs = [
        (1, "x " + item.upper() + " y"), (2, item.replace(" ", ", <b>\n")), (3, item.replace("é", "e")), (4, " ".join(item.split()[:19])), (5, None), (6, ""), (1, "x " + item.upper() + " y"),
        (7, "z " * 20000 + item), (8, item.replace("Wort5", "Wo-\nrt5")),
    ]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "too short")], "item_id long, text string")
    got = leaks.find_leaks(df, items)
    assert sorted(r.doc_id for r in got.collect()) == [1, 1, 2, 3, 7, 8]
    cut = {r.doc_id: r.text for r in leaks.remove_leaks(df, got).collect()}
    assert cut[1] == "x  y" and cut[4].startswith("Wort0") and cut[5] is None and len(cut[7]) < 40010
    assert leaks.find_leaks(df, items.limit(0)).count() == 0 and leaks.find_leaks(df.limit(0), items).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    item = lambda k: " ".join(f"a{k}b{i}" for i in range(25))
    df = spark.createDataFrame([(k, item(k)) for k in range(4)], "doc_id long, text string")
    items = spark.createDataFrame([(k, item(k)) for k in range(4)], "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_NGRAMS", 30)
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(df, items).collect()) == [(k, k) for k in range(4)]
