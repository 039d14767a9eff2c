import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import sentences as s


def cut(t):
    return [u for u, _, _ in s.units(t)]


@pytest.mark.parametrize("text,want", [
    ("One. Two!", ["One.", "Two!"]), ("Dr. May came. See Fig. 3 and p. 4.", ["Dr. May came.", "See Fig. 3 and p. 4."]),
    ('He said: "Stop. It is over." Then he left.', ['He said: "Stop.', 'It is over."', "Then he left."]), ('"Where is it?" asked Tom. Nobody knew.', ['"Where is it?" asked Tom.', "Nobody knew."]),
    ("The list (it has 3 entries.) was short.", ["The list (it has 3 entries.) was short."]), ("Seite offen.Der Rest", ["Seite offen.", "Der Rest"]),
    ("Wait... but no. Wait... He left.", ["Wait... but no.", "Wait...", "He left."]), ("Am 3. Mai kam er. Siehe Kap. 5. Das war es.", ["Am 3. Mai kam er.", "Siehe Kap. 5.", "Das war es."]),
    ("No. Not now. See no. 5 there.", ["No.", "Not now.", "See no. 5 there."]), ("Head\n\nText one\nline two.", ["Head", "Text one\nline two."]), ("a\r\n \r\nb", ["a", "b"]),
    ("他说：“很晚了。”编辑来了。等等……他走了。", ["他说：“很晚了。”", "编辑来了。", "等等……他走了。"]), ("“在哪里？”邻居问道。好。", ["“在哪里？”邻居问道。", "好。"]),
    ("「もう遅い。」と言いました。はい。", ["「もう遅い。」と言いました。", "はい。"]), ("“देर हो गई है।” Pexau ने कहा। ठीक है।", ["“देर हो गई है।” Pexau ने कहा।", "ठीक है।"]),
    ("เปิดเวลา 8.30 น. ทุกวัน ห้องสมุดปรับปรุงราคา", ["เปิดเวลา 8.30 น. ทุกวัน", "ห้องสมุดปรับปรุงราคา"]), ("هل وصل؟ نعم وصل.", ["هل وصل؟", "نعم وصل."]),
    ("«Où est-il ? » demande-t-elle. Bien.", ["«Où est-il ? » demande-t-elle.", "Bien."]), ("- one\n- two", ["- one", "- two"]), ("# Head\nText.", ["# Head", "Text."]),
    ("It opened at 7 p.m. The end.", ["It opened at 7 p.m.", "The end."]), ("Version 3.1.2 is on a.example.com now.", ["Version 3.1.2 is on a.example.com now."]), ("", []), (None, []), (" \n ﻿", []),
])
def test_units(text, want):
    assert cut(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé. !?\n\"'()«»„“…。 と1-ก"), max_size=80))
def test_offsets_cover_the_text(text):
    raw, last = text.encode(), 0
    for unit, a, b in s.units(text):
        assert raw[a:b].decode() == unit and unit.strip() == unit and a >= last
        assert not raw[last:a].decode().strip("﻿ \n\t")
        last = b
    assert not raw[last:].decode().strip()


def test_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", 9), (2, None, 9), (3, "", 9), (1, "One. Two.", 9), (4, "Ä. " * 3000 + "Ende.", 9)], "text_id long, text string, sent_no int")
    rows = s.split_sentences(df).collect()
    assert sum(r.text_id == 1 for r in rows) == 4 and not [r for r in rows if r.text_id in (2, 3)]
    assert max(r.end_byte for r in rows) == len(("Ä. " * 3000 + "Ende.").encode())
    assert s.split_sentences(df.limit(0)).collect() == []


def test_time_is_linear_in_the_text():
    import time

    for unit in ("( a ] b ", "a.", "(a. ", "“A b. ", "Am 12. Mai. ", "# a\n", "Wort.Wort", '"A b." c '):
        took = []
        for n in (4_000, 16_000):
            began = time.process_time()
            s.spans(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, unit
