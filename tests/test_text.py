"""Tokens, sentences, syllables, language vote and counts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import pytext as p


def cut(text):
    return [text[a:b] for a, b in p.sentence_spans(text)]


@pytest.mark.parametrize("text,want", [
    ("One. Two.", ["One.", "Two."]),
    ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
    ("Am 3. Oktober war es so. Danach nicht.", ["Am 3. Oktober war es so.", "Danach nicht."]),
    ("Es war 2020. Danach kam mehr.", ["Es war 2020.", "Danach kam mehr."]),
    ("Er sagt z.B. Folgendes. Gut.", ["Er sagt z.B. Folgendes.", "Gut."]),
    ("J. R. R. Tolkien wrote. Yes!", ["J. R. R. Tolkien wrote.", "Yes!"]),
    ("See example.com now. Ok?", ["See example.com now.", "Ok?"]),
    ('He said "hi." Then left.', ['He said "hi."', "Then left."]),
    ("Wait... what? No!", ["Wait... what?", "No!"]),
    ("no stop\n\nnew block", ["no stop", "new block"]),
    ("one line\nsame sentence.", ["one line\nsame sentence."]),
    ("", []), ("   ", []), ("...", ["..."]),
])
def test_sentences(text, want):
    assert cut(text) == want


@pytest.mark.parametrize("text,want", [
    ("don't e-mail", ["don't", "e-mail"]), ("1.000,50 x.y", ["1.000,50", "x", "y"]), ("l’année —", ["l’année"]), ("-a- 'b'", ["a", "b"]), (None, []),
])
def test_words(text, want):
    assert p.words(text) == want


@pytest.mark.parametrize("word,n", [("make", 1), ("table", 2), ("idea", 3), ("area", 3), ("sea", 1), ("passes", 2), ("notes", 1), ("wanted", 2), ("asked", 1), ("handled", 2), ("business", 2), ("yes", 1), ("myth", 1), ("42", 1), ("queue", 1), ("agreed", 2)])
def test_english_syllables(word, n):
    assert p.syllables(word, "en") == n


@pytest.mark.parametrize("word,n", [("Straße", 2), ("Quelle", 2), ("Familien", 4), ("Wien", 1), ("Chemie", 2), ("Häuser", 2), ("Boot", 1), ("Donaudampfschiff", 4)])
def test_german_syllables(word, n):
    assert p.syllables(word, "de") == n


@pytest.mark.parametrize("text,lang", [("Das ist ein Test und nicht mehr.", "de"), ("This is a test.", "en"), ("Ada Lovelace worked in London.", "en"), ("", "en"), (None, "en"), ("Größe", "de")])
def test_detect(text, lang):
    assert p.detect(text) == lang


def test_counts():
    n, w, s, ch, poly, mono, long = p.counts("The cat sat. Dogs ran quickly.", "en")
    assert (n, w, s, ch, mono, long) == (2, 6, 7, 23, 5, 1)
    assert p.counts(None, "en") == (0,) * 7


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBü. !?\n\"'()1,…–ß "), max_size=60))
def test_invariants(text):
    spans = p.sentence_spans(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == re.sub(r"\s", "", text)
    flat = [x for s in spans for x in s]
    assert p.byte_offsets(text, flat) == [len(text[:i].encode()) for i in flat]
