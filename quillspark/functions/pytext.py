"""Scalar text kernels run inside Arrow UDFs: tokens, sentences, syllables, language vote, counts.

Offsets are UTF-8 bytes, lengths are code points, letters are Unicode L, digits Unicode Nd.
Every function is total: null is treated as the empty text, which gives no tokens and no sentences.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

# --- fixed values (must equal the published behaviour) -------------------------------------------
ABBREVIATIONS = frozenset("""
mr mrs ms dr prof st jr sr vs etc inc ltd co corp dept approx fig no vol
univ ave blvd rd est min max sec al ed eds cf ibid
jan feb mar apr jun jul aug sep sept oct nov dec
bzw ca usw evtl inkl exkl nr abb hr fr ggf ggfs vgl bspw mio mrd jh jhd
str bzgl sog tel dt engl geb gest kap bes allg urspr insb zzgl mind
hrsg anm bsp tsd mtl jhrl versch entspr
""".split())
CLOSERS = "\"'’”“»«›)]}*_"
OPENERS = "\"'‘“„«»‹([{-–—*#>•"
STOP_DE = frozenset("""
der die das den dem des ein eine einen einem einer eines und oder aber auch
noch nur schon nicht ist sind sein seine ihre haben hatte hatten werden wird
wurde wurden mit von zu zum zur auf für aus bei nach über unter vor durch
gegen ohne um im beim vom als dass daß weil wenn dann sich ich du er sie es
wir uns euch mich dich ihm ihn ihnen kann können muss müssen soll sollen
wollen sehr mehr wie was wer wo hier dort diese dieser dieses jede jeden
alle alles heute immer wieder zwischen bis nun etwa dabei damit dazu doch
nichts schon seit sowie werden viele einige zwar deshalb jedoch
""".split())
STOP_EN = frozenset("""
the of and to a is it that for on are as with be at this have from or by not
but what all were we when there can which do how out about many then them
some would like into time has more see could people than been who now find
down did get come made may over new take only work know year most very after
our just think say where through much before too right any same want also
well must even because here why ask need home again off play life always
both together group often until without second later idea enough real almost
above while might next open begin still should world high every near own
last never start under they their there's you your his her him she its
""".split())
SUFFIX_DE = ("ung", "keit", "heit", "schaft", "lich", "isch", "chen", "tät", "ungen", "nisse")
SYLLABLES_EN = {
    "business": 2, "businesses": 3, "science": 2, "sciences": 2, "scientist": 3, "scientists": 3,
    "scientific": 4, "create": 2, "creates": 2, "created": 3, "creating": 3, "creation": 3, "creative": 3,
    "poem": 2, "poems": 2, "poet": 2, "poetry": 3, "aisle": 1, "wednesday": 2, "colonel": 2,
}
FOLDS = (("a", "äàáâãåāąæ"), ("o", "öòóôõøō"), ("u", "üùúûū"), ("e", "èéêëēę"), ("i", "ìíîïī"), ("s", "ßśš"),
         ("c", "çćč"), ("n", "ñń"), ("y", "ýÿ"), ("l", "ł"), ("z", "żźž"), ("r", "ř"), ("d", "ďđ"))
DETECT_WORDS = 2000
# --------------------------------------------------------------------------------------------------

_FOLD = {ord(c): base for base, cs in FOLDS for c in cs}
#: One token; also written into SQL, so it has no look-around.
TOKEN = r"(?:\p{Nd}(?:[.,]\p{Nd})*|\p{L})(?:['’‘´‐-]?(?:\p{Nd}(?:[.,]\p{Nd})*|\p{L}))*"
_TOKEN = regex.compile(TOKEN)
_SPACE = " \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = re.compile(f"[{_SPACE}]*")
_OPEN = re.compile(f"[{re.escape(OPENERS)}]*")
_CLOSE = re.compile(f"[{re.escape(CLOSERS)}]*")
_BREAK = re.compile(f"[.!?…]+|\n[{_SPACE}]*")
_LEFT = regex.compile(r"[\p{L}\p{Nd}.]*+$")
_NOT_MEASURED = regex.compile(r"[^\p{L}\p{Nd}]+")
_GAP = re.compile("[.!?…\n:]")


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text or "")


def spans(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text or "")]


def _dot_ends(text: str, dot: int) -> bool:
    """Whether a single full stop may end a sentence, from what stands left of it."""
    if dot and text[dot - 1].isdecimal():
        return dot >= 3 and text[dot - 2].isdecimal() and text[dot - 3].isdecimal()
    i = dot
    while i and ((c := text[i - 1]) == "." or c.isdecimal() or c.isalpha()):
        i -= 1
    left = text[i:dot]
    if not left:
        return True
    if "." in left or len(left) == 1:
        return False
    return not (left.isascii() and left.isalpha() and left.lower() in ABBREVIATIONS)


def _starts(text: str, at: int) -> bool:
    if at >= len(text):
        return True
    after = _WS.match(text, at).end()
    if after == at:
        return False
    after = _OPEN.match(text, after).end()
    return after >= len(text) or regex.match(r"\p{Ll}", text[after]) is None


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    a = _WS.match(text, a, b).end()
    while b > a and _WS.fullmatch(text[b - 1]):
        b -= 1
    return a, b


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Character spans of the sentences, trimmed, empty ones left out."""
    text = text or ""
    out, begin, skip = [], 0, 0
    for m in _BREAK.finditer(text):
        if m.start() < skip:
            continue
        if text[m.start()] == "\n":
            if m.group().count("\n") < 2:
                continue
            end = m.end()
        else:
            if m.group() == "." and not _dot_ends(text, m.start()):
                continue
            end = _CLOSE.match(text, m.end()).end()
            if not _starts(text, end):
                continue
        out.append(_trim(text, begin, end))
        begin = skip = end
    out.append(_trim(text, begin, len(text)))
    return [(a, b) for a, b in out if a < b]


def byte_offsets(text: str, at: list[int]) -> list[int]:
    """UTF-8 byte offsets of ascending character offsets."""
    if text.isascii():
        return at
    out, last, total = [], 0, 0
    for i in at:
        total += len(text[last:i].encode("utf-8", "surrogatepass"))
        last = i
        out.append(total)
    return out


def fold(word: str) -> str:
    return "".join(_FOLD.get(ord(c)) or (c if c.isascii() else "x") for c in word.lower() if c.isalpha())




@lru_cache(200_000)
def syllables_en(word: str) -> int:
    s = fold(word)
    if not s:
        return 0
    if s in SYLLABLES_EN:
        return SYLLABLES_EN[s]
    v = "x" + s[1:] if s[0] == "y" else s
    n = groups = len(re.findall("[aeiouy]+", v))
    if len(s) >= 4 and groups >= 2 and re.search("[^aeiouy](?:ea|ia|io)$", v):
        n += 1
    if len(s) >= 3:
        silent = (
            re.search("[^aeiouy]e$", v) and not re.search("[^aeiouy]le$", v)
            or re.search("[^aeiouy]es$", v) and not re.search("[^aeiouy]les$|[sxzcgj]es$|[cs]hes$", v)
            or re.search("[^aeiouytd]ed$", v) and not re.search("[^aeiouy]led$", v)
        )
        n -= bool(silent)
    return max(1, n)


@lru_cache(200_000)
def syllables_de(word: str) -> int:
    s = fold(word)
    if not s:
        return 0
    nuclei = re.findall("a[uiya]|e[uiye]|ie|oo|[aeiouy]", s.replace("qu", "q"))
    extra = len(s) >= 6 and s.endswith("ien") and nuclei[-1:] == ["ie"]
    return max(1, len(nuclei) + extra)


def syllables(word: str, lang: str) -> int:
    n = (syllables_de if lang == "de" else syllables_en)(word)
    return n or 1  # numbers are words of one syllable


def measure(word: str) -> int:
    """Letters and digits of a token."""
    return len(word) if word.isalnum() else len(_NOT_MEASURED.sub("", word))


def detect(text: str | None) -> str:
    """en or de by a vote of stop words, umlauts, endings and capitals; en where nothing speaks for either."""
    text, de, en, caps, n, last = text or "", 0.0, 0.0, 0, 0, -1
    for m in _TOKEN.finditer(text):
        n += 1
        if n > DETECT_WORDS:
            break
        tok = m.group()
        low = tok.lower()
        size = len(low) if low.isascii() else len(low.encode())
        de += low in STOP_DE
        en += low in STOP_EN
        if any(c in "äöüÄÖÜß" for c in tok):
            de += 2
        if size >= 6 and low.endswith(SUFFIX_DE):
            de += 1.5
        if size >= 5 and low.endswith(("ing", "ly")):
            en += 1
        if "n't" in low or low.endswith(("'s", "’s")):
            en += 1
        if last >= 0 and tok[0].isupper() and any(c.islower() for c in tok) and not _GAP.search(text, last, m.start()):
            caps += 1
        last = m.end()
    if n >= 5 and de > 0:
        de += 0.4 * caps
    return "de" if de > en else "en"


STAT_FIELDS = ("sentences", "words", "syllables", "characters", "polysyllabic_words", "monosyllabic_words", "long_words")


def counts(text: str | None, lang: str) -> tuple[int, ...]:
    """STAT_FIELDS of a text; sentences without a word don't count."""
    text = text or ""
    n = w = s = ch = poly = mono = long = 0
    syl = syllables_de if lang == "de" else syllables_en
    for a, b in sentence_spans(text):
        toks = _TOKEN.findall(text, a, b)
        n += bool(toks)
        w += len(toks)
        for t in toks:
            k = syl(t) or 1
            s += k
            poly += k >= 3
            mono += k == 1
            m = measure(t)
            ch += m
            long += m > 6
    return n, w, s, ch, poly, mono, long


def reading_ease(n: int, w: int, s: int, lang: str) -> float | None:
    """Unrounded reading ease on the scale of the language; None without words."""
    if not n or not w:
        return None
    return 180 - w / n - 58.5 * (s / w) if lang == "de" else 206.835 - 1.015 * (w / n) - 84.6 * (s / w)
