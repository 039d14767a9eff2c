"""Sentence units with byte offsets for texts in any script.

A pushdown automaton reads each block (text between blank lines): its stack holds the open quotations and
brackets and the level of the current list item, tries hold the abbreviations, and tables of script
terminators say which characters may end a unit. Nothing is shared between documents, so the operator is one
narrow Arrow stage without a shuffle.

Cases: null, empty and blank texts give no unit; a text of any length is one linear scan; repeated rows give
repeated units; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from quillspark.operators.rows import flat_map

#: Abbreviations that never end a sentence (titles, references, measures), in several languages.
NEVER = """
dr prof mr mrs ms mme mlle mm sr sra srta dra st ste hr fr frl herrn ing dipl sig sigg dott dottssa avv mevr dhr drs
fig figs abb vol kap nr núm num art pag pág págs págg pp ss blz afb afd hfst vgl cf vs approx ca aprox env circa bzw inkl exkl zzgl ggf evtl
vgl insb bes sog geb gest av avda blvd ave rd nos vols eds ed al см стр рис гл напр им ул г-н д-р проф табл
डॉ श्री पृ सं ص ج د
""".split()
#: Abbreviations that end a sentence when a capital follows.
MAYBE = """
etc usw ecc enz etz inc ltd corp co bros jr sen est min max dept univ руб тыс млн млрд коп др пр
jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil okt dez mio mrd tel str
""".split()
#: Only before a number.
NUMBERED = "no nº n° № p s".split()
MONTHS = """
januar jänner februar märz april mai juni juli august september oktober november dezember
""".split()
ORDINAL_NOUNS = MONTHS + "jahrhundert jahrhunderts jahrtausend kapitel klasse stock auflage tag mal geburtstag weltkrieg platz runde".split()
ORDINAL_BEFORE = "am im vom zum der die das den dem des ab bis seit beim jeder jeden jede ein einem einer".split()
STARTERS = """
the a an in on at by our this that these it he she they we you i there what when where why how no not if for please
der die das ein eine in im am wir er sie es dies dieses diese wenn und zu aus nach mit
el la los las un una en por para si no y pero más le les des du ce cette il elle nous vous à dans
""".split()
SAID = """
said asked replied answered called whispered shouted cried added wondered says asks
dijo preguntó respondió dit demande répond sagte fragte rief antwortete meinte vroeg zei disse perguntou chiese disse chiede
сказал сказала спросил спросила ответил ответила कहा पूछा बोला बोली قال سأل
""".split()
SAID_CJK = re.compile("[说問问道喊答叫]")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕"}
QUOTES = {"«": "»", "“": "”", "„": "“”", "‘": "’", "‚": "‘’", "‹": "›", "「": "」", "『": "』", "»": "«", "›": "‹", "《": "》", '"': '"', "'": "'"}
CLOSING = "\"'’”“»«›‹」』》)]}）］】〕"
FULL = "。！？｡．"  # need no space after them
DANDA = "।॥؟۔"


def trie(words: list[str]) -> dict:
    """Trie over reversed words: read leftwards from a full stop."""
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node["$"] = True
    return root


_NEVER, _MAYBE, _NUMBERED = trie(NEVER), trie(MAYBE), trie(NUMBERED)
_STARTERS, _SAID, _ORD, _ORD_BEFORE = map(frozenset, (STARTERS, SAID, ORDINAL_NOUNS, ORDINAL_BEFORE))
_SPACE = r"\s﻿​"
_BLANK = re.compile(rf"(?:\r\n|[\n\r ])[^\S\r\n]*﻿?(?:(?:\r\n|[\n\r ])[{_SPACE}]*)+")
_ITEM = re.compile(r"(?m)^([ \t]*)([-*•‣·–+]|\(?\d{1,3}[.)]|\(?[a-z][.)]|#{1,6})[ \t]+(?=\S)")
_LINE_END = re.compile("[\r\n]")
_BULLET = re.compile(r"[-*•‣·+#]")
_MARK = re.compile(r"[.!?…。！？｡．।॥؟۔]+|[\"'’‘‚“”„«»‹›「」『』《》()\[\]{}（）［］【】〔〕]")
_WORD = re.compile(r"[^\W_]+")
_TRIM = re.compile(rf"[{_SPACE}]*")
_NEXT = re.compile(rf"[{_SPACE}]*[\"'’‘‚“”„«»‹›「『《(\[{{（［【¿¡*_–—-]*[{_SPACE}]*")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[ \t\xa0]+(?:\r?\n[ \t\xa0]*)?(?=[฀-๿])|(?<=[\d฿])[ \t]+(?=[฀-๿]{6})")
_THAI_INNER = re.compile(r"\b\d[\d.,:]*\s*\Z")
_CASELESS = re.compile("[֐-ࣿऀ-໿぀-ヿ㐀-鿿가-힯]")


def _in(tree: dict, text: str, end: int, begin: int) -> bool:
    """Whether a word of the trie ends at end and starts at a word border."""
    node, i = tree, end
    while i > begin:
        c = text[i - 1].lower()
        if c not in node:
            break
        node, i = node[c], i - 1
        if "$" in node and (i == begin or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            return True
    return False


def _left_word(text: str, end: int, begin: int) -> str:
    i = end
    while i > begin and (text[i - 1].isalnum() or text[i - 1] == "." or "ऀ" <= text[i - 1] <= "෿"):
        i -= 1
    return text[i:end]


def _back(text: str, at: int, begin: int) -> int:
    """Where the white space before a place begins."""
    while at > begin and text[at - 1].isspace():
        at -= 1
    return at


def _plain_word(text: str, end: int, begin: int) -> bool:
    """Whether a word of two letters or more, small but for the first, ends here and follows no full stop."""
    i = end
    while i > begin and text[i - 1].isalnum():
        i -= 1
    if end - i < 2 or i > begin and (text[i - 1] == "." or "ऀ" <= text[i - 1] <= "෿"):
        return False
    return text[i:end].isalpha() and text[i + 1:end].islower()


def _dot_ends(text: str, dot: int, begin: int, after: int, end: int) -> bool:
    """Whether the single full stop at dot ends a sentence; after: where the next word begins."""
    left = _left_word(text, dot, begin)
    m = _WORD.match(text, after, end)
    word = m.group() if m else ""
    if not left:
        return True
    if left.isdecimal():
        if word.lower() in _ORD:
            return False
        before = _left_word(text, _back(text, dot - len(left), begin), begin).lower() if len(left) <= 2 else ""
        return not (before in _ORD_BEFORE and word[:1].isupper())
    if "." in left:
        if left[-1].isdecimal():
            return True
        short = all(len(x) <= 2 for x in left.split("."))
        if not short:
            return True
        return left.lower().endswith((".m", ".s")) and word.lower() in _STARTERS or left.lower().endswith(".m") and not word[:1].isdigit()
    letters = sum(c.isalnum() for c in left)
    if letters == 1 and not left.isdecimal():
        return False
    if left.isascii() and left.isalpha() and not set(left.lower()) & set("aeiouy") and not left.isupper() and left.lower() not in MAYBE:
        return False  # no word without a vowel
    if _in(_NEVER, text, dot, begin):
        return left.lower() == "st" and word.lower() in _STARTERS
    if _in(_NUMBERED, text, dot, begin):
        return not word[:1].isdigit()
    if _in(_MAYBE, text, dot, begin):
        return not word[:1].isdigit() and (left.lower() not in ("inc", "corp", "co", "ltd", "dept", "univ", "tel", "str") or word.lower() in _STARTERS)
    return True


def _pairs(text: str, a: int, b: int) -> dict[int, int]:
    """Opening to closing position of every matched quotation and bracket of a block."""
    stack: list[tuple[int, str]] = []
    depths: dict[str, list[int]] = {}  # by closer: where in the stack its openers are, so that a stray closer costs no search
    out: dict[int, int] = {}

    def push(i: int, closers: str) -> None:
        for x in closers:
            depths.setdefault(x, []).append(len(stack))
        stack.append((i, closers))

    for m in _MARK.finditer(text, a, b):
        c, i = m.group(), m.start()
        if c[0] in ".!?…。！？｡．।॥؟۔":
            continue
        if depths.get(c) and not (c in "'’" and i + 1 < b and text[i + 1].isalnum()):
            k = depths[c][-1]
            out[stack[k][0]] = i
            while len(stack) > k:
                for x in stack.pop()[1]:
                    depths[x].pop()
        elif c in PAIRS:
            push(i, PAIRS[c])
        elif c in QUOTES:
            if c in "'‘\"" and (i > a and text[i - 1].isalnum() or i + 1 >= b or text[i + 1].isspace() and c != '"'):
                continue
            if c == "“" and i > a and text[i - 1].isalnum() and not _CASELESS.match(text[i - 1]):
                continue
            push(i, QUOTES[c])
    return out


def _attributed(text: str, after: int, end: int, begin: int, opened: int) -> bool:
    """Whether the words after a closed quotation name its speaker."""
    before = _back(text, opened, begin)
    if before > begin and text[before - 1] in ":：":
        return False
    clause = re.split("[.!?。！？।]", text[after:min(end, after + 80)], maxsplit=1)[0]
    if _CASELESS.search(clause):
        if re.search("[一-鿿]", clause) and not re.search("[぀-ヿ]", clause):
            return len(clause) <= 14 and bool(SAID_CJK.search(clause))
    said = [w.lower() for w in clause.split()]
    return len(said) <= 6 and any(w.strip(",;:") in _SAID for w in said)


def _block(text: str, a: int, b: int) -> Iterator[int]:
    """Positions inside the block after which a new unit begins."""
    closes = _pairs(text, a, b)
    opened = {v: k for k, v in closes.items()}
    stack: list[int] = []  # openers around the current position
    brackets, corners = [0], [0]  # how many of the openers up to each depth are brackets, and corner quotes
    begin, skip = a, a
    led = (-1, -1, False)  # whether the first opener leads its sentence

    def leads(x: int) -> bool:
        nonlocal led
        if led[:2] != (begin, x):
            led = begin, x, _back(text, x, begin) == begin
        return led[2]

    def cut(n: int) -> None:
        del stack[n:], brackets[n + 1:], corners[n + 1:]

    for m in _MARK.finditer(text, a, b):
        i, c = m.start(), m.group()
        if i < skip:
            continue
        if i in closes:
            stack.append(i)
            brackets.append(brackets[-1] + (c in PAIRS))
            corners.append(corners[-1] + (c in "「『"))
            continue
        if i in opened:
            n = len(stack)
            while n and stack[n - 1] >= opened[i]:
                n -= 1
            cut(n)
            continue
        if c[0] not in ".!?…。！？｡．।॥؟۔":
            continue
        if brackets[-1] and not (len(stack) == 1 and leads(stack[0])):
            continue
        at, inner = m.end(), len(stack)  # inner: how many of the openers stay open
        first = stack[0] if stack else -1
        while at < b:  # closers belong to the sentence
            j = _TRIM.match(text, at, b).end()
            if at in opened:
                j = at
            elif not (j in opened and text[j] in "»«" and text[at:j].strip("\xa0  ") == "" and inner and opened[j] == stack[inner - 1]):
                if text[at] in "*_" and not (at + 1 < b and text[at + 1].isalnum()):
                    at += 1
                    continue
                break
            if inner and stack[inner - 1] >= opened[j]:
                inner -= 1
            elif not inner:
                break
            at = j + 1
        if brackets[inner]:
            continue
        closed = inner < len(stack)
        after = _NEXT.match(text, at, b).end()
        if _TRIM.match(text, at, b).end() >= b:
            yield b
            return
        nxt = text[after] if after < b else ""
        spaced = at < b and (text[at].isspace() or text[at] == "﻿")
        caseless = bool(nxt) and bool(_CASELESS.match(nxt))
        if c.strip(".…") == "" and (len(c) > 1 or c == "…"):  # ellipsis
            if not nxt.isupper() or not spaced and c[0] == "…":
                continue
        if c[-1] in FULL:
            if closed:
                if at < b and text[at] in "，、；：,;と":
                    continue
                if re.match("って|[とはがをのにで]", text[at:at + 2]) and "぀" <= text[at] <= "ヿ":
                    continue
                if _attributed(text, at, b, begin, first):
                    continue
            if corners[inner] and not spaced and at in opened:
                continue
        elif c[-1] in DANDA:
            if closed and _attributed(text, at, b, begin, first):
                continue
            if not spaced and not nxt:
                continue
        else:
            if not spaced:
                # a missing space does not join sentences
                if not (c == "." and nxt.isupper() and text[at] == nxt and _plain_word(text, i, begin)
                        and after + 1 < b and (text[after + 1].islower() or text[after + 1] == " " or text[after + 1] in "'’")
                        or c != "." and nxt and (nxt.isupper() or caseless) and (after == at or text[at] in "¿¡\"“«„»(") and not (closed and text[at] in "，、,;")):
                    continue
                if c == "." and (_in(_NEVER, text, i, begin) or _in(_MAYBE, text, i, begin)):
                    continue
            if nxt.islower():
                continue
            if at < b and spaced and text[_TRIM.match(text, at, b).end()] in "—–-,;:" and closed:
                if not nxt.isupper() or text[_TRIM.match(text, at, b).end()] in ",;:":
                    continue
            if c == "." and not closed and not _dot_ends(text, i, begin, after, b):
                continue
            if closed and _attributed(text, after, b, begin, first):
                continue
        yield at
        begin = skip = at
        cut(inner)


def _thai(text: str, a: int, b: int) -> Iterator[int]:
    for m in _THAI_GAP.finditer(text, a, b):
        yield m.end()


def _items(text: str, a: int, b: int) -> list[int]:
    """Starts of list items and headings of a block; levels: indent and kind of the markers seen so far."""
    found = list(_ITEM.finditer(text, a, b))
    if not found:
        return []
    levels: list[tuple[int, bool]] = []
    out = []
    numbers = [m for m in found if not _BULLET.match(m.group(2))]
    listed = found[0].start() == a and len(numbers) > 1  # a lone number at a line's start is a wrapped line
    for m in found:
        bullet = bool(_BULLET.match(m.group(2)))
        if not bullet and not listed or bullet and m.group(2) in "–-" and m.start() > a and not levels and len(found) < 2:
            continue
        level = (len(m.group(1)), bullet)
        while levels and levels[-1][0] > level[0]:
            levels.pop()
        if not levels or levels[-1][0] < level[0]:
            levels.append(level)
        out.append(m.start())
        if m.group(2)[0] == "#" and (line := _LINE_END.search(text, m.end(), b)):
            out.append(line.start())
    return out


def spans(text: str | None) -> list[tuple[int, int]]:
    """Character spans of the units, in order."""
    text = text or ""
    out: list[tuple[int, int]] = []
    at = 0
    for end, follow in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        if end > at:
            borders = _items(text, at, end)
            for a, b in zip([at, *borders], [*borders, end]):
                cuts = [*_block(text, a, b)]
                if _THAI.search(text, a, b):
                    cuts = sorted({*cuts, *_thai(text, a, b)})
                for x, y in zip([a, *cuts], [*cuts, b]):
                    x = _TRIM.match(text, x, y).end()
                    while y > x and (text[y - 1].isspace() or text[y - 1] in "﻿​"):
                        y -= 1
                    if x < y:
                        out.append((x, y))
        at = follow
    return out


def units(text: str | None) -> list[tuple[str, int, int]]:
    """(text, start byte, end byte) of each unit."""
    found = spans(text)
    if not found:
        return []
    if text.isascii():
        return [(text[a:b], a, b) for a, b in found]
    out, last, total = [], 0, 0
    for a, b in found:
        total += len(text[last:a].encode("utf-8", "surrogatepass"))
        unit = text[a:b]
        size = len(unit.encode("utf-8", "surrogatepass"))
        out.append((unit, total, total + size))
        total, last = total + size, b
    return out


def _rows() -> Callable[..., Iterator[tuple]]:
    def rows(key, text):  # noqa: ANN001, ANN202
        return [(key, n, x, a, b) for n, (x, a, b) in enumerate(units(text))]

    return rows


def split_sentences(df: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: id, sent_no (from 0), sent_text, start_byte, end_byte."""
    key = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, text_col], _rows, f"`{id_col}` {key}, sent_no int, sent_text string, start_byte bigint, end_byte bigint")
