"""Markup residue: which families of markup a text carries, and the clean text with its structure kept.

A lexer finds every sign that may be markup (HTML, Markdown, wiki, LaTeX) and nests the finds into a tree by
containment. Gradient-boosted trees over node features (subtree density, attribute tokens, depth, siblings,
neighbouring characters) give each node a probability of being markup rather than a sign used literally, and a
top-down decoding keeps the choices consistent: what stands in the syntax or the code of an accepted ancestor is
not markup of its own, and partners (open and close, rows of a table, items of a list) share one decision.

The trees are fitted on sentences of a bounded sample (SAMPLE rows) into which markup and literal signs are put
by rule, so the labels are exact; scoring and cleaning are narrow Arrow stages over whole texts.

Cases: null gives no family and null text; blank gives blank; texts of any length are read whole; repeated rows give
repeated results; unclosed constructs count by their own signs.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import sample as samples
from quillspark.operators.rows import flat_map

SAMPLE = 400
TREES, DEPTH, RATE = 60, 3, 0.25

TAGS = frozenset(
    "a abbr b big blockquote body br caption cite code col dd del div dl dt em figure font footer h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li link main meta nav ol p pre q ref s samp script section small span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var".split()
)
COMMANDS = frozenset(
    "alpha begin beta bf caption chapter cite citep citet delta displaystyle document dots emph end enumerate epsilon eqref eta footnote frac gamma ge geq href in infty int item itemize it label lambda ldots le left leq maketitle mathbb mathbf mathrm mu ne neq nu omega paragraph partial phi pi pm prod psi ref rho right rm section sigma sqrt subsection subsubsection sum tau text textbf textit texttt textsc theta times title to underline url usepackage varepsilon xi zeta cdot".split()
)
#: Kind, family, signs of which a text must have one, and pattern. Every pattern stops at the next sign of its own kind, so constructs of
#: any length are found in time linear in the text.
PATTERNS = [
    ("comment", "html", "<!--", r"<!--.*?(?:-->|\Z)"),
    ("tag", "html", "<", r"</?[A-Za-z][A-Za-z0-9-]*(?:(?:\s|&nbsp;|/)[^<>]*)?>|<[^<>\n\s][^<>\n]*>"),
    ("entity", "html", "&", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,9});?"),
    ("fence", "markdown", "``` ~~~", r"(?m)^[ \t]*(?:```|~~~)[^\n]*\n(?:.*?\n)??[ \t]*(?:```|~~~)[ \t]*$|```[^`]*```"),
    ("code", "markdown", "`", r"(?<!`)`[^`\n]+`(?!`)"),
    ("strong", "markdown", "*", r"(?<![*\\])\*{1,3}[^*\n]+\*{1,3}"),
    ("under", "markdown", "_", r"_{1,3}[^_\n]+_{1,3}|(?<=\w)_(?=\w)"),
    ("strike", "markdown", "~", r"~~[^~\n]+~~|~(?=\d)"),
    ("atx", "markdown", "#", r"(?m)^[ \t]{0,3}#{1,6}[ \t]*[^\s#][^\n]*"),
    ("setext", "markdown", "--- ===", r"(?m)(?<=\n)[=-]{3,}[ \t]*$"),
    ("link", "markdown", "[", r"!?\[[^\[\]\n]*\](?:\([^()\n]*\)|\[[^\[\]\n]*\])?"),
    ("row", "markdown", "|", r"(?m)^[ \t]*\|[^\n]*\|[ \t]*$|(?<=\w) \| (?=\w)"),
    ("bullet", "markdown", "", r"(?m)^[ \t]*(?:[-+*]|>|\d{1,3}[.)])[ \t]+(?=\S)"),
    ("wlink", "wiki", "[[", r"\[\[[^\[\]\n]+\]\]"),
    ("template", "wiki", "{{", r"\{\{[^{}]+\}\}"),
    ("quotes", "wiki", "''", r"'{2,5}[^'\n]+'{2,5}"),
    ("wheading", "wiki", "==", r"={2,6}[^=\n]+={2,6}|(?<=\w )==(?= \w)"),
    ("wtable", "wiki", "{|", r"\{\|.*?(?:\|\}|\Z)"),
    ("wrow", "wiki", "| !", r"(?m)^\|(?:-(?!-)|[+}])[^\n]*$|^[|!] [^\n|]*$"),
    ("switch", "wiki", "__", r"__[A-Z]{3,}__"),
    ("command", "latex", "\\", r"~?\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("math", "latex", "$ \\", r"\$\$[^$]+\$\$|\$[^$\n]+\$|\\\[(?:(?!\\\[).)+?\\\]|\\\((?:(?!\\\().)+?\\\)"),
    ("group", "latex", "{", r"\{[^{}|\n]+\}"),
    ("caret", "latex", "^", r"(?<=\w)\^(?:\{[^{}\n]*\}|\w)"),
]
KINDS = [k for k, *_ in PATTERNS]
FAMILY = {k: f for k, f, *_ in PATTERNS}
_RES = [(k, signs.split(), re.compile(p, re.S)) for k, _, signs, p in PATTERNS]
_RANK = {k: i for i, k in enumerate(KINDS)}
_ANY = re.compile(r"[<&`*_~#=\[|>{'\\$^]|(?m:^[ \t]*(?:[-+]|\d{1,3}[.)])[ \t])")
OPAQUE = {"fence", "code", "math", "comment"}  # nothing inside them is markup of its own
_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9]*)")
_CMD = re.compile(r"~?\\([A-Za-z]+)")
_SPACES = re.compile(r"[^\S\n]*")
_LINE_END = re.compile(r"[^\S\n]*(?:\n|\Z)")


class Node:
    __slots__ = ("kind", "a", "b", "parent", "children", "depth", "p", "keep")

    def __init__(self, kind: str, a: int, b: int):
        self.kind, self.a, self.b = kind, a, b
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.depth = 0
        self.p = 0.0
        self.keep = False


def tree(text: str) -> list[Node]:
    """All candidate nodes, parents set by containment."""
    if not _ANY.search(text):
        return []
    found = [Node(k, m.start(), m.end()) for k, signs, rx in _RES if not signs or any(x in text for x in signs) for m in rx.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda n: (n.a, -n.b, _RANK[n.kind]))
    stack: list[Node] = []
    for n in found:
        while stack and stack[-1].b <= n.a:
            stack.pop()
        for up in reversed(stack):
            if up.b >= n.b:
                n.parent, n.depth = up, up.depth + 1
                up.children.append(n)
                break
        stack.append(n)
    return found


def _kind(c: str) -> int:
    return 0 if not c else 1 if c == "\n" else 2 if c.isspace() else 3 if c.isdigit() else 4 if c.isalpha() else 5


def features(text: str, nodes: list[Node]) -> np.ndarray:
    size = Counter(n.kind for n in nodes)
    fam = Counter(FAMILY[n.kind] for n in nodes)
    below = [0] * len(nodes)
    at = {id(n): i for i, n in enumerate(nodes)}
    for n, i in zip(reversed(nodes), range(len(nodes) - 1, -1, -1)):  # children come after their parents
        if n.parent is not None:
            below[at[id(n.parent)]] += 1 + below[i]
    like = [Counter(c.kind for c in n.children) if n.children else None for n in nodes]
    rows = []
    begin = until = -1  # the line of the current node, and where its text begins
    lead = 0
    for i, n in enumerate(nodes):
        s = text[n.a:n.b]
        inner = s.strip("*_`~'=#$<>/[]{}|&;\\")
        left, right = text[n.a - 1:n.a], text[n.b:n.b + 1]
        name = _NAME.match(s) if n.kind == "tag" else _CMD.match(s) if n.kind == "command" else None
        word = name.group(1).lower() if name else ""
        known = word in (TAGS if n.kind == "tag" else COMMANDS)
        attributes = len(re.findall(r"[\w-]+\s*=\s*[\"'\w]", s)) if n.kind == "tag" else s.count("{")
        if not begin <= n.a < until:
            begin, until = text.rfind("\n", 0, n.a) + 1, text.find("\n", n.a) + 1 or len(text) + 1
            lead = _SPACES.match(text, begin).end()
        start = n.a <= lead
        ends = _LINE_END.match(text, n.b) is not None
        siblings = like[at[id(n.parent)]][n.kind] if n.parent else size[n.kind]
        opener = re.match(r"\W*", s).group()
        closer = s[len(s.rstrip("*_`~'=#$>]})|;")):]
        rows.append([
            _RANK[n.kind], len(s), len(inner), len(inner) / (len(s) + 1), below[i], len(s) / (1 + below[i]), n.depth,
            _RANK[n.parent.kind] if n.parent else -1, siblings, fam[FAMILY[n.kind]], _kind(left), _kind(right),
            _kind(inner[:1]), _kind(s[len(opener):][:1]), inner != inner.strip() or (len(s) > 2 and (s[len(opener) - 1:len(opener)].isspace() or s.rstrip("*_`~'=#$>]})|;")[-1:].isspace())),
            sum(c.isdigit() for c in inner) / (len(inner) + 1), known, attributes, start, ends, len(opener.strip()), len(closer),
            opener.strip() == closer[::-1] and bool(closer), s.endswith(";"), "](" in s or "][" in s, left in (":", "\\") or text[n.b:n.b + 1] == "\\", bool(re.match(r"[$]\d", s)), len(inner.split()),
        ])
    return np.array(rows, np.float32)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[list] = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-9
            t = self._grow(x, g, h, np.arange(len(y)), cuts, DEPTH)
            self.trees.append(t)
            f += RATE * self._apply(t, x)

    def _grow(self, x, g, h, rows, cuts, depth):  # noqa: ANN001, ANN202
        value = float(g[rows].sum() / (h[rows].sum() + 1))
        if depth == 0 or len(rows) < 12:
            return value
        gs, hs = g[rows], h[rows]
        whole = gs.sum() ** 2 / (hs.sum() + 1)
        best = (1e-3, None, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            bins = np.searchsorted(c, x[rows, j], "left")
            gl = np.cumsum(np.bincount(bins, gs, len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins, hs, len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(c[k]))
        if best[1] is None:
            return value
        low = x[rows, best[1]] <= best[2]
        return [best[1], best[2], self._grow(x, g, h, rows[low], cuts, depth - 1), self._grow(x, g, h, rows[~low], cuts, depth - 1)]

    def _apply(self, t, x):  # noqa: ANN001, ANN202
        if not isinstance(t, list):
            return np.full(len(x), t)
        low = x[:, t[0]] <= t[1]
        return np.where(low, self._apply(t[2], x), self._apply(t[3], x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if getattr(self, "flat", None) is None or len(self.flat[2]) != len(self.trees):
            self.flat = self._flatten()
        column, cut, leaf = self.flat
        each = np.arange(len(leaf))
        at = np.zeros((len(x), len(leaf)), np.intp)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, column[each, at]] > cut[each, at])
        return 1 / (1 + np.exp(-(self.base + RATE * leaf[each, at - (2**DEPTH - 1)].sum(1))))

    def _flatten(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trees filled up to full depth, as arrays: columns and cuts of the inner nodes, values of the leaves."""
        inner = 2**DEPTH - 1
        column, cut = np.zeros((len(self.trees), inner), np.intp), np.full((len(self.trees), inner), np.inf)
        leaf = np.zeros((len(self.trees), inner + 1))

        def put(i: int, t: list | float, at: int) -> None:
            if at >= inner:
                leaf[i, at - inner] = t
                return
            low, high = t, t
            if isinstance(t, list):
                column[i, at], cut[i, at], low, high = t
            put(i, low, 2 * at + 1)
            put(i, high, 2 * at + 2)

        for i, t in enumerate(self.trees):
            put(i, t, 0)
        return column, cut, leaf


# --- training texts -------------------------------------------------------------------------------
def _word(r: random.Random, s: str) -> str:
    return r.choice([w for w in s.split() if w.isalpha()] or ["word"])


def _marked(r: random.Random, s: str, plain: list[str]) -> str:
    """A snippet of markup around plain words."""
    if r.random() < 0.15:  # constructs of any length
        s, n = " ".join([s, *(r.choice(plain) for _ in range(r.randint(1, 5)))]), r.randint(1, 99)
        many = " + ".join(f"x_{i}^{n}" for i in range(n % 40 + 3))
        return r.choice([f"**{s}**", f"*{s}*", f"_{s}_", f"`{s}`", f"~~{s}~~", f"[{s}](https://a.example/{n})", f"![{s}](/{n}.png)", f"[{_word(r, s)}](https://a.example/{'-'.join(s.split())})", f"[[{s}]]", f"{{{{{_word(r, s)}|{s}}}}}", f"'''{s}'''",
                         f"''{s}''", f"\\textbf{{{s}}}", f"\\footnote{{{s}}}", f"\\emph{{{s}}}", f"${many}$", f"\\[ {many} \\]", f"\\( {many} \\)", f"<div title=\"{s}\">"])
    w, v, n = _word(r, s), _word(r, s), r.randint(1, 99)
    name = r.choice(sorted(TAGS))
    cmd = r.choice(sorted(COMMANDS))
    return r.choice([
        lambda: f"<{name}>{s}</{name}>", lambda: f"<{name} class=\"{v}\">{w}</{name}>", lambda: f"<{name.upper()} STYLE='x'>{s}", lambda: r.choice(["<br>", "<br/>", "<hr />", "<p>"]),
        lambda: f"<a href=\"/{w}/{n}\">{v}</a>", lambda: f"<!-- {w} -->", lambda: f"{w}&{r.choice(['nbsp', 'amp', 'quot', 'lt', 'gt', 'mdash', 'hellip', 'uuml', '#39', '#x27', '#160'])};{v}", lambda: f"\n<ul><li>{w}</li><li>{v}</li></ul>\n",
        lambda: f"\n{'#' * r.randint(1, 6)} {s}\n", lambda: f"\n{s}\n{r.choice('=-') * r.randint(3, 20)}\n", lambda: f"**{w}** {v}", lambda: f"*{w} {v}*", lambda: f"_{w} {v}_", lambda: f"__{w}__", lambda: f"`{w}`", lambda: f"\n```{r.choice(['', 'py'])}\n{w} = {n}\n```\n",
        lambda: f"[{w}](https://{v.lower()}.example/{n})", lambda: f"![{w}](/{v}.png)", lambda: f"\n| {w} | {v} |\n|---|---|\n| {n} | {n + 1} |\n", lambda: f"\n- {s}\n- {w} {v}\n- {v}\n", lambda: f"\n> {s}\n", lambda: f"~~{w}~~", lambda: f"\n1. {s}\n2. {w}\n",
        lambda: f"[[{w}]]", lambda: f"[[{w.title()}|{v}]]", lambda: f"[[File:{w}.jpg|thumb|{v}]]", lambda: f"[[Category:{w}]]", lambda: f"{{{{{w}|{v}}}}}", lambda: f"{{{{{w}:{v}}}}}", lambda: f"'''{w}'''", lambda: f"''{w} {v}''", lambda: f"\n{'=' * (k := r.randint(2, 4))} {s} {'=' * k}\n",
        lambda: f"\n{{| class=\"{w}\"\n|-\n| {n}\n| {v}\n|}}\n", lambda: f"__{w.upper()}TOC__" if len(w) > 2 else "__TOC__",
        lambda: f"\\{cmd}{{{w}}}", lambda: f"~\\cite{{{w.lower()}{n}}}", lambda: f"$\\{cmd}_{{{n}}}$", lambda: f"$x_{n}^{n} + y$", lambda: f"$E = {r.choice('abk')}^{{{n}}}$", lambda: f"\\[ \\sum_{{i=0}}^{{{n}}} a_i \\{cmd} b \\]", lambda: f"\n\\begin{{itemize}}\n\\item {w} {v}\n\\item {s}\n\\end{{itemize}}\n",
        lambda: f"{{\\displaystyle {r.choice('uvxy')}_{{{n}}} \\geq 0}}", lambda: f"\\textbf{{{w} {v}}}", lambda: f"\\section*{{{s}}}", lambda: f"\\ref{{fig:{n}}}", lambda: f"$\\frac{{a}}{{{n}}}$",
    ])()


def _literal(r: random.Random, s: str) -> str:
    """A sentence that uses such signs as themselves."""
    w, v, n, m = _word(r, s), _word(r, s), r.randint(1, 99), r.randint(1, 99)
    return r.choice([
        f"{w} a < b {v} c > d.", f"{w} a<b {v} c>d.", f"if a<{w.lower()} and c>{v.lower()} then.", f"{w} x<{n} {v} y>{m}.", f"{w} {n} < {m} {v}.", f"{w} x > {n} {v} y < {m}.", f"{w.title()}&{v.title()} {w}.", f"R&D {v}.", f"{w} & {v}.", f"${n} {w} {v} ${m} {w}.", f"${n},50 {w}.", f"{n}* {w} {m}* {v}.", f"{w} {n}* {v}.", f"{n}*{m} = {n * m}.",
        f"{w}_{v}_{n} {w}.", f"{w.lower()}_final_v{n} {v}.", f"{w.upper()}_{v.upper()} {w}.", f"#{n} {w}.", f"C# {w} F#.", f"{w} x == y {v}.", f"{w} x != y == {n}.", f"[sic] {w}.", f"[...] {w}.", f"[{n}] {w}.", f"{{a, b}} {w}.", f"{{{n}, {m}}} {v}.", f"2^{n} {w}.", f"e^x {v}.",
        f"C:\\{w.lower()}\\{v.lower()} {w}.", f"D:\\{w.lower()}\\new\\{v.lower()}.", f"\\\\{w.lower()}\\{v.lower()} {w}.", f"~{n} km {w}.", f"{w} | {v}.", f"-{n} °C {w}.", f"{n} - {m} {w}.", f"{w}'s {v}s' {w}.", f"'{w}' {v}.", f"\"{w}\" {v}.", f":-) {w}.", f"<3 {w}.", f"{w}/{v} {n}%.", f"({w}) {v}.", f"@{w} {v}.",
    ])


def train(texts: list[str], seed: int = 7) -> Boosted:
    """Trees fitted on sentences of the texts with markup and literal signs put in by rule."""
    r = random.Random(seed)
    plain = [x for t in texts for x in re.split(r"(?<=[.!?])\s+", t) if 20 < len(x) < 200 and not re.search(r"[<&`*_~#=\[\]|>{}'\\$^]", x)]
    plain = plain or ["The archive keeps a list of plain words.", "The editor checks two short reports in the first section."]
    xs, ys = [], []
    for turn in range(900):
        parts: list[tuple[str, bool | None]] = []
        some = r.random() < 0.5
        for _ in range(r.randint(2, 6)):
            parts.append((r.choice(plain) + " ", None))
            if r.random() < 0.7:
                mark = some and r.random() < 0.6
                state = r.getstate()
                snippet = _marked(r, r.choice(plain), plain) if mark else _literal(r, r.choice(plain))
                if not mark and r.random() < 0.4:  # the same signs twice on a line may look like a pair
                    again = r.getstate()
                    gap = [r.choice(plain) for _ in range(r.randint(1, 4))]
                    r.setstate(state)
                    snippet += f" {' '.join(gap)} " + _literal(r, r.choice(plain))
                    r.setstate(again)
                parts.append((snippet + r.choice([" ", " ", "\n", ""]), mark))
        text, spans = "", []
        for s, mark in parts:
            if mark:
                spans.append((len(text), len(text) + len(s)))
            text += s
        nodes = tree(text)
        if not nodes:
            continue
        xs.append(features(text, nodes))
        ys += [float(any(a <= n.a < b and (n.b <= b or n.b - b < 3) for a, b in spans)) for n in nodes]
    return Boosted(np.concatenate(xs), np.array(ys))


_VERBATIM = re.compile(r"<(pre|code|script|style)\b", re.I)
_CLOSING = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("pre", "code", "script", "style")}


# --- decoding -------------------------------------------------------------------------------------
def decode(text: str | None, model: Boosted) -> list[Node]:
    """Nodes with keep set where they are markup."""
    text = text or ""
    nodes = tree(text)
    if not nodes:
        return []
    for n, p in zip(nodes, model.predict(features(text, nodes))):
        n.p = float(p)
    partners: dict[str, list[Node]] = {}
    for n in nodes:  # partners share the mean of their probabilities
        if n.kind == "tag" and (m := _NAME.match(text[n.a:n.b])):
            partners.setdefault("t" + m.group(1).lower(), []).append(n)
        elif n.kind == "command" and (m := re.match(r"\\(?:begin|end)\{(\w+)", text[n.a:n.b])):
            partners.setdefault("e" + m.group(1), []).append(n)
        elif n.kind == "row" and text[n.a:n.b].lstrip().startswith("|"):
            partners.setdefault("r", []).append(n)
    for group in partners.values():
        if len(group) > 1:
            mean = sum(n.p for n in group) / len(group)
            for n in group:
                n.p = mean
    closed = -1
    unclosed: set[str] = set()
    for n in nodes:  # parents come before their children
        if n.a < closed:  # code of an accepted element
            continue
        up = n.parent
        blocked = False
        while up is not None and not blocked:
            if up.keep:
                syntax = up.kind in OPAQUE or up.kind in ("tag", "entity", "wlink", "template", "wtable", "command") and FAMILY[n.kind] != FAMILY[up.kind]
                blocked = syntax and not (n.kind == "tag" and up.kind in ("wtable", "command")) and not (up.kind == "tag" and n.kind == "entity")
            up = up.parent
        n.keep = not blocked and n.p > 0.5
        if n.keep and n.kind == "tag" and (m := _VERBATIM.match(text, n.a, n.b)) and (name := m.group(1).lower()) not in unclosed:
            end = _CLOSING[name].search(text, n.b)
            closed = end.start() if end else closed
            if not end:
                unclosed.add(name)
    return nodes


def families(text: str | None, model: Boosted) -> list[str]:
    return sorted({FAMILY[n.kind] for n in decode(text, model) if n.keep})


# --- clean text with structure --------------------------------------------------------------------
_HIDE = {ord(c): 0xF700 + ord(c) for c in "<>&`*_~#=[]|{}'\\$^!-+.)\n"}
_SHOW = {v: k for k, v in _HIDE.items()}
_WHOLE = {"comment", "tag", "entity", "link", "bullet", "setext", "wlink", "template", "switch", "command"}  # syntax from end to end
_TABLES = {"row", "wtable", "wrow"}
_WORDS = re.compile(r"<[A-Za-z]\w*(?:\s+\w+)+\s*>")  # "a <b and c> d": words where attributes would be
_BARE = frozenset("async autofocus autoplay checked controls default defer disabled hidden inert ismap itemscope loop multiple muted nomodule noshade novalidate nowrap open readonly required reversed selected".split())
_CODE_TAG = re.compile(r"</?code\b", re.I)


def _hidden(s: str) -> str:
    """The same text with its signs out of reach of the conversions below."""
    return s.translate(_HIDE)


def _sure(kind: str, s: str) -> bool:
    """Forms read as markup whatever the trees say: items (they keep their dash), links with a target, table rows."""
    return kind == "bullet" or kind == "link" and "](" in s or kind == "row" and s.strip()[0] == "|"


def _lines(s: str) -> str:
    return "\n".join(map(_hidden, s.split("\n")))


def literal(text: str, model: Boosted) -> str:
    """The text with every sign hidden that is no markup: of nodes that weren't kept, and within code and formulas.

    What is left to blocks() to remove or convert is what the decoding keeps.
    """
    nodes = decode(text, model)
    if not nodes:
        return text
    out = list(text)
    shut = bytearray(len(text))  # signs that kept markup needs
    code: list[Node] = []
    inside: set[int] = set()  # the code nodes and all below them
    verbatim = bytearray(len(text))  # within elements whose entities are still read
    unclosed: set[str] = set()
    for n in nodes:
        s = text[n.a:n.b]
        n.keep = (n.keep or _sure(n.kind, s)) and not (n.kind == "tag" and _WORDS.fullmatch(s) and not _BARE.intersection(s.lower().strip("</>").split()))
        if n.parent is not None and id(n.parent) in inside:
            n.keep = False
            inside.add(id(n))
        elif n.kind == "code" and not text[n.a - 1:n.a].isalnum() and not text[n.b:n.b + 1].isalnum() and s[1:-1] == s[1:-1].strip():
            code.append(n)  # inline code stays whole, whether its ticks are removed or not
            inside.add(id(n))
        elif n.keep and n.kind in ("code", "fence", "math"):
            code.append(n)
            inside.add(id(n))
        if not n.keep or n.kind in ("code", "fence", "math"):
            continue
        if n.kind == "tag" and (m := _VERBATIM.match(s)) and (name := m.group(1).lower()) not in unclosed and not verbatim[n.a]:
            if end := _CLOSING[name].search(text, n.b):
                verbatim[n.b:end.start()] = b"\1" * (end.start() - n.b)
            else:
                unclosed.add(name)
        if n.kind in _WHOLE:
            shut[n.a:n.b] = b"\1" * len(s)
        elif n.kind in _TABLES:
            for m in re.finditer(r"[|!{}+-]", s):
                shut[n.a + m.start()] = 1
        else:
            head, tail = len(re.match(r"[\W_]*", s).group()), len(s) - len(re.sub(r"[\W_]*\Z", "", s))
            shut[n.a:n.a + head] = b"\1" * head
            shut[n.b - tail:n.b] = b"\1" * tail
    own = {id(n) for n in code}
    for n in nodes:
        if not n.keep and id(n) not in own and not (verbatim[n.a] and (n.kind == "entity" or _CODE_TAG.match(text, n.a))):
            for i in range(n.a, n.b):
                if not shut[i] and text[i] != "\n":
                    out[i] = _hidden(text[i])
    for n in code:
        s = text[n.a:n.b]
        if n.kind == "fence" and "\n" in s and not text[text.rfind("\n", 0, n.a) + 1:n.a].strip():
            head, tail, drop, newline = s.index("\n") + 1, len(s) - s.rindex("\n"), False, False  # blocks() reads the fence lines
        elif n.kind == "math" and s[:2] in ("$$", "\\["):
            head, tail, drop, newline = 2, 2, False, True  # a block of its own
        elif n.kind == "math" or not n.keep:
            head, tail, drop, newline = 0, 0, False, n.kind == "math"
        else:
            head = tail = 1 if n.kind == "code" else 3
            drop, newline = True, False
        for i in range(n.a, n.b):
            if n.a + head <= i < n.b - tail:
                out[i] = text[i] if text[i] == "\n" and not newline else _hidden(text[i])
            else:
                out[i] = "" if drop else text[i]
    return "".join(out)


_HEADING = re.compile(r"(?m)^[ \t]*#{1,6}[ \t]+(.*?)[ \t]*#*$|^={2,6}[ \t]*(.*?)[ \t]*={2,6}[ \t]*$|<h[1-6][^>]*>(.*?)</h[1-6]>|\\(?:sub)*section\*?\{([^{}]*)\}", re.S | re.I)


def _inline(s: str) -> str:
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", s)
    s = re.sub(r"\[([^\[\]\n]*)\]\([^)\n]*\)", r"\1", s)
    s = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Category|Kategorie|Catégorie|Categoría):[^\[\]]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\{\{[^{}]*\}\}|__[A-Z]{3,}__", "", s)
    s = re.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", s)
    s = re.sub(r"~?\\(?:cite[pt]?|ref|label|eqref)\{[^{}]*\}", "", s)
    s = re.sub(r"\\(?:emph|text\w*|underline|title)\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"</?[A-Za-z][A-Za-z0-9-]*(?:(?:\s|&nbsp;|/)[^<>]*)?>", " ", s)
    s = re.sub(r"(?<!\w)(\*{1,3}|_{1,3}|~~|`)(?=\S)([^\n]*?\S)\1(?!\w)", r"\2", s)
    return html.unescape(s).replace("\xa0", " ")


def blocks(text: str | None, model: Boosted | None = None) -> list[tuple[str, int, str]]:
    """(kind, level, clean text) of each block: heading, item, code, formula, table, quote or text.

    With a model only the markup that it keeps is read as such; without one every sign is.
    """
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if model is not None:
        text = literal(text, model)
    text = re.sub(r"<pre[^>]*>(?:<code[^>]*>)?(.*?)(?:</code>)?</pre>", lambda m: f"\n```\n{_lines(html.unescape(m.group(1)))}\n```\n", text, flags=re.S | re.I)
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", lambda m: f"\n```\n{_lines(m.group(1))}\n```\n", text, flags=re.S)
    text = re.sub(r"\\\[((?:(?!\\\[).)+?)\\\]|\$\$([^$]+)\$\$", lambda m: f"\n\x02{(m.group(1) or m.group(2)).strip()}\n", text, flags=re.S)
    text = re.sub(r"<h([1-6])[^>]*>(.*?)</h[1-6]>", lambda m: "\n" + "#" * int(m.group(1)) + " " + re.sub(r"\s+", " ", m.group(2)) + "\n", text, flags=re.S | re.I)
    text = re.sub(r"\\((?:sub)*)section\*?\{([^{}]*)\}", lambda m: "\n" + "#" * (2 + len(m.group(1)) // 3) + f" {m.group(2)}\n", text)
    text = re.sub(r"<li[^>]*>", "\n- ", text, flags=re.I)
    text = re.sub(r"\\item\b", "\n- ", text)
    text = re.sub(r"\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"</?(?:p|div|ul|ol|li|br|hr|tr|table|blockquote|section|article|h[1-6])\b[^<>]*>", "\n", text, flags=re.I)
    out: list[tuple[str, int, str]] = []
    lines = text.split("\n")
    i = 0
    run: list[str] = []

    def flush() -> None:
        if run:
            clean = re.sub(r"\s+", " ", _inline(" ".join(run))).strip()
            if clean:
                out.append(("text", 0, clean))
            run.clear()

    while i < len(lines):
        line = lines[i]
        s = line.strip()
        if s.startswith(("```", "~~~")):
            flush()
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(s[:3])), len(lines))
            out.append(("code", 0, "\n".join(lines[i + 1:j])))
            i = j + 1
            continue
        if not s:
            flush()
        elif s[0] == "\x02":
            flush()
            out.append(("formula", 0, s[1:]))
        elif m := re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*#*$", s):
            flush()
            out.append(("heading", len(m.group(1)), _inline(m.group(2)).strip()))
        elif m := re.match(r"(={2,6})[ \t]*([^=].*?)[ \t]*={2,6}$", s):
            flush()
            out.append(("heading", len(m.group(1)), _inline(m.group(2)).strip()))
        elif re.fullmatch(r"=+|-{3,}", s) and run:
            head = run.pop()
            flush()
            out.append(("heading", 1 if s[0] == "=" else 2, _inline(head).strip()))
        elif re.fullmatch(r"[-*_]{3,}|\{\|.*|\|\}|\|-.*|\|[\s:|-]+\|?", s):
            flush()
        elif s[0] in "|!" and len(s) > 1:
            flush()
            out.append(("table", 0, re.sub(r"\s+", " ", _inline(s.strip("|! ").replace("|", " | "))).strip()))
        elif m := re.match(r"([ \t]*)(?:[-+*•]|\d{1,3}[.)])[ \t]+(.*)", line):
            flush()
            out.append(("item", len(m.group(1).expandtabs(4)) // 2, re.sub(r"\s+", " ", _inline(m.group(2))).strip()))
        elif s[0] == ">":
            flush()
            out.append(("quote", 0, _inline(s.lstrip("> ")).strip()))
        else:
            run.append(s)
        i += 1
    flush()
    return [(a, n, b.translate(_SHOW)) for a, n, b in out if b or a == "code"]


def clean(text: str | None, model: Boosted | None = None) -> str | None:
    """Plain text: headings and paragraphs apart, items with a dash, code and formulas as they stand."""
    if text is None:
        return None
    return _joined(blocks(text, model))


def _joined(found: list[tuple[str, int, str]]) -> str:
    out: list[str] = []
    last = ""
    for kind, level, s in found:
        out.append(("\n" if kind == last in ("item", "table") else "\n\n") if out else "")
        out.append("  " * level + "- " + s if kind == "item" else s)
        last = kind
    return "".join(out)


def fit(df: DataFrame, text_col: str, id_col: str, sample: int = SAMPLE) -> Boosted:
    return train(samples.texts(df.where(F.length(text_col) > 40), id_col, text_col, sample))


def markup_families(df: DataFrame, model: Boosted, id_col: str, text_col: str, time_col: str | None = None) -> DataFrame:
    """One row per text and family of markup it carries; with a time column, of each id's last delivery only.

    The texts stay where they are: what is shuffled to find the last delivery are the families.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    key = df.schema[id_col].dataType.simpleString()

    def make() -> Callable[..., list[tuple]]:
        m = sent.value
        return lambda k, text, at: [(k, at, families(text, m))]

    at = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    rows = flat_map(df, [id_col, text_col, at], make, f"`{id_col}` {key}, at timestamp, markup array<string>")
    if time_col:
        rows = rows.groupBy(id_col).agg(F.max_by("markup", F.coalesce("at", F.to_timestamp(F.lit("1970-01-01")))).alias("markup"))
    return rows.select(id_col, F.explode("markup").alias("markup"))


def clean_texts(df: DataFrame, id_col: str, text_col: str, model: Boosted | None = None) -> DataFrame:
    """clean_text and its blocks, one row per input row; the model is fitted on the texts themselves if none is given."""
    sent = df.sparkSession.sparkContext.broadcast(model or fit(df, text_col, id_col))

    def make() -> Callable[..., list[tuple]]:
        m = sent.value

        def rows(k, text):  # noqa: ANN001, ANN202
            found = blocks(text, m)
            return [(k, None if text is None else _joined(found), [{"kind": a, "level": b, "text": c} for a, b, c in found])]

        return rows

    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, clean_text string, blocks array<struct<kind:string,level:int,text:string>>")
