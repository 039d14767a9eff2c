"""Responses that hold an error, a notice, filler or an unfilled template in place of real content.

Each page is reduced to its main body, and the terms of its address slug, its title and its running text are compared: a
page that agrees with its address or its title is left alone. Two detectors look at one page: placeholders in title and
running text (quoted text and code aside), and filler, words without grammar that make up half of the running text or more. All
other rows come from combined host evidence: a line that stands at several addresses, of different hosts or of one,
is low in information, and a mismatched page whose running text is made of such lines is residue. Lines that differ by
one inserted name share a half, and halves of a line are counted as well; what rests on halves, on two addresses, or on lines
that the hosts repeat under a heading of their own, must pass an exact check of the wording, most of the running text being so worded.

Only ids, hashes and flags of the lines of mismatched pages are shuffled, counted per line, host and address before (partial
counts on the map side) and joined back with salted keys, so neither a host nor a line with a third of all rows is hot.

Cases: null and blank markdown is never flagged, nor is a page of lists, tables or code alone; a redelivered response counts once, and
an address once a host; equal bodies get equal answers but for their own title and slug; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.pagebody import REMEMBERED, read
from quillspark.llm.spam import FUNCTION
from quillspark.operators.durable import checkpointed
from quillspark.operators.rows import flat_map

ADDRESSES = 3  # addresses (host and slug) at which a line must stand to be low in information
HOSTS = 3  # hosts that must share it, where no address of one host has it ALONE times
ALONE = 8
WORDED = 2  # addresses that are enough for a line, or half of it, whose wording bears it out
SALTS = 16

_NAME = r"(?:[A-Za-z][a-z]*(?:[_.][A-Za-z]+)+|[a-z]{3,20}|[A-Z]{3,20}|[A-Z]+(?:_[A-Z]+)+)"
_PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}\s*\}}?\}}\}}|[$#]\{{\s*{_NAME}\s*\}}|\{{%\s*{_NAME}\s*%\}}|<%[=-]?\s*{_NAME}\s*%>|(?<![{{$#%\\\w]){{{_NAME}}}(?!}})|%%{_NAME}%%|@@{_NAME}@@|##{_NAME}##|(?<!\w)%[A-Z]{{3,}}(?:_[A-Z]+)*%(?!\w)"
    rf"|(?<!\w)__{_NAME}__(?!\w)|\[\[\s*(?:[a-z]+(?:[_.][a-z]+)*|[A-Z]{{3,}})\s*\]\]|\[(?:INSERT|Insert|YOUR|Your|ENTER|Enter|ADD|TODO|HIER|VOTRE|SU)\b[^\[\]]{{1,40}}\](?!\()|\[[^\[\]]{{1,40}} (?:goes here|here|hier einfügen|einfügen|ici|aquí)\](?!\()"
)
_ANGLE = re.compile(rf"<({_NAME})>")
_TAGS = frozenset("abbr audio big blockquote body button caption center cite code dd del details div dl dt em embed footer form frame head header hr html iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol option pre progress samp script section select small span strike strong style sub summary sup table tbody td template textarea tfoot th thead time tr track tt ul var video wbr".split())
_HINT = re.compile(r"[{<@]|%%|%[A-Z]|__|\[\[|##|\[(?:INSERT|Insert|YOUR|Your|ENTER|Enter|ADD|TODO|HIER|VOTRE|SU)\b|(?:here|ici|aquí|einfügen)\]")
_QUOTED = re.compile(r"`[^`]*`|«[^«»]*»|»[^«»]*«|“[^“”]*”|„[^„“”]*[“”]|\"[^\"\n]*\"|‚[^‚‘]*‘|‘[^‘’]*’")

_MESSAGE = re.compile(
    "(?:" + "|".join([
        # errors
        r"(?:http |http[- ]?status |status |error |fehler |erreur )?[1-5]\d\d\b(?:\s*[-–—:|]?\s*[\w' ]{0,50})?[.!]?", r"(?:error|fehler|erreur|código|code)\s*(?:code)?\s*\d{2,5}\s*[:.–-].{0,120}", r"\d{1,3}", r".{0,30}\b(?:page|site|url|document|file|resource|article) (?:was |is |could |can |you .{1,30} |requested )*(?:not (?:be )?found|no longer (?:here|available|exists?)|(?:not|un)available|missing|does not exist|doesn'?t exist|has (?:moved|been (?:moved|removed|deleted))|gone).{0,60}",
        r".{0,20}(?:we )?(?:could not|couldn'?t|can'?t|cannot|unable to) (?:find|load|open|reach|display|locate|connect|process) .{0,110}", r".{0,20}(?:not found|access denied|permission denied|forbidden|unauthori[sz]ed|bad gateway|bad request|service unavailable|internal server error|gateway time-?out|request timed? ?out).{0,70}", r".{0,40}(?:do not|don'?t) have (?:permission|access).{0,60}", r".{0,40}(?:too many requests|rate limit|slow down).{0,60}", r".{0,40}(?:server|connection|host|database) (?:did not|does not|is not|was|is|error|connection)?\s*(?:answer|respond|refused|reset|down|closed|failed|fails|unreachable|timed out|overloaded|busy).{0,60}", r".{0,40}connection (?:failed|error|refused|lost|timed out).{0,40}",
        r".{0,40}(?:something (?:broke|went wrong)|an? (?:unexpected |internal |fatal |unknown )?error (?:has )?occurred|fatal error|uncaught exception|stack trace|traceback).{0,110}", r".{0,40}(?:session|link|token|password) (?:has |is )?(?:expired|invalid|timed out).{0,60}", r".{0,40}(?:not available|unavailable|blocked) in your (?:region|country|location).{0,40}", r".{0,60}(?:down for|under|undergoing) (?:scheduled )?maintenance.{0,60}", r".{0,30}(?:come back|try again|check back) (?:later|in \d+ .{1,12}|soon).{0,20}", r"(?:oops|sorry|uh-oh|whoops)\b.{0,110}",
        r".{0,40}(?:seite|datei|adresse|artikel|inhalt).{0,30}(?:nicht gefunden|gibt es nicht(?: mehr)?|existiert nicht(?: mehr)?|nicht (?:mehr )?verfügbar|wurde (?:nicht gefunden|entfernt|verschoben|gelöscht)|nicht erreichbar).{0,60}", r".{0,40}(?:zugriff verweigert|zugang verweigert|keine berechtigung|interner serverfehler|serverfehler|nicht autorisiert|zeitüberschreitung|zu viele anfragen).{0,60}", r".{0,40}(?:server antwortet nicht|verbindung (?:fehlgeschlagen|abgelehnt|unterbrochen|verloren)|datenbank.{0,30}fehl).{0,60}", r".{0,30}(?:etwas schiefgegangen|ist (?:ein )?(?:unerwarteter )?fehler aufgetreten|schief gelaufen|schiefgelaufen).{0,60}", r".{0,30}(?:sitzung|anmeldung|link) ist abgelaufen.{0,60}", r".{0,50}(?:wartungsarbeiten|in wartung|gewartet).{0,60}", r".{0,50}(?:in ihrer region|in ihrem land) nicht verfügbar.{0,40}|.{0,30}zurzeit nicht erreichbar.{0,40}", r"(?:hoppla|leider|ups|entschuldigung|tut uns leid)\b.{0,110}", r"bitte (?:versuchen sie es|melden sie sich) .{0,50}",
        r".{0,40}page.{0,30}(?:introuvable|n'existe (?:plus|pas)|non trouvée|n'est (?:plus|pas) disponible|a été (?:supprimée|déplacée)).{0,60}", r".{0,40}(?:accès (?:refusé|interdit)|non autorisé|erreur (?:interne|du serveur|inattendue)|trop de requêtes|délai (?:d'attente )?dépassé).{0,60}", r".{0,40}(?:serveur ne répond pas|connexion (?:échouée|refusée|perdue|impossible)|échec de la connexion|base de données.{0,30}(?:échou|erreur|échec)).{0,60}", r".{0,30}(?:une erreur (?:est survenue|s'est produite)|quelque chose s'est mal passé|un problème est survenu).{0,60}", r".{0,30}session a expiré.{0,60}", r".{0,40}(?:en (?:cours de )?maintenance).{0,60}", r".{0,50}(?:pas disponible|indisponible) dans votre (?:région|pays).{0,40}", r"(?:désolé|oups|pardon|aïe)\b.{0,110}", r"(?:veuillez|merci de) (?:réessayer|vous (?:re)?connecter).{0,50}",
        r".{0,40}p[áa]gina.{0,30}(?:no (?:encontrada|existe|se encuentra|está disponible)|ya no existe|ha sido (?:eliminada|movida)|no encontramos).{0,60}", r".{0,40}(?:acceso (?:denegado|prohibido)|no autorizado|error (?:interno|del servidor|inesperado)|demasiadas (?:peticiones|solicitudes)|tiempo de espera agotado).{0,60}", r".{0,40}(?:servidor no responde|conexión (?:fallida|rechazada|perdida)|(?:falló|fallo de) (?:la )?conexión|base de datos.{0,30}(?:fall|error)).{0,60}", r".{0,30}(?:ha ocurrido un error|se (?:ha producido|produjo) un error|algo (?:ha salido|salió|fue) mal).{0,60}", r".{0,30}sesión ha (?:caducado|expirado).{0,60}", r".{0,40}(?:en|por) (?:tareas de )?mantenimiento.{0,60}", r".{0,50}no (?:está )?disponible en su (?:región|país).{0,40}", r"(?:lo sentimos|vaya|ups|perdón|disculpe)\b.{0,110}", r"(?:vuelva a intentarlo|inténtelo de nuevo|inicie sesión).{0,50}", r".{0,30}no (?:pudimos|hemos podido|podemos) encontrar.{0,80}|.{0,30}nous n'avons pas (?:pu )?trouv.{0,80}|.{0,30}konnten? (?:wir )?.{0,40}nicht (?:finden|laden|öffnen).{0,40}",
        # scripts and checks on the visitor
        r".{0,50}(?:enable|activate|turn on|requires?|needs?|without|allow|works best with) (?:javascript|scripts?|js|cookies).{0,80}", r".{0,50}(?:browser is (?:not supported|too old|out ?dated)|scripts and cookies must be|unsupported browser|javascript (?:is|has been|must be) (?:off|disabled|required|enabled|turned off)).{0,80}", r".{0,40}(?:not a robot|you are (?:a )?human|checking your browser|verifying|security check|captcha|unusual traffic|automated (?:visits|requests)|bot detection).{0,80}", r"(?:loading|please wait|one moment|wird geladen|bitte warten|chargement|veuillez patienter|patientez|cargando|espere)\b.{0,30}",
        r".{0,60}(?:aktivieren sie|schalten sie|braucht|benötigt|erfordert|ohne) (?:bitte )?(?:javascript|skripte|scripts).{0,80}|.{0,60}javascript.{0,40}(?:aktivieren|einschalten|abgeschaltet|deaktiviert|erforderlich|ausgeschaltet).{0,60}", r".{0,40}(?:prüfen|überprüfen) (?:wir )?(?:ihren browser|sie).{0,70}|.{0,40}(?:kein roboter|ein mensch|sicherheitsprüfung|browser wird (?:geprüft|nicht unterstützt)).{0,60}",
        r".{0,60}(?:activer|activez|besoin de|nécessite|requiert|sans) (?:le )?(?:javascript|scripts?).{0,80}", r".{0,40}(?:vérification de votre navigateur|pas un robot|êtes humain|navigateur (?:n'est pas|non) (?:pris en charge|supporté)|scripts?,? bloqués).{0,70}",
        r".{0,60}(?:active|activar|habilite|necesita|requiere|sin) (?:el )?(?:javascript|scripts?).{0,80}", r".{0,40}(?:comprobando|verificando|comprobamos) su navegador.{0,60}|.{0,40}(?:no es un robot|es humano|navegador no (?:es )?compatible).{0,60}",
        # prompts to fill in text
        r".{0,20}(?:your|add|enter|insert|put|type|write) .{0,40}(?:text|headline|title|heading|description|content|copy|caption).{0,20}(?:here|in this space|goes here).{0,30}|(?:add|enter|insert|write|type) (?:a|your|the|some) (?:short |brief |catchy )?(?:headline|title|heading|description|text|caption|introduction).{0,60}|.{0,40}(?:goes here|placeholder text|sample text|dummy text|coming soon|under construction).{0,30}",
        r".{0,10}hier (?:steht|kommt|folgt|bitte|eine?|ihr|ihre?n?|den|text).{0,60}(?:text|beschreibung|überschrift|titel|inhalt|eingeben|einfügen).{0,30}|.{0,30}(?:bitte )?(?:hier )?(?:eine? )?(?:kurze )?(?:beschreibung|überschrift|text|titel) (?:hier )?(?:eingeben|einfügen|ergänzen).{0,20}|.{0,20}platzhalter.{0,30}|.{0,30}(?:im aufbau|demnächst verfügbar).{0,20}",
        r".{0,10}votre (?:texte|titre|description|contenu).{0,10}ici.{0,20}|(?:saisissez|ajoutez|insérez|entrez|écrivez) (?:une?|votre|le|ici|du) .{0,50}|.{0,20}(?:en construction|bientôt disponible).{0,20}",
        r".{0,10}su (?:texto|título|titular|descripción|contenido).{0,10}aquí.{0,20}|(?:escriba|añada|introduzca|inserte|agregue) (?:una?|su|el|aquí) .{0,50}(?:texto|título|titular|descripción|aquí|contenido).{0,30}|.{0,20}(?:en construcción|próximamente).{0,20}",
    ]) + ")",
    re.I,
)
_FUNCTION = frozenset(w for ws in FUNCTION.values() for w in ws.split() if len(w) > 1)
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"[^\W\d_]{4,}")
_MARKS = re.compile("[\u0300-\u036f]+")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_LISTED = re.compile(r"[|>]|(?:[-*+•]|\d{1,3}[.)])\s")
_NUMBERED = re.compile(r"[\w-]*\d[\w-]*|/\S+")
_STRIP = re.compile(r"^(?:#{1,6}\s+|>\s*|[-*+]\s+|\d+[.)]\s+)+|[*_]{2,3}")


def _fold(s: str) -> str:
    s = s.lower()
    return s if s.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", s))


def terms(s: str) -> set[str]:
    return set(_TERM.findall(_fold(s)))


def slug(url: str | None) -> str:
    return re.sub(r"-?\d+$", "", (url or "").rstrip("/").rpartition("/")[2]).replace("-", " ")


def placeholder(s: str) -> bool:
    """Whether running text has an unfilled placeholder outside quotations and code."""
    if not _HINT.search(s):
        return False
    s = _QUOTED.sub(" ", s)
    if _PLACEHOLDER.search(s):
        return True
    return any(m.group(1).lower() not in _TAGS and f"</{m.group(1)}" not in s for m in _ANGLE.finditer(s))


def message(s: str) -> bool:
    """Whether a line is an error, a notice or a prompt by its wording, or all of its sentences are."""
    s = _QUOTED.sub(" ", s).strip() if any(c in s for c in "\"«»“”„`") else s
    if _said(s):
        return True
    parts = _SENTENCES.split(s)
    return len(parts) > 1 and all(map(_said, parts))


def _said(s: str) -> bool:
    return _known(s) if len(s) <= REMEMBERED else _MESSAGE.fullmatch(s) is not None


@lru_cache(1 << 15)
def _known(s: str) -> bool:
    """The same test for short sentences, which come again and again."""
    return _MESSAGE.fullmatch(s) is not None


def ungrammatical(words: list[str]) -> bool:
    """Words without grammar: hardly a function word of any language known here, or the same word again and again."""
    n = len(words)
    if n < 4:
        return False
    low = [w.lower() for w in words]
    return sum(w in _FUNCTION for w in low) * 12 < n and (n >= 6 or len(set(low)) * 2 <= n) or len(set(low)) * 4 <= n


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - 2**63


def agrees(about: set[str], body: set[str]) -> bool:
    """Whether a body takes up the terms of an address or a title: all, or two at least and half of them."""
    both = len(about & body)
    return bool(both) and (both == len(about) or both >= 2 and both * 2 >= len(about))


def line_keys(s: str) -> tuple[int, int, int]:
    """Hashes of a line without its numbers and paths, whole and by halves."""
    w = _WORD.findall(_NUMBERED.sub(" ", _fold(s)))
    at = (len(w) + 1) // 2
    return _hash(" ".join(w)), _hash("< " + " ".join(w[:at])), _hash("> " + " ".join(w[-at:]))


class Page:
    """What one response shows by itself."""

    __slots__ = ("filled", "filler", "lines", "mismatched", "own", "words")

    def __init__(self, markdown: str | None, host: str | None, url: str | None, title: str | None):
        body = [x.text for x in read(markdown, host) if x.kind == "body" and not x.code]
        self.filled = not (placeholder(title or "") or _HINT.search("\n".join(body)) and any(placeholder(x) for x in body))
        heads = [t for x in body if x[0] == "#" and (t := _STRIP.sub("", x).strip())]
        run = [t for x in body if x[0] != "#" and not _LISTED.match(x) and (t := _STRIP.sub("", x).strip())]
        listed = any(_LISTED.match(x) for x in body)
        self.lines = run or ([] if listed else heads)
        sizes = [t.count(" ") + 1 for t in self.lines]
        self.words = sum(sizes)
        self.filler = not listed and bool(run) and sum(self._most(lambda t: ungrammatical(_WORD.findall(t)))) > 0
        self.mismatched = bool(self.lines) and not listed and not self.filler
        if self.mismatched:
            text = terms(" ".join(run))
            self.mismatched = not agrees(terms(slug(url)), text) and not agrees(terms(title or ""), text)
        self.own = not run or self.mismatched and any(not message(h) for h in heads)  # a heading that says what the page is about

    def _most(self, test: Callable[[str], bool]) -> list[bool]:
        """The test of every line; all false unless most of the words are in lines that hold, so that prose is soon left."""
        left = self.words
        out = []
        for t in self.lines:
            out.append(test(t))
            left -= 0 if out[-1] else t.count(" ") + 1
            if left * 2 <= self.words:
                return [False] * len(self.lines)
        return out

    def worded(self) -> list[bool]:
        """Which lines are worded as messages."""
        return self._most(message)


def residue(df: DataFrame, id_col: str = "response_id", text_col: str = "markdown", host_col: str = "host", url_col: str = "page_url", title_col: str = "title") -> DataFrame:
    """Ids of the responses to leave out, with the reason: placeholder, filler or duplicate."""
    key = df.schema[id_col].dataType.simpleString()

    def make() -> Callable[..., list[tuple]]:
        def rows(k, text, host, url, title):  # noqa: ANN001, ANN202
            if text is None or not text.strip():
                return []
            p = Page(text, host, url, title)
            if not p.lines and p.filled:
                return []
            if not p.filled:
                return [(k, "placeholder", *[None] * 8)]
            if p.filler:
                return [(k, "filler", *[None] * 8)]
            if not p.mismatched:
                return []
            worded = p.worded()
            site, address = _hash(host or ""), _hash(f"{host}\n{slug(url)}\n{title or ''}".lower())
            return [(k, None, site, address, i, t.count(" ") + 1, p.words, p.own, worded[i], [*line_keys(t)]) for i, t in enumerate(p.lines)]

        return rows

    schema = f"`{id_col}` {key}, reason string, host bigint, address bigint, line int, words int, of int, own boolean, worded boolean, keys array<bigint>"
    found = checkpointed(flat_map(df, [id_col, text_col, host_col, url_col, title_col], make, schema))  # read by the branches below
    sure = found.where("reason is not null").select(id_col, "reason")
    lines = found.where("reason is null").select(id_col, "host", "address", "line", "words", "of", "own", "worded", F.posexplode("keys").alias("half", "key"))
    # equal addresses are merged first, so a line that one host repeats sends few rows
    sites = lines.groupBy("key", "host", "address").count().groupBy("key", "host").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.max("n").alias("alone"))
    strong = (F.col("n") >= ADDRESSES) & ((F.col("hosts") >= HOSTS) | (F.col("alone") >= ALONE))
    common = sites.where(F.col("n") >= WORDED).select("key", strong.alias("strong"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    said = lines.withColumn("salt", F.pmod(F.xxhash64(id_col, "line"), F.lit(SALTS)).cast("int")).join(common, ["key", "salt"])
    # a whole line is evidence by itself on a page without a heading of its own, anything else if its wording bears it out
    bears = F.col("worded") | F.col("strong") & (F.col("half") == 0) & ~F.col("own")
    by_line = said.where(bears).groupBy(id_col, "line").agg(F.max("words").alias("words"), F.max("of").alias("of"))
    duplicate = by_line.groupBy(id_col).agg(F.sum("words").alias("words"), F.max("of").alias("of")).where("words * 2 > of").select(id_col, F.lit("duplicate").alias("reason"))
    return sure.unionAll(duplicate).groupBy(id_col).agg(F.max("reason").alias("reason"))
