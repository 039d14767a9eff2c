"""Main body of a page by composite text density.

The Markdown of a page is read as a tree: page, sections (opened by headings), lines. Each node gets its characters, its
tags (list markers, headings, links, separators) and its link characters: those of links, and those of lines or sentences whose
wording is that of an anchor or a notice of the site (menus, consent notices and their buttons, tools, counters, sign-ups,
legal and contact lines), as sites write them as links as often as not. The composite text density is characters per
tag, adjusted by the share of link characters; a section's density sum is that of its lines. The section with the greatest sum
is the page's main subtree, the least density on the path from it to the root (section and page) is the threshold. Reading
only measures; what is body is decided by the densities alone (_select): a line of zero density falls out wherever it stands,
a line of the main subtree is body, and outside of it a line under the threshold falls out unless it is a sentence or of a
block that is short by nature.

Line rules work on one line at a time, so the cost is linear in the text; there is no shuffle but for the
redelivered rows (ids and line numbers only).

Cases: null and blank markdown has no lines; CRLF is allowed; a page without any dense line has no body line; repeated
rows count once; lines of any length are read whole, sentence by sentence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.rows import flat_map

#: Menu entries (fixed values), by language.
MENU = """
home|news|sport|sports|weather|events|gallery|shop|store|help|faq|contact|contact us|about|about us|jobs|careers|press|archive|archives|guides|topics|podcast|podcasts|newsletter|search|log in|login|sign in|sign up|register|subscribe|account|my account|cart|blog|forum|products|services|team|privacy|imprint|terms|terms of use|cookies|sitemap|media|videos|photos|calendar|opinion|culture|business|politics|science|travel|menu
startseite|aktuelles|nachrichten|wetter|termine|bilder|laden|hilfe|kontakt|über uns|stellen|karriere|presse|archiv|ratgeber|themen|suche|anmelden|abmelden|registrieren|abo|impressum|datenschutz|agb|agenda|dossiers|mediathek|kultur|politik|wirtschaft|reise|konto|warenkorb|menü
accueil|actualités|météo|boutique|aide|à propos|emplois|recherche|connexion|inscription|abonnement|dossier|culture|politique|économie|voyage|compte|panier|plan du site|mentions légales|confidentialité
inicio|noticias|deportes|el tiempo|eventos|galería|tienda|ayuda|contacto|quiénes somos|empleo|prensa|archivo|guías|temas|buscar|entrar|registro|suscripción|cultura|política|economía|viajes|cuenta|carrito|aviso legal|privacidad|mapa del sitio
"""
_MENU = frozenset(x for line in MENU.strip().split("\n") for x in line.split("|"))

RELATED = re.compile(
    r"(?:related(?: (?:articles?|posts?|stories|content|topics|pages|reading))?|most (?:read|popular|viewed|shared)|you (?:may|might) also like|recommended(?: for you)?|recommendations|more (?:from|on|in|about) .{1,40}|more (?:articles|stories|news)|popular(?: this week| now| posts)?|trending(?: now)?|read (?:also|next)|see also|up next|editor'?s picks?|latest (?:news|posts|articles|stories)"
    r"|meistgelesen|verwandte (?:artikel|themen|beiträge)|mehr (?:zum thema|aus .{1,30}|artikel)|empfehlungen|empfohlen(?:e artikel)?|das könnte (?:sie|dich) auch interessieren|lesen sie auch|auch interessant|beliebte? (?:artikel|beiträge)|weitere artikel|ähnliche artikel"
    r"|les plus lus|à lire (?:aussi|également)|recommandé pour vous|recommandations|articles? (?:liés|similaires|connexes|recommandés)|sur le même (?:sujet|thème)|vous aimerez aussi|lire aussi|dans la même rubrique|plus d'articles|populaires? cette semaine"
    r"|artículos relacionados|noticias relacionadas|lo más (?:leído|visto|popular)|más leíd[oa]s?|recomendados?(?: para (?:usted|ti))?|recomendaciones|también (?:le|te) puede interesar|le puede interesar|más (?:de esta sección|sobre .{1,30}|artículos|noticias)|lea también|populares? esta semana)[:.]?",
    re.I,
)

_FURNITURE = re.compile(
    "(?:" + "|".join([
        # consent notices
        r"(?:we|this (?:site|page|website)|our (?:site|partners)|.{1,40} and its \d+ partners) (?:and our partners )?(?:uses?|stores?|process) .{0,60}(?:cookies?|information on your device|personal data).{0,80}", r".{1,60}\b(?:agree|consent) to (?:our|the) use of cookies.{0,40}", r"your privacy (?:matters|is important).{0,40}", r"(?:some )?cookies (?:are|help) .{1,90}", r"you can change your (?:choice|settings|preferences).{0,50}", r".{0,40}cookie (?:policy|settings|notice|preferences).{0,40}",
        r"(?:wir|diese (?:seite|website)) (?:verwenden|nutzen|benutzen|verwendet|nutzt) (?:cookies|kekse).{0,90}", r".{1,60} und (?:ihre |seine |unsere )?\d+ partner speichern .{1,60}", r"ihre privatsphäre ist uns .{1,30}", r"mit der (?:weiteren )?nutzung von .{1,60} stimmen sie .{1,60}cookies.{0,30}", r"(?:einige|manche) cookies (?:sind|helfen).{1,90}", r"sie können ihre (?:auswahl|einstellungen?|wahl) .{1,50}",
        r"nous utilisons des cookies.{0,90}", r"(?:certains|des) cookies (?:sont|nous).{1,90}", r"en poursuivant votre (?:visite|navigation) .{1,80}cookies.{0,20}", r".{1,60} et ses \d+ partenaires stockent .{1,70}", r"votre vie privée .{1,50}", r"(?:le )?respect de (?:votre )?vie privée.{0,50}", r"vous pouvez modifier (?:votre|vos) (?:choix|préférences).{0,50}",
        r"(?:usamos|utilizamos|este sitio (?:usa|utiliza)) cookies.{0,90}", r"(?:algunas|unas) cookies (?:son|nos|ayudan).{1,90}", r"si (?:sigue|continúa) navegando.{1,80}cookies.{0,20}", r".{1,60} y sus \d+ socios guardan .{1,70}", r"su privacidad .{1,50}", r"(?:nos importa|respetamos) su privacidad.{0,40}", r"puede cambiar su (?:elección|configuración|selección).{0,50}",
        # buttons
        r"(?:accept|reject|allow|decline|refuse|deny)(?: (?:all|cookies|all cookies|selected))?", r"(?:only|strictly) necessary(?: cookies)?", r"(?:save|manage|customi[sz]e|change|set|cookie|privacy)(?: my| your)? (?:choices?|preferences|settings|selection|options)", r"ok(?:ay)?(?:, got it)?|got it|i agree|agree|dismiss|close|settings|options|customi[sz]e|more options",
        r"(?:alle |alles )?(?:akzeptieren|ablehnen|zulassen|annehmen)", r"nur notwendige(?: cookies)?|(?:auswahl|einstellungen) (?:speichern|ändern|verwalten|anpassen)|einstellungen|einverstanden|verstanden|zustimmen|schließen",
        r"(?:tout )?(?:accepter|refuser|autoriser)(?: tout)?|paramétrer|personnaliser|(?:enregistrer|gérer|sauvegarder) (?:mes |mon |ma |les |le )?(?:choix|préférences|sélection)|enregistrer|(?:uniquement|seulement) (?:les )?nécessaires|j'accepte|d'accord|compris|fermer|continuer sans accepter",
        r"(?:aceptar|rechazar|permitir)(?: todo| todas| cookies)?|configurar|(?:guardar|gestionar|cambiar) (?:mis? |la |las )?(?:selección|preferencias|elección)|s[oó]lo (?:las )?necesarias|guardar|de acuerdo|entendido|cerrar",
        # scripts
        r"(?:for the full experience|for all (?:features|functions)|to use all (?:features|functions)).{0,30}(?:turn on|enable|activate) (?:javascript|scripts).{0,20}", r"für alle funktionen .{0,30}javascript.{0,30}", r"activez javascript pour (?:profiter|utiliser|bénéficier).{0,50}", r"active javascript para (?:ver|usar|disfrutar) tod[ao]s.{0,40}",
        # tools
        r"(?:share|print|listen to|bookmark|save|e-?mail|download)(?: (?:this|the))?(?: (?:page|article|story|post|site))?", r"share (?:on|via|with) .{1,40}", r"back to (?:top|overview|home)|to top|top of page", r"skip to (?:main )?(?:content|navigation)|toggle (?:navigation|menu|search)|(?:open|close|show) (?:menu|navigation|search)", r"(?:next|previous) (?:page|article|post)(?: [»›>→])?|(?:[«‹<←] )?(?:previous|back|next)(?: [»›>→])?", r"load(?:ing)? (?:more|comments).{0,20}|(?:could not|unable to|failed to) load (?:related|more|comments).{0,40}", r"(?:estimated )?reading time:? ?\d+ ?min.{0,8}|\d+ min(?:ute)? read", r"was this (?:page|article) helpful\?.{0,20}", r"(?:read|learn|show|view|see) (?:more|all|less)(?: [»›…]| \.\.\.)?|continue reading",
        r"(?:seite |artikel |diese seite |diesen artikel )?(?:teilen|drucken|anhören|merken|empfehlen|ausdrucken|versenden)", r"(?:nach|zurück nach) oben|zum seitenanfang|zum (?:inhalt|hauptinhalt)(?: springen)?|navigation (?:umschalten|öffnen|ein-? ?/? ?ausblenden)|menü(?: öffnen| schließen)?|hauptmenü", r"(?:[«‹] )?(?:weiter|zurück|nächste seite|vorherige seite)(?: [»›])?", r".{0,30}(?:konnten|konnte) nicht geladen werden.{0,3}|.{3,40} werden geladen ?(?:…|\.{3})", r"lesezeit:? ?(?:ca\. )?\d+ ?min.{0,8}", r"war diese (?:seite|artikel) hilfreich\?.{0,20}|war dieser artikel hilfreich\?.{0,20}", r"mehr (?:erfahren|lesen|anzeigen)|weiterlesen|zum (?:ganzen )?artikel(?: »)?",
        r"partager(?: (?:la |cette |cet )?(?:page|article))?|imprimer(?: (?:la |cette )?page)?|écouter(?: (?:la |cette |cet |l')?(?:page|article))?|haut de (?:la )?page|retour (?:en haut|à l'accueil)|aller au (?:contenu|menu)(?: principal)?|(?:ouvrir|fermer|afficher) le menu|basculer la navigation|(?:[«‹] )?page (?:suivante|précédente)(?: [»›])?|suivant(?: [»›])?|impossible de charger .{1,40}|temps de lecture ?:? ?\d+ ?min.{0,8}|cette page vous a-t-elle été utile ?\?.{0,20}|cette page est-elle utile ?\?.{0,20}|en savoir plus|lire (?:la suite|plus)|voir plus",
        r"compartir(?: (?:la |esta )?página| este artículo)?|imprimir(?: (?:la |esta )?página)?|escuchar(?: (?:el |este )?artículo| la página)?|volver arriba|subir|(?:ir|saltar) al contenido(?: principal)?|(?:abrir|cerrar|mostrar) (?:el )?menú|alternar (?:la )?navegación|(?:[«‹] )?página (?:siguiente|anterior)(?: [»›])?|siguiente(?: [»›])?|no se pudieron? cargar .{1,40}|tiempo de lectura ?:? ?\d+ ?min.{0,8}|¿?(?:le|te) (?:ha sido|fue|resultó) útil esta página\?.{0,20}|¿(?:esta página|este artículo).{0,20}útil\?.{0,20}|(?:saber|leer|ver) más|más información|seguir leyendo",
        # counters, dates, bylines, tags
        r"(?:no|one|\d+) (?:comments?|shares?|likes?|views?|replies)|\d+ (?:kommentare?|aufrufe|antworten)|\d+ commentaires?|\d+ (?:comentarios?|visitas)|(?:no|keine|aucun|sin) (?:comments|kommentare|commentaire|comentarios)", r"(?:leave|write|post|add) (?:a|your) (?:comment|reply)|kommentar (?:schreiben|hinterlassen|verfassen)|(?:laisser|écrire|ajouter) un commentaire|(?:deje|escriba|añada|dejar|escribir) (?:un|su) comentario",
        r"(?:page )?(?:last )?(?:changed|updated|modified|edited)(?: on)?:? ?[\d./: -]{6,}.{0,12}|(?:page|site) last (?:changed|updated|modified).{0,25}|(?:zuletzt|letzte) (?:geändert|aktualisiert|änderung|aktualisierung)(?: am)?:? ?[\d./: -]{6,}.{0,8}|(?:dernière mise à jour|mis à jour)(?: le)? ?:? ?[\d./: -]{6,}|(?:última (?:actualización|modificación)|actualizado)(?: el)? ?:? ?[\d./: -]{6,}|stand: ?[\d./ -]{6,}",
        r"(?:published|filed|posted|category|categories) ?(?:in|under|on)?: .{1,80}|(?:kategorie|rubrik|veröffentlicht (?:in|unter))n?: .{1,80}|(?:publié dans|catégories?|rubrique) ?: .{1,80}|(?:publicado en|categorías?|sección): .{1,80}", r"(?:tags?|keywords|topics|labels|schlagw[oö]rter|schlagworte|stichw[oö]rter|mots[- ]clés|étiquettes|etiquetas|palabras clave)\s?: .{1,120}",
        # sign-ups and advertisements
        r".{0,20}sign up for (?:our|the|my) .{1,60}|(?:subscribe to|get|join|receive) (?:our|the) .{0,20}(?:newsletter|mailing list|updates).{0,50}|enter (?:your )?e-?mail.{0,30}|your e-?mail(?: address)?|you have \d+ free articles? left.{0,20}|log in to (?:comment|continue|read).{0,20}",
        r"(?:jetzt )?(?:den |unseren |zum )?newsletter (?:bestellen|abonnieren|anmelden).{0,50}|e-?mail-?adresse(?: eingeben)?|.{0,30}\d+ (?:kostenlose |freie )artikel (?:übrig|frei|lesen).{0,20}|sie haben (?:noch )?\d+ .{0,10}artikel.{0,30}",
        r"(?:recevez|abonnez-vous à|inscrivez-vous à) (?:notre|nos|la) .{0,50}|(?:votre )?adresse e-?mail|saisissez votre .{0,30}|(?:entrez|indiquez) votre (?:adresse )?e-?mail.{0,20}|il vous reste \d+ articles?.{0,30}",
        r"(?:reciba|suscríbase a|suscríbete a) (?:nuestro|nuestra|el|la) .{0,50}|(?:su )?correo electrónico|(?:introduzca|escriba) su correo.{0,20}|le quedan? \d+ artículos?.{0,30}",
        r"advertisements?|advertise(?: with us)?|sponsored(?: content)?|anzeigen?|werbung|werben bei uns|publicité|publicidad|annonces?|anuncios?|anúnciese.{0,20}|annoncez.{0,20}",
        r"follow us(?: on)?:?.{0,40}|folgen sie uns.{0,40}|suivez[- ]nous.{0,40}|síganos.{0,40}|síguenos.{0,40}",
        # legal and contact
        r"(?:©|\(c\)|copyright).{1,120}", r"(?:accessibility|privacy|cookie|legal)(?: statement| notice| policy| information)|terms(?: (?:of (?:use|service)|and conditions))?|site ?map|imprint", r"barrierefreiheit(?:serklärung)?|seitenübersicht|sitemap|impressum|datenschutz(?:erklärung)?|nutzungsbedingungen", r"accessibilité|plan du site|mentions légales|confidentialité|conditions (?:d'utilisation|générales)", r"accesibilidad|mapa del sitio|aviso legal|privacidad|condiciones de uso",
        r"(?:reproduction|reprint|copying) only with .{1,100}|(?:nachdruck|wiedergabe|vervielfältigung) nur mit .{1,100}|(?:reproduction|reproducción) .{0,40}(?:autorisation|permiso|autorización|sans accord).{0,80}|.{1,40} (?:is|ist|est|es) (?:a|an|ein|eine|un|une) (?:project|service|projekt|dienst|angebot|proyecto|servicio|projet) (?:of|by|der|des|von|de|del) .{1,80}", r"(?:proudly )?(?:powered|hosted|designed|built) (?:by|with|on) .{1,60}|(?:erstellt|betrieben) mit .{1,60}|(?:propulsé|réalisé|généré|fourni) par .{1,60}|(?:creado|hecho|desarrollado|funciona) con .{1,60}|page (?:built|made|generated) (?:by|with) .{1,50}",
        r"(?:tel|phone|telephone|telefon|switchboard|fax|tél|téléphone|teléfono|e-?mail|mail|zentrale|standard|centralita)\s?[.:]{1,2}\s?[\d+()/ @.\w-]{5,60}|tél\.? [\d ./-]{5,30}|tel\.? [\d ./-]{5,30}|(?:call us|contact us|rufen sie uns an|appelez-nous|llámenos).{0,60}",
    ]) + r")\s*[.!]?",
    re.I,
)

REMEMBERED = 80  # characters of a line whose answer is kept
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_MARKER = re.compile(r"(?:[-*+•]|\d{1,3}[.)])\s+")
_HEADING = re.compile(r"#{1,6}\s+|\*\*(?=[^*]+\*\*$)")
_SEPARATOR = re.compile(r"\s+[|·›»/•>–]\s+")
_TEASER = re.compile(r"(?:…|\.{3}|[.!?])\s*\[[^\[\]]{2,30}\]\([^()\s]*\)\s*$")
_BYLINE = re.compile(r"(?:(?:powered|made|hosted|built|run|published|written|posted) )?(?:by|von|par|por) [A-Z]\S+(?: [A-Z]\S+){0,3}(?: [\d.]+)?$|[A-ZÉ]\w+ (?:by|mit|with|par|por|von|con|avec) [A-Z]\S+ [A-Z]\S+ [\d.]+$|[A-Z]\w+(?: [a-zäöüé]+)? ?: [A-Z]\S+ [A-Z]\S+ [\d.]+$")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+(?=[^\W\d])")
_SENTENCE = re.compile(r"[.!?…:;。！？।؟][\"'»”“’)\]*_]*$")


class Line:
    __slots__ = ("no", "text", "chars", "link", "tags", "cue", "kind", "density", "section", "code")

    def __init__(self, no: int, text: str):
        self.no, self.text = no, text
        self.chars, self.link, self.tags = len(text), 0, 1
        self.cue = ""  # why all of it is link text
        self.kind = ""
        self.density = 0.0
        self.section = 0
        self.code = False


def site_names(host: str | None) -> frozenset[str]:
    """Names of the site as its host spells them."""
    if not host:
        return frozenset()
    label = [x for x in host.lower().split(".") if x not in ("www", "blog", "m", "news", "example", "com", "org", "net", "shop")][:1]
    name = re.sub(r"\d+$", "", label[0]).replace("-", " ") if label else ""
    return frozenset((name,)) if name else frozenset()


def _entry(s: str) -> bool:
    return s.lower() in _MENU


@lru_cache(1 << 15)
def _known(s: str) -> bool:
    """The same test for short lines, which come again and again."""
    return _FURNITURE.fullmatch(s) is not None


def _furniture(s: str, names: frozenset[str]) -> bool:
    """Whether a line without its marker is furniture by itself."""
    low = s.lower().strip(" .!")
    if low in _MENU or low in names:
        return True
    n = len(s)
    if _known(s) if n <= REMEMBERED else _FURNITURE.fullmatch(s):
        return True
    if n < 70 and _BYLINE.match(s):
        return True
    if names:
        for x in names:
            if x in low and (low.startswith(("search " + x, "suche ", "chercher ", "rechercher ", "buscar ")) and len(low) < len(x) + 26 or low.replace(x, "").strip(" -–|:·.") in ("", "logo", "home")):
                return True
    if " " in s and len(parts := _SEPARATOR.split(s)) > 1 and not s.startswith("|"):
        short = sum(len(p) < 28 for p in parts)
        known = sum(_entry(p) for p in parts)
        if known * 2 >= len(parts) or len(parts) >= 3 and short == len(parts) and not s.rstrip().endswith((".", "!", "?")):
            return True
    return False


def _linked(s: str, names: frozenset[str]) -> bool:
    """Whether a line without its marker, or each of its sentences, is worded like an anchor or a notice of the site."""
    parts = _SENTENCES.split(s)
    if not _furniture(parts[0], names):
        return False
    return len(parts) == 1 or _furniture(s, names) or all(_furniture(x, names) for x in parts[1:])


def read(markdown: str | None, host: str | None = None) -> list[Line]:
    """The page's non-blank lines, kind set to body, thin or what made their density zero."""
    if not markdown:
        return []
    names = site_names(host)
    lines: list[Line] = []
    fence = related = False
    section = 0
    fences = markdown.count("```") and sum(x.lstrip().startswith("```") for x in markdown.split("\n"))
    for no, raw in enumerate(markdown.split("\n"), 1):
        s = raw.strip().lstrip("﻿")
        if not s:
            continue
        line = Line(no, s)
        lines.append(line)
        if fence or s.startswith("```") and fences > 1:
            if s.startswith("```"):
                fence = not fence
                fences -= 1
            related = False
            line.section = section
            line.code = True
            continue
        if s.startswith("```"):  # a fence without its partner closes the code above it
            for above in reversed(lines[:-1]):
                if above.cue or above.text[0] in "#|>" or above.text[-1] in ".!?" and above.text.count(" ") >= 4:
                    break
                above.code = True
            line.code = True
            line.section = section
            continue
        if s[0] == "|":
            related = False
            line.tags += s.count("|")
            line.section = section
            continue
        mark = _MARKER.match(s)
        rest = s[mark.end():] if mark else s
        head = None if mark else _HEADING.match(s)
        if head:
            title = rest[head.end():].strip("*# ").strip()
            line.tags += 1
            section += 1
            related = bool(RELATED.fullmatch(title))
            line.section = section
            if related:
                line.cue, line.link = "related", line.chars
            elif s[0] == "*" and _furniture(title, names):
                line.cue, line.link = "tool", line.chars
            continue
        line.tags += bool(mark)
        if "](" in rest:
            links = _LINK.findall(rest)
            left = _LINK.sub("", rest)
            line.tags += len(links)
            line.link = len(rest) - len(left)
            if not left.strip(" |·›»,;:/•-–.…*"):
                line.cue, line.link = "link", line.chars
                if related and not rest.startswith("["):
                    related = False
                continue
            if _TEASER.search(rest) and (related or "…" in rest or len(links) == 1 and _furniture(links[0].strip(), names)):
                line.cue, line.link = "teaser", line.chars
                continue
            if rest[0] == "!" and not left.strip():
                line.cue, line.link = "logo", line.chars
                continue
        if related and mark:
            line.cue, line.link = "related", line.chars
            continue
        line.section = section
        if _linked(rest, names):
            line.cue, line.link = "tool", line.chars
            continue
        if related and not RELATED.fullmatch(rest):
            related = False
            section += 1
            line.section = section
        elif RELATED.fullmatch(rest):
            related = True
            section += 1
            line.cue, line.link = "related", line.chars
    return _select(lines)


def _sentence(s: str) -> bool:
    """Whether a line ends as a sentence does, links apart."""
    return _SENTENCE.search(_LINK.sub(r"\1", s)) is not None


def _density(chars: int, link: int, tags: int, ratio: float) -> float:
    """Composite text density of a node: characters a tag, adjusted by the page's share of link characters."""
    if link >= chars:
        return 0.0
    base = math.log(chars / (chars - link) * max(1, link) + ratio * chars + math.e)
    return chars / tags * math.log(max(1.001, chars / max(1, link) * tags)) / base


def _select(lines: list[Line]) -> list[Line]:
    """Composite densities, the section of the greatest sum, the threshold of its path; sets the kind of every line.

    The main section keeps all lines of any density. Elsewhere a line under the threshold is thin, unless it is a sentence or
    belongs to a block whose lines are short by nature: code, a table, a heading, numbered items, or items with a heading or a sentence in their section.
    """
    c = sum(x.chars for x in lines) or 1
    lc = sum(x.link for x in lines)
    ratio = lc / c
    sections: dict[int, list[float]] = {}  # sum of densities; characters, link characters, tags of the node
    told: set[int] = set()
    for x in lines:
        x.density = _density(x.chars, x.link, x.tags, ratio)
        if x.density > 0:
            node = sections.setdefault(x.section, [0.0, 0, 0, 0])
            for i, v in enumerate((x.density, x.chars, x.link, x.tags)):
                node[i] += v
            if not x.code and (_HEADING.match(x.text) or _sentence(x.text)):
                told.add(x.section)
    best = max(sections, key=lambda k: (sections[k][0], -k), default=None)
    threshold = min(_density(*sections[best][1:], ratio), _density(c, lc, sum(x.tags for x in lines), ratio)) if sections else 0.0
    for x in lines:
        if x.density <= 0:
            x.kind = x.cue or "link"
        elif x.section == best or x.density >= threshold:
            x.kind = "body"
        else:
            natural = x.code or x.text[0] in "|>" or _HEADING.match(x.text) or (x.section in told or x.text[0].isdigit()) and _MARKER.match(x.text) or _sentence(x.text)
            x.kind = "body" if natural else "thin"
    return lines


def body_text(markdown: str | None, host: str | None = None) -> str | None:
    """The page without its furniture, blank lines between blocks kept; None for null."""
    if markdown is None:
        return None
    keep = {x.no for x in read(markdown, host) if x.kind == "body"}
    out: list[str] = []
    for no, raw in enumerate(markdown.split("\n"), 1):
        if no in keep:
            out.append(raw.rstrip("\r"))
        elif not raw.strip() and out and out[-1]:
            out.append("")
    return "\n".join(out).strip("\n")


def furniture_lines(df: DataFrame, id_col: str = "response_id", text_col: str = "markdown", host_col: str = "host", time_col: str = "ingested_at") -> DataFrame:
    """One row per line that is not main body, of the last delivery of each response."""
    key = df.schema[id_col].dataType.simpleString()

    def make() -> Callable[..., list[tuple]]:
        return lambda k, text, host, at: [(k, at, [x.no for x in read(text, host) if x.kind != "body"])]

    rows = flat_map(df, [id_col, text_col, host_col, F.col(time_col).cast("timestamp")], make, f"`{id_col}` {key}, at timestamp, line_no array<bigint>")
    last = rows.groupBy(id_col).agg(F.max_by("line_no", F.coalesce("at", F.to_timestamp(F.lit("1970-01-01")))).alias("line_no"))
    return last.select(id_col, F.explode("line_no").alias("line_no"))


def main_bodies(df: DataFrame, id_col: str = "response_id", text_col: str = "markdown", host_col: str = "host") -> DataFrame:
    """The main body of every row."""
    key = df.schema[id_col].dataType.simpleString()

    def make() -> Callable[..., list[tuple]]:
        return lambda k, text, host: [(k, body_text(text, host))]

    return flat_map(df, [id_col, text_col, host_col], make, f"`{id_col}` {key}, body string")
