"""Word lists, suggestions and message formats of the style rules. All are fixed values that results depend on."""

# fmt: off
FILLER_DE = {
    "eigentlich": "streichen", "gewissermaßen": "streichen", "sozusagen": "streichen", "quasi": "streichen", "im Grunde": "streichen",
    "letztendlich": "streichen, oder „am Ende“", "durchaus": "streichen", "relativ": "streichen, oder die Zahl nennen",
    "sehr": "streichen, oder ein stärkeres Wort wählen", "wirklich": "streichen", "natürlich": "streichen", "selbstverständlich": "streichen",
    "praktisch": "streichen", "im Prinzip": "streichen", "gegebenenfalls": "streichen, oder die Bedingung nennen",
}
MODAL_DE = "könnte könnten würde würden sollte sollten müsste müssten dürfte dürften hätte hätten wäre wären".split()
BUREAUCRATIC_DE = {
    "im Rahmen von": "„bei“ oder „in“", "im Rahmen der": "„bei“ oder „in“", "im Rahmen des": "„bei“ oder „in“",
    "zum Zwecke der": "„um … zu“", "zum Zwecke des": "„um … zu“", "unter Berücksichtigung": "„mit Blick auf“ oder den Punkt direkt nennen",
    "in Bezug auf": "„zu“ oder „für“", "hinsichtlich": "„zu“ oder „bei“", "bezüglich": "„zu“", "seitens": "„von“ — und den Handelnden nennen",
    "aufgrund der Tatsache": "„weil“", "nicht zuletzt": "streichen",
}
NOMINAL_SUFFIX_DE = tuple("ungen ung heiten heit keiten keit nisse nis tümer tum schaften schaft ismus ismen".split())
NOMINAL_WORDS_DE = frozenset("inanspruchnahme inbetriebnahme kenntnisnahme zurkenntnisnahme".split())
NOMINAL_EXCEPT_DE = frozenset("""
zeitung zeitungen wohnung wohnungen rechnung rechnungen erfahrung erfahrungen ordnung ordnungen nahrung achtung kleidung wahrheit freiheit
gesundheit krankheit zeugnis ergebnis ergebnisse erlebnis erlebnisse verhältnis verhältnisse eigentum reichtum wirtschaft gesellschaft
landschaft mannschaft botschaft herrschaft wissenschaft
""".split())
AUXILIARY_DE = frozenset("werden wird wurde wurden worden".split())
PREFIX_PARTICIPLE_DE = tuple("be ver er ent zer emp miss über unter wider".split())
SEPARABLE_DE = tuple("""
durch zurück weiter gegen unter über auseinander zusammen voran voraus hinter nach vor bei ein aus auf ab an mit um zu fest frei los
statt teil wahr weg her hin dar empor sicher gleich klar hoch heim voll offen wieder
""".split())
PARTICIPLE_I_DE = ("end", "ende", "enden", "endem", "ender", "endes")
PARTICIPLE_EXCEPT_DE = frozenset("""
gegen gegenüber gerade gern gerne genug gemäß gesamt gestern gewiss genau general getreu gesund besonderen besonderes beiden beides
vielen entgegen verschieden verschiedenen besten ersten erst
""".split())
FUNCTION_DE = frozenset("""
aber alle allem allen aller alles als also auch auf aus bei beim bereits bin bis bist dabei damit dann dass dazu dem den denen denn der
deren des dessen dich die dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines einige einigen er es
etwa euch für gegen haben hat hatte hatten hier ihm ihn ihnen ihr ihre ihrem ihren ihrer ihres immer ist jede jedem jeden jeder jedes
jetzt kann kein keine keinen können man mehr mein mich mir mit muss müssen nach nicht nichts noch nun nur ob oder ohne schon sein seine
seinem seinen seiner seines sich sie sind so solche soll sollen sondern sonst über um und uns unser unsere unter vom von vor war waren
was weil weit welche welchem welchen welcher welches wenn werden wie wieder wir wird wirst wo wurde wurden während zum zur zwar zwischen
""".split())
FILLER_EN = {
    "very": "delete, or pick a stronger word", "really": "delete", "actually": "delete", "basically": "delete", "quite": "delete",
    "rather": "delete", "somewhat": "delete", "just": "delete", "simply": "delete", "essentially": "delete", "literally": "delete",
    "in order to": '"to"', "at this point in time": '"now"', "in the event that": '"if"', "due to the fact that": '"because"',
    "for the purpose of": '"to"', "a large number of": '"many"', "in spite of the fact": '"although"', "with regard to": '"about"',
    "it should be noted that": "delete and state the point",
}
HEDGE_EN = {
    "might": "say it plainly, or give the condition", "could": "say it plainly, or give the condition", "perhaps": "delete",
    "possibly": "delete", "seems to": '"is"', "appears to": '"is"', "tends to": '"is"', "sort of": "delete", "kind of": "delete",
}
BE_EN = frozenset("is are was were been being be am".split())
IRREGULAR_EN = frozenset("""
given taken made done seen written known held sent built brought bought kept left told found shown driven chosen spoken broken forgotten
hidden paid said put set met run begun gone won understood withdrawn drawn grown thrown worn torn lost sold led read cut hit let split
spread taught caught felt meant dealt sung sunk struck
""".split())
NOMINAL_SUFFIX_EN = tuple("tions tion ments ment ances ance ences ence ities ity nesses ness".split())
NOMINAL_EXCEPT_EN = frozenset("""
moment moments element elements sentence sentences science sciences silence audience audiences evidence distance distances instance
instances business businesses witness fitness illness city cities entity entities quality qualities quantity quantities security
community communities university universities experience experiences difference differences document documents environment environments
equipment government governments question questions section sections
""".split())
ADVERB_EXCEPT_EN = frozenset("""
only family families reply replies apply applies supply supplies early likely ugly holy july italy rally ally belly jelly silly lily
monopoly anomaly assembly multiply imply comply rely fly ply duly daily weekly monthly yearly friendly lonely lovely deadly costly unlikely
""".split())
FUNCTION_EN = frozenset("""
about after again against all also among and another any are because been before being below between both but came can come could did
does doing done down during each either else even ever every few for from further had has have having her here hers him his how however
into its itself just least less like made make many may might more most much must neither never next nor not now off often once one only
onto other others our ours out over own per quite rather same shall she should since some still such than that the their theirs them
then there these they this those though through thus too under until upon very was were what when where whether which while who whom
whose why will with within without would you your yours
""".split())

#: rule: (German message, German suggestion, English message, English suggestion); {x!q} is a quoted word in English.
MESSAGES = {
    "long-sentence": ("Satz mit {n} Wörtern (Grenze {limit}).", "In zwei Sätze aufteilen: ein Gedanke pro Satz.",
                      "Sentence runs to {n} words (limit {limit}).", "Split into two sentences: one idea per sentence."),
    "hard-sentence": ("Schwer lesbarer Satz: Lesbarkeit {score} von 100 (Amstad), {n} Wörter.", "Kürzen, Nebensätze auflösen, lange Wörter durch kurze ersetzen.",
                      "Hard sentence: reading ease {score} of 100 (Flesch), {n} words.", "Shorten it, unpack the subordinate clauses, swap long words for short ones."),
    "monotone": ("Gleichförmiger Satzrhythmus im ganzen Dokument: {n} Sätze, im Schnitt {mean} Wörter, kaum Längenunterschied (Variationskoeffizient {cv}).", "Kurze und lange Sätze mischen; einen kurzen Satz als Pointe setzen.",
                 "Monotone rhythm across the document: {n} sentences averaging {mean} words with almost no variation (coefficient of variation {cv}).", "Mix short and long sentences; land a short one to make a point."),
    "erratic": ("Sehr unregelmäßige Satzlängen im ganzen Dokument: {n} Sätze, im Schnitt {mean} Wörter (Variationskoeffizient {cv}).", "Die Ausreißer nach oben teilen, damit der Text gleichmäßig liest.",
                "Erratic sentence lengths across the document: {n} sentences averaging {mean} words (coefficient of variation {cv}).", "Split the outliers so the text reads evenly."),
    "repeated-word": ("„{word}“ wiederholt sich nach {gap} Wörtern.", "Synonym verwenden oder die zweite Nennung streichen.",
                      "{quoted} repeats after {gap} words.", "Use a synonym or drop the second mention."),
    "repeated-sentence-start": ("{run} aufeinanderfolgende Sätze beginnen mit „{word}“.", "Satzanfänge variieren: mit dem Subjekt, einem Zeitwort oder dem Ergebnis beginnen.",
                                "{run} consecutive sentences open with {quoted}.", "Vary the openings: start with the subject, a time marker, or the result."),
    "long-word": ("Sehr langes Wort: „{word}“ ({n} Zeichen).", "Kompositum auftrennen oder mit Bindestrich gliedern.",
                  "Very long word: {quoted} ({n} characters).", "Break the compound up or replace it with a shorter term."),
    "passive": ("Passiv: „{pair}“ — der Handelnde fehlt.", "Aktiv formulieren und das Subjekt nennen: wer tut es?",
                "Passive voice: {quoted} … {other} — the actor is missing.", "Name the actor and use the active voice: who does it?"),
    "nominalization": ("Substantivstil: {hits} Nominalisierungen auf {words} Wörter ({pct} %). Hier: „{word}“.", "Als Verb schreiben: statt „Durchführung von X“ lieber „X durchführen“.",
                       "Nominalization: {hits} noun forms in {words} words ({pct}%). Here: {quoted}.", 'Use the verb: "we decided" rather than "the decision was taken".'),
    "modal-hedge": ("Konjunktiv-Häufung: {hits} unverbindliche Formen auf {words} Wörter. Hier: „{word}“.", "Indikativ schreiben und die Aussage verantworten: „wir prüfen“ statt „wir würden prüfen“.", "", ""),
    "adverb": ("", "", "Adverbs: {hits} -ly adverbs in {words} words ({pct}%). Here: {quoted}.", 'Pick a stronger verb: "sprinted" rather than "ran quickly".'),
    "filler": ("Füllwort: „{span}“ trägt nichts zur Aussage bei.", "Ersatzlos {tip}.", "Filler: {quoted} adds nothing.", "Use {tip}."),
    "hedge": ("", "", "Hedge: {quoted} weakens the claim.", "Use {tip}."),
    "bureaucratic": ("Behördendeutsch: „{span}“.", "Einfacher: {tip}.", "", ""),
}
# fmt: on
