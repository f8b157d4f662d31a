"""Word lists and patterns of the rules on German and English requirement texts.

All are fixed values: results of the rules depend on each word. Patterns are for
lower-case text (``rules.low``) where nothing else is said. The edge of a word is
written as a character that isn't one of ``W`` (or the text's end), as ``\\b`` does not
know umlauts in every dialect; COSTS, UNITS, PROCUREMENT, NUMBER_NORM and DUTY are
stated anew, in another form, in the SQL that the rules are held against.
"""

#: A letter or digit of a word, umlauts included.
W = "[a-z0-9_äöüß]"

# Vendors of standard parts, hydraulics, electrics and materials; words that prescribe; words that leave a choice; titles of bought-in parts.
VENDORS = (
    "(^|[^a-z0-9_])(hasco|meusburger|d-?m-?e|strack|fibro|agathon|euchner|balluff|telemecanique|siemens|square d|parker|merkle|roemheld|römheld|hydropneu|hawe|rexroth|festo|st[äa]ubli|harting|weidm[üu]ller|lapp|"
    "oerlikon|balinit|b[öo]hler|uddeholm|d[öo]rrenberg|kind\\s*&\\s*co|buderus|loctite|kl[üu]ber|molykote|castrol|ermeto|voss|rud|norelem|k[öo]nig|koenig|progressive|regloplas|hb-therm|fondarex)($|[^a-z0-9_])"
)
PRESCRIBES = (
    "(^|[^a-z0-9_äöüß])nur($|[^a-z0-9_äöüß])|ausschlie(ß|ss)lich|zu verwenden|einzusetzen|eingesetzt werden|zu verschlie|verwenden($|[^a-z0-9_äöüß])|(^|[^a-z0-9_äöüß])(müssen|muss)($|[^a-z0-9_äöüß])|"
    "(^|[^a-z0-9_äöüß])sind($|[^a-z0-9_äöüß].{0,60}[^a-z0-9_äöüß])zu($|[^a-z0-9_äöüß])|vorgeschrieben|(^|[^a-z0-9_äöüß])lieferant\\s*:|(^|[^a-z0-9_äöüß])(only|must|shall)($|[^a-z0-9_äöüß])|required"
)
LEAVES_OPEN = (
    "bevorzugt|vorzugsweise|z\\.\\s?b\\.|beispielsweise|gleichwertig|andere\\s+[a-z0-9_äöüß]*\\s*(lieferanten|hersteller)[a-z0-9_äöüß]*\\s+(sind\\s+)?zul|(^|[^a-z0-9_äöüß])(können|kann)($|[^a-z0-9_äöüß])|möglich|e\\.g\\.|equivalent|prefer|vergleichbar|etc\\."
)
BOUGHT_IN = "schieber|auswerfer|führung und zentrierung|entlüftung|vakuum|temperier|hydraulik|elektrik|sensor|nachverdicht|squeez|handling|werkstoffauswahl|beschicht|normteil|normalie|ersatz- und verschleiß"

# Consequences of cost, who bears them, what is only an offer, negations and customers near a formula; cost in a standard.
COSTS = (
    "zu lasten|in rechnung (?:ge)?stellt|weiter(?:be)?rechne|angelastet|nach aktuellem stundensatz|kostenpflichtig|(?:fester|pauschal[a-z0-9_äöüß]*) betrag|vertragsstrafe|pönale|"
    "kosten[a-z0-9_äöüß]*[^a-z0-9_äöüß](?:.{0,58}[^a-z0-9_äöüß])?(?:trägt|tragen|übernimmt|übernehmen|gehen)(?:$|[^a-z0-9_äöüß])|at the expense|charged to"
)
PARTY = "lieferant|auftragnehmer|formenbauer|werkzeugherstell|hersteller|supplier|contractor|(^|[^a-z0-9_])diese[mn]($|[^a-z0-9_])"
OFFER = "angebot|kalkul|ausweisen|aufzuführen|quotation"
NEGATION = "^(nicht|kein[a-z0-9_äöüß]*|ohne|weder|not|no|never)$"
CUSTOMER = "^(auftraggeber[a-z0-9_äöüß]*|kunde[a-z0-9_äöüß]*|kunden|bestell[a-z0-9_äöüß]*|customer[a-z0-9_äöüß]*|client[a-z0-9_äöüß]*|purchaser[a-z0-9_äöüß]*|buyer[a-z0-9_äöüß]*)$"
COST_IN_STANDARD = "kosten|zu lasten|preis|mehraufw"

# Open wording, product placeholders, procurement, responsibility, contradiction, references, numbers and norms, duty.
OPEN_WORDING = "herstellerneutral|nach freigabe|freigegeben|vereinbart|abgestimmt|nach r[üu]cksprache|nach absprache"
PLACEHOLDER = "typ|fabrikat|hersteller|lieferant|marke|artikel"
PROCUREMENT = "(?<![a-z0-9_äöüß])fa\\.|(?<![a-z0-9_äöüß])firma(?![a-z0-9_äöüß])|fabrikat|hersteller|lieferant|(?<![a-z0-9_äöüß])marke(?![a-z0-9_äöüß])|typenbezeichnung"
AFFECTED = "verantwort|zuständig|genehmig|zulässig|unzulässig|nur mit|nur nach|untersagt|verboten|obliegt|verbleibt|lieferumfang|ausgenommen"
NEGATED_HINT = "^.{0,80}?[^a-z0-9_äöüß](kein[a-z0-9_äöüß]*|nicht|nichts|nein|n/?a|entf[äa]llt|unklar)($|[^a-z0-9_äöüß])|^(kein[a-z0-9_äöüß]*|nicht|nichts|nein|n/?a|entf[äa]llt|unklar)($|[^a-z0-9_äöüß])|nicht (anwendbar|zutreffend|relevant)"
CONTRADICTION = "widerspr"
NO_CONTRADICTION = "(nicht|kein[a-z0-9_äöüß]*|ohne)\\s+([a-z0-9_äöüß]+\\s+){0,3}widerspr|widerspruchsfrei|widerspricht\\s+([a-z0-9_äöüß]+\\s+){0,3}nicht"
REFERENCE = "(^|[^a-z0-9_äöüß])((seiten?|s\\.?|abschnitt|kapitel|punkt|ziffer|z\\.|nr\\.|pos\\.)\\s*[0-9]+([.,][0-9]+)*)"
NUMBER_NORM = "(^|[^a-zA-Z0-9_äöüÄÖÜß])(DIN|EN|ISO|VDI|VDA|VDE|SEP|ASTM|IEC)($|[^a-zA-Z0-9_äöüÄÖÜß])|[0-9]"  # on text as it is written
DUTY = "(^|[^a-z0-9_äöüß])(nur|ausschlie(ß|ss)lich|zwingend|verpflichtet|trägt|übernimmt|kosten|garantie|gewährleistung|frist|innerhalb|spätestens|wöchentlich|zusätzlich|mindestens|maximal|max\\.|min\\.)"
FOREIGN_ID = "(^|[^a-z0-9_])lhd-[0-9]"
CONNECTION_FAILED = "aufruf fehlgeschlagen"

# Titles of lists of contents, words that make such a title part of a sentence, rows with a page number.
CONTENTS_TITLE = "inhalts?verzeichnis|inhalt|table of contents|abbildungsverzeichnis|tabellenverzeichnis|abkürzungsverzeichnis|revisionshistorie"
SENTENCE_WORDS = "im in das des der die dem den mit und was zum zur vom am auf für über ohne eines einer einem ein eine folgendem folgenden folgender ihrem ihren seinem seinen deren dessen of the with and".split()
CONTENTS_ROW = "^\\s*[0-9]+(\\.[0-9]+)*\\.?\\s+\\S.{0,80}?(\\.{3,}|\\s{3,}|\\t)\\s*[0-9]{1,3}\\s*$"
# One of these words is in each title, and this gap in each row.
CONTENTS_WORDS = "inhalt|table of contents|verzeichnis|revisionshistorie"
CONTENTS_GAP = "(\\.{3}|\\s{3}|\\t)\\s*[0-9]"

# Units of values (pattern after a number, name); those that count instead of measure.
UNITS = [("schuss|abg(?:ü|u)ss[a-z0-9_äöüß]*|castings?|shots?|gießzyklen|zyklen", "schuss"), ("hübe|hub(?:$|[^a-z0-9_äöüß])|strokes?", "hübe"), ("hrc", "hrc"), ("khz", "khz"), ("bar(?:$|[^a-z0-9_äöüß])", "bar"), ("°\\s?c", "°c"), ("mm(?:$|[^a-z0-9_äöüß])", "mm"), ("%", "%")]
COUNTING = ["schuss", "hübe"]
NUMBER = "[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]+(?:[.,][0-9]+)?"
MATERIAL = "1\\.[0-9]{4}"

# Frequent German and English function words, for the share of real language in a text.
FUNCTION_WORDS = """
der die das und oder für von mit ist sind wird werden nicht auch nach bei zum zur den dem des ein eine einer einem sowie muss müssen kann können gemäß
the and for with are shall must not from this that will have been which used
""".split()

# Capitals and words that say nothing about where a fact is from; generic titles of headings.
EVERYDAY = "DIN ISO EN DE PDF CAD CAM CNC NC STL STEP IGES FTP SPC HRC PVD CVD DER DIE DAS UND MIT VON FÜR NICHT ODER ALS AUS BEI NUR".split()
GENERIC_TITLES = (
    "allgemein allgemeines anhang anhänge anlage anlagen sonstiges sonstige inhalt inhaltsverzeichnis bemerkung bemerkungen hinweis hinweise tabelle abbildung "
    "general annex appendix others remarks vorwort einleitung introduction änderungen änderungsindex verteiler"
).split()

# How a template document is built: numbered and deeper headings, classes, captions of blocks, lists. Blanks include the one that doesn't break.
BLANK = "[\\s\u00a0]"
NUMBERED = "^([0-9]+(?:\\.[0-9]+)?)[\\s\u00a0]+([^\\s\u00a0].*)$"
DEEPER = "^[0-9]+(\\.[0-9]+){2,}\\.?[\\s\u00a0]+[^\\s\u00a0]"
CLASSES = ("Pflicht", "Regel", "Optional")
FOUND_IN = "belegt[\\s\u00a0]+in[\\s\u00a0]+([0-9]+)[\\s\u00a0]+von[\\s\u00a0]+([0-9]+)"
CAPTIONS = {"required": "standardanforderungen", "variants": "ausprägungen im korpus", "placeholders": "projektspezifisch festzulegen"}
TERMS_PREFIX = "abgleichbegriffe:"
DOCUMENT_LIST = ",(?=[\\s\u00a0A-Za-zÄÖÜ])|\n"
TERM_LIST = "[·•;]"
BRACKETED = "\\[([^\\]]+)\\]"

# Fixed value: ids of documents that examples must not show.
DOCUMENT_MARK = "(?i)\\(?\\bLHD-[0-9,]+\\)?"
