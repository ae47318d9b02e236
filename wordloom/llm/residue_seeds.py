"""Sentences from which the residue models are fitted.

Written from general knowledge of web pages, programs and page templates, by topic and
in four languages; no sentence is taken from any table the operator is run on (a test
compares them).  Status lines, exception names, signals and system errors come from
Python's standard library.  ``(a|b)`` in a form stands for alternatives; a form is a
wording family, and families are what a cross-validation holds out.
"""

from __future__ import annotations

import builtins
import errno
import os
import re
import signal
from collections.abc import Iterator
from http import HTTPStatus
from itertools import cycle, islice

#: Variants made of one form at most.
VARIANTS = 24

NOTICE = [
    # scripts
    "This (site|application|player|form|map) (requires|relies on|only works with|will not run without) (JavaScript|JS|scripting|client-side scripts).",
    "(JavaScript|Scripting|JS) (must be|has to be|needs to be) (enabled|active|switched on|allowed) (for this site to work|before you can go on|to use the editor|in your web browser).",
    "(Enable|Activate|Allow|Switch on|Turn on) (JavaScript|scripts|JS) (in the settings of your browser|and refresh|to load the content|for the full experience).",
    "(Sorry, but|We're sorry but|Unfortunately) this (site|app|shop) (doesn't work properly|cannot be displayed|does not function) without (JavaScript|scripts) (enabled|switched on).",
    "It (looks like|seems that|appears) (JavaScript|scripting) is (deactivated|not enabled|unsupported|turned off) (on your device|in your web browser).",
    "(Your|The) browser (does not support|doesn't run|has disabled|is blocking) (JavaScript|scripts|HTML5 video|inline frames).",
    "(JavaScript|Scripts|JS) (disabled|blocked|unavailable|not supported|required|is disabled|is off). (Please check your settings|Some features will not work|This application needs it).",
    "For full functionality of this website it is necessary to (enable|allow) JavaScript. Here are the (instructions|steps).",
    "This (content|video|widget|function) (needs|requires) (scripts|JavaScript|cookies) (; see how to enable it|, see the list of supported browsers|to be enabled). Reload (once you have changed it|the page afterwards).",
    "Please (enable|turn on|activate|allow) (JavaScript|scripts|JS) (in order to use this service|so that we can show the contents|to proceed).",
    # cookies, login, browser, checks
    "(Cookies|Third-party cookies|Cookies and JavaScript) (must be enabled|are disabled in your browser|have to be accepted) (to sign in|to use this service|before continuing).",
    "(Accept|Allow|Please enable|You have to allow) cookies (and refresh|to proceed|to see the content|in your browser settings).",
    "(Log in|Sign in|Please log in|You need to sign in|You have to be logged in) (to read the full story|to view this thread|to leave a reply|to access your account|with your account first).",
    "(This content is|These pages are) (for members only|only available to subscribers|restricted to registered users). (Register|Log in) (now|here).",
    "Your (session|login) has (timed out|expired|ended). Please (sign|log) in (once more|to go on).",
    "(Subscribe|Register|Create an account) to (continue reading|unlock this article|see more).",
    "(You are using an outdated browser|Your browser is no longer supported|This browser is too old). (Upgrade|Please update your browser|Switch to a newer version).",
    "(Verifying|Checking|Making sure) (that you are|you're) (human|not a robot). (This may take a moment|Please wait|It will only take seconds).",
    "(Checking|Verifying) (your connection|if the site connection is secure|your device) before (you proceed|access is granted).",
    "(Complete|Solve) the (captcha|security check|challenge) (below|to proceed).",
    "(Please disable|Turn off|Pause|Switch off) your (ad blocker|adblocker|ad-blocking extension) (on this site|to support us|and reload).",
    "(Loading|Please wait)... (if this takes too long, check your connection|if the page stays empty, allow scripts|the content is being loaded)",
    "<noscript>(You need to enable scripts|Please turn JavaScript on|Scripting is switched off|This application works only with scripts)</noscript>",
    # de
    "(Bitte|Um fortzufahren) (aktivieren Sie|schalten Sie|erlauben Sie) (JavaScript|Skripte|Cookies) (in Ihrem Browser|ein|, um alle Funktionen zu nutzen).",
    "(JavaScript|Skripte|Cookies) (ist deaktiviert|sind deaktiviert|ist abgeschaltet|muss aktiviert sein|werden benötigt).",
    "Diese (Anwendung|Website|Funktion) (benötigt|erfordert|funktioniert nur mit) (JavaScript|Cookies|aktivierten Skripten).",
    "Ihr Browser (unterstützt kein JavaScript|ist veraltet|blockiert Cookies|erlaubt keine Skripte). (Bitte aktualisieren Sie ihn|Ändern Sie die Einstellungen).",
    "(Melden Sie sich an|Bitte loggen Sie sich ein|Anmeldung erforderlich), (um weiterzulesen|um den Inhalt zu sehen|um fortzufahren).",
    "Ihre Sitzung ist abgelaufen(.|, bitte melden Sie sich erneut an.)",
    # fr
    "(Merci d'activer|Activez|Vous devez activer) (JavaScript|les scripts|les cookies) (pour continuer|dans votre navigateur|pour utiliser ce service).",
    "(JavaScript|Les scripts) (est désactivé|sont désactivés|doit être activé|sont nécessaires) (dans votre navigateur|pour cette application).",
    "(Cette page|Cette application) (requiert|a besoin de|ne fonctionne pas sans) (JavaScript|cookies|scripts).",
    "Votre navigateur (n'est pas compatible|ne prend pas en charge JavaScript|est trop ancien|n'autorise pas les cookies).",
    "(Connectez-vous|Identifiez-vous|Merci de vous connecter) (pour lire la suite|pour accéder à cette page|pour continuer).",
    # es
    "(Por favor, active|Habilite|Debe activar) (JavaScript|las cookies|los scripts) (para continuar|en su navegador|para usar este servicio).",
    "(JavaScript|El uso de scripts) (está desactivado|está deshabilitado|debe estar habilitado) (en su navegador|para esta aplicación).",
    "(Esta página|Esta aplicación) (requiere|necesita|no funciona sin) (JavaScript|cookies|scripts).",
    "Su navegador (no es compatible|no admite JavaScript|está desactualizado|bloquea las cookies).",
    "(Inicie su sesión|Debe iniciar sesión|Identifíquese) (para leer más|para ver esta página|para seguir).",
]

ERROR = [
    # lost and refused pages
    "(The|Sorry, the) (page|article|file|address) you (requested|tried to open|were trying to reach) (could not be found|does not exist|is no longer available|has been deleted|may have been moved).",
    "(We couldn't|We could not|Sorry, we are unable to) (find|locate) (that page|what you were looking for|the requested address).",
    "(Not found|Nothing found|No such page|Page does not exist|This page isn't available). (Check the address|Try the search|Return to the start page|Go back).",
    "(Oops|Whoops|Uh oh)! (Something went wrong|That page is gone|This link seems to be broken|We hit a snag). (Go to the homepage|Try again).",
    "(This|The) (entry|thread|video|item|link) (has been removed|was deleted by its author|is broken or has expired|does not exist any more).",
    "(An error|A technical error|An internal error|An unknown error) (occurred|happened) (while processing your request|on the server|while loading this page). (Error|Incident|Reference) (number|code|id) (a81f0|5d2c7e|77b1).",
    "(Access|Permission) (to this page|to the requested resource|for this user) (is|has been) (denied|forbidden|restricted). (You do not have|You lack) permission (to open it|to access this server).",
    "(You are not|You're not) (authorized|allowed) to (view|open|access) this (page|directory|resource).",
    "(Your request|Your IP address|This connection) (has been blocked|was rejected|was refused) (by the firewall|by our security rules|for security reasons).",
    "(Too many attempts|Rate limit exceeded|You have reached the request limit|You are sending requests too fast). (Slow down|Please wait|Try again in) (a minute|15 seconds|and reload).",
    "(The service|This site|The server) is (temporarily unavailable|currently overloaded|offline at the moment|not responding). (Please try again later|Try again in a few minutes|Come back soon).",
    "(We are|We're|The site is) (undergoing maintenance|down for scheduled maintenance|currently performing upgrades|offline for maintenance). (Back soon|Please check back in an hour|Thank you for your patience).",
    "(Error|HTTP error|Status) (404|500|403|503|502)( – nothing at this address| – internal error|: the server reported a problem)",
    "The (gateway|upstream server|origin) (did not respond in time|returned an invalid response|closed the connection).",
    "(Request|Trace|Ray|Session|Support) (ID|id|number): (9c41e07b|5f02d1aa|a7c3|00418)",
    # programs
    'File "(main|/usr/lib/loader|src/views|lib/parser).py", line (8|31|204), in (load|main|handle|parse)',
    "Traceback (most recent call first|most recent call last, shortened):",
    "(list|string|tuple) index out of (range|bounds) in (parse|load|view)",
    "(Fatal|Parse|Recoverable) error: (Uncaught exception|Call to undefined function get|syntax error, unexpected end of file|cannot connect to database host|out of memory) in (/var/www/html/index.php|/home/site/lib/db.inc|/opt/web/view.php) on line (3|27|118)",
    "(Warning|Notice|Deprecated): (Undefined variable|Undefined index: title|include(): failed opening|mysqli_connect(): connection refused|Invalid argument supplied) in (/var/www/html/page.php|/home/site/lib/list.inc) on line (9|41)",
    "(java.lang.RuntimeException|java.io.IOException|java.lang.ClassCastException|java.util.NoSuchElementException|java.lang.IllegalArgumentException): (null|no value present|broken pipe|unexpected state|missing entry)",
    "at (com.shop.web.Servlet.service|org.site.View.show|net.app.Main.run)((Servlet|View|Main).java:(17|88|340))",
    "(Exception in thread|Unhandled exception in) (main|worker-2|pool-1): (stack trace follows|no handler|terminated)",
    "Uncaught (TypeError|ReferenceError|SyntaxError): (cannot read properties of undefined|app is not defined|unexpected token|x is not a function)",
    "ERROR (1045|1064|2002) (28000|42000|HY000): (access denied for user|you have an error in your SQL syntax|can't connect to local server)",
    "(Could not|Cannot|Error while trying to|Failed to) (connect to the database|establish a database connection|open stream|load resource): (connection refused|timeout|no such host)",
    # de
    "(Die Seite|Der Artikel|Das Dokument) (wurde nicht gefunden|konnte nicht gefunden werden|ist nicht mehr verfügbar|existiert leider nicht mehr).",
    "(Fehler|HTTP-Fehler) (404|500|403|503): (Seite nicht vorhanden|interner Serverfehler|Zugriff nicht erlaubt|Dienst nicht verfügbar)",
    "(Der Server|Der Dienst|Die Website) ist (derzeit|zurzeit|momentan) (nicht verfügbar|überlastet|nicht erreichbar). (Bitte später erneut versuchen|Wir arbeiten daran).",
    "(Zugriff|Der Zugang) (wurde verweigert|nicht gestattet|ist gesperrt). Es ist ein (Fehler|unerwarteter Fehler) aufgetreten.",
    # fr
    "(La page|L'article|Le document) (demandée n'existe pas|est introuvable|n'existe plus|n'a pas été trouvé).",
    "Erreur (404|500|403|503) - (page non trouvée|erreur interne du serveur|accès interdit|service indisponible)",
    "(Le serveur|Le site|Le service) est (actuellement|temporairement) (indisponible|surchargé|inaccessible). (Veuillez réessayer plus tard|Merci de patienter).",
    "(L'accès est|Accès) (interdit|refusé à cette page|non autorisé). Une erreur (est survenue|inattendue s'est produite).",
    # es
    "(La página|El artículo|El documento) (solicitada no existe|no se ha encontrado|ya no está disponible|no pudo ser encontrado).",
    "Error (404|500|403|503) - (no se encontró la página|error interno del servidor|prohibido|servicio no disponible)",
    "(El servidor|El sitio|El servicio) (no está disponible en este momento|está sobrecargado|no responde). (Inténtelo de nuevo más tarde|Vuelva pronto).",
    "(Acceso|El acceso) (prohibido|no autorizado|ha sido denegado). (Ha ocurrido|Se produjo) un error (inesperado|interno).",
]
EXCEPTION_DETAILS = ["'title'", "'user_id'", "list assignment index out of range", "invalid value", "unsupported operand", "object is not callable", "not found", "expected str, got NoneType"]

FILLER = [
    "(Insert|Add|Enter|Put|Type|Write) (your|some|the) (text|content|title|description|headline|copy) (here|in this box|at this place).",
    "(Your|The|Some) (headline|content|title|image|caption|message) (goes|comes|will go) here.",
    "(Text|Content|Copy|Description|Details) (to be added|to come|follows soon|will be added later|TBD).",
    "This is (a sample|a dummy|an example|some placeholder|a test) (paragraph|page|post|text|article|sentence)(.|, please ignore.|. Edit or delete it.|, replace it before going live.)",
    "(Placeholder|Dummy|Filler|Sample|Example|Test) (text|copy|content|paragraph|headline|article) (only|for layout|number 3|, not for publication|to be replaced|to show the design)",
    "(Example|Sample|Dummy) (text|page|line) (1|2|3)(.| of 5.| ends here.| begins here.)",
    "(Just|Only) a (test|placeholder|draft)(.|, delete it later.|, do not read.)",
    "(Lorem|Replace this|Change this|Delete this) (text|line|paragraph) (when|as soon as|once) the (real|final) (copy|content|words) (is|are) (there|ready).",
    "(copy|line|sample|blah|foo bar|title) (copy|line|sample|blah|foo bar|title) (copy|line|sample|blah|foo bar|title) (copy|line|sample|blah|foo bar|title)",
    "(tk|tktk|TK|xxx|todo|tbd) (tk|tktk|TK|xxx|todo|tbd) (headline|intro|body|caption|date) (tk|xxx|todo|to come)",
    "(Hier|An dieser Stelle) (steht|folgt|erscheint) (bald|demnächst) (Ihr|der|ein) (Text|Inhalt|Titel).",
    "(Dies|Das) ist (ein Beispieltext|ein Platzhalter|nur Fülltext|ein Mustertext)(.| und hat keinen Inhalt.|, bitte ersetzen.)",
    "(Beispieltext|Platzhalter|Blindtext|Mustertext|Fülltext) (für das Layout|ohne Inhalt|bitte ersetzen|folgt).",
    "(Insérez|Ajoutez|Saisissez) (votre|le) (texte|titre|contenu) (ici|à cet endroit).",
    "(Ceci est|Voici) (un texte d'exemple|un exemple de paragraphe|du texte provisoire|un texte de démonstration)(.|, à supprimer.|, à remplacer.)",
    "(Texte|Contenu) (fictif|provisoire|à venir|de démonstration|d'exemple).",
    "(Inserte|Añada|Escriba) (su|el) (texto|título|contenido) (aquí|en este lugar).",
    "(Este es|Esto es) (un texto de ejemplo|un párrafo de muestra|un texto provisional|contenido de prueba)(.|, bórrelo.|, debe reemplazarse.)",
    "(Texto|Contenido) (ficticio|provisional|de muestra|de prueba|por venir).",
    "(titre|texte|texto|frase|Text|Zeile) (titre|texte|texto|frase|Text|Zeile) (titre|texte|texto|frase|Text|Zeile) (titre|texte|texto|frase|Text|Zeile)",
]
#: The usual Latin filler (public domain), as printers set it, and the passage of Cicero it comes from.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum sed ut perspiciatis unde omnis iste natus error "
    "sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo"
).split()
MASH = "asdf qwerty jkl foo bar baz xxx test blah hjkl zxcv qwer dummy lkj sdfg".split()

#: Ways to mark a blank, as template languages, mail programs and editors have them; {n} is the name of what is missing.
BLANKS = [
    "{{{{{n}}}}}", "{{{{ {n} }}}}", "{{{{{n}|default}}}}", "{{{n}}}", "${{{n}}}", "#{{{n}}}", "${n}$", "%{n}%", "%%{n}%%", "%({n})s", "__{n}__", "[[{n}]]", "<%= {n} %>",
    "{{% include {n} %}}", "@@{n}@@", "*|{n}|*", "XXX{n}XXX", "<<{n}>>", "«{n}»", "&lt;{n}&gt;", "[insert {n}]", "[enter {n} here]", "[your {n}]", "[{n} TBD]", "(insert {n})", "<your {n}>",
    "[{n} hier eintragen]", "[Ihr {n}]", "[insérer {n}]", "[votre {n}]", "[inserte {n}]", "[su {n}]", "%s", "%d", "{{0}}", "{{1}}",
]
#: What programs print for a missing value.
EMPTY_VALUES = ["null", "undefined", "None", "NaN", "NaN/NaN/NaN", "[object Object]"]
NAMES = "name firstName last_name NAME email date order_id username company item address subject url count street total customer.name phone invoice.no signature zip".split()
#: Sentences around blanks; _ stands for one.
FORMS = [
    "Hi _, your invoice _ is attached.", "Dear Mr _, we confirm your booking for _.", "Good morning _! Your parcel from _ has left on _.", "Thank you for registering, _.", "Written by _ in _.",
    "Results for _: _ hits on _ pages.", "Kind regards, _", "_ and _ will play against _ on _.", "Our shop in _ opens at _.", "The weather in _ is _ with _ degrees.", "_ told the paper that _ would be late.",
    "Sehr geehrte Frau _, Ihre Bestellung _ ist unterwegs.", "Hallo _, willkommen bei _.", "Chère _, votre commande _ est prête.", "Bienvenue à _, _ !", "Estimado _, su pedido _ ha salido.", "Bienvenido a _, _.", "_, _", "_",
]

#: Sentences that talk about residue without being any, or merely share words with it; … stands for what they quote. Natural prose.
MENTIONS = [
    "(The manual|Our teacher|The course|The tutorial|A footnote) (explains|shows|told us) (why|when|how) (a server|a page|the browser) (shows|sends|prints) \"…\" (to its readers|at times|in such cases).",
    "(She|He|My uncle) (read|saw|typed|noticed) \"…\" on the (screen|door|poster|ticket) and (laughed|went home|took a picture).",
    "The (string|phrase|words|line|label) \"…\" (is|was|occurs|stood) (in every third record|at the end of the file|on the sign|in the list) (, so we removed it|for years|, as expected).",
    "(We|They) (count|match|filter|replace|collect) (lines|records|pages) that (contain|begin with|consist of) \"…\" (before the training|in the first step|by hand).",
    "(The tutorial|This chapter|My colleague) (shows|explains|describes) how to (disable|enable|use|debug) (JavaScript|cookies|scripts|a template|placeholders) (in a browser|in two steps|for beginners).",
    "(Our club|The old library|The museum|The ferry|The shop) was (closed|unavailable|out of service|under repair) (last week|for two days|in winter|to visitors), (because of the storm|so we stayed at home|as every year).",
    "(They|The guards) denied (him|us|the visitors) access to the (garden|archive|tower) (yesterday|again|on Monday).",
    "(He|She) (made an error|found the page|lost the key|missed the exception) in (line|chapter|room) (four|nine|twelve) and (corrected it|read on|laughed).",
    "(JavaScript|Latin|The template|A browser) (is|was) (a language|an old word|the topic of the evening|hard to learn) (, he said|for many|in those days).",
    "(Das Handbuch|Die Lehrerin|Der Kurs) erklärt, (warum|wann) (ein Server|der Browser) (so etwas|eine solche Meldung) (zeigt|sendet).",
    "(Le manuel|La professeure) explique (pourquoi|quand) (un serveur|le navigateur) (affiche|envoie) (cela|un tel message).",
    "(Der Brief|Das Blatt|Die Karte|Die Tasche) (im Koffer|in der Küche|auf dem Tisch|unter dem Bett) war (leer|nass|nicht zu übersehen|zerrissen), (also gingen wir nach Hause|und alle lachten|aber niemand sagte etwas).",
    "(Am Abend|Gestern|Nach dem Essen) (gingen|fuhren|liefen) (die Kinder|wir|meine Eltern) (noch einmal|zu Fuß|mit dem Rad) (an den Fluss|in die Stadt|zum Markt).",
    "(Le soir|Hier|Après le repas), (les enfants|nous|mes parents) (sommes allés|sont partis) (au bord de la rivière|en ville|au marché) (sans parler|comme d'habitude).",
    "(Por la tarde|Ayer|Después de comer) (los niños|mis padres|todos) (fueron|volvieron) (al río|a la ciudad|al mercado) (sin hablar|como siempre), y (nadie|mi hermana) (dijo nada|se quejó).",
    "(In the evening|Yesterday|After lunch) (the children|we|my parents) (went|walked|drove) (to the river|into town|to the market) (early|again|with the dog), so that (nobody|we) could (see|start|find) (the boats|the way|a seat).",
    "(El manual|La profesora) explica (por qué|cuándo) (un servidor|el navegador) (muestra|envía) (eso|ese mensaje).",
]


def variants(form: str, most: int = VARIANTS) -> list[str]:
    """Up to ``most`` of the sentences a form stands for, spread evenly over all of them."""
    slots = [s[1:-1].split("|") if s.startswith("(") and s.endswith(")") and "|" in s else [s] for s in re.split(r"(\([^()]*\|[^()]*\))", form)]
    whole = 1
    for s in slots:
        whole *= len(s)
    out = []
    for k in range(min(most, whole)):
        n, parts = k * whole // min(most, whole) + k % max(1, whole // min(most, whole)), []
        for s in slots:
            n, r = divmod(n, len(s))
            parts.append(s[r])
        out.append("".join(parts).replace(" ,", ",").replace(" ;", ";").strip())
    return list(dict.fromkeys(out))


def _library() -> Iterator[tuple[str, list[str]]]:
    """Families of failure messages from the standard library."""
    status = [s for s in HTTPStatus if s >= 400]
    yield "status", [x for s in status for x in (f"{s.value} {s.phrase}", s.phrase, f"HTTP {s.value} {s.phrase}", f"{s.value} error, {s.phrase}")]
    yield "status page", [f"<html><head><title>{s.value} {s.phrase}</title></head><body><center><h1>{s.phrase}</h1></center></body></html>" for s in status]
    raised = sorted(n for n, c in vars(builtins).items() if isinstance(c, type) and issubclass(c, Exception) and n.endswith(("Error", "Exception")))
    yield "exception", [f"{n}: {d}" for n, d in zip(raised, cycle(EXCEPTION_DETAILS), strict=False)]
    yield "traceback", ["Traceback (most recent call last):"]
    yield "system", [f"{c}: {os.strerror(e)}" for e, c in zip(sorted(errno.errorcode)[:60], cycle(["cat", "open", "connect", "/bin/sh", "bind"]), strict=False)]
    yield "signal", [x for s in signal.Signals if (x := signal.strsignal(s)) and s < 16]


def families() -> dict[str, list[list[str]]]:
    """Per class the wording families, each a list of sentences."""
    names, blanks = cycle(NAMES), cycle(BLANKS * 3 + EMPTY_VALUES * 4)
    template = []
    for form in FORMS:
        own, parts = [], form.split("_")
        for _ in range(3 * len(BLANKS) + 5):  # moves on in the cycle from form to form
            filled = [next(blanks).format(n=next(names)) for _ in parts[1:]]
            own.append(parts[0] + "".join(a + b for a, b in zip(filled, parts[1:], strict=True)))
        template.append(own)
    latin = [" ".join(islice(cycle(LATIN[k:] + LATIN[:k]), n)) + "." for k in range(0, len(LATIN), 2) for n in (6, 14)]
    mixed = [" ".join(LATIN[(k * j) % len(LATIN)] for j in range(1, 15)) for k in range(1, len(LATIN), 2)]
    mash = [" ".join(MASH[(k * j + j // 3) % len(MASH)] for j in range(1, 12)) for k in range(1, 30)]
    made = lambda forms: [variants(f) for f in forms]
    return {"template": template, "filler": [*made(FILLER), latin, mixed, mash], "error": [*made(ERROR), *(x for _, x in _library())], "notice": made(NOTICE), "mention": made(MENTIONS)}


def seeds(part: int | None = None, parts: int = 2) -> dict[str, list[str]]:
    """Sentences by class: template, filler, error, notice; and the mentions. ``part`` leaves out every ``parts``-th family."""
    return {c: [s for k, family in enumerate(fs) if part is None or k % parts != part for s in family] for c, fs in families().items()}
