"""Wordings on which nothing is fitted: residue by class, and sentences that only mention it or share words with it."""

HELD_OUT = {
    "notice": [
        "Please verify you are human.", "Bitte Cookies zulassen und Seite neu laden.", "To use this web app, turn scripting back on.", "Scripts are switched off, so the editor cannot start.",
        "Looks like JavaScript got turned off. Flip it on and hit refresh.", "You must allow cookies to place an order.", "Members, please log in to see this picture.", "Your session has run out. Log in again.",
        "We need to check that you are not a bot.", "Update your browser to view this website correctly.", "Internet Explorer is no longer supported on this site.", "Turn your ad blocker off to read on.",
        "Ohne JavaScript kann diese Seite nicht angezeigt werden.", "Um diesen Artikel zu lesen, melden Sie sich bitte an.", "Ihr Browser ist zu alt für diese Anwendung.", "Le site a besoin de cookies pour fonctionner.",
        "Sans JavaScript, cette application ne fonctionne pas.", "Vous devez vous connecter pour voir ce contenu.", "Necesita activar las cookies para entrar.", "Sin JavaScript no se puede mostrar esta página.",
        "<noscript>JavaScript is required for this form.</noscript>", "Sign in to view your messages.",
    ],
    "error": [
        "Segmentation fault (core dumped)", "Uncaught ReferenceError: jQuery is not defined", "HTTP/1.1 404 Not Found", "We can't seem to find the page you're after.", "Nothing lives at this address any more.",
        "The requested URL was not found on this server.", "Application error: a client-side exception has occurred.", "This site can't be reached", "Connection timed out after 30 seconds",
        "Internal error. Please contact the administrator.", "You don't have access to this folder.", "This video is unavailable.", "ZeroDivisionError: division by zero", "panic: runtime error: index out of range",
        "org.postgresql.util.PSQLException: connection refused", "Error establishing a database connection", "Service unavailable, please retry shortly.", "Our servers are down for upgrades. Check back later.",
        "Quota exceeded, try again tomorrow.", "Interner Serverfehler. Bitte versuchen Sie es später noch einmal.", "Leider ist ein Fehler aufgetreten.", "Cette page n'est plus disponible.",
        "Une erreur interne est survenue sur le serveur.", "No se pudo encontrar la página solicitada.", "Error interno. Vuelva a intentarlo más tarde.", "Fatal error: Allowed memory size exhausted in /var/www/app/core.php on line 88",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consetetur sadipscing elitr.", "Enter a title here", "Put the product description here.", "Sample text for the homepage.", "Placeholder: real copy to be supplied.",
        "This is dummy content used for the mock-up.", "Caption to be added.", "foo bar baz foo bar baz", "asdf asdf qwer asdf jkl", "Hier kommt der Text hin.", "Platzhaltertext, wird noch ersetzt.",
        "Ajoutez ici votre description.", "Texte provisoire à remplacer.", "Escriba aquí su contenido.", "Texto de prueba, no publicar.", "name name name name name name",
    ],
    "template": [
        "Hi {{customer}}, thanks for shopping with us.", "Welcome back, %USERNAME%!", "Dear [Your Name], we are glad to have you.", "The match between {home} and {away} was cancelled.", "Invoice <%= number %> is due.",
        "Posted on undefined by undefined", "Hello null, here is your weekly summary.", "Total: ${amount} for ${count} items", "Votre rendez-vous du {{date}} est confirmé.", "Guten Tag *|FNAME|*, Ihr Paket ist da.",
    ],
}
#: No residue, each a sentence or two.
MENTIONED = [
    "The tutorial shows how to disable JavaScript in a browser.", "Our lecture on error pages ended with a joke about the number 404.", 'She laughed when the ticket machine printed "500 Internal Server Error" and gave her a free ride.',
    "The placeholder {{title}} is replaced by the name of the book when the page is built.", "He forgot to sign in at the front desk and was sent back.", "Cookies were on the table, and the children ate all of them.",
    "The museum was unavailable to visitors for two weeks, so we went to the lake.", "Latin phrases such as ipso facto are common in law.", "The page was torn, and nobody found the missing half.",
    "In null-terminated strings the last byte has a meaning of its own.", "None of the neighbours had heard the storm.", 'The guide says that "please enable cookies" is the most frequent notice of all.',
    "The parser matches ${name} and leaves all other text alone.", "My uncle writes JavaScript for a living and hates it.", "The browser of the new phone is faster than the old one.", "They refused us access to the tower because of the wind.",
    "A template for the letter lies in the second drawer.", "The word undefined came up twice in the exam.", "We waited for the service to end before we went in.", "His request was denied by the council on Monday.",
    "Das Wort Fehler kommt im Text elfmal vor.", "Die Seite aus dem Tagebuch war zerrissen.", "La page du carnet était déchirée.", "El error del árbitro cambió el partido.", "The error was found in the third chapter, where the date is wrong.",
    "Maintenance of the bridge will take until autumn.", "The server brought the soup and forgot the bread.", "Session five of the workshop is about gardens.", 'A line that reads "text goes here" is what we filter first.',
    "She enabled the lights in the garden, and the guests applauded.", "The login of the club is painted on the door, which is not wise.", "Use %s in the format string where the word should stand.",
    "Error bars in the figure show two standard deviations.", "In the test the sample was heated and then weighed again.", "The traceback of the family tree took her three years.", "He was blocked by a truck for an hour.",
]
