"""Words of page production by concept, and the lines that are made of them.

A line left over from page production speaks about itself: about scripts, servers, pages and
the reader, and about nothing else. So it is recognised by the concepts it joins (a fault and a
page, scripts and a switch, an order to write and a place for text) and by how little else it
says, whatever its wording.
"""

from __future__ import annotations

import re

# fixed values: words by concept, in English, German, French, Spanish, Italian, Portuguese, Dutch and Russian
SCRIPT = frozenset("javascript jscript js script scripts scripting noscript cookies cookie скрипты javascripts".split())
SWITCH = frozenset("enable enables enabled enabling activate activated allow allows turn turned turning switch switched switching unblock disabled disables disable deactivated off on blocked blocks blocking required requires require needs need needed relies support supports supported supporting without permit permits accept aktivieren aktiviere aktiviert aktivierten erlauben erlaubt einschalten benötigt ohne deaktiviert ausgeschaltet abgeschaltet activer activez autoriser désactivé désactive sans besoin nécessite requiert activé active activar habilite habilitar desactivado necesita requiere sin attiva attivare abilita disabilitato richiede senza ative ativar habilite desativado requer sem inschakelen uitgeschakeld vereist включите отключен отключён отключены требуется".split())
READER = frozenset("you your yours you'll you're you've please we our us we're we'll sorry oops whoops uh oh bitte sie ihr ihrem ihren ihre du dein wir uns veuillez vous votre vos nous désolé merci usted su favor lo sentimos nosotros spiacenti tuo vostro desculpe seu u uw alstublieft пожалуйста вы ваш вашем мы browser browsers navigateur navegador browserversion браузер браузере human robot captcha visitor".split())
PAGE = frozenset("page pages site website web webpage app application screen view viewer display displayed shown show load loaded loading loads open opened render content contents document article thread resource item post topic file manual record section entry answer seite seiten webseite dokument inhalt inhalte datei anzeigen angezeigt sehen laden contenu fichier ressource afficher affichée affichée afficher página sitio contenido documento archivo recurso mostrar mostrarse ver pagina sito contenuto risorsa conteúdo recurso pagina inhoud страница страницу страницы сайт документ".split())
FAULT = frozenset("error errors fault faulty failed fails failure unavailable unreachable missing gone denied refused refuses rejected forbidden unauthorized unauthorised timeout timed expired overloaded busy maintenance moved removed deleted renamed wrong crashed broken down offline exist exists unexpected unhandled fatal interrupted stopped aborted exhausted exceeded invalid bad conflict unsupported cannot can't couldn't unable lost fehler nicht gefunden verfügbar erreichbar fehlgeschlagen wartung wartungsarbeiten abgelaufen verweigert überlastet abgebrochen erreur introuvable indisponible échec échoué refusé interdit expirée expiré rompu trouvée trouvé disponible error encontrada encontrado denegado prohibido caducado errore trovata trovato disponibile negato erro encontrada indisponível negado fout gevonden beschikbaar ошибка найдена найден недоступен недоступна запрещен запрещён истекла".split())
FOUND = frozenset("found available permission permitted allowed authorized access reached located completed processed responded respond reply responding zugriff accès acceso".split())
SERVER = frozenset("server servers gateway origin upstream proxy service backend request requests connection connect host http https url address link links database session response status code id ray reference trace incident verbindung anfrage dienst adresse serveur requête service lien enlace servidor solicitud servicio dirección servizio richiesta collegamento servidor solicitação verbinding dienst сервер запрос сервис адрес".split())
ACT = frozenset("retry try again later reload refresh contact administrator admin webmaster support back return home front homepage check wait moment minute minutes second seconds few soon shortly sign signed log login continue proceed help inform tell team owner versuchen später erneut prüfen zurück startseite neu réessayez réessayer ultérieurement plus tard retour accueil vérifiez intente nuevo más tarde vuelva inicio compruebe riprova tardi torna tente novamente mais tarde voltar probeer opnieuw terug попробуйте позже вернитесь".split())
WRITE = frozenset("insert replace add fill write enter type put edit complete provide update change describe supply goes belongs comes todo fixme tbd tba xxx einfügen ersetzen eintragen schreiben ajouter insérer remplacer écrire insertar reemplazar añadir escribir inserire sostituire inserir substituir вставьте замените".split())
BLANK = frozenset("text texts copy paragraph paragraphs heading headline title subtitle caption chapter section sentence description summary introduction intro body example sample dummy placeholder filler template boilerplate lorem ipsum draft content here blank intentionally unfinished publish publishing publication publish published own words blindtext platzhalter beispieltext fülltext mustertext überschrift texte paragraphe titre remplissage exemple texto párrafo título relleno ejemplo testo paragrafo titolo esempio segnaposto parágrafo preenchimento tekst текст заголовок заполнитель".split())
STOP = frozenset("a an and the of in on to for is are was were be been being about after before with not no it its this that these those there then if when while so as at by from into or but can could will would shall should may might must do does did don't doesn't isn't wasn't won't has have had having i he she they them their which what who some any all more most very just only also than too now right yet still up out over under again once i'm it's that's asked for looking something anything everything nothing went go goes get got use used using one two long took take takes see read view until instead der die das den dem des ein eine einen einem und oder zu um im in am auf von vom für ist sind war wird werden wurde kann können hier diese dieser dieses diesen le la les l un une des du de d et ou à au aux en dans sur pour par ce cet cette ces est sont été être a pas ne n' s' se que qui dans el los las una unos y o u del al en para por con este esta esto es son ha sido no que il lo gli uno e di da è sono non che questo questa o os as um uma do da em com este não het een van voor is niet deze и в на не для это этой этот с к".split())

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_DIGIT = re.compile(r"\d")
_STATUS = re.compile(r"[45]\d\d")
_QUOTED = re.compile(r"[\"“”„«»`=]\w|\w[\"“”`]|\w_\w|\w\.\w|\w/\w|[|<>{}]")
_REFERENCE = re.compile(r"\b(?:ray|reference|request|incident|trace|event|error|id|code|vorgang|ref)(?: id)?[ :#]+[\w-]*\d[\w-]*")


_NOT = frozenset("not no never nothing cannot can't couldn't isn't doesn't nicht kein keine pas aucun aucune sin no non nessuna não niet не нет".split())
_NAMES = ("script", "switch", "reader", "page", "fault", "found", "server", "act", "write", "blank", "not")
_OF: dict[str, tuple[str, ...]] = {}
for _name, _words in zip(_NAMES, (SCRIPT, SWITCH, READER, PAGE, FAULT, FOUND, SERVER, ACT, WRITE, BLANK, _NOT), strict=True):
    for _w in _words:
        _OF[_w] = (*_OF.get(_w, ()), _name)


def concepts(line: str, most: int | None = None) -> tuple[dict[str, int], list[str]]:
    """Words of each concept in a normalised line, and its other words. Stops after ``most``
    other words."""
    if "’" in line:
        line = line.replace("’", "'")
    if _DIGIT.search(line):
        line = _REFERENCE.sub(" ", line)
    if " script" in line:
        line = line.replace("java script", "javascript").replace("client side script", "script")
    if "client-side" in line:
        line = line.replace("client-side", " ")
    n = dict.fromkeys((*_NAMES, "status"), 0)
    other: list[str] = []
    for m in _WORD.finditer(line):
        w = m.group()
        if w in _OF:
            for name in _OF[w]:
                n[name] += 1
        elif w in STOP:
            continue
        elif _STATUS.fullmatch(w):
            n["status"] += 1
        elif not w.isdigit():
            other.append(w)
            if most is not None and len(other) > most:
                break
    return n, other


def page_speech(line: str, context: frozenset[str] | set[str] = frozenset()) -> str | None:
    """``script``, ``error`` or ``filler`` if the line speaks of page production and of nothing
    else. ``context``: terms of the title, the address and the rest of the body; a line that
    takes up one of them belongs to the content."""
    n, other = concepts(line, 3)
    if len(other) > 3:
        return None
    own = sum(n.values())
    if own < 2 or len(other) * 3 > own + 1 or _QUOTED.search(line) or any(w in context for w in other):
        return None
    fault = n["fault"] + (n["not"] if n["page"] + n["found"] else 0)
    whole = not other
    if n["script"] and n["switch"] and n["reader"] + n["page"]:
        return "script"
    if n["status"] and (fault or n["server"]):
        return "error"
    if fault and (n["page"] or n["server"]) and (whole or n["reader"]):
        return "error"
    if n["fault"] and n["act"] and (whole or n["reader"]):
        return "error"
    if n["blank"] and n["write"] + n["blank"] >= 2 and (n["write"] or n["blank"] >= 3) and n["fault"] + n["server"] + n["not"] == 0:
        return "filler"
    return None
