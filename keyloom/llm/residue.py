"""Problem 9: template residue, filler, error pages and script notices in documents.

A document is looked at line by line, because what page production leaves behind stands in
lines of its own, while documents that speak about it do so within sentences. Entities, tags,
compatibility characters, invisible characters, letter case and spacing are resolved first;
quoted lines and code blocks are examples and are skipped.

Detectors, all of whole lines:
  * *placeholder*: unfilled placeholders of any usual shape that make up a large part of the
    words, or their printed remains (undefined, NaN, [object Object] ...);
  * *filler*: lorem ipsum, keyboard runs, one or two words over and over;
  * *script*, *error*, *filler* by concept (:mod:`keyloom.llm.pagewords`): a line that joins the
    concepts of a script notice, an error page or a note to the writer, says next to nothing
    else, and takes up no term of the title or the address;
  * *wording*: known wordings whose concepts alone do not suffice.

*Host evidence* (``hosts``): a line that shares no term with the title or the address of its
document, has no informative term (identifiers, numbers), uses two words of page production
(``_CUES``), and comes back under ``title_share`` of the documents of the hosts it is on and on
``host_share`` of all hosts is a duplicated low-information response. The first or only line has no
title; it is judged by the address alone and by the documents it comes back in. Both shares are
relative, so a document is judged alike at every size of the corpus.

Defined results: null and blank texts are no cases; repeated documents are judged alike; an
empty table gives no rows; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.pagewords import page_speech
from keyloom.llm.text import invisible, unescape
from keyloom.runtime import materialize

# -- normalisation -----------------------------------------------------------------------------
# fixed values: names of HTML elements; other names in angle brackets may be placeholders
_HTML = "a|abbr|article|aside|b|big|blockquote|body|br|button|code|dd|del|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|img|ins|kbd|label|li|link|main|mark|meta|nav|noscript|ol|p|pre|s|section|small|span|strike|strong|sub|sup|table|tbody|td|tfoot|th|thead|tr|tt|u|ul|wbr"
_BREAK = re.compile(r"<(?:br|/p|/div|/li|/h[1-6]|/tr|hr)\s*/?>", re.I)
_TAGS = re.compile(rf"</?(?:{_HTML})(?:\s[^<>]*=[^<>]*)?\s*/?>|<!--.*?-->", re.I | re.S)
_ESCAPED_TAGS = re.compile(r"</?(?:b|br|code|div|em|i|p|span|strong)\s*/?>", re.I)
_SPACE = re.compile(r"\s+")


def clean(text: str) -> str:
    if "<" in text:
        text = _TAGS.sub("", _BREAK.sub("\n", text))
    text = unescape(text)
    if "<" in text:  # escaped markup; an escaped <BODY> or <TITLE> is a placeholder
        text = _ESCAPED_TAGS.sub("", text)
    if not text.isascii():
        text = "".join(c for c in text if c.isascii() or not invisible(c))
        # guillemets delimit placeholders and have no compatibility form
        text = unicodedata.normalize("NFKC", text)
    return text


def lines(text: str) -> Iterator[str]:
    """Normalised lines outside code blocks and quotations."""
    fenced = False
    for raw in clean(text).splitlines():
        line = _SPACE.sub(" ", raw).strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if line and not fenced and not line.startswith(">"):
            yield line.lower()


# -- detectors -----------------------------------------------------------------------------------
_NAME = r"[a-z_][\w.]*(?: [\w.]+){0,2}"
_PLACEHOLDER = re.compile(
    "|".join(
        (
            rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"#\{{\s*{_NAME}\s*\}}", rf"%\(\s*{_NAME}\s*\)[sd]", r"%[a-z_][\w.]*%",
            rf"@@\s*{_NAME}\s*@@", r"__[a-z][\w.]*__", rf"<%=?\s*{_NAME}\s*%>", rf"<\?=?\s*\$?{_NAME}\s*\?>", rf"\[\[\s*{_NAME}\s*\]\]", r"«\s*[a-z_][\w.]*\s*»",
            rf"\[(?:insert|your|enter|add|put) {_NAME}(?: here)?\]", rf"<(?:insert |your )?{_NAME}(?: goes)? here>", r"<[a-z_][\w.]*>", r"\{[a-z_][\w.]*\}",
            rf"\{{%\s*{_NAME}\s*%\}}", r"\[[a-z]+(?:_[a-z]+)+\]", r"%%\s*[a-z][\w. ]*%%", r"\[(?:your|customer|company|user|product|client|recipient)(?: \w+)?\]",
        )
    )
)
_MARKS = re.compile(r"[{<\[«]|%[a-z_(]|@@|__")  # one of these begins every placeholder
_UNFILLED = re.compile(r"\[object object\]|\binvalid date\b|\b(?:undefined|null|nan|none)\b")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_S = r"(?:java ?-?script|js|(?:client[- ]side )?scripts?|(?:client[- ]side )?scripting)"
_DO = r"(?:enable|activate|allow|turn on|switch on|unblock)"
_THING = r"(?:page|site|website|app|application|thread|article|document|manual|viewer|content|file|resource|answer|post|item|link|address|url|request|service|server|topic|view|entry|record|section)"
_REASON = r"(?:not found|page not found|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|temporarily unavailable|unavailable|forbidden|unauthori[sz]ed|access denied|internal server error|internal error|server (?:fault|error)|bad request|request time-?out|request timed out|timed out|rate limit(?: reached| exceeded)?|too many requests|gone|method not allowed|not acceptable|conflict)"
_CODE = r"[45]\d\d"


def _whole(*parts: str) -> re.Pattern:
    return re.compile("(?:" + "|".join(parts) + r")[\s.!…]*")


_SCRIPT = _whole(
    rf"(?:please )?{_DO} {_S}(?: and cookies)?(?: (?:in|for) (?:your browser|this (?:site|page)))?(?: (?:to|and) [^;()\"]{{3,60}})?",
    rf"(?:in order )?to [^;()\"]{{3,60}}, (?:please )?(?:you (?:need|have) to )?{_DO} {_S}(?: (?:in|for) (?:your browser|this (?:site|page)))?",
    rf"you (?:need|have|must)(?: to)? {_DO} {_S}(?: [^;()\"]{{3,60}})?",
    rf"you have (?:{_S} (?:turned off|switched off|disabled|blocked)|(?:turned off|disabled|blocked) {_S})(?:[;,] .{{3,60}})?",
    rf"your browser (?:blocks|disables|has disabled|does not (?:support|allow)|is blocking) {_S}",
    rf"{_S} (?:is|are|must be|may be|seems? to be|appears? to be) (?:disabled|turned off|switched off|blocked|required|needed|off|enabled)(?: (?:in|by) your browser| (?:to|for) [^;()\"]{{3,60}})?",
    rf"{_S} (?:required|needed|disabled)(?: \([^()]*\)| to [^;()\"]{{3,60}})?",
    rf"this {_THING} (?:requires|needs|relies on|works only with|uses) (?:cookies and )?{_S}(?: and cookies)?(?: to [^;()\"]{{3,60}})?",
    rf"(?:sorry, )?(?:we|you) (?:can't|can’t|cannot|can not) [^;()\"]{{3,60}} without {_S}",
    rf"(?:please )?verify (?:that )?you are (?:a )?human(?: by .{{0,30}}{_S})?",
    rf"(?:loading(?:\.\.\.|…)? ?)?if nothing (?:appears|loads|happens), {_S} (?:may|might) be (?:blocked|disabled)",
    r"noscript: .{3,60}",
    r"checking your browser before .{3,40}",
    rf"your browser (?:is not supported|is too old|is outdated)(?:[,;] .{{3,60}})?",
    rf"use a newer one with {_S} turned on",
    rf"bitte (?:aktivieren|erlauben) sie {_S}.{{0,60}}",
    rf"ohne {_S} kann dieser? \w+ nicht (?:angezeigt|geladen) werden",
    rf"veuillez (?:activer|autoriser) {_S}.{{0,60}}",
    rf"cette page (?:a besoin de|nécessite|requiert) {_S}.{{0,40}}",
    rf"(?:por favor,? )?(?:active|habilite|active usted) {_S} .{{3,50}}",
    rf"esta página (?:necesita|requiere) {_S}.{{0,40}}",
)
_ERROR = _whole(
    rf"(?:https? ?(?:/\d(?:\.\d)?)?|error|status|code)[: ]*{_CODE}",
    rf"(?:(?:https? ?(?:/\d(?:\.\d)?)?|error|status|code)[: ]*)?{_CODE}[ :,.–-]*\(?{_REASON}\)?",
    r"internal server error|service unavailable|(?:bad )?gateway time-?out|bad gateway|request timed out|rate limit reached|too many requests|page not found|access denied",
    rf"(?:sorry, )?(?:we|the server) (?:could not|couldn't|cannot|can't|were unable to|are unable to) (?:load|find|open|show|display|complete|process) (?:this|the|your) (?:requested )?{_THING}(?: you asked for)?",
    rf"you (?:may not|are not allowed to|do not have (?:permission|access) to|don't have (?:permission|access) to) (?:open|view|access|see|read) this {_THING}",
    rf"the (?:requested )?{_THING} (?:you (?:asked for|requested|are looking for) )?(?:is not here|is not available|does not exist|could not be (?:located|found|loaded|completed)|was not found)(?: any more| on this server)?",
    rf"the {_THING} server took too long to (?:reply|respond|answer)",
    rf"nothing to show for this {_THING}(?: right now)?",
    rf"an unexpected (?:condition|error) (?:stopped|interrupted) the {_THING}|an unexpected error (?:has )?occurred",
    rf"this {_THING} (?:was|has been) (?:moved|removed|deleted)(?: or (?:moved|removed|deleted))?",
    rf"this {_THING} (?:does not exist|is not available|is unavailable|is no longer available|cannot be displayed)(?: any ?more| right now| at the moment)?",
    r"(?:oops[!,.]? ?)?something went wrong(?: on our (?:side|end))?",
    r"we(?:'re|’re| are) (?:currently )?down for maintenance.{0,50}|(?:the site|this site) is (?:currently )?(?:down|under(?:going)?) (?:for )?maintenance.{0,40}|(?:this (?:page|site) is )?under construction|coming soon",
    r"your session (?:has )?(?:expired|timed out)(?:[,;] .{0,50})?",
    r"your request was blocked by .{3,50}|the request could not be completed",
    r"database error: .{3,60}|error establishing a database connection",
    r"could not connect to the \w+ (?:backend|server|database).{0,40}",
    r"fatal error: .{3,80}|warning: undefined .{3,80} on line \d+|(?:parse|syntax) error: .{3,60} on line \d+",
    rf"{_CODE} ?[-–:] ?you do not have permission to .{{3,40}}",
    r"(?:die |diese )?seite (?:wurde )?nicht gefunden|ein fehler ist aufgetreten|dieses? (?:dokument|seite) ist (?:derzeit )?nicht (?:verfügbar|erreichbar)",
    r"page (?:introuvable|non trouvée)(?: ?: .{3,50})?|(?:ce document|cette page) (?:est|n'est) (?:indisponible|pas disponible|plus disponible)|une erreur (?:est survenue|s'est produite)",
    r"página no encontrada|(?:este documento|esta página) no está disponible|se (?:ha producido|produjo) un error",
)
_WRITER = r"(?:section|example|text|content|description|summary|details?|paragraph|option|title|introduction|chapter|here)"
_FILLER = _whole(
    r"(?:sample|dummy|placeholder|filler|example) (?:text|paragraph|content)(?: (?:goes|comes|stands))? here",
    r"(?:this is )?(?:a |some )?(?:dummy|sample|placeholder|filler) (?:paragraph|text|content)(?: (?:used|meant|here) to .{3,40})?",
    r"your (?:text|content|title|headline|message|description) (?:goes )?here|replace this (?:paragraph|text|content|section) with .{3,40}",
    r"(?:click|tap) here to (?:add|edit) .{3,30}",
    r"hier steht (?:ein |der )?(?:blind|beispiel|platzhalter|füll)text|(?:blind|platzhalter|füll)text",
    r"text[eo] de (?:remplissage|ejemplo|relleno|exemple)(?:, text[eo] de (?:remplissage|ejemplo|relleno|exemple))*",
    rf"(?:todo|fixme|tbd|xxx)[: ]+(?:please )?(?:write|add|fill in|describe|insert|complete|document|replace|update)(?: (?:this|the|an?|more|some))?(?: {_WRITER}){{1,3}}(?: xxx)?",
    r"(?:\[?(?:tbd|tba|todo|fixme|xxx)\]?[ ,]*)+(?:[-–:] ?replace before publishing)?|replace before publishing",
    r"\(?this (?:paragraph|page|section) (?:is )?intentionally left .{3,30}\)?",
    r"heading (?:one|two|three|\d)",
    r"(?:x{3,} ?)+",
    r"(?:[^\W\d_]+ )*blah,? (?:[^\W\d_]+,? )*blah.{0,40}",
)
_WEAK = _whole(
    r"\[?(?:retry|reload|ok|close|continue|back|home|help)\]?", r"(?:please )?(?:try|retry|check) (?:again|later).{0,40}", r"go back(?: or .{3,30})?|return to .{3,30}|back to .{3,30}|(?:please )?(?:contact|ask|inform|tell) (?:the|your|our) .{3,30}",
    r"(?:ray|reference|request id|request|incident|trace|id|code|event|vorgang)[ :#]+[\w-]+(?: abgebrochen)?", r"content-length: \d+|content-type: .*|connection: .*|date: .*|server: .*", r"loading(?:\.\.\.|…)?|please wait.*|this takes .{3,30}",
    rf"{_CODE}|{_REASON}", r"(?:allow|enable|reload|refresh|update) it.{0,40}|reload (?:the|this) page", r"slow down and .{3,30}|use a newer one.{0,40}|(?:please )?sign in again.{0,20}", r"oops|sorry|error|warning|access denied",
    r"bitte (?:prüfen|versuchen) sie .{3,40}|le lien est .{3,30}|vuelva .{3,30}|veuillez .{3,40}|page introuvable :", r"\(id \d+\)|\(timeout .{3,20}\)",
)
# a status before other text on the same line: "503 Unavailable An unexpected ..."
_STATUS = re.compile(rf"(?:(?:https? ?(?:/\d(?:\.\d)?)?|error|status|code)[: ]*{_CODE}|{_CODE})[ .:,–-]*(?:\(?(?P<reason>{_REASON})\b\)?)?[ .:,–|-]*|(?P<alone>{_REASON})[ .:,–|-]+(?=\S)")
_PIECES = re.compile(r"(?<=[.!?…])\s+| [-–|•] ")
_BULLET = re.compile(r"^(?:[-*•+]|#{1,6}|\d+[.)])\s+")

# fixed values: the words of the usual filler passage
_LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
# fixed values: neighbouring keys typed to fill a box
_KEYBOARD = frozenset("asdf asdfg asdfgh asdfghjkl qwer qwert qwerty qwertz zxcv jkl hjkl sdfg dfgh fghj".split())


def _dense(line: str, pattern: re.Pattern, least: int, share: float = 3.5) -> bool:
    """Enough matches, and few other words beside them."""
    found = pattern.findall(line)
    if len(found) < least:
        return False
    other = len(_WORDS.findall(pattern.sub(" ", line)))
    return other <= 3 if len(found) == 1 else other <= share * len(found)


def _repetitive(words: list[str]) -> bool:
    letters = [w for w in words if w.isalpha()]
    if len(letters) < 4 or len(words) - len(letters) > len(letters) // 2:
        return False
    return len(set(letters)) == 1 or sum(w in _KEYBOARD for w in letters) >= 0.8 * len(letters)


def residue_kind(line: str, context: frozenset[str] | set[str] = frozenset()) -> str | None:
    """What a normalised line is left over from, or None. ``context``: terms of the title and
    the address; a line that takes one of them up is judged by known wordings only."""
    line = _BULLET.sub("", line)
    if (_MARKS.search(line) and _dense(line, _PLACEHOLDER, 1)) or _dense(line, _UNFILLED, 2, 2.0):
        return "placeholder"
    words = _WORDS.findall(line)
    if _repetitive(words):
        return "filler"
    latin = [w for w in words if w in _LOREM]
    if len(latin) >= 0.8 * len(words) and len({w for w in latin if len(w) > 3}) >= 3:
        return "filler"
    return page_speech(line, context) or ("wording" if _known_wording(line) else None)


def is_residue(line: str) -> bool:
    """Whether a normalised line is page-production text as a whole."""
    return residue_kind(line) is not None


def _known_wording(line: str) -> bool:
    if any(p.fullmatch(line) for p in (_SCRIPT, _ERROR, _FILLER)):
        return True
    sure = False
    status = _STATUS.match(line)
    if status:
        sure = bool(status["reason"]) or " " in (status["alone"] or "")
    rest = line[status.end() :] if status else line
    for piece in _PIECES.split(rest):
        piece = piece.strip(" -–|•")
        if not piece:
            continue
        if any(p.fullmatch(piece) for p in (_SCRIPT, _ERROR, _FILLER)):
            sure = True
        elif not _WEAK.fullmatch(piece):
            return False
    return sure


# -- host evidence -----------------------------------------------------------------------------
# fixed values: stems of words that page production uses about itself
_CUES = re.compile(r"\b(?:error|fehler|erreur|unavailable|indisponible|available|verfügbar|disponible|load(?:ed|ing)?|browser|navegador|navigateur|javascript|scripts?|cookies?|enable|disabled|page|seite|página|server|request(?:ed)?|redirect(?:ed|ing)?|sign in|log in|expired|denied|blocked|maintenance|placeholder|template|publish(?:ed|ing)?|draft|replace|dummy|sample|found|refresh|reload|administrator|captcha|human|moved|removed)\b")
_INFORMATIVE = re.compile(r"\d|\w\.\w|\w_\w|[a-z]+-\d|\"|\(|=")


def low_information(line: str, context: set[str]) -> bool:
    """A line without informative terms or terms of the title and address."""
    if _INFORMATIVE.search(line):
        return False
    return not (set(_WORDS.findall(line)) & context) and len({m.group() for m in _CUES.finditer(line)}) >= 2


_STOP = frozenset("a an and the of in on to for is was about after before with not no".split())


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, host in zip(pdf["__id"], pdf["__text"], pdf["__host"], strict=True):
            if not text or not text.strip():
                continue
            all_lines = list(lines(text))
            if not all_lines:
                continue
            title, address = all_lines[0], set(_WORDS.findall((host or "").lower())) - _STOP
            context = (set(_WORDS.findall(title)) - _STOP) | address
            sign = next((r for k, x in enumerate(all_lines) if (r := residue_kind(x, context if k else address))), None)
            if sign:
                out.append((doc, sign, None, None, None))
                continue
            if low_information(title, address):  # the whole text, or no title but the response itself
                out.append((doc, None, title, f"document {doc}", host))
            for x in {y for y in all_lines[1:] if low_information(y, context)}:
                out.append((doc, None, x, hash_title(title), host))
        yield pd.DataFrame(out, columns=["__id", "sign", "line", "title", "host"])


def hash_title(title: str) -> str:
    """Titles that differ in numbers only are one."""
    return hashlib.blake2b(re.sub(r"\d+", "0", title).encode(errors="surrogatepass"), digest_size=16).hexdigest()


def residue_signs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", title_share: float = 0.002, host_share: float = 0.05, least_titles: int = 3) -> DataFrame:
    """(doc_id, sign): every residue document once, with what gave it away: ``placeholder``,
    ``filler``, ``script``, ``error`` (shape and concepts of a line), ``wording`` (a known
    wording only) or ``hosts`` (a duplicated response)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(host).alias("__host")).where(F.col("__text").isNotNull())
    scanned = materialize(src.mapInPandas(_scan, f"__id {id_type}, sign string, line string, title string, host string"), "residue")
    sure = scanned.where("sign IS NOT NULL").select("__id", "sign")
    # low-information lines: distinct (line, title, host) first, so a line on a third of all
    # pages is combined before it is counted
    loose = scanned.where("sign IS NULL").withColumn("host", F.coalesce("host", F.lit("")))
    per_host = loose.select("line", "title", "host").distinct().groupBy("line", "host").agg(F.count(F.lit(1)).alias("titles"))
    sizes = src.groupBy(F.coalesce("__host", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("docs"))
    share = per_host.join(sizes, "host").groupBy("line").agg(F.sum("titles").alias("titles"), F.count(F.lit(1)).alias("hosts"), F.sum("docs").alias("docs"))
    n_hosts = sizes.agg(F.count(F.lit(1)).alias("n_hosts"))  # one number
    enough_titles = F.col("titles") >= F.greatest(F.lit(least_titles), F.col("docs") * title_share)
    enough_hosts = F.col("hosts") >= F.greatest(F.lit(2), F.col("n_hosts") * host_share)
    common = share.crossJoin(F.broadcast(n_hosts)).where(enough_titles & enough_hosts).select("line")
    by_host = loose.join(common, "line", "left_semi").select("__id", F.lit("hosts").alias("sign"))
    return sure.unionAll(by_host).groupBy("__id").agg(F.min("sign").alias("sign")).select(F.col("__id").alias(doc_id), "sign")


def residue_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", **shares: float) -> DataFrame:
    """The ids of documents with template residue, filler, error pages or script notices."""
    return residue_signs(docs, doc_id=doc_id, text=text, host=host, **shares).select(doc_id)
