"""Wording of filler, error pages and notices, slot marks, and which units need a look.

The lists rank what alignment finds to repeat. Every pattern needs one of a few
literals; one automaton over all of them tells for a unit which patterns can
match at all, so that most units never meet a pattern.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from functools import lru_cache
from re import _parser as sre

import regex

try:
    import ahocorasick
except ImportError:  # slower, the same results
    ahocorasick = None

_MARK_WORDS = (
    r"your|insert|enter|add|type|put|fill(?: in)?|replace|placeholder|change me|tbd|todo|"
    r"ihre?n?|einfügen|eintragen|ergänzen|ausfüllen|platzhalter|"
    r"à compléter|compléter|insérer|remplir|votre|vos|rellenar|completar|insertar|su|escriba|complete"
)
_HTML = (
    r"a|abbr|article|b|body|br|button|code|details|div|em|footer|form|h[1-6]|head|header|hr|html|i|img|input|kbd|label|"
    r"li|link|main|meta|nav|noscript|ol|option|p|pre|script|section|select|small|span|strong|style|sub|summary|sup|"
    r"table|tbody|td|th|thead|title|tr|u|ul"
)

#: Marks that only a template holds outside code.
SLOT = regex.compile(
    r"\{\{\{?[^{}\n]+\}\}\}?|\{%[^%\n]+%\}(?:\s*\{%\s*end\w*[^%\n]*%\})?|<%[=-]?[^%>\n]+%>|\$\{[^{}\n]+\}|"
    r"\$\([A-Za-z_]\w*\)|#\{[^{}\n]+\}|\{\[[^\[\]{}\n]+\]\}|\[\[[^\[\]\n]+\]\]|\*\|[^|\n]+\|\*|@@\w[\w .-]*@@|"
    r"<<[A-Za-z_][\w .-]*>>|%\([A-Za-z_]\w*\)[sdif]|(?<![\w%])%[A-Za-z_]\w*%(?![\w%])|"
    rf"\[\s*(?:{_MARK_WORDS})\b[^\[\]\n]*\](?!\()|\[[^\[\]\n]+\b(?:here|einfügen|eintragen|ergänzen|ici|aquí)\s*\](?!\()|"
    rf"<\s*(?:{_MARK_WORDS})\s[^<>\n]+>|<[^<>/\n]+\s(?:here|einfügen|eintragen|ici|aquí)\s*>|"
    r"(?<!\w)_{3,}(?:\s*\([^()\n]+\))",
    regex.IGNORECASE,
)

#: Marks that prose about code may hold as well.
WEAK_SLOT = regex.compile(
    r"(?<![\w$#{%])\{(?:\d+|[A-Za-z_]\w*)\}(?![\w}])|"
    rf"(?<![\w<`])<(?!/?(?:{_HTML})\b)(?!(?:HTML|HEAD|BODY|BR|HR|P|DIV|TABLE|TR|TD)>)[A-Za-z][A-Za-z0-9_-]{{1,40}}>(?![\w>])|"
    r"(?<![\w/.:])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?![\w/(]|\.\w)|(?<!\w)_{3,}(?!\w)"
)

_DEFAULTS = frozenset({"n/a", "null", "undefined", "none", "nil", "nan", "tba", "xxx", "default"})
_BLANK = re.compile(r"\w[ \t]{2,}[\w(]|(?<=\w)[ \t]+[.,](?:\s|$)|:\s*$")

_FILLER = re.compile(
    "|".join(
        [
            r"lorem ipsum",
            r"\b(?:text|title|lead|body|copy|description|content|summary|caption|heading|name|headline|image|quote|answer)s? (?:goes|go) here\b",
            r"\bplaceholder (?:copy|text|content|paragraph)\b|\bdummy text\b|^sample text\b|^(?:this is )?(?:only )?(?:a )?placeholder\b",
            r"\b(?:replace|edit|overwrite) this (?:paragraph|text|section|block|sentence)\b|\bwith your own words\b",
            r"\b(?:add|put|write|enter|type|insert) (?:your|some|a short|the) (?:own )?(?:content|text|overview|description|summary|words|introduction) (?:here|later)\b",
            r"^\W*(?:todo|fixme|tbd)\W+(?:add|describe|document|explain|fill|write|complete|expand|text|provide|insert|finish)\b|\bto be written\b|^\W*no text yet\b|^\W*\(?no (?:text|content) yet\)?",
            r"\b(?:details|text|content|more) (?:to follow|will (?:come|follow)(?: later)?|coming soon|to come)\b|\bcoming soon\b$",
            r"\byou can edit this (?:section|page|text) later\b|\bwill be replaced before release\b",
            r"platzhaltertext|blindtext|\bbeschreibung folgt\b|\btext folgt\b|\bhier steht (?:spater|bald)|\bhier (?:ihren|deinen) text\b|\binhalt folgt\b",
            r"\btexto de (?:ejemplo|relleno|muestra)\b|\bescriba aqui\b|\bescribe aqui\b|\bcontenido (?:pendiente|proximamente)\b|\btexto provisional\b",
            r"\bvotre (?:description|texte|titre|contenu) ici\b|\bcontenu a venir\b|\btexte (?:provisoire|a venir|de remplissage)\b|\btexte d'exemple\b|\bfaux texte\b",
            r"ダミーテキスト|差し替えてください|サンプルテキスト|ここにテキスト|準備中です",
        ]
    )
)

_STATUS = (
    r"not found|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|forbidden|unauthorized|"
    r"bad request|gone|payload too large|method not allowed|request time-?out|conflict|not acceptable|precondition failed|"
    r"unavailable for legal reasons|insufficient storage|proxy authentication required|payment required"
)
_CODE = r"(?:http\S*|error|erreur|fehler|fehlercode|status(?: code)?|codigo|code|erreur code|error code)"

_RETRY = (
    r"(?:please )?(?:try again|reload|wait a moment|go to the start page|come back|check the|ask the)\b|"
    r"(?:bitte (?:laden|versuchen)|veuillez (?:reessayer|recharger)|intentelo|vuelva a intentarlo|recargue)\b"
)

#: Wording of error, sign-in and blocked pages.
_ERROR = re.compile(
    "|".join(
        [
            rf"^\W*(?:{_CODE}:? *)?[45]\d\d\b[\s|:–—.-]*(?:{_STATUS})\b",
            rf"^\W*{_CODE}:? *[45]\d\d\b\W*(?:{_RETRY})|^\W*(?:{_CODE}:? *[45]\d\d\W*){{2,}}",
            r"^\W*\x02e\x03",
            rf"^\W*(?:{_STATUS})\W*(?:\|.*)?$|^\W*(?:{_STATUS})\b(?=\W+(?:ask|check|our|please|bitte|veuillez|intentelo|vuelva|reload|retry|try|wait|go|the server|you|we|this|request|reference|[\w-]+\.\w+ did)\b)",
            r"^\W*access (?:was |is |has been )?denied\W*$|\baccess denied\b(?=\W+(?:you|to view|please|ask|sign))|\b(?:you )?(?:do not|don't) have permission\b|\bnot (?:authori[sz]ed|allowed) to (?:view|access|see|read)\b",
            r"\byou must be (?:signed|logged) in\b|\b(?:sign|log) in (?:again )?to (?:continue|read|view|see|access)\b|\bsession (?:has )?(?:expired|timed out)\b|\bforgot (?:your )?password\b|\bplease (?:sign|log) in\b",
            r"\bpage (?:not found|you (?:asked|are looking|requested|were looking)|could not be found|does not exist|doesn't exist|has moved|cannot be displayed|can't be displayed)|\bhas moved or never existed\b|\b(?:can't|cannot|couldn't|could not) find (?:that|the|this) page\b",
            r"\baddress leads nowhere\b|\bcheck the spelling of the address\b|\bcheck the (?:url|address)\b",
            r"\bdown for (?:scheduled )?maintenance\b|\bwe(?:'ll| will) be back (?:soon|shortly)\b|\bundergoing maintenance\b",
            r"^\W*(?:oops\W+)?something went wrong\b|\bupstream (?:request )?(?:timed out|connect error)|\bno server is (?:ready|available)|\bserver could not answer\b|\bserver (?:encountered|is temporarily|did not respond)",
            r"^\W*internal error\W*$|\bquote (?:the )?reference\b.*\bhelp\b|\bour team has been (?:told|notified|informed)\b",
            r"\bno results could be loaded\b|\b(?:could not|couldn't|cannot|can't) be (?:rendered|loaded|reached|displayed)\b(?!.*\bscript)|\bdid not reply\W*$|\bpermission check failed\b",
            r"\bclient has been blocked\b|\byou have been blocked\b|\byour (?:ip|address|access|request) (?:address )?(?:has been|was|is) (?:blocked|limited|banned)|\bunusual (?:traffic|activity)\b|\btoo many requests\b|\brate limit (?:reached|exceeded)\b",
            r"\bchecking (?:that the|your|if the) (?:connection|browser|site)\b|\b(?:are|that) you(?:'re| are)? (?:human|not a robot)\b|\bcomplete the captcha\b|\bverify(?:ing)? you are human\b",
            r"\bask the owner of the \w+ for access\b|\brequest access\b$",
            r"\bseite (?:nicht gefunden|wurde nicht gefunden|existiert nicht)|\bgewunschte seite\b|\bzugriff verweigert\b|\bbitte melden sie sich an\b|\bein (?:unerwarteter )?fehler ist aufgetreten\b|\bes ist ein (?:\w+ )?fehler aufgetreten\b|\bsitzung ist abgelaufen\b|\binterner serverfehler\b|\bwartungsarbeiten\b",
            r"\bpage introuvable\b|\badresse demandee\b|\bcette page n'existe pas\b|\berreur interne\b|\bacces (?:refuse|interdit)\b|\bune erreur (?:est survenue|s'est produite|inattendue)|\bveuillez vous (?:connecter|identifier)|\bsession (?:a )?expire\b|\ben maintenance\b",
            r"\bse (?:produjo|ha producido) un error\b|\bpagina no (?:encontrada|existe|disponible)|\bno (?:se )?encontr\w+ la pagina\b|\bacceso denegado\b|\bno tiene permiso\b|\binicie sesion\b|\bsesion ha (?:caducado|expirado)\b|\berror interno del servidor\b|\ben mantenimiento\b",
            "ページが見つかりません|エラーが発生しました|アクセスが拒否|ログインしてください|メンテナンス中|セッションの有効期限",
        ]
    )
)

#: Wording that closes or accompanies such pages, too weak to tell one alone.
_ERROR_WEAK = re.compile(
    "|".join(
        [
            rf"^\W*{_CODE}:? *[45]\d\d\b",
            r"^\W*[45]\d\d\W*$",
            r"^\W*(?:oops|sorry)\b",
            rf"^\W*(?:{_RETRY})",
            r"^\W*(?:request id|reference|codigo|code d'erreur|fehlercode)\W",
            r"^\W*sign in\W*$|^\W*log ?in\W*$|^\W*password\W*$|^\W*anmelden\W*$",
            r"^\W*(?:access denied|(?:your )?session has expired|(?:the |your )?(?:request|connection|operation|gateway) timed out)\W*$",
        ]
    )
)

_SCRIPT = r"(?:java ?script|\bjs\b|scripts?\b|scripting|active content|aktive inhalte|skripte?n?\b|contenido activo)"
_NEED = (
    r"(?:enabl|activ|allow|turn(?:ed)? (?:it|them|on|off)|switch(?:ed)? o(?:n|ff)|requir|depend|\bneeds?\b|without|only with|best|block|disabl|support|erlaub|aktivier|benotig|"
    r"besoin|bloqu|sin scripts|habilit|permit|necesit|autoris|有効|必要)"
)
_PAGE = (
    r"(?:\bpage\b|\bdocument\b|\bsite\b|\bapp(?:lication)?\b|\bviewer\b|^\W*search\b|\breport\b|\bportal\b|\bview\b|\bbrowser\b|to continue|navigateur|navegador|\bansicht\b|\bseite\b|\bvista\b|\bpagina\b|ページ)"
)
_NOTICE_START = r"^\W*(?:<noscript>|notice:|hinweis:|aviso:|remarque ?:|avis ?:)"
_NOTICE = re.compile(
    rf"{_NOTICE_START}.*(?:{_SCRIPT}|{_NEED})|^(?=.*{_SCRIPT})(?=.*{_NEED})(?=.*{_PAGE})|"
    rf"^\W*(?:please |bitte |veuillez )?(?:enable|activate|allow|turn on|activer|activez|active|habilite|aktivieren sie)\b.*{_SCRIPT}|{_SCRIPT}.{{0,20}}有効|"
    rf"^\W*you need to .*{_SCRIPT}"
)
_NOSCRIPT = re.compile(r"^\W*<noscript>|\(noscript\)\W*$")

_IN_MARKUP = re.compile(rf"\b(?:{_STATUS})\b|{_CODE}:? *[45]\d\d\b|\b(?:error|fehler|erreur|denied|sign in|captcha)\b")
_NUMBER = re.compile(r"(?<!\d)(?![45]\d\d(?!\d))\d+")

#: General signs of such a page, in any wording: something failed or is missing, the
#: reader is addressed or asked to act, a status is named.
_CUES = [
    re.compile(
        r"\b(?:unable|fail(?:ed|ure|s)?|errors?|problems?|wrong|broken|denied|refused|rejected|expired|unavailable|unreachable|offline|missing|invalid|blocked|banned|"
        r"suspended|restricted|forbidden|removed|deleted|timed out|(?:can|could|do|does|did|is|are|was|were|has|have|will)(?: ?not|n't)|cannot|no longer|nothing|nowhere|maintenance|"
        r"fehler|nicht|kein\w*|gesperrt|abgelaufen|erreur|impossible|introuvable|indisponible|n'(?:a|est|existe|etait) |aucune?|fallo|no (?:se|esta|existe|hay|pudo|fue|tiene)|imposible)\b|"
        r"エラー|できません|ありません|失敗|拒否"
    ),
    re.compile(
        r"^\W*(?:please|try|retry|reload|refresh|return|go (?:back|to)|sign|log|contact|check|wait|come back|visit|search|use|ask|bitte|veuillez|intente|vuelva|recargue)\b|"
        r"\b(?:please|you|your|yourself|bitte|sie|ihre?n?|veuillez|vous|votre|vos|usted|su|intente\w*)\b|ください|お客様"
    ),
    re.compile(r"(?<!\d)[45]\d\d(?!\d)(?!\W*(?:ms|rows|edges|nodes|lines|files|s)\b)"),
    re.compile(
        r"\b(?:page|site|website|address|url|link|server|service|account|session|sign(?:ed)? in|log(?:ged)? in|login|access|permission|request|connection|browser|captcha|"
        r"seite|dienst|adresse|konto|anmeldung|zugriff|sitzung|anfrage|serveur|compte|acces|connexion|pagina|sitio|servidor|cuenta|acceso|sesion|solicitud)\b|ページ|サーバ|ログイン"
    ),
]
_PAGE_UNITS, _PAGE_CHARS = 12, 1000

_CHROME = re.compile(
    r"^\W*(?:menu|skip to content|home(?: *\| *[\w ]+)+|back to top|help(?: *· *\w+)+|(?:©|\(c\)).*|[\w ]+ ›.*|retry|go back|loading\W*|please enable it|"
    r"check your browser settings|use a newer browser|allow scripts and reload|turn off your blocker.*|turn it on and reload.*|go to the start page|"
    r"user name|password|your browser blocks them|request id \w+|reference:? \w+|error code:? *\d+|request \w+|(?:[\w-]+\.)+[a-z]{2,}(?: at [\d:.tz -]+)?|see how to enable \w+)\W*$"
)

_TOKEN = regex.compile(
    r"\x02[^\x03]*\x03|(?:Java|Type)Scripts?\b|[\w:./()<>-]*[\w)](?:[_/.:(]|::)[\w:./()<>-]*\w\)*|\w+|[^\w\s]"
)
_IDENTIFIER = regex.compile(r"(?:\w[_/:]\w|\w\.\w{1,4}\b.*/|\p{Ll}\p{Lu}|\(\)|^fn:)")
_PLAIN_NAMES = re.compile(r"^(?:Java|Type)Scripts?$")
#: Two words joined by a slash; they may be prose.
_ADDRESS = regex.compile(r"/|\w+://")  # of a page, not of code
_EITHER = regex.compile(r"\p{L}+/\p{L}+")
_NAME = "_"  # stands for a token of code where wording is judged; a word character
_FENCE = regex.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", regex.DOTALL)
_INLINE = regex.compile(r"`[^`\n]+`")
_JSON_ERROR = regex.compile(r"^[ \t]*\{\s*\"(?:error|errors|fault|status|statusCode|code|message)\"\s*:.*\}[ \t]*$", regex.MULTILINE | regex.IGNORECASE)
_QUOTED = regex.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“\n]+“|«[^»\n]+»|「[^」\n]+」")
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n|…\s")
_IGNORED = regex.compile(r"[­​-‏⁠﻿]")
_HTML_TAG = regex.compile(rf"</?(?:{_HTML})(?:\s[^<>]*)?>", regex.IGNORECASE)
_CODE_LINE = re.compile(r"\s*(?:WARN|ERROR|INFO|DEBUG|TRACE)\b|\s*(?:File \"|raise |SELECT |GET |POST |\||Traceback|\w*Error:|at \w+\()")


_ACCENTS = regex.compile(r"\p{M}+")


def fold(text: str) -> str:
    """Lower case without accents or runs of white space."""
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text)).replace("’", "'")
    return " ".join(text.casefold().split())


@lru_cache(1 << 16)
def _word(token: str) -> tuple[str, bool, bool]:
    """A token folded, whether it names code, and whether it is a value."""
    code = bool(_IDENTIFIER.search(_PLAIN_NAMES.sub("", token)))
    return fold(token), code, code or any(c.isdigit() for c in token)


def _folded(pattern: re.Pattern) -> re.Pattern:
    """Folds what a pattern for folded text says, which NFKD may have split."""
    return re.compile(_ACCENTS.sub("", unicodedata.normalize("NFKD", pattern.pattern)))


_FILLER, _ERROR, _ERROR_WEAK, _NOTICE = (_folded(p) for p in (_FILLER, _ERROR, _ERROR_WEAK, _NOTICE))
_CUES = [_folded(p) for p in _CUES]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _value(text: str) -> int:
    """A slot's value, of which only matters whether others differ."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _repeats(words: list[str]) -> bool:
    """Some words said over and over, alone or as a long run."""
    for period in range(1, len(words) // 3 + 1):
        run = period
        for i in range(period, len(words)):
            run = run + 1 if words[i] == words[i - period] else period
            if run >= max(6, 4 * period) and len(words[i]) > 1 and words[i].isalpha():
                return True
        if run == len(words) >= 3 * period and len(words[0]) > 1 and words[0].isalpha():
            return True
    return False


#: Syllables that filler Latin is spun from; a run of words made of nothing else is filler.
_LATIN = re.compile(
    r"(?:lorem|ipsum|dolor|sit|amet|con|sec|tetur|adi|pis|cing|elit|sed|do|eius|mod|tem|por|inci|di|dunt|ut|la|bore|et|magna|ali|qua|quam|enim|"
    r"minim|veni|quis|nos|trud|exer|ulla|co|labo|ris|nisi|ex|ea|com|modo|cos|sil|vi|tor|dus|rem|ur|ne|lo|ble|bus|ti|us)+"
)


@lru_cache(1 << 15)
def is_latin(word: str) -> bool:
    return _LATIN.fullmatch(word) is not None


def _latin(words: list[str]) -> bool:
    long = [w for w in words if len(w) > 1]
    return len(long) >= 5 and sum(bool(_LATIN.fullmatch(w)) for w in long) >= 0.9 * len(long) and sum(map(len, long)) >= 4 * len(long) * 0.8

# --- which patterns a unit needs ---------------------------------------------


def _literals(sequence) -> set[str] | None:
    """Literals one of which every match of a parsed pattern holds; the longest such set."""
    found: list[set[str]] = []
    run = ""
    for op, arg in [*sequence, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append({run})
            run = ""
        inner = None
        if op is sre.BRANCH:
            sets = [_literals(x) for x in arg[1]]
            inner = None if None in sets else set().union(*sets)
        elif op is sre.SUBPATTERN:
            inner = _literals(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _literals(arg[2])
        elif op is sre.ASSERT and arg[0] == 1:
            inner = _literals(arg[1])
        if inner:
            found.append(inner)
    return max(found, key=lambda x: min(len(w.strip()) for w in x), default=None)


def needed(pattern: str) -> set[str]:
    """Literals one of which every match of an alternative holds; those without any are left to chance."""
    parsed = sre.parse(pattern)  # what all alternatives begin with stands before the branch
    parts = next((arg[1] for op, arg in parsed if op is sre.BRANCH), [parsed])
    return set().union(*(x for p in parts if (x := _literals(p))))


FILLER, ERROR, WEAK, NOTICE, CHROME, DEFAULT = 1, 2, 4, 8, 16, 32
PAGE = ERROR | WEAK | NOTICE | CHROME
_NEEDS: dict[str, int] = {}
for _bit, _words in (
    (FILLER, needed(_FILLER.pattern)),
    (ERROR, needed(_ERROR.pattern) | needed(_IN_MARKUP.pattern)),
    (WEAK, needed(_ERROR_WEAK.pattern)),
    (CHROME, needed(_CHROME.pattern) - {"."}),  # a line that is a host's name only counts beside others
    (DEFAULT, {fold(w) for w in _DEFAULTS}),
    (NOTICE, needed(_SCRIPT) | needed(_NOTICE_START) | {"noscript", "有効", "必要"}),
):
    for _w in _words:
        _NEEDS[_w] = _NEEDS.get(_w, 0) | _bit
if ahocorasick:
    _AUTOMATON = ahocorasick.Automaton()
    for _w, _bit in _NEEDS.items():
        _AUTOMATON.add_word(_w, _bit)
    _AUTOMATON.make_automaton()
else:
    _ANY = {b: re.compile("|".join(re.escape(w) for w, x in _NEEDS.items() if x & b)) for b in (FILLER, ERROR, WEAK, NOTICE, CHROME, DEFAULT)}


def bits(folded: str) -> int:
    """Which groups of patterns a folded text may match."""
    out = 0
    if ahocorasick:
        for _, bit in _AUTOMATON.iter(folded):
            out |= bit
        return out
    return sum(b for b, p in _ANY.items() if p.search(folded))


# --- verdicts on a folded unit -------------------------------------------------


def _plain(folded: str) -> str:
    """Numbers alike, but for what may be a status code; units of a template then share a verdict."""
    return _NUMBER.sub("0", folded)


@lru_cache(1 << 15)
def _is_filler(folded: str) -> bool:
    words = [w.strip(".,;:!?") for w in folded.split()]
    if _FILLER.search(folded) or _latin(words):
        return True
    return len(words) > 2 and 2 * len(set(words)) <= len(words) + 2 and _repeats(words)


def _opens_as_filler(folded: str) -> bool:
    """Of a sentence that names code: one that merely mentions filler tells of it."""
    at = _FILLER.search(folded)
    return at is not None and not any(c.isalnum() or c == _NAME for c in folded[: at.start()])


@lru_cache(1 << 15)
def _wording(folded: str, markup: bool) -> int:
    if markup and _IN_MARKUP.search(folded):
        return 2
    if _NOSCRIPT.search(folded) or _ERROR.search(folded) or _NOTICE.search(folded):
        return 2
    return 1 if _ERROR_WEAK.search(folded) else 0


def may_be_page(folded: str) -> bool:
    """Whether a whole text shows three of the four signs, a failure or a status among them."""
    failed, reader, status, thing = _CUES
    seen = (thing.search(folded) is not None) + (status.search(folded) is not None)
    if not seen:
        return False  # the other two are not enough
    seen += failed.search(folded) is not None
    return seen >= 2 and seen + (reader.search(folded) is not None) >= 3


@lru_cache(1 << 15)
def _cues(folded: str) -> int:
    return sum(1 << i for i, pattern in enumerate(_CUES) if pattern.search(folded))
