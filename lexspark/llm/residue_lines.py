"""What a single line or title tells about templates left unfilled, filler and failures.

Only what holds for any site stands here: the notations of template languages, the words servers and browsers use by
their standards, and the general form of a slot in a notation not known. What a site's own templates and notices look
like is learned from the table (``pages.residue_of``), not listed.
"""

from __future__ import annotations

import re
from collections.abc import Set

#: A slot of a template, in the notations of the common template languages.
SLOT = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[#$%]\{[^{}]*\}|\{[A-Za-z_][\w.\- ]*\}|%\([\w.]+\)[sd]|%%[\w.\- ]+%%|%[A-Z][A-Z_.]+%"
    r"|__[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*__|\[\[[\w.\- ]+\]\]|<<[\w.\- ]+>>|@@[\w.\- ]+@@|\$[A-Za-z][\w.]*\$|<!--.*?-->|\[\s*(?:insert|your)\b[^\]]*\]|\[(?:title|name|date|company|headline|summary|page title|content|text|image|logo)\]",
    re.I,
)
#: Something that may be a slot in another notation: a word held by signs, a variable's name, a gap, or nothing between two marks.
ODD = re.compile(
    r"(?<![\w])[^\w\s,.;:!?'’\"“”()\-–—/&|·•»©*+]+(?:(?<=[{\[<%$@~^])|(?=\S))[\w. ]{1,30}(?:(?=[}\]>%$@~^])|(?<=\S))[^\w\s,.;:!?'’\"“”()\-–—/&|·•»©*+]+(?!\w)|(?<!\S)\$[A-Za-z]\w*|_{3,}|\.{4,}|(?<=,) ,|(?<=\w) (?=[,!?](?:\s|$))|\b[A-Z]{2,}_[A-Z_]+\b|\b[a-z]+(?:_[a-z]+)+\b|\bundefined\b|\bnull\b|\bNaN\b"
    r"|\b[Yy]our (?:(?:[Ff]irst|[Ll]ast|[Ff]ull|[Cc]ompany) )?[Nn]ame\b"
)
#: Without this (in the dialect of Arrow) a line matches neither ``SLOT`` nor ``ODD``.
SIGN = r"[^\p{L}\p{N}\s,.;:!?'’\"“”()\-–—/&|·•»©*+]|_|\.{4,}|\s[,!?](?:\s|$)|undefined|null|NaN|[Yy]our (?:\w+ )?[Nn]ame"
QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|(?<!\w)'[^']*'(?!\w)|«[^»]*»")
QUOTES = "`\"“„'«"
CODE = re.compile(r"^\s*(?:render|print|echo|return|run|def|for|if|\$\s|>>>|let|var|const)\b|[;{]\s*$|^\s*[\w.]+\(.*\)\s*;?\s*$")

#: What stands for text to come in the layouts of many systems.
FILLER = re.compile(r"\blorem ipsum\b|^(?:your text (?:goes )?here|placeholder text|this is a placeholder|dummy text|sample text|(?:text|content) coming soon|coming soon|under construction|todo\b|tbd\b)", re.I)
SCRIPTS = re.compile(
    r"\b(?:enable|activate|turn on|switch on|allow) (?:java ?scripts?|scripts)\b|\bjava ?script (?:is|has been|must be) (?:disabled|required|turned off|needed|off|blocked|enabled)|\bscripts are (?:disabled|off|blocked|turned off|switched off)"
    r"|\b(?:requires?|needs?|without|blocks?) (?:java ?script|scripts)\b|aktivieren sie (?:java ?script|skripte)|activez (?:java ?script|les scripts)|(?:active|habilite|activa) (?:java ?script|los scripts)",
    re.I,
)
#: Reason phrases of the HTTP standard, status lines, and the marks of error pages and dumps.
FAILURE = re.compile(
    r"^\W*(?:(?:http |status |error |fehler |erreur )*(?:code )?[45]\d\d\b\W{1,3}.{0,100}$|(?:http |status )+[45]\d\d\b|error(?: code)?\W? ?\d+|(?:page|file) not found\b|not found\W*$|internal server error\b|service (?:temporarily )?unavailable\b|bad gateway\b|gateway time-?out|bad request\W*$|access denied\b|forbidden\W*$"
    r"|too many requests\b|fatal(?: error)?: \w|warning: \w+\(|traceback \(|uncaught \w+|unhandled exception|null reference\b|segmentation fault|stack trace\b|(?:database )?connection (?:timed out|refused|failed|lost)\b|maintenance mode\W*$|request (?:timed out|blocked)\b|(?:die )?seite (?:wurde )?nicht gefunden|página no encontrada|page (?:non trouvée|introuvable))"
    r"|\(http \d{3}\)\W*$",
    re.I,
)
TITLE_FAILURE = re.compile(
    r"^\W*(?:(?:http |server |internal server |application |database |fatal )?error(?: (?:code )?\W?\d{3}\W?| page)?|(?:page |file |seite )?(?:not|nicht) (?:found|available|gefunden)|[45]\d\d(?:\W.{0,40})?|server error \W?\d+\W?|(?:service |temporarily )?unavailable|access denied|forbidden|(?:new|untitled|blank|sample|test) (?:page|document)(?: \d+)?|untitled|no title|title|insert title|(?:(?:insert|add|enter|type|your|the|a|my|site|page|post|blog|document|article) )*(?:title|headline|heading|name) (?:goes )?here"
    r"|página no encontrada|page introuvable|fehler|erreur|bad gateway|internal server error|(?:please )?enable javascript|just a moment\W*|under construction|coming soon|maintenance)\W*$",
    re.I,
)
#: What a slot of a line holds: nothing varies, values as a rule (names, numbers), something that may be a slot, a known notation.
FIXED, FILLED, UNFILLED, KNOWN = range(4)
MASK = "\x01"


def bare(line: str) -> str:
    """The line without what it quotes; empty for a line of code."""
    if CODE.search(line):
        return ""
    return QUOTED.sub(" ", line) if any(q in line for q in QUOTES) else line


def mask(line: str) -> tuple[str, int, str]:
    """The line with its slots masked, ``KNOWN``, ``UNFILLED`` or ``FIXED``, and what the slots hold. Quoted slots are none."""
    own = line if line.startswith(("<!--", "{%", "{{", "<%")) else bare(line)
    held: list[str] = []

    def put(m: re.Match) -> str:
        held.append(m[0])
        return " " + MASK if m[0] == " " else MASK

    masked, known = SLOT.subn(put, own)
    masked, odd = ODD.subn(put, masked)
    if not held:
        return line, FIXED, ""
    return masked, KNOWN if known else UNFILLED, "\t".join(held)


def kind(line: str) -> str | None:
    """``slot``, ``filler``, ``scripts``, ``failure`` or None, of one line."""
    text = " ".join(line.split())
    if not text:
        return None
    own = text if text.startswith(("<!--", "{%", "{{", "<%")) else bare(text)
    for name, pattern in (("slot", SLOT), ("filler", FILLER), ("scripts", SCRIPTS), ("failure", FAILURE)):
        if pattern.search(own):
            return name
    return None


def title_head(title: str | None, names: Set[str] = frozenset()) -> str:
    """The title without what it quotes and without the site's name, which stands before or after a bar.

    ``names`` are the labels of the host; without any of them in a part, the first part is the head.
    """
    own = QUOTED.sub(" ", re.sub(r"\s+", " ", title or "").strip())
    parts = [p.strip() for p in re.split(r"\s[|–—-]\s", own) if p.strip()]
    rest = [p for p in parts if len(p.split()) > 3 or not any(s in re.sub(r"[\W_]+", "", p.lower()) for s in names)]
    return (rest or parts or [""])[0]


def title_kind(title: str | None, head: str) -> tuple[str | None, bool]:
    """The same of a title, which has to be one as a whole; and whether it is doubtful, for a page may be about such words."""
    if not title or not title.strip():
        return None, False
    if SLOT.search(QUOTED.sub(" ", title)):
        return "slot", False
    if TITLE_FAILURE.match(head):
        return "failure", False
    if ODD.search(head) and not re.search(r"\w", ODD.sub(" ", head)):
        return "slot", True
    return ("filler", True) if FILLER.search(head) else (None, False)
