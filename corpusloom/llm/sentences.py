"""Sentences of texts in many languages and scripts.

The rules are those of the Unicode sentence-break property: terminators of all scripts (STerm, ATerm), closing marks
and blanks after them (SB9, SB10), marks and terminators that go on (SB8a, SContinue), numbers and dotted names that a
full stop does not part (SB6, SB7), and the break after all of that (SB11). They are tailored in three ways:
abbreviations of the text's own languages do not end a sentence, a passage in quotes or brackets belongs to the
sentence around it, and line breaks count by layout (headings, list items, remarks and code lines end at their line;
running text goes on over it).

The languages of a text are those whose common words it uses, by its scripts, and else the one it is said to be in.
Abbreviations are of four kinds: those that something always follows, those that only a number or a label follows
(which are often plain words too, as in "the answer is no."), those that only a name follows, and those that may
stand at a sentence's end.

``sentence_spans`` works on one text; ``split_sentences`` applies it to a column by Arrow batches. Most terminators are
plain (a word in small letters, a full stop, a blank, a capital) and are decided by that alone. A null, empty or blank
text has no sentence. Offsets are code points.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import over_cores

#: Common words, by language. Two of them in a text (one, if there are no two) show its language, and a
#: capital one opens a sentence.
COMMON = {
    "en": "the a an of and is are to in that this these it its he she they we you for with by from at on as if when then there after before each every one some or no not all thus what which who how neither both first",
    "de": "der die das und ist mit den dem des von zu im ein eine einer einem wird werden wurde bleibt nach ohne während keine keinen oder zum zur nennt sie es dies diese dieser so auf für wenn dann danach",
    "fr": "le la les et est des une dans pour du ce cette ces il elle on avec sans par sur qui que au aux ou nous puis ainsi si après avant comment",
    "es": "el los las de y en que una por con es se del al no como para esta este sin o lo su cuando si después cómo qué",
    "it": "il lo gli di che della delle nel con per una è non sono questo questa come",
    "pt": "o os as do da dos das que uma com não para em é são este esta como",
    "ru": "и в на не что с по для это как из при к от его или но так",
}
#: Abbreviations that something always follows, by language.
ALWAYS = {
    "en": "cf vs approx resp viz incl e.g i.e n.b ca al ser appl pat pats op e.g",
    "de": "lt bzw vgl evtl ggf inkl exkl sog mind vs gem insb z.b d.h u.a z.t i.d.r bspw ca",
    "fr": "env vs p.ex ex cf al ca",
    "es": "aprox vs p.ej ej al ca",
    "hi": "उदा",
    "it": "ca es",
    "pt": "aprox ex",
    "ru": "см т.е напр",
}
#: Abbreviations that a number or a label follows, by language.
BEFORE_NUMBER = {
    "en": "fig figs no nos sec secs col cols vol vols pp ch chap eq eqs ref refs rec tab art app para p s n q f v est max min temp",
    "de": "nr abb fig figs tab abs art bd ziff kap seite ref s p max min",
    "fr": "art fig figs vol chap éd éq réf tab p n no max min",
    "es": "núm num fig figs doc art arts pág págs vol cap ref n p máx mín ud uds",
    "hi": "सं पृ क्र",
    "ar": "ص رقم",
    "it": "fig pag art cap n p",
    "pt": "fig pág art núm n p",
    "ru": "рис стр п гл",
}
#: Of these, those that are words of their own too.
WORDS = "no nos art app col para max min temp est ref refs rec sec tab ud"
#: Abbreviations that a name follows, by language.
BEFORE_NAME = {
    "en": "dr mr mrs ms prof st dept messrs",
    "de": "dr prof hr fr st",
    "fr": "dr m mm mme mlle st ste av",
    "es": "sr sra srta dr dra ee tel av",
    "hi": "डॉ श्री प्रो",
    "it": "sig dott ing prof",
    "pt": "sr sra dr dra prof",
    "ru": "г ул им гг др пр д",
}
#: Abbreviations that may also stand at a sentence's end.
FINAL = "etc usw ecc ltd inc corp co bros jr sr u.s e.u u.k u.s.a ee.uu uu p.m a.m u.n ph.d b.v s.a usf ff т.д т.п"
#: Abbreviations of several parts.
SEVERAL = r"z\.\s?B|d\.\s?h|u\.\s?a|z\.\s?T|s\.\s?o|s\.\s?u|i\.\s?d\.\s?R|i\.\s?e|e\.\s?g|N\.\s?B|p\.\s?ex|p\.\s?ej|т\.\s?е|EE\.(?=\s?UU)"
#: Abbreviations of units that a unit's letter follows.
UNITS = "deg"
#: Words after which a dot or quote in text of one case goes on rather than ends.
GOES_ON = "and or but is are was were in if when after under during without at before once while for the of to by as that which said with la el les une un y et ou und oder ist sind"
#: German words before an ordinal number.
BEFORE_ORDINAL = "der die das den dem des am im vom zum zur seit bis ab jede jeder jedes jedem erste"
#: Words of several languages that a line does not end with.
BEFORE_MORE = "the a an of and or to in for with by from at as is are no each every der die das den dem des ein eine einer einem und oder mit ohne nach bei je le la les un une de du des et ou el los las una y o en del al keine weitere jeden jeder jedes jedem jede"
#: Widths, in characters, that lines of wrapped text have.
WRAPPED = range(55, 81)

_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_FINAL, _GOES_ON, _ORDINAL, _UNITS, _WORDS = (frozenset(v.split()) for v in (FINAL, GOES_ON, BEFORE_ORDINAL, UNITS, WORDS))
_SEVERAL = regex.compile(rf"(?i)\b(?:{SEVERAL})\.")
_PARTS = frozenset("ex ej ee uu".split())  # last parts of those, of two letters
_SCRIPTS = regex.compile(r"(?P<hi>\p{Devanagari})|(?P<ar>\p{Arabic})|(?P<ru>\p{Cyrillic})|(?P<en>[\p{Han}\p{Kana}\p{Hira}\p{Thai}])")
_UNIT_BEFORE = regex.compile(r"(?:\d|deg\.|%|°)\s*$")
_CASED = regex.compile(r"(\p{Ll}+)|(\p{Lu}+)")
_CAPS = regex.compile(r"\p{Lu}{2,}\W+\p{Lu}{2,}\W+\p{Lu}{2,}")
_WIDE = regex.compile(r"[。！？．｡।॥۔؟።။។]")
_THAI = regex.compile(r"\p{Thai}")
_LETTERS = regex.compile(r"[\p{L}\p{M}]*")
_ITEM = regex.compile(r"[IVXLC]+|\p{L}|\d+(?:\.\d+)*")
_LABEL = regex.compile(r"[(\[]?(?:\p{N}|\p{Lu}\p{N}|(?:[IVXLC]{2,}|[B-HJ-Z])\b)")
_ANY_LABEL = regex.compile(r"[(\[]?(?:\p{N}|\p{Lu}\p{N}|(?:[IVXLC]+|\p{Lu})\b)")
_DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}")
_SCALE = regex.compile(r"[CFKcfk]\b")
_PRIOR = regex.compile(r"(\p{L}+)\s+$")
_OPEN_END = regex.compile(r"([\p{L}\p{M}.]+)\.\s*$")
_FINAL_END = regex.compile(r"([\p{L}\p{M}.]+)\.\W*$")
_OPEN = {"(": ")", "[": "]", "（": "）", "【": "】", "［": "］", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "《": "》", "‹": "›", "〔": "〕"}
_BRACKETS = frozenset("([（【［〔")
_CLOSE = frozenset(_OPEN.values())
_MARKS = regex.compile(r"""["()\[\]（）【】［］「」『』«»“”„《》‹›〔〕]""")
_LINE = regex.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARKER = regex.compile(r"\s*(?:[-*•‣◦▪·–—]\s+|\(?\d{1,3}[.)]\s+|\d{1,3}(?:\.\d{1,3})+\.?\s+(?=\p{Lu})|\(?\p{L}\)\s+|\(?[IVXLC]{1,5}[.)]\s+|[一二三四五六七八九十]{1,3}[、．.]|[（(][一二三四五六七八九十]{1,3}[）)]|【)")
_TERM = regex.compile(r"(?:\p{Sentence_Break=STerm}|\p{Sentence_Break=ATerm}|…)+(?:\s+(?=[!?؟])[!?؟]+)?")
_STERM = regex.compile(r"\p{Sentence_Break=STerm}")
_GO_ON = regex.compile(r"[\p{Sentence_Break=SContinue}،；;]")
_BARE_TERM = regex.compile(r"[\p{L}\p{M}\p{N}.]*[\p{L}\p{M}\p{N}]")
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.]*$")
_CASELESS = regex.compile(r"[\p{Lo}]")
_DOTTED_NAME = r"\p{Ll}\.\p{Ll}\b"
_THAI_GAP = regex.compile(rf"(?<=[\p{{Thai}}])\s+(?=[\p{{Thai}}])|(?<=[\p{{Thai}}])\s+(?=\p{{Lu}}\p{{Ll}}+[ -]|\p{{Lu}} \p{{Ll}}|\p{{Ll}}\p{{Lu}}|{_DOTTED_NAME})")
_STARTER = regex.compile(r"\p{Ll}(?:\p{Lu}|\.\p{Ll}\b)")
_GLUED = regex.compile(rf"\p{{Lu}}\p{{Ll}}|\p{{Lu}} \p{{Ll}}|\p{{Ll}}\p{{Lu}}|{_DOTTED_NAME}|[\"“«¿¡]\p{{Lu}}")
_WORD_END = regex.compile(r"(?:(?<![.\p{L}\p{M}])[\p{Ll}\p{M}'’-]{2,}|[\p{L}]{3,}|[\p{N}][abc]?|\p{Lu}\.\p{Lu}|\b\p{Lu}|\p{Ll}\p{Lu}|[)\"”»])$")
_SIGNS = regex.compile(r";;|[{}∈|]|[!=<>:]=|<<|->|&\w+;|<\w+>")
_TOKEN = regex.compile(r"[!-~]{16,}|(?=.*\d)[\dA-Fa-fx]{6,}|[A-H]\d{2}[A-Z]\d+/\d+")
_SO = regex.compile(r"[\p{So}\p{Sk}\p{Cf}\uFFFD\s]+")
_ENDS = regex.compile(r"(?:\p{Sentence_Break=STerm}|\p{Sentence_Break=ATerm})\s*[\p{Pe}\p{Pf}\p{Pi}\"'”»]*[\p{So}\s\p{Cf}]*$")
_FIRST_WORD = regex.compile(r"\s*(\S+)")
_BEFORE_MORE = frozenset(BEFORE_MORE.split())
_LOWER, _UPPER = string.ascii_lowercase.encode(), string.ascii_uppercase.encode()


class _Language:
    """Abbreviations and opening words of a set of languages."""

    def __init__(self, names: frozenset[str]):
        words = lambda table: frozenset(w for n in names for w in table.get(n, "").split())
        self.always, self.number, self.name = words(ALWAYS), words(BEFORE_NUMBER), words(BEFORE_NAME)
        self.open = self.always | {w for w in self.number | self.name if len(w) > 1}
        self.opening = words(COMMON)
        self.german = "de" in names
        self.not_plain = self.open | _FINAL | _UNITS | _PARTS


_language = lru_cache(maxsize=1024)(_Language)


def languages(text: str, said: str | None = None) -> frozenset[str]:
    """Languages whose common words or script ``text`` uses; else the one it is ``said`` to be in, else English. Texts
    in scripts without capitals use English abbreviations for their Latin parts."""
    words = set(text.lower().split())
    hits = {k: len(words & v) for k, v in _COMMON.items()}
    found = {k for k, n in hits.items() if n > 1} or {k for k, n in hits.items() if n}
    if not text.isascii():
        found |= {m.lastgroup for m in _SCRIPTS.finditer(text)} if len(text) < 64 else _scripts(text)
    hint = (said or "").strip().lower()[:2]
    if hint in _COMMON and (not found or hits[hint]):
        found.add(hint)
    return frozenset(found or {"en"})


def _scripts(text: str) -> set[str]:
    """Groups of ``_SCRIPTS`` that occur, from the distinct characters."""
    return {m.lastgroup for m in _SCRIPTS.finditer("".join(set(text)))}


def _case(text: str) -> str:
    """'mixed', or 'one' if (nearly) all cased letters have the same case."""
    raw = text.encode("utf-8", "replace")
    lower, upper = len(raw) - len(raw.translate(None, _LOWER)), len(raw) - len(raw.translate(None, _UPPER))
    other = len(raw) - len(text)  # at least as many as there are other letters
    if upper and lower >= 0.05 * (upper + other):  # whatever those are
        return "mixed"
    if len(raw) != len(text):
        lower = upper = 0
        for small, large in _CASED.findall(text):
            lower, upper = lower + len(small), upper + len(large)
    if not upper and text == text.lower():
        return "one" if lower > 20 else "mixed"
    return "one" if lower + upper > 20 and lower < 0.05 * upper else "mixed"


def _is_code(x: str) -> bool:
    """Does a line look like code: signs that prose does not use, or one long token, number or symbol?"""
    if _SIGNS.search(x):
        return True
    return " " not in x and _TOKEN.fullmatch(x) is not None


def _ends(x: str) -> bool:
    """Does a line end with a terminator and what may close it?"""
    last = x[-1:]
    return not last.isalnum() and (last in ".!?。" or _ENDS.search(x) is not None)


def _regions(s: str) -> list[tuple[int, int]]:
    """(opening, closing) of quoted and bracketed passages that close in ``s``, outermost first."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in _MARKS.finditer(s):
        i, c = m.start(), m.group()
        if c == '"':
            k = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == '"'), None)
            before = s[i - 1] if i else " "
            opens = before.isspace() or before in _OPEN or not before.isalnum() and before not in ".!?,;:…)»”"
            if k is not None and not (opens and i + 1 < len(s) and s[i + 1].isalnum() and before.isspace()):
                out.append((stack[k][1], i))
                del stack[k:]
            elif opens:
                stack = [x for x in stack if x[0] != '"']
                stack.append(('"', i))
        elif c == "“" and any(o == "„" for o, _ in stack):
            k = max(n for n, (o, _) in enumerate(stack) if o == "„")
            out.append((stack[k][1], i))
            del stack[k:]
        elif c in _OPEN:
            stack.append((c, i))
        elif c in _CLOSE:
            k = next((n for n in range(len(stack) - 1, -1, -1) if _OPEN.get(stack[n][0]) == c), None)
            if k is not None:
                out.append((stack[k][1], i))
                del stack[k:]
    return sorted(out)


def _ends_open(s: str, lang: _Language) -> bool:
    """True if the line ends with an abbreviation that wants something after it."""
    t = s.rstrip()
    if t[-1:] != ".":
        return False
    m = _OPEN_END.search(t[t.rfind(" ") + 1 :])
    return bool(m) and (m.group(1).lower() in lang.open or len(m.group(1)) == 1 and m.group(1).islower())


def _ends_final(s: str) -> bool:
    """True if the line ends with an abbreviation that may stand at a sentence's end, or inside a quote."""
    m = _FINAL_END.search(s)
    return s.rstrip()[-1:] in "\"”»“’)" or bool(m) and (m.group(1).lower() in _FINAL or "." in m.group(1))


def _blocks(text: str, section: str, lang: _Language, mono: bool) -> Iterator[tuple[int, int, bool]]:
    """(start, end, remark style) of runs of text that no hard line break divides."""
    if not _LINE.search(text):
        remark = section == "note" or (not mono and text.lstrip()[0].islower() and not _MARKER.match(text) and not _STARTER.match(text.lstrip()) and section not in ("abstract", "claims", "description"))
        yield 0, len(text), remark
        return
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    each = section in ("codes", "note", "title")
    start = end = None
    remark = numbered = loose = False
    # width of the paragraph that each line belongs to
    widths, n = [0] * len(lines), 0
    while n < len(lines):
        m, w = n, 0
        while m < len(lines) and text[lines[m][0] : lines[m][1]].strip():
            w = max(w, len(text[lines[m][0] : lines[m][1]].rstrip()))
            m += 1
        if mono:  # no capitals to go by: only a paragraph that looks wrapped throughout is running text
            rows = [text[a:b] for a, b in lines[n:m]]
            filled = all(len(x.rstrip()) + 1 + len(_FIRST_WORD.match(y).group(1)) > w for x, y in zip(rows, rows[1:]))
            w = w if filled and w in WRAPPED else 10**6
        widths[n:m] = [w] * (m - n)
        n = max(m, n + 1)
    filled_lines = [len(text[lines[n][0] : lines[n][1]].rstrip()) for n in range(len(lines) - 1) if text[lines[n + 1][0] : lines[n + 1][1]].strip()]
    if not mono and filled_lines and max(filled_lines) in WRAPPED:  # one width for the whole text
        widths = [max(filled_lines)] * len(lines)
    prev, reach = "", 0
    for k, (a, b) in enumerate(lines):
        line = text[a:b]
        bare = line.strip()
        if not bare:
            if start is not None:
                yield start, end, remark
            start, reach = None, 0
            continue
        if start is not None:
            if each or _hard(prev, line, bare, widths[k], reach, remark or loose, numbered, mono, lang):
                yield start, end, remark
                start = None
            else:  # a line that begins small after a finished one is a remark of its own
                loose = not mono and bare[0].islower() and not _STARTER.match(bare) and _ends(prev.strip()) and not _ends_open(prev, lang) and not _ends_final(prev)
        if start is None:
            start, loose = a, False
            marker = _MARKER.match(line)
            numbered = bool(marker) and any(c.isdigit() for c in marker.group())
            head = bare[0]
            remark = section == "note" or (not mono and not marker and head.islower() and not _STARTER.match(bare) and section not in ("abstract", "claims", "description"))
        end = b
        own = len(line.rstrip())
        reach = reach + 1 + own if prev and _ends(prev.rstrip()) and start != a and reach + 1 + own <= widths[k] else own
        prev = line
    if start is not None:
        yield start, end, remark


def _last_word(s: str) -> str:
    """The letters that ``s`` ends with, in small letters."""
    k = len(s)
    while k and s[k - 1].isalpha():
        k -= 1
    return s[k:].lower()


def _hard(prev: str, line: str, bare: str, width: int, reach: int, remark: bool, numbered: bool, mono: bool, lang: _Language) -> bool:
    """Does the line break between two filled lines end a unit? ``reach``: length of the line before, together with
    the finished line before it if both fit into one (a break was put between two sentences of one line)."""
    a = prev.strip()
    open_ = _ends_open(a, lang)
    word = _FIRST_WORD.match(line).group(1)
    room = max(len(prev.rstrip()), reach)
    full = room + 1 + len(word) > width and room >= 45
    running = not mono and any(m.end() < len(a) and a[m.end()].isspace() and m.end() > 12 for m in _TERM.finditer(a))
    mark = _MARKER.match(line)
    if mark and not open_ and not (any(c.isdigit() for c in mark.group()) and (full or running) and not _ends(a) and a[-1] not in ",;:" and not _MARKER.match(prev)):
        return True
    if bare[0] in ":;,.!?)»”%…、。，；：！？）」":
        return False
    if _is_code(a) and not _ends(a) or _is_code(bare) and not _ends(bare):
        return True
    if remark:
        return True
    if _ends(a) or open_ or a[-1] in ",;:-–（(«「" or _last_word(a) in _BEFORE_MORE:
        return False  # what the punctuation says will hold
    indent = len(line) - len(line.lstrip()) >= 2
    if numbered and indent:
        return False
    first = bare[0]
    if first.islower() and not mono:
        return _STARTER.match(bare) is not None and not (full or running)
    if _MARKER.match(prev):
        return True
    if first.isdigit() and len(a) >= 45 or len(a) >= 60 and not _CASELESS.match(first):
        return False
    if _CASELESS.match(first):
        return not (running or (full and room >= 0.6 * width))
    return not (full or running)


def _abbreviation(low: str, s: str, k: int, look: str, word: str, mono: bool, lang: _Language) -> bool:
    """Is ``low`` with its full stop an abbreviation that what follows at ``k`` belongs to?"""
    if low in lang.always:
        return True
    if low in lang.name:
        return not look.isdigit() or low in lang.number
    more = word in lang.open and s[k + len(word) : k + len(word) + 1] == "."  # as in "Rec. No. 3"
    return low in lang.number and (more or (_LABEL if low in _WORDS else _ANY_LABEL).match(s, k) is not None or look.islower() and not mono)


def _decide(s: str, run: regex.Match, regions: list[tuple[int, int]], sent: int, mono: bool, remark: bool, lang: _Language, caps: bool) -> int | None:
    """End of the sentence if the terminators of ``run`` end one, else None. ``sent``: its start in ``s``."""
    i, e = run.span()
    mark = run.group()
    if not mono:
        near = s[max(sent, i - 50) : i + 50]
        mono = (caps or near == near.lower()) and _case(near) == "one"
    sterm = mark in "!?" or mark != "." and _STERM.search(mark) is not None
    inside = [r for r in regions if r[0] < i <= r[1]]
    closed, at_start, bracket = False, False, False
    if not inside and e < len(s) and s[e] in "\"'”’»":  # a closing mark without its opening
        e += 1
    for o, c in sorted(inside, key=lambda r: r[1]):
        if s[e:c].strip():
            return None
        e, closed = c + 1, True
        bracket, at_start = s[o] in _BRACKETS, not s[sent:o].strip()
        more = _TERM.match(s, e)
        if more:
            e, closed = more.end(), False
            sterm = sterm or _STERM.search(more.group()) is not None
    while e < len(s) and s[e] in ")]）】" and not inside:  # SB9
        e += 1
    k = e
    while k < len(s) and s[k].isspace():  # SB10
        k += 1
    if k >= len(s):
        return e
    nxt = s[k]
    if not nxt.isalnum() and (k > e or sterm):
        symbols = _SO.match(s, k)
        if symbols and symbols.group().strip():
            e = symbols.start() + len(symbols.group().rstrip())
            k = symbols.end()
            if k >= len(s):
                return e
            nxt = s[k]
    gap = k > e
    caseless = not nxt.isascii() and _CASELESS.match(nxt) is not None
    if not nxt.isalnum() and _GO_ON.match(nxt) and not (nxt in "-–—" and gap):  # SB8a
        return None
    wide = _WIDE.search(mark) is not None
    if not gap and not wide and not caseless and not (nxt in _OPEN and sterm) and not (_GLUED.match(s, k) and (sterm or closed or _WORD_END.search(s[max(0, i - 24) : i]))):
        return None  # SB6, SB7
    if not gap and nxt.isdigit() and "．" in mark:
        return None
    opener = nxt in _OPEN or nxt in "\"'¿¡‘"
    look = next((c for c in s[k : k + 6] if c.isalnum()), nxt)
    word = _LETTERS.match(s, k).group().lower()
    if closed:
        if caseless or _CASELESS.match(look):
            return e if bracket and at_start else None
        if mono:
            return None if word in _GOES_ON else e
        return e if look.isupper() or look.isdigit() and bracket or _STARTER.match(s, k) else None
    if "…" in mark or set(mark) == {"."} and len(mark) > 1:
        if caseless:
            return None
        if mono or look.islower() and remark:
            return None if "…" in mark or word in _GOES_ON else e
        return e if look.isupper() or opener else None
    if sterm:
        return e
    token = _WORD_BEFORE.search(s, max(sent, i - 40), i).group().lstrip(".")
    low = (token if token.isascii() else unicodedata.normalize("NFC", token)).lower().rstrip(".")
    if not token:
        return e
    if sent + len(s[sent:i]) - len(s[sent:i].lstrip()) >= i - len(token) and (token.isdigit() or _ITEM.fullmatch(token)):
        return None  # the number or letter that begins an item
    if low in _UNITS:
        return None if mono or _SCALE.match(s, k) else e
    if low in _FINAL or "." in low and low not in lang.open and _DOTTED.fullmatch(low):
        if mono:
            return None if word in _GOES_ON else e
        return e if look.isupper() or look.isdigit() or caseless or opener or _STARTER.match(s, k) else None
    if any(m.start() < i < m.end() for m in _SEVERAL.finditer(s, max(0, i - 10), min(len(s), i + 8))):
        return None
    if _abbreviation(low, s, k, look, word, mono, lang) and not (len(token) == 1 and token.isupper() and not look.isdigit()):
        return None
    if len(token) == 1 and token.isalpha() and not caseless:
        if token.isupper():  # an initial, unless a unit or a word that opens a sentence speaks against it
            return e if _UNIT_BEFORE.search(s[max(0, i - 8) : i - 1]) or not mono and look.isupper() and word in lang.opening and len(word) > 1 else None
        return e if look.isupper() or mono and word not in _GOES_ON else None
    if lang.german and token.isdigit() and len(token) <= 2:
        prior = _PRIOR.search(s[max(0, i - len(token) - 24) : i - len(token)])
        if prior and prior.group(1).lower() in _ORDINAL:
            return None
    return e


def _plain(s: str, at: int, end: int, start: int, lang: _Language) -> bool | None:
    """Is the terminator a plain end: a word in small letters that is no abbreviation, one mark, blank, a capital; or
    a wide mark before a letter? True: it ends. False: it is inside a number. None: it takes a closer look."""
    if end == len(s):
        return True
    mark, c = s[at:end], s[end]
    if c != " ":
        if mark == ".":
            if c.islower():  # a dotted name, unless a sentence is glued on
                return None if s[end + 1 : end + 2].isupper() or s[end + 1 : end + 2] == "." and s[end + 2 : end + 3].islower() else False
            return False if c.isdigit() and c.isascii() else None
        return True if mark in "。！？।" and len(mark) == 1 and c.isalnum() else None
    k, n = end + 1, len(s)
    while k < n and s[k] == " ":
        k += 1
    if k == n:
        return None
    nxt = s[k]
    if mark == "?" or mark == "!":
        return True if nxt.isupper() else None
    if mark != ".":
        return None
    if s[at - 1 : at] in _CLOSED_BEFORE:
        return True if nxt.isupper() else None
    begin = max(s.rfind(" ", start, at), s.rfind("\n", start, at), start - 1) + 1
    word = s[begin:at].lstrip("([")
    if (word.isdigit() or len(word) == 1 and word.isalpha()) and (begin == start or s[start:begin].isspace()):
        return False  # the number or letter that begins an item
    low = word.lower()
    if low in lang.always and len(word) > 1:
        return False
    if low in _FINAL and word[0].isupper() and s[k : k + 2].islower() and s[k + 1 : k + 2].isalpha():
        return False
    if low in lang.number and (nxt.isdigit() and nxt.isascii() or nxt.islower()):
        return False if len(word) > 1 else None
    if not nxt.isupper() or len(word) < 2 or low in lang.not_plain or not word.isalnum():
        return None
    if word[-2:].islower() and word.isalpha():
        return True
    if lang.german and word.isdigit() or s[start:begin].isspace() or begin == start:
        return None  # an ordinal, or the number or letter that begins an item
    return True


#: Marks that leave no word before a terminator.
_CLOSED_BEFORE = frozenset(")]%°")


def _split(s: str, mono: bool, remark: bool, lang: _Language) -> Iterator[tuple[int, int]]:
    """Sentence spans of one block."""
    regions = _regions(s)
    caps = not mono and _CAPS.search(s) is not None
    gaps = [m for m in _THAI_GAP.finditer(s) if not any(o < m.start() < c for o, c in regions)] if not s.isascii() and _THAI.search(s) else []
    ends = list(_TERM.finditer(s))
    if gaps:
        ends = sorted(ends + gaps, key=lambda m: (m.start(), m.group().isspace()))
    easy = not mono and not caps
    start = 0
    for m in ends:
        at, end = m.span()
        if at < start:
            continue
        inner = min((c for o, c in regions if o < at <= c), default=None) if regions else None
        plain = None
        if inner is not None:
            plain = False if s[end:inner].strip() else None  # more of the passage follows
        elif easy:
            plain = _plain(s, at, end, start, lang)
        if plain is not None:
            e: int | None = end if plain else None
        elif gaps and m.group().isspace():
            e = at
        else:
            e = _decide(s, m, regions, start, mono, remark, lang, caps)
        if e is not None and e > start:
            yield start, e
            start = e
    if start < len(s):
        yield start, len(s)


def sentence_spans(text: str | None, lang: str | None = None, section: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points, end exclusive, without blanks at either end. ``lang`` and
    ``section`` are hints that may be missing or wrong."""
    if not text or not text.strip():
        return []
    section = (section or "").strip().lower()
    own = _language(languages(text, lang))
    mono = _case(text) == "one"
    out: list[tuple[int, int]] = []
    for a, b, remark in _blocks(text, section, own, mono):
        block, first = text[a:b], True
        whole = section == "codes" or _is_code(block) and not _ends(block.rstrip())
        for i, j in [(0, len(block))] if whole else _split(block, mono, remark, own):
            piece = block[i:j]
            i += len(piece) - len(piece.lstrip())
            j -= len(piece) - len(piece.rstrip())
            if i >= j:
                continue
            if not first and not block[i].isalnum() and out and not any(map(str.isalnum, block[i:j])):
                out[-1] = (out[-1][0], a + j)  # marks only: they close the sentence before
            else:
                out.append((a + i, a + j))
            first = False
    return out


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", section_col: str = "section") -> DataFrame:
    """(id, start_pos, end_pos) of every sentence of every row; hint columns that are missing count as null."""
    hint = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    x = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), hint(lang_col).alias("lang"), hint(section_col).alias("section"))
    return over_cores(x, "_id").mapInArrow(_spans, f"_id {x.schema['_id'].dataType.simpleString()}, start_pos long, end_pos long").withColumnRenamed("_id", id_col)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sentence_spans(*row) for row in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = np.fromiter((x for f in found for span in f for x in span), dtype=np.int64, count=2 * len(owner)).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["_id", "start_pos", "end_pos"])
