"""Sentences of texts in many languages and scripts.

A pushdown automaton: it jumps from one telling character to the next (terminators, quotation marks, brackets, list labels, line
breaks, Thai white space), with the open quotations, brackets and list levels of a paragraph on its stack. Inside quotations and
brackets nothing ends, however deep they lie; a new list item closes what the one before left open. Outside a terminator ends a
sentence unless it belongs to an abbreviation, a number, an address or a list label, or the clause goes on. Abbreviations are looked
up in a trie that is read backwards from the dot, and judged by the paragraph's language and by the word that follows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values. Terminators that always end, and those that may.
FULL = "。！？｡!?।॥؟۔።፧၊။។៕‼⁇⁈⁉﹗﹖︒"
DOTS = ".．"
OPENERS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“", "«": "»", "‹": "›", "‚": "‘", "｢": "｣", "〝": "〟"}
CLOSERS = frozenset(OPENERS.values()) | {"”", "’", '"', "'", "›"}
STRAIGHT = "\"'"
#: What closes each sign on the stack; a straight quote closes itself.
PARTNERS = OPENERS | {sign: sign for sign in STRAIGHT}
#: Fixed values. Abbreviations without their dot, by language: titles and connecting words, behind which no sentence ends, and the others.
NEVER = """
mr mrs ms messrs dr prof st rev hon gen capt lt sgt vs cf ca approx viz i.e e.g n.b
hrsg vgl bzw evtl ggf inkl exkl zzgl sog z d u o h ing dipl verf übers
m mm mme mmes mlle mlles éd trad env réf
sra srta ud uds
डॉ श्री श्रीमती प्रो पं कु सु रु स्व ई सं
""".split()
ABBREVIATIONS = {
    "en": "sr col vol vols p pp no nos fig figs ed eds chap ch sec art ibid op cit jan feb mar apr jun jul aug sep sept oct nov dec dept univ inc ltd corp".split(),
    "de": "nr bd bde s abb kap b a ä v chr jh str tab anm aufl geb gest art p pp vol no fig jan feb mar apr jun jul aug sep sept oct nov dec".split(),
    "fr": "ex t fol fo f av apr art al coll col auj boul vol vols p pp no nos fig figs chap ch éd".split(),
    "es": "pág págs núm art vol".split(),
}
#: Words that often begin a sentence and hardly ever follow an abbreviation within one, and words that tell a language.
STARTERS = frozenset("""
The This That These Those He She It We They You Then There Here But And So When While After Before If Although However His Her Its Our Their My Some Many What Why How Now Yet Still Later
Il Elle Ils Elles Nous Vous On Puis Mais Alors Ce Cette Ces Cela Ensuite Enfin Quand Si Ainsi
Er Sie Es Wir Dann Aber Und Doch Danach Dies Diese Dieser Dieses Wenn Als Auch Hier Dort Jetzt So
""".split())
TELLING = {
    "en": frozenset("the of and to is was in that it for with as on by he she we they at his her from this are were".split()),
    "de": frozenset("der die das und ist war nicht ein eine von zu den dem des im mit auf für es er sie wir auch wird sich als".split()),
    "fr": frozenset("le la les et est était un une de du des que qui dans pour il elle nous vous sur avec au aux par ce cette puis".split()),
    "es": frozenset("el los las y es era un una de del que en para con por su al como más pero".split()),
}
#: Abbreviations that may stand at a sentence's end: there an upper-case word or the paragraph's end ends it.
FINAL = "etc usw jr sr inc ltd co corp u.s u.k a.m p.m bros ff sqq v.chr n.chr ".split()
MONTHS = """januar jänner februar feber märz april mai juni juli august september oktober november dezember
jan feb mrz apr jun jul aug sep sept okt nov dez januars jahrhundert jahrhunderts jh kapitel auflage band buch teil""".split()
#: Words a clause goes on with behind a closing sign in Japanese; behind those of the second line only if no kana follows.
PARTICLES = ("という", "といっ", "とい", "って", "と", "など", "の", "は", "が", "を", "に", "も", "へ", "や", "から", "まで", "より", "で", "だ", "か")
CONJUNCTIONS = ("ところ", "ときに", "とはいえ", "とにかく", "とうとう", "はじめ", "はい", "はたして", "のち", "もし", "もちろん", "もっと", "もう", "もはや", "でも", "では", "ですから", "だから", "だが", "だけど", "だって", "がんば", "やがて", "やはり", "やっと", "にわか", "からだ", "から", "かれ", "かつて", "かく")
GO_ON = frozenset(",，、;；:：)）]］】〕」』”»》〉・…‥—–-")
_LABEL = re.compile(r"(?:\d{1,3}|[A-Za-z]|[ivxlIVXL]{1,5})\Z")
_THAI = "฀-๿"
_BLANKS = " \u00a0\u3000\t\n\r"
_EVENT = re.compile("[" + re.escape(FULL + DOTS + "".join(OPENERS) + "".join(CLOSERS)) + rf"]|(?<=[{_THAI}])[{_BLANKS}]+(?=[{_THAI}])")
_LINE = r"(?:\r\n|[\n\r\x85\u2028])"
_BLANK_LINE = re.compile(rf"{_LINE}[^\S\n\r\x85\u2028\u2029]*{_LINE}\s*|\u2029\s*")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\n\r\x85\u2028]")
#: A list label, at the beginning of a line.
_ITEM = re.compile(r"[^\S\n\r\x85\u2028\u2029]*(?:\(?(?:\d{1,3}|[A-Za-z]|[ivxl]{1,5})[.)．）]|[-*•・‣◦])[ \t\u3000]")
_THAI_DIGIT = frozenset("0123456789๐๑๒๓๔๕๖๗๘๙")


@lru_cache(maxsize=1)
def _abbreviation_trie() -> dict:
    """Reversed abbreviations; the end of one maps "" to its languages, to None if no sentence ends behind it, or to "final" if one may."""
    root: dict = {}

    def node_of(word: str) -> dict:
        node = root
        for char in reversed(word):
            node = node.setdefault(char, {})
        return node

    for language, words in ABBREVIATIONS.items():
        for word in words:
            node = node_of(word)
            node[""] = node.get("", frozenset()) | {language}
    for word in NEVER:
        node_of(word)[""] = None
    for word in FINAL:
        node_of(word)[""] = "final"
    return root


_UNKNOWN = object()


def _abbreviation(text: str, dot: int, first: int):
    """What the trie holds for the longest abbreviation before a dot, or ``_UNKNOWN``."""
    node, at, found = _abbreviation_trie(), dot - 1, _UNKNOWN
    while at >= first:
        node = node.get(text[at].lower())
        if node is None:
            return found
        if "" in node and (at == first or not (text[at - 1].isalnum() or _combining(text[at - 1]) or text[at - 1] in "'’")):
            found = node[""]
        at -= 1
    return found


@lru_cache(maxsize=64)
def _language(text: str, first: int, last: int) -> str | None:
    """The language most of a paragraph's telling words are of; None without any, or if two have as many."""
    counts = Counter(language for word in _WORD.findall(text, first, last) for language, words in TELLING.items() if word.lower() in words)
    ranked = counts.most_common(2)
    return ranked[0][0] if ranked and (len(ranked) == 1 or ranked[0][1] > ranked[1][1]) else None


def _combining(char: str) -> bool:
    return "ऀ" <= char <= "ः" or "ऺ" <= char <= "ॏ" or "̀" <= char <= "ͯ"


def _cjk(char: str) -> bool:
    return "぀" <= char <= "ヿ" or "㐀" <= char <= "鿿" or "豈" <= char <= "﫿" or char >= "\U00020000"


def _word_before(text: str, at: int, first: int) -> str:
    begin = at
    while begin > first and (text[begin - 1].isalnum() or _combining(text[begin - 1])):
        begin -= 1
    return text[begin:at]


def _next(text: str, at: int, last: int) -> int:
    """The next place that is neither white space nor the sign of a quoted line."""
    while at < last and (text[at].isspace() or (text[at] == ">" and at and text[at - 1] in "\n\r" and text[at + 1 : at + 2].isspace())):
        at += 1
    return at


def _goes_on(text: str, at: int, last: int) -> bool:
    """Whether the clause goes on behind a closing sign."""
    follow = _next(text, at, last)
    if follow >= last:
        return False
    char = text[follow]
    if char in GO_ON or char.islower():
        return True
    if text[at - 1] in ")）]］】〕}":  # a remark in brackets that stands in a clause
        return False
    if "぀" <= char <= "ゟ":
        rest = text[follow : follow + 5]
        if rest.startswith(CONJUNCTIONS) and not rest.startswith(("という", "からの", "かと")):
            return False
        return rest.startswith(PARTICLES)
    return False


def _dot_ends(text: str, at: int, begin: int, first: int, last: int, levels: Levels) -> bool:
    """Whether the dot at a place ends a sentence that began at ``begin``."""
    before, after = text[at - 1] if at > first else " ", text[at + 1] if at + 1 < last else " "
    if after.isdigit() and before.isdigit() or before in DOTS or after in DOTS:
        return False  # a number, an ellipsis
    if not (after.isspace() or after in CLOSERS or _cjk(after) or after in OPENERS or after in FULL):
        return False  # an address, a mark such as Q.34.c
    if before.isspace() and not after.isspace():
        return False
    follow = _next(text, at + 1, last)
    while follow < last and text[follow] in CLOSERS:
        follow = _next(text, follow + 1, last)
    ahead = text[follow] if follow < last else ""
    word = _word_before(text, at, first)
    if not ahead:
        return True
    known = _abbreviation(text, at, first)
    if known is None:
        return False
    if known == "final":
        return not (ahead.islower() or ahead.isdigit() or ahead in GO_ON)
    coming = _WORD.match(text, follow, last)
    starts = coming is not None and coming.group() in STARTERS
    initial = len(word) == 1 and word.isupper() and word.upper() != word.lower()
    if known is not _UNKNOWN or initial:
        if ahead.islower() or ahead.isdigit() or ahead in GO_ON:
            return False
        if at - 3 >= first and text[at - 2] in " \u00a0\u202f." and text[at - 1].isalpha() and text[at - 2 - (text[at - 2] != ".")] in DOTS:
            return False  # the later part of an abbreviation of several
        if starts:
            return True
        if initial or (own := _language(text, first, last)) is None or own in known:
            return False
    if ahead.islower() or ahead in ",，、;；":
        return False
    if 1 <= len(word) <= 3 and any("ऀ" <= c <= "ॿ" for c in word) and sum(not _combining(c) for c in word) == 1:
        return False  # an initial in Devanagari
    label = at - len(word)
    if levels.label(text, word, label, begin, first):
        return False
    if word.isdigit():
        if ahead.isdigit():
            return False
        coming = re.match(r"[^\W\d_]+", text[follow : follow + 24])
        if coming and coming.group().lower() in MONTHS:
            return False
        lead = re.search(r"([^\W\d_]+)[ \u00a0]\Z", text[max(first, label - 12) : label])
        if lead and len(word) <= 2 and lead.group(1).lower() in ("am", "im", "zum", "vom", "der", "die", "das", "dem", "den", "des"):
            return False
    return True


def _straight(text: str, at: int, first: int, last: int) -> tuple[bool, bool]:
    """Whether a straight quote may open and may close a quotation, by what stands beside it."""
    before, after = text[at - 1] if at > first else " ", text[at + 1] if at + 1 < last else " "
    dense = _cjk(before) or _cjk(after) or before in FULL
    opens = not after.isspace() and (before.isspace() or before in OPENERS or before in "—–-/:，：、" or (text[at] == '"' and dense))
    closes = not before.isspace() and (not after.isalnum() or (text[at] == '"' and dense))
    return opens and (text[at] == '"' or after.isalnum()), closes


def _matched(text: str, first: int, last: int) -> dict[int, int]:
    """Opening signs of a paragraph with a closing partner: place -> partner's place. Lone signs are not in it.

    A new list item pops what lies above its level, so a sign that one item leaves open is not closed in another.
    """
    stack: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()  # how many signs of the stack want a partner, so that only searches that end well are made
    pairs: dict[int, int] = {}
    lines = [first, *(m.end() for m in _BREAK.finditer(text, first, last))]
    items = [m.end() for line in reversed(lines) if (m := _ITEM.match(text, line, last))]
    for match in _EVENT.finditer(text, first, last):
        char = match.group()[0]
        at = match.start()
        while items and items[-1] <= at:
            items.pop()
            while stack:
                waiting[PARTNERS[stack.pop()[0]]] -= 1
        opens, closes = _straight(text, at, first, last) if char in STRAIGHT else (char in OPENERS, char in CLOSERS)
        wants = (char, "“") if char == "”" else (char,)
        if closes and any(waiting[w] for w in wants):
            while True:
                sign, place = stack.pop()
                waiting[PARTNERS[sign]] -= 1
                if PARTNERS[sign] in wants:
                    pairs[place] = at
                    break
        elif opens:
            stack.append((char, at))
            waiting[PARTNERS[char]] += 1
    return pairs


class Levels:
    """The list levels of a paragraph: the kind and the number of the last label of each, the deepest last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []

    def label(self, text: str, word: str, at: int, begin: int, first: int) -> bool:
        """Whether a word before a dot is a list label: first of a sentence or line or behind a colon, or the next of an open level."""
        if not word or not _LABEL.match(word):
            return False
        kind = "number" if word.isdigit() else "letter" if len(word) == 1 else "roman"
        number = int(word) if kind == "number" else ord(word.lower()) - 96 if kind == "letter" else len(word)
        before = at
        while before > first and text[before - 1] in " \t\u00a0\u3000":
            before -= 1
        leading = at == begin or before == first or text[before - 1] in "\n\r\x85\u2028"
        following = (kind, number - 1) in self.stack
        if not (leading or (before < at and ((text[before - 1] in ":：" and number == 1) or (following and kind == "number")))):
            return False
        if following:
            del self.stack[self.stack.index((kind, number - 1)) :]
        self.stack.append((kind, number))
        return True


def _paragraph(text: str, first: int, last: int) -> Iterator[tuple[int, int]]:
    pairs, levels = _matched(text, first, last), Levels()
    begin = _solid(text, first, last)
    position = first
    while position < last:
        match = _EVENT.search(text, position, last)
        if match is None:
            break
        at, char = match.start(), match.group()[0]
        position = match.end()
        if at in pairs:  # push: everything up to the partner belongs to one sentence
            close = pairs[at]
            stands_alone = _next(text, begin, last) >= at
            position = close + 1
            inner = close - 1
            while inner > at and text[inner].isspace():
                inner -= 1
            while inner > at and text[inner] in CLOSERS:
                inner -= 1
            ended = text[inner] in FULL or (text[inner] in DOTS and text[inner - 1 : inner] not in DOTS and (stands_alone or text[at] not in "([（［{"))
            if inner == at:
                ended = False
            if text[at] in "(（[［{【〔" and not stands_alone:
                ended = False
            while position < last and text[position] in CLOSERS and position not in pairs:
                position += 1
            if ended and position < last and text[position] in FULL + DOTS:
                continue  # the sentence's own terminator follows
            if not ended or _goes_on(text, position, last):
                continue
            end = position
        elif char in FULL or (char in DOTS and begin <= at):
            if at < begin:
                continue
            if char in DOTS and not _dot_ends(text, at, begin, first, last, levels):
                continue
            end = at + 1
            while end < last and (text[end] in FULL or (text[end] in DOTS and not text[end + 1 : end + 2].isalnum())):
                end += 1
            closed = False
            while True:
                behind = end
                while behind < last and text[behind] in " \u00a0\u202f":
                    behind += 1
                behind = behind if text[behind : behind + 1] == "»" else end
                if behind < last and (text[behind] in CLOSERS and behind not in pairs):
                    end, closed = behind + 1, True
                elif end < last and text[end] in FULL:
                    end += 1
                else:
                    break
            if char in "!?" and end < last and not closed and text[end].isascii() and text[end].isalnum():
                continue  # inside an address
            if closed and _goes_on(text, end, last):
                position = end
                continue
            if not closed and char in "!?！？" and _next(text, end, last) < last and (text[_next(text, end, last)].islower() or text[_next(text, end, last)] in ",，、;；"):
                position = end
                continue
            position = end
        elif char in _BLANKS:
            around = text[at - 1], text[match.end()]
            if around[0] in _THAI_DIGIT or around[1] in _THAI_DIGIT:
                continue
            end = at
        else:
            continue
        stop = end
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        if stop > begin:
            yield begin, stop
        begin = _solid(text, end, last)
        position = max(position, end)
    stop = last
    while stop > begin and text[stop - 1].isspace():
        stop -= 1
    if stop > begin:
        yield begin, stop


def _solid(text: str, at: int, last: int) -> int:
    while at < last and text[at].isspace():
        at += 1
    return at


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of a text in order; none for null, empty and blank texts."""
    if not text:
        return []
    spans, at = [], 0
    for gap in _BLANK_LINE.finditer(text):
        spans += _paragraph(text, at, gap.start())
        at = gap.end()
    spans += _paragraph(text, at, len(text))
    return spans


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, starts, ends = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            for a, b in sentence_spans(text):
                rows.append(row)
                starts.append(a)
                ends.append(b)
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "start_at", "end_at"])


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, start_at, end_at``: one row for every sentence, in code points of the text; texts without any have no rows.

    The sentences of a text cover all its characters but white space, in order. Repeated rows give repeated sentences.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(_split, f"id {kind}, start_at bigint, end_at bigint")
