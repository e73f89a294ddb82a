"""One form for texts that look the same in print but are stored in different characters.

Tokens (words; single ideographs) as they are stored run through a trie of the corpus's vocabulary under a weighted edit automaton:
exchanging look-alikes and passing over invisible characters cost nothing, any other edit costs 1, and the automaton's states are all
trie nodes reached so far with their costs. A token takes the canonical spelling, the most frequent one, of those it reaches without
cost (entries are free of widths, invisible characters and the like); tokens that reach none, and all separators, are normalised by
table. Which entries are reached depends only on how a token looks, so texts that look alike come out equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.session import checkpointed

from .codepoints import decode, flatten, rows_of

#: Letters that look like a Latin one, each before the letter it looks like.
LETTERS = """
А A В B С C Е E Ѐ È Ё Ë Н H І I Ї Ï Ј J К K М M О O Р P Ѕ S Т T Х X Ү Y Ԁ D Ԍ G Ԛ Q Ԝ W Ѵ V Ӏ I З 3 Ь b
а a с c ԁ d е e ѐ è ё ë һ h і i ї ï ј j о o р p ԛ q ѕ s ѵ v ԝ w х x у y ү y г r ӏ l ґ ґ ӕ æ Ӕ Æ ӧ ö Ӧ Ö ә ə Ә Ə ӡ ʒ Ӡ Ʒ
Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X Ϲ C Ϳ J Ϻ M
α a γ y ι i κ k ν v ο o ρ p σ o τ t υ u χ x ϲ c ϳ j ɡ g ɑ a ɩ i ı i ȷ j ʏ Y ɪ i ʋ u ɯ w ɴ N ʀ R ʙ B ʜ H ʟ L ꜱ s ᴀ A ᴄ c ᴅ D ᴇ E ᴊ J ᴋ k ᴍ M ᴏ o ᴘ P ᴛ T ᴜ u ᴠ v ᴡ w ᴢ z
Հ h հ h ո n ս u օ o Օ O Տ S ց g զ q ա w լ l ք p Ս U Լ L ղ n ճ d յ j Ꭺ A Ᏼ B Ꮯ C Ꭰ D Ꭼ E Ꮐ G Ꮋ H Ꭵ i Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z
ⅽ c ⅾ d ⅼ l ⅿ m ℓ l ℴ o ℯ e ℊ g ℎ h Ⅰ I Ⅴ V Ⅹ X Ⅼ L Ⅽ C Ⅾ D Ⅿ M ⅰ i ⅴ v ⅹ x
""".split()
#: Kana, strokes and dashes that look like an ideograph or like another kana, each before it.
STROKES = """
ニ 二 ハ 八 カ 力 タ 夕 ト 卜 ロ 口 エ 工 メ 乂 ノ 丿 ー 一 — 一 ― 一 ─ 一 ㅡ 一 ᅳ 一 ㄧ 一 ㆒ 一 ㇐ 一 へ へ ヘ へ ベ べ ペ ぺ 囗 口 ㆓ 二 ㆔ 三 ㆕ 四 ㇑ 丨 ㇒ 丿 ㇓ 丿 ㇔ 丶 ㇏ 乀 ㇠ 乙 ㇟ 乚
ㄚ 丫 ㄒ 丅 ㄎ 丂 ㄈ 匚 ㄇ 冂 ㄙ 厶 ㄐ 丩 ㄑ 〈 ㄍ 巜 ㄥ 乚 ㄖ 日 ㇆ 𠃌 ㇕ 𠃍 ㇗ 𠄌 ㇖ 乛
""".split()
#: Radicals that look like an ideograph, each before it.
RADICALS = """
⺀ 冫 ⺁ 厂 ⺂ 乛 ⺃ 乚 ⺄ 乙 ⺅ 亻 ⺆ 冂 ⺇ 几 ⺈ 𠂊 ⺉ 刂 ⺊ 卜 ⺋ 㔾 ⺌ 小 ⺍ 小 ⺎ 兀 ⺏ 尣 ⺐ 尢 ⺑ 𡯂 ⺒ 巳 ⺓ 幺 ⺔ 彑 ⺕ 彐 ⺖ 忄 ⺗ 㣺 ⺘ 扌 ⺙ 攵 ⺛ 旡 ⺜ 日 ⺝ 月 ⺞ 歺 ⺟ 母 ⺠ 民
⺡ 氵 ⺢ 氺 ⺣ 灬 ⺤ 爫 ⺥ 爫 ⺦ 丬 ⺧ 牛 ⺨ 犭 ⺩ 王 ⺪ 疋 ⺫ 目 ⺬ 示 ⺭ 礻 ⺮ 竹 ⺯ 糹 ⺰ 纟 ⺱ 罒 ⺲ 罒 ⺳ 㓁 ⺴ 㓁 ⺵ 网 ⺶ 羊 ⺷ 羊 ⺸ 羊 ⺹ 耂 ⺺ 肀 ⺻ 聿 ⺼ 月 ⺽ 臼 ⺾ 艹 ⺿ 艹 ⻀ 艹 ⻁ 虎 ⻂ 衤
⻃ 覀 ⻄ 西 ⻅ 见 ⻆ 角 ⻇ 角 ⻈ 讠 ⻉ 贝 ⻊ 足 ⻋ 车 ⻌ 辶 ⻍ 辶 ⻎ 辶 ⻏ 阝 ⻐ 钅 ⻑ 長 ⻒ 镸 ⻓ 长 ⻔ 门 ⻕ 阜 ⻖ 阝 ⻗ 雨 ⻘ 青 ⻙ 韦 ⻚ 页 ⻛ 风 ⻜ 飞 ⻝ 食 ⻞ 飠 ⻟ 飠 ⻠ 饣 ⻡ 首 ⻢ 马 ⻣ 骨 ⻤ 鬼
⻥ 鱼 ⻦ 鸟 ⻧ 卤 ⻨ 麦 ⻩ 黄 ⻪ 黾 ⻫ 斉 ⻬ 齐 ⻭ 歯 ⻮ 齿 ⻯ 竜 ⻰ 龙 ⻱ 龜 ⻲ 亀 ⻳ 龟
""".split()
#: Separators that look alike, each before the one it looks like.
SEPARATORS = """
‐ - ‑ - ‒ - – - − - ﹣ - ⁃ - ˗ - · · ・ · ‧ · ∙ · ⋅ · • · · · ᛫ · ․ . ‥ .. … ... ︰ : ∶ : ։ : ꞉ : ; ; ⁄ / ∕ / ∣ | ǀ | ‚ , ‛ ' ʹ ' ʼ ' ′ ' ‘ ' ’ ' ´ ' ˊ ' ″ " 〃 " ∼ ~ 〜 ~ ～ ~ ∗ * ⁎ * ❨ ( ❩ ) ❲ 〔 ❳ 〕 ︵ ( ︶ ) ﹝ 〔 ﹞ 〕 〈 〈 〉 〉 ⟨ 〈 ⟩ 〉
""".split()
_SHOWN_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD])
_FILLERS = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0])
_LOOKS = ("<wide>", "<narrow>", "<noBreak>", "<font>")

#: The most frequent token spellings the trie holds, and the longest of them.
VOCABULARY, LONGEST = 200_000, 64


def ignorable(point: int) -> bool:
    """Whether a code point isn't seen: format and control characters, variation selectors, fillers."""
    if point in _FILLERS or 0xFE00 <= point <= 0xFE0F or 0xE0000 <= point <= 0xE0FFF:
        return True
    kind = unicodedata.category(chr(point))
    return (kind == "Cf" and point not in _SHOWN_FORMATS) or (kind == "Cc" and point not in (9, 10, 11, 12, 13, 0x85))


@lru_cache(maxsize=1)
def table() -> dict[int, str]:
    """Code point -> what it looks like, decomposed; only code points that look like something else are in it."""
    pairs: dict[str, str] = {}
    for names in (LETTERS, STROKES, RADICALS, SEPARATORS):
        pairs |= {a: b for a, b in zip(names[::2], names[1::2]) if a != b}

    def look(text: str, depth: int = 0) -> str:
        out = []
        for char in unicodedata.normalize("NFD", text):
            point = ord(char)
            if ignorable(point):
                continue
            kind = unicodedata.category(char)
            if kind == "Zs" or char == "\t":
                out.append(" ")
                continue
            if char in "\u0085\u2028\u2029\u000b\u000c":
                out.append("\n")
                continue
            to = pairs.get(char)
            if to is None and (how := unicodedata.decomposition(char)).startswith("<"):
                tag, _, codes = how.partition(" ")
                radical = 0x2E80 <= point <= 0x2FDF or 0xFB00 <= point <= 0xFB06 or 0x2F800 <= point <= 0x2FA1F
                if tag in _LOOKS or (tag == "<compat>" and radical):
                    to = "".join(chr(int(c, 16)) for c in codes.split())
            out.append(char if to is None or depth > 4 else look(to, depth + 1))
        return "".join(out)

    return {point: to for point in _assigned() if not 0xAC00 <= point <= 0xD7A3 and (to := look(char := chr(point))) != char}


@lru_cache(maxsize=1)
def _assigned() -> list[int]:
    """Code points that stand for a character, and those kept for invisible ones."""
    return [p for p in range(0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Co", "Cs") or 0xE0000 <= p <= 0xE0FFF]


@lru_cache(maxsize=1)
def _spelling_table() -> dict[int, str]:
    """What a spelling in the vocabulary is freed from: width, composition, radicals, invisible characters; letters of other scripts stay."""
    kept = {ord(c) for c in LETTERS[::2] + STROKES[::2]}
    return {point: look for point, look in table().items() if point not in kept}


def spelling(token: str) -> str:
    """A token as it may stand in the vocabulary."""
    composed = unicodedata.normalize("NFC", token)
    return unicodedata.normalize("NFC", "".join(c if ord(c) in _precomposed() else c.translate(_spelling_table()) for c in composed))


@lru_cache(maxsize=1)
def _precomposed() -> frozenset[int]:
    """Letters of other scripts with accents, whose look is Latin but whose spelling stays."""
    kept = {ord(c) for c in LETTERS[::2] + STROKES[::2]}
    return frozenset(p for p in table() if p not in kept and len(d := unicodedata.normalize("NFD", chr(p))) > 1 and any(ord(c) in kept for c in d))


def skeleton(text: str) -> str:
    """How a text looks, by table alone, as decomposed characters."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table()))


@lru_cache(maxsize=1)
def _classes() -> tuple[re.Pattern, dict[int, list[int]], list[int]]:
    """The pattern of words and of single ideographs that have look-alikes, the code points by their one-character look, and those of words."""
    word, mark, han, groups = [], [], set(), {}

    def is_han(char: str) -> bool:
        return "㐀" <= char <= "鿿" or "\U00020000" <= char <= "\U0003ffff"

    looks = table()
    for point in _assigned():
        look = looks.get(point, chr(point))
        if not look:
            mark.append(point)
        elif is_han(look[0]):
            if len(look) == 1 and point in looks:
                groups.setdefault(ord(look), [ord(look)]).append(point)
                han.update((point, ord(look)))
        elif (kind := unicodedata.category(look[0])[0]) == "M":
            mark.append(point)
        elif kind in "LN":
            word.append(point)

    def ranges(points: list[int]) -> str:
        out, first, last = [], None, None
        for point in [*sorted(points), 1 << 30]:
            if last is not None and point == last + 1:
                last = point
                continue
            if first is not None:
                out.append(re.escape(chr(first)) + ("-" + re.escape(chr(last)) if last > first else ""))
            first = last = point
        return "".join(out)

    marks = ranges(mark)
    return re.compile(f"[{ranges(word)}][{ranges(word)}{marks}]*|[{ranges(list(han))}]"), groups, word


def symbols(token: str) -> list[str]:
    """A token's stored characters, decomposed; each looks like one character or like nothing (see ``look_of``).

    Characters that look like several are replaced by these. Where exchanged letters would put accents in another order, all are.
    """
    stored = unicodedata.normalize("NFD", token)
    look = stored.translate(table())
    ordered = unicodedata.normalize("NFD", look)
    if ordered != look:
        return list(ordered)
    return [part for char in stored for part in (look_of(char) if len(look_of(char)) > 1 else char)]


def look_of(char: str) -> str:
    """What a character looks like; nothing for an invisible one."""
    return table().get(ord(char), char)


class Node:
    """A place in the trie: its children by their characters and by what these look like, and the spelling that ends here."""

    __slots__ = ("alike", "children", "entry")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.alike: dict[str, list[Node]] = {}
        self.entry: tuple[str, int] | None = None

    def child(self, char: str) -> Node:
        if (node := self.children.get(char)) is None:
            node = self.children[char] = Node()
            self.alike.setdefault(look_of(char), []).append(node)
        return node


class Trie:
    """A vocabulary of spellings, walked by a weighted edit automaton.

    Edges carry characters as they are spelt. An edge is taken without cost by any character that looks the same, and invisible
    characters of the token or of an entry are passed over without cost; other replacements, insertions and deletions cost 1.
    """

    def __init__(self) -> None:
        self.root = Node()

    def add(self, word: str, weight: int) -> None:
        """Of entries with the same characters the one with the greatest weight (of equal ones the smallest) stays."""
        node = self.root
        for char in symbols(word):
            node = node.child(char)
        if node.entry is None or (-weight, word) < (-node.entry[1], node.entry[0]):
            node.entry = (word, weight)

    @staticmethod
    def _settled(states: dict[Node, int], most: int) -> dict[Node, int]:
        """The states with all that are reached by inserting characters of an entry."""
        queue = list(states)
        while queue:
            node = queue.pop()
            cost = states[node]
            for children, price in ((node.alike.get("", ()), cost), (node.children.values() if cost < most else (), cost + 1)):
                for child in children:
                    if states.get(child, most + 1) > price:
                        states[child] = price
                        queue.append(child)
        return states

    def match(self, token: str, most: int = 0) -> tuple[str, int] | None:
        """The canonical spelling at the least cost up to ``most``, and that cost; of equal ones the most frequent, then the smallest."""
        states = self._settled({self.root: 0}, most)
        for char in symbols(token):
            look, reached = look_of(char), {}

            def reach(node: Node, cost: int) -> None:
                if cost <= most and reached.get(node, most + 1) > cost:  # noqa: B023
                    reached[node] = cost  # noqa: B023

            for node, cost in states.items():
                for child in node.alike.get(look, ()):
                    reach(child, cost)
                reach(node, cost + (look != ""))
                if cost < most:
                    for child in node.children.values():
                        reach(child, cost + 1)
            states = self._settled(reached, most)
            if not states:
                return None
        ends = [(cost, -node.entry[1], node.entry[0]) for node, cost in states.items() if node.entry]
        if not ends:
            return None
        cost, _, word = min(ends)
        return word, cost


class Canon:
    """Canonical forms by a vocabulary of ``(spelling, weight)``."""

    def __init__(self, vocabulary: list[tuple[str, int]]) -> None:
        self.trie, self.words, self.single = Trie(), {}, None
        weights: Counter[str] = Counter()
        for token, weight in vocabulary:
            weights[spelling(token)] += weight
        for token, weight in weights.items():
            self.trie.add(token, weight)
        groups = _classes()[1]
        self.rest = {point: look for point, look in table().items() if not look or not self._in_word(look[0])}
        for look, members in groups.items():
            form = self._token(chr(look))
            for point in members:
                if form == chr(point):
                    self.rest.pop(point, None)
                else:
                    self.rest[point] = form

    @staticmethod
    def _in_word(char: str) -> bool:
        return unicodedata.category(char)[0] in "LN" and not ("\u3400" <= char <= "\u9fff" or char >= "\U00020000")

    def _token(self, token: str) -> str:
        found = self.trie.match(token)
        return unicodedata.normalize("NFC", found[0] if found else skeleton(token))

    def _word(self, match: re.Match) -> str:
        token = match.group()
        form = self.words.get(token)
        if form is None:
            form = self._token(token)
            if len(self.words) < 1_000_000:
                self.words[token] = form
        return form

    def form(self, text: str) -> str:
        return _word_pattern().sub(self._word, text).translate(self.rest)

    def forms(self, column: pa.Array) -> pa.Array:
        """The forms of a column: one table lookup for all its characters; only rows with words or changes of length go one by one."""
        if self.single is None:
            self.single = np.arange(0x110000, dtype=np.uint32)
            self.hard = np.zeros(0x110000, bool)
            for point, look in self.rest.items():
                if len(look) == 1:
                    self.single[point] = ord(look)
                else:
                    self.hard[point] = True
            self.hard[_classes()[2]] = True
        points, offsets = flatten(column)
        mapped = decode(self.single[points])
        hard = np.unique(rows_of(offsets)[self.hard[points]])
        bounds = offsets.tolist()
        out = [mapped[a:b] for a, b in zip(bounds, bounds[1:])]
        for row in hard.tolist():
            out[row] = self.form(column[row].as_py())
        return pa.array(out, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))


@lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    """Words only: ideographs are single tokens and go through the translation table made from the trie."""
    return re.compile(_classes()[0].pattern.rpartition("|")[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with look-alikes and how often they occur in a task's texts; only rows with letters or digits are looked at one by one."""
    counts: Counter[str] = Counter()
    words = _word_pattern()
    single, lettered = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for members in _classes()[1].values():
        single[members] = True
    lettered[_classes()[2]] = True
    characters = np.zeros(0x110000, np.int64)
    for batch in batches:
        for column in batch.columns:
            points, offsets = flatten(column)
            found = np.bincount(points) if len(points) else np.zeros(0, np.int64)
            characters[: len(found)] += found
            rows = np.unique(rows_of(offsets)[lettered[points]])
            texts = column.take(pa.array(rows)).to_pylist()
            counts.update(w for w in words.findall("\n".join(texts)) if len(w) <= LONGEST)
        if len(counts) > 500_000:
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
            counts.clear()
    for point in np.flatnonzero(single & (characters > 0)):
        counts[chr(point)] += int(characters[point])
    yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])


def vocabulary(df: DataFrame, columns: list[str], size: int = VOCABULARY) -> list[tuple[str, int]]:
    """The ``size`` most frequent spellings of tokens that have look-alikes, counted over all rows; equally frequent ones by spelling."""
    counts = df.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(_counted, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return [(r.token, r.n) for r in counts.orderBy(F.desc("n"), "token").limit(size).collect()]


_CANON: list = []


def _forms(shared, first: int):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        if not _CANON or _CANON[0][0] is not words:
            _CANON[:] = [(words, Canon(words))]
        canon = _CANON[0][1]
        for batch in batches:
            columns = list(batch.columns)
            for i in range(first, len(columns)):
                columns[i] = canon.forms(columns[i])
            yield pa.record_batch(columns, names=batch.schema.names)

    return form


def canonical(df: DataFrame, keep: list[str], columns: list[str], size: int = VOCABULARY) -> DataFrame:
    """``keep`` unchanged and each of ``columns`` in canonical form, under its own name with ``_form`` behind it.

    Width, composition of accents, kinds of blanks, invisible characters and look-alikes are unified; other accents, other
    characters, other scripts' forms of an ideograph, the number of blanks and line breaks stay. Null stays null. The vocabulary
    is that of ``columns`` over all rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(df, columns, size))
    rows = df.select(*keep, *[F.col(c).cast("string").alias(f"{c}_form") for c in columns])
    return rows.mapInArrow(_forms(shared, len(keep)), rows.schema)


def _forms_of_records(df: DataFrame, id_col: str, look_col: str, other_col: str, size: int) -> DataFrame:
    """``id, form, stored``, written: a key of a record's look, and one of what is stored in both columns."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(look_col).alias("look"), F.col(other_col).alias("other")).where("id is not null and look is not null")
    marked = rows.withColumn("stored", F.md5(F.concat_ws("\0", F.coalesce(F.char_length("other"), F.lit(-1)).cast("string"), F.coalesce("other", F.lit("")), "look")))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(df, [look_col, other_col], size))
    formed = marked.select("id", "stored", F.col("look").alias("form")).mapInArrow(_forms(shared, 2), "id string, stored string, form string")
    keyed = formed.select("id", F.struct(F.md5("form").alias("form"), "stored").alias("k")).groupBy("id").agg(F.max("k").alias("k"))
    return checkpointed(keyed.select("id", "k.form", "k.stored"))


def lookalike_classes(df: DataFrame, id_col: str, look_col: str, other_col: str, size: int = VOCABULARY) -> DataFrame:
    """``id, class_id, members, links`` of every record: its class of equal looks, and how many of that are stored differently.

    class_id is the smallest id of the class. Rows as of ``lookalike_pairs``, whose pairs are counted here and not formed.
    """
    keyed = _forms_of_records(df, id_col, look_col, other_col, size)
    copies = keyed.groupBy("form", "stored").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = copies.groupBy("form").agg(F.sum("copies").alias("members"), F.min("first").alias("class_id"))
    return keyed.join(copies.select("form", "stored", "copies"), ["form", "stored"]).join(classes, "form").select("id", "class_id", "members", (F.col("members") - F.col("copies")).alias("links"))


def lookalike_pairs(df: DataFrame, id_col: str, look_col: str, other_col: str, size: int = VOCABULARY) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of records whose ``look_col`` looks the same while it or ``other_col`` is stored differently.

    Null ids and null ``look_col`` take no part; a null ``other_col`` differs from any text. Repeated rows of one id count once
    (of differing ones the greatest). Exact copies form no pairs with each other, and are never set against each other.
    """
    keyed = _forms_of_records(df, id_col, look_col, other_col, size)
    copies = keyed.select("form", "stored").distinct()
    met = copies.withColumnRenamed("stored", "stored_a").join(copies.withColumnRenamed("stored", "stored_b"), "form").where("stored_a < stored_b")
    a, b = keyed.withColumnsRenamed({"id": "a", "stored": "stored_a"}), keyed.withColumnsRenamed({"id": "b", "stored": "stored_b"})
    pairs = met.join(a, ["form", "stored_a"]).join(b, ["form", "stored_b"])
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
