"""Sentence units of texts in many languages, scripts and layouts.

A text is read in two steps. Lines make blocks: headings, list items, paragraphs, fenced blocks; a stack
holds the levels of the lists that are open, so that a number is an item where it goes on with one of
them or begins a deeper one. Within a block a pushdown automaton runs over the marks that matter: a stack holds the open
quotations and brackets, each with the boundaries found inside it. When one closes, its boundaries
stand if a new sentence follows, and fall if the sentence goes on; what is never closed was none, and
its boundaries pass to what is around it. Whether a period ends a sentence is told by a trie of
abbreviations, by numbers and initials, and by what follows in a script with or without capitals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairngraph.llm.abbreviations import INNER, lookup

# Marks, by what they do.
FULL = "。｡！？．।॥؟۔։።፧။។៕‽⁇⁈⁉"
WEAK = ".!?…"
GREEK = ";\u037e"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "〖": "〗", "“": "”", "„": "“”", "‚": "‘’", "‘": "’", "«": "»", "‹": "›", "»": "«", "›": "‹", '"': '"', "'": "'"}
BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
BRACKETS = "([{（［【〔〖"
CLOSERS = "".join(dict.fromkeys("".join(PAIRS.values())))
SPACED_CLOSERS = "»›"
GAP = " \t\u00a0\u202f\u2009"
LEADING = "".join(PAIRS) + "*_~¿¡-–—•·"
# Words that begin sentences and are no names, after a lone initial or a German ordinal.
STARTERS = frozenset("""The A An This That These Those It Its He She We They You In On At As If When Where While Who Why How What Since After Before For From Every Each No Some All Any There Here Our Their Use See Set Ask But And Or So Then
Die Der Das Ein Eine Einen Einem Es Er Sie Wir Ihr In Im Am An Auf Aus Bei Mit Nach Seit Von Vor Zu Zum Zur Für Wenn Wann Wie Was Wer Warum Wird Alle Alles Jede Jeder Jedes Diese Dieser Dieses Siehe Etwa Bitte Ab Und Aber Nur Nicht Dort Hier Danach
Le La Les L Un Une Il Elle On Nous Ce Cette Ces Dans Sur Pour Par Si Voir El Los Las Una Se No En Con Por""".split())
# Words that begin a sentence written small, after a number.
SMALL_STARTERS = frozenset("a an the this these it we they you der die das ein eine es er sie wir le la les un une il elle el los las una".split())
# Words before a German ordinal.
BEFORE_ORDINAL = frozenset("am der die das dem den des im vom zum zur beim ab bis dessen jeder jede jedes seinem ihrem einem einen nach vor seit unser unserem unseren dieser diesem jedem".split())

#: Levels of nested lists whose numbers a line can go on with; deeper stacks are only asked for their innermost.
MOST_LEVELS = 32

_CLASS = lambda s: "[" + re.escape(s) + "]"
_THAI = "\u0e01-\u0e2e\u0e30-\u0e3a\u0e40-\u0e45\u0e47-\u0e4e"
_CJK = "\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = "[^\\W_]"
_QUOTE = "'\u2019"
# A period before an ASCII letter or digit ends nothing, an apostrophe within a word is no quotation: neither is looked at.
MARK = re.compile(f"`+|(?:{_CLASS((FULL + WEAK).replace('.', ''))}|[.](?![0-9A-Za-z]))+|{_CLASS(GREEK)}|{_CLASS(''.join(c for c in ''.join(PAIRS) + CLOSERS if c not in _QUOTE))}|[{_QUOTE}](?!{_WORD})|(?<!{_WORD})[{_QUOTE}]|\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]|(?<=[{_THAI}\u0e2f\u0e46])[ \t\u00a0]+(?=[{_THAI}])")
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})([^\n]*)")
HEADING = re.compile(r"[ ]{0,3}#{1,6}(?=\s|$)")
NUMBERING = re.compile(r"\s*(?:\d{1,3}(?:\.\d{1,3})*[.)]?|[A-Z][.)])(?=\s)")
ITEM = re.compile(r"[ \t]*(?:(?P<bullet>[-*+•◦‣▪●·–])|(?P<number>\d{1,4})(?P<stop>[.)])|\((?P<round>\d{1,3}|[a-z])\)|(?P<letter>[a-z])\))(?=\s|$)[ \t\u00a0]*")
RULE = re.compile(r"[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|={3,}[ \t]*)$")
HAN = re.compile(f"[{_CJK}]")
HANGUL = re.compile("[\uac00-\ud7af\u1100-\u11ff]")
PLAIN_WORD = re.compile(r"(?<![\w./(-])[^\W\d_A-Z][^\W\d_A-Z]+(?=[\s,.;:!?)]|$)")
GREEK_LETTER = re.compile("[\u0370-\u0373\u0376-\u037d\u0386\u0388-\u03ff\u1f00-\u1fff]")
_LETTER = "(?:[^\\W_]|[\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0963\u0971-\u0dff\u0e31-\u0e4e])"
#: Read backwards from the period.
WORD_BEFORE = re.compile(rf"{_LETTER}+(?:[.\u2019'-]{_LETTER}+)*")
WORD_AFTER = re.compile(r"[^\W\d_]+")


class _Levels:
    """The open list levels, outermost first: where the marks of each stand and the last number, -1 for bullets and letters."""

    __slots__ = ("stack",)

    def __init__(self):
        self.stack: list[tuple[int, int]] = []

    def enter(self, indent: int, number: int) -> None:
        """An item begins: deeper levels are over, its own goes on or is new."""
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        if self.stack and self.stack[-1][0] == indent:
            self.stack.pop()
        self.stack.append((indent, number))

    def fits(self, indent: int, number: int) -> bool:
        """Within an item, can a line that begins with a number be the next one?

        It is where it follows the last number of a level, where a level counts all its items as 1,
        or where it is the first of a level that stands further in.
        """
        if number == 1 and self.stack and indent > self.stack[-1][0]:
            return True
        return any(number == last + 1 and last >= 0 or number == last == 1 and indent == at for at, last in reversed(self.stack[-MOST_LEVELS:]))


def _indent(line: str, marks: int) -> int:
    return len(line[:marks].expandtabs(4))


def _blocks(text: str) -> Iterator[tuple[int, int, int, str]]:
    """start, end, where its words begin, kind (``text``, ``fence``) of each block, in order."""
    lines, at = [], 0
    for m in LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    start = words = end = -1
    in_item, levels = False, _Levels()
    i = 0
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b]
        mark = line.lstrip()[:1]
        if not mark:
            if start >= 0:
                yield start, end, words, "text"
            start, in_item = -1, False
            i += 1
            continue
        fence = FENCE.match(line) if mark in "`~" else None
        if fence and "`" not in fence[2]:
            if start >= 0:
                yield start, end, words, "text"
                start = -1
            close = re.compile(rf"[ ]{{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$")
            j = i + 1
            while j < len(lines) and not close.match(text, lines[j][0], lines[j][1]):
                j += 1
            last = min(j, len(lines) - 1)
            yield a, lines[last][1], a, "fence"
            i, in_item = last + 1, False
            continue
        head = HEADING.match(line) if mark == "#" else None
        if head or (mark in "-*_=" and RULE.match(line) and not ITEM.fullmatch(line)):
            if head is None and start >= 0 and mark == "=":
                yield start, b, words, "text"  # a title and the line under it
            else:
                if start >= 0:
                    yield start, end, words, "text"
                begins = a + (head.end() if head else len(line))
                numbered = NUMBERING.match(text, begins, b) if head else None
                yield a, b, numbered.end() if numbered else begins, "text"
            start, in_item = -1, False
            levels.stack.clear()
            i += 1
            continue
        item = ITEM.match(line)
        if item:
            number, indent = int(item["number"]) if item["number"] else -1, _indent(line, len(line) - len(line.lstrip()))
            # A number at the start of a wrapped line is an item only where one can be.
            fits = start < 0 or number < 0 or (levels.fits(indent, number) if in_item else number == 1)
            if fits and not (start >= 0 and item.end() == len(line)):
                if start >= 0:
                    yield start, end, words, "text"
                start, end, words, in_item = a, b, a + item.end(), True
                levels.enter(_level(levels, indent, number), number)
                i += 1
                continue
        if start < 0:
            start = words = a
            if not line[0].isspace():
                levels.stack.clear()  # a paragraph at the margin ends all lists
        end = b
        i += 1
    if start >= 0:
        yield start, end, words, "text"


def _level(levels: _Levels, indent: int, number: int) -> int:
    """Where an item's level stands: its own indent, but that of the level it counts on if the marks are not aligned."""
    if number > 1 and not any(at == indent and last == number - 1 for at, last in levels.stack):
        return next((at for at, last in reversed(levels.stack) if last == number - 1 and abs(at - indent) <= 1), indent)
    return indent


class _Frame:
    """What is open: the marks that close it, and the boundaries found inside, of which ``last`` is the latest.

    ``below`` is the latest boundary of all that is around it; nothing there moves while this is open.
    """

    __slots__ = ("closers", "opener", "at", "cuts", "last", "below")

    def __init__(self, closers: str, opener: str, at: int, below: int):
        self.closers, self.opener, self.at, self.cuts, self.last, self.below = closers, opener, at, [], -1, below

    def take(self, other: _Frame) -> None:
        """The boundaries of another frame are added, the fewer to the more."""
        if len(other.cuts) > len(self.cuts):
            self.cuts, other.cuts = other.cuts, self.cuts
        self.cuts.extend(other.cuts)
        self.last = max(self.last, other.last)


class _Automaton:
    """One block; ``cuts`` gives the offsets at which its units end. The time taken grows with the text's length alone."""

    def __init__(self, text: str, start: int, end: int):
        self.t, self.start, self.end = text, start, end
        self.stack = [_Frame("", "", start, start)]
        self.closable: dict[str, int] = {}
        self.opened: dict[str, int] = {}
        self.greek = self.greek_read = start - 1
        self.by_line = False
        if LINE.search(text, start, end):
            han = len(HAN.findall(text, start, end))
            self.by_line = han > 0 and not HANGUL.search(text, start, end) and han >= 2 * len(PLAIN_WORD.findall(text[start:end]))

    def cuts(self) -> list[int]:
        t, pos, stack = self.t, self.start, self.stack
        search, end = MARK.search, self.end
        while m := search(t, pos, end):
            c, pos = m[0][0], m.end()
            if c in FULL or c in WEAK:
                pos = self.terminal(m.start(), pos)
            elif c == "`":
                close = t.find(m[0], pos, end)
                pos = close + len(m[0]) if close >= 0 else pos
            elif c in BREAKS:
                if self.by_line:
                    self.cut(m.start())
            elif c in GREEK:
                if self.is_greek(m.start()):
                    pos = self.terminal(m.start(), pos)
            elif c in " \t\u00a0":
                self.cut(m.start())
            else:
                pos = self.pair(m.start())
        while len(stack) > 1:
            self.release()
        return stack[0].cuts

    def is_greek(self, at: int) -> bool:
        """Has the sentence before ``at`` a Greek letter? Each letter is looked at once."""
        if at > self.greek_read:
            for m in GREEK_LETTER.finditer(self.t, max(self.start, self.greek_read), at):
                self.greek = m.start()
            self.greek_read = at
        top = self.stack[-1]
        return self.greek >= max(self.start, top.last, top.below)

    def cut(self, at: int) -> None:
        top = self.stack[-1]
        top.cuts.append(at)
        top.last = at

    def push(self, closers: str, opener: str, at: int) -> None:
        top = self.stack[-1]
        self.stack.append(_Frame(closers, opener, at, max(top.last, top.below)))
        self.opened[opener] = self.opened.get(opener, 0) + 1
        for c in closers:
            self.closable[c] = self.closable.get(c, 0) + 1

    def pop(self) -> _Frame:
        top = self.stack.pop()
        self.opened[top.opener] -= 1
        for c in top.closers:
            self.closable[c] -= 1
        return top

    def release(self) -> None:
        """The innermost was never closed: its boundaries are those of what is around it."""
        top = self.pop()
        self.stack[-1].take(top)

    def closing(self, at: int) -> int | None:
        """Depth of the frame the mark at ``at`` closes, or None."""
        c = self.t[at]
        if c not in CLOSERS:
            return None
        if c in "'\u2019\u2018":  # an apostrophe?
            if at + 1 < self.end and self.t[at + 1].isalnum():
                return None
        if c == '"' or c == "'":
            before = self.t[at - 1] if at > self.start else " "
            if before.isspace() or before in BRACKETS:
                return None
        if not self.closable.get(c):
            return None
        return next(k for k in range(len(self.stack) - 1, 0, -1) if c in self.stack[k].closers)

    def close(self, depth: int) -> _Frame:
        while len(self.stack) - 1 > depth:
            self.release()
        return self.pop()

    def pair(self, at: int) -> int:
        """A quotation mark or bracket that follows no terminal."""
        t, c = self.t, self.t[at]
        depth = self.closing(at)
        if depth is not None:
            self.close(depth)  # closed in the midst of a sentence: what is inside ends nothing
            return at + 1
        if c in PAIRS:
            before = t[at - 1] if at > self.start else " "
            after = t[at + 1] if at + 1 < self.end else " "
            if c in "\"'\u2018\u201c" and c != "\u201c":
                if after.isspace() or before.isalnum() or before in WEAK:
                    return at + 1
                if c in "\"'":
                    while self.opened.get(c):  # the one before was never closed
                        self.release()
            self.push(PAIRS[c], c, at)
        return at + 1

    def terminal(self, at: int, pos: int) -> int:
        """A run of terminal marks from ``at`` to ``pos``; gives the place to go on from."""
        t, end = self.t, self.end
        marks = t[at:pos]
        closed: list[_Frame] = []
        while pos < end:
            c = t[pos]
            gap = pos
            if c in GAP:  # the space before a French closing quote
                while gap < end and t[gap] in GAP:
                    gap += 1
                if not (gap < end and t[gap] in SPACED_CLOSERS and self.closable.get(t[gap])):
                    break
                c = t[gap]
            depth = self.closing(gap)
            if depth is not None:
                closed.append(self.close(depth))
                pos = gap + 1
            elif gap == pos and (c in FULL or c in WEAK):
                if closed:
                    marks = c  # a terminal behind the quotation is the sentence's own
                pos += 1
            elif gap == pos and (c in "*_" or c in "”’»」』）】" or (c in "\"'" and (pos + 1 == end or t[pos + 1].isspace()))):
                if c in "*_" and not (pos + 1 >= end or t[pos + 1].isspace() or t[pos + 1] in "*_" + CLOSERS):
                    break
                pos += 1
            else:
                break
        if self.ends(at, pos, marks, closed):
            for f in reversed(closed):
                self.stack[-1].take(f)
            self.cut(pos)
        return pos

    def ends(self, at: int, pos: int, marks: str, closed: list[_Frame]) -> bool:
        """Does a sentence end with the marks at ``at``, what they close ending at ``pos``?"""
        t, end = self.t, self.end
        k = pos
        while k < end and t[k].isspace():
            k += 1
        if k >= end:
            return True
        gap = k > pos
        a = k
        while a < end and (t[a] in LEADING or t[a].isspace()):
            a += 1
        n = t[a] if a < end else ""
        upper, lower, digit = n.isupper() or n.istitle(), n.islower(), n.isdigit()
        caseless = n.isalpha() and not upper and not lower
        before = t[at - 1] if at > self.start else " "
        quoted = bool(closed)
        dots = marks.strip("…") == "" or (set(marks) <= {"."} and len(marks) > 1) or (set(marks) <= {".", "…"} and "…" in marks)
        if dots:
            if not gap and not HAN.match(n):
                return False
            return (upper or t[k] in "¿¡") and gap
        if any(c in FULL for c in marks) or (marks[-1] in "!?" and HAN.match(before)):
            if not quoted:
                return t[k] not in "，、,；;：:"
            if t[k] in "，、,；;：:。":
                return False
            outer = closed[-1]
            lead = t[outer.at - 1] if outer.at > self.start else ""
            if outer.opener in BRACKETS:
                return gap or lead == "" or lead in FULL or lead.isspace() or lead in CLOSERS
            if upper and gap:
                return True
            return bool(t[k] in PAIRS and outer.opener == t[k]) or (lead in "：:，," and lead != "" and not re.match(r"[的と地得之]|然后|就|便|并", t[k : k + 2])) or (gap and bool(HAN.match(before)))
        if not gap:
            return False
        if marks[-1] in GREEK or any(c in "!?" for c in marks):
            if quoted:
                return not (lower or (caseless and closed[-1].opener not in BRACKETS)) or (not n)
            return True
        # One period.
        if t[k] in ",;:)":
            return False
        if quoted and (lower or (caseless and closed[-1].opener not in BRACKETS)):
            return False
        return self.period(at, k, a, upper, lower, digit, caseless, quoted)

    def period(self, at: int, k: int, a: int, upper: bool, lower: bool, digit: bool, caseless: bool, quoted: bool) -> bool:
        t = self.t
        word = WORD_BEFORE.match(t[max(self.start, at - 60) : at][::-1])
        w = word[0][::-1] if word else ""
        follow = WORD_AFTER.match(t, a)
        follow = follow[0] if follow else ""
        inner = INNER.get(w + ".") if word and "." not in w else None
        if inner and any(t.startswith(p, k) for p in inner):
            return False
        found = lookup(t, at + 1)
        if found and found[1] >= self.start:
            kind, begin = found
            number_before = bool(re.search(r"\d[\s\u00a0\u202f]*$", t[max(self.start, begin - 6) : begin]))
            if kind == "name":
                kind = "maybe" if number_before else "never"
            if kind == "number" and number_before and begin > 0 and len(t[begin:at]) <= 4 and upper:
                return not quoted  # a unit: "5 min. The"
            if kind == "never":
                return False
            if quoted and closed_bracket(t, at):
                return False
            if kind == "number":
                return upper and len(follow) > 1 and not follow.isupper()
            return upper or digit and kind == "maybe" and "\n" in t[at:k]
        if not w:
            return True
        if w.isdigit() and len(w) <= 4:
            if lower and follow not in SMALL_STARTERS and not re.match(r"[\w.]*[_/(]", t[a : a + 40]):
                return False
            previous = re.search(r"([^\W\d_]+)\s+$", t[max(self.start, at - len(w) - 24) : at - len(w)])
            if upper and len(w) <= 2 and previous and previous[1].lower() in BEFORE_ORDINAL and follow not in STARTERS:
                return False
            return True
        if len(w) == 1 and w.isalpha():
            if w.isupper():  # an initial
                return bool(not upper or follow in STARTERS) if not lower else False
            if not lower and not upper and not w.islower():
                return False  # a lone letter of a script without capitals
        if "\u0e00" <= w[-1] <= "\u0e7f":
            return len(w) > 4
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", w):  # U.S., а.е.
            return upper and follow in STARTERS
        return True


def closed_bracket(text: str, at: int) -> bool:
    """An abbreviation's period stands right before a closing bracket."""
    return text[at + 1 : at + 2] in {")", "]", "}", "）"}


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentence units of a text: end exclusive, no white space at either end, all else covered.

    A null, empty or blank text has none.
    """
    if not text:
        return []
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for start, end, words, kind in _blocks(text):
        if kind == "fence":
            add(start, end)
            continue
        at = start
        for cut in sorted(set(_Automaton(text, words, end).cuts())):
            add(at, cut)
            at = cut
        add(at, end)
    return out


def sentences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start_char, end_char of every sentence unit of every document, one row each.

    Offsets count Unicode characters of the text as it is stored. Documents with a null or blank text
    give no rows; the same text twice gives its units for each document. The length of a text is not
    limited. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = sentence_units(text)
                ids += [i] * len(units)
                starts += [a for a, _ in units]
                ends += [b for _, b in units]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_char", "end_char"])

    rows = documents.selectExpr(f"cast(`{id_column}` as long) as i", f"`{text_column}` as t").where("i is not null and t is not null")
    return rows.mapInArrow(run, "doc_id long, start_char int, end_char int")
