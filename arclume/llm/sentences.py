"""Sentence units of texts in any script: a pushdown automaton over quotations, brackets and list levels."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclume.session import spread

# Abbreviations by what may follow their last full stop.
#: A name, a term or an explanation follows: never an end inside a paragraph.
BEFORE_MORE = """
Mr Mrs Ms mr mrs dr st Messrs Dr Drs Prof St Rev Hon Gen Col Capt Lt Sgt Gov Sen Rep Pres vs cf viz approx ca c.f i.e e.g resp incl excl
z.B d.h u.a i.d.R s.o s.u o.ä v.a z.T bzw vgl ggf evtl inkl exkl zzgl sog Hr Hrn Fr Frl Dipl Ing
p.ex c.-à-d M MM Mme Mlle env av apr
p.ej Sr Sra Srta Sres Dr Dra Ud Uds Vd Lic
т.е т.к т.н г-н г-жа гр им ул проф акад д-р см ср напр
π.χ κ κα κος κ.κ δηλ βλ πρβλ Δρ Καθ
डॉ श्री श्रीमती प्रो सुश्री
د أ م ص.ب
""".split()
#: A number or a letter follows: an end only if neither does.
BEFORE_NUMBER = """
No Nos Nr Nrn Fig Figs fig figs Eq Eqs Sec sec sect Sect Ch ch chap Chap Vol vol p pp Tab Abb Art art Bd S Kap Abs Ziff
n fig chap vol pág págs Pág cap núm art
рис стр гл табл п пп ст № т
σελ αρ εικ κεφ
""".split()
#: Ends a sentence if what follows begins one.
AT_END = """
etc a.m p.m A.M P.M Inc Ltd Corp Co Jr al U.S U.K
usw u.s.w u.v.m u.ä ff Uhr
etc s.s
т.д т.п др пр г гг в вв н.э тыс млн млрд руб
κ.λπ κ.ά κ.τ.λ κτλ κλπ μ.μ π.μ
""".split()
#: Also an abbreviation before a name when a capital follows (and then no end).
BEFORE_NAME = {"г", "М", "д"}
#: What belongs to a country in front of it, with a capital.
OF_COUNTRY = frozenset("Army Navy Air Marine Marines Coast Forces Senate House Congress President Government Department Treasury Supreme Court District Census Bureau Secretary State States Constitution Parliament Embassy Patent Postal Customs Federal Dollar".split())
COUNTRIES = {"U.S", "U.K"}
#: Months after an ordinal number.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split()
#: Names that open a sentence in lower case.
LOWER_NAMES = "npm systemd iptables pandas numpy nginx git curl bash grep sudo ssh docker kubectl pip yarn webpack macOS iOS jQuery eBPF gRPC tmux vim zsh awk sed rsync cron journalctl udev dbus ffmpeg gcc clang cmake make pytest scipy matplotlib sqlite redis mysql postgres psql apt dpkg yum dnf brew conda wget htop strace gdb lldb jq xargs tar".split()
#: Words that go on after a quotation, in scripts without letter case.
GOES_ON = tuple(
    "然后 就 说 說 道 问 問 的 但 而 并 且 接着 随后 于是 是 之后 后来 他说 她说 我说 他说道 、 ， , ； ： と って は が を の に も で へ という とか など から まで や ば 라고 이라고 라는 하고 고 는 은 이 가 을 를 의 에 와 과 도 로 しか".split()
)

ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
STRONG = "!?。！？｡।॥؟۔‼⁇⁈⁉።"
DOTS = ".…．‥"
PAIRS = {"„": "“”", "“": "”“", "”": "”", "«": "»", "»": "«", "‹": "›", "‘": "’", '"': '"', "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", "〔": "〕"}
OPENERS = {c: "".join(o for o in PAIRS if c in PAIRS[o]) for c in "".join(PAIRS.values())}
BRACKETS = "([{（【［〔"
CLOSERS = "”“»«›’\")]}」』）】》〉］〕"
LINKED, CODED, MAILED = r"(?:https?|ftp)://[!#-'*-;=?-Z\\^-_a-z{}~]+", r"`[^`\n]*(?:\n[^`\n]+)?`", r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+"
MARKS = (
    r"(?P<quote>[„“”«»‹›‘’\"()\[\]{}「」『』（）【】《》〈〉［］〔〕])"
    r"|(?P<end>[.!?…。！？｡।॥؟۔‼⁇⁈⁉።．‥;\u037e](?:[\u200b-\u200d\u00ad]*[ \u00a0]?[.!?…？！]|[!?…。！？؟])*)"
    r"|(?P<thai>(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า|ฮะ)(?=[\s\u200b-\u200d\ufeff]|$|[\"”»)）]))"
)


@lru_cache(maxsize=None)
def _events(links: bool, code: bool, mail: bool) -> re.Pattern:
    """The marks that the automaton stops at, in texts that hold links, code or addresses or don't."""
    skip = "|".join(p for p, there in ((LINKED, links), (CODED, code), (MAILED, mail)) if there)
    return re.compile(f"(?P<skip>{skip})|{MARKS}" if skip else MARKS)


FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
BULLET = re.compile(r"([ \t]*)(?:[-*+•‣·–]|\(?[a-zA-Z]\)|\(\d+\))[ \t]+(?=\S)")
NUMBER = re.compile(r"([ \t]*)(\d{1,9})[.)）、][ \t]+(?=\S)")
#: Markup that closes behind the mark that ends a sentence.
MARKUP = re.compile(r"(?:</\w+>|\*{1,3}|_{1,3}|~~)+(?=\s|&nbsp;|$)")
WORD = re.compile(r"[\w-]+")
TOKEN = re.compile(r"[^\s(\[«„“\"]*$")
INDENT = re.compile(r"(?: {4}|\t)")
INITIALS = re.compile(r"(?:[^\W\d_]\.\s*){1,3}[^\W\d_]{2}")
LINK = re.compile(r"[ \t>]*(?:<?(?:https?|ftp)://\S+>?|!?\[[^\]\n]*\]\([^)\n]*\))[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,}|=+)[ \t]*$")


class AbbreviationTrie:
    """Abbreviations read backwards from a full stop. White space between their parts may be there or not."""

    def __init__(self) -> None:
        self.root: dict = {}
        for kind, words in (("end", AT_END), ("number", BEFORE_NUMBER), ("more", BEFORE_MORE)):
            for word in words:
                parts = word.split(".")
                for spelled in {word, word[0].upper() + word[1:]} if len(parts) > 1 or kind == "more" and len(word) > 2 else {word}:
                    own = spelled.split(".")
                    for n in range(1, len(own) + 1):
                        self.add(own[:n], kind if n == len(own) else "more", own[n:])

    def add(self, parts: list[str], kind: str, rest: list[str]) -> None:
        node = self.root
        for ch in reversed(".".join(parts)):
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((kind, rest))

    def match(self, text: str, dot: int, least: int) -> tuple[str, str] | None:
        """(kind, abbreviation) of the longest abbreviation whose last full stop is at ``dot``; it begins at ``least`` at the earliest."""
        node, at, best = self.root, dot - 1, None
        while at >= least:
            ch = text[at]
            if ch in ZERO_WIDTH:
                at -= 1
                continue
            if "." in node and ch.isspace():
                while at >= least and text[at].isspace():
                    at -= 1
                if at < least or text[at] != ".":
                    break
                ch = "."
            node = node.get(ch)
            if node is None:
                break
            at -= 1
            if "" in node and (at < least or not _wordlike(text[at])):
                for kind, rest in node[""]:
                    if not rest or self._follows(text, dot + 1, rest):
                        best = (kind, text[at + 1 : dot])
                        if rest:
                            return best
        return best

    @staticmethod
    def _follows(text: str, at: int, rest: list[str]) -> bool:
        for part in rest:
            while at < len(text) and text[at].isspace():
                at += 1
            if not text.startswith(part + ".", at):
                return False
            at += len(part) + 1
        return True


def _wordlike(ch: str) -> bool:
    return ch.isalnum() or unicodedata.category(ch)[0] == "M"


TRIE = AbbreviationTrie()
LOWER = frozenset(LOWER_NAMES)
MONTH = frozenset(MONTHS)


def _cased(ch: str) -> bool:
    return ch.lower() != ch.upper()


def _blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the blocks: 'code', 'line' (one unit) or 'prose'. List items are blocks of their own."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    begin = None  # of the open paragraph or list item
    last = 0
    number: int | None = None  # of the open list, by its items' numbers
    listed = False
    i = 0

    def done() -> Iterator[tuple[str, int, int]]:
        nonlocal begin
        if begin is not None:
            yield "prose", begin, last
            begin = None

    while i < len(lines):
        at, line = lines[i]
        if not line.strip():
            yield from done()
            i += 1
            continue
        fence = FENCE.match(line)
        if fence and (fence[1][0] == "~" or "`" not in line[fence.end() :]):
            yield from done()
            j = i + 1
            close = re.compile(r"\s*" + re.escape(fence[1]) + re.escape(fence[1][0]) + r"*\s*$")
            while j < len(lines) and not close.match(lines[j][1]):
                j += 1
            j = min(j, len(lines) - 1)
            yield "code", at, lines[j][0] + len(lines[j][1])
            i, number, listed = j + 1, None, False
            continue
        if begin is None and INDENT.match(line) and not listed:
            j = k = i
            while k < len(lines) and (INDENT.match(lines[k][1]) or not lines[k][1].strip()):
                if lines[k][1].strip():
                    j = k
                elif k + 1 < len(lines) and lines[k + 1][1].strip() and not INDENT.match(lines[k + 1][1]):
                    break
                k += 1
            yield "code", at, lines[j][0] + len(lines[j][1])
            i = j + 1
            continue
        if HEADING.match(line):
            yield from done()
            yield "line", at, at + len(line)
            number, listed = None, False
        elif RULE.match(line) and (begin is None or line.lstrip()[0] == "="):
            if begin is not None and "\n" not in text[begin:last]:
                yield "line", begin, last
                begin = None
            yield from done()
        elif begin is None and LINK.match(line) and (i + 1 == len(lines) or not lines[i + 1][1].strip()):
            yield "line", at, at + len(line)
            number, listed = None, False
        else:
            bullet, numbered = BULLET.match(line), NUMBER.match(line)
            own = False
            if bullet and (begin is None or listed):
                own, number = True, None
            elif numbered and (begin is None or listed and number is not None and int(numbered[2]) == number + 1):
                word = re.match(r"\w+", line[numbered.end() :])
                if not (word and word[0].lower() in MONTH):
                    own, number = True, int(numbered[2])
            if own:
                yield from done()
                begin, listed = at + (bullet or numbered).end(), True
            elif begin is None:
                begin, listed, number = at, listed and line[:1].isspace(), None if not line[:1].isspace() else number
            last = at + len(line)
        i += 1
    yield from done()


def _begins(text: str, at: int, stop: int) -> bool:
    """Whether what stands at ``at`` can begin a sentence: anything but a word in lower case and a mark that goes on."""
    ch = text[at]
    if ch.isalpha() and ch.islower():
        word = WORD.match(text, at, stop)[0]
        return word in LOWER or any(c.isupper() for c in word)
    return ch not in ",;:，、；：—–-)]}」』）&/|=+<%·"


def _prose(text: str, begin: int, stop: int, event: re.Pattern) -> Iterator[int]:
    """Ends of the sentences of one paragraph or list item, without the last; ``event`` finds the marks to stop at."""
    last: dict[str, int] = {}
    unclosed: set[int] = set()

    def closes(q: str, at: int) -> bool:
        """Whether a mark that closes ``q`` stands behind ``at``."""
        if q not in last:
            last[q] = max(text.rfind(c, begin, stop) for c in PAIRS[q])
        return last[q] > at

    def visible(at: int) -> int:
        while at < stop and ((ch := text[at]).isspace() or ch in ZERO_WIDTH or ch == ">" and text[at - 1] == "\n" or ch == "&" and text.startswith("&nbsp;", at)):
            at += 6 if ch == "&" else 1
        return at

    def end(at: int) -> None:
        nonlocal first
        ends.append(at)
        first = at

    pos = first = begin
    ends: list[int] = []
    while True:
        stack: list[tuple[str, int]] = []
        opened_by = dict.fromkeys(PAIRS, 0)
        while m := event.search(text, pos, stop):
            i, pos = m.start(), m.end()
            kind = m.lastgroup
            if kind == "skip":
                while pos > i + 1 and text[pos - 1] in ".,;:!?'" and text[i] != "`":
                    pos -= 1
                continue
            if kind == "quote":
                q = m[0]
                top = next((k for k in range(len(stack) - 1, -1, -1) if q in PAIRS[stack[k][0]]), None) if stack and any(opened_by[o] for o in OPENERS.get(q, "")) else None
                # a mark that both opens and closes closes if it was opened; an apostrophe does neither
                if q in "‘’" and 0 < i < stop - 1 and text[i - 1].isalnum() and text[i + 1].isalnum():
                    continue
                if top is not None and not (q == "“" and stack[top][0] == "“" and i + 1 < stop and text[i + 1].isalnum() and text[i - 1].isspace()):
                    opened = stack[top]
                    for o, _ in stack[top:]:
                        opened_by[o] -= 1
                    del stack[top:]
                    if not stack:
                        before = i - 1
                        while before > opened[1] and (text[before].isspace() or text[before] in ZERO_WIDTH or text[before] in CLOSERS):
                            before -= 1
                        if text[before] not in STRONG + DOTS:
                            continue
                        while pos < stop and text[pos] in CLOSERS and text[pos] not in "“«\"" :
                            pos += 1
                        after = visible(pos)
                        if after >= stop or text[after] in STRONG + DOTS:
                            continue
                        inner = visible(opened[1] + 1)
                        spaced = after > pos
                        if opened[0] in BRACKETS:
                            whole = text[inner].isupper() or not _cased(text[inner])
                            if whole and _begins(text, after, stop) and not text.startswith(GOES_ON, after):
                                end(pos)
                        elif _cased(text[after]) or spaced:
                            if _begins(text, after, stop) and not (not _cased(text[after]) and text.startswith(GOES_ON, after)):
                                end(pos)
                        elif _begins(text, after, stop) and not text.startswith(GOES_ON, after):
                            end(pos)
                elif q in PAIRS and closes(q, i) and (stack or i not in unclosed):
                    if q == '"' and i > begin and (text[i - 1].isalnum() or i + 1 < stop and text[i + 1].isspace()):
                        continue
                    if q == "‘" and not (i == begin or not text[i - 1].isalnum()):
                        continue
                    if q in "”»" and i > begin and not text[i - 1].isspace():
                        continue
                    if q == "(" and i > begin and text[i - 1] in ":;" or q == "(" and text[i - 2 : i] in (":-", ";-"):
                        continue
                    stack.append((q, i))
                    opened_by[q] += 1
                continue
            if stack:
                continue
            if kind == "thai":
                after = visible(pos)
                if after < stop and text[after] not in STRONG + DOTS + CLOSERS:
                    end(pos)
                continue
            run = m[0]
            if run[0] in ";\u037e":
                before = i - 1
                while before > begin and text[before] in ZERO_WIDTH + "\u00a0 ":
                    before -= 1
                greek = "Ͱ" <= text[before] <= "Ͽ" or "ἀ" <= text[before] <= "῿"
                if run[0] == "\u037e" or greek and len(run) == 1 and (pos >= stop or text[pos].isspace() or _wordlike(text[pos]) and text[pos].isupper()):
                    if visible(pos) < stop:
                        end(pos)
                    continue
                if len(run) == 1:
                    continue
            while pos < stop and text[pos] in CLOSERS and text[pos] not in '“«"(' :
                pos += 1
            if pos < stop and text[pos] == '"' and text.count('"', first, pos) % 2:
                pos += 1
            if marks := MARKUP.match(text, pos, stop):
                pos = marks.end()
            after = visible(pos)
            if after >= stop:
                break
            gap, ch = after > pos and (any(c.isspace() for c in text[pos:after]) or "&" in text[pos:after]), text[after]
            if any(c in STRONG for c in run):
                wide = any(c in "。！？｡।॥።" for c in run)
                if wide:
                    if ch not in "，、,；":
                        end(pos)
                elif gap:
                    if ch not in ",;:，、—–":
                        end(pos)
                elif ch.isalpha() and (ch.isupper() or not _cased(ch)) or ch in "¿¡«„“「(\"":
                    end(pos)
                continue
            if len(run) > 1 or run in "…‥":  # an ellipsis
                words = re.findall(r"\w+", text[first:i])
                said = i - 1
                while said > begin and text[said] in "，、；":
                    said -= 1
                wide = not gap and i > begin and text[said].isalpha() and not _cased(text[said]) and ch not in CLOSERS + "，、,。；;：:"
                if len(words) > 1 and gap and _begins(text, after, stop) and not (not _cased(ch) and text.startswith(GOES_ON, after)):
                    end(pos)
                elif wide and len(run) > 1 and not text.startswith(GOES_ON, after):
                    end(pos)
                elif not gap and ch.isupper() and len(words) > 1 and len(run) > 1:
                    end(pos)
                continue
            # one full stop
            if not gap:
                before = text[i - 1] if i > begin else " "
                nxt = text[after + 1] if after + 1 < stop else " "
                if before in ZERO_WIDTH:
                    before = text[max(begin, i - 2)]
                joined = before.isalpha() and (before.islower() or not _cased(before)) or before.isdigit() or before in CLOSERS or unicodedata.category(before)[0] == "M"
                opens = ch.isupper() and (nxt.islower() or nxt.isspace() or nxt in "'’" + ZERO_WIDTH or nxt == "." and INITIALS.match(text, after, stop) is not None) or ch.isalpha() and not _cased(ch) and not _cased(before) or ch in "¿¡«„“"
                if joined and opens and ch.isascii() and before.isdigit() and not nxt.islower():
                    opens = False
                found = TRIE.match(text, i, begin)
                if not (joined and opens) or found and found[0] != "end":
                    continue
                end(pos)
                continue
            found = TRIE.match(text, i, begin)
            if found:
                kind, word = found
                if kind == "more" or kind == "number" and (ch.isdigit() or ch in "§#" or ch.isalpha() and (after + 1 >= stop or not text[after + 1].isalnum())):
                    continue
                if kind == "end" and (not _begins(text, after, stop) or word in BEFORE_NAME and ch.isupper()):
                    continue
                if word in COUNTRIES and (name := WORD.match(text, after, stop)) and name[0] in OF_COUNTRY:
                    continue
                if kind == "number" and not _begins(text, after, stop):
                    continue
                end(pos)
                continue
            if i > begin and text[i - 1].isupper() and (i - 1 == begin or not _wordlike(text[i - 2])) and ch.isupper():
                continue  # an initial
            token = TOKEN.search(text, max(begin, i - 40), i)[0].strip(ZERO_WIDTH)
            if token.isdigit() and len(token) <= 2:
                word = WORD.match(text, after, stop)
                if word and word[0].lower() in MONTH:
                    continue  # an ordinal in a date
            if ch in ",;:":
                continue
            end(pos)
        if stack:
            # Nothing closes what is left open. Behind the outermost the text goes on as if that were no opener; what was open above it would stay open
            # again, so it opens nothing either where nothing else is open.
            unclosed.update(i for _, i in stack)
            pos = stack[0][1] + 1
            continue
        yield from ends
        return


def sentence_ends(text: str | None) -> list[int]:
    """Offsets in code points just behind the last visible character of every sentence unit of ``text``.

    Null, empty and blank texts have no units.
    """
    if not text:
        return []
    out: list[int] = []
    event = _events("://" in text, "`" in text, "@" in text)
    for kind, begin, stop in _blocks(text):
        marks = [*(_prose(text, begin, stop, event) if kind == "prose" else []), stop]
        low = begin
        for mark in marks:
            at = mark
            while at > low and text[at - 1].isspace():
                at -= 1
            if at > low and (not out or at > out[-1]) and not text[low:at].isspace():
                out.append(at)
            low = max(low, mark)
    return out


def sentence_units(documents: DataFrame, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """One row per sentence unit: (keep, sent_no, sent_start, sent_end, sentence); ``with_text`` False leaves ``sentence`` out.

    ``sent_no`` counts from 0; ``sent_start`` is where the unit's first visible character is, ``sent_end`` lies just
    behind the last, both in code points. Every document is cut on its own and whole, in one pass: no shuffle, and rows repeated
    or of any length come out as they are. A document without visible text has no rows.
    """
    rows = spread(documents.select(*keep, F.col(text).alias("_text")))
    kept = [c for c in rows.columns if c != "_text"]
    schema = rows.select(*[f"`{c}`" for c in kept]).schema.add("sent_no", "integer").add("sent_start", "integer").add("sent_end", "integer")
    if with_text:
        schema = schema.add("sentence", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_text"]
            of: list[int] = []
            number: list[int] = []
            starts: list[int] = []
            stops: list[int] = []
            said: list[str] = []

            def flush() -> pa.RecordBatch:
                at = pa.array(of, pa.int32())
                columns = [c.take(at) for c in own] + [pa.array(x, pa.int32()) for x in (number, starts, stops)] + ([pa.array(said, pa.string())] if with_text else [])
                for x in (of, number, starts, stops, said):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            size = 0
            for row, t in enumerate(b.column(b.schema.get_field_index("_text"))):
                t = t.as_py()
                ends = sentence_ends(t)
                low = 0
                for n, at in enumerate(ends):
                    while t[low].isspace():
                        low += 1
                    number.append(n)
                    starts.append(low)
                    if with_text:
                        said.append(t[low:at])
                    low = at
                of += [row] * len(ends)
                stops += ends
                size += len(t or "")
                if len(of) > 50_000 or with_text and size > 1 << 24:
                    yield flush()
                    size = 0
            if of:
                yield flush()

    return rows.mapInArrow(cut, schema)
