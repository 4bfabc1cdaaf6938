"""Problem 5: sentence units with their positions, for every script.

The character properties are Unicode's (UAX #29 sentence terminals, closing punctuation, case);
on top of them: abbreviations that don't end a sentence, by the language that the text's common words tell, quotations that are closed
before they count, numbers at the head of an item, and Thai, which marks no ends.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .lookalike import look_alikes

#: By language, never the end: titles, and what is always followed by a name or by more of the sentence.
TITLES = {
    "en": frozenset("mr mrs ms dr prof eng st sr jr eq cf vs ie eg".split()),
    "de": frozenset("dr prof ing dipl hr fr st bzw vgl usw abs abschn bd".split()),
    "fr": frozenset("m mme mlle mm dr prof st ste ing cf env ex".split()),
    "es": frozenset("sr sra srta dr dra prof ing lic st ud uds".split()),
    "hi": frozenset("डॉ श्री प्रो कु".split()),
}
#: By language, not the end before a number: references.
REFERENCES = {
    "en": frozenset("no nos fig figs sec secs art arts pag p pp ch chap vol ed eq".split()),
    "de": frozenset("nr abb art kap abs bd s vol".split()),
    "fr": frozenset("no nr fig art arts chap vol p pp pag".split()),
    "es": frozenset("no núm fig art arts pág págs cap vol p pp sec".split()),
    "hi": frozenset("सं क्र पृ".split()),
}
#: By language, the end only before a capital or an opening mark: measures and shortened words.
SHORT = {
    "en": frozenset("approx min max incl etc ltd co inc corp dept est excl avg temp tel jan feb mar apr jun jul aug sep sept oct nov dec".split()),
    "de": frozenset("max min inkl ca mind etc exkl evtl ggf tel usw jan feb mär apr jun jul aug sep okt nov dez".split()),
    "fr": frozenset("max min env incl etc évt excl tel janv févr avr juil sept oct nov déc".split()),
    "es": frozenset("máx mín aprox incl etc excl resp tel ene feb abr ago sept oct nov dic".split()),
    "hi": frozenset(),
}
#: By language, words by which it is known.
COMMON = {
    "en": frozenset("the of and to in is has was that for with been".split()),
    "de": frozenset("der die das und ist wird den von mit nicht wurde bei".split()),
    "fr": frozenset("le la les des et est une dans par du pour été".split()),
    "es": frozenset("el la los las y del que una por con ha fue".split()),
}
#: What a single letter may name, so that it isn't an initial.
LABELS = frozenset("plan vitamin class type grade group option appendix annex phase model team zone step level klasse typ gruppe anhang plan classe groupe annexe clase tipo grupo anexo".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Thai: a statement ends after these, and starts with these.
THAI_ENDS = ("หรือไม่", "ทันที", "แล้ว", "ไหม", "ครับ", "ค่ะ", "นะ")
THAI_STARTS = ("หาก", "ถ้า", "เมื่อ", "ก่อน", "หลัง", "ระหว่าง", "ปลาย", "ต้น")
THAI_LONG = 16

_TERMINAL = regex.compile(r"[.!?…।॥\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]+")
_CLOSERS = regex.compile(r"[\p{Pe}\p{Pf}\"'”’»」』]*")
_QUOTED = regex.compile(r"„[^„“”\n]*[“”]|“[^“”\n]*”|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]*\"")
_ITEM = regex.compile(r"\s*[(]?\p{N}{1,4}[.．)、]?\s*")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}]+$|[\p{N}.,]+$")
_THAI_GAP = regex.compile(r"(?<=[฀-๿])[ ]+(?=[฀-๿])")
_ODD = regex.compile(r"[^\n\x20-\x7e¡-¬®-ſऀ-ॿ฀-๿‘-„…、-ヿ一-鿿！？，：；（）]")
_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_WORD_END = regex.compile(r"[\p{L}\p{M}]+(?=\s+$)")
_NUMBERED = regex.compile(r"\s*(?:[IVXLCDM]+\b|[A-Z]{1,4}[-–]?\d)")
_DEVANAGARI = regex.compile(r"\p{Devanagari}")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}]")


def _folded(text: str, table: dict[int, str]) -> tuple[str, list[int] | None]:
    """``text`` with look-alike characters as their prototypes and unseen ones gone; for each character, where it stands in ``text``."""
    if not _ODD.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        to = table.get(ord(c), c)
        kind = unicodedata.category(c)[0]
        if kind == "M" or kind in "PS" and not 0xFF01 <= ord(c) <= 0xFF5E or len(to) > 1 and not to.isalpha():
            to = c
        out.append(to)
        at += [i] * len(to)
    return "".join(out), at


def _starts(rest: str, k: int) -> str:
    """What the text after an end mark opens with: E nothing, U capital or opening mark, D digit, l lower case, C caseless letter, p other."""
    while k < len(rest) and rest[k].isspace():
        k += 1
    if k >= len(rest):
        return "E"
    c = rest[k]
    if c in "“„«「『¿¡‘\"":
        return "U"
    if c.isdigit():
        return "D"
    if c in "([（【":
        return "U"
    if c.isalpha():
        return "C" if _CASELESS.match(c) else "U" if c.isupper() or c.istitle() else "l" if c.islower() else "C"
    return "p"


def languages(text: str) -> tuple[str, ...]:
    """The languages whose abbreviations hold for a text: the one with most of its common words in it, Hindi for its script; all of them if nothing tells."""
    words = _WORDS.findall(text.lower())
    hits = {k: sum(w in common for w in words) for k, common in COMMON.items()}
    most = max(hits.values())
    if not most:
        return ("hi",) if _DEVANAGARI.search(text) else tuple(TITLES)
    return tuple(k for k, n in hits.items() if n == most) + (("hi",) if _DEVANAGARI.search(text) else ())


def _abbreviated(line: str, dot: int, nxt: str, gap: bool, known: tuple[str, ...]) -> bool:
    """Whether the full stop at ``dot`` belongs to what stands before it, in a text of the languages ``known``."""
    m = _WORD_BEFORE.search(line, max(0, dot - 24), dot)
    if not m:
        return False
    word, head = m[0], line[: m.start()]
    low = word.lower()
    before = head[-1:]
    if word[-1].isdigit() or word[0].isdigit():
        if nxt == "D" and not gap:
            return True
        if nxt in ("l", "D"):
            return nxt == "l" or not gap
        follow = regex.match(r"\s*(\p{L}+)", line[dot + 1 :])
        return bool(follow and follow[1].lower() in MONTHS)
    if nxt in ("U", "E") and (_unit(head) or before in ("°", "/")):
        return False  # a measure, as in "75 mm." or "9 l/min."
    if any(low in TITLES[k] for k in known):
        return True
    if any(low in REFERENCES[k] for k in known) and (nxt == "D" or nxt == "U" and _NUMBERED.match(line, dot + 1)):
        return True
    if len(word) == 1 and word.isalpha() and not _CASELESS.match(word):
        named = _WORD_END.search(head)
        return not (nxt == "U" and word.isupper() and named and named[0].lower() in LABELS)
    if any(low in SHORT[k] for k in known):
        return nxt != "U"
    if nxt in ("l", "C") and gap and not _CASELESS.match(word):
        return nxt == "l"
    if _DEVANAGARI.match(word):
        return len(word) == 1 or nxt == "D" and any(low in REFERENCES[k] for k in known)
    return not gap and nxt not in ("U", "E") or (not gap and nxt == "U" and len(word) < 2)


def _unit(head: str) -> bool:
    """Whether a number stands directly before: the letter after it is a unit."""
    return bool(regex.search(r"\d\s?$", head))


def _line_ends(line: str, known: tuple[str, ...]) -> list[int]:
    """Ends of the units of one line without a line break."""
    body = len(line.rstrip())
    if not body or not line.strip():
        return []
    line = line[:body]
    ends: list[int] = []
    quoted = [(m.start(), m.end()) for m in _QUOTED.finditer(line)]
    q, start = 0, 0
    for m in _TERMINAL.finditer(line):
        a, b = m.span()
        if b <= start:
            continue
        while q < len(quoted) and quoted[q][1] <= a:
            q += 1
        inside = q < len(quoted) and quoted[q][0] < a
        if inside:
            close = quoted[q][1]
            if line[b : close - 1].strip():
                continue  # more is said before the quotation ends
            end = _CLOSERS.match(line, close).end()
            nxt = _starts(line, end)
            if nxt == "E" or (nxt in ("U", "D") and end < body and line[end].isspace()):
                ends.append(end)
                start = end
            continue
        end = _CLOSERS.match(line, b).end()
        while q < len(quoted) and quoted[q][0] < end:  # a quotation that opens here isn't a closing mark
            end = min(end, max(b, quoted[q][0]))
            break
        nxt = _starts(line, end)
        gap = end < body and line[end].isspace()
        mark = m[0]
        if nxt == "E":
            ends.append(end)
            start = end
            continue
        if set(mark) <= {"…"} or mark in ("..", "..."):
            if nxt == "U" and gap:
                ends.append(end)
                start = end
            continue
        if mark[-1] in ".．" and set(mark) <= {".", "．"}:
            if _ITEM.fullmatch(line, start, b):
                continue
            if end == b and (nxt == "p" or _abbreviated(line, a, nxt, gap, known)):
                continue
            if end > b and nxt in ("l", "p"):
                continue
        elif nxt in ("l", "p") and mark[-1] in "!?":
            if nxt == "l" or not gap:
                continue
        ends.append(end)
        start = end
    # Thai: a gap between Thai letters where one statement ends and another starts
    if "฀" <= max(line) and regex.search(r"\p{Thai}", line):
        gaps = [m.span() for m in _THAI_GAP.finditer(line)]
        for k, (a, b) in enumerate(gaps):
            before = line[:a].rsplit(None, 1)[-1]
            after = line[b:].split(None, 1)[0]
            if _thai_end(before, after, k > 0 and gaps[k - 1][1] == a - len(before), k + 1 < len(gaps) and gaps[k + 1][0] == b + len(after)):
                ends.append(a)
    if body not in ends:
        ends.append(body)
    return sorted(set(ends))


def _thai_end(before: str, after: str, thai_before: bool, thai_after: bool) -> bool:
    if thai_before and len(before) < THAI_LONG or thai_after and len(after) < THAI_LONG:
        return False  # a single word between gaps
    if before.endswith(THAI_ENDS) or after.startswith(THAI_STARTS):
        return True
    return after.endswith("รุ่น") or len(after) >= THAI_LONG


def sentence_ends(text: str, table: dict[int, str] | None = None) -> list[int]:
    """Ends (exclusive) of the sentence units of ``text``, after closing marks and before space.

    A line break always ends a unit, blank lines have none, and the empty text has none.
    """
    folded, at = _folded(text, table or {})
    out, base, known = [], 0, languages(folded)
    for line in folded.split("\n"):
        out += [base + e for e in _line_ends(line, known)]
        base += len(line) + 1
    return out if at is None else sorted({at[e - 1] + 1 for e in out})


def _unit_rows(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(look_alikes(spark))  # bounded by Unicode's size

    def work(cols: dict, table: dict) -> dict:
        units = []
        for t in cols["text"].to_pylist():
            start, own = 0, []
            for e in sentence_ends(t, table):
                while start < e and t[start].isspace():
                    start += 1
                own.append((start, e))
                start = e
            units.append([{"start_char": a, "end_char": b} for a, b in own])
        return {"grp": cols["grp"], "record_id": cols["record_id"], "units": units}

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("grp"), F.col(key).alias("record_id"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)
    found = map_batches(rows, work, f"grp {kinds['grp']}, record_id {kinds['record_id']}, units array<struct<start_char: int, end_char: int>>", setup=lambda: shared.value)
    return found.select(F.col("grp").alias(group), "record_id", F.explode("units").alias("u")).select(group, "record_id", "u.start_char", "u.end_char")


def sentence_units(df: DataFrame, group: str, key: str, text: str = "content") -> DataFrame:
    """``group``, ``record_id``, ``start_char``, ``end_char`` of every unit of every distinct row.

    Null keys and texts are left out; a key with two texts has the units of both, those in the same
    place once; a unit starts after the space that follows the one before it.
    """
    return _unit_rows(df, group, key, text).distinct()


def sentence_end_rows(df: DataFrame, group: str, key: str, text: str = "content") -> DataFrame:
    """``group``, ``record_id``, ``end_char``: the ends alone."""
    return _unit_rows(df, group, key, text).select(group, "record_id", "end_char").distinct()
