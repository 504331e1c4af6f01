"""Personal data: plain forms, and disguised forms found on a normalised copy with mapped offsets.

Plain forms are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. Three
small transducers then write a normalised copy of the text, each output character with the source
span it stands for: look-alike letters, digits and signs become ASCII; runs of spelled digits become
digits; bracketed or spelled ``at`` / ``dot`` become ``@`` and ``.``. What is found there only, and
does not overlap a plain find of its kind, is mapped back to source characters.

Spelled ``dot``, then also ``at``, are rewritten on tapes of their own in any case and any mix with signs;
an address found there counts only if it is sound as a whole: no article as host, a last label of
letters after a written ``@``, and after a bare "at" a spelled dot or a known last label. Digit words
mix with groups of digits after a plus (8 to 15 digits) and in card numbers (Luhn); without a plus a phone
number takes at least ``MIN_SPELLED`` digit words, so that prose stays as it is.

Rows: null and empty texts have no spans. Long texts are read whole, in linear time. Repeated rows
and null ids are kept. Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtide.llm.common import per_value, struct_of

KINDS = ("email", "ip", "card", "phone")
MIN_SPELLED = 7
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic and Greek letters, signs and digits that look like ASCII ones.
LOOK_ALIKE = str.maketrans({
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "․": ".", "。": ".", "·": ".", " ": " ", " ": " ", " ": " ", "​": "",
    "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
})
# Digit words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
DIGIT_WORD = r"(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9])"
SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[\x20-]?)?{DIGIT_WORD}(?:[\x20,.\n-]{{1,2}}{DIGIT_WORD}){{{MIN_SPELLED - 1},}}(?![^\W_])", re.I)
WORD_OF_RUN = re.compile(rf"plus|\+|{DIGIT_WORD}", re.I)
BRACKETED = re.compile(r"[\x20]?[\[({<][\x20]?(at|dot|ät|punkt|arroba|punto|arobase|point|@|\.)[\x20]?[\])}>][\x20]?", re.I)
MIXED_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[\x20(-]{{0,2}})?(?:{DIGIT_WORD}|[0-9]++)(?:[\x20,.\n()-]{{1,3}}(?:[0-9]++|{DIGIT_WORD})(?![^\W_]))+", re.I)
PART_OF_MIXED = re.compile(rf"plus|\+|[0-9]+|{DIGIT_WORD}", re.I)
SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9-])\x20dot\x20(?=[A-Za-z0-9-])", re.I | re.A)
SPOKEN_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])\x20at\x20(?=[A-Za-z0-9-]++(?:\.|\x20dot\x20)[A-Za-z0-9-])", re.I | re.A)
AT_WORDS = {"at", "ät", "arroba", "arobase", "@"}
# Last labels that make a host after a bare "at", and words before one that are no name.
LAST_LABELS = set("com org net edu gov mil int info biz name io ai app dev co me tv eu uk us ca au nz ie de at ch fr be nl lu it es pt "
                  "pl cz sk hu ro bg gr se no dk fi is ee lv lt ru ua by tr il in pk cn jp kr tw hk sg my th vn id ph br mx ar cl pe za ng "
                  "ke eg ma example test".split())
NO_NAME = set("look looked looking me us him her them it be is are was were available found hosted visit visited here there online site "
              "website page located and or sold listed more details".split())
NO_HOST = {"the", "a", "an", "this", "that", "my", "our", "your", "their", "its"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards so that long runs cost no second look."""
    found, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
        upto = host.end() if host else at + 1
        at = text.find("@", upto)
    return found


def small_enough(parts: list[str]) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in parts)


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the plain forms by kind, in order; matches that fail the check are dropped."""
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in IP.finditer(text) if small_enough(m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16
                 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15] if "+" in text else [],
    }


class Tape:
    """A text under rewriting, each character with the source span that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts each edit's string in place of characters first to last; edits ascend, without overlap.

        An output of one character stands for the whole source of its edit, of several for it, too.
        """
        if not edits:
            return
        pieces, starts, ends, upto = [], [], [], 0
        for first, last, new in edits:
            pieces += [self.text[upto:first], new]
            starts += [*self.start[upto:first], *[self.start[first]] * len(new)]
            ends += [*self.end[upto:first], *[self.end[last - 1]] * len(new)]
            upto = last
        self.text = "".join([*pieces, self.text[upto:]])
        self.start, self.end = [*starts, *self.start[upto:]], [*ends, *self.end[upto:]]

    def source(self, first: int, last: int) -> tuple[int, int]:
        return min(self.start[first:last]), max(self.end[first:last])


def ascii_edits(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes and full-width forms, wherever they stand beside or between identifier characters."""
    edits = []
    for m in re.finditer(r"[^\x00-\x7F]", text):
        c = m.group()
        new = c.translate(LOOK_ALIKE)
        if new == c:
            new = unicodedata.normalize("NFKC", c)
        if new != c and new.isascii() and len(new) <= 1:
            edits.append((m.start(), m.end(), new))
    return edits


def disguise_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(*m.span(), "@" if m.group(1).lower() in AT_WORDS else ".") for m in BRACKETED.finditer(text)]
    kept, upto = [], 0
    for edit in sorted(edits):
        if edit[0] >= upto:
            kept.append(edit)
            upto = edit[1]
    return kept


def spoken(text: str, tape: Tape) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Source spans of sound addresses with spelled dots, and with spelled dots and ats; and of IP addresses with spelled dots."""
    found, ips = [], []
    dots = [(*m.span(), ".") for m in SPOKEN_DOT.finditer(tape.text)]
    if dots:
        only_dots = copy_of(tape)
        only_dots.rewrite(dots)
        found += sound_emails(text, only_dots)
        ips += [only_dots.source(*place) for place in plain_spans(only_dots.text)["ip"]]
    ats = [(*m.span(), "@") for m in SPOKEN_AT.finditer(tape.text)]  # read while the dots are words
    if ats:
        both = copy_of(tape)
        both.rewrite(sorted(dots + ats))
        found += sound_emails(text, both)
    return found, ips


def copy_of(tape: Tape) -> Tape:
    out = Tape(tape.text)
    out.start, out.end = tape.start, tape.end
    return out


def sound_emails(text: str, tape: Tape) -> list[tuple[int, int]]:
    found = []
    for first, last in emails(tape.text):
        at = tape.text.index("@", first)
        labels = tape.text[at + 1:last].lower().split(".")
        if labels[0] in NO_HOST:
            continue
        if text[tape.start[at]:tape.end[at]].strip().lower() == "at":
            spelled = any(tape.text[n] == "." and tape.end[n] - tape.start[n] > 1 for n in range(at, last))
            sound = spelled or labels[-1] in LAST_LABELS and tape.text[first:at].lower() not in NO_NAME
        else:
            sound = len(labels[-1]) > 1 and labels[-1].isalpha() and labels[-1] not in NO_HOST
        if sound:
            found.append(tape.source(first, last))
    return found


def mixed_runs(text: str) -> list[tuple[int, int]]:
    """Digit words and groups of digits in a run that are a phone number after a plus, or a card number, or, from a digit word
    to the end of the run, enough digit words for a phone number. A number may start at any part of its run; of those from one
    part on the longest counts. No number has over 19 digits, so a start looks at that many parts at most."""
    found = []
    for m in MIXED_RUN.finditer(text):
        parts = [(w.start(), w.end(), w.group().lower()) for w in PART_OF_MIXED.finditer(text, *m.span())]
        spelled_run = any(len(WORD_OF_RUN.findall(s.group())) >= 8 for s in SPELLED_RUN.finditer(text, *m.span()))
        at = 0
        while at < len(parts):
            plus = parts[at][2] in ("plus", "+")
            digits, words, last = "", 0, None
            for n in range(at + plus, len(parts)):
                if parts[n][2] in ("plus", "+"):
                    break
                digits += SPELLED.get(parts[n][2], parts[n][2])
                words += parts[n][2] in SPELLED
                if len(digits) > 19:
                    break
                if words and (8 <= len(digits) <= 15 if plus else len(digits) >= 16 and luhn(digits)):
                    last = n
                elif (not plus and n == len(parts) - 1 and parts[at][2] in SPELLED and words >= MIN_SPELLED
                      and 8 <= len(digits) <= 15 and not spelled_run):
                    last = n
            if last is not None:
                found.append((parts[at][0], parts[last][1]))
            at = at + 1 if last is None else last + 1
    return found


def spelled_edits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Edits that turn digit words into digits, and the runs (in output positions) they make."""
    edits, runs, shift = [], [], 0
    mixed = mixed_runs(text)
    places = [(*place, True) for place in mixed]
    places += [(*m.span(), False) for m in SPELLED_RUN.finditer(text) if not any(a < m.end() and m.start() < b for a, b in near(mixed, *m.span()))]
    for start, end, sound in sorted(places):
        words = [(w.span(), w.group().lower()) for w in WORD_OF_RUN.finditer(text, start, end)]
        if not sound:
            while words and words[0][1].isdigit():  # a figure before the first digit word counts something else
                words.pop(0)
            if sum(len(w) > 1 for _, w in words) < MIN_SPELLED:
                continue
            start = words[0][0][0]
        new = "".join(["+" if w in ("plus", "+") else SPELLED.get(w, w) for _, w in words])
        first = start + shift
        for n, ((a, b), _) in enumerate(words):  # each word with the gap before it
            edits.append((words[n - 1][0][1] if n else a, b, new[n]))
        shift += len(new) - (end - start)
        runs.append((first, first + len(new)))
    return edits, runs


def spans(text: str | None) -> list[dict]:
    """All spans of a text as kind, start, end, plain; by kind, then start."""
    if not text:
        return []
    found = plain_spans(text)
    more = {kind: [] for kind in KINDS}
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(ascii_edits(tape.text))
    tape.rewrite(disguise_edits(tape.text))
    for kind, places in zip(("email", "ip"), spoken(text, tape)):
        more[kind] += places
    edits, runs = spelled_edits(tape.text)
    tape.rewrite(edits)
    if tape.text != text:
        for kind, places in plain_spans(tape.text).items():
            more[kind] += [tape.source(*place) for place in places]
        for first, last in runs:
            digits = digits_of(tape.text[first:last])
            if 16 <= len(digits) <= 19 and luhn(digits):
                more["card"].append(tape.source(first, last))
            elif 8 <= len(digits) <= 15:
                more["phone"].append(tape.source(first, last))
    rows = []
    for kind in KINDS:
        own = [(a, b, True) for a, b in found[kind]]
        held = sorted(found[kind])
        for a, b in sorted(set(more[kind]), key=lambda place: (place[0], -place[1] if kind == "email" else place[1])):
            if not any(a < d and c < b for c, d in near(held, a, b)):
                own.append((a, b, False))
                insort(held, (a, b))
        rows += [{"kind": kind, "start": a, "end": b, "plain": plain} for a, b, plain in sorted(own)]
    return rows


def near(places: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of the sorted, disjoint places that may overlap start to end."""
    at = bisect_left(places, (start, start))
    stop = bisect_left(places, (end, end))
    return places[max(0, at - 1):stop + 1]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, plain>>) for every row; offsets are code points."""
    kind = pa.list_(struct_of(kind=pa.string(), start=pa.int64(), end=pa.int64(), plain=pa.bool_()))
    found = per_value(docs.sparkSession, lambda: spans,
                      "array<struct<kind: string, start: bigint, end: bigint, plain: boolean>>", kind)
    return docs.select(F.col(id_col), found(F.col(text_col)).alias("spans"))
