"""Fields of one invoice text, found in a single walk over it.

An automaton finds all labels and phrases of all fields at once; small readers then look at what stands beside each
place: an amount, a date, a number. A reader moves forward over its own gap and value only, and looks back at most
``CONTEXT`` characters, so the time is linear in the text and nothing recurses, however odd the text is.

Values are cut out as text; columns of the job parse them (``extraction``).
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick

from triweave.functions.numbers import NOT_NUMBERS

# Labels of a field, the most trusted first.
GROSS_LABELS = ("łączna kwota brutto", "laczna kwota brutto", "wartość brutto", "wartosc brutto", "kwota brutto", "razem brutto", "total gross", "total", "brutto", "razem do zapłaty", "do zapłaty", "amount due")
NET_LABELS = ("total net", "wartość netto", "wartosc netto", "kwota netto", "netto", "net")
VAT_LABELS = ("total vat", "wartość vat", "wartosc vat", "kwota vat", "podatek vat", "vat amount", "tax amount", "podatek", "vat")
ISSUE_LABELS = ("data wystawienia", "wystawiono", "issue date", "invoice date")
SALE_LABELS = ("data sprzedaży", "data sprzedazy", "data wykonania usługi", "data wykonania uslugi", "sale date", "service date")
DUE_LABELS = ("data płatności", "data platnosci", "termin płatności", "termin platnosci", "due date", "date due", "payment due")
CURRENCY_LABELS = ("waluta", "currency", "currency code", "kod waluty", "kwota", "razem", "total", "amount", "do zapłaty", "do zaplaty")
# How currencies are written beside amounts, and in texts: as a whole word, or anywhere.
UNITS = ("pln", "eur", "usd", "gbp", "chf", "czk", "sek", "nok", "dkk", "zł", "€", "$", "£")
CODES = ("pln", "eur", "usd", "gbp", "chf", "czk", "sek", "nok", "dkk")
NAMED = {
    "EUR": (("€",), ("euro",)),
    "PLN": (("zł",), ("zl", "zlot", "zloty", "zlotych", "zlote", "złot", "złoty", "złotych", "złote")),
    "USD": (("$",), ("dolar", "dollar", "dollars")),
    "GBP": (("£",), ("pound", "funt")),
    "CHF": ((), ("frank", "franka", "franków")),
}
# Words before a number, and phrases after which a number is another document's.
CORRECTING = tuple(a + b for a in ("korygując", "korygujac") for b in "aey")
NUMBER_WORDS = ("no.", "no", "number")
OTHERS = ("do faktury", "dotyczy", "dotyczy faktury", "dot. faktury", "korekta do", "correction of invoice", "correction to invoice", "credit note for invoice", "credit note to invoice", "original invoice", "corrected invoice", "related invoice", "refers to invoice", "relates to invoice")
OTHER_KINDS = ("korygowana", "korygowanej", "pierwotna", "pierwotnej", "oryginalna", "oryginalnej")
BETWEEN = frozenset(("nr", "numer", "no", "number", "vat", "faktury", "faktura", "invoice", "korygującej", "korygujacej"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CONTEXT = 81  # characters before a number that may give it to another document
MOST_DIGITS = 16  # of an amount
GAP, LINE_SPAN = 30, 80  # characters between a label and its date; of a line behind a currency label

WIDE = "\u00a0\u202f"  # blanks that do not break a line
DIGITS, BLANKS, SPACES = frozenset("0123456789"), frozenset(" \t"), frozenset(" \t" + WIDE)
WORD_DATE = re.compile(r"([A-Za-z]{3,9})\s+([0-9]{1,2}),\s+([0-9]{4})")
NUMBER_CHARS = re.compile(r"[A-Za-z0-9][A-Za-z0-9/_.\-]{2,}")
WORDS = re.compile(r"\w+")

OTHER_PHRASES = frozenset(tuple(WORDS.findall(x)) for x in (*OTHERS, *(f"{a} {b}" for k in OTHER_KINDS for n in ("faktura", "faktury") for a, b in ((n, k), (k, n)))))
LONGEST = max(map(len, OTHER_PHRASES))


def fold(text: str) -> str:
    """Lower case, place for place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    words = {*GROSS_LABELS, *NET_LABELS, *VAT_LABELS, *ISSUE_LABELS, *SALE_LABELS, *DUE_LABELS, *CURRENCY_LABELS, *CODES}
    words |= {"numer", "faktur", "invoice", "nr", "credit", "nota", "korekta", "fv"} | {x for some in NAMED.values() for kind in some for x in kind}
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


class Text:
    """A text with its lines and the places of all labels."""

    def __init__(self, text: str):
        self.text, self.low = text, fold(text)
        self.n = len(text)
        self.starts = [0]
        self.starts += (m.end() for m in re.finditer("\n", text))
        self.at: dict[str, list[int]] = {}
        for end, word in automaton().iter(self.low):
            self.at.setdefault(word, []).append(end + 1 - len(word))

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def line(self, row: int) -> tuple[int, int]:
        """Start and end of a line, its break left out."""
        a = self.starts[row]
        z = self.starts[row + 1] - 1 if row + 1 < len(self.starts) else self.n
        return a, z - 1 if z > a and self.text[z - 1] == "\r" else z

    def skip(self, at: int, chars: Iterable[str], end: int) -> int:
        while at < end and self.text[at] in chars:
            at += 1
        return at

    def white(self, at: int) -> int:
        while at < self.n and self.text[at].isspace():
            at += 1
        return at

    def inner(self, at: int) -> bool:
        """Whether a word character stands at a place."""
        return 0 <= at < self.n and (self.text[at].isalnum() or self.text[at] == "_")

    def whole(self, word: str) -> Iterator[int]:
        """Places where ``word`` is not a part of a longer word."""
        for a in self.at.get(word, ()):
            if not (self.inner(a - 1) and self.inner(a)) and not (self.inner(a + len(word) - 1) and self.inner(a + len(word))):
                yield a


# ---- amounts


def digits(t: Text, at: int, end: int) -> int:
    return t.skip(at, DIGITS, end)


def decimal_end(t: Text, at: int, end: int) -> int:
    """End of an amount with two decimals that begins at a place, groups of thousands allowed; -1 if there is none."""
    s = t.text
    first = at + (at < end and s[at] == "-")
    last = digits(t, first, end)
    two = lambda p: p + 3 if p + 2 < end and s[p + 1] in DIGITS and s[p + 2] in DIGITS else -1
    if last == first:
        return -1
    if last - first <= 3:
        for group, point in ((" " + WIDE, ".,"), (".", ","), (",", ".")):
            p = last
            while p + 3 < end and s[p] in group and all(c in DIGITS for c in s[p + 1 : p + 4]):
                p += 4
            if p > last and p < end and s[p] in point and (z := two(p)) > 0:
                return z
    return two(last) if last < end and s[last] in ".," else -1


def unit_end(t: Text, at: int, end: int, brackets: bool = True) -> int:
    """End of a currency sign or code at a place, or the place itself."""
    if brackets and at < end and t.text[at] == "(":
        z = unit_end(t, at + 1, end, brackets=False)
        return z + 1 if z > at + 1 and z < end and t.text[z] == ")" else at
    return next((at + len(u) for u in UNITS if t.low.startswith(u, at) and at + len(u) <= end), at)


def ended(t: Text, at: int, end: int) -> bool:
    """Nothing but blanks up to the end of the line, or to a heading of an amount."""
    p = t.skip(at, SPACES, end)
    if p == end:
        return True
    return p > at and t.text[p - 1] in BLANKS and any(t.low.startswith(w, p) and not t.inner(p + len(w)) for w in ("net", "vat", "total"))


def amount_at(t: Text, at: int, end: int) -> tuple[str, bool] | None:
    """The amount that a stretch of a line consists of, and whether a currency stands beside it."""
    p = t.skip(at, SPACES, end)
    lead = unit_end(t, p, end)
    named = lead > p
    value = t.skip(lead, SPACES, end) if named else p
    z = decimal_end(t, value, end)
    if z < 0:
        first = value + (value < end and t.text[value] == "-")
        z = digits(t, first, end)
        if z == first:
            return None
    p = t.skip(z, SPACES, end)
    trail = unit_end(t, p, end, brackets=False)
    if trail > p and ended(t, trail, end):
        return t.text[value:z], True
    return (t.text[value:z], named) if ended(t, z, end) else None


def fits(value: str) -> bool:
    return sum(c in DIGITS for c in value) <= MOST_DIGITS


def is_term(t: Text, at: int) -> bool:
    """Whether a term of payment is named right before a place, as in ``terms: net 30``."""
    p = at
    while p and t.text[p - 1] in BLANKS:
        p -= 1
    p -= bool(p and t.text[p - 1] in ":-")
    while p and t.text[p - 1] in BLANKS:
        p -= 1
    return (t.low.endswith("terms", 0, p) and not t.inner(p - 6)) or t.low.endswith(("płatności", "platnosci"), 0, p)


def table_columns(t: Text) -> tuple[str | None, ...]:
    """Net, tax and total of the first TOTAL line below a heading NET, VAT, TOTAL; the heading may hold amounts itself."""
    for head in t.whole("net"):
        _, end = t.line(t.row(head))
        p = head
        for word in ("net", "vat", "total"):
            if not t.low.startswith(word, p) or t.inner(p + len(word)):
                break
            p += len(word)
            if word != "total":
                p = t.skip(p, SPACES, end)
                u = unit_end(t, p, end)
                p = t.skip(u, SPACES, end) if u > p else p
                d = decimal_end(t, p, end)
                p = t.skip(d, SPACES, end) if d > 0 else p
        else:
            for total in t.whole("total"):
                if total >= p and (found := total_row(t, total)):
                    return tuple(x if fits(x) else None for x in found)
            break
    return (None, None, None)


def total_row(t: Text, at: int) -> list[str] | None:
    start, _ = t.line(t.row(at))
    if t.skip(start, BLANKS, at) < at:
        return None
    p, out = at + len("total"), []
    colon = t.skip(p, BLANKS, t.n)
    p = colon + 1 if t.text.startswith(":", colon) else p
    for _ in range(3):
        a = t.skip(p, " \t\r\n", t.n)
        z = decimal_end(t, a, t.n)
        if a == p or z < 0:
            return None
        out.append(t.text[a:z])
        p = z
    p = t.skip(p, BLANKS, t.n)
    return out if p == t.n or t.text[p] == "\n" or t.text.startswith("\r\n", p) or (t.text[p] == "\r" and p + 1 == t.n) else None


def labelled_amount(t: Text, labels: tuple[str, ...], table: tuple[str | None, ...]) -> str | None:
    """Amount of the first label, in order of trust, that has one: in the table for the bare headings, right behind the label, or alone on the next line.

    A bare ``net`` may be a term of payment: it needs decimals or a currency.
    """
    for label in labels:
        if label not in t.at:
            continue
        column = {"net": 0, "vat": 1, "total": 2}.get(label)
        if column is not None and table[column] is not None:
            return table[column]
        bare = label in ("net", "netto")
        for a in t.whole(label):
            row = t.row(a)
            start, end = t.line(row)
            z = a + len(label)
            if z > end or (bare and is_term(t, a)):
                continue
            p = t.skip(z, SPACES, end)
            u = unit_end(t, p, end)
            named = u > p
            p = t.skip(u, SPACES, end) if named else p
            p += p < end and t.text[p] in ":="
            p = t.skip(p, SPACES, end)
            if p == end and t.white(start) >= a:
                if row + 1 == len(t.starts):
                    continue
                p, end = t.line(row + 1)
            found = amount_at(t, p, end)
            if found is None or not fits(found[0]):
                continue
            if bare and not (named or found[1] or "." in found[0] or "," in found[0]):
                continue
            return found[0]
    return None


# ---- dates


def date_end(t: Text, at: int) -> int:
    """End of a date in one of three shapes at a place, or -1."""
    s = t.text[at : at + 10]
    if len(s) == 10:
        ok = lambda some: all(s[k] in DIGITS for k in some)
        if (s[4] == s[7] == "-" and ok((0, 1, 2, 3, 5, 6, 8, 9))) or (s[2] in "./-" and s[5] in "./-" and ok((0, 1, 3, 4, 6, 7, 8, 9))):
            return at + 10
    m = WORD_DATE.match(t.text, at)
    return m.end() if m else -1


def is_date(x: str) -> bool:
    """Whether a day of the calendar is written, in a shape that is read."""
    try:
        if x[0].isalpha():
            name, day, year = WORD_DATE.match(x).groups()
            month = next((k for k, m in enumerate(MONTHS, 1) if name.lower() in (m, m[:3])), 0)
            dt.date(int(year), month, int(day))
        elif x[4] == "-":
            dt.date.fromisoformat(x)
        else:
            a, b, year = int(x[:2]), int(x[3:5]), int(x[6:])
            if x[2] != x[5]:
                return False
            a, b = (b, a) if b > 12 and x[2] != "." else (a, b)
            dt.date(year, b, a)
    except ValueError:
        return False
    return True


def labelled_date(t: Text, labels: tuple[str, ...]) -> str | None:
    """Date behind the first label, in order of trust, whose first date is one of the calendar."""
    for label in labels:
        for a in t.at.get(label, ()):
            p = z = a + len(label)
            while p < t.n and p - z <= GAP and not (t.text[p].isascii() and t.text[p].isalnum()):
                p += 1
            end = date_end(t, p) if p - z <= GAP else -1
            if end > 0:
                if is_date(t.text[p:end]):
                    return t.text[p:end]
                break
    return None


def first_date(t: Text) -> str | None:
    """First date of the calendar anywhere: ISO dates first, then numeric ones, then those with a month name."""
    for shape in (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}\b", r"\b[A-Za-z]{3,9}\s+[0-9]{1,2},\s+[0-9]{4}\b"):
        for m in re.finditer(shape, t.text):
            if is_date(m[0]):
                return m[0]
    return None


# ---- numbers


def number_behind(t: Text, at: int, slots: tuple[tuple[str, ...], ...], blank: bool = False) -> tuple[int, int] | None:
    """Place of a number behind optional words, one of each slot; as many words as leave a number are read.

    ``blank``: only blanks and tabs may stand before the word.
    """
    if slots:
        p = t.skip(at, BLANKS, t.n) if blank else t.white(at)
        for word in slots[0]:
            if t.low.startswith(word, p) and (found := number_behind(t, p + len(word), slots[1:])):
                return found
        return number_behind(t, p, slots[1:])
    p = at
    while p < t.n and (t.text[p].isspace() or t.text[p] in ":#-"):
        p += 1
    m = NUMBER_CHARS.match(t.text, p)
    return m.span() if m else None


def after_words(t: Text, at: int, *words: str) -> int:
    """Behind words with white space between them, or -1."""
    for k, w in enumerate(words):
        p = t.white(at) if k else at
        if (k and p == at) or not t.low.startswith(w, p):
            return -1
        at = p + len(w)
    return at


def places(t: Text) -> Iterator[Iterator[tuple[int, tuple[int, int] | None]]]:
    """Where numbers stand, the most trusted kind first: place of the lead, and of the number behind it."""
    number = ("nr", "numer")
    yield ((a, number_behind(t, z, ()) if (z := after_words(t, a, "numer", "faktury")) > 0 else None) for a in t.at.get("numer", ()))
    yield ((a, own_line(t, a)) for a in t.at.get("invoice", ()))
    yield ((a, faktura(t, a + len("faktur"), number)) for a in t.at.get("faktur", ()))
    both = sorted([(a, "nr") for a in t.at.get("nr", ())] + [(a, "invoice") for a in t.at.get("invoice", ())])
    yield ((a, number_behind(t, a + len(w), (NUMBER_WORDS,)) if w == "invoice" else number_behind(t, p + len("faktury"), ()) if t.low.startswith("faktury", p := t.white(a + 2)) else None) for a, w in both)
    notes = sorted((a, w) for w in ("credit", "nota", "korekta") for a in t.at.get(w, ()) if not t.inner(a - 1))
    yield ((a, number_behind(t, z, ((*NUMBER_WORDS, *number),), blank=True) if (z := note_end(t, a, w)) > 0 else None) for a, w in notes)
    yield ((a, number_behind(t, a + 2, ())) for a in t.at.get("fv", ()) if not t.inner(a - 1))


def faktura(t: Text, at: int, number: tuple[str, ...]) -> tuple[int, int] | None:
    slots = (("vat",), CORRECTING, number)
    if t.low.startswith(("a", "y"), at) and (found := number_behind(t, at + 1, slots)):
        return found
    return number_behind(t, at, slots)


def note_end(t: Text, at: int, word: str) -> int:
    if word == "korekta":
        return at + len(word)
    if word == "credit":
        return after_words(t, at, "credit", "note")
    return next((z for c in CORRECTING if (z := after_words(t, at, "nota", c)) > 0), -1)


def own_line(t: Text, at: int) -> tuple[int, int] | None:
    """A number that fills the line of ``invoice number``."""
    start, _ = t.line(t.row(at))
    if at - start > LINE_SPAN or t.text[start:at].strip():
        return None
    p = t.skip(at + len("invoice"), BLANKS, t.n)
    for word in NUMBER_WORDS:
        if t.low.startswith(word, p):
            m = NUMBER_CHARS.match(t.text, t.skip(p + len(word), " \t:#-", t.n))
            if m:
                _, end = t.line(t.row(m.end()))
                if not t.text[m.end() : min(end, m.end() + LINE_SPAN)].strip() and end - m.end() <= LINE_SPAN:
                    return m.span()
    return None


def clean(x: str) -> str:
    return x.strip().strip(":#.,").replace("_", "/").upper()


def valid(x: str) -> bool:
    return len(x) >= 3 and any(c in DIGITS for c in x) and x not in NOT_NUMBERS


def of_another(t: Text, at: int) -> bool:
    """Whether a phrase right before a number gives it to another document."""
    start = max(0, at - CONTEXT)
    before = t.low[start:at]
    words = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(before)]
    edge = len(before)
    while words:
        a, z, last = words[-1]
        if any(not c.isspace() and c not in ":#.-" for c in before[z:edge]):
            return False
        for n in range(1, min(LONGEST, len(words)) + 1):
            phrase = tuple(w for *_, w in words[-n:])
            gaps = [before[x[1] : y[0]] for x, y in zip(words[-n:], words[-n + 1 :] if n > 1 else (), strict=False)]
            if phrase in OTHER_PHRASES and all((g.startswith(".") and not g[1:].strip()) if w == "dot" else not g.strip() for g, w in zip(gaps, phrase, strict=False)):
                return True
        if last not in BETWEEN:
            return False
        edge = a
        words.pop()
    return False


def invoice_number(t: Text) -> str | None:
    """The document's own number; one that a phrase gives to another document only if there is no other."""
    spare = None
    for kind in places(t):
        read_to = 0
        for a, span in kind:
            if span is None or a < read_to:
                continue
            read_to = span[1]
            number = clean(t.text[span[0] : span[1]])
            if not valid(number):
                continue
            if not of_another(t, span[0]):
                return number
            spare = spare or number
    return spare


# ---- currency


def currencies(t: Text) -> list[tuple[int, int, str, int]]:
    """Place, end, code and rank of all currencies of a text; codes come before names."""
    found = [(a, a + 3, c.upper(), 0) for c in CODES if c in t.at for a in t.whole(c)]
    for rank, (code, (signs, words)) in enumerate(NAMED.items(), 1):
        found += [(a, a + len(w), code, rank) for w in signs for a in t.at.get(w, ())]
        found += [(a, a + len(w), code, rank) for w in words for a in t.whole(w)]
    return sorted(found)


def currency(t: Text) -> str | None:
    """Currency on the line of a label, else anywhere; of several the code that stands first, else the first kind of name."""
    found = currencies(t)
    if not found:
        return None
    at = [f[0] for f in found]

    def best(a: int, z: int) -> str | None:
        some = [f for f in found[bisect_left(at, a) : bisect_left(at, z)] if f[1] <= z]
        return min(some, key=lambda f: (f[3], f[0]))[2] if some else None

    for label in CURRENCY_LABELS:
        read_to = 0
        for a in t.at.get(label, ()):
            if a < read_to:
                continue
            _, end = t.line(t.row(a))
            read_to = min(max(end, a + len(label)), a + len(label) + LINE_SPAN)
            if code := best(a, read_to):
                return code
    return min(found, key=lambda f: (f[3], f[0]))[2]


def header(t: Text, name: str) -> str | None:
    """Value of a mail header line; it may begin on a later line."""
    for m in re.finditer(rf"(?im)^{name}:", t.text):
        p = t.white(m.end())
        value = t.text[p : t.line(t.row(p))[1]].strip() if p < t.n else ""
        if value:
            return value
    return None
