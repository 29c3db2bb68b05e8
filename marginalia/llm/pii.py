"""Personal information in free text by weak supervision.

Broad patterns propose spans; labelers (formats, gazetteers, words of context) vote on each; expectation
maximisation estimates from the votes alone how reliable every labeler is and how likely each span is a true
one; on those likelihoods a logistic span classifier is trained for each kind, which also sees the words around.
The classifier then judges every span, and of accepted spans that exclude each other the better judged one stands.
Contexts, reliabilities and classifiers are learned from all documents: what is counted are contexts, patterns of votes and
equal rows of features, so spans don't come to the driver one by one.

What stands before and after a person isn't listed here but learned: people of the gazetteer and names after a form of address are the seeds, and
the contexts in which much of what is proposed are seeds speak for a name, those in which none ever is against. Contexts that
speak for a name also propose the words behind them, however these are written.

Texts are read through a translation of single characters (odd blanks, hyphens, full-width forms), so
places in it are places in the text.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from dataclasses import dataclass, field, replace
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import cut_lineage, is_at_most

KINDS = ("email", "phone", "idnumber", "address", "name")
#: Contexts or rows of features that a task counts before it gives their counts away and begins anew.
COUNTED = 100_000
#: Distinct rows of features that the driver fits classifiers to by itself; more are left where they are and give their slopes in each round.
FIT_ROWS = 400_000
#: Rows a gazetteer may have; it is broadcast.
GAZETTEER_ROWS = 200_000
#: Buckets of the words around a span.
BUCKETS = 512

#: Blanks, hyphens and full-width forms, and what they are read as.
_READ_AS = {
    **dict.fromkeys(map(ord, "\xa0              　"), " "),
    **dict.fromkeys(map(ord, "‐‑‒–—―−﹣－"), "-"),
    **{0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0x21 + i) in "()+./:@" or chr(0x21 + i).isalnum()},
}

#: Forms of address; words of streets in four languages.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "mme", "mlle", "frau", "herr", "sra", "sr", "señor", "señora", "mx")
STREET_WORDS = (
    "Alley", "Avenue", "Ave", "Boulevard", "Blvd", "Broadway", "Circle", "Close", "Court", "Ct", "Crescent", "Drive", "Dr", "Gardens", "Green", "Grove", "Highway", "Hill", "Lane", "Ln", "Loop", "Mews", "Parade", "Park", "Parkway",
    "Place", "Pl", "Plaza", "Promenade", "Quay", "Rise", "Road", "Rd", "Row", "Square", "Sq", "Street", "St", "Terrace", "Trail", "View", "Walk", "Way", "Wharf", "Yard",
)
FRENCH_STREETS = ("allée", "avenue", "boulevard", "chemin", "cours", "impasse", "place", "quai", "route", "rue", "square")
SPANISH_STREETS = (r"Avda\.", "Avenida", "C/", "Calle", "Camino", "Carrera", "Paseo", "Plaza")
GERMAN_STREETS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm")
#: Words of four languages that begin sentences or lead nouns but are no given names.
NO_GIVEN = frozenset(
    "a after all an and another any as ask at before below both but by call did each every for from if in is it its many my no not of on one only or our please product regards see since so some thank thanks that the "
    "their then there these they this those to two under until we what when where which while who why with you your am auf aus bei das dem den der des die ein eine für im ist marke mit nach produkt seit und unter von "
    "wir zu zum zur au aux avec ce cette chez dans de depuis des du en et la le les marque nous par pour produit sur un une con del desde el las los marca para por producto se una y".split()
)
#: Words of four languages behind which, and verbs before which, a person may stand in any sentence.
NAME_NEAR = frozenset("and asked bei con für gracias gave met mit para saw thank thanks told to und von with".split())
PERSON_VERBS = frozenset("asked called fixed gave merged met moved said says sent spoke thinks told wants wrote".split())
PLACE_WORDS = frozenset(w.lower().rstrip(".") for w in (*STREET_WORDS, *FRENCH_STREETS, *GERMAN_STREETS, "Avda", "Avenida", "Calle", "Camino", "Carrera", "Paseo", "North", "South", "East", "West", "Old", "New", "Upper", "Lower")) - {"dr", "st"}
#: Words that announce a kind of number or place, or another kind of number.
MAIL_CUES = ("contact", "courriel", "email", "e-mail", "mail", "reachable", "メール")
PHONE_CUES = ("alt", "au", "call", "durchwahl", "fax", "mobile", "on", "phone", "tel", "telefon", "telephone", "unter", "電話")
ID_CUES = ("ausweisnr", "card", "dni", "documento", "id", "identity", "insurance", "national", "nie", "nif", "nino", "no", "number", "passport", "reisepass", "social", "ssn", "steuer", "tax", "verified")
ADDRESS_CUES = ("address", "adresse", "at", "dirección", "en", "lives", "of", "to")
NUMBER_CUES = ("barcode", "batch", "build", "digest", "invoice", "job", "lot", "order", "parcel", "ref", "release", "route", "row", "sku", "ticket", "version", "window")

#: Seeds that a context must hold at least, and the share of seeds among what stands in it, to speak for a name; candidates
#: without a seed that make a context speak against one. Tokens of a context at most.
SEEDS, SEED_SHARE, SEEDLESS, CONTEXT = 3, 0.3, 20, 4
#: Documents for which the labelers' prior counts stand once. They grow with the documents: otherwise in large tables they count for nothing, and where
#: nearly all that is proposed is true the likelihoods part true spans by how they are announced.
PRIOR_DOCUMENTS = 8_192
#: Families that a gazetteer must list for an ending unknown to it to speak against a name.
TELLING = 50

_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _READ_AS))) + "]")


def read(text: str) -> str:
    """The text with odd characters read as plain ones; every place stays what it is."""
    return text if text.isascii() else _ODD.sub(lambda m: _READ_AS[ord(m.group())], text)


class _Lower(dict):
    """Characters in lower case where that is one character."""

    def __missing__(self, c: int) -> str:
        x = chr(c).lower()
        self[c] = x if len(x) == 1 else chr(c)
        return self[c]


_LOWER = _Lower()


@dataclass
class Span:
    """A proposal. before, after: for names, what stands there, from the shortest on; seed: a listed person or a form of address; led: only its context proposes it."""

    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    around: tuple[str, ...]
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    seed: bool = False
    led: bool = False


_DIGIT = re.compile(r"\d")


def _shape(word: str) -> str:
    return word.lower() if word.isalpha() else _DIGIT.sub("#", word.lower())


_LEFT = re.compile(r"[^\W_]+(?:_[^\W_]+)*|[^\w\s]")
_CONTEXT = re.compile(r"[^\W_]+(?:_[^\W_]+)*|[^\w\s]|\n")


def _tokens_before(text: str, start: int, n: int, pattern: re.Pattern) -> list[tuple[int, str]]:
    """(place, token) of the last n tokens before a place, the nearest first, however far they lie."""
    reach = 10 * n
    while True:
        low = max(0, start - reach)
        found = [(m.start(), m.group()) for m in pattern.finditer(text, low, start)]
        if low == 0 or len(found) > n:  # one more than needed: the first may be cut off
            return found[-n:][::-1]
        reach *= 8


def _words_before(text: str, start: int, n: int = 3) -> list[str]:
    return [_shape(w) for _, w in _tokens_before(text, start, n, _LEFT)]


def _words_after(text: str, end: int, n: int = 2) -> list[str]:
    out = []
    for m in _LEFT.finditer(text, end):
        out.append(_shape(m.group()))
        if len(out) == n:
            break
    return out


def _cue(words: list[str], cues) -> bool:
    return any(w in cues for w in words)


class _Taken:
    """Disjoint stretches of a text that may not be used again."""

    def __init__(self, stretches: list[tuple[int, int]]) -> None:
        self.ends: list[int] = []
        self.starts: list[int] = []
        for a, b in sorted(stretches):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __contains__(self, span: Span) -> bool:
        i = bisect_right(self.ends, span.start)
        return i < len(self.ends) and self.starts[i] < span.end


@dataclass(frozen=True)
class Contexts:
    """What is learned of what stands around names: texts before and after that speak for one, and such that speak against.

    leading: those before that propose what follows them, however it is written.
    """

    before: frozenset = frozenset()
    after: frozenset = frozenset()
    not_before: frozenset = frozenset()
    not_after: frozenset = frozenset()
    leading: frozenset = frozenset()

    def votes(self, before: tuple[str, ...], after: tuple[str, ...]) -> tuple[int, int]:
        left = 1 if before and (before[0].strip().lower() in NAME_NEAR or not self.before.isdisjoint(before)) else -1 if before and before[0] in self.not_before else 0
        right = 1 if after and (after[0] in PERSON_VERBS or not self.after.isdisjoint(after)) else -1 if after and after[0] in self.not_after else 0
        return left, right

    def keeps(self, span: Span) -> bool:
        """Whether a span stands without its context, or the context is one of those that may propose."""
        return not span.led or not self.leading.isdisjoint(span.before)


def _count_led(contexts: Contexts, places: Iterable[tuple[tuple[str, ...], bool]], every: Counter, seeds: Counter) -> None:
    """Count, of (before, seed) of each name, the contexts that speak for one."""
    for before, seed in places:
        own = contexts.before.intersection(before)
        every.update(own)
        if seed:
            seeds.update(own)


def _leading(contexts: Contexts, every: Counter, seeds: Counter) -> Contexts:
    """The contexts that propose: of all they have proposed, seeds have their share."""
    return replace(contexts, leading=frozenset(c for c in contexts.before if seeds[c] >= SEED_SHARE * every[c] > 0))


def settled(contexts: Contexts, spans: list[Span]) -> tuple[Contexts, list[Span]]:
    """The contexts with those that may propose, and the spans without what the others proposed."""
    every, seeds = Counter(), Counter()
    _count_led(contexts, ((s.before, s.seed) for s in spans if s.kind == "name"), every, seeds)
    contexts = _leading(contexts, every, seeds)
    return contexts, [s for s in spans if contexts.keeps(s)]


def learned(spans: Iterable[Span]) -> Contexts:
    """Contexts from proposed names, those of listed people and after forms of address being the seeds. Without seeds there are none.

    All that speak for a name propose at first; ``_leading`` then tells which of them may go on to.
    """
    counts: Counter = Counter()
    for s in spans:
        _count_contexts(s, counts)
    return _speaking(counts)


def _count_contexts(span: Span, counts: Counter) -> None:
    """Count a name's contexts by (side, context, whether it is a seed's); the context None counts the name itself."""
    for side, own in ((0, span.before), (1, span.after)):
        for c in (None, *own):
            counts[side, c, span.seed] += 1


def _speaking(counts: dict[tuple[int, str | None, bool], int]) -> Contexts:
    made: list[frozenset] = []
    for side in (0, 1):
        seeds = {c: n for (at, c, seed), n in counts.items() if at == side and seed}
        every = Counter(seeds)
        for (at, c, seed), n in counts.items():
            if at == side and not seed:
                every[c] += n
        good = {c for c, n in seeds.items() if c is not None and n >= SEEDS and n >= SEED_SHARE * every[c]}
        bad = {c for c, n in every.items() if c is not None and n >= SEEDLESS and c not in seeds} if seeds else set()
        made += [frozenset(good), frozenset(bad)]
    return Contexts(made[0], made[2], made[1], made[3], made[0])


class Finder:
    """Proposes spans in a text, each with its labelers' votes: 1 for, -1 against, 0 none."""

    #: Number of labelers of each kind.
    LABELERS = {"email": 4, "phone": 5, "idnumber": 5, "address": 4, "name": 9}

    def __init__(self, people: list[tuple[str | None, str | None]], brands: list[str | None] = (), contexts: Contexts = Contexts()) -> None:
        norm = lambda x: " ".join(read(x or "").lower().split())
        self.contexts = contexts
        self.people = {(norm(g), norm(f)) for g, f in people}
        self.given, self.family = {g for g, _ in self.people} - {""}, {f for _, f in self.people} - {""}
        self.initials = {(g[:1], f) for g, f in self.people}
        self.brands = {norm(b) for b in brands} - {""}
        last = Counter(b.replace("-", " ").split()[-1] for b in self.brands if len(b.replace("-", " ").split()) > 1)
        #: Words that several brands end in.
        self.brand_words = {w for w, n in last.items() if n >= 2}
        #: Endings of three and of two letters that families often have.
        self.endings, self.short_endings = ({e for e, n in Counter(f[-k:] for f in self.family).items() if n >= max(2, len(self.family) // 100)} for k in (3, 2))
        #: Listed people, however they are written, and texts behind which names stand.
        self.listed = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for g, f in self.people:
            if g and f:
                self.listed.add_word(f"{g} {f}", len(g) + 1 + len(f))
                self.listed.add_word(f"{f}, {g}", len(g) + 2 + len(f))
        self.led = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for c in contexts.leading:
            self.led.add_word(c, len(c))
        for automaton in (self.listed, self.led):
            if len(automaton):
                automaton.make_automaton()

    def with_contexts(self, contexts: Contexts) -> Finder:
        made = copy(self)
        made.__init__(list(self.people), list(self.brands), contexts)
        return made

    def spans(self, text: str | None, accepts: Callable[[Span], bool] | None = None) -> list[Span]:
        """All proposed spans; null, empty and blank texts have none.

        A phone number that overlaps an identity number is left out: one that ``accepts`` takes, or, to train on, any.
        """
        return _freed(self.proposed(text), accepts)

    def proposed(self, text: str | None) -> list[Span]:
        """All proposed spans, phone numbers that overlap identity numbers among them."""
        if not text or text.isspace():
            return []
        t = read(text)
        emails = list(self.emails(t))
        return emails + list(self.idnumbers(t)) + list(self.addresses(t)) + list(self.phones(t)) + self.names(t, emails)

    def completed(self, text: str | None, spans: list[Span]) -> list[Span]:
        """What ``proposed`` gives, from the spans that a finder without contexts has proposed."""
        names = [s for s in spans if s.kind == "name"]
        for s in names:
            s.votes = (*s.votes[:3], *self.contexts.votes(s.before, s.after), *s.votes[5:])
        t, pairs = self._more(text, names)
        return spans + self._names(t, pairs, [s for s in spans if s.kind == "email"])

    def leads(self, text: str | None, spans: list[Span]) -> Iterator[tuple[tuple[str, ...], bool]]:
        """(before, seed) of each name that ``completed`` gives."""
        names = [s for s in spans if s.kind == "name"]
        for s in names:
            yield s.before, s.seed
        t, pairs = self._more(text, names)
        for (a, _), (form, given, family, _) in pairs.items():
            yield self._before(t, a, form)[0], self._known(form, given, family)

    def _more(self, text: str | None, names: list[Span]) -> tuple[str, dict]:
        """The text as it is read and the pairs that only contexts propose."""
        if not text or text.isspace() or not len(self.led):
            return "", {}
        t, pairs, there = read(text), {}, {(s.start, s.end) for s in names}
        self._lead(t, pairs)
        return t, {place: x for place, x in pairs.items() if place not in there}

    def found(self, text: str | None, classifier: Classifier) -> list[Span]:
        """The accepted spans of a text."""
        return _judged(self.proposed(text), classifier)

    # The patterns begin with a class of characters and look behind after it: so a search runs to the next such character instead of
    # looking behind at each.

    # -- email -------------------------------------------------------------
    _SIGN = re.compile(r"[@\[({< ](?:(?<=@)|(?<=[\[({<]) ?(?:at|AT|At) ?[\])}>]|(?<= )(?:at|AT)(?= [\w-]+(?: dot | DOT )[A-Za-z]))")
    _LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?\Z")
    _INNER = re.compile(r"[A-Za-z0-9._%+-]*")
    _DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({<]?(?<=[ \[({<])(?:dot|DOT|Dot)[\])}>]? ?)[A-Za-z0-9-]+)*")

    def _local(self, t: str, end: int) -> re.Match | None:
        """The longest local part that ends at a place."""
        reach = 64
        while True:
            low = max(0, end - reach)
            m = self._LOCAL.search(t, low, end)
            if m is None or low == 0 or not self._INNER.fullmatch(t, low, m.start()):
                return m  # something that no local part holds stands before it
            reach *= 8

    def emails(self, t: str) -> Iterator[Span]:
        for m in self._SIGN.finditer(t):
            a, b = m.span()
            a, b = a - (t[a - 1 : a] == " "), b + (t[b : b + 1] == " ")
            local = self._local(t, a)
            domain = self._DOMAIN.match(t, b)
            if not local or not domain:
                continue
            labels = re.split(r"\.|\W*\b(?:dot|DOT|Dot)\b\W*", domain.group())
            good = len(labels) > 1 and labels[-1].isalpha() and len(labels[-1]) > 1 and all(labels)
            before, after = _words_before(t, local.start()), _words_after(t, domain.end())
            votes = (
                1 if good else -1,
                -1 if labels[0][:1].isdigit() else 0,
                1 if _cue(before, MAIL_CUES) else 0,
                1 if any(c.isalpha() for c in local.group()) and ("." in domain.group() or "dot" in domain.group().lower()) and not domain.group()[0].isdigit() else -1,
            )
            yield Span("email", local.start(), domain.end(), votes, (*before, *("+" + w for w in after)))

    # -- phone -------------------------------------------------------------
    _PHONE = re.compile(r"[+(\d](?<![\w+./#$€-][+(\d])(?:(?<=\+)\d{1,3}[ .-]?(?:\(0\) ?)?\d|(?<=\()\d{2,5}\) ?\d|(?<=\d))[\d ./-]{5,17}\d(?:,? ext\.? ?\d{1,5})?(?![\w])")

    # How North American, British, French and German numbers are grouped. A number that follows one of
    # these after a blank is no part of it.
    _GROUPED = re.compile(
        r"(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?:,? ext\.? ?\d{1,5})?"
        r"|(?:\+44 ?(?:\(0\) ?)?|0)\d{2} \d{4} \d{4}"
        r"|(?:\+33 ?(?:\(0\) ?)?|0)\d(?:[ .]\d\d){4}"
        r"|(?:\+49[ -]?|0049[ -]?)\d{2,4}[ -/]\d{3,5}(?: ?\d{3}|-\d{2,4})?|0\d{2,4}/\d{3,8}(?:-\d{1,4})?)(?!\d)"
    )

    def phones(self, t: str) -> Iterator[Span]:
        for m in self._PHONE.finditer(t):
            grouped = self._GROUPED.match(m.group())
            # In digits alone any ten look North American; there the whole match stands.
            raw = grouped.group() if grouped and (not grouped.group().isdigit() or m.group() == grouped.group()) else m.group()
            end = m.start() + len(raw)
            core = re.split(r",? ext", raw)[0]
            digits = re.sub(r"\D", "", core)
            if not 8 <= len(digits) <= 15 or re.search(r"[ ./-]{2}", core.replace("(0) ", "")) and "(" not in core:
                continue
            groups = re.findall(r"\d+", core)
            before, after = _words_before(t, m.start()), _words_after(t, end)
            international = raw[0] == "+" or digits.startswith("00")
            american = [len(g) for g in groups[-3:]] == [3, 3, 4] and len(groups) <= 4
            national = digits[0] == "0" and not digits.startswith("00") and 9 <= len(digits) <= 12 and len(groups) >= 2
            dated = re.fullmatch(r"(?:19|20)\d\d-\d\d-\d\d.*", core) is not None
            votes = (
                1 if international and 10 <= len(digits) <= 14 else 0,
                1 if american or national else -1 if not international else 0,
                1 if _cue(before, PHONE_CUES) or ";" in before[:1] or "|" in before[:1] else 0,
                -1 if _cue(before, NUMBER_CUES) or dated else 0,
                -1 if re.fullmatch(r"\d+[.]\d+|\d+-\d+|\d{4} \d{4} \d{4}|\d{8,}", core) else 1 if len(groups) > 1 or raw[0] == "+" else 0,
            )
            yield Span("phone", m.start(), end, votes, (*before, *("+" + w for w in after), "=" + re.sub(r"\d", "#", core)))

    # -- idnumber ----------------------------------------------------------
    _ID = re.compile(
        r"[\dA-Z](?<![\w+-][\dA-Z])(?:(?<=\d)(?:\d{2}([- ])\d{2}\1\d{4}|\d{5}-\d{4}|\d{7} ?-?[A-Z]|\d \d{3} \d{3} \d{3})"
        r"|(?<=[A-Z])[A-Z] ?(?:\d{7}|\d{2} ?\d{2} ?\d{2} ?[A-D]))(?![\w-])"
    )

    def idnumbers(self, t: str) -> Iterator[Span]:
        for m in self._ID.finditer(t):
            before, after = _words_before(t, m.start(), 4), _words_after(t, m.end())
            closed = t[m.end() : m.end() + 1] in (")", ";", ",")
            votes = (
                1 if _cue(before[:3], ID_CUES) else 0,
                -1 if _cue(before[:2], NUMBER_CUES) else 0,
                1 if before[:1] == [","] and closed else 0,
                1 if before[:1] == [";"] and closed else 0,
                1 if re.fullmatch(r"9\d\d.\d\d.\d{4}|\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-\d{4}|[A-Z]{2} ?\d{7}|\d{8}.?.?[A-Z]|0\d \d{3} \d{3} \d{3}", m.group()) else 0,
            )
            yield Span("idnumber", m.start(), m.end(), votes, (*before, *("+" + w for w in after), "=" + re.sub("[A-Z]", "A", _shape(m.group()).upper())))

    # -- address -----------------------------------------------------------
    _W = r"[A-ZÀ-Þ][\w'’-]*"
    _NUMBER = re.compile(r"\d(?<![\w.-]\d)\d{0,4}(?=(?: ?(?:bis|ter|quater)| ?[a-zA-Z])?,? [A-ZÀ-Þabcipqrs])")
    _AFTER_NUMBER = re.compile(
        rf"\d{{1,5}}(?:(?P<english>[a-zA-Z]?,? (?:(?:North|South|East|West|Old|New|Upper|Lower|[NSEW]\.?) )?{_W}(?: {_W})? (?:{'|'.join(STREET_WORDS)})\b\.?)"
        rf"|(?P<french>(?: ?(?:bis|ter|quater)| ?[a-d])?,? (?:{'|'.join(FRENCH_STREETS)}) (?:(?:de la|de|du|des|le|la|les) |d['’]|de l['’])?{_W}(?: {_W})?))(?!\w)"
    )
    _SPANISH = re.compile(rf"(?:{'|'.join(rf'{w}(?<![\w.-]{w})' for w in SPANISH_STREETS)}) (?:(?:de la|de los|de las|del|de) )?{_W}(?: {_W})?,? (?:n\.?[ºo°]\.? ?|núm\. ?)?\d{{1,4}}[a-z]?(?!\w)")
    _GERMAN_END = re.compile(rf"(?:{'|'.join(map(re.escape, GERMAN_STREETS))}) \d{{1,4}} ?[a-z]?(?!\w)|[ -](?:{'|'.join(re.escape(w.capitalize()) for w in GERMAN_STREETS)}) \d{{1,4}} ?[a-z]?(?!\w)")
    _GERMAN_START = re.compile(rf"(?<![\w.-]){_W}\Z")

    def addresses(self, t: str) -> Iterator[Span]:
        for m in self._NUMBER.finditer(t):
            m = self._AFTER_NUMBER.match(t, m.start())
            if m:
                yield self._address(t, m.start(), m.end(), m["french"] is not None)
        for m in self._SPANISH.finditer(t):
            yield self._address(t, m.start(), m.end(), True)
        for m in self._german_ends(t):
            low = max((i for i in (t.rfind(c, 0, m.start()) for c in " \n\t") if i >= 0), default=-1) + 1
            first = self._GERMAN_START.search(t, low, m.start() + (0 if t[m.start()] in " -" else 1))
            if first:
                yield self._address(t, first.start(), m.end(), True)

    _HOUSE, _GERMAN_WORDS = re.compile(rf" (?<=[{''.join({w[-1] for w in GERMAN_STREETS})}] )(?=\d)"), tuple(x for w in GERMAN_STREETS for x in (w, " " + w.capitalize(), "-" + w.capitalize()))

    def _german_ends(self, t: str) -> Iterator[re.Match]:
        """The matches of _GERMAN_END: what stands before a blank and a digit tells first whether there can be one."""
        for house in self._HOUSE.finditer(t):
            if t.endswith(self._GERMAN_WORDS, 0, house.start()):
                word = next(w for w in self._GERMAN_WORDS if t.endswith(w, 0, house.start()))
                m = self._GERMAN_END.match(t, house.start() - len(word))
                if m:
                    yield m

    def _address(self, t: str, start: int, end: int, typical: bool) -> Span:
        before, after = _words_before(t, start), _words_after(t, end)
        votes = (
            1 if _cue(before[:3], ADDRESS_CUES) else 0,
            1 if t[max(0, start - 1) : start] == "\n" or after[:1] == ["|"] or after[:1] == [","] else 0,
            -1 if _cue(after[:1], self.brand_words) or _cue(before[:1], NUMBER_CUES) else 1,
            1 if typical or len(t[start:end].split()) >= 3 else 0,
        )
        return Span("address", start, end, votes, (*before, *("+" + w for w in after)))

    # -- name --------------------------------------------------------------
    _CAPITAL = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
    _ANYCASE = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
    # Any two capitalised words, or an initial or form of address with one. Only the first is consumed: the second may begin a pair too.
    _ANY = re.compile(rf"([A-ZÀ-ÖØ-Þ](?<![\w@'’-][A-ZÀ-ÖØ-Þ])(?:[^\W\d_]|['’-](?=[^\W\d_]))*\.?)(,? )(?=({_CAPITAL})(?![\w@]))")
    # What a context proposes: two words as they may be written, or a form of address with one.
    _LED = re.compile(rf"(?:(?:{'|'.join(TITLES)})\.? )?({_ANYCASE}\.?)(,? )({_ANYCASE})(?![\w@])", re.IGNORECASE)
    _LED_TITLE = re.compile(rf"({'|'.join(TITLES)})(\.? )({_ANYCASE})(?![\w@])", re.IGNORECASE)

    def names(self, t: str, emails: list[Span] = ()) -> list[Span]:
        """Proposed names: capitalised pairs, listed people however written, and what stands in a context that speaks for a name."""
        pairs: dict[tuple[int, int], tuple[str, str, str, bool]] = {}
        for m in self._ANY.finditer(t):
            first = m.group(1)
            if len(first) == 1 or first[-1] == "." and len(first) > 2 and first[:-1].lower() not in TITLES:
                continue
            if first.isupper() and m.group(3).isupper() and self._in_capitals(t, m.start(), m.end(3)):
                continue  # capitals say nothing where everything is written in them
            self._pair(t, pairs, m.start(), m.end(1), m.start(3), m.end(3), m.group(2))
        if len(self.listed):
            low = t.lower()
            if len(low) != len(t):
                low = t.translate(_LOWER)
            for last, length in self.listed.iter(low):
                a, d = last - length + 1, last + 1
                if (a and (t[a - 1].isalnum() or t[a - 1] in "_@")) or (d < len(t) and (t[d].isalnum() or t[d] in "_@")):
                    continue
                b, c = a + low[a:d].index(" "), a + low[a:d].index(" ") + 1
                self._pair(t, pairs, a, b - (t[b - 1] == ","), c, d, ", " if t[b - 1] == "," else " ")
        if len(self.led):
            self._lead(t, pairs)
        return self._names(t, pairs, emails)

    def _lead(self, t: str, pairs: dict) -> None:
        """Note what stands in a context that speaks for a name."""
        done = -1
        for last, length in self.led.iter(t):
            if last == done or last + 1 == len(t) or not (t[last + 1].isalnum() and not t[last + 1].isdecimal()):
                continue  # a longer context ends here as well, or no word begins
            a = last - length + 1
            if a and t[a].isalnum() and t[a - 1].isalnum() and t[a].isascii() == t[a - 1].isascii():
                continue  # the end of a longer word
            done = last
            m = self._LED_TITLE.match(t, last + 1) or self._LED.match(t, last + 1)
            if m:
                self._pair(t, pairs, m.start(1), m.end(1), m.start(3), m.end(3), m.group(2) if "," in m.group(2) else " ", True)

    def _names(self, t: str, pairs: dict, emails: list[Span]) -> list[Span]:
        mails = [(s.start, s.end) for s in emails]
        places = [a for a, _ in mails]
        out = []
        for (a, b), x in pairs.items():
            i = bisect_right(places, b)
            out.append(self._name(t, a, b, *x, t[mails[i][0] : mails[i][1]].lower() if i < len(mails) else ""))
        return out

    def _in_capitals(self, t: str, a: int, d: int) -> bool:
        """Whether a word of capitals stands beside a stretch."""
        left, right = _tokens_before(t, a, 1, _LEFT), _LEFT.search(t, d)
        beside = [w for _, w in left] + ([right.group()] if right else [])
        return any(len(w) > 1 and w.isalpha() and w.isupper() for w in beside)

    def _pair(self, t: str, found: dict, a: int, b: int, c: int, d: int, between: str, led: bool = False) -> None:
        """Note a pair, unless one of its words can't be a person's and the pair isn't a listed one. led: only its context proposes it."""
        first, second = t[a:b].lower(), t[c:d].lower()
        bare = first.rstrip(".")
        if bare in TITLES:
            if "," not in between:
                found.setdefault((c, d), ("title", "", second, led))
            return
        if first.endswith("."):
            if len(bare) == 1 and "," not in between:
                found.setdefault((a, d), ("initial", bare, second, led))
            return
        form, given, family = ("reversed", second, first) if "," in between else ("plain", first, second)
        if len(bare) < 2:
            return
        if (given, family) not in self.people:
            if given in NO_GIVEN or family in NO_GIVEN or given in PLACE_WORDS or family in PLACE_WORDS or given in self.brand_words or family in self.brand_words or f"{given} {family}" in self.brands:
                return
            if "-" in family and family.rsplit("-", 1)[1] in self.brand_words or "-" in given and given.rsplit("-", 1)[1] in self.brand_words:
                return
            if form == "reversed" and family not in self.family:
                # Words in a list are capitalised and parted by commas as well.
                if t[d : d + 2] == ", " and t[d + 2 : d + 3].isupper() or t[max(0, a - 2) : a] == ", " and t[_tokens_before(t, a, 2, _LEFT)[-1][0]].isupper():
                    return
        found.setdefault((a, d), (form, given, family, led))

    _LETTERS, _PRODUCT = re.compile(r"[^\W\d_]+"), re.compile(r" [a-z]+ \d")

    def _before(self, t: str, a: int, form: str) -> tuple[tuple[str, ...], list[tuple[int, str]]]:
        """The texts before a name, and the tokens that they begin at."""
        led = _tokens_before(t, a, CONTEXT + 2, _CONTEXT)
        start = a
        if form == "title":  # what stands before the form of address counts
            cut = 2 if led and led[0][1] == "." else 1
            start, led = led[cut - 1][0] if len(led) >= cut else a, led[cut:]
        return tuple(t[p:start] for p, _ in led[:CONTEXT]), led

    def _known(self, form: str, given: str, family: str) -> bool:
        return (given, family) in self.people if form in ("plain", "reversed") else form == "title" or (given, family) in self.initials

    def _name(self, t: str, a: int, b: int, form: str, given: str, family: str, led_only: bool, mail: str) -> Span:
        before, led = self._before(t, a, form)
        words = [_shape(w) for _, w in led if w != "\n"][:3]
        after = _words_after(t, b, 2)
        behind = (after[0], " ".join(after)) if len(after) == 2 else tuple(after)
        if t[b : b + 1] == "\n":
            behind = ("\n", *behind)
        here = t[a:b]
        cased = all(w[0].isupper() for w in self._LETTERS.findall(here))
        known = self._known(form, given, family)
        brand = _cue(after[:1], self.brand_words) or after[:1] in (["-"], ["&"]) or words[:1] == ["&"] or family in self.brands or given in self.brands and not known or _cue(after[:1], PLACE_WORDS)
        left, right = self.contexts.votes(before, behind)
        votes = (
            1 if known else 0,
            1 if family in self.family else 0 if family[-2:] in self.short_endings or len(self.family) < TELLING else -1,
            (1 if given in self.given else 0) if form in ("plain", "reversed") else 0,
            left,
            right,
            -1 if brand else 0,
            -1 if self._PRODUCT.match(t, b, b + 24) or t[a - 1 : a] == "#" else 0,
            1 if family[-3:] in self.endings else -1 if not cased else 0,
            1 if mail and ((len(family) > 2 and family in mail.partition("@")[0]) or (len(given) > 2 and given in mail.partition("@")[0])) else 0,
        )
        return Span("name", a, b, votes, (*words, *("+" + w for w in after), "=" + form), before, behind, bool(known), led_only)


def _freed(spans: list[Span], accepts: Callable[[Span], bool] | None = None) -> list[Span]:
    """The spans without phone numbers that overlap an identity number: one that ``accepts`` takes, or any."""
    held = _Taken([(s.start, s.end) for s in spans if s.kind == "idnumber" and (accepts is None or accepts(s))])
    return [s for s in spans if s.kind != "phone" or s not in held]


def _judged(spans: list[Span], classifier: Classifier) -> list[Span]:
    """The accepted spans: no phone within an identity number, no name within a mail or street address, and of names that share a word the better judged."""
    own = [s for s in _freed(spans, classifier.accepts) if classifier.accepts(s)]
    others = _Taken([(s.start, s.end) for s in own if s.kind in ("email", "address")])
    names = [s for s in own if s.kind == "name" and s not in others]
    return [s for s in own if s.kind != "name"] + _best(names, classifier.score)


def _best(names: list[Span], score: Callable[[Span], float]) -> list[Span]:
    """Of names that overlap the better judged stands, then the earlier. Pairs overlap their neighbours only."""
    out: list[Span] = []
    kept_starts: list[int] = []
    kept_ends: list[int] = []
    for s in sorted(names, key=lambda s: (-score(s), s.start)):
        i = bisect_right(kept_ends, s.start)
        if i == len(kept_starts) or kept_starts[i] >= s.end:
            kept_starts.insert(i, s.start)
            kept_ends.insert(i, s.end)
            out.append(s)
    return out


# -- weak supervision ---------------------------------------------------------------------------------


def reliabilities(votes: np.ndarray, rounds: int = 30, counts: np.ndarray | None = None, trust: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(likelihood that each row is true, outcome probabilities labelers x classes x votes) by expectation maximisation.

    votes: rows x labelers of -1, 0, 1. counts: how often each row is there, by default once; trust: what the prior counts are multiplied by. The start is the majority; the prior counts say that labelers are
    better than chance, which also settles which class is which.
    """
    m = votes.shape[1]
    counts = np.ones(len(votes)) if counts is None else counts
    prior = trust * np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]])  # class false, true; vote -1, 0, 1
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # rows x labelers x votes
    likely = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    table = np.zeros((m, 2, 3))
    for _ in range(rounds):
        for c, weight in ((0, 1 - likely), (1, likely)):
            table[:, c] = np.einsum("i,ijv->jv", weight * counts, one) + prior[c]
        table /= table.sum(axis=2, keepdims=True)
        share = ((likely * counts).sum() + trust) / (counts.sum() + 2 * trust)
        log = np.einsum("ijv,jcv->ic", one, np.log(table)) + np.log([1 - share, share])
        likely = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
    return likely, table


@lru_cache(1 << 15)
def _bucket(place: int, word: str) -> int:
    return zlib.crc32(f"{place}{word}".encode()) % BUCKETS


def features(span_votes: tuple[int, ...], around: tuple[str, ...]) -> list[int]:
    """Places of the ones of a span's feature vector: the votes for and against, and the hashed words around."""
    m = len(span_votes)
    own = [j if v > 0 else m + j for j, v in enumerate(span_votes) if v]
    return [*own, *(2 * m + _bucket(i, w) for i, w in enumerate(around))]


@dataclass
class Classifier:
    """A logistic span classifier for each kind: weights, the last being the intercept."""

    weights: dict[str, list[float]] = field(default_factory=dict)

    def score(self, span: Span) -> float:
        w = self.weights.get(span.kind)
        if w is None:  # no span of this kind was in the sample: the votes decide
            return float(sum(span.votes))
        return sum(map(w.__getitem__, features(span.votes, span.around)), w[-1])

    def accepts(self, span: Span) -> bool:
        return self.score(span) > 0


#: Weights of each kind, and where they begin in the one vector of all kinds.
_WEIGHTS = {k: 2 * Finder.LABELERS[k] + BUCKETS + 1 for k in KINDS}
_BEGIN = {k: sum(_WEIGHTS[x] for x in KINDS[: KINDS.index(k)]) for k in KINDS}


def _row(span: Span) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    """(kind, votes, places of the ones among the weights of all kinds): spans with equal rows are one row that counts as often."""
    begin = _BEGIN[span.kind]
    return span.kind, span.votes, (*sorted({begin + p for p in features(span.votes, span.around)}), begin + _WEIGHTS[span.kind] - 1)


def _likelihoods(patterns: dict[tuple[str, tuple[int, ...]], int], documents: int = 0) -> dict[tuple[str, tuple[int, ...]], float]:
    """How likely a span is true, by (kind, votes); patterns: how many spans of the documents have them."""
    out = {}
    for kind in KINDS:
        own = sorted(votes for k, votes in patterns if k == kind)
        if own:
            likely, _ = reliabilities(np.array(own), counts=np.array([patterns[kind, votes] for votes in own], float), trust=max(1.0, documents / PRIOR_DOCUMENTS))
            out |= {(kind, votes): x for votes, x in zip(own, likely.tolist(), strict=True)}
    return out


def _slopes(rows: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    """What rows (places, likely, n) add to the slopes of the loss."""
    lists = rows["places"]
    at = lists.offsets.to_numpy()
    places = lists.values.to_numpy()[at[0] : at[-1]]
    p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[places], at[:-1] - at[0]), -30, 30)))
    return np.bincount(places, np.repeat((p - rows["likely"].to_numpy()) * rows["n"].to_numpy(), np.diff(at)), len(w))


def _fit(totals: dict[str, int], slopes: Callable[[np.ndarray], np.ndarray], rounds: int = 150, rate: float = 2.0, ridge: float = 1e-3) -> Classifier:
    """Classifiers by a logistic fit to the likelihoods. totals: spans of each kind; slopes: the sum of ``_slopes`` over all rows."""
    start, penalty, n = [], [], []
    for kind in KINDS:
        m = Finder.LABELERS[kind]
        start.append(np.repeat([0.5, -0.5, 0.0], [m, m, BUCKETS + 1]))  # a vote that is never seen counts as it is meant
        penalty.append(np.repeat([ridge, 10 * ridge, ridge], [2 * m, BUCKETS, 1]))  # the words around correct the votes, they don't replace them
        n.append(np.full(_WEIGHTS[kind], max(1, totals.get(kind, 0))))
    start, penalty, n = map(np.concatenate, (start, penalty, n))
    w, velocity = start.copy(), np.zeros_like(start)
    for _ in range(rounds if totals else 0):
        velocity = 0.9 * velocity - rate * 0.1 * (slopes(w) / n + penalty * (w - start))
        w = w + velocity
    return Classifier({k: w[_BEGIN[k] : _BEGIN[k] + _WEIGHTS[k]].tolist() for k in KINDS if k in totals})


def _totals(patterns: dict[tuple[str, tuple[int, ...]], int]) -> dict[str, int]:
    out: Counter = Counter()
    for (kind, _), n in patterns.items():
        out[kind] += n
    return dict(out)


def train(spans: list[Span]) -> Classifier:
    """Classifiers from unlabelled spans: labeler reliabilities first, then a logistic fit to the likelihoods."""
    rows, patterns = Counter(map(_row, spans)), Counter((s.kind, s.votes) for s in spans)
    likely, own = _likelihoods(patterns), sorted(rows)
    made = pa.RecordBatch.from_arrays([pa.array([x[2] for x in own], pa.list_(pa.int32())), pa.array([likely[x[:2]] for x in own], pa.float64()), pa.array([rows[x] for x in own], pa.int64())], ["places", "likely", "n"])
    return _fit(_totals(patterns), lambda w: _slopes(made, w))


# -- Spark --------------------------------------------------------------------------------------------

_FINDERS: dict[str, Finder] = {}


def _finder(gazetteers) -> Finder:
    key, people, brands, contexts = gazetteers.value
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(people, brands, contexts)
    return _FINDERS[key]


class _Propose:
    """(text) -> proposed spans, at most ``most`` of a task if it is given. No query uses it; it shows what is proposed."""

    def __init__(self, gazetteers, kinds: tuple[str, ...] = KINDS, most: int | None = None) -> None:
        self.gazetteers, self.kinds, self.most = gazetteers, kinds, most

    def fewer(self, spans: list[Span]) -> list[Span]:
        if self.most is None or len(spans) <= self.most:
            return spans
        return sorted(spans, key=lambda s: (zlib.crc32(repr((s.kind, s.around, s.before, s.start)).encode()), s.start))[: self.most]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, spans = _finder(self.gazetteers), []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    spans += finder.names(read(text)) if self.kinds == ("name",) else finder.spans(text)
                    if self.most is not None and len(spans) > 2 * self.most:
                        spans = self.fewer(spans)
        spans = self.fewer(spans)
        for a in range(0, len(spans), 10_000):
            yield self.rows(spans[a : a + 10_000])

    def rows(self, spans: list[Span]) -> pa.RecordBatch:
        texts = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s.kind for s in spans], pa.string()), pa.array([list(s.votes) for s in spans], pa.list_(pa.int32())),
                *[pa.array([list(getattr(s, c)) for s in spans], texts) for c in ("around", "before", "after")], pa.array([s.seed for s in spans], pa.bool_()), pa.array([s.led for s in spans], pa.bool_()),
            ],
            ["kind", "votes", "around", "before", "after", "seed", "led"],
        )


def _unpacked(packed: bytes | None) -> list[Span]:
    return [Span(*x) for x in pickle.loads(packed)] if packed else []


class _Pack:
    """(id, text) -> (id, text, spans that are proposed without contexts; null if there are none)."""

    def __init__(self, gazetteers) -> None:
        self.gazetteers = gazetteers

    def packed(self, finder: Finder, text: str | None) -> bytes | None:
        spans = finder.proposed(text)
        return pickle.dumps([(s.kind, s.start, s.end, s.votes, s.around, s.before, s.after, s.seed) for s in spans], 5) if spans else None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(self.gazetteers)
        for batch in batches:
            packed = [self.packed(finder, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "text", "spans"])


class _Contexts:
    """(spans) -> how often each context stands beside names, in parts; single: whether it may be the nearest. Side 2 counts documents."""

    FORM = "side int, context string, single boolean, seed boolean, n bigint"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts[2, None, False] += batch.num_rows
            for packed in batch.column(0).to_pylist():
                for s in _unpacked(packed):
                    if s.kind == "name":
                        _count_contexts(s, counts)
                if len(counts) >= COUNTED:
                    yield self.rows(counts)
                    counts.clear()
        yield self.rows(counts)

    def rows(self, counts: Counter) -> pa.RecordBatch:
        single = [c is not None and (" " not in c if side else len(_CONTEXT.findall(c)) < 2) for side, c, _ in counts]
        columns = [pa.array([x[i] for x in counts], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*columns[:2], pa.array(single, pa.bool_()), columns[2], pa.array(list(counts.values()), pa.int64())], ["side", "context", "single", "seed", "n"])


class _Leads:
    """(text, spans) -> how often each context that speaks for a name stands before what is proposed, and before seeds."""

    FORM = "context string, every bigint, seeds bigint"

    def __init__(self, gazetteers) -> None:
        self.gazetteers = gazetteers

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, every, seeds = _finder(self.gazetteers), Counter(), Counter()
        for batch in batches:
            for text, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _count_led(finder.contexts, finder.leads(text, _unpacked(packed)), every, seeds)
        own = sorted(every)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([every[c] for c in own], pa.int64()), pa.array([seeds[c] for c in own], pa.int64())], ["context", "every", "seeds"])


class _Rows:
    """(text, spans) -> how often each row of features is there, in parts."""

    FORM = "kind string, votes array<int>, places array<int>, n bigint"

    def __init__(self, gazetteers) -> None:
        self.gazetteers = gazetteers

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, counts = _finder(self.gazetteers), Counter()
        for batch in batches:
            for text, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update(_row(s) for s in _freed(finder.completed(text, _unpacked(packed))) if finder.contexts.keeps(s))
                if len(counts) >= COUNTED:
                    yield self.rows(counts)
                    counts.clear()
        yield self.rows(counts)

    def rows(self, counts: Counter) -> pa.RecordBatch:
        numbers = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in counts], kind) for i, kind in enumerate((pa.string(), numbers, numbers))], pa.array(list(counts.values()), pa.int64())], ["kind", "votes", "places", "n"])


class _Slopes:
    """(places, likely, n) -> the slopes of a task's rows."""

    FORM = "slopes array<double>"

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(self.weights))
        for batch in batches:
            if batch.num_rows:
                total += _slopes(batch, self.weights)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["slopes"])


def _trained(rows: DataFrame, documents: int) -> Classifier:
    """Classifiers from all rows (kind, votes, places, n): fitted by the driver if they are few, else each round is a job over them."""
    spark = rows.sparkSession
    patterns = {(r.kind, tuple(r.votes)): r.n for r in rows.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    if not patterns:
        return Classifier()
    likely = spark.createDataFrame([(k, list(v), x) for (k, v), x in _likelihoods(patterns, documents).items()], "kind string, votes array<int>, likely double")
    judged = rows.join(F.broadcast(likely), ["kind", "votes"]).select("places", "likely", "n")
    if is_at_most(rows, FIT_ROWS):
        own = judged.orderBy("places").toArrow().combine_chunks().to_batches()
        return _fit(_totals(patterns), lambda w: sum(_slopes(b, w) for b in own))
    laid = cut_lineage(judged)

    def slopes(w: np.ndarray) -> np.ndarray:
        return sum(np.array(x) for x in sorted(r.slopes for r in laid.mapInArrow(_Slopes(w), _Slopes.FORM).collect()))

    return _fit(_totals(patterns), slopes)


def _disjoint(spans: list[Span]) -> list[Span]:
    """Of accepted spans that overlap the earliest and longest stands."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end, KINDS.index(s.kind))):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


class _Find:
    """(id, text, spans) -> what is found, or the texts without it."""

    def __init__(self, gazetteers, classifier, id_column: str, redact: bool) -> None:
        self.gazetteers, self.classifier, self.id_column, self.redact = gazetteers, classifier, id_column, redact

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, classifier = _finder(self.gazetteers), self.classifier.value
        for batch in batches:
            keys, kinds, starts, ends, texts = [], [], [], [], []
            for key, text, packed in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                spans = _judged(finder.completed(text, _unpacked(packed)), classifier)
                if self.redact:
                    if text is not None:
                        parts, at = [], 0
                        for s in _disjoint(spans):
                            parts += [text[at : s.start], f"[{s.kind.upper()}]"]
                            at = s.end
                        text = "".join([*parts, text[at:]])
                    texts.append(text)
                    keys.append(key)
                else:
                    for s in {(s.kind, s.start): s for s in reversed(spans)}.values():
                        keys.append(key)
                        kinds.append(s.kind)
                        starts.append(s.start)
                        ends.append(s.end)
            first = pa.array(keys, batch.column(0).type)
            if self.redact:
                yield pa.RecordBatch.from_arrays([first, pa.array(texts, pa.string())], [self.id_column, "redacted"])
            else:
                yield pa.RecordBatch.from_arrays([first, pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [self.id_column, "pii_kind", "start_pos", "end_pos"])


def _prepared(documents: DataFrame, people: DataFrame, brands: DataFrame | None, id_column: str, text_column: str, given: str, family: str, brand: str) -> tuple:
    """(documents with what is proposed in them, gazetteers with what is learned of contexts, classifier)."""
    spark = documents.sparkSession

    def rows(df: DataFrame, *columns: str) -> list[tuple]:
        got = df.select(*columns).distinct().limit(GAZETTEER_ROWS + 1).collect()
        if len(got) > GAZETTEER_ROWS:
            raise ValueError(f"a gazetteer has more than {GAZETTEER_ROWS} rows")
        return sorted((tuple(r) for r in got), key=str)

    own = rows(people, given, family)
    marks = [r[0] for r in rows(brands, brand)] if brands is not None else []
    sc = spark.sparkContext

    def held(contexts: Contexts):
        return sc.broadcast((f"{zlib.crc32(repr((own, marks, sorted(contexts.leading), sorted(contexts.before), sorted(contexts.after))).encode())}", own, marks, contexts))

    # The patterns go over all texts once; what depends on contexts is worked out from what is laid aside here.
    kind = documents.schema[id_column].dataType.simpleString()
    packed = cut_lineage(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(_Pack(held(Contexts())), f"id {kind}, text string, spans binary"))

    n, seeds = F.sum("n"), F.coalesce(F.sum(F.when(F.col("seed"), F.col("n"))), F.lit(0))
    counted = packed.select("spans").mapInArrow(_Contexts(), _Contexts.FORM).groupBy("side", "context").agg(n.alias("every"), seeds.alias("seeds"), F.max("single").alias("single"))
    telling = counted.where((F.col("seeds") >= SEEDS) & (F.col("seeds") >= F.lit(SEED_SHARE) * F.col("every")) | (F.col("every") >= SEEDLESS) & (F.col("seeds") == 0) & F.col("single") | F.col("context").isNull()).collect()
    first = _speaking({(r.side, r.context, seed): x for r in telling for seed, x in ((True, r.seeds), (False, r.every - r.seeds)) if x})

    total = sum(r.every for r in telling if r.side == 2)

    contexts = first
    if first.before:
        led = packed.select("text", "spans").mapInArrow(_Leads(held(first)), _Leads.FORM).groupBy("context").agg(F.sum("every").alias("every"), F.sum("seeds").alias("seeds")).collect()
        contexts = _leading(first, Counter({r.context: r.every for r in led}), Counter({r.context: r.seeds for r in led}))
    gazetteers = held(contexts)
    features_of = cut_lineage(packed.select("text", "spans").mapInArrow(_Rows(gazetteers), _Rows.FORM).groupBy("kind", "votes", "places").agg(F.sum("n").alias("n")))
    return packed, gazetteers, sc.broadcast(_trained(features_of, total))


def find(
    documents: DataFrame, people: DataFrame, brands: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", given: str = "given_name", family: str = "family_name", brand: str = "name"
) -> DataFrame:
    """(id, pii_kind, start_pos, end_pos): each occurrence, places in code points from 0, the end exclusive.

    Null, empty and blank texts have none. Documents are not shuffled; each is searched once and laid aside with what
    is proposed in it. A document that repeats in the input repeats here.
    """
    packed, gazetteers, classifier = _prepared(documents, people, brands, id_column, text_column, given, family, brand)
    kind = documents.schema[id_column].dataType.simpleString()
    return packed.mapInArrow(_Find(gazetteers, classifier, id_column, False), f"`{id_column}` {kind}, pii_kind string, start_pos bigint, end_pos bigint")


def redact(
    documents: DataFrame, people: DataFrame, brands: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", given: str = "given_name", family: str = "family_name", brand: str = "name"
) -> DataFrame:
    """(id, redacted): each text with every occurrence replaced by its kind in brackets; null stays null."""
    packed, gazetteers, classifier = _prepared(documents, people, brands, id_column, text_column, given, family, brand)
    kind = documents.schema[id_column].dataType.simpleString()
    return packed.mapInArrow(_Find(gazetteers, classifier, id_column, True), f"`{id_column}` {kind}, redacted string")
