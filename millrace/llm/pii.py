"""Personal data by candidate generation and gradient boosting.

Four base kinds have exact rules. Beside them, high-recall generators propose
overlapping spans: digit groups, spelled-out addresses, account numbers, and
what the base rules miss where numbers run together (every stretch of a card's
length in a run of digits that fails as a whole, every prefix of a phone's
length in a phone that goes on too long). Boosted trees score each candidate by
its format and by what stands around it; a logistic calibration makes
probabilities of the scores, and a threshold for each kind selects what else to
redact. Overlaps are decided after scoring: base spans stay, and of selected
spans that overlap the likeliest does.

The corpus has no labels for personal data. The trees learn from made-up
candidates, drawn with a fixed seed, and, if given, from ``hard_negatives``:
candidates of a bounded sample of the corpus whose own check digits refute them.
A made-up candidate's label follows from its format and from what the words
before it mean; those words are drawn from lists of their own, of which the
features know some, and half of all candidates have nothing telling before them.
Calibration, thresholds and the precision and recall in ``Detector.report`` each
come from examples of their own.

Defined results: a null text counts as empty and has no spans; repeated rows
give equal rows; texts of any length are scanned whole; equally likely spans
go by their start, then their kind; an empty table gives an empty result; other
columns are carried along, and a column whose name is one of the result's is
replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import boosting
from millrace.llm.text import others, quoted

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_text", "phone_local", "ssn", "iban", "card_run", "phone_run")
#: Made-up candidates: half teach the trees, a sixth each are for calibration, thresholds and the report. Thresholds are the least of this precision, and at least one half.
EXAMPLES, PRECISION = 13_500, 0.93
#: Texts that refuted candidates are drawn from, about, and candidates at most.
NEGATIVE_TEXTS, NEGATIVES = 4_000, 2_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match takes all digits that follow, so none starts amid digits.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; a name reaches back to its first character or to the last match, and is read once."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", *s) for s in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


#: What proposes spans of the other kinds; recall matters here, the trees see to precision.
GENERATORS = (
    ("email_text", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]\x20?(?:at|AT|arroba)\x20?[\])]\x20?|\x20(?:at|AT|arroba)\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?(?:dot|DOT|punto)\x20?[\])]\x20?|\x20(?:dot|DOT|punto)\x20|\.)[A-Za-z]{2,24}){1,3}")),
    ("phone_local", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
GROUP = re.compile(r"[0-9]+")


def card_runs(text: str):
    """Stretches of whole digit groups, 13 to 19 digits in all, of runs that aren't a card as they stand."""
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        if 13 <= sum(e - s for s, e in groups) <= 19 and luhn(digits_of(m[0])):
            continue
        for n, (start, _) in enumerate(groups):
            digits = 0
            for s, e in groups[n:]:
                digits += e - s
                if digits > 19:
                    break
                if digits >= 13:
                    yield start, e


def phone_runs(text: str):
    """Prefixes of whole digit groups, 9 to 15 digits in all, of numbers with a plus sign that have more."""
    for m in PHONE.finditer(text):
        if len(digits_of(m[0])) <= 15:
            continue
        digits = 0
        for g in GROUP.finditer(text, *m.span()):
            digits += g.end() - g.start()
            if digits > 15:
                break
            if digits >= 9:
                yield m.start(), g.end()


#: A spelled-out address spells its sign, in brackets or between spaces; texts without one have none, as the generator asks for it.
SPELLED = re.compile(r"[\[(]\x20?(?:at|AT|arroba)\x20?[\])]|\x20(?:at|AT|arroba)\x20")
#: What the last part of an address commonly is.
TOP_LEVEL = re.compile(r"(?i)[\x20.)\]](?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ch|at|nl|mx|ar|br)$")
DIGIT = re.compile(r"[0-9]")
PHONE_WORDS = re.compile(r"(?i)\b(?:tel|phone|call|mobile|cell|fax|contact|whatsapp|sms|ring|dial)")
ID_WORDS = re.compile(r"(?i)\b(?:ssn|social|security|taxpayer|passport|iban|account|bank|konto|mail|write|reach|e-?mail)")
OTHER_WORDS = re.compile(r"(?i)\b(?:order|isbn|issn|version|ver|no|part|item|page|model|serial|invoice|ref|score|date|year|ticket|sku|build|chapter|lat|total|price|lot|batch|catalogue|drawing|sold)\b")
CARD_WORDS = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|paid|payment|charge)")
#: A number that goes on after a candidate, and an address of four numbers right after it.
GOES_ON = re.compile(r"[\x20()./-]{0,2}[0-9]")
NEXT_IP = re.compile(r"\x20[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
#: Words that commonly stand before a place.
PLACED = re.compile(r"(?i)(?:look|looks|looking|met|meet|arrived|arrive|are|is|was|be|sold|shop|buy|found|find|available|live|stay|more|us|here|visit|read|works?|people|site|store|listed|posted|online)$")
CONTEXT = 40


def _iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 20]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    first, second, *_ = [*groups, 0, 0]
    name = re.match(r"[^\x20\[(]*", span)[0]
    number = int(m[0]) if (m := re.match(r"[0-9]{1,9}", span)) else 0
    return [
        float(MORE_KINDS.index(kind)),
        float(sum(groups)),
        float(len(groups)),
        float(first),
        float(second),
        float(groups[-1] if groups else 0),
        float(first == 4 and 1900 <= number < 2100),
        float(first == 2 and number <= 31),
        float(span.count("-")),
        float(span.count(".") + span.count("/")),
        float(span.count(" ")),
        float("(" in span) + float("[" in span),
        float(span[:1] == "0"),
        float(bool(PHONE_WORDS.search(before))),
        float(bool(ID_WORDS.search(before))),
        float(bool(OTHER_WORDS.search(before))),
        float(bool(re.search(r"[$€£%#=/A-Za-z]$", before))),
        float(bool(re.match(r"[%/A-Za-z0-9€]|\x20?(?:kg|km|cm|mm|EUR|USD|pages)", after))),
        float(kind == "iban" and _iban_ok(span)),
        float(bool(re.search(r"\b(?:dot|DOT|punto)\b|[\[(]\x20?(?:at|AT|dot|DOT)", span))),
        float(kind == "ssn" and span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00"),
        float(len({*digits_of(span)})),
        float(kind == "email_text" and bool(TOP_LEVEL.search(span))),
        float(kind == "email_text" and bool(PLACED.match(name))),
        float(kind == "email_text" and bool(re.search(r"[._0-9%+-]", name))),
        float(kind == "card_run" and luhn(digits_of(span))),
        float(kind == "card_run" and len(groups) > 1 and (len({*groups[:-1]}) > 1 or groups[-1] > groups[0])),
        float(bool(CARD_WORDS.search(before))),
        float(bool(re.search(r"[0-9][\x20()./-]{0,2}$", before))),
        float(bool(GOES_ON.match(after))),
        float(bool(NEXT_IP.match(after))),
    ]


#: What the words before a candidate say, by the label that they speak for. The features know some of these words only.
LEADS = {
    ("phone_local", True): ("call", "phone:", "mobile", "my number is", "ring her on", "text me at", "dial", "telephone", "office line", "her desk:", "reachable under", "hotline"),
    ("phone_local", False): ("order", "invoice", "isbn", "ticket", "version", "sold", "counted", "between", "scores of", "catalogue", "lot", "batch", "results were"),
    ("ssn", True): ("ssn", "social security number", "taxpayer id", "born 1960,", "insured under", "applicant", "my social is"),
    ("ssn", False): ("part", "serial", "order", "item", "catalogue", "drawing", "lot", "batch", "locker"),
    ("iban", True): ("iban", "bank account", "konto", "please transfer to", "pay into", "beneficiary"),
    ("iban", False): ("serial", "model", "part", "key", "licence", "frame number"),
    ("email_text", True): ("mail", "write to", "reach me:", "contact", "e-mail", "drop a line to", "address:", "questions to"),
    ("email_text", False): ("yesterday", "the shop", "more of this", "come and", "they", "we all"),
    ("card_run", True): ("card", "visa", "paid with", "credit card:", "tarjeta", "please charge", "karte", "on file"),
    ("card_run", False): ("order", "serial", "tracking", "lot", "batch", "meter", "invoice", "barcode"),
    ("phone_run", True): ("call", "phone:", "mobile", "dial", "from", "logged"),
    ("phone_run", False): ("serial", "offset", "range", "values", "measured"),
}


def _card(rng: np.random.Generator, valid: bool) -> str:
    """Digits with or without a valid check digit, as one group or in fours."""
    n = int(rng.choice([16, 16, 16, 16, 15, 13, 19]))
    head = "".join(map(str, rng.integers(0, 10, n - 1)))
    check = next(d for d in "0123456789" if luhn(head + d))
    digits = head + (check if valid else str((int(check) + int(rng.integers(1, 10))) % 10))
    sign = str(rng.choice(["", "", " ", "-"]))
    return sign.join(digits[i : i + 4] for i in range(0, n, 4)) if sign else digits


def _run_examples(rng: np.random.Generator, kind: str) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) for every candidate of a made-up run; positive are the numbers that it was made of."""
    number = lambda: "".join(map(str, rng.integers(0, 10, int(rng.integers(1, 9)))))
    parts: list[tuple[str, bool]] = []
    if kind == "card_run":
        form = int(rng.integers(8))
        if form == 0:
            parts = [(_card(rng, False), False)]
        elif form == 1:
            parts = [(_card(rng, bool(rng.integers(2))), True), (_card(rng, bool(rng.integers(2))), True)]
        elif form == 2:
            parts = [(_card(rng, True), True), (number(), False)]
        elif form == 3:
            parts = [(number(), False), (_card(rng, True), True)]
        elif form == 4:
            parts = [(_card(rng, False), False), (number(), False)]
        elif form == 5:
            parts = [("".join(map(str, rng.integers(0, 10, int(rng.integers(20, 34))))), False)]
        else:  # groups of no card's form, whose check digit is right by chance
            parts = [(str(rng.choice([" ", "-"])).join("".join(map(str, rng.integers(0, 10, int(rng.integers(2, 8))))) for _ in range(int(rng.integers(3, 7)))), False)]
        parts = [(p, good and luhn(digits_of(p))) for p, good in parts]
        body = str(rng.choice([" ", "-"])).join(p for p, _ in parts)
    else:
        d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
        phone = str(rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+49 {d(3)} {d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(3)}", f"+{d(11)}"]))
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        form = int(rng.integers(4))
        if form == 0:
            parts, body = [(phone, True)], f"{phone} {ip}"
        elif form == 1:
            other = str(rng.choice([f"{d(3)}-{d(4)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}"]))
            parts, body = [(phone, True)], f"{phone} {other}"
        else:  # a long number with a sign is no phone
            parts, body = [("+", False)], "+" + str(rng.choice([".", "-", " ", ""])).join(d(int(rng.integers(3, 7))) for _ in range(int(rng.integers(5, 8))))
    good = any(g for _, g in parts)
    lead = str(rng.choice(LEADS[kind, good])) if rng.integers(2) else ""
    # Digits amid letters, as in a digest, are no number.
    text = f"some words {lead} {body} and more" if form or rng.random() < 0.7 else f"token {'abcdef'[int(rng.integers(6))]}{body}{'abcdef'[int(rng.integers(6))]} and more"
    spans, at = set(), text.find(body)
    for p, g in parts:
        start = text.find(p, at)
        spans |= {(start, start + len(p))} if g else set()
        at = start + len(p)
    found = dict(PROPOSERS)[kind](text)
    return [(text, s, e, int((s, e) in spans)) for s, e in found]


def _example(rng: np.random.Generator) -> tuple[str, str, int]:
    """A made-up sentence around a candidate: (text, kind, label)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(*"abdeghiklmnoprstuvwy") for _ in range(int(rng.integers(2, 9))))
    fill = lambda: " ".join(word() for _ in range(int(rng.integers(2, 6))))
    number = lambda low, high: int(rng.integers(low, high))
    kind, good, lead = pick("email_text", "phone_local", "ssn", "iban"), bool(rng.integers(2)), None
    if kind == "phone_local":
        phone = lambda: pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(2)} {d(2)}")
        if good:
            body = phone()
        elif rng.random() < 0.15:  # the form of a number, but the words say otherwise
            body, lead = phone(), pick(*LEADS[kind, False])
        else:
            date, ssn = f"{number(1, 29):02d}{{0}}{number(1, 13):02d}{{0}}{number(1900, 2100)}".format(pick("-", ".", "/")), f"{number(1, 899):03d}-{number(1, 99):02d}-{d(4)}"
            body = pick(date, f"{number(1900, 2100)}-{number(1, 13):02d}-{number(1, 29):02d}", ssn, f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(2)}.{d(3)}.{d(3)}", f"978-{d(2)}-{d(4)}-{d(3)}")
    elif kind == "ssn":
        valid = f"{number(1, 665):03d}-{number(1, 99):02d}-{d(4)}"
        if good:
            body = valid
        elif rng.random() < 0.15:
            body, lead = valid, pick(*LEADS[kind, False])
        else:
            body = pick(f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)} {d(2)} {d(4)}")
    elif kind == "iban":
        country, size = pick(("DE", 18), ("ES", 20), ("AT", 16), ("FR", 23), ("NL", 14), ("BE", 12))
        tail = d(size)
        check = 98 - int("".join(str(int(c, 36)) for c in tail + country + "00")) % 97
        body = f"{country}{check:02d}{tail}" if good else f"{pick('AB', 'XK', 'QT', country)}{(check + number(1, 90)) % 97:02d}{tail}"
        body = " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if rng.integers(2) else body
    else:
        sign, dot, end = pick(" at ", " AT ", " arroba ", " (at) ", "[at]", " [AT] ", " (arroba) "), pick(".", " dot ", " DOT ", " punto ", " (dot) ", "[dot]"), pick("com", "org", "net", "de", "es", "fr", "info", "co.uk")
        if good:
            body = f"{word()}{pick('', '.' + word(), '_' + word(), str(number(1, 99)))}{sign}{word()}{dot}{end}"
        elif rng.random() < 0.5:
            body = f"{pick('look', 'we met', 'arrived', 'is', 'sold', 'available', 'people', 'works', 'find us', word() + ' was')} at {word()}{pick('.', ' dot ')}{end}"
        else:
            body = f"{word()} {pick('at', 'AT', 'arroba')} {word()}{pick('.', ' dot ', ' punto ')}{pick('then', 'he', 'we', word() + 'k')}"
    if lead is None and rng.integers(2):
        lead = pick(*LEADS[kind, good])
    return " ".join([fill(), *([lead] if lead else []), body, fill()]), kind, int(good)


@dataclass(frozen=True)
class Detector:
    """Trees, their calibration, the least probability for each kind, and precision and recall of each kind on examples of their own."""

    model: tuple[float, list[boosting.Node]]
    slope: float
    offset: float
    thresholds: dict[str, float]
    report: dict[str, tuple[float, float]]

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        return boosting.sigmoid(self.slope * boosting.margin(self.model, np.array(rows)) + self.offset)


def _least(p: np.ndarray, t: np.ndarray, precision: float) -> float:
    """The least threshold from one half on at which so many of the selected are right; 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(p[order]) != 0, True)  # equal probabilities are selected together
    enough = np.flatnonzero((right >= precision) & last)
    return max(0.5, float(p[order][enough[-1]])) if len(enough) else 1.0


#: What proposes the numbers that run together.
PROPOSERS = (("card_run", card_runs), ("phone_run", phone_runs))


def train(examples: int = EXAMPLES, precision: float = PRECISION, seed: int = 5, negatives: list[list[float]] | None = None) -> Detector:
    """A detector from made-up examples, and feature rows of refuted candidates; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    rows, labels, kinds = [], [], []
    while len(rows) < examples:
        if rng.integers(3) == 0:
            kind = MORE_KINDS[4 + int(rng.integers(2))]
            made = _run_examples(rng, kind)
        else:
            text, kind, label = _example(rng)
            made = [(text, *m.span(), label)] if (m := dict(GENERATORS)[kind].search(text)) else []
        for text, start, end, label in made:
            rows.append(features(text, kind, start, end))
            labels.append(label)
            kinds.append(kind)
    for row in negatives or ():
        rows.append(row)
        labels.append(0)
        kinds.append(MORE_KINDS[int(row[0])])
    x, y, kind, part = np.array(rows), np.array(labels, float), np.array(kinds), np.arange(len(rows)) % 6
    model = boosting.boost(x[part < 3], y[part < 3], rounds=80, depth=4)
    z, t = boosting.margin(model, x), y
    slope, offset, fit = 1.0, 0.0, part == 3
    for _ in range(200):
        error = boosting.sigmoid(slope * z[fit] + offset) - t[fit]
        slope, offset = slope - 0.05 * float((error * z[fit]).mean()), offset - 0.05 * float(error.mean())
    p = boosting.sigmoid(slope * z + offset)
    thresholds = {k: _least(p[choice], t[choice], precision) for k in MORE_KINDS for choice in [(part == 4) & (kind == k)]}
    report = {}
    for k in MORE_KINDS:
        mine = (part == 5) & (kind == k)
        chosen = p[mine] >= thresholds[k]
        report[k] = (float(t[mine][chosen].mean()) if chosen.any() else 1.0, float(chosen[t[mine] == 1].mean()) if (t[mine] == 1).any() else 0.0)
    return Detector(model, slope, offset, thresholds, report)


class _Spans:
    """Disjoint spans in order; tells whether another would touch one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int, keep: bool = True) -> bool:
        """Whether there is room; the span is then kept, if asked."""
        at = bisect_right(self.starts, start)
        free = (at == 0 or self.ends[at - 1] <= start) and (at == len(self.starts) or end <= self.starts[at])
        if free and keep:
            self.starts.insert(at, start)
            self.ends.insert(at, end)
        return free


def more_spans(text: str, base: list[tuple[str, int, int]], detector: Detector) -> list[tuple[str, int, int]]:
    """Selected spans of the other kinds, by kind as listed, then start."""
    proposed = candidates(text)
    if not proposed:
        return []
    scored = zip(detector.probability([features(text, *c) for c in proposed]), proposed, strict=True)
    held = _Spans([(s, e) for _, s, e in base])
    chosen = [c for p, c in sorted(scored, key=lambda x: (-x[0], x[1][1], MORE_KINDS.index(x[1][0]))) if p >= detector.thresholds[c[0]] and held.add(c[1], c[2])]
    return sorted(chosen, key=lambda c: (MORE_KINDS.index(c[0]), c[1]))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Every span that a generator proposes, whatever it overlaps."""
    may = {"email_text": SPELLED.search(text)}
    has_digit = DIGIT.search(text)
    found = [(kind, *m.span()) for kind, pattern in GENERATORS if may.get(kind, has_digit) for m in pattern.finditer(text)]
    return found + [(kind, *span) for kind, propose in PROPOSERS if has_digit for span in propose(text)]


def refuted(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate's own check digits or reserved numbers say that it isn't what it looks like."""
    span = text[start:end]
    if kind == "card_run":
        return not luhn(digits_of(span))
    if kind == "iban":
        return not _iban_ok(span)
    return kind == "ssn" and (span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00")


def hard_negatives(df: DataFrame, text: str = "text", texts: int = NEGATIVE_TEXTS, most: int = NEGATIVES) -> list[list[float]]:
    """Feature rows of refuted candidates in about ``texts`` texts, chosen by hash; equal texts count once, and ``most`` bounds what is collected."""
    value = F.col(quoted(text))
    chosen = df.select(value.alias("text"), F.pmod(F.xxhash64(F.lit(3), value), F.lit(1 << 30)).alias("at")).where(F.col("at") < F.lit((1 << 30) * min(1.0, texts / max(1, df.count()))))

    def rows(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            t = v.as_py() or ""
            out.append([features(t, *c) for c in candidates(t) if refuted(t, *c)])
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    made = F.explode(F.arrow_udf(rows, "array<array<double>>")(F.col("text"))).alias("row")
    return [list(r["row"]) for r in chosen.where("text IS NOT NULL").dropDuplicates(["at"]).select("at", made).orderBy("at", "row").limit(most).collect()]


STRUCT = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def scan(df: DataFrame, detector: Detector | None = None, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``df`` with ``out``: array<struct<kind,start,end,base>>, base kinds first, by kind, then start; one pass, no shuffle."""
    model = detector or train()

    def spans(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            t = value.as_py()
            base = base_spans(t or "")
            rows.append([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more_spans(t or "", base, model)])
        each = [x for r in rows for x in r]
        kinds, starts, ends, bases = zip(*each) if each else ((), (), (), ())
        flat = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(bases, pa.bool_())], ["kind", "start", "end", "base"]
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), flat)

    return df.select(*others(df, out), F.arrow_udf(spans, STRUCT)(quoted(text)).alias(out))


def spans_text(spans):
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or stretch of overlapping ones, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
