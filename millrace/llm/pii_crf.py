"""Personal data by patterns and a semi-Markov conditional random field.

Patterns find the plain forms (e-mail, IP address, payment card, phone with +). Around whatever else looks like one of
these (an @, an at in brackets or before words with a dot, seven or more digits close together) a semi-Markov field reads the tokens: every
stretch of up to MAX_TOKENS tokens is a candidate segment of each type, scored by features of the whole span (its
shape, digits, checksum, brackets, neighbours and the cue words before it). Dynamic programming over segment ends
chooses boundaries and types together, each token outside a segment counting 0. Spans it finds that touch no
pattern's span are added; the patterns' spans always stay.

The field's weights are learned by maximum likelihood (forward-backward sums over segmentations) from sentences that a
seeded generator makes: each form of each type, and look-alikes that are none (dates, versions, prices, checksums,
long numbers that fail the card check, words "at" a plain domain). They take a few seconds, on the driver.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive; rows are judged one
by one. Work and memory per text grow in proportion to it: a region is read once, however many anchors it has, and
holds whole every segment of up to MAX_TOKENS tokens about them.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, map_slices

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, tokens before it that are read for its cue, characters to look back for both at first.
MAX_TOKENS, CONTEXT, REGION = 32, 8, 160
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EMAIL_FULL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 14 <= len(d) <= 19 and luhn(d)


def _is_phone(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    spans: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at  # the local part is the longest run before the @ that no earlier match took
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _is_ip(m[0])]
        spans += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if len(m[0]) >= 14 and _is_card(m[0])]
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the field ----

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[\s\S]")
#: A part of every form that _SPELLED and _SPACED take: an @, an at in brackets, an at before a label and any dot.
_ANCHOR = re.compile(r"@|(?<![0-9])[0-9](?:[ ().\-/]{0,2}[0-9]){6}|\b(?:at|AT)\b[^\n]{1,40}?\b(?:dot|DOT)\b|[\[({] ?(?:at|AT) ?[\])}]|(?<= )(?:at|AT)(?= [A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-])")
_NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_TRUNK = re.compile(r"(?:00[1-9][0-9]{0,2}|0[1-9][0-9]{0,4})(?:[ /.-][0-9]{2,9}){1,5}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) )[A-Za-z0-9-]+(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]+)+")
_MORE = re.compile(r" ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?[A-Za-z0-9-]| (?:dot|DOT) [A-Za-z0-9-]")
_SPACED = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+")
#: A word, " at " and a plain domain: prose ("more at example.com") as often as an address.
_PROSE = re.compile(r"[A-Za-z]+ (?:at|AT) [A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TOP = re.compile(r"[A-Za-z]{2,}\Z")
_GROUPS = re.compile(r"[0-9]{4}(?:[ ./-][0-9]{4}){2,3}|[0-9]{4}[ ./-][0-9]{6}[ ./-][0-9]{4,5}")
_CUES = {"email": {"email", "mail", "contact", "write", "reach"}, "ip": {"ip", "host", "server", "node", "from"}, "card": {"card", "visa", "credit", "paid", "charge"}, "phone": {"phone", "tel", "call", "fax", "mobile", "ring"}}


def _span_features(text: str, start: int, end: int, cue: str) -> list[str]:
    """Features of the span as a whole, the same for every type."""
    span = text[start:end]
    digits = _digits(span)
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"digits{min(n, 7) if n < 7 else 8 if n < 10 else n if n < 12 else 12 if n < 14 else 14 if n < 17 else 17 if n < 20 else 20}"]
    if _EMAIL_FULL.fullmatch(span):
        out.append("plain email")
    elif "@" in span and _SPACED.fullmatch(span) and _TOP.search(span):
        out.append("spaced email")
    elif _SPELLED.fullmatch(span) and _TOP.search(span) and not _MORE.match(text, end):
        out.append("prose at" if _PROSE.fullmatch(span) else "spelled email")
    elif any(c.isalpha() for c in span):
        out.append("letters")
    else:
        out += [name for name, good in (("ip", _IP.fullmatch(span) and _is_ip(span)), ("card", _is_card(span)), ("four", _GROUPS.fullmatch(span)), ("plus", _PHONE.fullmatch(span) and _is_phone(span)), ("national", _NATIONAL.fullmatch(span)), ("trunk", _TRUNK.fullmatch(span))) if good]
        out.append(f"separators{len(set(span) - set('0123456789'))}")
        if span.count("(") != span.count(")"):
            out.append("open bracket")
        if before in (" ", "-", ".", "/") and before and "0" <= text[start - 2 : start - 1] <= "9":
            out.append("digits before")
        if after in (" ", "-", ".", "/") and after and "0" <= text[end + 1 : end + 2] <= "9":
            out.append("digits after")
    if before.isalnum() or before in ("@", ".", "-", "/", "+", "#", "$", "_", "(") and before:
        out.append("glued before")
    if after.isalnum() or after in ("@", "-", "/", "_", ")") and after or after == "." and text[end + 1 : end + 2].isalnum():
        out.append("glued after")
    return out + [f"cue {kind}" for kind, words in _CUES.items() if cue in words]


def _tokens(text: str, low: int, high: int) -> tuple[list[re.Match], list[int]]:
    """The tokens of text[low:high] and their starts (and the end)."""
    tokens = list(_TOKEN.finditer(text, low, high))
    return tokens, [t.start() for t in tokens] + [high]


def _candidates(text: str, tokens: list[re.Match], places: list[int]) -> Iterator[tuple[int, int, list[str]]]:
    """The candidate segments (first token, token after the last, features), by first token."""
    kinds = [("d" if "0" <= (c := t[0][0]) <= "9" else "a" if c.isalpha() else "s" if c.isspace() else c) for t in tokens]
    cue, cues = "", []
    for t, kind in zip(tokens, kinds, strict=True):
        cues.append(cue)
        if kind == "a":
            cue = t[0].lower()
    for i, kind in enumerate(kinds):
        if kind not in ("d", "a", "+", "("):
            continue
        digits = marks = words = spelled = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            k = kinds[j]
            if k == "s" and (len(tokens[j][0]) > 1 or tokens[j][0] in "\n\r") or k not in ("d", "a", "s") and k not in "+()[]{}.-/@%_":
                break
            if k == "d":
                digits += len(tokens[j][0])
            elif k == "a":
                words += 1
                spelled += tokens[j][0] in ("at", "AT")
            elif k == "@":
                marks += 1
            if marks > 1 or words > 10 or words and not (marks or spelled) and words > 3 or digits > 24:
                break
            if k in ("d", "a") and (digits >= 7 and not words or (marks or spelled) and j > i + 1 or digits >= 4 and not words and j > i + 4):
                yield i, j + 1, _span_features(text, places[i], places[j + 1], cues[i])


def segments(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token starts (and the end) of text[low:high], and the candidate segments."""
    tokens, places = _tokens(text, low, high)
    return places, list(_candidates(text, tokens, places))


def _sum_logs(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _settle(best: list[float], back: list, done: int, to: int) -> None:
    """Makes the sums after `done`, up to `to`, final: a token left out counts 0, and wins a tie."""
    for k in range(done + 1, to + 1):
        if best[k - 1] >= best[k]:
            best[k], back[k] = best[k - 1], None


class Field:
    """Weights by (type, feature)."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def score(self, kind: str, features: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def decode(self, text: str, low: int, high: int) -> list[Span]:
        """The best segmentation's spans. Candidates are scored as they come, so that none are held."""
        tokens, places = _tokens(text, low, high)
        best, back, done = [0.0] * len(places), [None] * len(places), 0
        for i, j, features in _candidates(text, tokens, places):
            _settle(best, back, done, i)
            done = i
            for kind in KINDS:
                if (s := self.score(kind, features)) > 0 and best[i] + s > best[j]:  # below 0 it loses to leaving its tokens out
                    best[j], back[j] = best[i] + s, (i, kind)
        _settle(best, back, done, len(places) - 1)
        spans, j = [], len(places) - 1
        while j > 0:
            if back[j]:
                spans.append((places[back[j][0]], places[j], back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return spans[::-1]


def train(examples: list[tuple[str, list[Span]]], rounds: int = 8, rate: float = 0.5, penalty: float = 2e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps, one example at a time."""
    prepared = []
    for text, gold in examples:
        places, found = segments(text, 0, len(text))
        true = {(places.index(a), places.index(b), kind) for a, b, kind in gold}
        prepared.append((len(places) - 1, [(i, j, kind, [(kind, f) for f in features], (i, j, kind) in true) for i, j, features in found for kind in KINDS]))
    weights: dict[tuple[str, str], float] = {}
    scale: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        for n, found in prepared:
            scored = [(i, j, sum(weights.get(f, 0.0) for f in features)) for i, j, _, features, _ in found]
            ends: list[list] = [[] for _ in range(n + 1)]
            starts: list[list] = [[] for _ in range(n + 1)]
            for i, j, s in scored:
                ends[j].append((i, s))
                starts[i].append((j, s))
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _sum_logs([alpha[j - 1], *(alpha[i] + s for i, s in ends[j])]) if ends[j] else alpha[j - 1]
            for i in range(n - 1, -1, -1):
                beta[i] = _sum_logs([beta[i + 1], *(beta[j] + s for j, s in starts[i])]) if starts[i] else beta[i + 1]
            slope: dict[tuple[str, str], float] = {}
            for (i, j, s), (_, _, _, features, true) in zip(scored, found, strict=True):
                p = math.exp(alpha[i] + s + beta[j] - alpha[n]) - true
                if abs(p) > 1e-6:
                    for f in features:
                        slope[f] = slope.get(f, 0.0) + p
            for f, g in slope.items():
                g += penalty * weights.get(f, 0.0)
                scale[f] = scale.get(f, 1e-8) + g * g
                weights[f] = weights.get(f, 0.0) - rate * g / math.sqrt(scale[f])
    return Field(weights)


def generated(n: int = 320, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sentences with one or no entity, and its span."""
    draw = random.Random(seed)
    number = lambda k: "".join(draw.choices("0123456789", k=k))
    word = lambda: "".join(draw.choices("abcdefghiklmnoprstuvw", k=draw.randint(2, 8)))

    def card(grouped: bool) -> str:
        body = str(draw.randint(3, 6)) + number(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return " ".join(body[k : k + 4] for k in range(0, 16, 4)) if grouped else body

    def long_number(k: int) -> str:
        while luhn(x := str(draw.randint(1, 9)) + number(k - 1)):
            pass
        return x

    octets = lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4))
    forms = {
        "email": [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}{number(2)}@{word()}.{word()}.org", lambda: f"{word()} at {word()} dot com", lambda: f"{word()} (at) {word()} (dot) net", lambda: f"{word()}[at]{word()}[dot]org", lambda: f"{word()} @ {word()}.com", lambda: f"{word()}.{word()} (at) {word()}.com"],
        "ip": [octets, octets],
        "card": [lambda: card(False), lambda: card(True), lambda: card(True).replace(" ", "-"), lambda: card(True).replace(" ", ".")],
        "phone": [lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"+49 30 {number(7)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: f"0{draw.randint(11, 99)} {number(4)} {number(4)}", lambda: f"00{draw.randint(20, 49)} {number(2)} {number(7)}"],
    }
    none = [
        lambda: f"20{number(2)}-{draw.randint(10, 12)}-{draw.randint(10, 28)} {draw.randint(10, 23)}.{number(2)}.{number(2)}", lambda: f"{draw.randint(10, 28)}.{draw.randint(10, 12)}.20{number(2)}", lambda: f"{number(1)}.{number(2)}.{number(2)}", lambda: f"{number(7)}", lambda: f"{number(9)}", lambda: f"#{number(8)}",
        lambda: long_number(16), lambda: long_number(14), lambda: long_number(18), lambda: "".join(draw.choices("0123456789abcdef", k=40)), lambda: f"${number(3)},{number(3)}.{number(2)}", lambda: f"{number(4)} {number(4)} {number(4)}", lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()}.{draw.choice(('com', 'org'))}", lambda: f"@{word()}", lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: f"{number(3)} {number(3)} {number(3)}", lambda: f"{number(4)}-{number(4)}", lambda: f"20{number(2)}{number(4)}{number(6)}", lambda: f"met at {word()} near the {word()} dot", lambda: f"{number(5)}-{number(5)}", lambda: f"20{number(2)}-0{number(1)}-{draw.randint(10, 28)} at {draw.randint(10, 23)}.{number(2)}.{number(2)}", lambda: f"30{number(1)}.{number(3)}.{number(3)}.{number(3)}", lambda: f"{number(10)}", lambda: f"{number(12)}",
        lambda: "".join(draw.choices("ABDEFGINRST", k=2)) + " ".join([number(2), *(number(4) for _ in range(draw.randint(3, 5))), number(draw.randint(1, 4))]), lambda: " ".join([number(2), f"0{number(3)}", number(4), number(4), number(2)]),
    ]
    out = []
    for k in range(n):
        kind = (*KINDS, None, None, None)[k % 7]
        head = " ".join(word() for _ in range(draw.randint(0, 4)))
        if kind and draw.random() < 0.3:
            head = f"{head} {draw.choice(sorted(_CUES[kind]))}".strip()
        head = head + " " if head else ""
        body = draw.choice(forms[kind] if kind else none)()
        tail = draw.choice([".", ",", "", " " + word(), f" {word()} {word()}.", "\n" + word()])
        out.append((head + body + tail, [(len(head), len(head) + len(body), kind)] if kind else []))
    return out


@lru_cache(1)
def trained() -> Field:
    return train(generated())


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with the field's that touch none of them."""
    base = base_spans(text)
    added: list[Span] = []
    for low, high in _regions(text, base):
        added += [s for s in field.decode(text, low, high) if all(s[1] <= a or b <= s[0] for a, b, _ in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _regions(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """The stretches to read: each holds whole every segment that its anchors can be in; those that touch are one."""
    low = high = -1
    for m in _ANCHOR.finditer(text):
        if any(a <= m.start() and m.end() <= b for a, b, _ in base):
            continue
        if m.start() > high:
            before = _before(text, m.start())
            if before > high:
                if high >= 0:
                    yield low, high
                low = before
        high = max(high, _after(text, m.end()))
    if high >= 0:
        yield low, high


def _before(text: str, start: int) -> int:
    """Where the tokens begin that a segment with an anchor at `start` may have before it, and CONTEXT tokens for its cue."""
    want, size = MAX_TOKENS + CONTEXT, REGION
    while True:
        tokens = list(_TOKEN.finditer(text, max(0, start - size), start))
        if size >= start or len(tokens) > want:  # the first of them may be part of a token
            return tokens[-want:][0].start() if tokens else start
        size *= 2


def _after(text: str, end: int) -> int:
    """Where the tokens end that a segment with an anchor up to `end` may have after it, and the one that follows."""
    for k, t in enumerate(_TOKEN.finditer(text, end)):
        end = t.end()
        if k >= MAX_TOKENS:
            break
    return end


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(part: pa.RecordBatch) -> dict:
        found = [all_spans(t or "", shared.value) for t in part.column(1).to_pylist()]
        rows = lambda k: [[{"start": a, "end": b, "kind": kind} for a, b, kind in x[k]] for x in found]
        return {"doc_id": part.column(0), "base": rows(0), "spans": rows(1)}

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    kind = "array<struct<start: long, end: long, kind: string>>"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, base {kind}, spans {kind}", ["doc_id", "base", "spans"], [pa.int64(), span, span])


def pii_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op7, from find_pii(), and n_spans, the number of all spans."""
    found = find_pii(docs)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(text: str, spans: list[Span]) -> str:
    """The text with `<KIND>` in place of each span; spans that overlap make one, of the first's kind."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out.append(text[done:a] + f"<{kind.upper()}>")
        done = max(done, b)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with personal data redacted: same columns and rows, n_chars brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if t is None else redact(t, all_spans(t, shared.value)[1]) for t in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = map_rows(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
