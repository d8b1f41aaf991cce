import hashlib
import math
import random
import re

import pytest

from millrace.llm import pii_crf as p

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    check = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and check(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], p.KINDS.index(s[2])))


def test_base_spans_are_the_patterns():
    draw = random.Random(3)
    for _ in range(20000):
        text = "".join(draw.choices("0123456789.@+-() ab%_1.1", k=draw.randint(1, 40)))
        assert p.base_spans(text) == brute_base(text), text


def test_decoding_is_the_best_segmentation():
    field = p.trained()
    for text, _ in p.generated(30, seed=8):
        places, found = p.segments(text, 0, len(text))
        scored = [(i, j, kind, field.score(kind, f)) for i, j, f in found for kind in p.KINDS]

        def best(at, scored=scored, last=len(places) - 1, memo=None):
            memo = {} if memo is None else memo
            if at == last:
                return 0.0
            if at not in memo:
                memo[at] = max([best(at + 1, scored, last, memo), *(s + best(j, scored, last, memo) for i, j, _, s in scored if i == at)])
            return memo[at]

        index = {(places[i], places[j], kind): s for i, j, kind, s in scored}
        assert math.isclose(sum(index[s] for s in field.decode(text, 0, len(text))), best(0), abs_tol=1e-9)


def test_held_out_sentences():
    field, right = p.trained(), 0
    examples = p.generated(300, seed=77)
    for text, gold in examples:
        right += field.decode(text, 0, len(text)) == gold
    assert right / len(examples) > 0.95


def test_added_spans():
    field = p.trained()
    for text, kind, span in [("write to anna (at) example (dot) org today", "email", "anna (at) example (dot) org"), ("call (212) 555-0187 now", "phone", "(212) 555-0187")]:
        base, spans = p.all_spans(text, field)
        assert not base and [(k, text[a:b]) for a, b, k in spans] == [(kind, span)]
    for clean in ("on 2024-01-15 at 10.30.00", "version 1.2.3", "a commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "number 9807915762804490.", "Ordinary prose, nothing else. " * 50):
        assert p.all_spans(clean, field) == ([], []), clean


@pytest.mark.parametrize("address", ["jane.doe (at) example.com", "bob[at]example.org", "bob {AT} mail.example.org", "jane.doe at example.com", "bob AT example[.]org", "bob at alabelofmorethanfortylettersandnotasinglebreak dot com", "bob (at) alabelofmorethanfortylettersandnotasinglebreak (dot) com", "bob @ example.com"])
def test_every_spelled_form_is_read(address):
    assert p._SPELLED.fullmatch(address) or p._SPACED.fullmatch(address)
    for text in (f"write to {address} today", address):
        assert [(k, text[a:b]) for a, b, k in p.all_spans(text, p.trained())[1]] == [("email", address)]


@pytest.mark.parametrize("text", ["See more at example.com.", "Visit us at www.example.org today", "shown at news.example.co.uk, as ever", "read it AT example.com"])
def test_prose_before_a_domain_is_no_address(text):
    assert p.all_spans(text, p.trained()) == ([], [])


def test_generated_forms_in_the_whole_text():
    field = p.trained()
    for seed in (77, 78):
        for text, gold in p.generated(300, seed=seed):
            spans = p.all_spans(text, field)[1]
            assert set(spans) >= {s for s in field.decode(text, 0, len(text)) if s in gold}, text


@pytest.mark.parametrize("first", ["2024-05-12 10.30.00", "#12345678", "a.b@c.de", "@name", "room at the blue dot"])
@pytest.mark.parametrize("entity", ["jane.doe (at) northwindtraders (dot) com", "bob[at]example[dot]org", "0044 20 1234567", "(212) 555-0187"])
def test_entities_at_every_offset_after_an_anchor(first, entity):
    words = "some of the other plain words that fill a line with no meaning of their own and then still more".split() * 2
    for n in range(1, len(words)):
        text = " ".join(["Ordered", first, *words[:n], entity, "is the one to ask about all of this when it is late"])
        assert entity in [text[a:b] for a, b, _ in p.all_spans(text, p.trained())[1]], text


def test_long_tokens_and_many_anchors():
    field = p.trained()
    name = "a" * 400
    text = f"write to {name} (at) {name} (dot) com today"
    assert [text[a:b] for a, b, _ in p.all_spans(text, field)[1]] == [text[9:-6]]
    text = " ".join(f"bob{k} (at) example (dot) com, 2024-05-12 10.30.00," for k in range(200))
    assert len(p.all_spans(text, field)[1]) == 200
    for text, _ in p.generated(60, seed=6):
        many = "\n".join([text] * 5)
        found = [s for s in field.decode(many, 0, len(many)) if all(s[1] <= a or b <= s[0] for a, b, _ in p.base_spans(many))]
        assert set(p.all_spans(many, field)[1]) == set(found) | set(p.base_spans(many))


def test_rows(spark, docs):
    text = "é mail a.b@c.de, ip 10.0.0.1 card 4111 1111 1111 1111 or +1 (212) 555-0187"
    rows = docs((1, text), (2, None), (3, ""), (4, "word " * 30000 + "x@y.zz"), (1, text))
    got = p.pii_digest(rows).collect()
    by = {r["doc_id"]: r for r in got}
    joined = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(text))
    assert len(got) == 5 and (by[1]["n_email"], by[1]["n_ip"], by[1]["n_card"], by[1]["n_phone"]) == (1, 1, 1, 1)
    assert by[1]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and by[1]["spans"] == joined
    assert by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[4]["n_email"] == 1
    assert p.pii_digest(rows.limit(0)).collect() == []


def test_redaction(spark, docs):
    got = {r["doc_id"]: r for r in p.redacted(docs((1, "to a@b.cc and 10.0.0.1!"), (2, "clean"), (3, None))).collect()}
    assert got[1]["text"] == "to <EMAIL> and <IP>!" and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "clean" and got[3]["text"] is None


@pytest.mark.parametrize("text", ["@" * 3000, "1 " * 5000, "1" * 20000, "+1" * 5000, "a" * 20000 + "@", " at " * 2000 + " dot "])
def test_hostile_texts_end(text):
    assert p.base_spans(text) == brute_base(text) if len(text) < 15000 else p.base_spans(text) is not None
    p.all_spans(text, p.trained())


FORMS = ["(212) 555-0187", "anna.brown (at) example-host (dot) org", "jane.doe at example dot com", "030 4567 1234", "4111.1111.1111.1111", "bob[at]example[dot]org", "ann at mail dot example dot co dot uk"]


@pytest.mark.parametrize("first", FORMS)
def test_two_entities_at_every_distance(first):
    filler = "the quick brown fox jumps over a lazy dog and runs far away from all the noise of town " * 5
    for second in FORMS[:3]:
        for distance in range(0, 401, 1 if first in FORMS[:2] else 7):
            text = f"{first}, {filler[:distance].strip()}; {second} end"
            found = [text[a:b] for a, b, _ in p.all_spans(text, p.trained())[1]]
            assert found == [first, second], text


def test_groups_of_a_longer_number_are_no_phone():
    for text in ("IBAN DE89 3704 0044 0532 0130 00 please", "GB29 NWBK 6016 1331 9268 19"):
        assert p.all_spans(text, p.trained())[1] == []
    assert [k for _, _, k in p.all_spans("tel 0532 0130 00 please", p.trained())[1]] == ["phone"]
