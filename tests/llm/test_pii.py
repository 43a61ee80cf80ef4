import hashlib
import re

from tests.llm.conftest import awkward
from tributary.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract, word for word."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(n) <= 19 and pii.luhn(n)):
                continue
            if kind == "phone" and not 9 <= len(n) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c@d.e x@y z@w.q.r. @no.where me@-.-- %+-@a.b",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 1..2.3.4.5 256.1.1.1.9.9.9.9 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 0000000000000 5",
    "+1 (980) 555-6268 +12 +1234567890123456789 ++491701234567 + 49 +4-9-1-7-0-1-2-3-4",
    "ü+1 (980) 555-6268, mail ä@b.de und x@b.de.",
]


def test_base_spans_follow_the_contract():
    for text in [*TRICKY, " ".join(TRICKY), "\n".join(TRICKY)]:
        assert pii.base_spans(text) == plain(text), text


def test_luhn_and_mod97():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


def test_extra_kinds_need_their_checks_or_context():
    kinds = lambda t: [s[0] for s in pii.pii_spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 NOW") == ["iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 NOW") == []
    assert kinds("my ssn is 123-45-6789.") == ["ssn"] and kinds("code 123-45-6789.") == []
    assert kinds("call (212) 555-0123 now") == ["local_phone"] and kinds("see (212) 555-0123 now") == []


def test_account_numbers_in_a_row():
    numbers = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE89 3704 0044 0532 0130 00"]
    for gap in (" ", "\n", ", ", "  "):
        text = gap.join(numbers)
        assert [text[s:e] for _, s, e in pii.extra_spans(text)] == numbers
    text = "ref AB12 GB82WEST12345698765432 and XY99ABCDEFGHIJKL DE89370400440532013000"
    assert [text[s:e] for _, s, e in pii.extra_spans(text)] == [numbers[1], numbers[0]]


def test_context_moves_the_score():
    score = lambda t: pii.pii_spans(t)[0][3]
    assert score("version 1.2.3.4") < score("1.2.3.4") < score("the server 1.2.3.4")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 50_000, "1." * 100_000, "+1" * 50_000, "A1 " * 50_000):
        pii.pii_spans(text)


def test_digest(frame):
    docs = frame([*awkward(), (8, TRICKY[1]), (9, "x@y.de " + TRICKY[2])]).selectExpr("*", "1 as spans", "2 as k")
    rows = pii.pii_digest(docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    for key, text in ((8, TRICKY[1]), (9, "x@y.de " + TRICKY[2]), (1, "")):
        spans = plain(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert by[key].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [by[key][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_masking(frame):
    docs = frame([(1, "mail me@x.de or 1.2.3.4!"), (2, None), (3, "")])
    assert [r.text for r in pii.mask_pii(docs).orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP]!", None, ""]
