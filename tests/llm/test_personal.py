import hashlib
import random
import re

from weatherloom.llm import personal

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, m):
    n = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(n) <= 19 and luhn(n)
    return kind == "email" or 8 <= len(n) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_equal_plain_regular_expressions(make_docs):
    rng = random.Random(5)
    bits = ["a@b.c", "%d@e.f", "x.y+z@mail-1.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "12", "7", " ", "-", "+1 (375) 555-4393", "+49", "é", "日本", "\n", "++", "(", "5105105105105100", "foo", "+1((((", "1.1", "\U0001f600"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += [None, "", "a" * 20000, "1" * 20000, "1." * 9000, "a@" + "b." * 9000, "+1" + "(" * 20000, ("x@y.zz " * 300)]
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    for row in personal.digest(personal.find(docs)).collect():
        want = base_spans(texts[row.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), texts[row.doc_id][:200]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for x, _, _ in want) for k, _ in BASE]
        assert row.spans.startswith(line)


def test_added_kinds_need_checksum_or_context(make_docs):
    texts = {
        1: "account DE89 3704 0044 0532 0130 00 thanks",
        2: "account DE89 3704 0044 0532 0130 01 thanks",
        3: "iban GB82WEST12345698765432.",
        4: "call 123-45-6789 now",
        5: "her SSN: 123-45-6789 now",
        6: "amex 3782 822463 10005",
        7: "plain words",
    }
    found = {r.doc_id: r.spans for r in personal.digest(personal.find(make_docs(list(texts.items())))).collect()}
    assert found == {1: "iban:8:35", 2: "", 3: "iban:5:27", 4: "", 5: "ssn:9:20", 6: "amex:5:22", 7: ""}


def test_context_raises_score_and_empty_table(make_docs):
    rows = personal.find(make_docs([(1, "ip address 10.0.0.1"), (2, "xx 10.0.0.1")])).collect()
    scores = {r.doc_id: r.ip[0].score for r in rows}
    assert scores[1] > scores[2]
    assert personal.digest(personal.find(make_docs([]))).count() == 0
