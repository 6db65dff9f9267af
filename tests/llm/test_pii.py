"""Personal data: the base against the agreed patterns, disguises against planted cases, the registered query against both."""

import hashlib
import random
import re

import pytest

from claimlens.llm import pii, queries
from claimlens.llm.common import table

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base by the agreed patterns, as they are written."""
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d)))
            right = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and doubled % 10 == 0, "phone": 9 <= len(d) <= 15}
            if right[kind]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_of_random_texts():
    r = random.Random(3)
    for alphabet in ("a@.b ", "1. 2", "+1 (0)-.9", "4 -1", "@a.1-+ %_\n", "é@a.z1 "):
        for _ in range(1500):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert pii.detected(text) == plain(text), text
    for text in ("4111 1111 1111 1111", "378282246310005", "1.2.3.256", "0001.02.3.4.5", "+49 172 3456789x", "a@b.c@d.e", "1" * 3000 + ".1.1.1"):
        assert pii.detected(text) == plain(text)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("see john.doe (at) example (dot) com.", "email", "john.doe (at) example (dot) com"),
        ("john[at]example.com", "email", "john[at]example.com"),
        ("écrire à ann AT corp DOT io !", "email", "ann AT corp DOT io"),
        ("a_at_b_dot_org", "email", "a_at_b_dot_org"),
        ("jоhn＠еxаmple.com ok", "email", "jоhn＠еxаmple.com"),
        ("jo​hn@ex​ample.com", "email", "jo​hn@ex​ample.com"),
        ("call plus four nine one seven two three four five six seven eight!", "phone", "plus four nine one seven two three four five six seven eight"),
        ("plus double four seven nine eight seven six five four three two one", "phone", "plus double four seven nine eight seven six five four three two one"),
        ("ñ +４９ (０１７) ５５５-７７１３", "phone", "+４９ (０１７) ５５５-７７１３"),
        ("٤٥٦ +٤٩ ١٧٢ ٣٤٥٦٧٨٩", "phone", "+٤٩ ١٧٢ ٣٤٥٦٧٨٩"),
        ("card: quatre un un un un un un un un un un un un un un un", "card", "quatre un un un un un un un un un un un un un un un"),
        ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
        ("host one nine two dot one six eight dot one dot one zero.", "ip", "one nine two dot one six eight dot one dot one zero"),
        ("10 [dot] 0 [dot] 0 [dot] 1", "ip", "10 [dot] 0 [dot] 0 [dot] 1"),
        ("x@y.co[dot]uk", "email", "x@y.co[dot]uk"),
    ],
)
def test_disguises(text, kind, source):
    find = pii.Transducers(pii.character_table())
    new = pii.added(text, pii.detected(text), find(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in new] == [(kind, source)]


@pytest.mark.parametrize(
    "text", ["look at example.com. Dot", "at one point we met at home", "one two three and four", "we meet @ 5. Then", "почта россии", "le un et le deux, un point", "I’d say “no” — at 5 dot", "12½ m² n° 4", "mañana, punto final"]
)
def test_clean_texts_stay_clean(text):
    assert pii.added(text, pii.detected(text), pii.Transducers(pii.character_table())(text)) == []


def test_alignment_of_rewritten_texts():
    text = "\u200ba＠bc\u200b (dot) com one two three"
    out = pii.Transducers(pii.character_table())(text)
    assert out.text == "a@bc.com 123"
    assert [text[a:b] for a, b in zip(out.first, out.last)] == ["a", "＠", "b", "c", " (dot) ", "c", "o", "m", " ", "one", "two", "three"]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co and c [at] d.com", "x"), (3, "a@b.co and c [at] d.com", "x"), (None, "+1 (017) 555-7713 " + "z" * 200_000 + " 10.1.2.3", "x")]
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added, r.spans) for r in got] == [(0, 0, 0, 0, 0, "")] * 2 + [(1, 0, 0, 0, 1, "email:0:6,email:11:23")] * 2 + [(0, 1, 0, 1, 0, "phone:0:17,ip:200019:200027")]
    assert got[0].base_sha256 == empty and got[2].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op13(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = queries.QUERIES["op13_pii_spans"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    find = pii.Transducers(pii.character_table())
    for r in got:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        # without the search for signs of disguise
        assert r.spans == pii.joined(sorted(base + pii.added(texts[r.doc_id], base, find(texts[r.doc_id]))))
