import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from folioscope.llm import personal_data as pd

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 13 <= len(d) <= 19 and plain_luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TRICKY = [
    "a@b.c_d@e.f @@@ x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4650 1958 9880 3591, 4650-1958-9880-3591-1",
    "+1 (555) 010-2345. +12 +123456789 ++49 30 1234567", "a.b@c..d e@f.g.", "%@x.y", "1" * 5000 + "." + "2" * 50, "@" * 3000,
    "a" * 3000 + "@", "x@y.z@w.v", "mail me@here.org4650195898803591", "+1" * 50,
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_is_the_plain_patterns(text):
    assert pd.find(text)[0] == base(text)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("write john.doe [at] mail [dot] example [dot] com today", "email", "john.doe [at] mail [dot] example [dot] com"),
    ("john(at)example(dot)org", "email", "john(at)example(dot)org"),
    ("john at example dot com", "email", "john at example dot com"),
    ("j\u043ehn@example.com", "email", "j\u043ehn@example.com"),
    ("\uff4aane@example.com", "email", "\uff4aane@example.com"),
    ("ja\u200bne@example.com", "email", "ja\u200bne@example.com"),
    ("ip 192[.]168[.]1[.]20 here", "ip", "192[.]168[.]1[.]20"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("card four six five zero one nine five eight nine eight eight zero three five nine one.", "card",
     "four six five zero one nine five eight nine eight eight zero three five nine one"),
    ("+1 five five five zero one zero two three four five", "phone", "+1 five five five zero one zero two three four five"),
    ("+\uff14\uff19 30 1234567", "phone", "+\uff14\uff19 30 1234567"),
])
def test_disguises_map_back(text, kind, span):
    found, all_ = pd.find(text)
    assert set(found) <= set(all_)
    assert (kind, text.index(span), text.index(span) + len(span)) in all_


@pytest.mark.parametrize("text", [
    "we met at the end. dot", "look at this. one two", "at home (at) all", "one at a time", "see at example.com", "un deux trois",
])
def test_plain_prose_is_left_alone(text):
    assert pd.find(text) == ([], [])


DISGUISED = [
    "+44 seven 9 four 1 two 5 six 3 eight 0", "a\t@\tb.org", "a\n@\u00a0b.org", "a\ufe6bb.org", "a@b\ufe52org",
    "F\u00dcNF dot null dot null dot eins", "\u017feven \u017fix f\u0130ve dot one dot one dot one",
    "4\u2075 +\u2474 30 1234567", "one\u00a0nine\u3000two dot 1 dot 1 dot 1",
]
PIECES = [
    *pd.NUMBER_WORDS, "F\u00dcNF", "Z\u00c9RO", "\u017feven", "f\u0130ve", "s\u0131x", "plus", "plu\u017f", "dot", "pun\u212at", "at", "\u00c4T",
    "(at)", "[dot]", "{ . }", "< @ >", "@", "\t@\n", "a", "b.c", "mail", "org", "1", "44", "192", "+", "\ufe6b", "\ufe52", "\u2488",
    "\u200b", "_one_", "on\u00e9", "\u65e5\u672c",
]
BETWEEN = [" ", " ", "\t", "\n", ",", ".", "-", "", "  ", "\x1c", "\x85", "\u00a0", "\u3000", "_"]


def gated(texts):
    return [pd.find(t, bool(w)) for t, w in zip(texts, pd.worded(pa.array(texts)), strict=True)]


@pytest.mark.parametrize("text", DISGUISED[:5])
def test_gate_lets_disguises_through(text):
    found, all_ = gated([text])[0]
    assert len(all_) > len(found)


def test_gate_loses_nothing_the_transducers_find():
    rnd = random.Random(7)
    mixed = ["".join(rnd.choice(PIECES) + rnd.choice(BETWEEN) for _ in range(rnd.randint(1, 14))) for _ in range(20_000)]
    texts = DISGUISED + TRICKY + mixed
    assert gated(texts) == [pd.find(t, True) for t in texts]


def test_folded_letters_are_number_words():
    assert pd.find("one one dot \u017feven dot f\u0130ve dot s\u0131x")[1] == [("ip", 0, 34)]


def test_plain_matches_keep_their_spans():
    # The address part is plain; the card ends inside it, and the dot-spelled one elsewhere is rewritten.
    text = "4650195898803591.2.3.4 and one dot two dot 3 dot 4"
    assert ("card", 0, 16) in pd.find(text)[0]
    assert [s for s in pd.find(text)[1] if s[0] == "card"] == [("card", 0, 16)]


@pytest.mark.parametrize("frame", ["hard", "small", "clashing"])
def test_tables(request, frame):
    docs = request.getfixturevalue(frame)
    got = pd.personal_data(docs).collect()
    assert len(got) == docs.count()
    want = Counter()
    for r in docs.collect():
        b = base(r.text)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want[(r.doc_id, *(sum(k == x for k, _, _ in b) for x in PATTERNS), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want


def test_empty(empty):
    assert pd.personal_data(empty).count() == 0
