import re

from ledgerloom.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text or "")]
    out += [("ip", *m.span()) for m in IP.finditer(text or "") if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text or ""):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text or "") if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


TEXTS = ["a@b.c", "x@y z@w.co.uk.", "a@b@c.d", "@a.b", "p.q%+-@x-.y-", "1.2.3.4", "1.2.3.4.5", "256.1.1.1 01.002.3.255", "1.2.3", "4111 1111 1111 1111",
         "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (017) 555-7713 x", "+1", "+12345678 ", "+1 (017) ((((", "é\U0001F600 mail é@x.de a@x.de",
         "10.0.0.1@x.com", "+1.2.3.4.5.6.7.8", "1" * 5000, "a" * 5000, "0000000000000000", "+49 30 1234567\n+49 30 1234568", "a@b..c", ""]


def test_base_equals_the_patterns():
    import random

    draw = random.Random(5)
    texts = TEXTS + ["".join(draw.choice("0123456789 .-+@()ax") for _ in range(draw.randint(1, 90))) for _ in range(4000)]
    for text in texts:
        assert private.base_spans(text) == brute(text), text
    long = "7" * 300_000 + "@" + "b" * 300_000 + " +1 " + "(" * 300_000
    assert private.base_spans(long) == []


def test_patterns_find_unseen_values(docs_of):
    seeds = [(i, f"please call me at +1 (20{i}) 555-01{i:02d} today") for i in range(6)]
    others = [(10, "you can call me at (206) 555-0199 today"), (11, "the ratio was 206 555 0177 there"), (12, None), (13, ""),
              (14, "call me at +1 (209) 555-0109 today"), (14, "call me at +1 (209) 555-0109 today"), (None, "mail x@y.org"), (15, "w " * 40_000)]
    docs = docs_of(seeds + others, "spans base kind")
    rows = {r["doc_id"]: r for r in private.find_private(docs).collect()}
    assert private.find_private(docs).count() == len(seeds + others)
    assert rows[10]["spans"] == "phone:19:33" and rows[10]["n_phone"] == 0 and rows[10]["base"] == ""
    assert rows[11]["spans"] == "" and rows[12]["spans"] == "" and rows[None]["spans"] == "email:5:12"
    masked = {r["doc_id"]: r["text"] for r in private.mask_private(docs).collect()}
    assert masked[10] == "you can call me at [PHONE] today" and masked[11] == others[1][1] and masked[12] is None
    assert private.mask_private(docs).columns == docs.columns and private.mask_private(docs).count() == len(seeds + others)
    assert private.find_private(docs.limit(0)).count() == 0


def test_mask_joins_overlaps():
    assert private.mask("abcdefgh", "card:1:4,phone:3:6") == "a[CARD]gh"


def brute_trusted(texts):
    """The values that patterns confirm, by plain loops over all pairs of pattern and value."""
    seeds, values, edges = set(), set(), set()
    for text in texts:
        base = private.base_spans(text)
        both = base + private.loose_spans(text, base)
        for i, ((k, s, e), around) in enumerate(zip(both, private.contexts(text or "", both))):
            v = (k, private.value(k, text[s:e]))
            values.add(v)
            if i < len(base):
                seeds.add(v)
            edges |= {(k, p, v) for p in around}
    trust = {v: float(v in seeds) for v in values}
    for _ in range(200):
        sure = {}
        for key in {(k, p) for k, p, _ in edges}:
            of = [trust[v] for k, p, v in edges if (k, p) == key]
            if sum(t >= private.VALUE_CONFIDENCE for t in of) >= private.PATTERN_SUPPORT:
                if sum(of) / len(of) >= private.PATTERN_CONFIDENCE:
                    sure[key] = sum(of) / len(of)
        for v in values - seeds:
            left = 1.0
            for k, p, w in edges:
                if w == v and (k, p) in sure:
                    left *= max(1 - sure[k, p], 1e-6)
            trust[v] = max(trust[v], 1 - left)
    return {v for v in values - seeds if trust[v] >= private.VALUE_CONFIDENCE}


def test_contexts_are_whole_words():
    around = lambda text: private.contexts(text, private.base_spans(text))
    long = "w" * 130
    assert around(f"call {long} +49 30 1234567 Now99 x") == [[f"call {long} _", f"{long} _ now00"]]
    assert around("a b1:+49 30 1234567") == [["a b0: _"]] and around("+49 30 1234567") == [[]]
    assert around("x@y.de , z@w.de")[1] == ["<email> , _"] and around("to x@y.de z@w.de")[0] == ["to _ <email>"]
    vast = around("v" * 400_000 + " x@y.de " + "u" * 400_000)[0]
    assert len(vast) == 1 and len(vast[0]) <= private.LONG_PATTERN and vast != around("v" * 399_999 + " x@y.de " + "u" * 400_000)[0]
    assert len(around("a@b.c," * 50_000)) == 50_000


def test_compressed_addresses():
    found = lambda text: [(k, text[s:e]) for k, s, e in private.loose_spans(text, private.base_spans(text))]
    assert found("at 2001:db8::1, fe80::1:2 and ::1") == [("ip", "2001:db8::1"), ("ip", "fe80::1:2"), ("ip", "::1")]
    assert found("1:2:3:4:5:6:7:8") == [("ip", "1:2:3:4:5:6:7:8")]
    assert not found("12:30:45 a:b :: 1::2::3 std::dead 12345::1 x " + "f" * 400_000)


def test_long_chains_are_followed(docs_of):
    """Each value makes the pattern sure that confirms the next one; no number of rounds is fixed."""
    number = lambda i: f"(2{i:02d}) 555-{1000 + i}"
    rows = []
    for i, w in enumerate("abcdefgh"):  # six of eight values are too few, the value before makes a pattern sure
        have = [f"+1 (200) 555-{j:04d}" for j in range(6)] + ([number(i)] if i else []) + [number(i + 1)]
        rows += [f"go {w} {x} end{'.' * j}{w}" for j, x in enumerate(have)]
    rows += ["no way 206 555 0177 there", "1 2 2001:db8::1 3", None, ""]
    docs = docs_of(list(enumerate(rows)))
    got = {(r["kind"], r["value"]) for r in private.trusted_values(private.mentions(docs)).collect()}
    assert got == brute_trusted(rows) == {("phone", private.value("phone", number(i))) for i in range(1, 9)}


def test_hidden_seeds_are_found_again(docs_of):
    """A tenth of the numbers lose their country code and are found again where contexts recur; other numbers are left."""
    import random

    draw = random.Random(11)
    ways = ["please call me at {} today", "our office number is {} for questions", "fax line open under {} until six"]
    rows, hidden = [], {}
    for i in range(300):
        plain = f"({draw.randint(200, 989)}) {draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
        if i % 10 == 3:
            hidden[i] = plain
        rows.append((i, ways[i % 3].format(plain if i in hidden else "+1 " + plain)))
    rows += [(1000 + i, f"batch {draw.choice('abcdef')} of {200 + i} 555 {1000 + i} pieces was sold") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in private.find_private(docs_of(rows)).collect()}
    found = [i for i in hidden if got[i]]
    wrong = [i for i, _ in rows if i >= 1000 and got[i]]
    assert len(found) >= 0.9 * len(hidden) and not wrong
