import random
import re

from isohypse.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and P.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_equal_the_expressions(rows):
    rng = random.Random(1)
    bits = ["a", "b.c", "@", "@@", ".", "-", "+", "+1", "1", "23", "255.", "256", "1.2.3.4", "0" * 5, " ", "  ", "(499) 555-6503", "4465758382889437", "\u00e9", "x@y.z", "%", "m-1.", "\u0663"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + [t or "" for _, t in rows]
    for t in texts:
        assert P.base_spans(t) == brute(t)


def test_repeated_numbers_get_one_label(documents):
    field = P.fit(documents)
    text = "call +1 (499) 555-6503 now and then (499) 555-6503 again or bob@example.com"
    base, spans = P.all_spans(text, field)
    assert set(base) <= set(spans) and len(base) == 2


def test_skip_edges_link_distant_repeats():
    tokens = P.tokens_of("555-6503 " + "word " * 50 + "5556503")
    (a, b), = P._links(tokens)
    assert tokens[a][2] == "555-6503" and tokens[b][2] == "5556503"


def test_table_and_masking(documents, rows, empty):
    out = P.find(documents).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), *[sum(s[0] == k for s in brute(t or "")) for k in range(4)]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out) == want
    masked = {r.doc_id: r.text for r in P.redact(documents).where("doc_id < 0").collect()}
    assert "<EMAIL>" in masked[-8] and "example.org" not in masked[-8] and masked[-1] is None
    assert P.find(empty).count() == 0
