import random

import pytest

from shellgraph.llm import pii as M


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutes(size):
    f = M.Feistel(b"k")
    out = [f.hide(x, size, b"t") for x in range(size)]
    assert sorted(out) == list(range(size)) and all(f.show(y, size, b"t") == x for x, y in enumerate(out))
    assert size < 97 or (out != [M.Feistel(b"other").hide(x, size, b"t") for x in range(size)] and out != [f.hide(x, size, b"u") for x in range(size)])


GOOD = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["1987-02-28", "31/12/1999", "2.3.2004", "12/31/1999", "2000/02/29"],
    "ip": ["8.8.8.8", "192.168.10.254"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (555) 555-5657", "(212) 555-0199", "+49 170 1234567", "555-867-5309"],
    "email": ["Jane.Doe+x@mail3.example.com", "a@b.co"],
    "secret": ["40d78" + "a1" * 18, "DEADBEEF01" * 4],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in GOOD.items() for v in vs])
def test_kinds(kind, value):
    p, back = M.Pseudonyms(b"key"), M.Pseudonyms(b"key", back=True)
    text, found = p.replace(f"see {value}, ok")
    assert [k for *_, k, _ in found] == [kind] and text != f"see {value}, ok"
    new = found[0][3]
    same = lambda a, b: a == b or (a.isdigit() and b.isdigit()) or (a.isalpha() and b.isalpha() and a.isupper() == b.isupper())
    if kind not in ("ip", "date", "secret"):
        assert len(new) == len(value) and all(same(a, b) for a, b in zip(value, new, strict=True))
    if kind != "date":
        assert back.one(kind, new) == value
    assert p.spans(f"see {new}, ok")[0][2] == kind  # still valid in its format
    assert p.replace(f"{value}|{value}")[0].split("|") == [new, new]


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "2023-02-30", "300.1.1.1", "1.2.3.4.5", "666-45-6789", "DE88370400440532013000", "a@b", "v12345", "no 1234567 here", "@", "", "x4111111111111111", "f" * 31 + "g", "2353820953013749"])
def test_clean_stays(text):
    assert M.Pseudonyms(b"key").replace(text) == (text, [])


@pytest.mark.parametrize("value,kind,after,kinds", [
    ("4539 1488 0343 6467", "card", " 12/27", []), ("4111 1111 1111 1111", "card", " 123", []), ("4539148803436467", "card", " 190.1.2.3", ["ip"]), ("4111-1111-1111-1111", "card", " 123-45-6789", ["ssn"]),
    ("340000000000009", "card", " 4111 1111 1111 1111", ["card"]), ("4111111111111111", "card", " 123@x.org", ["email"]), ("+44 20 7946 0958", "phone", " 2024 12", []),
    ("+1 (826) 555-4081", "phone", " 190.137.223.204", ["ip"]), ("+1 (826) 555-4081", "phone", " 19.1.2.3", ["ip"]), ("+1 (826) 555-4081", "phone", " 4111 1111 1111 1111", ["card"]), ("BE68 5390 0754 7034", "iban", " PAID BY", []),
])
def test_values_before_more_digits(value, kind, after, kinds):
    """What follows a value neither hides it nor changes its pseudonym, and isn't cut."""
    p = M.Pseudonyms(b"key")
    alone = p.one(kind, value)
    text, found = p.replace(f"see {value}{after}, ok")
    assert [k for *_, k, _ in found] == [kind, *kinds] and text.startswith(f"see {alone} ")
    assert found[-1][1] == len(f"see {value}{after}") or not kinds


def test_case_and_links():
    p = M.Pseudonyms(b"key")
    assert p.one("email", "Bob@X.org").lower() == p.one("email", "bob@x.org")
    rng = random.Random(2)
    cards = set()
    while len(cards) < 300:
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        cards.add(body + next(c for c in "0123456789" if M.luhn(body + c)))
    assert len({p.one("card", c) for c in cards}) == 300 and all(M.luhn(p.one("card", c)) for c in cards)


def test_odd(spark, odd, none):
    rows = M.pseudonymise(odd, b"key").collect()
    before = sorted(str((r.doc_id, r.text)) for r in odd.collect())
    assert sorted(str((r.doc_id, r.text)) for r in rows) == before and all(r.n_private == 0 and r.kinds == [] for r in rows)
    assert M.pseudonymise(none, b"key").collect() == []
    df = spark.createDataFrame([(1, "mail me@x.org or +1 (555) 555-5657 now", "a"), (2, "y" * 200_000 + " 8.8.8.8", "a")], "doc_id long, text string, kinds string")
    r = {r.doc_id: r for r in M.pseudonymise(df, b"key").collect()}
    assert (r[1].n_private, r[1].kinds) == (2, ["email", "phone"]) and "me@x.org" not in r[1].text and r[2].kinds == ["ip"]


def test_dates_never_meet():
    """Every date of 1900 to 2099 in eight notations: no two values share a pseudonym, each keeps its notation."""
    from datetime import date, timedelta

    step = lambda n, size, tweak: (n * 31_337 + 911) % size  # noqa: E731  a permutation as good as any here, and quick
    days = [date(1900, 1, 1) + timedelta(n) for n in range((date(2100, 1, 1) - date(1900, 1, 1)).days)]
    forms = ["{d:02}/{m:02}/{y}", "{m:02}/{d:02}/{y}", "{d}/{m}/{y}", "{m}/{d}/{y}", "{d:02}/{m}/{y}", "{d}/{m:02}/{y}", "{y}-{m:02}-{d:02}", "{d:02}.{m:02}-{y}"]
    values = {f.format(d=t.day, m=t.month, y=t.year) for f in forms for t in days}
    new = {v: M._date(v, step) for v in values}
    assert len(set(new.values())) == len(values)
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    assert all(shape(v) == shape(n) for v, n in new.items())


@pytest.mark.parametrize("value", ["2021-03-04", "04/03/2021", "3/14/2021", "4.3.2021", "04.3.2021", "12.3.2021", "2021/03/04"])
def test_dates_back(value):
    p, back = M.Pseudonyms(b"key"), M.Pseudonyms(b"key", back=True)
    assert back.one("date", p.one("date", value)) == value != p.one("date", value)


def test_dates_in_text():
    p = M.Pseudonyms(b"key")
    new = p.one("date", "2021-03-04")
    assert p.replace("at 2021-03-04T10:00:00Z")[0] == f"at {new}T10:00:00Z"
    assert p.one("date", "2021/03/04") == new.replace("-", "/") and p.one("date", "04.03.2021") == ".".join(new.split("-")[::-1])
    assert [k for *_, k, _ in p.replace("am 2.3.2004. Von 01/02/2003-05/02/2003")[1]] == ["date"] * 3
    for text in ("0.2.3.2004", "2.3.2004.1", "2021-03-04Tx", "v1.2.3.2004"):
        assert p.replace(text) == (text, [])
