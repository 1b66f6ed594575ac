import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import pii

KEY = "k"


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 37, 1000):
        assert sorted(pii.feistel(i, size, b"k" * 32, b"t") for i in range(size)) == list(range(size))


def test_formats_stay():
    cases = {
        "card": ["4757965300669737", "4757 9653 0066 9737", "4757-9653-0066-9737"],
        "phone": ["+1 (415) 555-7713", "+1 (017) 555-7713", "(017) 555-7713", "+49 30 1234567"],
        "ipv4": ["97.51.17.173"],
        "ssn": ["123-45-6789"],
        "email": ["und.34@mail7.example.com"],
        "date": ["2021-03-04", "04/07/1999", "4.7.1999", "12/31/1999"],
    }
    for kind, values in cases.items():
        for v in values:
            new = pii.pseudonym(kind, v, KEY)
            assert new != v and new == pii.pseudonym(kind, v, KEY)
            if kind not in ("ipv4", "date"):
                assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", new)) == re.sub("[a-z]", "a", re.sub("[0-9]", "9", v))
    card = pii.pseudonym("card", "4757 9653 0066 9737", KEY).replace(" ", "")
    assert card == pii.pseudonym("card", "4757965300669737", KEY) and pii.luhn_digit(card[:-1]) == card[-1]
    datetime.date.fromisoformat(pii.pseudonym("date", "2021-03-04", KEY))


def test_invalid_values_stay():
    for text in ("1234567890123456", "300.1.1.1", "31.02.2020", "000-12-3456", "1.2.3.4.5", "2021-13-01", "no data"):
        assert pii.pseudonymised(text, KEY) == (text, [])


def test_numbers_side_by_side():
    card, other, phone = "4757965300669737", "4845168114407329", "+1 (017) 555-7713"
    for text, kinds in ((f"{card} {other}", ["card", "card"]), (f"12 {card} 345", ["card"]), (f"{card}-1", ["card"]), (f"{phone} 12", ["phone"]), (f"7 {phone} {card}", ["phone", "card"])):
        new, spans = pii.pseudonymised(text, KEY)
        assert [k for *_, k in spans] == kinds
        assert card not in new and other not in new and phone not in new
        for s, e, k in spans:
            assert pii.pseudonym(k, text[s:e], KEY) in new and text[s:e] in (card, other, phone)


def test_ssn_walks_to_valid_ones():
    for n in range(100):
        assert pii.valid_ssn(int(pii.pseudonym("ssn", f"123-45-{n + 1:04d}", KEY).replace("-", "")))


@settings(max_examples=80, deadline=None)
@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)))
def test_dates_stay_distinct(a, b):
    x, y = (pii.pseudonym("date", d.isoformat(), KEY) for d in (a, b))
    assert (x == y) == (a == b)


def test_tables(odd, empty, spark):
    done = pii.pseudonymise(odd, KEY)
    assert set(done.columns) == set(odd.columns) and done.count() == odd.count()
    assert {r.text for r in done.collect() if r.doc_id in (1, 2)} == {None, ""}
    assert pii.pseudonymise(odd, KEY, spans_col=None).columns == odd.columns
    assert pii.digest(pii.pseudonymise(empty.drop("pii_spans"), KEY)).collect() == []
    df = spark.createDataFrame([(1, "call +1 (017) 555-7713 now"), (2, "or +1 (017) 555-7713"), (3, "x " * 200_000 + "4757965300669737")], "doc_id long, text string")
    a, b, c = sorted(pii.digest(pii.pseudonymise(df, KEY)).collect())
    assert a.text.split("call ")[1][:17] == b.text.split("or ")[1]
    assert c.n_card == 1 and c.spans == "card:400000:400016" and "4757965300669737" not in c.text


def test_other_spellings():
    phones = ("415-555-2671", "415.555.2671", "1-415-555-2671", "1.415.555.2671", "+1.415.555.2671", "(415) 555 2671", "(415) 555-2671", "1 (415) 555-2671", "+14155552671", "+1 415 555 2671")
    dates = ("2021/03/04", "2021/3/4", "2021.03.04", "03/04/21", "3/4/21", "12/31/99", "4 March 2021", "04 Mar 2021", "MARCH 4, 2021", "dec 31 1999")
    for kind, values in (("phone", phones), ("date", dates)):
        for v in values:
            new, spans = pii.pseudonymised(f"on {v}, at", KEY)
            assert spans == [(3, 3 + len(v), kind)] and v not in new
            again = new[3 : -len(", at")]
            assert pii.pseudonymised(f"on {again}, at", KEY)[1] == [(3, 3 + len(again), kind)]
    assert len({"".join(c for c in pii.pseudonym("phone", v, KEY) if c.isdigit())[-10:] for v in phones}) == 1
    assert pii.pseudonym("phone", "+14155552671", KEY).startswith("+1") and pii.pseudonym("phone", "+442071838750", KEY).startswith("+44")
    new, spans = pii.pseudonymised("at 2021-03-04T10:00:00Z", KEY)
    assert spans == [(3, 13, "date")] and new.endswith("T10:00:00Z") and "2021-03-04" not in new
    for text in ("1.2.3", "31/02/21", "30 February 2021", "415-555-26711", "1415-555-2671", "2021/13/01", "2021-03-04Tx", "12 maybe 2021"):
        assert pii.pseudonymised(text, KEY) == (text, [])


def test_two_digit_years_stay_distinct():
    days = [datetime.date(1950, 1, 1) + datetime.timedelta(days=7 * n) for n in range(5000)]
    assert len({pii.pseudonym("date", f"{d:%d/%m/%y}", KEY) for d in days}) == 5000


def test_addresses_of_every_length():
    """Local parts of 1 to 1200 characters end, keep their shape, and change nearly everywhere."""
    for n in [*range(1, 401), 511, 512, 513, 1024, 1025, 1200]:
        for letter in "q7":
            found = letter * n + "@example.com"
            new, spans = pii.pseudonymised(f"to {found}.", KEY)
            assert spans == [(3, 3 + len(found), "email")] and len(new) == len(found) + 4
            if n >= 100:
                assert sum(c == letter for c in new[3 : 3 + n]) < n / (2 if letter == "q" else 1.5)
    assert pii.pseudonym("email", "a" * 600 + "@x.com", KEY)[:512] != pii.pseudonym("email", "a" * 599 + "b@x.com", KEY)[:512]


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"[A-Za-z0-9._%+-]{1,80}@[a-z]{1,9}\.[a-z]{2,4}", fullmatch=True))
def test_random_addresses_end(found):
    new = pii.pseudonym("email", found, KEY)
    assert new.rpartition("@")[2] == found.rpartition("@")[2] and len(new) == len(found)


def test_long_runs_without_an_address():
    pii.pseudonymised("a1-" * 300_000 + " 1-2", KEY)


def test_short_names_are_permuted():
    names = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    assert sorted(pii.permuted_name(x, b"k" * 32, b"t") for x in names) == names


def test_phones_stay_valid():
    for n in range(200):
        new = pii.pseudonym("phone", f"+1 (415) 555-{n:04d}", KEY)
        assert pii.valid_number("".join(c for c in new if c.isdigit())[1:])
        assert not pii.valid_number("".join(c for c in pii.pseudonym("phone", f"+1 (017) 555-{n:04d}", KEY) if c.isdigit())[1:])


def test_key_of_the_session(spark):
    old = spark.conf.get(pii.KEY_SETTING, None)
    spark.conf.unset(pii.KEY_SETTING)
    made = pii.session_key(spark)
    assert len(made) == 64 and pii.session_key(spark) == made
    spark.conf.set(pii.KEY_SETTING, old or made)


def independent(text):
    """Findings by a plain scan: every start, kinds in order, the longest match of each pattern by itself."""
    out, at, compiled = [], 0, {k: re.compile(p, re.ASCII) for k, p in pii.PATTERNS.items()}
    while at < len(text):
        for kind, pattern in compiled.items():
            if not (m := pattern.match(text, at)):
                continue
            found = m[0]
            while kind == "card" and pii.pseudonym(kind, found, KEY) is None and (cut := max(found.rfind(" "), found.rfind("-"))) > 0:
                found = found[:cut]
            if pii.pseudonym(kind, found, KEY) is not None:
                out.append((at, at + len(found), kind))
                at += len(found) - 1
            else:
                while at + 1 < m.end() and text[at].isdigit() and text[at + 1].isdigit():
                    at += 1
            break
        at += 1
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    linked = {}
    total = 0
    for r in pii.pseudonymise(docs, KEY).collect():
        old, new = texts[r.doc_id], r.text or ""
        spans = [(s.start, s.end, s.kind) for s in r.pii_spans]
        assert spans == independent(old)
        shift, rest = 0, []
        for s, e, kind in spans:
            want = pii.pseudonym(kind, old[s:e], KEY)
            assert new[s + shift : s + shift + len(want)] == want
            assert linked.setdefault((kind, old[s:e]), want) == want
            shift += len(want) - (e - s)
            rest.append(old[s:e])
        assert len(new) == len(old) + shift
        total += len(spans)
    assert total and len(set(linked.values())) == len(linked)
