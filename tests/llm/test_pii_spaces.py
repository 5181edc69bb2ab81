import itertools
import string

from ledgerloom.llm import pii

from .util import docs


def test_crowded_formats_find_surrogates(spark):
    names = ["".join(x).capitalize() for x in itertools.islice(itertools.product("bdfgklmnpr", "aeiou", "bdfgklmnpr", "aeiou", "n", "ab"), 3000)]
    ips = [".".join(x) for x in itertools.islice(itertools.product("123456789", repeat=4), 6000)]
    mails = [f"{a}@{b}.de" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    rows = [(i, " ; ".join(f"Mrs {n} Smith" for n in part)) for i, part in enumerate(itertools.batched(names, 500))]
    rows += [(100 + i, " ; ".join(part)) for i, part in enumerate(itertools.batched(ips + mails, 500))]
    found = pii.surrogates(docs(spark, rows), b"key").collect()
    new = {(s.kind, r.text[s.start : s.end]) for r in found for s in r.spans}
    assert {k: sum(x[0] == k for x in new) for k in ("person", "ip", "email")} == {"person": len(set(names)) + 1, "ip": 6000, "email": 676}
    assert not {x for _, x in new} & {*names, *ips, *mails}


def test_grown_surrogates_keep_the_written_form():
    for kind, text, normal in (("email", "A.b@C.de", "a.b@c.de"), ("phone", "12 345 678", "12345678"), ("secret", "correct-horse-battery", "correct-horse-battery")):
        new = pii.written(text, kind, pii.surrogate(b"key", kind, normal, 7))
        assert len(new) == len(text) + 2 and new[0].isupper() == text[0].isupper()


def test_secrets_without_digits(spark):
    rows = [(1, "password: correct-horse-battery"), (2, "password: correct-horse-battery in 2024"), (3, "password: ____________")]
    found = {r.doc_id: r.text for r in pii.surrogates(docs(spark, rows), b"key").collect()}
    assert found[1] + " in 2024" == found[2] and "correct" not in found[1] and found[3] != rows[2][1]


def test_any_number_of_names_and_addresses(spark):
    # 100,000 surnames of six letters, of which the first space has 12,675 surrogates, and every address of four digits
    names = ["".join(x).capitalize() for x in itertools.islice(itertools.product("bdfgklmnpr", "aeiou", "bdfgklmnpr", "aeiou", "bdfgklmnpr", "aeioubdf"), 100_000)]
    ips = [".".join(x) for x in itertools.product(string.digits, repeat=4)]
    rows = [(i, " ; ".join(f"Mr {n}" for n in part)) for i, part in enumerate(itertools.batched(names, 2000))]
    rows += [(100 + i, " ; ".join(part)) for i, part in enumerate(itertools.batched(ips, 2000))]
    found = pii.surrogates(docs(spark, rows), b"key").collect()
    new = {(s.kind, r.text[s.start : s.end]) for r in found for s in r.spans}
    assert sum(k == "person" for k, _ in new) == len(set(names)) == 100_000 and sum(k == "ip" for k, _ in new) == 10_000
    assert not {x for _, x in new} & {*names, *ips}


def test_many_entities_in_one_text(spark):
    mails = [f"user{i}@host{i}.example" for i in range(200_000)]
    r = pii.surrogates(docs(spark, [(None, " ".join(mails))]), b"key").first()
    assert len(r.spans) == len(set(r.text.split())) == len(mails) and not set(r.text.split()) & set(mails)
