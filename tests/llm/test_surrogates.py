from __future__ import annotations

import re

from sessionlens.llm import surrogates as S

KEY = b"test"
TEXT = (
    "Mr. John Smith met Frau Anna Müller. Smith wrote to John.Smith@Mail.example.com, or john.smith@mail.example.com. "
    "Call +1 (017) 555-7713 or +1 017 555 7713; card 4111 1111 1111 1111, 10.2.3.4 and 81.2.69.142, "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", 123-45-6789, DE89 3704 0044 0532 0130 00, г-жа Анна Петрова.'
)


def rewritten(spark, rows, columns="doc_id long, text string"):
    return S.replace_personal_data(spark.createDataFrame(rows, columns), KEY).collect()


def test_kinds_that_are_found():
    found = {(TEXT[a:b], k) for a, b, k in S.mentions(TEXT)}
    assert found == {
        ("John", "given_m"), ("Smith", "family"), ("Anna", "given_f"), ("Müller", "family"), ("John.Smith@Mail.example.com", "email"),
        ("john.smith@mail.example.com", "email"), ("+1 (017) 555-7713", "phone"), ("+1 017 555 7713", "phone"), ("4111 1111 1111 1111", "card"),
        ("10.2.3.4", "ipv4"), ("81.2.69.142", "ipv4"), ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"), ("123-45-6789", "ssn"),
        ("DE89 3704 0044 0532 0130 00", "iban"), ("Анна", "given_f"), ("Петрова", "family"),
    }
    assert not S.mentions("On 2024-01-15, in 1990-2000, 12.5 of 100 000 words; version 1.2.3, a token: of it, Mr and Dr walk at 10:30.")


def test_short_forms_of_addresses_and_secrets():
    text = 'At 2001:db8::1, fe80::1 or 2001:DB8:0:0:0:0:0:1; ::ffff:10.1.2.3. password=hunter "pwd": "open sesame" api_key=\'abc\' passwd = ok'
    found = [(text[a:b], k) for a, b, k in S.mentions(text)]
    assert found == [
        ("2001:db8::1", "ipv6"), ("fe80::1", "ipv6"), ("2001:DB8:0:0:0:0:0:1", "ipv6"), ("::ffff:10.1.2.3", "ipv6"),
        ("hunter", "secret"), ("open sesame", "secret"), ("abc", "secret"), ("ok", "secret"),
    ]
    assert S.canonical("ipv6", "2001:db8::1") == S.canonical("ipv6", "2001:DB8:0:0:0:0:0:1")
    assert S.surrogate("ipv6", "fe80::1", KEY).startswith("fe80:")
    assert not S.mentions("std::sort, add::bad and a::b at 10:30:45; password == other, password=*** and token: none")


def test_layout_type_and_coreference(spark):
    (row,) = rewritten(spark, [(1, TEXT)])
    new = row["text"]
    for a, b, k in S.mentions(TEXT):
        if k not in ("given_m", "given_f"):
            assert TEXT[a:b] not in new
    shape = lambda x: re.sub(r"\d", "9", x)
    phones = re.findall(r"\+\d[ ()\d-]{10,}\d", new)
    assert [shape(p) for p in phones] == ["+9 (999) 999-9999", "+9 999 999 9999"]
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    mails = re.findall(r"\S+@\S+\.com", new)
    assert len(mails) == 2 and mails[0] != mails[1] and mails[0].lower() == mails[1]
    first, second = re.search(r"Mr\. \w+ (\w+) met", new)[1], re.search(r"\. (\w+) wrote", new)[1]
    assert first == second
    assert re.search(r"Frau \w+a ", new) and re.search(r"г-жа [А-Я][а-я]+а [А-Я][а-я]+\.", new)
    assert S._luhn(re.sub(r"\D", "", re.search(r"card ([\d ]{19})", new)[1])) == 0
    assert " 10." in new and re.search(r'token = "[0-9a-f]{40}"', new)
    assert row["replaced"] == len(S.mentions(TEXT))


def test_distinct_entities_stay_distinct(spark):
    """A private network has 254 * 254 addresses here: drawn once, some of 3000 would collide."""
    entities = [f"192.168.{1 + i // 250}.{1 + i % 250}" for i in range(3000)]
    first = {S.surrogate("ipv4", e, KEY) for e in entities}
    assert len(first) < 3000 or first & set(entities)
    rows = [(i, f"from {e} again {e}") for i, e in enumerate(entities)]
    got = {r["doc_id"]: re.findall(r"\d+\.\d+\.\d+\.\d+", r["text"]) for r in rewritten(spark, rows)}
    assert all(a == b for a, b in got.values())
    new = {a for a, _ in got.values()}
    assert len(new) == 3000 and not new & set(entities)


def test_full_networks_and_name_spaces_end(spark):
    """All 254 * 254 addresses that surrogates in 192.168 are first drawn from are entities themselves."""
    full = [("ipv4", f"192.168.{a}.{b}") for a in range(1, 255) for b in range(1, 255)]
    small = [("secret", str(d)) for d in range(10)]
    entities = spark.createDataFrame(full + small, "kind string, entity string")
    got = S.settled_surrogates(entities, KEY).collect()
    assert len(got) == len({(r["kind"], r["surrogate"]) for r in got}) == len(full) + len(small)
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(full + small)
    assert all(r["surrogate"].startswith(("10.", "192.168.")) for r in got if r["kind"] == "ipv4")
    for kind, entity in (("given_f", "Anna"), ("phone", "5550100"), ("email", "a@b.com"), ("secret", "a")):
        at = [S.surrogate(kind, entity, KEY, attempt) for attempt in range(40)]
        assert max(map(len, at)) > max(map(len, at[:4])) and S.laid_out(kind, entity, at[-1]).lower() == at[-1].lower()


def test_edge_cases(spark):
    rows = [(1, "a@b.com", 1, "x"), (1, "a@b.com", 1, "x"), (None, "A@b.com", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (4, "plain", 1, "x"), (5, "w " * 200_000 + "a@b.com", 1, "x")]
    got = rewritten(spark, rows, "doc_id long, text string, row long, again string")
    texts = [(r["doc_id"], r["text"]) for r in got if r["doc_id"] != 5]
    mail = next(t for i, t in texts if i == 1)
    assert mail != "a@b.com" and texts.count((1, mail)) == 2
    assert (None, mail[0].upper() + mail[1:]) in texts
    assert (2, None) in texts and (3, "") in texts and (4, "plain") in texts
    assert next(r["text"] for r in got if r["doc_id"] == 5).endswith(" " + mail)
    assert {r["row"] for r in got} == {1} and {r["again"] for r in got} == {"x"}
    assert rewritten(spark, [], "doc_id long, text string") == []


def test_numbers_that_are_no_cards_stay(spark):
    for text in ("order 1234567890123", "ISBN 978-3-16-148410-0", "9783161484100", "a run of 5731080387325255 here"):
        assert S.mentions(text) == []
    assert [k for *_, k in S.mentions("card 4111 1111 1111 1111 and 4222222222222")] == ["card", "card"]
    assert [k for *_, k in S.mentions("call +49 30 901820 or 030 9018200")] == ["phone", "phone"]


def test_one_person_has_one_given_name_whatever_the_title(spark):
    text = "Dr Maria Lopez spoke. Mrs Maria Lopez left."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = S.replace_personal_data(docs, b"key").first()["text"].split()
    assert words[1] == words[5] != "Maria" and words[2] == words[6] != "Lopez"
