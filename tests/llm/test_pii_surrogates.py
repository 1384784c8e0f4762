import re

from boxwright.llm import pii_surrogates as p

TEXT = (
    "Dear Mr. John Smith and Mrs Anna SMITH, write to Bob.Q7@Mail.Example.com or bob.q7@mail.example.com, call +1 (499) 555-6503 or +1 499.555.6503. "
    "Card 4111 1111 1111 1111, IP 10.1.2.33, SSN 123-45-6789, DE89 3704 0044 0532 0130 00. Господин Иван Петров"
)


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def run(spark, rows, key="k"):
    return p.replace_private(spark.createDataFrame(rows, "doc_id long, text string, n_chars string"), key).collect()


def test_formats_and_coreference(spark):
    rows = [(1, TEXT, "a"), (2, None, "b"), (3, "", "c"), (None, "x@y.org", "d"), (4, "plain text 12, v1.2.3", "e"), (5, "Mr Smith again 4111111111111111", "f"), (5, "Mr Smith again 4111111111111111", "f")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    new = {r.doc_id: r.text for r in got}
    assert new[2] is None and new[3] == "" and new[4] == rows[4][1]
    shape = lambda t: re.sub(r"\d", "9", t)
    for pattern in (r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\+1 \d{3}\.\d{3}\.\d{4}", r"\d{4} \d{4} \d{4} \d{4}", r"\d{3}-\d{2}-\d{4}", r"\d\d\.\d\.\d\.\d\d", r"DE\d\d(?: \d{4}){4} \d\d"):
        old, now = re.search(pattern, TEXT), re.search(pattern, new[1])
        assert now and old[0] != now[0] and shape(old[0]) == shape(now[0])
    phones = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[ (\d).-]+\d", new[1])]
    assert phones[0] == phones[1] != "14995556503"
    mails = re.findall(r"\S+@[\w.]+\w", new[1])
    assert mails[0].lower() == mails[1] and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z]\d@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com", mails[0])
    card = re.search(r"(?:\d{4} ){3}\d{4}", new[1])[0]
    assert luhn(card) and card[0] == "4" and card.replace(" ", "") in new[5]
    first = re.search(r"Mr\. (\w+) (\w+) and Mrs (\w+) (\w+),", new[1])
    assert first[1] in p.GIVEN["latin", "m"].split() and first[3] in p.GIVEN["latin", "f"].split()
    assert first[4] == first[2].upper() and f"Mr {first[2]} again" in new[5]
    assert re.search(r"Господин ([А-Я][а-я]+) ([А-Я][а-я]+)$", new[1])[1] in p.GIVEN["cyrillic", "m"].split()
    counts = {r.doc_id: tuple(r[f"n_{k}"] for k in p.KINDS) for r in got}
    assert counts[1] == (2, 2, 1, 1, 1, 1, 3) and counts[5] == (0, 0, 1, 0, 0, 0, 1) and counts[4] == (0,) * 7
    assert {r.doc_id: r.text for r in run(spark, rows)} == new
    assert {r.doc_id: r.text for r in run(spark, rows, "other")}[1] != new[1]


def test_distinct_where_the_space_is_small(spark):
    ips = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    rows = [(i, f"from {x} to {ips[0]}", "") for i, x in enumerate(ips)]
    got = {r.doc_id: re.findall(r"[\d.]+\d", r.text) for r in run(spark, rows)}
    new = [got[i][0] for i in range(len(ips))]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)
    assert {x[1] for x in got.values()} == {new[0]}


def test_long_and_odd_texts(spark):
    rows = [(1, "a@" + "b." * 30_000, ""), (2, "x" * 100_000 + " me@here.org", ""), (3, "@" * 1000 + "1" * 1000, "")]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[2].n_email == 1 and got[2].text.startswith("x" * 100_000 + " ") and got[3].text == rows[2][1]
    assert run(spark, []) == []


def test_further_mentions_and_gender(spark):
    rows = [
        (1, "Mr John Smith called. Smith said that John, SMITH's friend, is in. Smithers and blacksmith stay.", ""),
        (2, "Dr Anna Brown met Mrs Anna Brown. Anna's dog is brown, Brown said.", ""),
        (3, "Smith without a title in this text.", ""),
        (4, "Dr Mr", ""),
    ]
    got = {r.doc_id: r for r in run(spark, rows)}
    given, surname = re.match(r"Mr (\w+) (\w+) called", got[1].text).groups()
    assert got[1].text == f"Mr {given} {surname} called. {surname} said that {given}, {surname.upper()}'s friend, is in. Smithers and blacksmith stay."
    assert got[1].n_name == 4
    first = re.match(r"Dr (\w+) (\w+) met", got[2].text).groups()
    assert first[0] in p.GIVEN["latin", "f"].split()
    assert got[2].text == f"Dr {first[0]} {first[1]} met Mrs {first[0]} {first[1]}. {first[0]}'s dog is brown, Brown said." and got[2].n_name == 3
    assert got[3].text == rows[2][1] and got[3].n_name == 0


def test_phone_formats(spark):
    phones = ["+33 1 23 45 67 89", "01 23 45 67 89", "020 7946 0958", "030 1234567", "555 123 4567", "5551234567", "0301234567", "+1 (499) 555-6503"]
    rows = [(i, f"call {x}.", "") for i, x in enumerate(phones)]
    others = ["05/2024", "01-02-2024", "01/02/2024 10:00", "1700000000", "v1.2.3", "12 345 678", "2024-01-02 10:11:12", "0.123456789"]
    rows += [(100 + i, f"at {x} it was", "") for i, x in enumerate(others)]
    got = {r.doc_id: r for r in run(spark, rows)}
    shape = lambda t: re.sub(r"\d", "9", t)
    for i, text, _ in rows:
        if i < 100:
            assert got[i].n_phone == 1 and got[i].text != text and shape(got[i].text) == shape(text), text
        else:
            assert got[i].text == text


def mod97(iban):
    x = re.sub(r"\s", "", iban)
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_country_codes_check_digits_and_domains(spark):
    phones = ["+49 30 1234567", "+351 21 123 4567", "+1 499 555 6503", "+47 12 34 56 78", "+7 495 123 45 67"]
    rows = [(i, f"call {x} now", "") for i, x in enumerate(phones)]
    rows += [(10, "IBAN DE89 3704 0044 0532 0130 00 or GB29 NWBK 6016 1331 9268 19 or DE88 3704 0044 0532 0130 00", "")]
    rows += [(20 + i, f"to {x}@Mail.shop.example and {x}@other.example", "") for i, x in enumerate(["ann", "bob", "eve", "a", "b", "c"])]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    for i, x in enumerate(phones):
        assert got[i] != rows[i][1] and got[i].startswith("call " + x.split()[0] + " "), x
    old, new = (re.findall(r"[A-Z]{2}\d\d(?: [A-Z0-9]{2,4})+", t) for t in (rows[5][1], got[10]))
    assert [x[:2] for x in new] == ["DE", "GB", "DE"] and [mod97(x) == 1 for x in new] == [mod97(x) == 1 for x in old] == [True, True, False]
    mails = [re.findall(r"(\S+)@(\S+)", got[20 + i]) for i in range(6)]
    assert len({m[0][1] for m in mails}) == len({m[1][1] for m in mails}) == 1 and mails[0][0][1] != mails[0][1][1]
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[a-z]{4}\.example", mails[0][0][1]) and "mail.shop" not in mails[0][0][1].lower()
    assert len({m[0][0] for m in mails}) == 6
