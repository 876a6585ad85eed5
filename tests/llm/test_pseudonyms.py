import datetime
import hashlib
import random
import re

from yardmaster.llm import pseudonyms

from .helpers import frame


def rewritten(spark, texts, key="k"):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymized(table, key).collect()}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def test_formats_and_checks_hold(spark):
    cards = [b + next(str(c) for c in range(10) if luhn(b + str(c))) for b in (f"4{n * 7919:014d}" for n in range(200))]
    got = rewritten(spark, cards)
    new = [got[i].text for i in range(len(cards))]
    assert all(luhn(x) and len(x) == 16 for x in new) and len(set(new)) == len(cards) and sum(a == b for a, b in zip(cards, new)) <= 1
    dates = [(datetime.date(1990, 1, 1) + datetime.timedelta(days=31 * i)).isoformat() for i in range(200)]
    new = [r.text for r in rewritten(spark, dates).values()]
    assert len(set(new)) == 200 and all(1800 <= datetime.date.fromisoformat(x).year < 2200 for x in new)
    ips = [f"10.{i}.{i * 7 % 256}.9" for i in range(200)]
    new = [r.text for r in rewritten(spark, ips).values()]
    assert len(set(new)) == 200 and all(len(x.split(".")) == 4 and max(map(int, x.split("."))) < 256 for x in new)
    ssns = [f"{100 + i:03d}-{i % 99 + 1:02d}-{i + 1:04d}" for i in range(200)]
    new = [r.text for r in rewritten(spark, ssns).values()]
    assert len(set(new)) == 200 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new)


def test_equal_values_stay_linked_and_keys_matter(spark):
    texts = ["card 4539578763621486.", "4539 5787 6362 1486", "x@y.org a@b.example.com", "a@b.example.com!", "+1 (017) 555-7713", "tel +1 (017) 555-7713%%%", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "born 01/02/1990 or 02.01.1990"]
    got = rewritten(spark, texts)
    assert got[0].text[5:-1] == got[1].text.replace(" ", "") and got[1].text.count(" ") == 3
    assert got[2].text.split()[1] == got[3].text[:-1]
    assert got[4].text == got[5].text[4:-3] and got[4].text.startswith("+1 (")
    iban = got[7].text
    assert iban == got[6].text.replace(" ", "") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(r.n_replaced == (2 if i in (2, 8) else 1) for i, r in got.items())
    other = rewritten(spark, texts, key="another")
    assert all(other[i].text != got[i].text for i in got)


def test_what_does_not_validate_stays(spark):
    texts = ["4539578763621487", "999.1.1.1 1.2.3.4.5 01.2.3.4", "1987-02-30 2024-13-01", "000-12-3456", "v1.2.3 costs 1,234.56 in 2024", "GB82WEST12345698765433", "no@domain", "plain words", "", None]
    got = rewritten(spark, texts)
    assert [got[i].text for i in range(len(texts))] == texts and all(r.n_replaced == 0 for r in got.values())


def test_cases_and_other_forms_are_found_and_linked(spark):
    token = "9233a8ec" * 5
    texts = [f"token = '{token}'", f"TOKEN = '{token.upper()}'", token[:20] + token[20:].upper(), "2024-05-01", "AT 2024-05-01T10:00:00Z", "3/4/2024", "2024/03/04", "2024-3-4", "4.3.2024", "+14155552671", "415 555 2671", "+44 20 7946 0958", "2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "::ffff:10.1.2.3", "see a::b, 10:30:00 and std::add"]
    got = {i: r.text for i, r in rewritten(spark, texts).items()}
    assert all(got[i] != t for i, t in enumerate(texts[:-1])) and got[15] == texts[15]
    assert got[1] == got[0].upper() and got[2].lower() == got[0][9:-1]
    assert got[4] == f"AT {got[3]}T10:00:00Z"
    day = datetime.date(*map(int, got[7].split("-")))
    assert tuple(map(int, got[5].split("/"))) == (day.month, day.day, day.year) and got[6] == f"{day:%Y/%m/%d}" and got[8] == f"{day.day}.{day.month}.{day.year}"
    assert re.fullmatch(r"\+1\d{10}", got[9]) and re.fullmatch(r"\d{3} \d{3} \d{4}", got[10]) and re.fullmatch(r"\+44 \d\d \d{4} \d{4}", got[11])
    assert got[12].upper() == got[13] and got[12].count(":") == 7 and got[14].startswith("::ffff:")


def test_odd_tables(spark):
    table = frame(spark)
    got = pseudonyms.pseudonymized(table, "k", count="replaced")
    assert got.columns == [*table.columns, "replaced"]
    assert sorted(map(repr, (r[:6] for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in table.collect())))
    assert pseudonyms.pseudonymized(frame(spark, []), "k").count() == 0
    long = spark.createDataFrame([(1, "w" * 200_000 + " a@b.org " + "1" * 5000 + " 10.1.2.3 " * 2000)], "doc_id long, text string")
    row = pseudonyms.pseudonymized(long, "k").first()
    assert row.n_replaced == 2001 and "10.1.2.3" not in row.text


def plain_prf(key, kind, turn, x):
    return hashlib.sha512(f"{key}|{kind}|{turn}|{x}".encode()).hexdigest()


def plain_numbers(key, kind, a, b, n_a, n_b):
    for t in range(8):
        if t % 2 == 0:
            a = (a + int(plain_prf(key, kind, t, b)[:12], 16)) % n_a
        else:
            b = (b + int(plain_prf(key, kind, t, a)[:12], 16)) % n_b
    return a, b


def plain_text(key, kind, text, alphabets):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]

    def moved(x, stream):
        out = ""
        for i, c in enumerate(x):
            by = int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)
            home = next((s for s in alphabets if c in s), None)
            out += home[(home.index(c) + by) % len(home)] if home else c
        return out

    for t in range(8):
        if t % 2 == 0:
            a = moved(a, plain_prf(key, kind, t, b))
        else:
            b = moved(b, plain_prf(key, kind, t, a))
    return a + b


def plain_card(key, digits):
    body = plain_text(key, "card", digits[:-1], ["0123456789"])
    total = sum(d if i % 2 else d // 5 + d * 2 % 10 for i, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def plain_ssn(key, ssn):
    area, group, serial = map(int, ssn.split("-"))
    a, b = plain_numbers(key, "ssn", area - 1 if area < 666 else area - 2, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + 1 if a < 665 else a + 2:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def plain_day(key, day):
    n = (datetime.date.fromisoformat(day) - datetime.date(1800, 1, 1)).days
    a, b = plain_numbers(key, "date", n // 773, n % 773, 189, 773)
    return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).isoformat()


def test_pseudonyms_equal_a_plain_model(spark):
    rng = random.Random(14)
    want = []
    for i in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        total = sum(d if k % 2 else d // 5 + d * 2 % 10 for k, d in enumerate(map(int, reversed(body))))
        card = body + str(-total % 10)
        ssn = f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}"
        day = (datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146097))).isoformat()
        ip = [rng.randrange(256) for _ in range(4)]
        a, b = plain_numbers("k", "ipv4", ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], 1 << 16, 1 << 16)
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(32, 65)))
        text = f"card {card}, ssn {ssn}; day {day} at {'.'.join(map(str, ip))} has {secret}!"
        new = f"card {plain_card('k', card)}, ssn {plain_ssn('k', ssn)}; day {plain_day('k', day)} at {a >> 8}.{a & 255}.{b >> 8}.{b & 255} has {plain_text('k', 'hex', secret, ['0123456789abcdef'])}!"
        want.append((i, text, new))
    got = pseudonyms.pseudonymized(spark.createDataFrame([(i, t, 1) for i, t, _ in want], "doc_id long, text string, n_replaced int"), "k")
    assert got.columns == ["doc_id", "text", "n_replaced", "_n_replaced"]
    assert {r.doc_id: r.text for r in got.collect()} == {i: new for i, _, new in want}
