"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame operations only.

Values are found by pattern and validated; what doesn't validate stays as it is.
Each kind of value is permuted within its own format: a Feistel network adds a
keyed hash of one half to the other, alternately, so the map is one-to-one and
equal values have equal pseudonyms in every document. Check digits are made anew.

| kind | validated by | permuted |
|-|-|-|
| payment card | Luhn sum | all digits but the last, which is made anew |
| IBAN | remainder 1 by 97 | account part; check digits are made anew |
| date | calendar, 1800 to 2199 | the 146,097 days of that 400-year cycle |
| IPv4 address | octets to 255 | two halves of 16 bits |
| IPv6 address | eight groups, or fewer with a double colon | all 128 bits |
| social security number | ranges in use | area, and group with serial |
| phone number | form | digits after the country code |
| e-mail address | form | letters and digits before the last two labels |
| hexadecimal secret | 32 to 64 digits | all digits, the case put back |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_.+\-])", r"(?![\p{L}\p{N}_])"
EMAIL = r"[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
PHONE = r"(?:\+\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{1,3}[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|\d{3} \d{3} \d{4}|\+\d{8,15}|\+(?=(?:\d[ .\-]?){8})\d{1,3}(?:[ .\-]\d{1,4}){2,5}"
#: The country codes of one and two digits; the others have three.
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
IPV6 = rf"{_GROUPS}{{7}}|(?=[0-9A-Fa-f:]{{0,40}}::)(?=[A-Fa-f:]{{0,40}}[0-9])(?:{_GROUPS}{{0,6}})?::(?:{_GROUPS}{{0,6}})?"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
_TIME = r"(?=[Tt]\d{2}:?\d{2})"
SSN = r"\d{3}-\d{2}-\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
HEX = r"[0-9A-Fa-f]{32,64}"
CARD = r"\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}"
#: E-mail and phone may begin with what may not stand before the others.
ANY = rf"(?<![\p{{L}}\p{{N}}._%+\-]){EMAIL}|(?<![\p{{L}}\p{{N}}_])(?:{PHONE}){_AFTER}|(?<!:){_BEFORE}(?:{IPV6}){_AFTER}(?!:|\.\d)|{_BEFORE}(?:{DATE}){_TIME}|{_BEFORE}(?:{HEX}|{IBAN}|{IPV4}(?!\.?\d)|{DATE}|{SSN}(?!-)|{CARD}){_AFTER}"

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_DAY0, _DAYS = "1800-01-01", (189, 773)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _prf(key: str, kind: str, turn: Column, x: Column) -> Column:
    """128 hexadecimal digits that depend on the key."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), x.cast("string")).cast("binary"), 512)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def permuted_numbers(key: str, kind: str, a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """struct(a, b) permuted among n_a x n_b pairs."""

    def turn(s: Column, t: Column) -> Column:
        move = lambda x: _number(F.substring(_prf(key, kind, t, x), 1, 12))
        first = F.struct(((s["a"] + move(s["b"])) % n_a).alias("a"), s["b"].alias("b"))
        second = F.struct(s["a"].alias("a"), ((s["b"] + move(s["a"])) % n_b).alias("b"))
        return F.when(t % 2 == 0, first).otherwise(second)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def permuted_text(key: str, kind: str, text: Column, alphabets: list[str]) -> Column:
    """`text` with each character of an alphabet permuted within it, others in place."""

    def moved(x: Column, stream: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substr(x, i, F.lit(1))
            by = _number(F.substr(stream, (i - 1) % 32 * 4 + 1, F.lit(4)))
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                out = F.when(at > 0, F.substr(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(x) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), one), "")).otherwise(x)

    def turn(s: Column, t: Column) -> Column:
        first = F.struct(moved(s["a"], _prf(key, kind, t, s["b"])).alias("a"), s["b"].alias("b"))
        second = F.struct(s["a"].alias("a"), moved(s["b"], _prf(key, kind, t, s["a"])).alias("b"))
        return F.when(t % 2 == 0, first).otherwise(second)

    half = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text) - half).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: F.concat(s["a"], s["b"]))


def _luhn(digits: Column, double_last: bool) -> Column:
    """Luhn sum; the last digit is doubled or the one before it."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = let(d * 2, lambda x: F.when(x > 9, x - 9).otherwise(x))
        return total + F.when(i % 2 == (0 if double_last else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refilled(form: Column, characters: Column, kept: str) -> Column:
    """`form` with its characters outside the class `kept` replaced in turn by `characters`."""

    def one(i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(form, F.lit(1), i), kept, ""))
        c = F.substr(form, i, F.lit(1))
        return F.when(F.regexp_replace(c, kept, "") == "", c).otherwise(F.substr(characters, before, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _card(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        body = permuted_text(key, "card", F.substr(d, F.lit(1), F.length(d) - 1), [_DIGITS])
        new = let(body, lambda x: F.concat(x, ((10 - _luhn(x, True) % 10) % 10).cast("string")))
        return F.when(_luhn(d, False) % 10 == 0, let(new, lambda x: _refilled(m, x, "[^0-9]"))).otherwise(m)

    return let(F.regexp_replace(m, "[ \\-]", ""), made)


def _mod97(text: Column) -> Column:
    def add(rest: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        letter = F.instr(F.lit(_UPPER), c)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise((rest * 10 + c.try_cast("int")) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _iban(key: str, m: Column) -> Column:
    def made(s: Column) -> Column:
        country, account = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.length(s) - 4)
        valid = _mod97(F.concat(account, F.substr(s, F.lit(1), F.lit(4)))) == 1
        new = let(permuted_text(key, "iban", account, [_DIGITS, _UPPER]), lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        return F.when(valid, let(new, lambda x: _refilled(m, x, " "))).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), made)


def _date(key: str, m: Column) -> Column:
    # written without padding if a field is
    short = m.rlike(r"(?:^|[/.\-])\d(?:[/.\-]|$)")

    def made(form: str) -> Column:
        def permuted(day: Column) -> Column:
            n = F.datediff(day, F.lit(_DAY0).cast("date"))
            new = let(permuted_numbers(key, "date", F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS), lambda s: (s["a"] * _DAYS[1] + s["b"]).cast("int"))
            inside = (n >= 0) & (n < _DAYS[0] * _DAYS[1])
            written = let(F.date_add(F.lit(_DAY0).cast("date"), new), lambda d: F.when(short, F.date_format(d, form)).otherwise(F.date_format(d, form.replace("M", "MM").replace("d", "dd"))))
            return F.when(inside, written).otherwise(m)

        return let(F.try_to_timestamp(m, F.lit(form)).cast("date"), permuted)

    month_first = F.regexp_extract(m, r"^\d+", 0).try_cast("int") <= 12
    slashed = F.when(m.rlike("^[0-9]{4}"), made("yyyy/M/d")).when(month_first, F.coalesce(made("M/d/yyyy"), made("d/M/yyyy"))).otherwise(made("d/M/yyyy"))
    return F.coalesce(F.when(F.instr(m, "-") > 0, made("yyyy-M-d")).when(F.instr(m, "/") > 0, slashed).otherwise(made("d.M.yyyy")), m)


def _in_case_of(m: Column, new: Column) -> Column:
    """`new` (of lower case) in the case of `m`, place by place where that is mixed."""
    at = lambda text, i: F.substr(text, i, F.lit(1))
    mixed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), lambda i: F.when(at(m, i).rlike("[A-F]"), F.upper(at(new, i))).otherwise(at(new, i))), "")
    return F.when(~m.rlike("[A-F]"), new).when(~m.rlike("[a-f]"), F.upper(new)).otherwise(mixed)


def _hex(key: str, m: Column) -> Column:
    """One value has one pseudonym in either case."""
    return let(permuted_text(key, "hex", F.lower(m), [_HEX]), lambda new: _in_case_of(m, new))


def _ipv6(key: str, m: Column) -> Column:
    """The 128 bits permuted, so all spellings of an address stay linked; written as eight groups."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def made(sides: Column) -> Column:
        left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(sides[1])).otherwise(F.array().cast("array<string>"))
        missing = F.lit(8) - F.size(left) - F.size(right)
        valid = F.when(F.size(sides) > 1, missing >= 1).otherwise(missing == 0)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
        new = let(permuted_text(key, "ipv6", digits, [_HEX]), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(x, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":"))
        return F.when(valid, F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(new)).otherwise(new)).otherwise(m)

    return let(F.split(F.lower(m), "::"), made)


def _ipv4(key: str, m: Column) -> Column:
    def made(o: Column) -> Column:
        canonical = F.forall(o, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        n = lambda i: o[i].cast("int")
        pair = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        new = let(permuted_numbers(key, "ipv4", n(0) * 256 + n(1), n(2) * 256 + n(3), 1 << 16, 1 << 16), lambda s: F.concat_ws(".", pair(s["a"]), pair(s["b"])))
        return F.when(canonical, new).otherwise(m)

    return let(F.split(m, r"\."), made)


def _ssn(key: str, m: Column) -> Column:
    def made(p: Column) -> Column:
        area, group, serial = (p[i].cast("int") for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

        def written(s: Column) -> Column:
            out = F.when(s["a"] < 665, s["a"] + 1).otherwise(s["a"] + 2), F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1
            return F.concat_ws("-", *(F.lpad(x.cast("string"), w, "0") for x, w in zip(out, (3, 2, 4))))

        new = permuted_numbers(key, "ssn", F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return F.when(valid, let(new, written)).otherwise(m)

    return let(F.split(m, "-"), made)


def _after(key: str, kind: str, m: Column, head: str, tail: str) -> Column:
    """Letters and digits permuted between the patterns `head` and `tail`."""
    a, b = F.regexp_extract(m, f"^({head})", 1), F.regexp_extract(m, f"({tail})$", 1)
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.concat(s["a"], permuted_text(key, kind, F.substr(m, F.length(s["a"]) + 1, F.length(m) - F.length(s["a"]) - F.length(s["b"])), [_DIGITS, _LOWER, _UPPER]), s["b"]))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a found value; itself where it doesn't validate."""
    is_a = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.instr(m, "@") > 0, _after(key, "email", m, "", r"[.@][A-Za-z0-9\-]+\.[A-Za-z0-9\-]+"))
        .when(is_a(DATE), _date(key, m))
        .when(is_a(SSN), _ssn(key, m))
        .when(is_a(IPV4), _ipv4(key, m))
        .when(is_a(IPV6), _ipv6(key, m))
        .when(m.rlike(r"^\+\d+$"), _after(key, "phone", m, COUNTRY, ""))
        .when(is_a(PHONE), _after(key, "phone", m, r"(?:\+\d{1,3}[ .\-]?)?", ""))
        .when(is_a(HEX), _hex(key, m))
        .when(is_a(IBAN), _iban(key, m))
        .otherwise(_card(key, m))
    )


def pseudonymized(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """`docs` with the values in `text` replaced, and a column `count` (long) of how many changed.

    A null text stays null and counts 0; texts without values are unchanged;
    repeated rows repeat. The work is row by row: nothing is shuffled. `key` is
    secret; whoever has it can undo the permutation. Slashed dates are read month
    first, else day first. Where a column is called as `count` is, the new one has
    underscores in front.
    """
    (count,) = unused(docs.columns, count) if count else (None,)
    t = F.col(text)
    rebuilt = let(
        F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)),
        lambda found: let(
            F.transform(found, lambda m: pseudonym(key, m)),
            lambda new: F.struct(
                F.array_join(F.zip_with(F.split(t, ANY, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "").alias("text"),
                F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).cast("long").alias("n"),
            ),
        ),
    )
    plain = F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))
    kept = [F.col(c) for c in docs.columns if c != text]
    made = docs.select(*kept, F.when(t.rlike("[0-9@]"), rebuilt).otherwise(plain).alias(text))
    counted = [F.col(f"`{text}`.n").alias(count)] if count else []
    return made.select(*(F.col(f"`{text}`.text").alias(c) if c == text else F.col(c) for c in docs.columns), *counted)
