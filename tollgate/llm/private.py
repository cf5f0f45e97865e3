"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers (cards by Luhn, IBANs by mod 97, US social security numbers, IPv4 and IPv6 addresses, phone numbers),
dates, e-mail addresses, long hexadecimal secrets, access tokens with known prefixes and JSON web tokens are permuted
within their format by a keyed Feistel network over mixed radices, with SHA-512 as the round function. Equal values,
however they are spaced, get equal pseudonyms in all documents, and different values different ones. The permutation is P,
a step of one in each place, and P backwards: so no value stays what it was. Check digits are computed anew. Country codes
of phone numbers, domains of e-mail addresses and prefixes of tokens stay. Dates of the years 1900 to 2099 stay within
them, others outside. A social security number is permuted again until the result is a possible one (64 times at most, by
when the chance of none is below 1e-60). Who has the key can undo all pseudonyms, so it has no default.

What stays in clear: values that fail validation; digits without separators, but for cards and what follows a word for
phone or social security numbers, as nothing tells them from other numbers; groups of three digits with spaces and no
country code, which are also how large numbers are written; IPv6 addresses whose first group is shorter than three digits,
or without a decimal digit, as names in programs look like them; hexadecimal texts without a decimal digit. An IPv6 address is permuted as it is written.

Cases: null stays null, empty stays empty; texts without private values stay byte for byte; rows are independent, so
repeated rows change alike; an empty table gives an empty one; the text column is found whatever its case; other columns
are kept, except n_private, which is replaced. Very long texts are one pass of one regular expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import free_name, named, quoted

ROUNDS = 8
#: The days of 1900 to 2099, and those of the years 1 to 1899 and 2100 to 9999, each as a product of two radices.
DAYS, OTHER_DAYS = (17, 4297), (1258, 2845)
FIRST, YEAR_1900, DAYS_BEFORE = "0001-01-01", "1900-01-01", 693595
#: Put around what is found; texts that hold it themselves are split by the expression a second time.
MARK = "\x01\x02"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Scripts that are written without spaces: words before an address are told from it where it goes on in other letters.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}"
LOCAL = rf"[\p{{L}}\p{{N}}._%+\-&&[^{UNSPACED}]]"
DOMAIN = r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]+)*\.(?:xn--[0-9A-Za-z-]+|\p{L}{2,})"
EMAIL = rf"(?:(?<!{LOCAL}){LOCAL}++|(?<![{UNSPACED}])[{UNSPACED}]++)@{DOMAIN}"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
TOKENS = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "xoxb-", "xoxp-"]
TOKEN = rf"(?<![0-9A-Za-z_-])(?:{'|'.join(TOKENS)})[0-9A-Za-z]{{16,}}+(?![0-9A-Za-z])"
LONG_TOKENS = ["sk-proj-", "github_pat_", "sk_live_", "sk_test_", "npm_"]
LONG_TOKEN = rf"(?<![0-9A-Za-z_-])(?:(?:{'|'.join(LONG_TOKENS)})[0-9A-Za-z_-]{{16,}}+|eyJ[0-9A-Za-z_-]{{8,}}+\.eyJ[0-9A-Za-z_-]{{8,}}+\.[0-9A-Za-z_-]{{16,}}+)"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
PHONE = r"(?<![0-9])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){3,4}|\+[1-9][0-9]{1,2}[ .-]?[1-9](?:[ .-]?[0-9]{2}){4})(?![0-9])"
#: Digits without separators after a word that tells what they are.
TOLD_PHONE = r"(?<![0-9])(?<=(?i:(?:phone|tel|telephone|mobile|cell|fax)(?: number| no)?)[^0-9A-Za-z]{1,4})[0-9]{10}(?![0-9])"
TOLD_SSN = r"(?<![0-9])(?<=(?i:ssn|social security number)[^0-9A-Za-z]{1,4})[0-9]{9}(?![0-9])"
#: Country codes of one and two digits (ITU-T E.164); the others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
MONTHS = "January February March April May June July August September October November December".split()
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
MONTH_FIRST = rf"(?<![0-9A-Za-z])(?:{'|'.join(MONTHS)}) [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])"
DAY_FIRST = rf"(?<![0-9./-])[0-9]{{1,2}} (?:{'|'.join(MONTHS)}) [0-9]{{4}}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{{3,4}}:(?:(?:{GROUP}:){{6}}{GROUP}|(?:{GROUP}:){{0,5}}(?::{GROUP}){{1,6}})(?![0-9A-Za-z:])"
#: All kinds; those that begin with a digit, a sign or a bracket are only tried there.
PLAIN = "|".join([SECRET, LONG_TOKEN, TOKEN, IBAN, IPV6, MONTH_FIRST, f"(?=[0-9+(])(?:{'|'.join([PHONE, SSN, DAY_FIRST, DATE, CARD, IP, TOLD_PHONE, TOLD_SSN])})"])
ANY = f"{EMAIL}|{PLAIN}"
#: Texts without any of these hold nothing of PLAIN.
SIGNS = f"[0-9]|{'|'.join([*TOKENS, *LONG_TOKENS, 'eyJ'])}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def permuted(values: Column, radices: Column, key: Column) -> Column:
    """The permutation of an array of ints, each below its radix (an array of ints, 1 for what stays)."""

    def turned(side: Column, other: Column, own: Column, k: Column, n: Column) -> Column:
        state = F.sha2(F.concat(key, F.lit("|"), n.cast("string"), F.lit("|"), F.array_join(other.cast("array<string>"), ",")).cast("binary"), 512)
        return let(state, lambda h: F.transform(side, lambda x, j: F.pmod(x + F.when(k < ROUNDS, 1).otherwise(-1) * F.conv(h.substr(F.pmod(j, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), own.getItem(j))))

    def step(state: Column, k: Column, left: Column, right: Column) -> Column:
        n = F.when(k < ROUNDS, k).otherwise(2 * ROUNDS - k)
        one = lambda side, own: F.transform(side, lambda x, j: F.pmod(x + 1, own.getItem(j)))
        a = F.when(k == ROUNDS, one(state.getField("a"), left)).when(n % 2 == 0, turned(state.getField("a"), state.getField("b"), left, k, n)).otherwise(state.getField("a"))
        b = F.when(k == ROUNDS, one(state.getField("b"), right)).when(n % 2 == 1, turned(state.getField("b"), state.getField("a"), right, k, n)).otherwise(state.getField("b"))
        return F.struct(a.alias("a"), b.alias("b"))

    size = F.size(values)
    half = F.floor(size / 2).cast("int")
    part = lambda x: (F.slice(x, F.lit(1), half), F.slice(x, half + 1, size - half))
    (a, b), (left, right) = part(values), part(radices)
    # The rounds, the step of one, and the rounds backwards. Each round changes one half by the other.
    state = F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), F.struct(a.alias("a"), b.alias("b")), lambda s, k: step(s, k, left, right))
    return let(state, lambda s: F.concat(s.getField("a"), s.getField("b")))


def letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: text.substr(i, F.lit(1)))


def swapped(text: Column, key: Column) -> Column:
    """A text of ASCII letters and digits, each place permuted within digits, small or capital letters; empty stays."""
    base = lambda c: F.when(c < "A", 48).when(c < "a", 65).otherwise(97)

    def body(chars: Column) -> Column:
        values = F.transform(chars, lambda c: F.ascii(c) - base(c))
        radices = F.transform(chars, lambda c: F.when(c < "A", 10).otherwise(26))
        return F.array_join(F.zip_with(chars, permuted(values, radices, key), lambda c, v: F.chr(base(c) + v)), "")

    return F.when(F.length(text) == 0, text).otherwise(let(letters(text), body))


def swapped_letters(text: Column, key: Column) -> Column:
    """Each letter that is not ASCII permuted within the letters of its kind, all else in its place."""
    kinds = F.array(*[F.struct(F.lit(ord(a)).alias("first"), F.lit(ord(b)).alias("last")) for a, b in LETTERS])

    def placed(c: Column) -> Column:
        """The first letter of the kind of c, and how many there are; itself alone if there is none."""
        own = F.get(F.filter(kinds, lambda x: F.ascii(c).between(x.getField("first"), x.getField("last"))), F.lit(0))
        return let(F.coalesce(own, F.struct(F.ascii(c).alias("first"), F.ascii(c).alias("last"))), lambda x: F.struct(c.alias("c"), x.getField("first").alias("first"), (x.getField("last") - x.getField("first") + 1).alias("n")))

    def body(places: Column) -> Column:
        new = permuted(F.transform(places, lambda p: F.ascii(p.getField("c")) - p.getField("first")), F.transform(places, lambda p: p.getField("n")), key)
        letter = lambda p, v: F.decode(F.unhex(F.lpad(F.hex(p.getField("first") + v), 4, "0")), "UTF-16BE")
        return F.array_join(F.zip_with(places, new, lambda p, v: F.when(p.getField("n") == 1, p.getField("c")).otherwise(letter(p, v))), "")

    return F.when(F.length(text) == 0, text).otherwise(let(F.transform(letters(text), placed), body))


def swapped_hex(text: Column, key: Column) -> Column:
    """Hexadecimal digits permuted, with what stands between them kept; a new letter is a capital unless small ones were there."""
    digits = F.transform(letters(F.lower(bare(text))), lambda c: F.conv(c, 16, 10).cast("int"))
    new = let(digits, lambda d: F.array_join(F.transform(permuted(d, F.transform(d, lambda _: F.lit(16)), key), lambda v: F.lower(F.hex(v))), ""))
    cased = let(new, lambda x: F.when(text == F.lower(text), x).otherwise(F.upper(x)))
    return let(cased, lambda x: F.when(text.contains(":"), refilled(text, x)).otherwise(x))


#: First and last letters of the kinds that swapped_letters keeps to.
LETTERS = ["ßö", "øÿ", "ÀÖ", "ØÞ", "Āſ", "αω", "ΑΡ", "ΣΩ", "ря", "ап", "АЯ", "ѐџ", "ЀЏ", "את", "في", "ءغ", "अह", "กฮ", "ぁゖ", "ァヺ", "一\u9fff", "가힣"]


def bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def refilled(pattern: Column, new: Column) -> Column:
    """pattern with its ASCII letters and digits replaced by those of new, in order."""
    filled = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda i: let(pattern.substr(i, F.lit(1)), lambda c: F.when(c.rlike("[0-9A-Za-z]"), x.substr(F.length(bare(pattern.substr(F.lit(1), i))), F.lit(1))).otherwise(c))), "")
    return let(new, filled)


def luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of a number whose last digit counts once."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    places = F.transform(letters(F.reverse(digits)), lambda c, j: let(c.cast("int"), lambda d: F.when(j % 2 == 1, doubled(d)).otherwise(d)))
    return F.pmod(F.aggregate(places, F.lit(0), lambda a, x: a + x), F.lit(10))


def mod97(text: Column) -> Column:
    """A text of digits and capitals as a number, letters as 10 to 35, modulo 97."""
    return F.aggregate(letters(text), F.lit(0), lambda a, c: F.pmod(F.when(c < "A", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a text that ANY has found."""
    k = lambda kind: F.lit(f"{key}|{kind}")
    whole = lambda pattern: value.rlike(rf"^(?:{pattern})\z")

    local = F.substring_index(value, "@", 1)
    name = F.when(local.rlike(r"[^\x00-\x7F]"), swapped_letters(local, k("letters"))).otherwise(local)
    email = F.concat(let(name, lambda n: refilled(n, swapped(bare(n), k("mail")))), value.substr(F.length(local) + 1, F.length(value)))

    card = let(bare(value), lambda d: let(swapped(d.substr(F.lit(1), F.length(d) - 1), k("card")), lambda p: refilled(value, F.concat(p, F.pmod(10 - luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))))

    # What comes before the number itself: the country code, or what makes it longer than ten digits.
    before = lambda d: F.when(value.startswith("+"), F.length(F.regexp_extract(value, COUNTRY, 0)) - 1).otherwise(F.greatest(F.length(d) - 10, F.lit(0)))
    phone = let(bare(value), lambda d: let(before(d), lambda n: refilled(value, F.concat(d.substr(F.lit(1), n), swapped(d.substr(n + 1, F.length(d)), k("phone"))))))

    bad_ssn = r"^(?:000|666|9)|^...00|0000\z"
    walk = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(64)), swapped(d, k("ssn")), lambda a, _: F.when(a.rlike(bad_ssn), swapped(a, k("ssn"))).otherwise(a))
    ssn = let(bare(value), lambda d: F.when(d.rlike(bad_ssn), value).otherwise(refilled(value, walk(d))))

    iban = let(bare(value), lambda s: let(swapped(s.substr(F.lit(5), F.length(s)), k("iban")), lambda p: refilled(value, F.concat(s.substr(F.lit(1), F.lit(2)), F.lpad((98 - mod97(F.concat(p, s.substr(F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), p))))
    good_iban = let(bare(value), lambda s: mod97(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))) == 1)

    octets = F.split(value, r"\.").cast("array<int>")
    ip = F.array_join(permuted(octets, F.transform(octets, lambda _: F.lit(256)), k("ip")).cast("array<string>"), ".")

    def secret(heads: list[str]) -> Column:
        return let(F.regexp_extract(value, f"^(?:{'|'.join(heads)})", 0), lambda head: let(value.substr(F.length(head) + 1, F.length(value)), lambda rest: F.concat(head, refilled(rest, swapped(bare(rest), k("token"))))))

    def dated(pattern: str) -> Column:
        def moved(day: Column, radices: tuple[int, int], kind: str) -> Column:
            return let(permuted(F.array((day / radices[1]).cast("int"), F.pmod(day, F.lit(radices[1]))), F.array(*map(F.lit, radices)), k(kind)), lambda x: x.getItem(0) * radices[1] + x.getItem(1))

        def placed(day: Column) -> Column:
            span = DAYS[0] * DAYS[1]
            inside = moved(day - DAYS_BEFORE, DAYS, "date") + DAYS_BEFORE
            outside = let(moved(F.when(day < DAYS_BEFORE, day).otherwise(day - span), OTHER_DAYS, "other date"), lambda d: F.when(d < DAYS_BEFORE, d).otherwise(d + span))
            return F.when(day.between(DAYS_BEFORE, DAYS_BEFORE + span - 1), inside).otherwise(outside)

        day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(pattern))), F.to_date(F.lit(FIRST)))
        return let(day, lambda d: F.when(d >= 0, F.date_format(F.date_add(F.to_date(F.lit(FIRST)), placed(d).cast("int")), pattern)))

    def named_day(two: str, one: str) -> Column:
        return F.when(value.rlike("(?:^|[^0-9])0[0-9](?:[^0-9])"), dated(two)).otherwise(dated(one))

    date = F.coalesce(F.when(value.rlike("^[0-9]{4}-"), dated("yyyy-MM-dd")).when(value.rlike("^[0-9]{4}/"), dated("yyyy/MM/dd")).when(value.rlike("^[A-Z]"), named_day("MMMM dd, yyyy", "MMMM d, yyyy")).when(value.contains(" "), named_day("dd MMMM yyyy", "d MMMM yyyy")).when(value.contains("/"), F.coalesce(dated("MM/dd/yyyy"), dated("dd/MM/yyyy"))).otherwise(dated("dd.MM.yyyy")), value)

    kinds = [(value.contains("@"), email), (value.rlike(r"^[0-9A-Fa-f]{32,}\z"), swapped_hex(value, k("hex"))), (whole(LONG_TOKEN), secret([*LONG_TOKENS, "eyJ"])), (whole(TOKEN), secret(TOKENS)), (value.contains(":"), swapped_hex(value, k("ipv6"))), (whole(f"{DATE}|{DAY_FIRST}|{MONTH_FIRST}"), date), (value.rlike("^[A-Z]"), F.when(good_iban, iban).otherwise(value)), (whole(f"{SSN}|[0-9]{{9}}"), ssn), (whole(f"{PHONE}|[0-9]{{10}}"), phone), (whole(IP), ip)]
    return reduce(lambda c, x: c.when(*x), kinds[1:], F.when(*kinds[0])).otherwise(F.when(luhn(bare(value)) == 0, card).otherwise(value))


def parts(text: Column) -> Column:
    """A text cut before and after each private value: every other part is one."""

    def cut(pattern: str) -> Column:
        marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        # A text that holds the mark itself is passed twice: once for what is between, once for what is found.
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        twice = F.flatten(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.array(a, b)))
        return F.when(text.contains(MARK), F.slice(twice, F.lit(1), F.size(twice) - 1)).otherwise(marked)

    return F.when(text.contains("@"), cut(ANY)).when(text.rlike(SIGNS), cut(PLAIN)).otherwise(F.array(text))


def pseudonymised(documents: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_private") -> DataFrame:
    """documents with private values replaced in text_col, and the number of those that changed."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text_col = named(documents, text_col)
    old, new = free_name(documents, "old_in"), free_name(documents, "new_in")
    keep = [c for c in documents.columns if not count_col or c.lower() != count_col.lower()]
    out = documents.select(*[quoted(c) for c in keep], parts(F.col(quoted(text_col))).alias(old))
    out = out.withColumn(new, F.when(F.size(old) > 1, F.transform(old, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)).otherwise(x))))
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("long")
    some = F.size(old) > 1
    columns = [F.when(some, F.array_join(new, "")).otherwise(F.col(quoted(c))).alias(c) if c == text_col else F.col(quoted(c)) for c in keep]
    return out.select(*columns, *([F.when(some, changed).otherwise(0).cast("long").alias(count_col)] if count_col else []))
