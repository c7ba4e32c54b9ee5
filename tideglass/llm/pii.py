"""Surrogates for personal data and secrets, with DataFrame functions only.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card and other long numbers, social security
numbers, IBANs, access keys, values of password-like settings, and names: after a form of address or a phrase that
introduces one, before a suffix of address, and where a common given name is followed by a surname. Once a name is
found in a text, each of its parts is replaced wherever it stands in that text.

Entities are made of units: a mail address of mailbox and host, a name of its parts, anything else is one unit. A unit
has a canonical form (digits of a number, lower case of a name, mailbox or host), so mentions that are written
differently are one unit and get one surrogate, written the way each mention is. Surrogates are drawn from an
HMAC-SHA256 of type, canonical form and attempt under a secret key, and keep type, length, separators, case, script,
country codes, issuer digits, private networks and check digits (cards, IBANs, however they are spaced); hyphens and
apostrophes of names stay, and given names end as their gender does. A draw that
another unit also drew, or that is itself a unit of the corpus, is drawn again, until all units of a type have distinct
surrogates; names grow by a letter every two attempts, and what still collides after WIDEN attempts grows by a
character, so there is always room. As units are distinct, entities made of them are, and what two entities share
(a host, a surname) their surrogates share too.

Null text stays null; rows without entities are not shuffled. Repeated rows are rewritten alike, each row gives one
row. An empty table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.frequent import meet
from tideglass.llm.store import materialize, release

WIDEN = 40

# Forms of address by gender, phrases that introduce a name, suffixes of address, common given names by
# gender, and the patterns of entities.
MALE = "Mr Herr Señor Sr Don Sir Monsieur Lord Господин Κύριος Signor Senhor".split()
FEMALE = "Mrs Ms Miss Frau Señora Sra Doña Madame Mme Mademoiselle Mlle Lady Госпожа Κυρία Signora Senhora".split()
NEUTRAL = "Dr Prof Professor Doctor Doktor Docteur Доктор Hon Rev".split()
PHRASES = ("my name is", "My name is", "I am called", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "mon nom est", "Mon nom est", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "меня зовут", "Меня зовут")
SUFFIXES = "さん 様 先生 女士 氏 님 씨".split()
GIVEN_MALE = "John James Robert Michael William David Richard Thomas Charles Daniel Paul Mark George Peter Hans Karl Klaus Jürgen Wolfgang Stefan Andreas Heinrich Jean Pierre Michel Jacques Philippe François Juan José Carlos Luis Miguel Antonio Pedro Javier Иван Сергей Дмитрий Александр Николай Γιώργος Νίκος".split()
GIVEN_FEMALE = "Mary Jane Alice Anna Elizabeth Susan Linda Sarah Emma Laura Maria Julia Claudia Sabine Petra Monika Ursula Marie Sophie Camille Claire Isabelle Hélène Carmen Lucía Elena Ana Isabel Ольга Анна Мария Елена Наталья Ελένη Μαρία".split()
SETTING = r"(?:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?"
#: No number begins with a date, of whatever order.
DATED = r"(?!(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:[0-2]\d|3[01])(?!\d)|(?:[0-2]\d|3[01])-(?:0[1-9]|1[0-2])-(?:19|20)\d\d(?!\d))"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("secret", SETTING + r"[A-Za-z0-9+/_\-]{8,}"),
    ("access_key", r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("iban", r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![0-9A-Za-z])"),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?!\d)"),
    ("ip", r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)"),
    ("ip6", r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    ("phone", r"\+(?=(?:[ .\-()]{0,2}\d){7})\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\d)|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d)"),
    ("number", DATED + r"(?<!\d-)\d(?:[ \-]?\d){8,18}(?!\d)"),
)
#: Country codes of one and two digits; others have three.
COUNTRIES = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Scripts without case, by class of characters: first letter and how many follow each other.
RANGES = (
    ("IsHan", 0x4E00, 20000),
    ("IsHiragana", 0x3042, 80),
    ("IsKatakana", 0x30A2, 80),
    ("IsHangul", 0xAC00, 11172),
    ("IsArabic", 0x0627, 20),
    ("IsHebrew", 0x05D0, 27),
    ("IsDevanagari", 0x0915, 37),
    ("IsThai", 0x0E01, 46),
)
#: Scripts that are written in Latin syllables and then letter by letter.
LETTERS = "abdefgiklmnoprstuvz"
LETTERED = (("IsCyrillic", "абдефгиклмнопрстувз"), ("IsGreek", "αβδεφγικλμνοπρστυχζ"))

_CASELESS = "[" + "".join(rf"\p{{{name}}}" for name, _, _ in RANGES) + "]"
_CASED = r"\p{Lu}\p{L}*(?:['’]\p{Lu}\p{L}+)?(?:-\p{Lu}\p{L}+)*"
_WORD = rf"(?:{_CASED}|{_CASELESS}{{2,}})"
ADDRESS = rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?\s"
_START = r"(?<![\p{L}\p{N}])"
#: Names start with a capital or a letter without case; what that is not is passed over at once.
NAME = (
    rf"(?=[\p{{Lu}}\p{{Lo}}]){_START}(?:(?:{ADDRESS}){{1,2}}(?:\p{{Lu}}\.\s){{0,3}}{_WORD}(?:\s{_WORD})?"
    rf"|(?<=(?:{'|'.join(PHRASES)})\s){_WORD}(?:\s{_WORD})?"
    rf"|(?:{'|'.join(GIVEN_MALE + GIVEN_FEMALE)})\s{_CASED}"
    rf"|{_CASELESS}{{2,5}}?(?=\s?(?:{'|'.join(SUFFIXES)})))"
)
#: Every other entity holds a digit, an @ or two colons, or sets something.
HINT = r"[0-9@]|::|[=:]\s{0,2}[\"']?[A-Za-z0-9+/_\-]{8}"
# An entity starts where no word does already; the first pattern that fits there wins.
ENTITY = r"(?<![\p{L}\p{N}._%+@])(?:" + "|".join(p for _, p in PATTERNS) + ")"
DIGIT_TYPES = ("ssn", "phone", "number")
#: Types that are written with separators: what stands between their digits (an IBAN's digits and letters) is kept.
SPREAD_TYPES = (*DIGIT_TYPES, "iban")
NAME_TYPES = ("given_m", "given_f", "given", "surname")
LOWER_TYPES = ("mailbox", "host", "ip6", *NAME_TYPES)


def _any(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def parts_of(names: Column) -> Column:
    """The parts of names with their types, as an array: the last word is a surname if there are several words or a
    form of address, others are given names, with the gender of the form of address or of the name."""

    def one(name: Column) -> Column:
        bare = F.regexp_replace(name, rf"^(?:{ADDRESS}|\p{{Lu}}\.\s)+", "")
        words = F.split(bare, r"\s")
        addressed = bare != name
        male = name.rlike(rf"^(?:{'|'.join(MALE)})\.?\s") | F.array_contains(_any(GIVEN_MALE), words[0])
        female = name.rlike(rf"(?:^|\s)(?:{'|'.join(FEMALE)})\.?\s") | F.array_contains(_any(GIVEN_FEMALE), words[0])
        given = F.when(female, "given_f").when(male, "given_m").otherwise("given")
        last = F.size(words) - 1
        return F.transform(words, lambda w, i: F.struct(w.alias("part"), F.when((i == last) & ((last > 0) | addressed), "surname").otherwise(given).alias("kind")))

    return F.filter(F.flatten(F.transform(names, one)), lambda p: F.length(p["part"]) > 1)


def pattern_of(parts: Column) -> Column:
    """The pattern of a text's entities: that of all texts, and its own names, the longest first."""
    by_length = F.reverse(F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.struct(F.length(p["part"]).alias("n"), p["part"].alias("part"))))))
    own = F.array_join(F.transform(by_length, lambda p: p["part"]), "|")
    return F.when(F.size(parts) == 0, F.lit(ENTITY)).otherwise(F.concat(F.lit(ENTITY + r"|(?<![\p{Lu}\p{Ll}\p{N}])(?:"), own, F.lit(r")(?![\p{Lu}\p{Ll}\p{N}])")))


def kind_of(mention: Column, parts: Column) -> Column:
    """Type of a mention, which starts with its setting's name, if any."""
    whole = lambda name: mention.rlike(f"^(?:{dict(PATTERNS)[name]})$")
    out = F.when(whole("email"), "email")
    for name, _ in PATTERNS[1:]:
        out = out.when(whole(name), name)
    return out.otherwise(F.get(F.filter(parts, lambda p: p["part"] == mention), F.lit(0))["kind"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def units_of(kind: Column, mention: Column) -> Column:
    """The units of a mention without its lead: type, and how it is written."""
    unit = lambda k, text: F.struct(k.alias("kind"), text.alias("text"))
    mail = F.array(unit(F.lit("mailbox"), F.substring_index(mention, "@", 1)), unit(F.lit("host"), F.substring_index(mention, "@", -1)))
    return F.when(kind == "email", mail).otherwise(F.array(unit(kind, mention)))


def canonical(kind: Column, text: Column) -> Column:
    plus = F.when((kind == "phone") & F.startswith(text, F.lit("+")), "+").otherwise("")
    return F.when(kind.isin(*DIGIT_TYPES), F.concat(plus, digits_of(text))).when(kind == "iban", F.regexp_replace(text, " ", "")).when(kind.isin(*LOWER_TYPES), F.lower(text)).otherwise(text)


def keyed(key: bytes, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as 64 hexadecimal digits."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    message = F.concat_ws("\x1f", *parts).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def stream(key: bytes, *parts: Column) -> Column:
    """128 numbers from 0 to 255 for the parts, as hexadecimal digits."""
    return F.concat(*[keyed(key, *parts, F.lit(str(i))) for i in range(4)])


def _at(numbers: Column, i: Column) -> Column:
    return F.conv(F.substr(numbers, 2 * (i % 128) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def charwise(value: Column, numbers: Column, keep: Column, hexadecimal: Column) -> Column:
    """Each character after the first `keep` by another of its class."""

    def swap(c: Column, i: Column) -> Column:
        n = _at(numbers, i)
        return (
            F.when(i < keep, c)
            .when(hexadecimal & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", n))
            .when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit undoubled."""

    def mark(c: Column, i: Column) -> Column:
        n = c.try_cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    marks = F.transform(F.split(F.reverse(digits), ""), mark)
    return F.aggregate(marks, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def iban_rest(iban: Column) -> Column:
    """The number that an IBAN stands for, modulo 97; 1 if its check digits are right."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    letter = lambda c: F.ascii(c) - 55
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).when(c.rlike("[A-Z]"), (acc * 100 + letter(c)) % 97).otherwise(acc)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def name_surrogate(kind: Column, value: Column, numbers: Column, attempt: int) -> Column:
    """A name in the script of the value, as long as the value and one letter longer every two attempts: its letters
    are drawn anew (consonants and vowels by turns, or letters of its range); hyphens, apostrophes and length stay."""
    more = attempt // 2
    consonants, vowels = "bdfgklmnprstvz", "aeiou"
    ending = F.when(kind == "given_f", "a").when(kind == "given_m", "n").when(kind == "given", "e").otherwise("o")
    letters = F.split(F.concat(value, F.lit("x" * more)), "")
    last = F.size(letters) - 1
    drawn = lambda i: F.when(i % 2 == 0, _pick(consonants, _at(numbers, i))).otherwise(_pick(vowels, _at(numbers, i)))
    latin = F.array_join(F.transform(letters, lambda c, i: F.when(c.rlike("[0-9]"), _pick("0123456789", _at(numbers, i))).when(~c.rlike(r"\p{L}"), c).when((i == last) & (last > 2), ending).otherwise(drawn(i))), "")
    out = latin
    for name, own in reversed(LETTERED):
        out = F.when(value.rlike(rf"\p{{{name}}}"), F.translate(latin, LETTERS, own)).otherwise(out)
    places = F.sequence(F.lit(0), F.length(value) - 1 + more)
    for name, first, count in reversed(RANGES):
        point = lambda i: F.lit(first) + (_at(numbers, 2 * i) * 256 + _at(numbers, 2 * i + 1)) % count  # noqa: B023, E731
        other = F.array_join(F.transform(places, lambda i: F.decode(F.unhex(F.lpad(F.hex(point(i)), 4, "0")), "UTF-16BE")), "")  # noqa: B023
        out = F.when(value.rlike(rf"\p{{{name}}}"), other).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, numbers: Column, attempt: int) -> Column:
    """Surrogate of a canonical form; numbers is a column that holds a stream."""
    wide = F.concat(value, F.lit("0" * (attempt // WIDEN)))
    hexadecimal = (kind == "ip6") | kind.isin("secret", "mailbox") & value.rlike("^(?=.*[a-f])[0-9a-f]{8,}$")
    # A number with a plus keeps its country, another one its first digit.
    country_code = F.when(~F.startswith(value, F.lit("+")), 1).when(value.rlike(r"^\+[17]"), 2).when(value.rlike(COUNTRIES), 3).otherwise(4)
    plain = charwise(wide, numbers, F.when(kind == "phone", country_code).when(kind == "number", 1).when(kind.isin("access_key", "iban"), 4).otherwise(0), hexadecimal)
    # Cards: the last digit makes the sum a multiple of ten where the original's was.
    body = F.substr(plain, F.lit(1), F.length(plain) - 1)
    checked = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    number = F.when((F.length(value) >= 13) & (luhn_sum(F.when(kind == "number", value)) % 10 == 0), checked).otherwise(plain)
    # IBANs: the check digits are right where the original's were, else others.
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    right = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    drawn = F.concat(_pick("0123456789", _at(numbers, F.lit(126))), _pick("0123456789", _at(numbers, F.lit(127))))
    iban = F.concat(country, F.when(iban_rest(F.when(kind == "iban", value)) == 1, right).otherwise(drawn), account)
    # Private and local addresses stay in their network, and no other address becomes one.
    kept = F.when(value.rlike(r"^(?:10|127)\."), 1).when(value.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01])|169\.254)\."), 2).otherwise(0)
    old = F.split(value, r"\.")
    first = F.lit(11) + _at(numbers, F.lit(0)) % 110
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < kept, F.get(old, i)).when(i == 0, first.cast("string")).otherwise((_at(numbers, i) % 254 + 1).cast("string"))), ".")
    # When the addresses of one length no longer suffice, those of the longer kind for documentation do.
    ip = F.concat(F.lit("2001:db8::" if attempt >= WIDEN else ""), octets)
    # Hosts: the last label stays.
    top = F.substring_index(value, ".", -1)
    inner = F.substr(wide, F.lit(1), F.length(wide) - F.length(top) - 1 - attempt // WIDEN)
    host = F.concat(charwise(F.concat(inner, F.lit("a" * (attempt // WIDEN))), numbers, F.lit(0), F.lit(False)), F.lit("."), top)
    return F.when(kind == "ip", ip).when(kind == "host", host).when(kind == "number", number).when(kind == "iban", iban).when(kind.isin(*NAME_TYPES), name_surrogate(kind, value, numbers, attempt)).otherwise(plain)


def written(kind: Column, text: Column, new: Column) -> Column:
    """The surrogate of a canonical form, written like the unit's text."""
    bare = F.when(kind == "iban", new).otherwise(digits_of(new))
    own = F.when(kind == "iban", r"[^0-9A-Z]").otherwise(r"[^0-9]")
    order = lambda i: F.length(F.regexp_replace(F.substr(text, F.lit(1), i + 1), own, F.lit("")))
    stands = lambda c: F.length(F.regexp_replace(c, own, F.lit(""))) > 0
    spread = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(stands(c), F.substr(bare, order(i), F.lit(1))).otherwise(c)), "")
    # Digits beyond the text's own are there if the surrogate had to grow.
    spread = F.concat(spread, F.substr(bare, F.length(F.regexp_replace(text, own, F.lit(""))) + 1))
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    # Names are capital where the text is.
    named = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(upper(F.substr(text, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), "")
    cased = F.when(upper(text), F.upper(new)).when(kind.isin(*NAME_TYPES), named).otherwise(new)
    return F.when(kind.isin(*SPREAD_TYPES), spread).when(kind.isin(*LOWER_TYPES), cased).otherwise(new)


def mapping(units: DataFrame, key: bytes) -> DataFrame:
    """One surrogate for each distinct (kind, value): kind, value, surrogate; no two alike within a kind (all parts of
    names are one kind here), none a unit of that kind. Which of two units that draw alike keeps the draw (the lesser value) depends on the units, so a surrogate
    is the same in two corpora unless it collided in one of them."""
    left = units.select("kind", "value")
    everything = left
    taken: DataFrame | None = None
    attempt = 0
    while attempt == 0 or left.limit(1).count():
        # Streams are written before they are used, or every character would compute its own.
        seeded = materialize(left.withColumn("numbers", stream(key, F.col("kind"), F.col("value"), F.lit(str(attempt)))), "streams")
        drawn = materialize(seeded.select("kind", "value", surrogate(F.col("kind"), F.col("value"), F.col("numbers"), attempt).alias("surrogate")), "surrogates")
        space = F.when(F.col("kind").isin(*NAME_TYPES), "name").otherwise(F.col("kind")).alias("space")
        clash = everything.select(space, F.col("value").alias("surrogate"))
        if taken is not None:
            clash = clash.unionByName(taken.select(space, "surrogate"))
        first = drawn.groupBy(space, "surrogate").agg(F.min(F.struct("value", "kind")).alias("one")).join(clash, ["space", "surrogate"], "left_anti")
        won = materialize(first.select("one.kind", "one.value", "surrogate"), "surrogates-won")
        old, left = left, materialize(left.join(won, ["kind", "value"], "left_anti"), "surrogates-left")
        taken = won if taken is None else taken.unionByName(won)
        release(seeded, drawn, old if attempt else None)
        attempt += 1
    return taken


def replace(docs: DataFrame, key: bytes | str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: ident, text (rewritten), n_replaced, replaced (kind and surrogate, in order).

    key is the secret that surrogates are drawn with; whoever has it can test guesses of originals.
    """
    secret = key.encode() if isinstance(key, str) else key
    if len(secret) < 16:
        raise ValueError("the key must have 16 bytes at least")
    rows = docs.select(docs[ident].alias("ident"), docs[text].cast("string").alias("text"))
    replaced = "array<struct<kind:string,surrogate:string>>"
    hit = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY) | F.col("text").rlike(NAME), F.lit(False))
    clean = rows.where(~hit).select("ident", "text", F.lit(0).cast("bigint").alias("n_replaced"), F.array().cast(replaced).alias("replaced"))
    # Texts with entities, cut at them: gaps[0] mention[0] gaps[1] ... written once, so a row number can name each row.
    named = materialize(rows.where(hit).select("ident", "text", parts_of(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("parts")), "names")
    pattern = pattern_of(F.col("parts"))
    cut = materialize(
        named.select("ident", "parts", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("mentions"), F.split("text", pattern, -1).alias("gaps")),
        "mentions",
    )
    release(named)
    each = cut.select("row", "parts", F.posexplode("mentions").alias("pos", "whole")).withColumn("kind", kind_of(F.col("whole"), F.col("parts")))
    each = each.withColumn("lead", F.when(F.col("kind") == "secret", F.regexp_extract("whole", SETTING, 0)).otherwise(""))
    each = each.select("row", "pos", "lead", F.posexplode(units_of(F.col("kind"), F.substr("whole", F.length("lead") + 1))).alias("at", "unit"))
    each = each.select("row", "pos", "lead", "at", "unit.kind", "unit.text", canonical(F.col("unit.kind"), F.col("unit.text")).alias("value"))
    each = materialize(each, "units")
    counted = materialize(each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")), "units-distinct")
    # Mentions of frequent units meet their surrogates where they are; the others are shuffled.
    met = meet(each, materialize(mapping(counted, secret).join(counted, ["kind", "value"]), "units-known"), ["kind", "value"])
    new = met.select("row", "pos", "lead", F.struct("at", "kind", written(F.col("kind"), F.col("text"), F.col("surrogate")).alias("surrogate")).alias("unit"))
    # One exchange by text; units become mentions and mentions texts within it.
    mention = new.repartition("row").groupBy("row", "pos").agg(F.first("lead").alias("lead"), F.array_sort(F.collect_list("unit")).alias("units"))
    first = F.col("units")[0]["kind"]
    kind = F.when(first == "mailbox", "email").when(first.isin(*NAME_TYPES), "name").otherwise(first)
    mention = mention.select("row", F.struct("pos", "lead", kind.alias("kind"), F.array_join(F.transform("units", lambda u: u["surrogate"]), "@").alias("surrogate")).alias("x"))
    by_row = mention.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("found"))
    found = by_row.join(cut, "row").select("ident", "gaps", "found")
    rebuilt = F.concat(F.array_join(F.zip_with("found", F.slice("gaps", F.lit(1), F.size("found")), lambda x, g: F.concat(g, x["lead"], x["surrogate"])), ""), F.element_at("gaps", -1))
    dirty = found.select(
        "ident",
        rebuilt.alias("text"),
        F.size("found").cast("bigint").alias("n_replaced"),
        F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate"))).cast(replaced).alias("replaced"),
    )
    return clean.unionByName(dirty).withColumnRenamed("ident", ident)
