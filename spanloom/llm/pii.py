"""Personal data and secrets replaced by keyed, type-consistent surrogates, with DataFrame functions only.

Numbers (phones, cards, social security numbers, IPv4 addresses) go through a keyed Feistel permutation of their digits, so
distinct numbers of a type and length stay distinct by construction, and the same digits get the same surrogate however
they are written. Text (e-mail, keys, secrets, IBANs with valid check digits, names after a title) is rebuilt character
class by character class from a keyed hash; names keep gender, script and capitals, and get as many syllables as the
number of names in the corpus asks for. Corpus-wide, distinct originals that would share a surrogate are looked for before
anything is replaced, and the hash is salted anew until there are none. A surrogate depends on the key and on what an
entity's mentions have in common, so mentions corefer within and across documents. Who has the key can undo the numbers,
so the caller supplies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, without

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Г-жа|Κυρία)"
_MALE = r"(?:Mr|Herr|Herrn|Monsieur|Señor|Sr|Signor|Г-н|Κύριος)"
#: All eight groups, or some around a double colon after one that begins with a digit or has one in it.
_IPV6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f]{0,3}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})"
#: The country codes of one and of two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Each kind's pattern, in order of preference at one place. All repetition is bounded or possessive.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]{1,64}+@(?:[\p{L}0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\p{L}0-9\-])",
    "secret": r"(?<!\p{L})(?i:access_token|token|secret|password|passwd|api[_\-]?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_\-]{12,}+",
    "key": r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9\-]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ipv6": rf"(?<![0-9A-Za-z:.]){_IPV6}(?![0-9A-Za-z:])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-+])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "card": r"(?<![\d.])\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "name": rf"(?<!\p{{L}})(?:{_FEMALE}|{_MALE})\.? \p{{Lu}}\p{{L}}{{1,40}}(?: \p{{Lu}}\p{{L}}{{1,40}})?",
}
ANY = rf"(?<![\p{{L}}0-9])(?:{'|'.join(PATTERNS.values())})"
#: Every match of ANY has one of these; most texts of prose have none and are done after this.
HINT = r"[0-9@=:]|A[KS]IA|gh[pousr]_|sk-|xox[abprs]-|[FHMSГΚ]\S{1,8} \p{Lu}"
_SYLLABLES = {
    "latin": [c + v + e for c in "b d f g k l m n p r s t v z br tr".split() for v in "a e i o".split() for e in ("", "n")],
    "cyrillic": [c + v + e for c in "б в г д к л м н п р с т ф з бр тр".split() for v in "а е и о".split() for e in ("", "н")],
    "greek": [c + v + e for c in "β γ δ ζ κ λ μ ν π ρ σ τ φ χ βρ τρ".split() for v in "α ε ι ο".split() for e in ("", "ν")],
}
_ENDINGS = {"latin": ("lia", "rik"), "cyrillic": ("лия", "рик"), "greek": ("λία", "ρος")}


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY."""
    out = F.when(m.contains("@"), "email")
    for kind in ("secret", "key", "ipv4", "ipv6", "ssn", "card", "phone", "iban", "name"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("phone")


def _digest(key: str, kind: str, value: Column, salt: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"{key}/{salt}"), F.lit(kind), value), 256)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated, and written into the plan, once."""
    return F.transform(F.array(value), body)[0]


def _feistel(x: Column, y: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs x < a, y < b, as a struct (x, y)."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, a, b, F.when(even, s["y"]).otherwise(s["x"])), 256)
        f = F.conv(F.substring(h, 1, 14), 16, 10).cast("long")
        return F.struct(F.when(even, (s["x"] + f) % a).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise((s["y"] + f) % b).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.struct(x.alias("x"), y.alias("y")), step)


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """As many digits (at most 18), permuted."""
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")

    def cut(p: Column) -> Column:
        out = _feistel(p["l"].cast("long"), p["r"].cast("long"), ten(F.length(p["l"])), ten(F.length(p["r"])), key, kind)
        return _let(F.struct(out.alias("s"), F.length(p["l"]).alias("n"), F.length(p["r"]).alias("k")), lambda q: F.concat(F.lpad(q["s"]["x"].cast("string"), q["n"], "0"), F.lpad(q["s"]["y"].cast("string"), q["k"], "0")))

    halves = lambda d: F.struct(d.substr(F.lit(1), F.floor(F.length(d) / 2).cast("int")).alias("l"), d.substr(F.floor(F.length(d) / 2).cast("int") + 1, F.length(d)).alias("r"))
    return _let(digits, lambda d: F.when(F.length(d) >= 2, _let(halves(d), cut)).otherwise(d))


def _refill(m: Column, digits: Column, slot=lambda c: c.between("0", "9")) -> Column:
    """m with its digits (or what slot picks) replaced, in order, by the characters of digits."""

    def fill(d: Column) -> Column:
        step = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.when(slot(c), d.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + slot(c).cast("int")).alias("at")))
        return step["out"]

    return _let(digits, fill)


def _luhn(d: Column, doubled_first: int) -> Column:
    """Luhn's sum of the digits from the last, every other one doubled."""
    terms = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when((i + doubled_first) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _classwise(value: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """value with each ASCII letter and digit, and each other letter, replaced by one of its class."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(c: Column, h: Column, hexa: Column) -> Column:
        n = F.when(hexa, 6).otherwise(26)
        pick = lambda alphabet, n: F.lit(alphabet).substr((F.pmod(h, n) + 1).cast("int"), F.lit(1))
        return F.when(c.between("0", "9"), pick("0123456789", F.lit(10))).when(c.between("A", "Z"), pick(up, n)).when(c.between("a", "z") | c.rlike(r"^\p{L}$"), pick(low, n)).otherwise(c)

    bound = F.struct(value.alias("v"), seed.alias("s"), (hexadecimal if hexadecimal is not None else F.lit(False)).alias("x"))
    return _let(bound, lambda b: F.array_join(F.transform(F.split(b["v"], ""), lambda c, i: _let(F.xxhash64(b["s"], i), lambda h: one(c, h, b["x"]))), ""))


def _mod97(t: Column) -> Column:
    """The remainder by 97 of the number that a string of digits and capitals (A is 10) stands for."""
    return F.aggregate(F.split(t, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).when(c.between("A", "Z"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))


def _name_part(token: Column, part: str, female: Column, key: str, salt: int, syllables: int) -> Column:
    """A made-up name in the token's script, in capitals if the token is; a given name ends by gender."""
    seed = _digest(key, part, F.lower(token), salt)

    def made(script: str, h: Column) -> Column:
        s, n = F.array(*[F.lit(x) for x in _SYLLABLES[script]]), len(_SYLLABLES[script])
        body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(syllables - 1)), lambda i: F.element_at(s, F.conv(h.substr(4 * i + 1, F.lit(4)), 16, 10).cast("int") % n + 1)), "")
        end = F.when(female, _ENDINGS[script][0]).otherwise(_ENDINGS[script][1]) if part == "given" else F.lit("")
        loud = (F.upper(token) == token) & (F.length(token) > 1)
        return _let(F.concat(body, end), lambda x: F.when(loud, F.upper(x)).otherwise(F.initcap(x)))

    return _let(seed, lambda h: F.when(token.rlike(r"\p{IsCyrillic}"), made("cyrillic", h)).when(token.rlike(r"\p{IsGreek}"), made("greek", h)).otherwise(made("latin", h)))


def surrogate(m: Column, kind: Column, key: str, salt: int = 0, syllables: int = 5) -> Column:
    """The replacement of one match; a run of digits that fails Luhn's check is no card and stays."""
    seed = lambda value, k: _digest(key, k, value, salt)

    def email(p: Column) -> Column:
        suffix = F.when(p["d"].rlike(r"\.(com|org|net)$"), F.substring_index(p["d"], ".", -1)).otherwise("com")
        local = _classwise(F.rpad(p["l"], F.greatest(F.length(p["l"]), F.lit(18)), "qwertyuiopasdfghjk"), seed(F.concat(p["l"], F.lit("@"), p["d"]), "email"))
        return F.concat(local, F.lit("@m"), F.substring(seed(p["d"], "domain"), 1, 12), F.lit(".example."), suffix)

    def after(pattern: str, body) -> Column:
        """What pattern finds first stays; body makes the rest."""
        return _let(F.regexp_extract(m, pattern, 1), lambda h: F.concat(h, _let(m.substr(F.length(h) + 1, F.length(m)), body)))

    def card(d: Column) -> Column:
        body = F.concat(d.substr(1, 1), _permuted(d.substr(F.lit(2), F.length(d) - 2), key, "card"))
        whole = _let(body, lambda x: F.concat(x, ((F.lit(10) - _luhn(x, 1) % 10) % 10).cast("string")))
        return F.when(_luhn(d, 0) % 10 == 0, _refill(m, whole)).otherwise(m)

    def ipv4(o: Column) -> Column:
        byte, size = (lambda i: o[i].cast("long")), F.lit(65536).cast("long")
        p = _feistel(byte(0) * 256 + byte(1), byte(2) * 256 + byte(3), size, size, key, "ipv4")
        return _let(p, lambda q: F.concat_ws(".", F.floor(q["x"] / 256), q["x"] % 256, F.floor(q["y"] / 256), q["y"] % 256))

    def phone(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.length(F.regexp_extract(d, _COUNTRY, 1))).otherwise(0) + 1  # the country's code and one digit stay
        return _let(F.least(code, F.length(d) - 2), lambda k: _refill(m, F.concat(d.substr(F.lit(1), k), _permuted(d.substr(k + 1, F.length(d)), key, "phone"))))

    def iban(c: Column) -> Column:
        country, own = c.substr(1, 2), _classwise(c.substr(F.lit(5), F.length(c)), seed(c, "iban"))
        checked = lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)
        return _refill(m, _let(own, checked), lambda c: c != " ")

    def ipv6(h: Column) -> Column:  # 96 bits below the prefix for documentation
        return F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), h.substr(4 * i + 1, 4)) for i in range(6)])

    def name(words: Column) -> Column:
        female = m.rlike(rf"^{_FEMALE}(?!\p{{L}})")
        given = F.when(F.size(words) > 1, F.concat(_name_part(words[0], "given", female, key, salt, syllables), F.lit(" "))).otherwise("")
        return F.concat(F.regexp_extract(m, rf"^((?:{_FEMALE}|{_MALE})\.? )", 1), given, _name_part(F.element_at(words, -1), "family", female, key, salt, syllables))

    digits = _digits(m)
    secret = after(r"^([^=:]*[=:] ?[\"']?)", lambda v: _classwise(F.rpad(v, F.greatest(F.length(v), F.lit(16)), "0123456789abcdef"), seed(v, "secret"), v.rlike("^[0-9a-fA-F]+$")))
    out = F.when(kind == "email", _let(F.struct(F.lower(F.substring_index(m, "@", 1)).alias("l"), F.lower(F.substring_index(m, "@", -1)).alias("d")), email))
    out = out.when(kind == "secret", secret).when(kind == "key", after(r"^(A[KS]IA|gh[pousr]_|sk-|xox[abprs]-)", lambda v: _classwise(v, seed(m, "key"))))
    out = out.when(kind == "iban", _let(F.regexp_replace(m, " ", ""), iban)).when(kind == "ipv6", _let(seed(F.lower(m), "ipv6"), ipv6))
    out = out.when(kind == "card", _let(digits, card)).when(kind == "ipv4", _let(F.split(m, r"\."), ipv4)).when(kind == "ssn", _refill(m, _permuted(digits, key, "ssn")))
    return out.when(kind == "name", _let(F.split(F.regexp_replace(m, rf"^(?:{_FEMALE}|{_MALE})\.? ", ""), " "), name)).otherwise(_let(digits, phone))


def canonical(m: Column, kind: Column) -> Column:
    """What two mentions of one entity have in common: no capitals in addresses and names, no title, no signs between digits."""
    out = F.when(kind.isin("email", "ipv6"), F.lower(m)).when(kind.isin("card", "ssn"), _digits(m)).when(kind == "phone", F.concat(F.regexp_extract(m, r"^(\+?)", 1), _digits(m)))
    out = out.when(kind == "name", F.lower(F.regexp_replace(m, rf"^(?:{_FEMALE}|{_MALE})\.? ", "")))
    return out.when(kind == "secret", F.regexp_replace(m, r"^[^=:]*[=:] ?[\"']?", "")).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)


#: Kinds whose surrogates come from a hash, not from a permutation.
HASHED = ("email", "secret", "key", "iban", "ipv6", "name")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = "pii", most_salts: int = 4) -> DataFrame:
    """docs with every entity in text_col replaced; found_col (None: left out): array of (kind, original, surrogate) in order.

    A null text stays null and an empty one empty; both have no entities. Texts of any length are searched whole, repeated rows
    each give their row, and an empty table gives none. A column of docs called found_col gives way to the result's; others of
    any name stay. Raises if most_salts salts all let two entities share a surrogate.
    """
    if found_col:
        docs = without(docs, found_col)
    columns = docs.columns
    text, matches_, entities_, new_ = F.col(f"`{text_col}`"), fresh(columns, "pii_matches"), fresh(columns, "pii_entities"), fresh(columns, "pii_text")
    matched = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = stored(docs.withColumn(matches_, matched), "pii")
    some = held.where(F.size(matches_) > 0).select(F.explode(matches_).alias("m")).distinct().withColumn("kind", kind_of(F.col("m")))
    some = stored(some.where(F.col("kind").isin(*HASHED)), "pii-entities")
    names = some.where("kind = 'name'").count()
    syllables = next(n for n in range(5, 17) if names**2 < 2e-3 * 128**n)  # two of the names meet with a chance under 1 in 1000
    for salt in range(most_salts):
        pairs = some.select("kind", canonical(F.col("m"), F.col("kind")).alias("c"), canonical(surrogate(F.col("m"), F.col("kind"), key, salt, syllables), F.col("kind")).alias("s")).distinct()
        clash = pairs.groupBy("kind", "s").count().where("count > 1")
        if clash.isEmpty():
            break
    else:
        raise ValueError(f"{most_salts} salts leave entities that share a surrogate")
    entities = F.transform(matches_, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("original")))
    entities = F.transform(entities, lambda e: F.struct(e["kind"].alias("kind"), e["original"].alias("original"), surrogate(e["original"], e["kind"], key, salt, syllables).alias("surrogate")))
    parts = F.split(text, ANY, -1)
    has = F.size(matches_) > 0
    empty = F.array().cast("array<struct<kind:string,original:string,surrogate:string>>")
    out = held.withColumn(entities_, F.when(has, entities).otherwise(empty))
    rebuilt = F.concat(F.array_join(F.transform(entities_, lambda e, i: F.concat(parts[i], e["surrogate"])), ""), F.element_at(parts, -1))
    out = out.withColumn(new_, F.when(has, rebuilt).otherwise(text))
    return out.select(*[F.col(new_).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], *([F.filter(entities_, lambda e: e["original"] != e["surrogate"]).alias(found_col)] if found_col else []))
