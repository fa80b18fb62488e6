"""Personal data replaced by keyed surrogates; DataFrame functions only.

One pattern finds mentions.  A mention is reduced to its entity, a kind and a normal form
(``+1 (743) 555-3824`` and ``743.555.3824`` are one entity).  Each distinct entity gets a
surrogate of its own kind and shape, drawn from a keyed SHA-512 stream: digits for digits,
letters of the same case for letters, numbers that pass the same checks, names of the same
gender and script.  Equal entities get equal surrogates wherever they stand, so coreference
stays.  Surrogates are checked for collisions, with each other and with real entities of the
corpus; those that collide are drawn again until all are distinct, and longer from the third
draw on where a short shape may be used up.  Mentions are written in the format they had.
A password without a letter or digit is none: it has nothing to replace.

A person is found behind a form of address, and then each of the names wherever it stands in
the same document.  Given names and surnames are entities of their own, so ``Mr Smith`` and
``John Smith`` stay one person's names.  Names that no form of address goes before anywhere
in their document are not found.  The parts of an address on either side of ``@`` are at most
64 and 8,000 characters long, as the mail standards have it or more; longer ones are no
addresses.  All patterns take time in proportion to a text's length.

Only rows with a mention are dealt anew; all others pass where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import persist, shuffle_partitions

KEY = "sievebank"

# Forms of address, by the gender that they tell of the person behind them.
MALE_TITLES = ("Mr", "MR", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Господин")
FEMALE_TITLES = ("Mrs", "MRS", "Ms", "MS", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа")
OTHER_TITLES = ("Dr", "DR", "Doctor", "Prof", "Professor")

#: Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "latin": ("bal", "cor", "dem", "fal", "gar", "hol", "jor", "kel", "lam", "mar", "nor", "pel", "quin", "ros", "sel", "tam", "vel", "wil", "yor", "zan"),
    "cyrillic": ("бал", "вер", "гор", "дем", "жар", "зар", "кол", "лав", "мар", "нор", "пел", "рос", "сел", "там", "фал", "хор", "цел", "чар", "шел", "яр"),
}
ENDINGS = {
    ("latin", "m"): ("den", "ric", "ton", "vin"),
    ("latin", "f"): ("dia", "line", "na", "ra"),
    ("cyrillic", "m"): ("ан", "ей", "ин", "ор"),
    ("cyrillic", "f"): ("ана", "ея", "ина", "ора"),
    ("latin", "n"): ("en", "is", "or", "um"),
    ("cyrillic", "n"): ("ис", "ен", "ор", "ум"),
    # surnames: those of Cyrillic script end in a vowel for women
    ("latin", "s"): ("berg", "field", "man", "well"),
    ("cyrillic", "s"): ("ов", "ев", "ский", "ин"),
    ("cyrillic", "w"): ("ова", "ева", "ская", "ина"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLE = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=lambda t: (-len(t), t)))
_NAME = r"(?:\p{Lu}\p{L}+|\p{Lu}(?=['’]))(?:['’\-]\p{Lu}\p{L}+){0,3}"
#: A form of address and one or two names; initials between them stay.
PERSON = rf"(?<!\p{{L}})({_TITLE})\.? (?:\p{{Lu}}\. ?){{0,2}}({_NAME})(?: (?:\p{{Lu}}\. ?){{0,2}}({_NAME}))?"
PARTS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,125}[A-Za-z]{2,63}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token)=(?=[^\s\"',;]*[\p{L}\p{N}])[^\s\"',;]+",
    "hex_secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
}
PATTERN = "|".join(PARTS.values())
#: What every mention holds; texts without it are not searched further.
HINT = rf"[0-9@]|=|(?:{_TITLE})"


def names_in(text: Column) -> Column:
    """The names behind forms of address: each word with its role and, for given names, gender."""

    def of(m: Column) -> Column:
        title, first, last = (F.regexp_extract(m, PERSON, k) for k in (1, 2, 3))
        gender = F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("n")

        def name(word: Column, role: str, gender: Column) -> Column:
            return F.struct(word.alias("word"), F.concat(F.lit(role + ":"), gender, F.lit(":"), F.lower(word)).alias("norm"))

        surname = F.when(last == "", first).otherwise(last)
        kind = F.when(surname.rlike(r"\p{IsCyrillic}(?:[аяАЯ])$"), "w").otherwise("s")
        return F.when(last == "", F.array(name(surname, "surname", kind))).otherwise(F.array(name(first, "given", gender), name(surname, "surname", kind)))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), of))
    return F.when(text.rlike(PERSON), found).otherwise(F.array().cast("array<struct<word:string,norm:string>>"))


def pattern_for(names: Column) -> Column:
    """The pattern of a document: that of all texts, and behind it the names found there, longer ones first."""
    words = F.array_distinct(F.transform(names, lambda x: x["word"]))
    order = F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(F.size(names) > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?=\p{Lu})(?:"), F.array_join(order, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(PATTERN))


def mentions_in(text: Column, pattern: Column) -> Column:
    """All mentions of a text in order; none for a null text."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    out = F.lit("phone")
    for kind in ("card", "ip", "ssn", "iban", "hex_secret", "person", "access_key", "password", "email"):
        out = F.when(mention.rlike(f"^(?:{PARTS.get(kind, _NAME)})$"), F.lit(kind)).otherwise(out)
    return out


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normal(kind: Column, mention: Column, names: Column) -> Column:
    """What is the same for all mentions of an entity."""
    number = F.regexp_replace(digits(mention), "^1(?=[0-9]{10}$)", "")  # a number without a country is one of +1
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "phone", number)
        .when(kind.isin("card", "ssn"), digits(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "password", F.regexp_replace(mention, "^[^=]+=", ""))
        .when(kind == "person", F.element_at(F.filter(names, lambda x: x["word"] == mention), 1)["norm"])
        .otherwise(mention)
    )


def stream(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits that depend on the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1f0")), 512), F.sha2(F.concat(seed, F.lit("\x1f1")), 512))


def draw(h: Column, k: Column) -> Column:
    """The ``k``-th number from 0 to 65535 of a stream, from 0; 64 numbers, then again."""
    return F.conv(F.substring(h, F.pmod(k, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def reshaped(value: Column, h: Column, hexadecimal: bool = False) -> Column:
    """Other characters of the same classes in the same places; ASCII letters for letters and digits beyond ASCII."""
    letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"

    def other(c: Column, k: Column) -> Column:
        b = draw(h, k)

        def one(of: str) -> Column:
            return F.substring(F.lit(of), (b % len(of)) + 1, F.lit(1))

        return (
            F.when(c.rlike("[0-9]"), one("0123456789"))
            .when(c.rlike("[a-z]"), one(letters))
            .when(c.rlike("[A-Z]"), one(letters.upper()))
            .when(c.rlike(r"[\p{L}\p{N}]"), one(letters))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), other), "")


def luhn(number: Column) -> Column:
    """A card number's digits with the last one set so that the number passes its check."""
    n = F.length(number)
    body = F.substring(number, F.lit(1), n - 1)

    def part(k: Column) -> Column:
        d = F.substring(body, k, F.lit(1)).cast("int") * F.when((n - k) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), part), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def iban(country: Column, rest: Column) -> Column:
    """An account number with the check digits that make it leave 1 when divided by 97."""
    as_number = F.array_join(F.transform(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    left = F.aggregate(F.split(as_number, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97))
    return F.concat(country, F.lpad((F.lit(98) - left).cast("string"), 2, "0"), rest)


def made_name(norm: Column, h: Column, attempt: Column) -> Column:
    """A name of the entity's role, gender and script; later draws are longer."""

    def of(script: str, gender: str) -> Column:
        syllables, endings = F.array(*map(F.lit, SYLLABLES[script])), F.array(*map(F.lit, ENDINGS[script, gender]))
        first = F.transform(F.sequence(F.lit(0), F.lit(1) + attempt), lambda j: syllables[draw(h, j) % len(SYLLABLES[script])])
        return F.concat(F.array_join(first, ""), endings[draw(h, F.lit(59)) % len(ENDINGS[script, gender])])

    head, cyrillic, out = F.regexp_extract(norm, "^[a-z]+:[a-z]:", 0), norm.rlike(r"\p{IsCyrillic}"), None
    for script, gender in ENDINGS:
        at = cyrillic == F.lit(script == "cyrillic")
        at = at & F.substring(head, -2, 1).isin(gender) if (script, gender) != ("latin", "s") else at
        out = F.when(at, of(script, gender)) if out is None else out.when(at, of(script, gender))
    return F.concat(head, out)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str, site: Column) -> Column:
    """An entity's surrogate in normal form, at the given attempt."""
    h = stream(key, kind, norm, attempt.cast("string"))
    suffix = F.substring_index(norm, ".", -1)
    longer = F.repeat(F.lit("a"), F.greatest(attempt - 1, F.lit(0)))
    octets = F.array(*[(draw(h, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    leading = (draw(h, F.lit(60)) % 8 + 2).cast("string")
    shaped = reshaped(norm, h)
    n = F.length(norm)
    rest = F.substring(shaped, F.lit(2), n)
    country = F.substring(norm, F.lit(1), n - 10)  # of a phone number, which stays
    return (
        F.when(kind == "email", F.concat(reshaped(F.concat(F.substring_index(norm, "@", 1), longer), h), F.lit("@"), site))
        .when(kind == "domain", F.concat(reshaped(F.concat(F.substring(norm, F.lit(1), n - F.length(suffix) - 1), longer), h), F.lit("."), suffix))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", luhn(F.concat(F.substring(norm, 1, 1), rest)))
        .when(kind == "phone", F.concat(country, leading, F.substring(shaped, n - 8, F.lit(9))))
        .when(kind == "access_key", F.concat(F.lit("AKIA"), F.substring(shaped, F.lit(5), n)))
        .when(kind == "iban", iban(F.substring(norm, 1, 2), F.substring(shaped, F.lit(5), n)))
        .when(kind == "hex_secret", reshaped(norm, h, hexadecimal=True))
        .when(kind == "person", made_name(norm, h, attempt))
        .when(kind == "password", reshaped(F.concat(norm, longer), h))
        .otherwise(shaped)
    )


def surrogates(entities: DataFrame, key: str = KEY, attempts: int = 64) -> DataFrame:
    """Distinct surrogates for distinct entities (``kind``, ``norm``), none of them an entity.

    Domains of addresses are entities by themselves: addresses of one domain share its surrogate.
    """
    plain = entities.select("kind", "norm", F.lit(None).cast("string").alias("domain"))
    domain = F.when(F.col("kind") == "email", F.substring_index("norm", "@", -1))
    domains = entities.filter("kind = 'email'").select(F.lit("domain").alias("kind"), domain.alias("norm")).distinct()
    sites = distinct_draws(persist(domains.withColumn("site", F.lit(None).cast("string")), "domains"), key, attempts)
    sites = sites.select(F.col("norm").alias("of"), F.col("surrogate").alias("site"))
    plain = plain.withColumn("domain", domain).join(sites, F.col("domain") == F.col("of"), "left").select("kind", "norm", "site")
    return distinct_draws(persist(plain, "entities"), key, attempts)


def distinct_draws(entities: DataFrame, key: str, attempts: int) -> DataFrame:
    """``kind``, ``norm`` and ``surrogate`` for entities with the ``site`` of addresses; those that collide are drawn again."""
    spark = entities.sparkSession
    # few bytes, but much work for each: in as many tasks as there may be
    waiting, kept, attempt = entities.repartition(shuffle_partitions(spark), "kind", "norm"), None, 0
    while True:
        drawn = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key, F.col("site")))
        drawn = persist(drawn.select("kind", "norm", "surrogate"), "drawn")
        drawn = drawn.join(entities.select(F.col("kind").alias("k"), F.col("norm").alias("real")), (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("real")), "left")
        if kept is not None:
            drawn = drawn.join(kept.select(F.col("kind").alias("k2"), F.col("surrogate").alias("used")), (F.col("kind") == F.col("k2")) & (F.col("surrogate") == F.col("used")), "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("string"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"), F.max("real").alias("real"), F.max("used").alias("used"))
        good = persist(first.filter("real IS NULL AND used IS NULL").select("kind", "norm", "surrogate"), "surrogates")
        kept = good if kept is None else kept.unionByName(good)
        left = persist(waiting.join(good.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "site"), "collided")
        if left.isEmpty():
            return kept
        waiting, attempt = left, attempt + 1
        if attempt >= attempts:
            raise ValueError("no free surrogates are left for some entities")


def filled(mention: Column, numbers: Column, skip: Column) -> Column:
    """The mention with its digits behind the first ``skip`` replaced by ``numbers``."""
    start = F.struct(F.lit("").alias("s"), (F.lit(1) - skip).alias("k"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(a["s"], F.when(digit & (a["k"] > 0), F.substring(numbers, a["k"], F.lit(1))).otherwise(c)).alias("s"),
            (a["k"] + digit.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(mention, ""), start, step, lambda a: a["s"])


def written(kind: Column, mention: Column, new: Column) -> Column:
    """A surrogate in the format of the mention that it replaces."""
    grouped = F.trim(F.regexp_replace(new, "(.{4})", "$1 "))
    return (
        F.when(kind.isin("card", "ssn"), filled(mention, new, F.lit(0)))
        .when(kind == "phone", filled(mention, new, F.length(digits(mention)) - F.length(new)))
        .when(kind == "iban", F.when(mention.contains(" "), grouped).otherwise(new))
        .when(kind == "password", F.concat(F.regexp_extract(mention, "^[^=]+=", 0), new))
        .when(kind == "person", F.when(F.upper(mention) == mention, F.upper(F.regexp_replace(new, "^.*:", ""))).otherwise(F.initcap(F.regexp_replace(new, "^.*:", ""))))
        .when((kind == "email") & (F.upper(mention) == mention), F.upper(new))
        .otherwise(new)
    )


def replace(docs: DataFrame, text_column: str = "text", key: str = KEY, length_column: str | None = None, count_column: str | None = None) -> DataFrame:
    """All rows, with every mention in ``text_column`` replaced by its surrogate.

    A null or empty text stays as it is.  Rows need no id: repeated rows and null ids are
    replaced alike.  ``length_column``, if the table has it, becomes the new text's length in
    rows that change; ``count_column`` adds the number of mentions.  All other columns stay,
    whatever their names; an empty table gives no rows.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).alias("row"))
    at = f"c{columns.index(text_column)}"
    names = names_in(F.col(f"row.{at}"))
    found = mentions_in(F.col(f"row.{at}"), pattern_for(names))
    searched = packed.filter(F.col(f"row.{at}").rlike(HINT)).select("row", names.alias("names"))
    has = searched.withColumn("pattern", pattern_for(F.col("names")))
    has = has.withColumn("mentions", mentions_in(F.col(f"row.{at}"), F.col("pattern"))).filter(F.size("mentions") > 0)
    # numbers given once, in a table: they differ from row to row and stay as they are
    has = persist(has.withColumn("n", F.monotonically_increasing_id()), "mentions")

    mention = F.col("mention")
    each = has.select("n", "names", F.posexplode("mentions").alias("pos", "mention")).withColumn("kind", kind_of(mention))
    each = each.withColumn("norm", normal(F.col("kind"), mention, F.col("names")))
    entities = persist(each.select("kind", "norm").distinct(), "entities")
    # a table again, so that both sides of the join are dealt anew and a hot entity can be split
    known = persist(surrogates(entities, key), "known").select(F.col("kind").alias("k"), F.col("norm").alias("e"), "surrogate")
    new = each.join(known, (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("e")))
    new = new.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("pos", written(F.col("kind"), mention, F.col("surrogate")).alias("new")))).alias("new"))
    text = F.col(f"row.{at}")
    pieces = F.zip_with(F.split(text, F.col("pattern"), -1), F.col("new.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = has.join(new, "n").withColumn("changed", F.array_join(pieces, ""))

    def out(df: DataFrame, new_text: Column, count: Column, new_length: Column | None) -> DataFrame:
        chosen = []
        for k, c in enumerate(columns):
            value = F.col(f"row.c{k}")
            if c == text_column:
                value = new_text
            elif c == length_column and new_length is not None:
                value = new_length.cast(docs.schema[c].dataType)
            chosen.append(value.alias(c))
        return df.select(*chosen, *([count.cast("long").alias(count_column)] if count_column else []))

    same = out(packed.filter(F.size(found) == 0), text, F.lit(0), None)
    return same.union(out(changed, F.col("changed"), F.size("mentions"), F.length("changed")))
