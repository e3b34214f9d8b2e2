"""Personal data replaced by surrogates of the same kind, with DataFrame functions only.

Entities are found by one regular expression. A surrogate follows from a keyed hash of the kind and the canonical form
of the entity, so every mention of an entity gets the same one, in every document and every run with the same key. It
keeps the kind and the format: digits stay digits, separators stay in place, card numbers keep a valid check digit,
names keep script and the gender that their title tells. Over all entities of the table a check finds surrogates that
two entities share, or that are themselves an entity; those entities take the next hash until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadrank.llm.common import text_key, without
from leadrank.session import cut_lineage

# Titles that open a name, by the gender they tell.
MALE_TITLES = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа")
# Titles after which any noun has a capital too, degrees, and small words inside names.
GERMAN_TITLES = ("Herr", "Herrn", "Frau")
DEGREES = ("Dr", "Prof", "Professor", "Professorin", "Doktor")
PARTICLES = ("van", "von", "vom", "zu", "zum", "zur", "de", "del", "della", "der", "den", "des", "di", "da", "dos", "du", "la", "le", "ter", "ten", "bin", "ibn", "al", "el")
# Given names and syllables of surnames, by script.
MALE_NAMES = ("Adrian", "Bruno", "Cedric", "Dario", "Emil", "Felix", "Gregor", "Hugo", "Ivo", "Jonas", "Konrad", "Leon")
FEMALE_NAMES = ("Alma", "Berta", "Clara", "Dora", "Elin", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Lea")
CYRILLIC_MALE = ("Антон", "Борис", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл")
CYRILLIC_FEMALE = ("Алла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Карина")
SYLLABLES = ("bar", "cor", "dal", "fen", "gol", "har", "jen", "kel", "lor", "mar", "nev", "pol", "ras", "sol", "tam", "ver")
CYRILLIC_SYLLABLES = ("бар", "вел", "гор", "дан", "зим", "кол", "лар", "мир", "нев", "пол", "рос", "сол", "там", "фед", "хар", "шир")

# A capital and all letters, marks, hyphens and apostrophes that follow it; at least one of them is a small letter.
_NAME_WORD = r"\p{Lu}(?=[\p{L}\p{M}'’\-]*\p{Ll})(?:[\p{L}\p{M}]|['’\-](?=\p{L}))*+"
_TITLES = MALE_TITLES + FEMALE_TITLES
# Small words and initials, then a word that is no title of somebody else.
_NAME_PART = (
    rf"(?:(?:{'|'.join(PARTICLES)})[\x20])*+(?:\p{{Lu}}\.?[\x20](?=\p{{Lu}}))*+"
    rf"(?!(?:{'|'.join(_TITLES)})(?![\p{{L}}\p{{M}}]))(?:[dDlL]['’])?+{_NAME_WORD}"
)
_DEGREES = rf"(?:(?:{'|'.join(DEGREES)})\.?[\x20])*"


def _names(titles: tuple[str, ...], more: str) -> str:
    return rf"(?<![\p{{L}}])(?:{'|'.join(titles)})\.?[\x20]{_DEGREES}+{_NAME_PART}(?:[\x20]{_NAME_PART}){more}"


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9][A-Za-z0-9\-]{0,62}+(?:\.[A-Za-z0-9][A-Za-z0-9\-]{0,62}+){1,8}+",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|token|secret|api[_\-]?key)[\"']?+[\x20\t]*+[:=][\x20\t]*+(?:\"[^\"\r\n]{8,}+|'[^'\r\n]{8,}+|[^\s\"'][^\s]{7,}+)",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?\([0-9]{1,4}\)[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,3}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "name": f"(?:{_names(GERMAN_TITLES, '{0,2}+')}|{_names(tuple(t for t in _TITLES if t not in GERMAN_TITLES), '*+')})",
}


def _any_of(*kinds: str) -> str:
    return "(?:" + "|".join(f"(?:{PATTERNS[kind]})" for kind in kinds) + ")"


# All kinds in one. Most places of a text are left after a look at one or two characters.
ANY = "|".join(
    (
        r"(?<![A-Za-z0-9])" + _any_of("email", "secret", "access_key", "iban"),
        r"(?=[0-9+(])" + _any_of("ip", "ssn", "phone", "card"),
        f"(?=[{''.join(sorted({title[0] for title in MALE_TITLES + FEMALE_TITLES}))}])" + _any_of("name"),
    )
)
# Country codes of phone numbers; those not listed with one or two digits have three.
_COUNTRY_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_SECRET_HEAD = r"""^([A-Za-z_\-]+["']?[\x20\t]*[:=][\x20\t]*["']?)"""
_TITLE = r"^([\p{L}]+\.?) "
_NAME_HEAD = rf"^([\p{{L}}]+\.?[\x20]{_DEGREES})"
_PARTICLE = rf"(?<![\p{{L}}'’\-])(?:{'|'.join(PARTICLES)})[\x20]"
# From this try on a surrogate also grows, so that small formats never run out of values.
GROWING_TRY = 4


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def kind_of(found: Column) -> Column:
    """The kind of a string that the expression has found."""
    return (
        F.when(found.rlike(rf"^(?:{PATTERNS['secret']})$"), "secret")
        .when(found.contains("@"), "email")
        .when(found.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "access_key")
        .when(found.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(rf"^(?:{PATTERNS['phone']})$"), "phone")
        .when(found.rlike(r"^[0-9]"), "card")
        .otherwise("name")
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check; a valid number has a multiple of ten."""
    steps = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10
        ),
    )
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _iban_check(country: Column, own: Column) -> Column:
    """The two check digits of an account: they make the whole, read as a number, leave 1 when divided by 97."""
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    add = lambda rest, c: (rest * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + digit(c)) % 97
    rest = F.aggregate(F.split(F.concat(own, country, F.lit("00")), ""), F.lit(0), add)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _is_entity(found: Column) -> Column:
    """A run of digits that fails the check of card numbers is no entity."""
    return (kind_of(found) != "card") | (_luhn_sum(_digits(found)) % 10 == 0)


def canonical(found: Column) -> Column:
    """Kind and value that all mentions of an entity share, whatever their case or separators."""
    return _let(kind_of(found), lambda kind: F.concat(kind, F.lit(":"), _value(found, kind)))


def _value(found: Column, kind: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind == "secret", F.regexp_replace(found, _SECRET_HEAD, ""))
        .when(kind == "phone", F.regexp_replace(found, r"[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), _digits(found))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "name", F.concat(_gender(found), F.lit(" "), F.lower(F.regexp_replace(found, _NAME_HEAD, ""))))
        .otherwise(found)
    )


def _gender(found: Column) -> Column:
    title = F.regexp_replace(F.regexp_extract(found, _TITLE, 1), r"\.$", "")
    return F.when(title.isin(*MALE_TITLES), "m").otherwise("f")


def _stream(entity: Column, key: str, tries: Column, length: int = 4) -> Column:
    """Hex digits of a keyed hash, 64 for each part."""
    parts = [F.sha2(F.concat(F.lit(key), F.lit(f"|{part}|"), tries.cast("string"), F.lit("|"), entity), 256) for part in range(length)]
    return F.concat(*parts)


def _number(stream: Column, place: Column | int) -> Column:
    """A number from 0 to 65535 from four hex digits of the stream."""
    at = F.pmod(F.lit(place) if isinstance(place, int) else place, F.lit(63)) * 4 + 1
    return F.conv(F.substr(stream, at, F.lit(4)), 16, 10).cast("int")


def _pick(stream: Column, place: Column | int, choices: tuple[str, ...] | str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), _number(stream, place) % len(choices) + 1)


def _fill(shape: Column, stream: Column) -> Column:
    """`shape` with each digit and ASCII letter replaced by one of its class; all else stays."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chars = F.transform(
        F.split(shape, ""),
        lambda c, i: F.when(c.rlike("^[0-9]$"), (_number(stream, i) % 10).cast("string"))
        .when(c.rlike("^[a-z]$"), F.substr(F.lit(lower), _number(stream, i) % 26 + 1, F.lit(1)))
        .when(c.rlike("^[A-Z]$"), F.substr(F.lit(upper), _number(stream, i) % 26 + 1, F.lit(1)))
        .otherwise(c),
    )
    return F.array_join(chars, "")


def _lay_out(shape: Column, chars: Column, place: str = "^[0-9]$") -> Column:
    """`chars` written into those places of `shape` that hold a digit, or whatever `place` matches."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    done = F.aggregate(
        F.split(shape, ""),
        start,
        lambda state, c: F.when(
            c.rlike(place),
            F.struct(
                F.concat(state["text"], F.substr(chars, state["next"], F.lit(1))).alias("text"),
                (state["next"] + 1).alias("next"),
            ),
        ).otherwise(F.struct(F.concat(state["text"], c).alias("text"), state["next"].alias("next"))),
    )
    return done["text"]


def surrogate(found: Column, entity: Column, tries: Column, key: str) -> Column:
    """The surrogate of a mention; `entity` is its canonical form, `tries` how many hashes were given up."""
    facts = F.struct(
        found.alias("found"),
        entity.alias("entity"),
        tries.alias("tries"),
        F.substring_index(entity, ":", 1).alias("kind"),
        _stream(entity, key, tries).alias("stream"),
    )
    return _let(facts, lambda e: _by_kind(e["found"], e["entity"], e["tries"], e["kind"], e["stream"]))


def _by_kind(found: Column, entity: Column, tries: Column, kind: Column, stream: Column) -> Column:
    grown = F.when(tries >= GROWING_TRY, F.substr(stream, F.lit(1), F.lit(12))).otherwise("")
    grown_letters = F.translate(grown, "0123456789", "ghijklmnop")
    local, domain = F.substring_index(entity, ":", -1), F.lit(".example.org")
    local = F.substring_index(local, "@", 1)
    email = F.concat(_fill(local, stream), grown, F.lit("@"), _pick(stream, 62, ("mail", "post", "box", "web")), domain)
    head = F.regexp_extract(found, _SECRET_HEAD, 1)
    body = F.regexp_replace(found, _SECRET_HEAD, "")
    is_hex = body.rlike("^[0-9a-f]+$")
    hexed = F.array_join(F.transform(F.split(body, ""), lambda c, i: F.substr(stream, F.pmod(i, F.lit(256)) + 1, F.lit(1))), "")
    secret = F.concat(head, F.when(is_hex, hexed).otherwise(_fill(body, stream)), grown)
    digits = _digits(found)
    # A phone number keeps its country code, a card its first digit; the last digit of a card is its check.
    # What a mention looks like only lays the value out: the value itself follows from the entity.
    number = _digits(entity)
    country = F.regexp_extract(entity, rf"^phone:\+({_COUNTRY_CODE})", 1)
    phone = F.concat(country, F.substr(_fill(number, stream), F.length(country) + 1, F.length(number)))
    body_of_card = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.substr(_fill(digits, stream), F.lit(2), F.length(digits) - 2))
    check = F.pmod(-_luhn_sum(F.concat(body_of_card, F.lit("0"))), F.lit(10)).cast("string")
    account = F.substring_index(entity, ":", -1)
    country_of = F.substr(account, F.lit(1), F.lit(2))
    own_part = _fill(F.substr(account, F.lit(5), F.length(account)), stream)
    account = _let(own_part, lambda own: F.concat(country_of, _iban_check(country_of, own), own))
    iban = F.concat(_lay_out(found, account, "^[A-Z0-9]$"), F.upper(grown))
    ip = F.concat_ws(".", *[((_number(stream, n) % 15 + 240) if n == 0 else _number(stream, n) % 254 + 1).cast("string") for n in range(4)])
    cyrillic = entity.rlike(r"\p{IsCyrillic}")
    male = entity.startswith("name:m")
    given = (
        F.when(cyrillic & male, _pick(stream, 0, CYRILLIC_MALE))
        .when(cyrillic, _pick(stream, 0, CYRILLIC_FEMALE))
        .when(male, _pick(stream, 0, MALE_NAMES))
        .otherwise(_pick(stream, 0, FEMALE_NAMES))
    )
    sounds = lambda choices: F.concat(*[_pick(stream, n, choices) for n in range(1, 6)])
    surname = F.initcap(F.concat(F.when(cyrillic, sounds(CYRILLIC_SYLLABLES)).otherwise(sounds(SYLLABLES)), grown_letters))
    title = F.regexp_extract(found, _NAME_HEAD, 1)
    called = F.regexp_replace(F.regexp_replace(found, _NAME_HEAD, ""), _PARTICLE, "")
    whole = F.concat(title, F.when(called.contains(" "), F.concat(given, F.lit(" "))).otherwise(""), surname)
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "access_key", F.concat(F.substr(found, F.lit(1), F.lit(4)), _fill(F.substr(found, F.lit(5), F.lit(16)), stream), F.upper(grown)))
        .when(kind == "iban", iban)
        .when(kind == "ip", ip)
        .when(kind == "card", _lay_out(found, F.concat(body_of_card, check)))
        .when(kind == "phone", _lay_out(found, phone))
        .when(kind == "ssn", _fill(found, stream))
        .otherwise(whole)
    )


def alias(found: Column, entity: Column, tries: Column, key: str) -> Column:
    """The canonical form of a surrogate; the plan holds the surrogate once, though the form names it many times."""
    return _let(surrogate(found, entity, tries, key), canonical)


def _found(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ANY), F.lit(0))


def colliding(entities: DataFrame, key: str) -> DataFrame:
    """`entity`, `tries` of those entities whose first surrogate is not theirs alone; `tries` says which one is.

    `entities` has one row per entity with a mention `found`. A surrogate belongs to the entity with the fewest tries,
    then the smallest name; a surrogate that is an entity itself belongs to nobody. The loop ends when each surrogate
    has one owner; the rows that move are few, since formats hold far more values than a corpus has entities.
    """
    # Entities are few next to the texts; dealt out by name they still keep all tasks busy with their surrogates.
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = cut_lineage(entities.withColumn("tries", F.lit(0)))
    while True:
        named = cut_lineage(owners.repartition(tasks, "entity").withColumn("alias", alias(F.col("found"), F.col("entity"), F.col("tries"), key)))
        shared = named.groupBy("alias").agg(F.count("*").alias("users"), F.min(F.struct("tries", "entity"))["entity"].alias("owner"))
        real = named.select(F.col("entity").alias("alias"), F.lit(True).alias("real"))
        lost = (
            named.join(shared.where("users > 1"), "alias", "left")
            .join(real, "alias", "left")
            .where(F.col("real").isNotNull() | (F.col("owner").isNotNull() & (F.col("owner") != F.col("entity"))))
            .select("entity")
        )
        lost = cut_lineage(lost)
        if lost.isEmpty():
            return owners.where("tries > 0").select("entity", "tries")
        moved = lost.withColumn("step", F.lit(1))
        owners = cut_lineage(
            owners.join(moved, "entity", "left").withColumn("tries", F.col("tries") + F.coalesce("step", F.lit(0))).drop("step")
        )


def pseudonymized(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with surrogates in `text`, and `n_entities`, the number of mentions replaced.

    * Kinds: e-mail addresses, passwords and tokens behind their label, access keys, IBANs, IPv4 addresses, US social
      security numbers, phone numbers, card numbers with a valid check digit, names behind a title.
    * Secrets are taken up to white space, or up to the closing quote if a quote opens them.
    * A name is a title, degrees, and the words with a capital that follow, with the initials and small words ("van", "de
      la") between them; the title of somebody else ends it. After a German title it has three such words at most, since
      every German noun has a capital. Degrees stay and tell no names apart.
    * Phone numbers are those with a country code or in a North American format. IPv6 addresses are not looked for.
    * Null texts stay null with 0 entities; empty texts and texts without entities stay as they are. Repeated rows get
      equal texts. An empty table gives an empty one. A column `n_entities` of `docs` is replaced.
    """
    marked = docs.select(text_key(text).alias("doc_key"), F.explode(F.array_distinct(_found(text))).alias("found"))
    mentions = cut_lineage(marked.where(_is_entity(F.col("found"))).distinct().withColumn("entity", canonical(F.col("found"))))
    moved = cut_lineage(colliding(mentions.groupBy("entity").agg(F.min("found").alias("found")), key))
    names = without(docs, ["n_entities", "__tries", "__doc_key", "__found"]).columns
    rows = docs.select(*[F.col(f"`{name}`") for name in names])
    if moved.isEmpty():
        rows = rows.withColumn("__tries", F.lit(None).cast("map<string,int>"))
    else:
        by_doc = mentions.select("doc_key", "entity").distinct().join(moved, "entity").groupBy("doc_key").agg(
            F.map_from_entries(F.collect_list(F.struct("entity", "tries"))).alias("__tries")
        )
        rows = rows.withColumn("__doc_key", text_key(text)).join(
            by_doc.withColumnRenamed("doc_key", "__doc_key"), "__doc_key", "left"
        )

    def replaced(found: Column) -> Column:
        tries = lambda entity: F.coalesce(F.try_element_at(F.col("__tries"), entity), F.lit(0))
        new = _let(canonical(found), lambda entity: surrogate(found, entity, tries(entity), key))
        return F.when(_is_entity(found), new).otherwise(found)

    rows = rows.withColumn("__found", _found(text))
    between = F.split(F.col(text), ANY, -1)
    new = F.array_join(
        F.zip_with(between, F.transform("__found", replaced), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    rewritten = F.when(F.size("__found") > 0, new).otherwise(F.col(text))
    count = F.size(F.filter("__found", _is_entity)).cast("long")
    return rows.select(
        *[(rewritten.alias(name) if name == text else F.col(f"`{name}`")) for name in names], count.alias("n_entities")
    )
