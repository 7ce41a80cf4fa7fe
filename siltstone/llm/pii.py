"""Surrogates for personal data.

E-mail addresses, telephone numbers, IPv4 addresses, payment cards, US social security numbers,
IBANs and names after a form of address are found by one pattern. Each distinct entity
gets a surrogate drawn from a keyed digest of what it is: of the same type and format,
with names of the same gender and script. A full name takes the last name's own surrogate,
so "Mr. Smith" stays the same person as "Mr. John Smith". Addresses stay of their kind (private, loopback,
link-local, multicast). The same entity has the same surrogate wherever it
stands and however it is spaced; two entities never share one, and no surrogate is an entity that occurs:
those that would are drawn again. Only where entities fill a format (a whole private network) so that nothing
is free do they get each other's values.

DataFrame operations only. Texts without entities pass through; of the others only the
entities, narrow rows, are shuffled, reduced to distinct ones before surrogates are drawn.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_known, sized, stash, unstash

# First and last names by script and gender, and forms of address by gender.
LATIN_MALE = "Adrian Bernard Conrad Damian Edgar Fabian Gaspard Henrik Ivo Jonas Klaus Leandro Marius Norbert Oscar Pascal Quentin Rainer Silvan Tobias Ulrich Valentin Walter Xavier Yannick Zeno".split()
LATIN_FEMALE = "Adela Beatrix Clara Dorothea Elisa Frida Greta Hanna Irene Judith Katrin Lucia Martha Nadine Olivia Paula Quirina Rosalie Sabine Theresa Ulrike Vera Wanda Xenia Yvonne Zoe".split()
LATIN_LAST = "Albers Brandt Castell Dorval Ehlers Fontaine Gruber Hollis Ibarra Jansen Keller Lindholm Moreau Navarro Ortega Pfeiffer Quintero Rossel Santoro Tanner Ullmann Vidal Winter Xander Yates Zeller".split()
CYRILLIC_MALE = "Андрей Борис Виктор Глеб Денис Егор Захар Илья Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур Фёдор".split()
CYRILLIC_FEMALE = "Алла Валентина Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Марина Наталья Ольга Полина Раиса Светлана Тамара Юлия".split()
CYRILLIC_LAST = "Белый Громов Дубров Жилин Зимин Карпов Лосев Мороз Носов Орлов Петров Рогов Серов Титов Уваров Фомин Чехов Шилов".split()
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа")

_TITLE = "|".join((*MALE_TITLES, *FEMALE_TITLES, "Dr"))
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
# Repeated groups are possessive or bounded: others recurse in Java, and a long text would end the stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_QUICK = rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}"


def type_of(surface: Column) -> Column:
    """Which pattern a found entity is of."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(surface.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, surface: Column) -> Column:
    """What makes two mentions one entity: case for addresses, spacing and punctuation for numbers, the form of address for names."""
    plain = F.regexp_replace(surface, r"[^0-9A-Za-z+]", "")
    return F.when(kind == "email", F.lower(surface)).when(kind == "name", F.regexp_replace(surface, rf"^(?:{_TITLE})\.? ", "")).when(kind == "ip", surface).otherwise(F.upper(plain))


def _gender(surface: Column) -> Column:
    m = surface.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\.? ")
    f = surface.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? ")
    return F.when(m, "m").when(f, "f")


def _digest(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts in hex."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(c ^ x for c in secret))
    said = F.encode(F.concat_ws("|", *[p.cast("string") for p in parts]), "UTF-8")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), said), 256))), 256)


def _shaped(value: Column, digest: Column, keep: Column | int = 0) -> Column:
    """``value`` with digits for digits and letters for letters of the same case, drawn
    from the digest by place; the first ``keep`` characters and all others stay."""
    digits = F.concat(F.translate(digest, "abcdef", "274961"), F.translate(F.reverse(digest), "abcdef", "583072"))
    letters = F.concat(F.translate(digest, "0123456789abcdef", "bkdrmlnpsatveioz"), F.translate(F.reverse(digest), "0123456789abcdef", "gfhjcuwyqxteasdl"))
    chars = F.split(value, "")

    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        d, a = F.substring(digits, at, F.lit(1)), F.substring(letters, at, F.lit(1))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), d).when(c.rlike("[a-z]"), a).when(c.rlike("[A-Z]"), F.upper(a)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one counted once."""
    rev = F.split(F.reverse(digits), "")

    def add(acc: Column, p: Column) -> Column:
        d = p["d"].cast("int") * F.when(p["i"] % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(rev, lambda c: c != ""), lambda c, i: F.struct(c.alias("d"), i.alias("i"))), F.lit(0), add)


def _card(value: Column, digest: Column) -> Column:
    """Keeps the issuer's first digit, the length, and whether Luhn's check holds."""
    draft = _shaped(value, digest, 1)
    body = F.substring(draft, F.lit(1), F.length(draft) - 1)
    fix = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    valid = F.pmod(_luhn_sum(value), F.lit(10)) == 0
    return F.when(valid, F.concat(body, fix)).otherwise(draft)


#: What addresses that aren't public start with (private, loopback, this network, link-local, multicast and reserved), which they keep.
_SPECIAL = r"^(10|127|0|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|2(?:2[4-9]|[34][0-9]|5[0-5]))\."


def _ip(value: Column, digest: Column) -> Column:
    octet = lambda k, low, span: (F.pmod(F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("long"), F.lit(span)) + low).cast("string")
    private = F.regexp_extract(value, _SPECIAL, 1)
    n = F.when(private == "", 4).otherwise(4 - F.size(F.split(private, r"\.")))
    tail = F.array(octet(0, 11, 89), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    return F.when(private == "", F.array_join(tail, ".")).otherwise(F.concat(private, F.lit("."), F.array_join(F.slice(tail, 5 - n, n), ".")))


def _email(value: Column, digest: Column, key: str) -> Column:
    """The domain's surrogate hangs on the domain alone, and its last label stays."""
    domain = F.substring_index(value, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    return F.concat(_shaped(F.substring_index(value, "@", 1), digest), F.lit("@"), _shaped(host, _digest(key, F.lit("domain"), domain)), F.lit("."), F.substring_index(domain, ".", -1))


def _pick(names: list[str], digest: Column, at: int) -> Column:
    n = F.pmod(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(len(names))).cast("int")
    return F.get(F.array(*[F.lit(x) for x in names]), n)


def _name(value: Column, gender: Column, digest: Column, attempt: int, last: Column) -> Column:
    """A last name of the same script, or, if two names were given, a first name of the same gender before ``last``, the last name's
    surrogate. After the first attempt with a second name, after eight with a made-up one, so that there are always enough."""
    g = F.coalesce(gender, F.when(F.substring(digest, 60, 1) < "8", "m").otherwise("f"))
    cyrillic = value.rlike(r"\p{IsCyrillic}")

    def first(at: int) -> Column:
        of = lambda male, female: F.when(g == "m", _pick(male, digest, at)).otherwise(_pick(female, digest, at))
        return F.when(cyrillic, of(CYRILLIC_MALE, CYRILLIC_FEMALE)).otherwise(of(LATIN_MALE, LATIN_FEMALE))

    surname = lambda at: F.when(cyrillic, _pick(CYRILLIC_LAST, digest, at)).otherwise(_pick(LATIN_LAST, digest, at))
    made = F.concat(F.lit("-"), _shaped(F.lit("Aaaaaa"), digest)) if attempt > 8 else F.lit("")
    more = lambda name: F.concat(name(1), F.lit("-"), name(17), made) if attempt else name(1)
    return F.when(value.contains(" "), F.concat(more(first), F.lit(" "), last)).otherwise(more(surname))


def _draw(key: str, attempt: int) -> Column:
    kind, v, d = F.col("kind"), F.col("entity"), _digest(key, F.col("kind"), F.col("entity"), F.lit(attempt))
    by_kind = F.when(kind == "email", _email(v, d, f"{key}|{max(0, attempt - 3)}")).when(kind == "ip", _ip(v, d)).when(kind == "card", _card(v, d)).when(kind == "name", _name(v, F.col("gender"), d, attempt, F.col("last")))
    return by_kind.when(kind == "iban", _shaped(v, d, 2)).when((kind == "phone") & v.startswith("+"), _shaped(v, d, 2)).otherwise(_shaped(v, d))


def _format() -> Column:
    """What a surrogate keeps of its entity: values of one format may stand for each other."""
    kind, v = F.col("kind"), F.col("entity")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    head = F.when(kind == "card", F.concat(F.substring(v, 1, 1), (F.pmod(_luhn_sum(v), F.lit(10)) == 0).cast("string"))).when((kind == "iban") | (kind == "phone") & v.startswith("+"), F.substring(v, 1, 2))
    of_name = F.concat_ws(" ", v.rlike(r"\p{IsCyrillic}").cast("string"), F.col("gender"), v.contains(" ").cast("string"))
    private = F.regexp_extract(v, _SPECIAL, 1)
    tail = F.when(kind == "email", F.substring_index(v, ".", -1)).otherwise(F.lit(""))
    return F.when(kind == "name", of_name).when(kind == "ip", private).otherwise(F.concat(F.coalesce(head, F.lit("")), F.lit(":"), shape, F.lit(":"), tail))


def _permuted(left: DataFrame, given: DataFrame, key: str, group: int = 1000) -> DataFrame:
    """For entities of formats so full that draws found nothing free: each is given the next one of its format, by a keyed order within groups
    of some ``group``, going round. Drawn surrogates are never entities, so these are still distinct; a surrogate may then
    be another person's value. One that is alone changes places with one of its format that has a
    surrogate; the only one of its format has its letters and digits blotted out."""
    rows = left.withColumn("format", _format()).withColumn("h", _digest(key, F.lit("order"), F.col("kind"), F.col("entity")))
    many = rows.groupBy("kind", "format").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / group)).alias("groups"))
    rows = rows.join(many, ["kind", "format"]).withColumn("part", F.pmod(F.xxhash64("h"), F.col("groups")))
    w = Window.partitionBy("kind", "format", "part").orderBy("h", "entity")
    whole = Window.partitionBy("kind", "format", "part").orderBy("h", "entity").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("surrogate", F.coalesce(F.lead("entity").over(w), F.first("entity").over(whole)))
    turned = rows.where("surrogate <> entity").select("kind", "entity", "surrogate")
    alone = rows.where("surrogate = entity").select("kind", "format", F.col("entity").alias("one"))
    part = given.withColumn("format", _format()).join(alone, ["kind", "format"]).groupBy("kind", "one").agg(F.min(F.struct("entity", "surrogate")).alias("with"))
    swapped = part.select("kind", F.explode(F.array(F.struct(F.col("one").alias("entity"), F.col("with.surrogate").alias("surrogate")), F.struct(F.col("with.entity").alias("entity"), F.col("one").alias("surrogate")))).alias("s")).select("kind", "s.*")
    blotted = alone.join(part, ["kind", "one"], "left_anti").select("kind", F.col("one").alias("entity"), F.regexp_replace("one", r"[\p{L}\p{N}]", "X").alias("surrogate"))
    return turned.unionByName(swapped).unionByName(blotted)


def _settled(known: DataFrame, key: str, most_attempts: int) -> DataFrame:
    """(kind, entity, gender, last) distinct by (kind, entity) -> (kind, entity, surrogate).

    All are drawn; a surrogate that is an entity itself, or that an entity holds already, is drawn again: of several that drew the same in one
    attempt, the least keeps it. An attempt reads what is settled, but shuffles only what isn't. What is still without one after
    ``most_attempts``, as its format has hardly a free value, is ``_permuted``."""
    real = known.select("kind", F.col("entity").alias("surrogate"))
    settled, left, old = [], known, []
    for attempt in range(most_attempts):
        drawn = stash(left.select("kind", "entity", "gender", "last", _draw(key, attempt).alias("surrogate")))
        best = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        taken = reduce(DataFrame.unionByName, [real, *[s.select("kind", "surrogate") for s in settled]])
        few = sized(drawn.select("kind", "surrogate"))
        taken = taken.join(few, ["kind", "surrogate"], "left_semi")
        settled.append(stash(best.join(taken, ["kind", "surrogate"], "left_anti").join(known, ["kind", "entity"]).select("kind", "entity", "gender", "surrogate")))
        unstash(*old)
        left = stash(drawn.join(settled[-1], ["kind", "entity"], "left_anti").select("kind", "entity", "gender", "last"))
        old = [drawn, left]
        if not left.take(1):
            break
    given = reduce(DataFrame.unionByName, settled)
    if left.take(1):
        more = stash(_permuted(left, given, key))
        given = given.join(sized(more.select("kind", "entity")), ["kind", "entity"], "left_anti").select("kind", "entity", "surrogate").unionByName(more)
    return given.select("kind", "entity", "surrogate")


def surrogates(entities: DataFrame, key: str, most_attempts: int = 24) -> DataFrame:
    """(kind, entity, gender) -> (kind, entity, surrogate): one for each distinct (kind, entity), all distinct within a kind, and none an entity.

    A full name is a first name and the surrogate of its last name, whether that occurs alone or not: those are settled first."""
    known = stash(entities.where("kind is not null and entity is not null").groupBy("kind", "entity").agg(F.min("gender").alias("gender")))
    full = (F.col("kind") == "name") & F.col("entity").contains(" ")
    surname = F.substring_index("entity", " ", -1)
    named = known.where(full).withColumn("surname", surname)
    alone = known.where(~full).withColumn("asked", F.lit(True)).unionByName(named.select("kind", F.col("surname").alias("entity"), F.lit(None).cast("string").alias("gender"), F.lit(False).alias("asked")))
    alone = stash(alone.groupBy("kind", "entity").agg(F.min("gender").alias("gender"), F.max("asked").alias("asked"), F.lit(None).cast("string").alias("last")))
    short = stash(_settled(alone.drop("asked"), key, most_attempts))
    if not named.take(1):
        return short
    lasts = stash(short.where("kind = 'name'").select(F.col("entity").alias("surname"), F.col("surrogate").alias("last")))
    copies = stash(named.groupBy("surname").agg(F.count(F.lit(1)).alias("copies")).join(lasts, "surname"))
    whole = stash(join_known(named, copies, "surname", "copies").select("kind", "entity", "gender", "last"))
    asked = short.join(sized(alone.where("not asked").select("kind", "entity")), ["kind", "entity"], "left_anti")
    return asked.unionByName(_settled(whole, key, most_attempts))


def _rendered(kind: Column, surface: Column, surrogate: Column) -> Column:
    """A surrogate written as its mention was: spacing, punctuation, capitals, form of address."""
    chars = F.filter(F.split(surface, ""), lambda c: c != "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z+]")
        return F.struct(F.concat(acc["out"], F.when(own, F.substring(surrogate, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + own.cast("int")).alias("at"))

    spaced = F.aggregate(chars, state, put, lambda acc: acc["out"])
    title = F.regexp_extract(surface, rf"^((?:{_TITLE})\.? )", 1)
    capitals = (surface == F.upper(surface)) & (surface != F.lower(surface))
    return F.when(kind == "name", F.concat(title, surrogate)).when(kind == "email", F.when(capitals, F.upper(surrogate)).otherwise(surrogate)).when(kind == "ip", surrogate).otherwise(spaced)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced and n_entities (bigint) added; a column of that name is
    replaced. ``key`` is the secret that surrogates hang on: without it they can't be drawn again. Null texts stay null with 0 entities; texts without entities stay as they
    are; rows keep their number, and repeated rows come out alike."""
    if not key:
        raise ValueError("a key is needed")
    cols = [c for c in docs.columns if c != "n_entities"]
    src = docs.select(*cols)
    t = F.col(text_col)
    hit = F.coalesce(t.rlike(_QUICK) & t.rlike(_ANY), F.lit(False))
    found = F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))
    parts = src.where(hit).select(F.struct(*cols).alias("_row"), F.split(t, _ANY, -1).alias("_parts"), found.alias("_found")).withColumn("_key", F.monotonically_increasing_id())
    parts = stash(parts)
    each = parts.select("_key", F.posexplode("_found").alias("_pos", "surface")).withColumn("kind", type_of(F.col("surface")))
    each = each.withColumn("entity", canonical(F.col("kind"), F.col("surface"))).withColumn("gender", F.when(F.col("kind") == "name", _gender(F.col("surface"))))
    each = stash(each)
    what = ["kind", "entity"]
    # an address in very many texts is one key: its surrogate comes to its mentions by broadcast
    counted = stash(each.groupBy(*what).agg(F.min("gender").alias("gender"), F.count(F.lit(1)).alias("copies")))
    table = stash(surrogates(counted.drop("copies"), key).join(counted.select(*what, "copies"), what))
    new = join_known(each, table, what, "copies").select("_key", "_pos", _rendered(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("_new"))
    new = new.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_pos", "_new"))).alias("_new"))
    joined = F.array_join(F.zip_with("_parts", F.transform("_new", lambda x: x["_new"]), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    changed = parts.join(new, "_key").select(*[F.col(f"_row.`{c}`").alias(c) if c != text_col else joined.alias(c) for c in cols], F.size("_found").cast("long").alias("n_entities"))
    return src.where(~hit).withColumn("n_entities", F.lit(0).cast("long")).unionByName(changed)
