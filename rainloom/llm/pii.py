r"""Personal data and secrets replaced by keyed surrogates, in DataFrame functions only.

One pattern finds the entities; ``split`` by it gives the text between them, so a document is its gaps and its
entities in turn. An entity has a kind and a canonical form (digits of a card, lower case of an address, gender and
names of a person), and its surrogate is a function of a secret key, kind and canonical form alone: the same entity
gets the same surrogate in every document (coreference), written in the layout of each mention (spaces, brackets,
case, title). Within a document a person called by title and family name, or by the family name alone, is the first
one named in full with it. Surrogates keep the kind: digits for digits, letters of the same script and case for
letters, hexadecimal for hexadecimal, a Luhn-valid card for a valid one, an address for an address, a name of the same
gender and script for a name. Thirteen digits and more in one row that fail the Luhn check are no card and stay.
Names are found by a title or by a given name of the list, so others are missed.

Collision check: the distinct entities of the corpus are written down with their surrogates. Where two share one,
or a surrogate is a real entity, all but the first take the next attempt, until none collide. The few that moved
are joined to the documents that hold them, by the digest of their text.

Defined cases: null text stays null with no entities, empty text stays empty; repeated rows are treated alike; an empty
table gives an empty result; further columns are ignored. Every quantifier that may run long is possessive, so long texts
take linear time. A secret of any length is one entity; one hexadecimal digit
repeated over 512 times without a keyword is none.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settled

#: Given names by gender and script, for finding names and for making them.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Pierre Jean Luis Carlos Miguel Javier Pablo".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Anna Ursula Monika Sabine Marie Claire Carmen Lucía Elena Sofía".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
#: Titles that stand before a name, by gender ("n": either).
TITLES = {"m": "Mr Herr Monsieur Señor Sr Г-н".split(), "f": "Mrs Ms Miss Frau Mme Madame Mlle Señora Sra Г-жа".split(), "n": "Dr Prof".split()}
#: Syllables of surrogate family names.
SYLLABLES = {"latin": "ba do fen gar hol jin kel lor mas nev pol rud sen tor vik wel".split(), "cyrillic": "ба до фен гар хол жин кел лор мас нев пол руд сен тор вик зел".split()}
ENDINGS = {("m", "cyrillic"): "ов", ("f", "cyrillic"): "ова"}

_GAP = r"[^\p{L}\p{N}\n()+]{0,6}"
#: Words after a given name that make it a place or an institution.
PLACES = "Street St Avenue Road Lane Square Bridge Park Hall College University School Church Hospital Airport Island Museum Library Award Prize Day".split()
_NAME = rf"(?!(?:{'|'.join(PLACES)})(?![\p{{L}}]))\p{{Lu}}[\p{{L}}'’-]{{1,30}}+"
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_ALL_TITLES = "|".join(t for names in TITLES.values() for t in names)
_NAMED = rf"(?=\p{{Lu}})(?:(?:{_ALL_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_ALL_GIVEN}) {_NAME})(?! (?:{'|'.join(PLACES)})(?![\p{{L}}]))"
#: What names a secret, up to its value.
_LED = r"""(?i:token|secret|password|passwd|pwd|api[_-]?key|access_key)["']?\s{0,3}[=:]\s{0,3}["']?"""
_VALUE = r"[A-Za-z0-9+/_~.-]{8,}+"
#: One character over 512 times and nothing else is a filling, no secret.
_FILLING = r"(?<one>[0-9A-Fa-f])\k<one>{512,}+(?![\p{L}\p{N}])"
_HEX = rf"(?!{_FILLING})" r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{20,}+)(?![\p{L}\p{N}])"
_CARD = r"\d(?:[ -]?\d){12,18}(?![\p{N}])"
#: A secret that is named may follow letters (accessToken=...).
_NAMED_SECRET = rf"(?=[TtSsPpAa]){_LED}{_VALUE}"
#: Kind and pattern, in order of preference at one place. All begin where a word may begin: that is asked once, before them.
KINDS = [
    ("email", r"[\p{L}\p{N}._%+-]{1,256}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+"),
    ("secret", rf"(?=[0-9A-Fa-fgs]){_HEX}"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("phone", rf"\+\d{{1,3}}{_GAP}\(\d{{2,4}}\){_GAP}\d{{3,4}}{_GAP}\d{{3,4}}(?!\d)|(?<![.-])\(\d{{3}}\) ?\d{{3}}[-. ]\d{{4}}(?!\d)|\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}(?!\d)|(?<![.-])\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?![\d-])"),
    ("ssn", r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<!\.)(?=\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)|(?<!:)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"),
    ("card", _CARD),
    ("name", _NAMED),
]
#: First and last what may follow letters: named secrets and cards.
PATTERN = rf"{_NAMED_SECRET}|(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}+(._%-])(?:" + "|".join(f"(?:{p})" for _, p in KINDS) + rf")|(?<=\p{{L}})(?=\d){_CARD}"
#: The kind of what the pattern finds and a closer look lets go.
NONE = "none"
#: Texts with entities whose digests may be broadcast, some tens of MB.
HELD_ROWS = 100_000
#: Attempts in the length of a number before surrogates get longer.
REDRAWS = 4
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщыэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def kind_of(entity: Column) -> Column:
    """The kind of a found entity, from its own form."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(whole(_LED + _VALUE), "secret")
        .when(entity.contains("@"), "email")
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}") | whole(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"), "ip")
        .when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        # Digits in one row are a card only where they pass the card's own check.
        .when(whole(r"\d{13,19}"), F.when(_luhn(entity) == 0, "card").otherwise(NONE))
        .when(whole(r"\d(?:[ -]?\d){12,18}"), "card")
        .when(entity.rlike(r"^[+(]\d") | whole(r"\d{3}[-.]\d{3}[-.]\d{4}"), "phone")
        .when(whole(_NAMED), "name")
        .when(whole(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"), "iban")
        .otherwise("secret")
    )


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip"), F.lower(entity))
        .when(kind == "name", F.concat(_gender(entity), F.lit(":"), _untitled(entity)))
        .otherwise(F.regexp_replace(entity, f"^{_LED}", ""))
    )


def _untitled(name: Column) -> Column:
    return F.regexp_replace(name, rf"^(?:{_ALL_TITLES})\.? ", "")


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it; it keeps plans small too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: str, kind: Column, form: Column, attempt: Column, part: str = "") -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit(part), kind, form, attempt.cast("string")).cast("binary"), 256)


def _pick(letters: str, r: Column) -> Column:
    return F.substr(F.lit(letters), (r % len(letters) + 1).cast("int"), F.lit(1))


def _like(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """text with each letter and digit replaced by one of its sort, drawn by the digests of seed and a count: one for every
    21 characters, so that a text of any length has a stream that does not repeat."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 21).cast("int")), lambda k: F.sha2(F.concat_ws("\u001f", seed, k.cast("string")).cast("binary"), 256))
    return let(F.struct(text.alias("text"), blocks.alias("blocks")), lambda b: _drawn(b["text"], b["blocks"], hexadecimal))


def _drawn(text: Column, blocks: Column, hexadecimal: Column) -> Column:
    def drawn(c: Column, i: Column) -> Column:
        digits = F.substr(F.get(blocks, F.floor(i / 21).cast("int")), (i % 21 * 3 + 1).cast("int"), F.lit(3))
        return F.struct(c.alias("c"), F.conv(digits, 16, 10).cast("int").alias("r"))

    def one(x: Column) -> Column:
        c, r = x["c"], x["r"]
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", r))
            .when(hexadecimal & c.rlike("[A-F]"), _pick("0123456789ABCDEF", r))
            .when(c.rlike("[0-9]"), _pick("0123456789", r))
            .when(c.rlike("[a-z]"), _pick(_LOWER, r))
            .when(c.rlike("[A-Z]"), _pick(_UPPER, r))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), _pick(_CYRILLIC, r))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), _pick(_CYRILLIC.upper(), r))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), _pick(_GREEK, r))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), _pick(_GREEK.upper(), r))
            .when(c.rlike(r"\p{Lu}"), _pick("ÀÁÂÄÉÈÍÓÖÚÜÑ", r))
            .when(c.rlike(r"\p{Ll}"), _pick("àáâäéèíóöúüñ", r))
            .when(c.rlike(r"\p{N}"), _pick("0123456789", r))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.transform(F.split(text, ""), drawn), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def add(total: Column, c: Column) -> Column:
        d = c["d"].cast("int") * F.when(c["i"] % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    indexed = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(indexed, F.lit(0), add) % 10


def _gender(entity: Column) -> Column:
    def any_of(words: list[str]) -> Column:
        return entity.rlike(rf"^(?:{'|'.join(words)})(?![\p{{L}}])")

    male, female = (any_of([*TITLES[g], *GIVEN[g, "latin"], *GIVEN[g, "cyrillic"]]) for g in "mf")
    inner = F.when(entity.rlike(rf" (?:{'|'.join(GIVEN['f', 'latin'] + GIVEN['f', 'cyrillic'])})(?![\p{{L}}])"), "f").otherwise("m")
    return F.when(female, "f").when(male, "m").otherwise(inner)


def _name(form: Column, stream: Column, attempt: Column) -> Column:
    """A given name (where the form has two names) and a family name of its gender and script, a syllable longer with each
    attempt."""
    byte = lambda k: F.conv(F.substr(stream, (F.lit(2) * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    gender, cyrillic, two = F.substr(form, F.lit(1), F.lit(1)), form.rlike(r"\p{IsCyrillic}"), form.contains(" ")

    def of(g: str, script: str) -> Column:
        given = F.element_at(F.array(*map(F.lit, GIVEN[g, script])), byte(F.lit(0)) % len(GIVEN[g, script]) + 1)
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        parts = F.transform(F.sequence(F.lit(1), F.least(attempt + 4, F.lit(127))), lambda k: F.element_at(syllables, byte(k) % 16 + 1))
        family = F.concat(F.array_join(parts, ""), F.lit(ENDINGS.get((g, script), "")))
        return F.concat(F.when(two, F.concat(given, F.lit(" "))).otherwise(""), F.initcap(family))

    return (
        F.when(cyrillic & (gender == "f"), of("f", "cyrillic")).when(cyrillic, of("m", "cyrillic")).when(gender == "f", of("f", "latin")).otherwise(of("m", "latin"))
    )


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate of a canonical form. Later attempts have longer ones: names, addresses and secrets from
    the first on, numbers of a fixed length after REDRAWS of that length. So no set of entities uses all surrogates up."""
    stream = F.concat(*(_hash(key, kind, form, attempt, f"s{k}") for k in range(4)))
    bound = F.struct(
        kind.alias("kind"),
        form.alias("form"),
        attempt.cast("int").alias("attempt"),
        F.greatest(attempt.cast("int") - REDRAWS, F.lit(0)).alias("wider"),
        stream.alias("stream"),
        F.translate(stream, "abcdef", "012345").alias("decimal"),
        F.regexp_replace(form, r"\D", "").alias("digits"),
        form.rlike("^(?:[0-9a-f:]+|[0-9A-F]+)$").alias("hex"),
        F.when(form.startswith("+"), F.length(F.regexp_extract(form, r"^\+(1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 1))).otherwise(0).alias("country"),
    )
    return let(bound, lambda b: _surrogate(b, key))


def _card(b: Column) -> Column:
    digits, decimal = b["digits"], b["decimal"]
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.substr(decimal, F.lit(1), F.length(digits) - 2 + b["wider"]))
    check = lambda x: F.when(_luhn(digits) == 0, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")).otherwise(F.substr(decimal, F.lit(60), F.lit(1)))
    return let(body, lambda x: F.concat(x, check(x)))


def _surrogate(b: Column, key: str) -> Column:
    kind, form, stream, decimal, n = b["kind"], b["form"], b["stream"], b["decimal"], F.length(b["digits"])
    octet = lambda k, low, size: (F.conv(F.substr(stream, F.lit(4 * k + 1), F.lit(4)), 16, 10).cast("int") % size + low).cast("string")
    domain = F.substring_index(form, "@", -1)
    # The same domain is replaced alike in all addresses.
    of_domain = let(_hash(key, F.lit("domain"), domain, F.lit(0), "s0"), lambda s: _like(F.regexp_replace(domain, r"\.[^.]*$", ""), s, F.lit(False)))
    # What is replaced character by character, and what stands before it.
    before = F.when(kind == "iban", F.substr(form, F.lit(1), F.lit(2))).otherwise("")
    spelled = F.when(kind == "email", F.substring_index(form, "@", 1)).when(kind == "iban", F.substr(form, F.lit(3))).otherwise(form)
    longer = F.when(kind == "iban", F.repeat(F.lit("0"), b["wider"])).when(kind == "ip", F.repeat(F.lit("a"), b["wider"])).otherwise(F.repeat(F.when(form.rlike("^[0-9A-F]+$"), "A").otherwise("a"), b["attempt"]))
    like = F.concat(before, _like(F.concat(spelled, longer), F.substr(stream, F.lit(1), F.lit(64)), b["hex"] & kind.isin("ip", "secret")))
    return (
        F.when(kind == "card", _card(b))
        .when(kind == "phone", F.concat(F.substr(form, F.lit(1), F.when(form.startswith("+"), b["country"] + 1).otherwise(0)), F.substr(decimal, F.lit(1), n - b["country"] + b["wider"])))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(decimal, F.lit(1), b["wider"] + 8)))
        .when((kind == "ip") & form.contains("."), F.concat_ws(".", octet(0, 11, 200), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254), F.when(b["wider"] > 0, F.substr(decimal, F.lit(30), b["wider"]))))
        .when(kind == "name", _name(form, stream, b["attempt"]))
        .otherwise(F.concat(like, F.when(kind == "email", F.concat(F.lit("@"), of_domain, F.lit(".example"))).otherwise("")))
    )


def laid_out(kind: Column, entity: Column, other: Column) -> Column:
    """A surrogate's canonical form in the layout of the entity that it replaces."""

    def put(done: Column, c: Column) -> Column:
        take = c.rlike("[0-9A-Za-z]")
        return F.struct(
            (done["k"] + F.when(take, 1).otherwise(0)).alias("k"),
            F.concat(done["text"], F.when(take, F.substr(F.regexp_replace(other, r"^\+", ""), done["k"], F.lit(1))).otherwise(c)).alias("text"),
        )

    spread = F.aggregate(F.split(entity, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("text")), put, lambda done: F.concat(done["text"], F.substr(F.regexp_replace(other, r"^\+", ""), done["k"])))
    shouted = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    title = F.regexp_extract(entity, rf"^((?:{_ALL_TITLES})\.? )?", 1)
    called = F.when(_untitled(entity).contains(" "), other).otherwise(F.regexp_extract(other, r"\S+$", 0))
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), spread)
        .when(kind.isin("email", "ip"), F.when(shouted, F.upper(other)).otherwise(other))
        .when(kind == "name", F.concat(title, called))
        .when(kind == "secret", F.concat(F.regexp_extract(entity, f"^(?:{_LED})?", 0), other))
        .otherwise(other)
    )


def _classified(entity: Column) -> Column:
    known = F.struct(entity.alias("entity"), kind_of(entity).alias("kind"))
    return let(known, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), canonical(e["kind"], e["entity"]).alias("form")))


def collisions(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, form, attempt) of the distinct entities whose surrogate is not their first one."""
    now = scratch.table("try-0", entities.withColumn("attempt", F.lit(0)).withColumn("other", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)))
    real = entities.select("kind", F.col("form").alias("other"))
    for k in count(1):
        shared = now.groupBy("kind", "other").agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("first")).filter("n > 1").select("kind", "other", "first")
        taken = now.join(real, ["kind", "other"], "left_semi").select("kind", "form")
        late = now.join(shared, ["kind", "other"]).filter("form <> first").select("kind", "form")
        again = scratch.table(f"again-{k}", late.unionByName(taken).distinct().withColumn("again", F.lit(True)))
        if again.isEmpty():
            break
        moved = now.join(again, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        other = F.when(F.col("again"), surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)).otherwise(F.col("other"))
        now = scratch.table(f"try-{k}", moved.withColumn("other", other).drop("again"))
    return now.filter("attempt > 0").select("kind", "form", "attempt")


def _family(form: Column) -> Column:
    return F.regexp_extract(form, r"\S+$", 0)


def linked(found: Column) -> Column:
    """The entities of one text, where a person who is called by the family name alone is the first of that name and gender
    who is named in full."""
    full = F.filter(found, lambda m: (m["kind"] == "name") & m["form"].contains(" "))

    def one(m: Column, people: Column) -> Column:
        same = F.filter(people, lambda p: (F.substring(p["form"], 1, 2) == F.substring(m["form"], 1, 2)) & (_family(p["form"]) == F.substr(m["form"], F.lit(3))))
        form = F.when((m["kind"] == "name") & ~m["form"].contains(" "), F.coalesce(F.get(same, F.lit(0))["form"], m["form"])).otherwise(m["form"])
        return F.struct(m["entity"].alias("entity"), m["kind"].alias("kind"), form.alias("form"))

    return F.when(F.size(full) > 0, let(full, lambda people: F.transform(found, lambda m: one(m, people)))).otherwise(found)


def replaced(docs: DataFrame, key: str, held_rows: int = HELD_ROWS) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (sorted, distinct) for every row of docs; ``key`` is secret, from the
    caller's configuration.

    One pass of the pattern over all texts finds the mentions; only texts that have some are cut again. Texts with
    entities are joined by digest: broadcast where they were counted to be at most ``held_rows``, else merged.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    with Scratch(spark) as scratch:
        said = rows.select(digest.alias("digest"), F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("entity"))
        known = said.distinct().select("digest", _classified(F.col("entity")).alias("m")).select("digest", "m.kind", "m.form").filter(F.col("kind") != NONE)
        mentions = scratch.table("mentions", known.distinct())
        moved = collisions(mentions.select("kind", "form").distinct(), scratch, key)
        later = F.when(F.col("attempt").isNotNull(), F.struct(F.concat_ws("\u001f", "kind", "form"), "attempt"))
        held = settled(mentions.join(moved, ["kind", "form"], "left").groupBy("digest").agg(F.map_from_entries(F.collect_list(later)).alias("attempts")))
        few = held.limit(held_rows + 1).count() <= held_rows
    joined = rows.withColumn("digest", digest).join(F.broadcast(held) if few else held.hint("merge"), "digest", "left")
    nothing = F.array().cast("array<struct<entity:string,kind:string,form:string>>")
    found = F.when(F.col("attempts").isNotNull(), linked(F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), _classified))).otherwise(nothing)
    cut = joined.withColumn("found", found)

    def other_of(m: Column) -> Column:
        attempt = F.coalesce(F.element_at(F.col("attempts"), F.concat_ws("\u001f", m["kind"], m["form"])), F.lit(0))
        return surrogate(m["kind"], m["form"], attempt, key)

    def put(m: Column) -> Column:
        return F.when(m["kind"] == NONE, m["entity"]).otherwise(let(other_of(m), lambda other: laid_out(m["kind"], m["entity"], other)))

    # Between the entities, a family name that stands alone is that of the first person named in full with it.
    people = F.array_distinct(F.transform(F.filter("found", lambda m: (m["kind"] == "name") & m["form"].contains(" ")), lambda m: F.struct(_family(m["form"]).alias("family"), _family(other_of(m)).alias("other"))))
    bare = lambda gap, names: F.aggregate(names, gap, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), p["family"], F.lit(r"(?![\p{L}\p{N}])")), p["other"]))
    gaps = F.split(F.col("text"), PATTERN, -1)
    gaps = let(people, lambda names: F.when(F.size(names) > 0, F.transform(gaps, lambda g: bare(g, names))).otherwise(gaps))
    others = F.concat(F.transform("found", put), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, others, lambda g, o: F.concat(g, o)), "")
    kept = F.filter("found", lambda m: m["kind"] != NONE)
    return cut.select(
        "doc_id",
        F.when(F.col("attempts").isNotNull(), text).otherwise(F.col("text")).alias("text"),
        F.size(kept).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform(kept, lambda m: m["kind"]))).alias("kinds"),
    )
