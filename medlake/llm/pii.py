"""PII surrogates, with DataFrame and SQL functions only.

Entities (e-mail, phone, IPv4, SSN, payment card with a right check digit,
person name after a title) are found by one alternation of patterns and
replaced by keyed surrogates of the same type and format:

* digits stay digits at the same places (a phone keeps its country code, a
  card its first digit and gets a right check digit), an address
  becomes another address, an e-mail keeps the shape of its local part and
  moves to a reserved ``.example`` domain that depends on the old domain;
* a name is built from syllables of its own script (Latin, Cyrillic or Greek),
  word by word; its first word takes the ending of the gender its title shows,
  and letter case, spaces and hyphens stay.

Coreference: the surrogate is a function of key, type and *canonical* entity
(digits only, lower case ...), so one entity gets one surrogate everywhere, in
whatever format it is written.  A name of two words or more that a document
gives with a title is also found there without one.  A name without a sign of
gender ("Dr John Smith", "John Smith") is the person of that name whose title
shows one, if the corpus has a man or a woman of the name and not both.  A
surname alone needs a title.  Distinctness: ``collisions`` takes the distinct
entities of the whole corpus, and every entity whose surrogate is shared, or
is itself an entity of the corpus, gets another attempt until none is left.
Only those exceptions are joined back, to the rows that hold them.

Rows without an entity are never shuffled for the replacement.  Results for
odd input: null stays null with no entities; empty text stays empty; repeated
rows get equal results; extra columns are kept by ``replace_pii``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import landed, row_key, spare

#: Secret of the surrogates; production passes its own.
KEY = "medlake-surrogates"
#: Rounds in a row without a settled entity that show a value space to be full.
STALLED = 32

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES = {"f": ("Mrs", "Ms", "Miss", "Mme", "Frau", "Sra", "Señora", "Signora", "Госпожа", "Κυρία"),
          "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Signor", "Господин", "Κύριος"), "n": ("Dr", "Prof")}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
_PART = rf"{_WORD}(?:-{_WORD})*"
#: Names of two words or more that no title leads; the look-ahead finds overlapping ones.
BARE = rf"(?<!\p{{L}}|\p{{L}}['’-])(?<!(?<!\p{{L}})(?:{_TITLE})\.? )(?=({_PART} {_PART}|{_WORD}(?:-{_WORD})+)(?!\p{{L}}|['’-]\p{{Lu}}))"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
             r"|(?<![0-9+])\+[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9+])\+[0-9]{9,15}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_PART}(?: {_PART})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these cannot hold an entity.
GATE = rf"[0-9@]|(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}"
TYPES = tuple(PATTERNS)

#: Syllables by script, 16 each so that a hex digit picks one.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke la lo ma mi na ra sa to".split(),
    "cyrillic": "ба бе бо да де до ка ке ла ло ма ми на ра са то".split(),
    "greek": "βα βε βο δα δε δο κα κε λα λο μα μι να ρα σα το".split(),
}
#: Country calling codes of one and of two digits; all others have three.
CODES = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ENDINGS = {"latin": ("n", "na"), "cyrillic": ("н", "на"), "greek": ("ς", "να")}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum with every second digit doubled, counted from the right; ``odd`` is
    0 for a whole number and 1 for one whose check digit is still missing."""
    one = F.transform(F.reverse(F.split(digits, "")), lambda x, i: F.when(
        (i + odd) % 2 == 1, (x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(one, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def entity_type(match: Column) -> Column:
    """Type of one match; null where a check shows it is no entity."""
    card = match.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$")
    return (F.when(match.contains("@"), "email").when(match.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-"), "phone")
            .when(match.rlike(r"^[0-9]+\.[0-9]+\."), "ip").when(match.rlike(r"^[0-9]{3}-[0-9]{2}-"), "ssn")
            .when(card & (_luhn_sum(_digits(match), 0) % 10 == 0), "card")
            .when(card, F.lit(None).cast("string")).otherwise("name"))


def canonical(kind: Column, match: Column) -> Column:
    """What two spellings of one entity share.  A name keeps a gender mark."""
    title = F.regexp_extract(match, rf"^({_TITLE})", 1)
    mark = F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")
    name = F.lower(F.regexp_replace(match, rf"^(?:{_TITLE})\.? ", ""))
    digits = _digits(match)
    phone = F.when(match.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (F.when(kind == "email", F.lower(match)).when(kind == "ip", match)
            .when(kind == "name", F.concat(mark, F.lit(":"), name)).when(kind == "phone", phone).otherwise(digits))


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _stream(h: Column) -> Column:
    """36 decimal digits from a hex digest."""
    block = lambda a: F.substring(F.lpad(F.conv(F.substring(h, a, 15), 16, 10), 19, "0"), 2, 18)
    return F.concat(block(1), block(17))


def _letters(h: Column) -> Column:
    """Letters a-p, one for each hex digit."""
    return F.translate(h, "0123456789abcdef", "abcdefghijklmnop")


def _name_word(word: Column, h: Column, gender: Column, shift: int, last: Column, count: Column) -> Column:
    """A word from ``count`` syllables of the script of ``word``."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    hexes = F.split(F.substring(h, F.lit(shift), count), "")
    build = lambda s: F.concat(F.array_join(F.transform(hexes, lambda x: F.element_at(
        F.array(*[F.lit(v) for v in SYLLABLES[s]]), F.conv(x, 16, 10).cast("int") + 1)), ""),
        F.when(last, F.lit("")).when(gender == "f", ENDINGS[s][1]).when(gender == "m", ENDINGS[s][0]).otherwise(""))
    return F.when(script == "cyrillic", build("cyrillic")).when(script == "greek", build("greek")).otherwise(build("latin"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """Canonical surrogate of a canonical entity."""
    h = _hash(key, kind, canon, attempt)
    num = _stream(h)
    n = F.length(canon)
    byte = lambda i: F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int")
    ip = F.concat_ws(".", byte(0) % 223 + 1, byte(1), byte(2), byte(3) % 254 + 1)
    body = F.concat(F.substring(canon, 1, 1), F.substring(num, 1, 14))
    check = (F.lit(10) - _luhn_sum(body, 1) % 10) % 10
    card = F.concat(body, check.cast("string"))
    code = F.length(F.regexp_extract(canon, CODES, 0))
    lead = F.when(~canon.startswith("+"), 0).when(code > 0, code).otherwise(4)
    phone = F.concat(F.substring(canon, F.lit(1), lead), F.substring(num, F.lit(1), n - lead))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    letters, dh = _letters(F.concat(h, h)), _hash(key, F.lit("domain"), domain)
    shaped = F.array_join(F.transform(F.split(F.substring(local, 1, 64), ""), lambda x, i: F.when(
        x.rlike("[a-z]"), F.substring(letters, i + 1, F.lit(1))).when(
        x.rlike("[0-9]"), F.substring(num, i % 36 + 1, F.lit(1))).otherwise(x)), "")
    # short local parts may run out of room: later attempts grow
    shaped = F.when(attempt >= 2, F.concat(shaped, F.substring(letters, F.lit(65), attempt))).otherwise(shaped)
    email = F.concat(shaped, F.lit("@"), F.substring(_letters(dh), 1, 6), F.lit(".example."),
                     F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")),
                                  F.conv(F.substring(dh, 20, 2), 16, 10).cast("int") % 3 + 1))
    gender, words = F.substring(canon, 1, 1), F.split(F.substring(canon, F.lit(3), n), "[ -]")
    # the first word carries the gender; five syllables have 16^5 values: later attempts grow
    count = F.lit(5) + F.greatest(attempt - 1, F.lit(0))
    name = F.concat(gender, F.lit(":"), F.array_join(F.transform(words, lambda w, i: _name_word(
        w, F.when(i == 0, h).otherwise(_hash(key, h, i)), gender, 1, i > 0, count)), " "))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "name", name)
            .when(kind == "phone", phone).otherwise(F.substring(num, F.lit(1), n)))


def written(kind: Column, match: Column, canon_surrogate: Column) -> Column:
    """The surrogate in the format of the match."""
    digits = _digits(canon_surrogate)
    laid = F.array_join(F.transform(F.split(match, ""), lambda x, i: F.when(
        x.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(match, F.lit(1), i))) + 1, F.lit(1)))
        .otherwise(x)), "")
    title = F.regexp_extract(match, rf"^((?:{_TITLE})\.? )", 1)
    old = F.substring(match, F.length(title) + 1, F.length(match))
    name = F.substring(canon_surrogate, F.lit(3), F.length(canon_surrogate))
    name = F.when(old == F.upper(old), F.upper(name)).otherwise(F.initcap(name))
    between = F.regexp_extract_all(old, F.lit("[ -]"), F.lit(0))
    name = F.array_join(F.transform(F.split(name, " "), lambda w, i: F.concat(
        F.when(i == 0, "").otherwise(F.coalesce(F.get(between, i - 1), F.lit(" "))), w)), "")
    return (F.when(kind.isin("email", "ip"), canon_surrogate).when(kind == "name", F.concat(title, name)).otherwise(laid))


def _entities(matches: Column) -> Column:
    """Array of (type, match, canon) for an array of matches."""
    def one(m: Column) -> Column:
        kind = entity_type(m)
        return F.struct(kind.alias("type"), m.alias("match"), canonical(kind, m).alias("canon"))
    return F.transform(matches, one)


def _bare_pattern(text: Column, entities: Column) -> Column:
    """``ANY`` and the spellings under which the text holds its own titled names
    without a title; null if there are none."""
    told = F.transform(F.filter(entities, lambda e: (e["type"] == "name") & F.substring(e["canon"], 3, 1 << 30).rlike("[ -]")),
                       lambda e: F.substring(e["canon"], 3, 1 << 30))
    spelt = F.array_distinct(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)))
    # array_intersect hashes: no product of names and spellings
    mine = F.array_intersect(told, F.transform(spelt, F.lower))
    held = F.filter(spelt, lambda w: F.array_contains(mine, F.lower(w)))
    return F.when(F.size(told) > 0, F.when(F.size(mine) > 0, F.concat(
        F.lit(ANY + r"|(?<!\p{L}|\p{L}['’-])(?:"), F.array_join(held, "|"), F.lit(r")(?!\p{L}|['’-]\p{Lu})"))))


def detect(docs: DataFrame, text_col: str = "text", out: str = "entities", pattern: str = "pattern") -> DataFrame:
    """Adds ``out``, the entities in order (null types are false alarms; null
    where the text cannot hold one), and ``pattern``, what the text was
    searched for if it holds titled names without their title as well."""
    text = F.col(f"`{text_col}`").cast("string")
    first = docs.withColumn(out, F.when(text.rlike(GATE), _entities(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))))
    more = first.withColumn(pattern, F.when(F.size(out) > 0, _bare_pattern(text, F.col(out))))
    return more.withColumn(out, F.when(F.col(pattern).isNull(), F.col(out)).otherwise(
        _entities(F.regexp_extract_all(text, F.col(pattern), F.lit(0)))))


def _plain(kind: Column, canon: Column) -> Column:
    """What two surrogates must not share: a name's gender mark is not written."""
    return F.when(kind == "name", F.substring(canon, 3, 1 << 30)).otherwise(canon)


def collisions(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, canon, attempt) of the distinct ``entities`` (type, canon) that
    cannot use attempt 0.  Every round keeps the smallest of those that share
    a surrogate; the others, and whatever equals a real entity or an earlier
    surrogate, go on to the next attempt.  Rounds go on until all are settled;
    only a space of values that is full raises."""
    real = landed(entities.distinct(), "entities")
    taken = None
    # none yet; createDataFrame([]) would start Python workers for no rows, and a daemon that stays
    out = real.select("type", "canon", F.lit(0).alias("attempt")).filter("false")
    todo, left, stalled = real, None, 0
    for attempt in itertools.count():
        kind = F.col("type")
        tried = todo.withColumn("sur", _plain(kind, surrogate(kind, F.col("canon"), F.lit(attempt), key)))
        used = real.select("type", _plain(kind, F.col("canon")).alias("sur"))
        used = used if taken is None else used.union(taken)
        free = tried.join(used, ["type", "sur"], "left_anti")
        won = landed(free.groupBy("type", "sur").agg(F.min("canon").alias("canon")), f"surrogates{attempt}")
        if attempt:
            out = out.union(won.select("type", "canon", F.lit(attempt).alias("attempt")))
        todo = landed(todo.join(won, ["type", "canon"], "left_anti"), f"open{attempt}")
        taken = won.select("type", "sur") if taken is None else taken.union(won.select("type", "sur"))
        before, left = left, todo.count()
        if not left:
            return out
        stalled = stalled + 1 if left == before else 0
        if stalled >= STALLED:
            raise RuntimeError(f"{left} entities, and no surrogate free in {STALLED} rounds")


def same_people(entities: DataFrame) -> DataFrame:
    """(type, canon, alias): names without a sign of gender, and the one person
    of that name whose title shows it."""
    names = entities.filter("type = 'name'").select(F.substring("canon", 1, 1).alias("mark"), F.substring("canon", 3, 1 << 30).alias("base"))
    seen = names.groupBy("base").agg(*[F.max(F.col("mark") == m).alias(m) for m in "mfn"])
    return seen.filter("n and m <> f").select(
        F.lit("name").alias("type"), F.concat(F.lit("n:"), "base").alias("canon"),
        F.concat(F.when(F.col("m"), "m:").otherwise("f:"), "base").alias("alias"))


def exceptions(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, canon, alias, attempt) of the entities whose surrogate is not that
    of their own canonical form at attempt 0."""
    real = landed(entities.distinct(), "found")
    alias = landed(same_people(real), "aliases")
    again = landed(collisions(real.join(alias, ["type", "canon"], "left_anti"), key), "attempts")
    led = alias.join(again.withColumnRenamed("canon", "alias"), ["type", "alias"], "left").select(
        "type", "canon", "alias", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return led.union(again.select("type", "canon", F.col("canon").alias("alias"), "attempt"))


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = KEY, types_col: str = "pii_types") -> DataFrame:
    """All columns of ``docs`` with the text's entities replaced, and
    ``types_col``, the types of the replaced entities in order (it takes the
    place of a column of that name)."""
    docs = docs.drop(types_col)
    names = docs.columns
    ents, rk, tried, pat = (spare(docs, n) for n in ("_llm_entities", "_llm_rk", "_llm_tries", "_llm_pattern"))
    text = F.col(f"`{text_col}`").cast("string")
    found = detect(docs, text_col, ents, pat)
    each = (detect(docs.select(text.alias("t")), "t").select(F.explode("entities").alias("e"))
            .filter("e.type is not null").select("e.type", "e.canon"))
    moved = landed(exceptions(each, key), "exceptions")
    some = F.size(F.coalesce(F.col(ents), F.array())) > 0

    def assembled(df: DataFrame, chosen) -> DataFrame:
        pieces = F.when(F.col(pat).isNull(), F.split(text, ANY, -1)).otherwise(F.split(text, F.col(pat), -1))
        subs = F.transform(ents, lambda e: F.when(e["type"].isNull(), e["match"]).otherwise(
            written(e["type"], e["match"], surrogate(e["type"], *chosen(e), key))))
        woven = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(ents)), subs, lambda p, s: F.concat(p, s)), ""),
                         F.element_at(pieces, -1))
        kinds = F.filter(F.transform(ents, lambda e: e["type"]), lambda t: t.isNotNull())
        # F.when keeps texts without entities out of the expensive branch
        return df.select(*[F.when(some, woven).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
                         F.coalesce(F.when(some, kinds), F.array().cast("array<string>")).alias(types_col))

    if moved.isEmpty():
        return assembled(found, lambda e: (e["canon"], F.lit(0)))
    # only rows that hold an exception take its person and attempt along
    keyed = found.withColumn(rk, row_key(names[0], text_col))
    tag = lambda e: F.concat(e["type"], F.lit("|"), e["canon"])
    holders = (keyed.filter(some).select(rk, F.explode(ents).alias("e")).select(rk, "e.type", "e.canon").distinct()
               .join(moved, ["type", "canon"])
               .groupBy(rk).agg(F.map_from_entries(F.collect_list(F.struct(
                   F.concat("type", F.lit("|"), "canon"), F.struct("alias", "attempt")))).alias(tried)))
    plain = assembled(keyed.filter(~some), lambda e: (e["canon"], F.lit(0)))

    def moved_to(e):
        to = F.element_at(tried, tag(e))
        return F.coalesce(to["alias"], e["canon"]), F.coalesce(to["attempt"], F.lit(0))

    return plain.union(assembled(keyed.filter(some).join(holders, rk, "left"), moved_to))


def pii_report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per document: its text with surrogates, and how many of each type."""
    out = replace_pii(docs.select("doc_id", "text"), "text", key)
    count = [(F.size("pii_types") - F.size(F.array_remove("pii_types", k))).cast("long").alias(f"n_{k}") for k in TYPES]
    return out.select("doc_id", "text", F.size("pii_types").cast("long").alias("n_entities"), *count)


def drop_pii(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The documents with surrogates in their texts, columns unchanged."""
    types = spare(docs, "_llm_types")
    return replace_pii(docs, text_col, key, types).drop(types)
