"""Surrogates for personal data and secrets: keyed, type-consistent, distinct; DataFrame functions only.

``ENTITIES`` finds e-mail addresses, phone, card and social-security numbers, IBANs, IP addresses, access keys, secrets after
``password=`` and the like, and names after a title; the words of a name so found are replaced wherever else they stand in the
same text. Each match is rewritten in its own shape: digit for digit, letter for letter of the same case, punctuation kept; IP
octets stay in range, card numbers keep their check digit, an e-mail's domain has a surrogate of its own. Each word of a name
has one made-up word of its own script, case and gender, whatever title stands before it, so that a surname alone, with a
given name and after another title agree. Gender comes from the word: a listed given name, or its ending.

What replaces an entity depends on a secret key (HMAC-SHA-512) and on the entity's canonical form alone (case and punctuation
apart), so the same entity has the same surrogate everywhere. Collision check: over all distinct entities (of names, words), a
surrogate that another has too, or that is itself a real one, is drawn again with the next attempt number until none is left.
Each attempt makes names longer by a syllable and every second one mailboxes by a letter, so they can't run out; where another
kind of entity has no free surrogate after ``most`` attempts, an error says so. Attempts other than 0 are few; they are joined
to the documents that hold such an entity.

The key is a parameter. Like everything in a plan it stands in event logs, which are as secret as the key.

Scale: texts are rewritten in one map without a shuffle; what is shuffled is the distinct entities, aggregated before. No
pattern backtracks or recurses without a bound, so long runs of any sign are harmless; an address has at most 256 signs before the @ and 127 labels after it.

Left out: names that no title introduces anywhere in the text, scripts other than those in ``SYLLABLES``, and ties between a
name and a mailbox that is made of it.

Edge cases: null texts stay null, empty ones empty; texts without an entity are returned unchanged; repeated rows are
rewritten alike; an empty table gives an empty result; ``replace`` carries other columns along and renames its own on a clash.
"""

from __future__ import annotations

import hashlib
import re
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import fresh, small, table, written

#: Titles by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Госпожа", "Г-жа")
MALE = ("Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Господин", "Г-н")
NEUTRAL = ("Dr", "Prof", "Mx")
TITLES = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=lambda t: (-len(t), t)))

#: A word of a name, in a script with capitals, in Chinese, or in another script without capitals.
NAME = r"(?=[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}])\p{Lu}[\p{L}'’\-]+|\p{IsHan}{2,4}|[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}&&\p{L}][\p{L}\p{M}'’\-]+"

#: What each kind of entity looks like, in order of precedence.
ENTITIES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,256}+@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.){1,127}[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api[_\-]?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_\-]{8,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){3,4}(?![0-9])|(?<![0-9A-Za-z.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? (?:{NAME})(?: (?:{NAME}))?",
}
ANY = "|".join(f"(?:{p})" for p in ENTITIES.values())
#: A text without any of these has no entity; cheaper to look for than the entities themselves.
HINT = rf"[@0-9]|(?i:password|passwd|pwd|token|secret|api[_\-]?key)|(?<!\p{{L}})(?:{TITLES})\.? \p{{L}}"

#: Syllables that names are made of, by script, and how many a name has at first.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we za ze".split(),
    "cyrillic": "ба бе бо ва ве да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то фа хо ча ша".split(),
    "greek": "βα βε γα γε δα δε ζα ζε θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα φε χα χε".split(),
    "han": list("安白冰晨成春丹东方飞风刚光海涵浩恒华佳健江杰金静军凯兰乐雷力丽亮林玲龙梅明宁鹏平青晴荣瑞山诗松涛文霞祥晓欣雪雅阳宜永雨云泽志子"),
    "hangul": list("가강건경고광구규기나남노다대도동두라령로리마만명모무미민바백범병보봉사상서선성소수숙순승시신아안양연영예오용우원유윤은의이인일자장재정제조종주준지진찬창채천철춘태하한해혁현형혜호홍화효훈희"),
    "kana": "あい あき うめ えり かな かず きく けん こと さち しん すみ せい たか ちか つき てつ とも なお はる ひで ふみ まさ みな もと やす ゆき よし りつ れん".split(),
    "arabic": "با بي بو تا دا دي را ري سا سي شا طا عا فا في قا كا كي لا لي ما مي نا ني ها وا يا".split(),
    "hebrew": "בא בי גא גי דא די הא זי חא טל כא לא לי מא מי נא ני סא עד פי צי קא רא רי שא שי תא תי".split(),
    "devanagari": "का की गा चा जा जी ता ती दा दे ना नी पा बा भा मा मी या रा री ला ली वा वी शा सा सी हा".split(),
}
SCRIPTS = {
    "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]",
    "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}",
}
LENGTHS = {"han": 2, "hangul": 2, "kana": 2}
#: Endings by script and gender; scripts that are not listed have none.
ENDINGS = {
    "latin f": ["lina", "nelle", "ria", "ssa"], "latin m": ["rdo", "nus", "lbert", "sten"], "latin n": ["ren", "ly", "x", "ris"],
    "cyrillic f": ["нова", "рина", "лева", "ская"], "cyrillic m": ["нов", "рин", "лев", "ский"], "cyrillic n": ["ко", "енко", "дзе", "ян"],
    "greek f": ["νου", "ρία", "λίνα", "δου"], "greek m": ["νος", "δης", "κης", "ρας"], "greek n": ["ρη", "λη", "νη", "τη"],
}
#: Common given names by gender; other words go by their endings.
GIVEN = {
    "f": "mary patricia jennifer elizabeth susan karen sarah nancy margaret emily helen ruth jane alice anne marie claire sophie chantal ingrid ursula heike petra carmen pilar dolores isabel",
    "m": "james john robert michael william david richard joseph thomas charles peter paul mark george kevin hans klaus wolfgang jürgen pierre jean jacques michel josé juan carlos luis miguel joshua luca noah никита илья",
}
FEMALE_ENDINGS, MALE_ENDINGS = r"(?:[aα]|[ая]|ου)$", r"(?:ов|ев|ёв|ин|ын|ский|цкий|ος|ης|ας)$"
MOST = 20


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(ENTITIES.items())[:-1]):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{_bare(pattern)})$")), kind).otherwise(out)
    return out


def _bare(pattern: str) -> str:
    """A pattern without its look-behinds, for a whole entity."""
    return re.sub(r"\(\?<!(?:\[[^\]]*\]|\\p\{L\})\)", "", pattern)


def words_of(name: Column) -> Column:
    """The words of a name, less its title."""
    return F.split(F.regexp_replace(name, rf"^(?:{TITLES})\.? ", ""), " ")


def script_of(word: Column) -> Column:
    out = F.lit("latin")
    for script, pattern in SCRIPTS.items():
        out = F.when(F.regexp_like(word, F.lit(f"^{pattern}")), script).otherwise(out)
    return out


def gender_of(word: Column) -> Column:
    low = F.lower(word)
    listed = [F.when(low.isin(names.split()), g) for g, names in GIVEN.items()]
    return F.coalesce(*listed, F.when(F.regexp_like(low, F.lit(MALE_ENDINGS)), "m").when(F.regexp_like(low, F.lit(FEMALE_ENDINGS)), "f"), F.lit("n"))


def canonical(kind: Column, entity: Column) -> Column:
    """What the entity is, case and punctuation apart, as an array: of a secret the value, of a name its words, each with its script."""
    plain = F.lower(F.regexp_replace(entity, "[^A-Za-z0-9]", ""))
    value = F.lower(F.regexp_extract(entity, r"([A-Za-z0-9+/_\-]{8,})$", 1))
    name = F.transform(words_of(entity), lambda w: F.concat_ws(" ", script_of(w), F.lower(w)))
    other = F.when(kind == "email", F.lower(entity)).when(kind == "secret", value).when(kind == "ip", entity).otherwise(plain)
    return F.when(kind == "name", name).otherwise(F.array(other))


class Keyed:
    """Numbers drawn from a key, what is replaced, and an attempt. ``hexes`` under 128 weakens them, for tests of collisions."""

    def __init__(self, key: str, hexes: int = 128):
        key = key.encode()
        key = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
        self.inner, self.outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
        self.hexes = hexes

    def hash(self, *parts: Column) -> Column:
        """HMAC-SHA-512 of the parts, in hexadecimal digits."""
        inside = F.sha2(F.concat(self.inner, F.concat_ws("\x1f", *parts).cast("binary")), 512)
        h = F.sha2(F.concat(self.outer, F.unhex(inside)), 512)
        return h if self.hexes >= 128 else F.sha2(F.substring(h, 1, self.hexes).cast("binary"), 512)

    @staticmethod
    def number(h: Column, k: Column, width: int = 2) -> Column:
        """The ``k``-th number of a hash (from 0, going round)."""
        at = (F.pmod(k, F.lit(128 // width)) * width + 1).cast("int")
        return F.conv(F.substr(h, at, F.lit(width)), 16, 10).cast("int")


def shaped(text: Column, h: Column, keep: Column | None = None, hexadecimal: Column | None = None) -> Column:
    """``text`` with each letter and digit after the first ``keep`` of them redrawn: same kind, same case; the rest as it is."""
    keep = F.lit(0) if keep is None else keep
    span = F.lit(26) if hexadecimal is None else F.when(hexadecimal, 6).otherwise(26)

    def drawn(c: Column, k: Column) -> Column:
        n = Keyed.number(h, k)
        new = F.when(c.between("0", "9"), F.char(48 + n % 10)).when(c.between("a", "z"), F.char(97 + n % span)).otherwise(F.char(65 + n % span))
        return F.when(k < keep, c).otherwise(new)

    new = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]"), F.lit(0)), drawn)
    return F.array_join(F.zip_with(F.split(text, "[A-Za-z0-9]", -1), F.concat(new, F.array(F.lit(""))), lambda gap, c: F.concat(gap, c)), "")


def luhn_rest(digits: Column) -> Column:
    """Check sum modulo 10 of a card number's digits; 0 if it is valid."""
    d = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    two = F.transform(d, lambda x, i: F.when((F.size(d) - i) % 2 == 0, F.when(2 * x > 9, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(two, F.lit(0), lambda a, x: a + x) % 10


def _cased(made: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(made)).otherwise(F.initcap(made))


def _parts(x: Column) -> Column:
    """An entity cut into what stays before, what is redrawn (from its ``keep``-th letter or digit on), and what stays behind."""
    kind, e, extra = x["kind"], x["e"], F.floor(x["n"][0] / 2).cast("int")
    mailbox = F.concat(F.substring_index(e, "@", 1), F.repeat(F.lit("a"), extra))
    value = F.when(kind == "secret", F.regexp_extract(e, r"([A-Za-z0-9+/_\-]{8,})$", 1)).when(kind == "email", mailbox).when(kind == "name", F.lit("")).otherwise(e)
    keep = F.when(kind == "phone", F.length(F.regexp_extract(e, r"^\+([0-9]{1,3})", 1))).when(kind == "iban", 2).when(kind == "access_key", 4).otherwise(0)
    title = F.when(kind == "name", F.regexp_extract(e, rf"^(?:{TITLES})\.? ", 0)).otherwise("")
    domain = F.when(kind == "email", F.substring_index(e, "@", -1)).otherwise("")
    return F.struct(value.alias("value"), keep.alias("keep"), title.alias("title"), domain.alias("domain"))


def _drawn(x: Column, keyed: Keyed) -> Column:
    """The hashes for an entity (of a name, for each word) and its domain, by attempt."""
    own = F.zip_with(x["canon"], x["n"], lambda c, n: keyed.hash(x["kind"], c, n.cast("string")))
    domain = F.when(x["part"]["domain"] != "", keyed.hash(F.lit("domain"), F.lower(x["part"]["domain"]), x["n"][0].cast("string")))
    return F.struct(own.alias("own"), domain.alias("domain"))


def _name(words: Column, hashes: Column, attempts: Column) -> Column:
    """Made-up words, each by its own hash and one syllable longer with each attempt."""
    syllables = F.create_map(*[c for s, x in SYLLABLES.items() for c in (F.lit(s), F.array(*map(F.lit, x)))])
    endings = F.create_map(*[c for s, x in ENDINGS.items() for c in (F.lit(s), F.array(*map(F.lit, x)))])
    lengths = F.create_map(*[c for s in SYLLABLES for c in (F.lit(s), F.lit(LENGTHS.get(s, 3)))])

    def made(x: Column) -> Column:
        w, h, script = x["words"], x["h"], script_of(x["words"])
        list_ = F.element_at(syllables, script)
        places = F.sequence(F.lit(1), F.element_at(lengths, script) + x["n"])
        stem = F.transform(places, lambda k: F.element_at(list_, (Keyed.number(h, k, 4) % F.size(list_) + 1).cast("int")))
        ends = F.try_element_at(endings, F.concat_ws(" ", script, gender_of(w)))
        end = F.when(ends.isNull(), "").otherwise(F.element_at(ends, (Keyed.number(h, F.lit(0), 4) % 4 + 1).cast("int")))
        return _cased(F.concat(F.array_join(stem, ""), end), w)

    return F.array_join(F.transform(F.arrays_zip(words.alias("words"), hashes.alias("h"), attempts.alias("n")), made), " ")


def _made(x: Column) -> Column:
    """The surrogate, from parts and hashes, but for a card's check digit."""
    kind, part, h = x["kind"], x["part"], F.get(x["h"]["own"], F.lit(0))
    octets = F.transform(F.array(*map(F.lit, range(4))), lambda k: F.when(k == 0, Keyed.number(h, k, 4) % 223 + 1).otherwise(Keyed.number(h, k, 4) % 256).cast("string"))
    body = shaped(part["value"], h, part["keep"], (kind == "secret") & F.regexp_like(part["value"], F.lit("^[0-9a-fA-F]+$")))
    head = F.substr(x["e"], F.lit(1), F.length(x["e"]) - F.length(part["value"]))
    host, tld = F.regexp_extract(part["domain"], r"^(.*)\.[^.]*$", 1), F.regexp_extract(part["domain"], r"(\.[^.]*)$", 1)
    words = F.split(F.substr(x["e"], F.length(part["title"]) + 1), " ")
    return (
        F.when(kind == "email", F.concat(body, F.lit("@"), shaped(host, x["h"]["domain"]), tld))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "name", F.concat(part["title"], _name(words, x["h"]["own"], x["n"])))
        .when(kind == "secret", F.concat(head, body))
        .otherwise(body)
    )


def _checked(x: Column) -> Column:
    """A card number that was valid gets a valid check digit."""
    digits = F.regexp_replace(x["made"], "[^0-9]", "")
    last = F.pmod(F.right(x["made"], F.lit(1)).try_cast("int") - luhn_rest(digits), F.lit(10)).cast("string")
    mended = F.concat(F.substr(x["made"], F.lit(1), F.length(x["made"]) - 1), last)
    valid = (x["kind"] == "card") & (luhn_rest(F.regexp_replace(x["e"], "[^0-9]", "")) == 0)
    return F.when(valid, mended).otherwise(x["made"])


def surrogates(found: str, attempt, keyed: Keyed, frame: DataFrame) -> DataFrame:
    """``frame`` with the array of entities ``found`` (kind, canon, e) replaced by the array of their surrogates.

    Step by step, so that no step repeats the expressions of the one before; ``attempt`` says which draw each part of an
    entity's canonical form is at.
    """
    kept = ["kind", "canon", "e", "n", "part", "h"]

    def more(name: str, of, fields: int) -> None:
        nonlocal frame
        frame = frame.withColumn(found, F.transform(found, lambda x: F.struct(*[x[k].alias(k) for k in kept[:fields]], of(x).alias(name))))

    more("n", lambda x: F.transform(x["canon"], lambda c: attempt(x["kind"], c).cast("int")), 3)
    more("part", _parts, 4)
    more("h", lambda x: _drawn(x, keyed), 5)
    frame = frame.withColumn(found, F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["e"].alias("e"), _made(x).alias("made"))))
    return frame.withColumn(found, F.transform(found, _checked))


def found_in(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with _pattern, what the text's entities look like, the words of its titled names included, and _found, all of them
    in order as (kind, canon, e); null if there is none."""
    titled = F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ENTITIES["name"]), F.lit(0)))
    words = F.array_distinct(F.flatten(F.transform(titled, words_of)))
    docs = docs.withColumn("_names", F.array_join(F.reverse(F.array_sort(words)), "|"))  # longer words before their beginnings
    known = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.col("_names"), F.lit(")(?: (?:"), F.col("_names"), F.lit(r"))?(?![\p{L}'’\-])"))
    docs = docs.withColumn("_pattern", F.when(F.col("_names") != "", known).otherwise(ANY))
    found = F.nullif(F.regexp_extract_all(text, F.col("_pattern"), F.lit(0)), F.array().cast("array<string>"))
    docs = docs.withColumn("_found", F.when(F.regexp_like(text, F.lit(HINT)), found))
    docs = docs.withColumn("_found", F.transform("_found", lambda e: F.struct(kind_of(e).alias("kind"), e.alias("e"))))
    return docs.withColumn("_found", F.transform("_found", lambda x: F.struct(x["kind"].alias("kind"), canonical(x["kind"], x["e"]).alias("canon"), x["e"].alias("e"))))


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon, form) of every distinct entity, of names of every word; form is the smallest way it is written."""
    t = F.col(f"`{text}`")
    found = found_in(docs.select(t), t).select(F.explode("_found").alias("x")).select("x.kind", "x.canon", "x.e")
    forms = F.when(F.col("kind") == "name", words_of(F.col("e"))).otherwise(F.array("e"))
    found = found.select("kind", F.explode(F.arrays_zip("canon", forms.alias("form"))).alias("x")).select("kind", "x.canon", "x.form")
    return found.groupBy("kind", "canon").agg(F.min("form").alias("form"))


def attempts(entities: DataFrame, keyed: Keyed, most: int = MOST) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogates collide with others' or with real entities."""
    redrawn = entities.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)
    real = entities.select("kind", F.col("canon").alias("made")).withColumn("real", F.lit(True))
    for _ in range(most):
        tried = entities.join(redrawn, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        tried = tried.withColumn("made", F.array(F.struct("kind", F.array("canon").alias("canon"), F.col("form").alias("e"))))
        made = written(surrogates("made", lambda kind, c: F.col("attempt"), keyed, tried).withColumn("made", F.element_at("made", 1)))
        made = made.withColumn("made", F.element_at(canonical(F.col("kind"), F.col("made")), 1))
        # the entity with the lowest attempt, then smallest, keeps a surrogate that several share; nobody keeps a real one
        owner = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count(F.lit(1)).alias("n"))
        clash = owner.join(real, ["kind", "made"], "left").filter((F.col("n") > 1) | F.col("real")).select("kind", "made", "owner", "real")
        bad = made.join(clash, ["kind", "made"]).filter(F.col("real") | (F.col("owner.canon") != F.col("canon"))).select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        bad = written(bad)
        if bad.isEmpty():
            return redrawn
        redrawn = written(redrawn.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(bad))
    kinds = sorted(r["kind"] for r in bad.select("kind").distinct().collect())
    raise RuntimeError(f"after {most} attempts some entities have no surrogate of their own: {', '.join(kinds)}")


def replace(docs: DataFrame, *, key: str, text: str = "text", hexes: int = 128, most: int = MOST) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and n_entities and kinds (distinct, sorted, comma-joined)."""
    keyed, t = Keyed(key, hexes), F.col(f"`{text}`")
    names = [fresh(x, docs.columns) for x in ("n_entities", "kinds")]
    again = attempts(written(distinct_entities(docs, text)), keyed, most)
    out = found_in(docs, t)
    tag = lambda kind, canon: F.concat_ws("\x1f", kind, canon)
    if again.isEmpty():
        out = out.withColumn("_again", F.lit(None).cast("map<string,int>"))
    else:
        row = F.xxhash64(t)
        held = out.select(row.alias("_row"), F.explode("_found").alias("x")).select("_row", "x.kind", F.explode("x.canon").alias("canon")).distinct()
        held = held.join(small(again, again.count()), ["kind", "canon"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(tag("kind", "canon"), "attempt"))).alias("_again"))
        held = written(held)
        out = out.withColumn("_row", row).join(small(held, held.count()), "_row", "left")
    out = out.withColumn("_made", F.col("_found"))
    out = surrogates("_made", lambda kind, c: F.coalesce(F.try_element_at("_again", tag(kind, c)), F.lit(0)), keyed, out)
    pieces = F.zip_with(F.split(t, F.col("_pattern"), -1), F.concat("_made", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return out.select(
        *[F.when(F.col("_found").isNull(), t).otherwise(F.array_join(pieces, "")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size("_found"), F.lit(0)).alias(names[0]),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["kind"]))), ","), F.lit("")).alias(names[1]),
    )


#: Where a session keeps the key of its surrogates.
KEY = "spark.duewise.surrogates.key"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced, by the session's key or one drawn for this run."""
    key = spark.conf.get(KEY, None) or secrets.token_hex(64)
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
