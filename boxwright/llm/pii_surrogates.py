"""Personal data replaced by surrogates of the same kind and format.

Detected entities are reduced to a normal form (digits of a number, lower case
of an address, one token of a name).  A keyed hash of the normal form gives the
surrogate, so all mentions of an entity get the same one, in the format in
which each is written: lengths, separators, case, country codes and issuer
digits, the check digits of cards and IBANs, and for names script and gender
are kept; addresses of one domain get one domain.  A name is
found behind a title; its tokens are then found without one in the same text,
and a title that tells no gender takes it from other mentions of the given
name.  Surrogates
are checked over the whole corpus: one that equals a real entity or the
surrogate of another one is drawn anew, until all are distinct.

Everything is a DataFrame expression.  Mentions and entities are shuffled;
texts are only where they hold an entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.shared import let, materialise, packed, small

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "name")
#: From this attempt on, addresses may get longer and the parts of an IP address any length.
WIDEN = 6
#: Given names up to this number are sent to all executors, more are joined by shuffle.
BROADCAST_NAMES = 100_000

# Titles and given names by gender, surname syllables by script.
MALE, FEMALE, EITHER = "Mr|Herr|Señor|Monsieur|Господин", "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Mlle|Госпожа", "Dr|Prof"
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Emil Felix Gustav Henry Ivan Jonas Karl Leo Martin Noah Oscar Paul Robert Simon Thomas Victor",
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera",
    ("latin", "x"): "Alex Ariel Chris Dana Eden Jamie Jordan Kim Lee Logan Morgan Noel Parker Quinn Robin Sam Sasha Sky Terry Toni",
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур",
    ("cyrillic", "f"): "Анна Валентина Галина Дарья Елена Жанна Ирина Карина Лидия Мария Надежда Ольга Полина Раиса Софья Татьяна",
    ("cyrillic", "x"): "Саша Женя Валя Слава",
}
SYLLABLES = {"latin": "ba ben da del fa gor ha hol ka kel la len ma mon na nor pa pel ra rin sa sol ta ten va vor wa win za zen", "cyrillic": "ба бе ва ве га да де ка ко ла ле ма мо на но па по ра ро са со та то ша"}

# Country codes of telephone numbers of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"

_EDGE = "(?![A-Za-z0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERN = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}",
    rf"(?<![A-Za-z0-9.-])[0-9](?:[\x20-]?[0-9]){{12,18}}{_EDGE}",
    rf"(?<![A-Za-z0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_EDGE}(?!\.[0-9])",
    rf"(?<![A-Za-z0-9+])\+[0-9]{{1,3}}[\x20.-]?\(?[0-9]{{1,4}}\)?(?:[\x20.-]?[0-9]{{2,4}}){{2,5}}{_EDGE}",
    rf"(?<![A-Za-z0-9])\([0-9]{{3}}\)\x20?[0-9]{{3}}[\x20.-][0-9]{{4}}{_EDGE}",
    rf"(?<![A-Za-z0-9.-])[0-9]{{3}}[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}{_EDGE}",
    rf"(?<![A-Za-z0-9.-])(?:[2-9][0-9]{{9}}|0[1-9][0-9]{{8,9}}){_EDGE}(?![.-][0-9])",
    rf"(?<![A-Za-z0-9.-])0[1-9](?:[\x20.][0-9]{{2}}){{4}}{_EDGE}",
    rf"(?<![A-Za-z0-9.-])(?=(?:[\x20/-]?[0-9]){{9,12}}{_EDGE})0[0-9]{{1,4}}[\x20/-][0-9]{{3,8}}(?:[\x20-][0-9]{{2,5}}){{0,3}}{_EDGE}",
    rf"(?<![A-Za-z0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![A-Za-z0-9-])",
    rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?{_EDGE}",
    rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{EITHER})\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}",
))

#: Words that are looked up among the names of their text, and what a name may have behind it.
WORD = r"(?<!\p{L})\p{L}[\p{L}'’-]*"
POSSESSIVE = "['’][sS]?$"

#: Every match holds a digit, an @ or a title; most texts hold none of them, and this is found out at less cost.
TITLE = rf"(?:{MALE}|{FEMALE}|{EITHER})\.?\x20\p{{Lu}}"


def _has_private(text: Column) -> Column:
    return (text.rlike("[0-9@]") | text.rlike(TITLE)) & text.rlike(PATTERN)


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{MALE}|{FEMALE}|{EITHER})\.?\x20"), "name").when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike("^[A-Z]"), "iban")
        .when(m.startswith("+") | m.startswith("(") | (F.length(F.regexp_replace(m, "[^0-9]", "")) < 13), "phone").otherwise("card")
    )


def _chars(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, POSSESSIVE, ""))


def _pieces(kind: Column, m: Column) -> Column:
    """(kind, text, norm) of the parts of a mention that are replaced one by
    one; those of kind 'keep' stay.  A local part of an address has the whole
    address as its norm, and an international number its plus."""
    part = lambda k, t, n: F.struct(k.alias("kind"), t.alias("text"), n.alias("norm"))
    title = F.regexp_extract(m, rf"^({MALE}|{FEMALE}|{EITHER})\.?\x20", 0)
    gender = F.when(m.rlike(f"^(?:{FEMALE})\\b"), "f").when(m.rlike(f"^(?:{MALE})\\b"), "m").otherwise("x")
    tokens = F.split(m.substr(F.length(title) + 1, F.length(m)), " ")
    named = F.transform(tokens, lambda t, i: part(F.when(i == F.size(tokens) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender)), F.concat(F.when(i > 0, " ").otherwise(""), t), _bare(t)))
    norm = F.when(kind == "ip", m).otherwise(F.concat(F.when((kind == "phone") & m.startswith("+"), "+").otherwise(""), F.regexp_replace(m, "[^A-Za-z0-9]", "")))
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    address = F.array(part(kind, local, F.lower(m)), part(F.lit("keep"), F.lit("@"), F.lit("")), part(F.lit("domain"), domain, F.lower(domain)))
    return F.when(kind == "name", F.concat(F.array(part(F.lit("keep"), title, F.lit(""))), named)).when(kind == "email", address).otherwise(F.array(part(kind, m, norm)))


def _mod97(x: Column) -> Column:
    """The remainder of a number by 97, letters being 10 to 35."""
    return F.aggregate(_chars(x), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _drawn(key: str, kind: Column, norm: Column, attempt: int) -> Column:
    """The surrogate of a normal form."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt)))
    stream = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(norm) / 32).cast("int") + 1), lambda i: F.sha2(F.concat_ws("|", seed, i), 256)), "")

    def of(hexes: Column) -> Column:
        value = lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        stays = (
            F.when(kind == "email", F.length(F.substring_index(norm, "@", 1))).when(kind == "domain", F.length(norm) - F.length(F.substring_index(norm, ".", -1))).otherwise(F.length(norm)),  # to the end
            F.when(kind == "iban", 2).when((kind == "phone") & norm.startswith("+"), F.length(F.regexp_extract(norm, COUNTRY, 0))).when((kind == "card") | ((kind == "phone") & norm.startswith("0")), 1).otherwise(0),  # from the start
        )

        def char(c: Column, i: Column) -> Column:
            new = F.when(c.rlike("[a-z]"), F.char(97 + value(i) % 26)).when(c.rlike("[A-Z]"), F.char(65 + value(i) % 26)).when(c.rlike("[0-9]"), F.char(48 + value(i) % 10)).otherwise(c)
            return F.when((i >= stays[0]) | (i < stays[1]), c).otherwise(new)

        plain = F.array_join(F.transform(_chars(norm), char), "")
        if attempt >= WIDEN:
            plain = F.when(kind.isin("email", "domain"), F.concat(F.substring(hexes, 1, 6), plain)).otherwise(plain)

        def octet(o: Column, i: Column) -> Column:
            if attempt >= WIDEN:
                return (value(i) % 254 + 1).cast("string")
            return F.when(F.length(o) == 1, value(i) % 9 + 1).when(F.length(o) == 2, value(i) % 90 + 10).otherwise(100 + value(i) % 156).cast("string")

        def checked(p: Column) -> Column:
            body = F.substring(p, F.lit(1), F.length(p) - 1)
            right = F.filter(F.array(*(F.lit(str(k)) for k in range(10))), lambda c: F.call_function("luhn_check", F.concat(body, c)))[0]
            wrong = ((right.cast("int") + 1 + value(F.lit(0)) % 9) % 10).cast("string")
            return F.concat(body, F.when(F.call_function("luhn_check", norm), right).otherwise(wrong))

        def numbered(p: Column) -> Column:
            """With check digits that are right if the entity's are."""
            rest = F.substring(p, F.lit(5), F.length(p))
            right = 98 - _mod97(F.concat(rest, F.substring(p, 1, 2), F.lit("00")))
            good = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
            return F.concat(F.substring(p, 1, 2), F.lpad(F.when(good, right).otherwise(right % 97 + 1).cast("string"), 2, "0"), rest)

        script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        pick = lambda names, i: F.element_at(F.split(F.lit(names), " "), value(F.lit(i)) % len(names.split()) + 1)
        given = reduce(lambda a, sg: F.when((script == sg[0]) & (kind == f"given_{sg[1]}"), pick(GIVEN[sg], 0)).otherwise(a), GIVEN, F.lit(""))
        surname = reduce(lambda a, s: F.when(script == s, F.concat(*(pick(SYLLABLES[s], 1 + i) for i in range(3 + attempt)))).otherwise(a), SYLLABLES, F.lit(""))
        if attempt:  # more given names than the list has: longer ones
            given = F.concat(given, F.when(script == "cyrillic", F.concat(*(pick(SYLLABLES["cyrillic"], 8 + i) for i in range(attempt)))).otherwise(F.concat(*(pick(SYLLABLES["latin"], 8 + i) for i in range(attempt)))))
        return (
            F.when(kind == "ip", F.array_join(F.transform(F.split(norm, r"\."), octet), ".")).when(kind == "card", let(plain, checked)).when(kind == "iban", let(plain, numbered))
            .when(kind.startswith("given"), F.lower(given)).when(kind == "surname", surname).otherwise(plain)
        )

    return let(stream, of)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, new: distinct surrogates of the distinct ``entities(kind,
    norm)``, none of which equals an entity of its kind."""
    entities = materialise(entities.distinct(), "entities")
    is_open, attempt, settled = entities, 0, None
    while True:
        drawn = is_open.withColumn("new", _drawn(key, F.col("kind"), F.col("norm"), attempt))
        taken = entities.select("kind", F.col("norm").alias("new"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "new"))
        fresh = drawn.join(taken, ["kind", "new"], "left_anti").groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        fresh = materialise(fresh.select("kind", "norm", "new"), "surrogates")
        settled = fresh if settled is None else settled.union(fresh)
        is_open = materialise(is_open.join(fresh, ["kind", "norm"], "left_anti"), "open")
        attempt += 1
        if not is_open.limit(1).count():
            return settled


def _written(kind: Column, text: Column, new: Column) -> Column:
    """``new`` in the format of the mention ``text``."""
    upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    digits = F.replace(new, F.lit("+"), F.lit(""))
    number = F.array_join(F.transform(_chars(text), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), "[^A-Za-z0-9]", "")), F.lit(1))).otherwise(c)), "")
    part = F.substring_index(new, "@", 1)
    shift = F.length(part) - F.length(text)
    address = F.array_join(F.transform(_chars(part), lambda c, i: F.when(upper(F.substring(text, F.greatest(i + 1 - shift, F.lit(1)), F.lit(1))), F.upper(c)).otherwise(c)), "")
    blank = F.when(text.startswith(" "), " ").otherwise("")
    bare = F.regexp_replace(F.ltrim(text), POSSESSIVE, "")
    name = F.concat(blank, F.when((F.length(bare) > 1) & upper(bare), F.upper(new)).otherwise(F.initcap(new)), F.regexp_extract(text, POSSESSIVE, 0))
    return F.when(kind == "keep", text).when(kind.isin("email", "domain"), address).when(kind == "ip", new).when(kind.isin("phone", "card", "ssn", "iban"), number).otherwise(name)


def _with_gender(parts: DataFrame) -> DataFrame:
    """``parts`` where given names behind a title that tells no gender have the
    gender of their other mentions, if these agree."""
    told = parts.where(F.col("kind").isin("given_m", "given_f")).groupBy(F.col("norm").alias("_norm")).agg(F.min("kind").alias("_low"), F.max("kind").alias("_high"))
    told = small(materialise(told.where("_low = _high"), "genders"), BROADCAST_NAMES)
    met = parts.join(told, (F.col("kind") == "given_x") & (F.col("norm") == F.col("_norm")), "left")
    return met.withColumn("kind", F.coalesce("_low", "kind")).drop("_norm", "_low", "_high")


def _named(word: Column, names: Column) -> Column:
    """The surrogate that ``names`` has for a capitalised word; null for others."""
    return F.when(word.rlike(r"^\p{Lu}"), F.element_at(names, _bare(word)))


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, text and any others) with surrogates in the texts, and
    a count ``n_<kind>`` for each of ``KINDS``.

    ``n_name`` counts mentions with a title and without.  A token that is both a
    given name and a surname in a text counts as a surname there; one that the
    text also has as a word in small letters is replaced only behind a title.
    Null texts stay null, texts without entities stay as they are; both count
    0.  Columns of ``docs`` that have the name of a count are replaced by it, all
    others keep their values, whatever their names; an empty table stays empty.  Rows with one doc_id and one text, and rows without doc_id, are treated
    like others.  Whoever has ``key`` can recompute the surrogate of a guess,
    so it is to be kept secret.
    """
    rows = packed(docs)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    held = rows.where(_has_private(text))
    found = held.select(F.struct("row.doc_id", F.xxhash64(text).alias("h")).alias("d"), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), 0)).alias("pos", "m"))
    found = materialise(found.distinct(), "mentions").withColumn("kind", _kind(F.col("m")))
    parts = found.select("d", "pos", F.col("kind").alias("whole"), F.posexplode(_pieces(F.col("kind"), F.col("m"))).alias("sub", "p")).select("d", "pos", "whole", "sub", "p.*")
    parts = materialise(_with_gender(parts), "parts")
    new = surrogates(parts.where("kind <> 'keep'").select("kind", "norm"), key)
    written = parts.join(new, ["kind", "norm"], "left").withColumn("out", _written(F.col("kind"), F.col("text"), F.col("new")))
    by_mention = written.groupBy("d", "pos").agg(F.first("whole").alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub", "out"))), lambda x: x["out"]), "").alias("out"))
    counts = [F.count(F.when(F.col("whole") == k, 1)).alias(f"n_{k}") for k in KINDS]
    by_doc = by_mention.groupBy("d").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]).alias("_outs"), *counts)
    tokens = written.where((F.col("kind") == "surname") | F.col("kind").startswith("given")).groupBy("d", "norm").agg(F.max(F.struct("kind", "new"))["new"].alias("new"))
    by_doc = by_doc.join(tokens.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("norm", "new"))).alias("_names")), "d", "left")
    by_doc = by_doc.select(F.col("d.doc_id").alias("_id"), F.col("d.h").alias("_h"), "_outs", "_names", *(f"n_{k}" for k in KINDS))
    met = held.join(by_doc, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")))
    gaps = F.split(text, PATTERN)
    words = lambda x: F.regexp_extract_all(x, F.lit(WORD), 0)
    names = let(F.array_distinct(words(text)), lambda all_words: F.map_filter("_names", lambda k, _: ~F.array_contains(all_words, k)))

    def renamed(gap: Column, known: Column) -> Column:
        swap = lambda w: let(_named(w, known), lambda new: F.when(new.isNull(), w).otherwise(_written(F.lit("surname"), w, new)))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(gap, WORD).alias("sep"), words(gap).alias("word")), lambda z: F.array(z["sep"], F.coalesce(swap(z["word"]), F.lit(""))))), "")

    def further(known: Column) -> Column:
        found_in = lambda gap: F.size(F.filter(words(gap), lambda w: _named(w, known).isNotNull()))
        return F.struct(
            F.transform(gaps, lambda gap: renamed(gap, known)).alias("gaps"),
            F.aggregate(gaps, F.lit(0).cast("bigint"), lambda n, gap: n + found_in(gap)).alias("n"),
        )

    met = met.withColumn("_more", F.when(F.col("_names").isNotNull(), let(names, further)).otherwise(F.struct(gaps.alias("gaps"), F.lit(0).cast("bigint").alias("n"))))
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(F.col("_more.gaps").alias("gap"), F.col("_outs").alias("out")), lambda z: F.array(z["gap"], F.coalesce(z["out"], F.lit(""))))), "")
    names = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    own = lambda new: [new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names]
    counted = {k: F.col(f"n_{k}") for k in KINDS} | {"name": F.col("n_name") + F.col("_more.n")}
    done = met.select(*own(woven), *(counted[k].alias(f"n_{k}") for k in KINDS))
    clean = rows.where(~_has_private(text)).select(*own(F.col("row.text")), *(F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS))
    return clean.union(done)
