"""Personal data and secrets, replaced by keyed surrogates of the same type (operator 4); DataFrame functions only.

Patterns find e-mail and IPv4 addresses, phone and card numbers (with a valid check digit), social security numbers, access
keys, assigned secrets and persons: by title, by a listed first name (or the first part of a hyphenated one), or by words that announce
a name, initials and particles ("de la") between first name and surname included. Each finding gets a surrogate from a keyed hash of its normal form:

- numbers keep their separators and length, phones their country code (with separators or without), cards their first digit and a
  valid check digit;
- addresses keep their layout and top-level domain; keys and secrets keep prefix, alphabet and case of each character;
- persons' first names are drawn by gender and script, surnames are built in the script, with the gender's ending.

The normal form leaves out layout, so the same number, address or name has one surrogate everywhere (coreference). Where a
document names a person, its other mentions of that surname or first name, capitalised or in capitals, and of the whole name
in any case, take the same surrogates. Distinct normal forms are checked against each other: where two share a surrogate, or a
surrogate is itself a found value, all but the first try again with another hash; names, secrets and mail addresses grow
longer with the tries, so that there is room for any number of them, until none collide (distinctness). Formats that cannot
grow (social security numbers, cards, phones, IPv4) have room as long as a table does not use up nearly all their numbers.

Only distinct findings are shuffled, and of the documents those that may have any. Null texts stay null and empty texts empty,
with no findings. Rows that repeat get the same result. An empty table gives no rows. Columns of the documents may have any
names; one named as a result column is replaced by it. First names that are neither listed nor announced are not found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Scratch

# Common first names by script and gender, surname syllables and gendered surname endings by script.
FIRST_NAMES = {
    ("latin", "f"): "Aisha Alice Amina Ana Anna Barbara Carla Carmen Clara Diana Elena Emma Eva Fatima Hannah Helen Ines Ingrid Irene Jennifer Julia Karen Laura Leila Linda Lucia Margaret Maria Marta Mary Mei Nina Olivia Patricia Paula Priya Rosa Sara Sarah Sofia Susan Teresa Vera Yuki".split(),
    ("latin", "m"): "Adam Ahmed Ali Andrew Anton Carlos Charles Daniel David Edward Felix Frank George Hans Henry Hiroshi Hugo Ivan James Jean John Jorge José Juan Karl Kenji Louis Marco Martin Michael Mohammed Omar Oscar Paul Pedro Peter Pierre Raj Richard Robert Thomas Victor Wei William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Лариса Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Σπύρος".split(),
}
SYLLABLES = {"latin": "ba ber bor cal dan del fer gar hol kes lan len mar mon nor pas rin ros sal tor val ver win zan".split(), "cyrillic": "бар вол гор дан жел зав кор лев мор нов пет рог сав тор фед чер".split(), "greek": "βασ γαλ δημ καρ λαμ μαν νικ παπ ρηγ σαβ τσι χρι".split()}
ENDINGS = {("latin", "f"): "", ("latin", "m"): "", ("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов", ("greek", "f"): "ου", ("greek", "m"): "ος"}
TITLES = {"m": "Mr Mister Herr Señor Monsieur Господин Κύριος".split(), "f": "Mrs Ms Miss Frau Señora Madame Госпожа Κυρία".split(), "any": "Dr Doctor Prof Professor Доктор Профессор Δρ".split()}
PARTICLES = ["de la", "de", "del", "della", "da", "di", "du", "van der", "van den", "van", "von", "zu", "bin", "ibn", "al"]
# The calling codes of one and two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# Words after which a name is no person, and words that announce one.
PLACES = "Street St Avenue Ave Road Rd Boulevard Square Lane Platz Straße Strasse School University College Airport Station Park Hospital Foundation Award Prize Church Bridge County".split()
CUES = ["[Mm]y name is", "[Ss]igned by", "[Nn]ame:", "[Cc]ontact:"]

_WORD = r"\p{Lu}(?:\p{L}|['’-]\p{L}{2})++"
_INITIALS = r"(?:\p{Lu}\.? ){0,2}"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) )?"
_LAST = rf"(?!(?:{'|'.join(PLACES)})\b){_WORD}(?! (?:{'|'.join(PLACES)})\b)"


def _one_of(words) -> str:
    """A pattern for any of the words where no letter comes before; it fails at most places on its first character."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:])
    return r"[A-ZΆ-ΫА-Я]" + rf"(?<!\p{{L}}.)(?:" + "|".join(f"(?<={a})(?:{'|'.join(rest)})" for a, rest in by.items()) + ")"


_LISTED = [n for names in FIRST_NAMES.values() for n in names]
_TITLES = [t for titles in TITLES.values() for t in titles]
_NAME, _TITLE = _one_of(_LISTED + [n.upper() for n in _LISTED]) + r"(?:-\p{Lu}\p{L}++)*+", _one_of(_TITLES) + r"\b"
_CUE = rf"(?=\p{{Lu}})(?<=\b(?:{'|'.join(CUES)}) )"
_ASSIGNED = r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-(?:proj-)?[A-Za-z0-9]{20,}\b",
    "secret": rf"\b(?=[pstaPSTA]){_ASSIGNED}\b\"?\s*[=:]\s*[\"']?[^\s\"']{{6,}}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|\+\d{1,3}[ .-]\d(?:[ .-]\d{3,4}){2}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "person": rf"(?:{_TITLE}\.? (?:{_WORD} {_INITIALS})?{_PARTICLE}{_LAST}|{_NAME} {_INITIALS}{_PARTICLE}{_LAST}|{_CUE}{_WORD} {_INITIALS}{_PARTICLE}{_LAST})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_LEAD = rf"^{_ASSIGNED}\"?\s*[=:]\s*[\"']?"
_HEAD = _one_of(_LISTED + [n.upper() for n in _LISTED] + _TITLES) + r"(?:\.? |-\p{Lu})|(?:" + "|".join(CUES) + r") \p{Lu}"


def _quick(text: Column) -> Column:
    """What every finding has: a digit or one of @ = :, the head of a key, or a title or first name. Few texts do, and to look costs little."""
    heads = [text.contains(x) for x in ("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")]
    return reduce(lambda a, b: a | b, [text.rlike("[0-9@=:]"), *heads, text.rlike(_HEAD)])


def _kind(raw: Column) -> Column:
    """The kind of a finding. What stood before it is not seen here, so an announced name is told by its form."""
    out = F.lit("mention")
    for kind, p in reversed(PATTERNS.items()):
        p = p.replace(_CUE, "") if kind == "person" else p
        out = F.when(raw.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


_PART = "struct<lead:string,raw:string,kind:string,norm:string>"


def _one(lead: Column, body: Column, kind: Column, norm: Column) -> Column:
    return F.struct(lead.alias("lead"), body.alias("raw"), kind.alias("kind"), norm.alias("norm")).cast(_PART)


def _person(raw: Column, key: str) -> Column:
    """Array of the parts of a person's mention: first name, if there is one, and surname. Initials become others, particles stay."""
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.? ", 0)
    name = raw.substr(F.length(title) + 1, F.length(raw))
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    particle = F.regexp_extract(name, f"^{_PARTICLE}", 0)
    first = F.when(name.contains(" ") & (F.length(particle) == 0), F.substring_index(name, " ", 1)).otherwise("")
    last = F.substring_index(name, " ", -1)
    middle = F.filter(F.split(name.substr(F.length(first) + 1, F.length(name) - F.length(first) - F.length(last)), " "), lambda x: x != "")
    women = [n for (_, g), names in FIRST_NAMES.items() if g == "f" for n in names]
    gender = F.when(title.rlike(rf"^(?:{'|'.join(TITLES['f'])})"), "f").when(title.rlike(rf"^(?:{'|'.join(TITLES['m'])})\b"), "m").when(F.initcap(F.substring_index(first, "-", 1)).isin(women), "f").otherwise("m")
    letter = lambda x: F.char(F.lit(65) + F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("initial"), x, F.lower(last)), 256), 1, 2), 16, 10).cast("int") % 26)
    initials = F.array_join(F.transform(middle, lambda x: F.concat(F.when(x == F.lower(x), x).otherwise(F.concat(letter(x), F.substring(x, 2, 1))), F.lit(" "))), "")
    # a surname with the other gender's ending is the same family's
    bare = F.lower(F.when(script == "cyrillic", F.regexp_replace(last, "(?i)(ов|ова|ев|ева|ин|ина)$", "")).otherwise(last))
    surname = lambda lead: _one(lead, last, F.concat_ws(":", F.lit("last"), gender, script), bare)
    both = F.array(_one(title, first, F.concat_ws(":", F.lit("first"), gender, script), F.lower(first)), surname(F.concat(F.lit(" "), initials)))
    return F.when(F.length(first) > 0, both).otherwise(F.array(surname(F.concat(title, particle))))


def _parts(raw: Column, kind: Column, names: Column, key: str) -> Column:
    """Array of (lead, raw, kind, norm): what is replaced in a finding, with the text before it that stays. No kind: all stays."""
    none, null = F.lit(""), F.lit(None).cast("string")
    lead = F.regexp_extract(raw, _LEAD, 0)
    value = raw.substr(F.length(lead) + 1, F.length(raw))
    # numbers without a code are found in the layouts of code 1 alone, and are the same numbers as with it
    number = F.concat(F.when(raw.startswith("+"), "").otherwise("1"), _digits(raw))
    code = F.length(F.regexp_extract(number, rf"^(?:{'|'.join(CALLING_CODES)}|\d{{3}})", 0))
    known = lambda word: F.filter(names, lambda n: F.lower(n["raw"]) == F.lower(word))
    again = F.transform(F.split(raw, " "), lambda word, i: _let(F.get(known(word), F.lit(0)), lambda n: _one(F.when(i > 0, " ").otherwise(""), word, n["kind"], n["norm"])))
    return (
        F.when(kind == "person", _person(raw, key))
        .when(kind == "mention", again)
        .when(kind == "secret", F.array(_one(lead, value, kind, value)))
        .when(kind == "email", F.array(_one(none, raw, kind, F.lower(raw))))
        .when(kind == "phone", F.array(_one(none, raw, F.concat(F.lit("phone:"), code.cast("string")), number)))
        .when((kind == "card") & (_luhn(_digits(raw)) != 0), F.array(_one(raw, none, null, null)))
        .when(kind.isin("card", "ssn"), F.array(_one(none, raw, kind, _digits(raw))))
        .otherwise(F.array(_one(none, raw, kind, raw)))
    )


def _names(text: Column, key: str) -> Column:
    """The parts (raw, kind, norm) of the persons that a text names."""
    each = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"(?:{PATTERNS['person']})"), F.lit(0)), lambda p: _person(p, key)))
    return F.array_distinct(F.transform(each, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), x["norm"].alias("norm"))))


def _pattern(names: Column) -> Column:
    """ANY, and the mentions of a document's persons."""
    low = F.transform(names, lambda n: F.lower(n["raw"]))
    words = F.flatten(F.transform(names, lambda n: F.array(n["raw"], F.initcap(F.lower(n["raw"])), F.upper(n["raw"]))))
    any_of = F.array_join(F.array_distinct(words), "|")
    whole = F.concat(F.lit("(?i:(?:"), F.array_join(low, "|"), F.lit(") (?:"), F.array_join(low, "|"), F.lit("))"))
    return F.when(F.size(names) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}'’-])(?:"), whole, F.lit("|"), any_of, F.lit(r")(?![\p{L}-])"))).otherwise(F.lit(ANY))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Hex digits of 64 bytes that only the key's holder can tell from the value; gender does not enter a surname's."""
    about = F.when(kind.startswith("last:"), F.concat(F.lit("last:"), F.substring_index(kind, ":", -1))).otherwise(kind)
    return F.sha2(F.concat_ws("\u0001", F.lit(key), about, attempt.cast("string"), norm), 512)


def _byte(stream: Column, i) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _scrambled(norm: Column, stream: Column, keep: Column, upto: Column) -> Column:
    """Characters keep + 1 to upto become others of their class; hexadecimal strings stay hexadecimal."""
    hexed = norm.rlike("^[0-9a-f]{8,}$")

    def other(c: Column, i: Column) -> Column:
        v = _byte(stream, i)
        letter = lambda base: F.char(F.lit(base) + F.pmod(v, F.when(hexed, 6).otherwise(26)))
        return (
            F.when((i < keep) | (i >= upto), c)
            .when(c.rlike("[0-9]"), F.when((c != "0") & (i == 0), F.pmod(v, F.lit(9)) + 1).otherwise(F.pmod(v, F.lit(10))).cast("string"))
            .when(c.rlike("[a-z]"), letter(97))
            .when(c.rlike("[A-Z]"), letter(65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(norm, ""), other), "")


def _luhn(digits: Column) -> Column:
    """The digits' weighted sum modulo 10; 0 for a valid card number."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _pick(items: list[str], stream: Column, i: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), F.pmod(_byte(stream, i) * 256 + _byte(stream, i + 1), F.lit(len(items))) + 1)


def surrogate(kind: Column, norm: Column, attempt: Column, s: Column) -> Column:
    """The surrogate of a normal form, in normal form too (names in title case), from its stream s."""
    size = F.length(norm)
    keep = F.when(kind.startswith("phone:"), F.substring_index(kind, ":", -1).cast("int")).when(kind == "card", 1).when((kind == "key") & norm.startswith("AKIA"), 4).when((kind == "key") & norm.startswith("gh"), 4).when((kind == "key") & norm.startswith("sk-proj-"), 8).when(kind == "key", 3).otherwise(0)
    upto = F.when(kind == "email", size - F.length(F.substring_index(norm, ".", -1))).otherwise(size)
    longer = F.when(kind.isin("secret", "email") & (attempt > 3), F.lower(F.substring(F.reverse(s), F.lit(1), F.least(attempt - 3, F.lit(32))))).otherwise("")
    plain = F.concat(longer, _scrambled(norm, s, keep, upto))
    card = _let(plain, lambda p: F.when(_luhn(norm) == 0, F.concat(p.substr(F.lit(1), size - 1), F.pmod(p.substr(size, F.lit(1)).cast("int") - _luhn(p), F.lit(10)).cast("string"))).otherwise(p))
    octet = lambda i: _byte(s, i).cast("string")
    ip = F.concat_ws(".", (F.pmod(_byte(s, 0), F.lit(223)) + 1).cast("string"), octet(1), octet(2), octet(3))
    names = {}
    for (script, gender), firsts in FIRST_NAMES.items():
        f = F.concat_ws("-", *[F.when((attempt >= 2 * k) | (F.lit(k == 1) & norm.contains("-")), _pick(firsts, s, 2 * k)) for k in range(6)])
        syllables = F.concat(*[_pick(SYLLABLES[script], s, 2 * k) for k in range(2)], *[F.when(attempt >= k - 1, _pick(SYLLABLES[script], s, 2 * k)).otherwise("") for k in range(2, 8)])
        names[f"first:{gender}:{script}"], names[f"last:{gender}:{script}"] = f, F.concat(F.initcap(syllables), F.lit(ENDINGS[script, gender]))
    out = F.when(kind == "card", card).when(kind == "ip", ip)
    for name, value in names.items():
        out = out.when(kind == name, value)
    return out.otherwise(plain)


def rendered(raw: Column, kind: Column, sur: Column) -> Column:
    """The surrogate in the layout of one mention."""
    digits = lambda i: F.length(sur) - F.length(_digits(raw)) + F.length(_digits(raw.substr(F.lit(1), i)))
    number = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9]"), sur.substr((digits(i) + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(raw, ""), lambda c, i: _let(sur.substr((i + 1).cast("int"), F.lit(1)), lambda x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x))), "")
    shout = F.when(raw == F.upper(raw), F.upper(sur)).when(raw == F.lower(raw), F.lower(sur)).otherwise(sur)
    return F.when(kind.startswith("phone:") | kind.isin("card", "ssn"), number).when(kind == "email", cased).when(kind.startswith("first:") | kind.startswith("last:"), shout).otherwise(sur)


def surrogates(values: DataFrame, key: str, scratch: Scratch, attempts: int = 200) -> DataFrame:
    """kind, norm, sur for distinct (kind, norm); no two norms of a group share a surrogate, and none is a found value.

    Groups are kinds without the gender, so a surname has one stem for both; its two forms do not collide with each other.
    """
    group = F.when(F.col("kind").startswith("phone:"), "phone").when(F.col("kind").startswith("last:"), F.concat(F.lit("last:"), F.substring_index("kind", ":", -1))).otherwise(F.col("kind"))

    made = surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("stream"))
    all_of = values.select("kind", "norm", group.alias("grp"))
    settled, pending = None, all_of
    for k in range(attempts):
        now = pending.withColumn("attempt", F.lit(k)).withColumn("stream", _stream(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        now = scratch.stage(now.withColumn("sur", made).select("kind", "norm", "grp", "sur"), f"try-{k}")
        shared = now.groupBy("grp", "sur").agg(F.min("norm").alias("first"), F.max("norm").alias("final")).where("first <> final").select("grp", "sur", "first")
        lost = now.join(shared, ["grp", "sur"]).where("norm <> first").select("grp", "norm")
        found = all_of.select(F.col("grp").alias("g"), F.lower("norm").alias("low")).distinct()
        lost = lost.union(now.join(found, (F.col("grp") == F.col("g")) & (F.lower("sur") == F.col("low"))).select("grp", "norm"))
        if settled is not None:
            lost = lost.union(now.join(settled.select("grp", "sur"), ["grp", "sur"]).select("grp", "norm"))
        # both forms of a surname try again together; what is settled is not written again
        lost = scratch.stage(lost.distinct(), f"lost-{k}")
        kept = now.join(lost, ["grp", "norm"], "left_anti").select("kind", "norm", "grp", "sur")
        settled = kept if settled is None else settled.unionByName(kept)
        if lost.isEmpty():
            return settled.select("kind", "norm", "sur")
        pending = now.join(lost, ["grp", "norm"], "left_semi").select("kind", "norm", "grp")
    raise RuntimeError(f"surrogates still collide after {attempts} tries")


def pseudonymize(docs: DataFrame, key: str, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", n_col: str = "_n_found", kinds_col: str = "_kinds") -> DataFrame:
    """The rows of docs with surrogates in their texts, and columns n_col (findings) and kinds_col (sorted, comma-joined)."""
    text = F.col(f"`{text_col}`").cast("string")
    own = [c for c in docs.columns if c not in (n_col, kinds_col)]
    none = ~F.coalesce(F.when(_quick(text), text.rlike(ANY)), F.lit(False))
    plain = docs.where(none).select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in own], F.lit(0).cast("long").alias(n_col), F.lit("").alias(kinds_col))
    # the patterns pass all texts twice: here, to set apart the documents with findings, and when the others are read for the result
    hit = docs.where(~none).select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), _names(text, key).alias("names"))
    hit = scratch.stage(hit, "hit").withColumn("t", F.col(f"d.`{text_col}`").cast("string")).withColumn("pattern", _pattern(F.col("names")))
    each = hit.select("id", "th", "names", F.posexplode(F.regexp_extract_all("t", F.col("pattern"), F.lit(0))).alias("pos", "found")).withColumn("what", _kind(F.col("found")))
    each = each.select("id", "th", "pos", F.when(F.col("what") == "mention", "person").otherwise(F.col("what")).alias("what"), F.posexplode(_parts(F.col("found"), F.col("what"), F.col("names"), key)).alias("sub", "p"))
    each = scratch.stage(each.select("id", "th", "pos", "sub", "what", "p.*").distinct(), "found")
    table = surrogates(each.where("kind is not null").select("kind", "norm").distinct(), key, scratch)
    new = each.join(table, ["kind", "norm"], "left").select("id", "th", "pos", "sub", F.when(F.col("kind").isNotNull(), F.col("what")).alias("what"), F.concat("lead", F.when(F.col("kind").isNotNull(), rendered(F.col("raw"), F.col("kind"), F.col("sur"))).otherwise(F.col("raw"))).alias("out"))
    whole = new.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "out", "what"))).alias("parts"), F.array_join(F.sort_array(F.collect_set("what")), ",").alias("kinds"))
    whole = whole.withColumnsRenamed({"id": "of", "th": "of_th"})
    joined = hit.select("d", "id", "th", "t", "pattern").join(whole, (F.col("th") == F.col("of_th")) & F.col("id").eqNullSafe(F.col("of")))
    gaps = F.split("t", F.col("pattern"), -1)
    after = lambda i: F.array_join(F.transform(F.filter("parts", lambda p: p["pos"] == i), lambda p: p["out"]), "")
    made = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, after(i))), "")
    n = F.size(F.array_distinct(F.transform(F.filter("parts", lambda p: p["what"].isNotNull()), lambda p: p["pos"]))).cast("long")
    done = joined.select(*[made.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in own], n.alias(n_col), F.col("kinds").alias(kinds_col))
    return plain.unionByName(done)
