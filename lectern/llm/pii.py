"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import unnamed

ROUNDS = 6
#: A pseudonym outside the valid values is permuted again; so many times always suffice in practice (see ``_walk``).
WALKS = 64
YEARS = (1900, 200)

# The length of an IBAN in each country that has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Digits of a card without gaps, or in the groups that cards are printed in.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 3, 3, 3), (6, 13))


def _card(groups: tuple[int, ...]) -> str:
    return "[ -]".join(f"[0-9]{{{n}}}" for n in groups)


# What counts as personal data. Order matters: the first alternative that fits a place is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9])(?:{'|'.join(_iban(n, c) for n, c in IBAN_LENGTHS.items())})(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\1(?:19|20)[0-9]{2})(?![0-9A-Za-z/-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": rf"(?<![0-9A-Za-z])(?:{_card((4, 4, 4, 4))}[ -][0-9]{{1,3}}|{'|'.join(map(_card, CARD_GROUPS))}|[0-9]{{13,19}})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|\+[1-9][0-9]{0,2}(?:[ ./()-]{0,2}[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: A card whose longest reading fails may be followed by another number (a security code, an expiry date).
SHORTER = rf"(?<![0-9A-Za-z]){_card((4, 4, 4, 4))}(?![0-9A-Za-z])"
#: Other groupings and countries, where nothing above is found.
LOOSE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
_LOOSE = "|".join(LOOSE.values())
_NAMED = ANY.replace("([./-])", "(?<dot>[./-])").replace(r"\1", r"\k<dot>")
#: Nothing, where a match begins: group 1 the match, 3 its shorter reading, 4 the loose one.
STARTS = f"(?=({_NAMED})|{_LOOSE})(?=({SHORTER})|)(?=({_LOOSE})|)"
_SPANS = "array<struct<at:int,stop:int,value:string>>"

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _hash(key: str, *parts: Column) -> Column:
    """A keyed number below 2^52."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _moved(c: Column, kind: Column, by: Column) -> Column:
    def step(first: str, size: int) -> Column:
        return F.chr((F.ascii(c) - ord(first) + by) % size + ord(first))

    return F.when(kind == "d", step("0", 10)).when(kind == "D", step("2", 8)).when(kind == "l", step("a", 26)).when(kind == "u", step("A", 26)).otherwise(c)


def _classes(core: Column) -> Column:
    """A character's class at each place: d digit, l lower, u upper case letter."""
    return F.translate(core, _DIGITS + _LOWER + _LOWER.upper(), "d" * 10 + "l" * 26 + "u" * 26)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute(core: Column, kinds: Column, key: str, tweak: Column) -> Column:
    """Feistel network over the characters of ``core`` (64 at most): each half in turn is shifted, place by place and
    within its character's class, by a keyed hash of the other half. A bijection on the strings of one pattern of classes."""
    half = F.floor(F.size(kinds) / 2).cast("int")

    def shifted(part: Column, part_kinds: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other, "")), 512)
        moved = lambda h: F.transform(part, lambda c, i: _moved(
            c, F.get(part_kinds, i), F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))
        return _let(digest, moved)

    def round_(acc: Column, r: Column) -> Column:
        a, b, ka, kb = (acc[x] for x in ("a", "b", "ka", "kb"))
        first = F.struct(shifted(a, ka, b, r).alias("a"), b.alias("b"), ka.alias("ka"), kb.alias("kb"))
        second = F.struct(a.alias("a"), shifted(b, kb, a, r).alias("b"), ka.alias("ka"), kb.alias("kb"))
        return F.when(r % 2 == 0, first).otherwise(second)

    def halves(chars: Column) -> tuple[Column, Column]:
        return F.slice(chars, F.lit(1), half), F.slice(chars, half + 1, F.lit(64))

    (a, b), (ka, kb) = halves(_chars(core)), halves(kinds)
    start = F.struct(a.alias("a"), b.alias("b"), ka.alias("ka"), kb.alias("kb"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda acc: F.array_join(F.concat(acc["a"], acc["b"]), ""))


def _core(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _laid(value: Column, core: Column) -> Column:
    """``core``'s characters at the letter and digit places of ``value``; its other characters stay."""
    def at(c: Column, i: Column) -> Column:
        place = F.length(_core(F.substr(value, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(core, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(value), at), "")


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum with every second digit from the right doubled, beginning with the last if ``odd`` is 0."""
    def add(acc: Column, c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + (i + odd + 1) % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    marked = F.transform(F.reverse(_chars(digits)), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(marked, F.lit(0), lambda acc, x: add(acc, x["c"], x["i"]))


def _mod97(text: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), add)


def _iban_mod(core: Column, check: Column) -> Column:
    return _mod97(F.concat(F.substr(core, F.lit(5), F.length(core)), F.substr(core, F.lit(1), F.lit(2)), check))


def _walked(body: Column, kinds: Column, key: str, tweak: Column, valid) -> Column:
    """Cycle walking: permute until the outcome is valid; a bijection on the valid values. At most an eighth of the
    values of any kind here is invalid, so ``WALKS`` steps fail once in 10^57."""
    def step(acc: Column, _: Column) -> Column:
        again = _let(permute(acc["s"], kinds, key, tweak), lambda s: F.struct(s.alias("s"), valid(s).alias("ok")))
        return F.when(acc["ok"], acc).otherwise(again)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(body.alias("s"), F.lit(False).alias("ok")), step, lambda acc: acc["s"])


def _ssn_ok(core: Column) -> Column:
    return ~core.rlike("^(?:000|666|9)|^...00|0000$")


def _ip(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    pair = [F.element_at(octets, i).cast("bigint") * 256 + F.element_at(octets, i + 1).cast("bigint") for i in (1, 3)]

    def round_(acc: Column, r: Column) -> Column:
        moved = (acc["a"] + _hash(key, F.lit("ip"), r, acc["b"])) % 65536
        return F.struct(acc["b"].alias("a"), moved.alias("b"))

    def dotted(acc: Column) -> Column:
        parts = [F.floor(acc["a"] / 256), acc["a"] % 256, F.floor(acc["b"] / 256), acc["b"] % 256]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    start = F.struct(pair[0].alias("a"), pair[1].alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, dotted)


def _date_format(value: Column) -> Column:
    """A valid date's pattern (day before month where both fit), else null."""
    mark = F.substr(value, F.lit(3), F.lit(1))
    fits = lambda fmt: F.try_to_timestamp(value, fmt).isNotNull()
    iso = F.lit("yyyy-MM-dd")
    day, month = (F.concat(F.lit(a), mark, F.lit(b), mark, F.lit("yyyy")) for a, b in (("dd", "MM"), ("MM", "dd")))
    return F.when(value.rlike("^[0-9]{4}"), F.when(fits(iso), iso)).when(fits(day), day).when(fits(month), month)


def _date(value: Column, fmt: Column, key: str) -> Column:
    """Years and days of the year are shifted in turn by a keyed hash of the other; 29 February stays one, in another leap year."""
    first, count = YEARS
    day = F.to_date(F.try_to_timestamp(value, fmt))
    leap_day = F.date_format(day, "MMdd") == "0229"
    year, noleap = F.year(day), F.datediff(day, F.make_date(F.year(day), F.lit(1), F.lit(1)))
    is_leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366
    place = noleap - (is_leap & (noleap > 59)).cast("int")  # of 365

    def round_(acc: Column, r: Column) -> Column:
        years = F.struct(((acc["y"] + _hash(key, F.lit("date"), r, acc["d"])) % count).alias("y"), acc["d"].alias("d"))
        days = F.struct(acc["y"].alias("y"), ((acc["d"] + _hash(key, F.lit("date"), r, acc["y"])) % 365).alias("d"))
        return F.when(r % 2 == 0, years).otherwise(days)

    def named(acc: Column) -> Column:
        # 2001 has no leap day: its day number gives month and day
        shown = F.date_add(F.lit("2001-01-01").cast("date"), acc["d"].cast("int"))
        return F.make_date((acc["y"] + first).cast("int"), F.month(shown), F.dayofmonth(shown))

    start = F.struct((year - first).cast("bigint").alias("y"), place.cast("bigint").alias("d"))
    plain = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, named)
    # 1904, 1908, ... 2096: 49 leap years
    leap = (F.floor((year - 1904) / 4) + _hash(key, F.lit("leap day"))) % 49 * 4 + 1904
    return F.date_format(F.when(leap_day, F.make_date(leap.cast("int"), F.lit(2), F.lit(29))).otherwise(plain), "yyyy-MM-dd")


def _written(iso: Column, fmt: Column) -> Column:
    y, m, d = F.substr(iso, F.lit(1), F.lit(4)), F.substr(iso, F.lit(6), F.lit(2)), F.substr(iso, F.lit(9), F.lit(2))
    return F.replace(F.replace(F.replace(fmt, F.lit("yyyy"), y), F.lit("MM"), m), F.lit("dd"), d)


def _spec(value: Column, core: Column) -> Column:
    """What of a match is permuted: kind, head (kept), body, the classes of its characters, tail (kept), tweak.
    Kind is null where the match fails validation."""
    whole = {k: value.rlike(f"^(?:{p}|{LOOSE[k]})$" if k in LOOSE else f"^(?:{p})$") for k, p in PATTERNS.items()}
    length = F.length(core)

    def out(kind: str | None, body: Column, head: Column | str = "", tail: Column | str = "", tweak: Column | str = "", kinds: Column | None = None) -> Column:
        texts = [F.lit(x) if isinstance(x, str) else x for x in (head, tail, tweak)]
        return F.struct(
            F.lit(kind).cast("string").alias("kind"), texts[0].alias("head"), body.alias("body"), (_classes(body) if kinds is None else kinds).alias("kinds"),
            texts[1].alias("tail"), F.concat(F.lit(f"{kind}|"), texts[2]).alias("tweak"))

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    after = lambda n: F.substr(core, F.lit(n + 1), length)
    country = F.substr(core, F.lit(1), F.lit(2))
    american = core.rlike("^1?[2-9][0-9]{9}$")
    number = F.substr(core, length - 9, F.lit(10))
    number_kinds = F.when(number.rlike("^...[2-9]"), F.lit("DddDdddddd")).otherwise(F.lit("Dddddddddd"))
    return (
        F.when(whole["email"], out("email", _core(local), tail=F.concat(F.lit("@"), domain), tweak=F.lower(domain)))
        .when(whole["key"], out("key", after(4), head=F.substr(core, F.lit(1), F.lit(4))))
        .when(whole["iban"] & (_iban_mod(core, F.substr(core, F.lit(3), F.lit(2))) == 1), out("iban", after(4), head=country, tweak=country))
        .when(whole["date"] & _date_format(value).isNotNull(), out("date", F.lit("")))
        .when(whole["ip"], out("ip", F.lit("")))
        .when(whole["ssn"] & _ssn_ok(core), out("ssn", core))
        .when(whole["card"] & (luhn_sum(core, 1) % 10 == 0), out("card", F.substr(core, F.lit(1), length - 1)))
        .when(whole["phone"] & american, out("phone", number, head=F.substr(core, F.lit(1), length - 10), kinds=number_kinds))
        .when(whole["phone"], out("phone", after(2), head=F.substr(core, F.lit(1), F.lit(2))))
        .otherwise(out(None, F.lit("")))
    )


def _finished(value: Column, spec: Column, body: Column, key: str) -> Column:
    kind = spec["kind"]
    stem = F.concat(spec["head"], F.lit("00"), body)
    check = F.lpad((98 - _iban_mod(stem, F.lit("00"))).cast("string"), 2, "0")
    whole = (
        F.when(kind == "iban", F.concat(spec["head"], check, body))
        .when(kind == "card", F.concat(body, ((10 - luhn_sum(body, 0) % 10) % 10).cast("string")))
        .otherwise(F.concat(spec["head"], body))
    )
    local = F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(value)
    return (
        F.when(kind.isNull(), value)
        .when(kind == "ip", _ip(value, key))
        .when(kind == "date", _let(_date_format(value), lambda fmt: _written(_date(value, fmt, key), fmt)))
        .otherwise(F.concat(_laid(local, whole), spec["tail"]))
    )


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, value) of one match: its pseudonym, or kind null and the value as it is where it fails validation."""
    def from_spec(spec: Column) -> Column:
        valid = lambda s: (spec["kind"] != "ssn") | _ssn_ok(s)
        body = F.when(spec["body"] == "", "").otherwise(_walked(spec["body"], _chars(spec["kinds"]), key, spec["tweak"], valid))
        return _let(body, lambda b: F.struct(spec["kind"].alias("kind"), _finished(value, spec, b, key).alias("value")))

    return _let(_core(value), lambda core: _let(_spec(value, core), from_spec))


def _valid(value: Column) -> Column:
    return _let(_core(value), lambda core: _spec(value, core)["kind"].isNotNull())


def _candidates(text: Column) -> Column:
    """Every place where a match begins, inside other matches too: where (from 0), the match, its shorter and its loose reading."""
    padded = F.concat(F.lit("\n"), text)  # a split leaves out an empty piece at the very start
    pieces = F.transform(F.split(padded, STARTS), lambda p: F.length(p))
    places = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")), lambda acc: acc["out"])
    first, shorter, loose = (F.regexp_extract_all(padded, F.lit(STARTS), F.lit(i)) for i in (1, 3, 4))
    return F.arrays_zip(places.alias("at"), first.alias("first"), shorter.alias("shorter"), loose.alias("loose"))


def _span(at: Column, value: Column) -> Column:
    return F.struct(at.alias("at"), (at + F.length(value)).alias("stop"), value.alias("value"))


def _taken(candidates: Column) -> Column:
    """From left to right the first valid reading at each place that no taken one covers."""
    def add(acc: Column, c: Column) -> Column:
        read = F.when(_valid(c["first"]), c["first"]).when(_valid(c["shorter"]), c["shorter"])
        with_it = lambda v: F.when(v.isNull(), acc).otherwise(
            F.struct((c["at"] + F.length(v)).alias("end"), F.concat(acc["out"], F.array(_span(c["at"], v))).alias("out")))
        return F.when((c["first"] == "") | (c["at"] < acc["end"]), acc).otherwise(_let(read, with_it))

    return F.aggregate(candidates, F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("out")), add, lambda acc: acc["out"])


def _rest(candidates: Column, taken: Column) -> Column:
    """Valid ones of the loose readings that touch nothing taken, each behind the one before."""
    def add(acc: Column, c: Column) -> Column:
        stop = c["at"] + F.length(c["loose"])
        free = (c["loose"] != "") & (c["at"] >= acc["end"]) & ~F.exists(taken, lambda t: (t["at"] < stop) & (t["stop"] > c["at"]))
        out = F.when(_valid(c["loose"]), F.concat(acc["out"], F.array(_span(c["at"], c["loose"])))).otherwise(acc["out"])
        return F.when(free, F.struct(stop.alias("end"), out.alias("out"))).otherwise(acc)

    return F.aggregate(candidates, F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("out")), add, lambda acc: acc["out"])


def _replaced(spans: Column, key: str) -> Column:
    """The spans in order with kind and pseudonym."""
    def one(x: Column) -> Column:
        return _let(pseudonym(x["value"], key), lambda p: F.struct(x["at"].alias("at"), x["stop"].alias("stop"), p["kind"].alias("kind"), p["value"].alias("value")))

    return F.transform(F.array_sort(spans), one)


def _rewritten(text: Column, found: Column) -> Column:
    """The text with its spans replaced."""
    def piece(x: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(found, i - 1)["stop"])
        return F.concat(F.substr(text, before + 1, x["at"] - before), x["value"])

    tail = F.substr(text, F.element_at(found, -1)["stop"] + 1)
    return F.concat(F.array_join(F.transform(found, piece), ""), tail)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every valid e-mail address, access key, IBAN, date, IPv4 address, social security, card and phone
    number in ``text_col`` replaced by its pseudonym, and two more columns: ``private`` (how many were replaced) and
    ``private_kinds`` (their kinds: distinct, sorted, comma-joined).

    The pseudonym of a value has its format: separators stay, digits become digits, letters letters of their case, check
    digits (Luhn, mod 97) are made anew, dates stay dates and addresses addresses. It depends on the key, the kind and
    the value without separators alone, so equal values stay linked across documents; it is a permutation, which the
    holder of the key can undo. What fails validation (a wrong check digit, 31 February) is left alone, but for
    values that it holds or that begin in it; a text without any match stays as it is, byte for byte. Nulls stay null with 0 found; a column already named ``private`` or
    ``private_kinds`` is replaced. No shuffle, no Python. ``key`` shows in the plan: keep plans where the key may be.
    """
    done, back = _rewritten_texts(docs, key, text_col)
    back = [c for c, name in zip(back, docs.columns) if name not in ("private", "private_kinds")]
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",")
    count = F.coalesce(F.when(F.col("found").isNotNull(), F.size("found")), F.lit(0))
    return done.select(*back, count.alias("private"), F.coalesce(kinds, F.lit("")).alias("private_kinds"))


def _rewritten_texts(docs: DataFrame, key: str, text_col: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` under plain names with its texts rewritten, ``found`` (what was, in order) and ``old`` (the text before),
    and its columns under their own names."""
    plain, names, back = unnamed(docs)
    text = F.col(names[text_col])
    # every match holds one of these, and most texts do not
    hint = text.rlike("[0-9@]|AKIA|ASIA")
    hit = F.coalesce(hint & text.rlike(f"{ANY}|{_LOOSE}"), F.lit(False))
    # what is used twice is a column of its own: both uses share one evaluation
    found = plain.withColumn("seen", F.when(hit, _candidates(text))).withColumn("taken", _taken(F.col("seen")))
    found = found.withColumn("found", _replaced(F.concat("taken", _rest(F.col("seen"), F.col("taken"))), key)).drop("seen", "taken")
    new = F.when(F.size("found") > 0, _rewritten(text, F.col("found"))).otherwise(text)
    return found.withColumns({names[text_col]: new, "old": text}), back


def pseudonymize_documents(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in their texts; columns are those of ``docs``, whatever their names (pseudonyms keep
    lengths but for addresses, so n_chars, where there is one, is counted anew for changed texts)."""
    done, back = _rewritten_texts(docs, key, "text")
    if "n_chars" in docs.columns:
        text, count = (f"c{docs.columns.index(c)}" for c in ("text", "n_chars"))
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn(count, F.when(F.col(text) != F.col("old"), F.length(text).cast(kind)).otherwise(F.col(count)))
    return done.select(*back)
