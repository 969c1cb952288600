"""Normalisation of names and addresses as column expressions.

Everything is row-local: tokens stay arrays, so no explode and no shuffle. Learned
aliases enter as a join with a small table or as a map column.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The dictionaries, patterns and stop words that normalised records are defined by.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöüÀÂÎÏÔÙÛàâîïôùûÁÚáúÃÕãõÅåØøÝýÿ"
PLAIN = "ACEEEINOOUaceeeinoouAAIIOUUaaiiouuAUauAOaoAaOoYyy"
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}
MULTI_WORD = {
    "district of columbia": "dc", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "west virginia": "wv",
    "andhra pradesh": "andhrapradesh", "arunachal pradesh": "arunachalpradesh", "himachal pradesh": "himachalpradesh", "madhya pradesh": "madhyapradesh",
    "uttar pradesh": "uttarpradesh", "tamil nadu": "tamilnadu", "west bengal": "westbengal", "jammu and kashmir": "jammukashmir", "jammu kashmir": "jammukashmir",
}
ADDR_CANON = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "drv": "dr", "lane": "ln", "boulevard": "blvd", "bd": "blvd",
    "bld": "blvd", "boul": "blvd", "parkway": "pkwy", "pky": "pkwy", "circle": "cir", "court": "ct", "crt": "ct", "place": "pl", "terrace": "ter",
    "terr": "ter", "highway": "hwy", "trail": "trl", "square": "sq", "suite": "ste", "apartment": "apt", "floor": "fl", "flr": "fl", "number": "no",
    "num": "no", "nbr": "no", "building": "bldg", "bldng": "bldg", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne",
    "northwest": "nw", "southeast": "se", "southwest": "sw", "route": "rte", "rt": "rte", "mount": "mt", "point": "pt", "heights": "hts", "junction": "jct",
    "center": "ctr", "centre": "ctr", "expressway": "expy", "freeway": "fwy", "crossing": "xing", "alley": "aly", "plaza": "plz", "opposite": "opp",
    "near": "nr", "sector": "sec", "saint": "st", "sainte": "ste", "rue": "rue", "r": "rue", "chemin": "chem", "ch": "chem", "impasse": "imp",
    "allee": "allee", "quai": "quai", "cours": "crs", "faubourg": "fbg", "residence": "res",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
    "eleventh": "11", "twelfth": "12", "thirteenth": "13", "fourteenth": "14", "fifteenth": "15", "sixteenth": "16", "seventeenth": "17",
    "eighteenth": "18", "nineteenth": "19", "twentieth": "20",
}
NAME_CANON = {
    "corporation": "corp", "incorporated": "inc", "company": "co", "limited": "ltd", "private": "pvt", "centre": "center", "ctr": "center",
    "svcs": "services", "service": "services", "svc": "services", "grp": "group", "intl": "international", "assoc": "associates", "bros": "brothers",
    "mgmt": "management", "natl": "national", "mfg": "manufacturing", "shree": "sri", "shri": "sri", "sree": "sri",
}
LEGAL = (
    "llc inc corp co ltd pvt pllc llp lp plc pa pc sa sas sasu sarl eurl sci snc scop selarl public the and of mr mrs ms dr shri sri smt m s"
).split()
ALIAS = r"\b(?:formerly known as|also known as|doing business as|trading as|formerly|f k a|d b a|a k a|fka|dba|aka)\b"
WEB = r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|net|org|biz|info|co\.in|in|fr|us|co|io)$"
MISSING = r"\b(?:n/a|none|null|nil)\b"
LEET = ("013456789", "oleasgtbg")
# End of fixed values.

ADDRESS_WORDS = ADDR_CANON | US_STATES


def plain(c: Column) -> Column:
    """Null to '', Latin accents removed."""
    return F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN)


def spell(text: str) -> str:
    """Any script to ASCII: accents dropped, Devanagari spelt by the names of its letters, the rest left out."""
    out: list[str] = []
    for ch in unicodedata.normalize("NFKD", text):
        if ch < "\x80":
            out.append(ch)
            continue
        name = unicodedata.name(ch, "")
        if name.startswith("DEVANAGARI LETTER "):
            sound = name[18:].lower().replace("ttt", "t")
            out.append(sound)
        elif name.startswith("DEVANAGARI VOWEL SIGN ") or name == "DEVANAGARI SIGN VIRAMA":
            if out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]  # the sign replaces the letter's own a
            if "VOWEL" in name:
                out.append(name[22:].lower())
        elif name.startswith("DEVANAGARI SIGN ANUSVARA"):
            out.append("n")
        elif unicodedata.decimal(ch, None) is not None:
            out.append(str(unicodedata.decimal(ch)))
        elif name.startswith("LATIN "):
            out.append({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"}.get(ch, ""))
        elif unicodedata.category(ch) == "Zs":
            out.append(" ")
    return "".join(out)


def _devanagari() -> tuple[dict[str, str], dict[str, str]]:
    """(letters, signs) of the script by the rule of ``spell``; a letter that keeps its own a ends in a mark."""
    letters, signs = {}, {}
    for code in range(0x0900, 0x0980):
        ch = chr(code)
        name = unicodedata.name(ch, "")
        if name.startswith("DEVANAGARI LETTER ") and not unicodedata.decomposition(ch):
            sound = name[18:].lower().replace("ttt", "t")
            letters[ch] = sound[:-1] + MARK if sound.endswith("a") and len(sound) > 1 else sound
        elif name.startswith("DEVANAGARI VOWEL SIGN "):
            signs[ch] = name[22:].lower()
        elif name == "DEVANAGARI SIGN VIRAMA":
            signs[ch] = ""
        elif name.startswith("DEVANAGARI SIGN ANUSVARA"):
            letters[ch] = "n"
        elif name == "DEVANAGARI SIGN NUKTA":
            letters[ch] = ""
    return letters, signs


def _one_letter() -> tuple[str, str]:
    """Letters beyond Latin-1 and digits of other scripts that are one ASCII sign once accents are dropped."""
    froms, tos = list("ŁłĐđĦħı"), list("LlDdHhi")  # a stroke or a missing dot is no accent
    for code in (*range(0x0100, 0x0250), *range(0x1E00, 0x1F00), *range(0x0660, 0x0DF0)):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)
        digit = unicodedata.decimal(ch, None)
        if digit is not None:
            froms.append(ch)
            tos.append(str(digit))
        elif base[0] < "\x80" and all(unicodedata.combining(x) for x in base[1:]):
            froms.append(ch)
            tos.append(base[0])
    return "".join(froms), "".join(tos)


#: Stands for the a that a Devanagari letter carries until a sign replaces it.
MARK = "\x01"
DEVANAGARI, SIGNS = _devanagari()
FURTHER = _one_letter()


def ascii_of(c: Column) -> Column:
    """Null to '', Latin accents removed, Devanagari spelt out; native, and only texts beyond Latin-1 pay for it.

    Signs of other scripts stay; cleaning turns them into spaces.
    """
    text = F.coalesce(c, F.lit(""))
    spelt = F.translate(F.translate(text, ACCENTED, PLAIN), *FURTHER)
    for ch, sound in DEVANAGARI.items():
        spelt = F.replace(spelt, F.lit(ch), F.lit(sound))
    for ch, sound in SIGNS.items():
        spelt = F.replace(F.replace(spelt, F.lit(MARK + ch), F.lit(sound)), F.lit(ch), F.lit(sound))
    spelt = F.replace(spelt, F.lit(MARK), F.lit("a"))
    return F.when(text.rlike(r"[^\x00-\xFF]"), F.when(text.rlike(r"[\u0900-\u097F]"), spelt).otherwise(F.translate(F.translate(text, ACCENTED, PLAIN), *FURTHER))).otherwise(plain(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def lookup(c: Column, words: dict[str, str]) -> Column:
    """The word a dictionary gives, else the word. A hash set decides first; only its members search the map."""
    entries = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.when(c.isin(list(words)), F.try_element_at(entries, c)).otherwise(c)


def fix_name_token(t: Column) -> Column:
    """Digits typed for letters repaired (one or two digits, three letters or more, no ordinal), then the canonical word."""
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    wrong = digits.between(1, 2) & (F.length(t) - digits >= 3) & ~t.rlike(r"^\d+(st|nd|rd|th)$")
    return lookup(F.when(wrong, F.translate(t, *LEET)).otherwise(t), NAME_CANON)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def clean_names(df: DataFrame, name: str = "business_name") -> DataFrame:
    """Adds name_c, name_pre_c, name_post_c, is_web, has_alias."""
    raw = F.trim(F.lower(ascii_of(F.col(name))))
    x = df.withColumn("_raw", raw).withColumn("is_web", F.col("_raw").rlike(WEB))
    x = x.withColumn("_raw", F.when(F.col("is_web"), F.replace(F.regexp_extract("_raw", WEB, 1), F.lit("-"), F.lit(" "))).otherwise(F.col("_raw")))
    c = F.regexp_replace(F.replace(F.regexp_replace("_raw", r"\bid\s*[:#]?\s*\d+", " "), F.lit("&"), F.lit(" and ")), r"[.']", "")
    x = x.withColumn("_c", F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " ")))
    return x.withColumns(
        {
            "has_alias": F.col("_c").rlike(ALIAS),
            "name_pre_c": F.trim(F.regexp_extract("_c", r"^(.*?)\s*" + ALIAS, 1)),
            "name_post_c": F.trim(F.regexp_extract("_c", ALIAS + r"\s*(.*)$", 1)),
            "name_c": squeeze(F.regexp_replace("_c", ALIAS, " ")),
        }
    ).drop("_raw", "_c")


def clean_address(c: Column) -> Column:
    a = F.lower(ascii_of(c))
    a = F.regexp_replace(F.regexp_replace(a, MISSING, " "), r"p\.?\s?o\.?\s?box", " pobox ")
    a = F.regexp_replace(F.regexp_replace(a, r"(\d+)(?:st|nd|rd|th)\b", "$1"), r"[^a-z0-9]+", " ")
    a = F.regexp_replace(F.regexp_replace(a, r"(\d)([a-z])", "$1 $2"), r"([a-z])(\d)", "$1 $2")
    # one search tells which texts have any of them; as an array's element the text so far is made once
    each = lambda x: reduce(lambda e, kv: F.regexp_replace(e, rf"\b{kv[0]}\b", kv[1]), MULTI_WORD.items(), x)
    a = F.transform(F.array(a), lambda x: F.when(x.rlike(rf"\b(?:{'|'.join(MULTI_WORD)})\b"), each(x)).otherwise(x))[0]
    return squeeze(F.regexp_replace(a, r"\b0+(\d)", "$1"))


def map_tokens(toks: Column, word, aliases: Column | None = None) -> Column:
    """Each token through ``word``, then through a map of learned aliases."""
    fixed = F.transform(toks, word)
    return F.transform(fixed, lambda t: F.coalesce(F.try_element_at(aliases, t), t)) if aliases is not None else fixed


def alias_map(table: DataFrame, out: str) -> DataFrame:
    """country, map of the country's aliases (country, tok, to): one row a country."""
    return table.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("tok", "to"))).alias(out))


def normalize(records: DataFrame, name_alias: DataFrame | None = None, addr_alias: DataFrame | None = None) -> DataFrame:
    """records (…, country, business_name, business_address) -> normalised columns in place of the raw two."""
    x = clean_names(records).withColumn("_a", clean_address(F.col("business_address")))
    maps: dict[str, Column | None] = {"name": None, "addr": None}
    for side, table in (("name", name_alias), ("addr", addr_alias)):
        if table is not None:
            x = x.join(F.broadcast(alias_map(table, f"_{side}_map")), "country", "left")
            maps[side] = F.coalesce(F.col(f"_{side}_map"), F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"))
    name = lambda c: F.array_join(map_tokens(tokens(F.col(c)), fix_name_token, maps["name"]), " ")
    x = x.withColumns(
        {
            "name_n": name("name_c"),
            "name_alt": name("name_post_c"),
            "name_pre": name("name_pre_c"),
            "addr_n": F.array_join(map_tokens(tokens(F.col("_a")), lambda t: lookup(t, ADDRESS_WORDS), maps["addr"]), " "),
        }
    )
    core = F.array_join(F.filter(tokens(F.col("name_n")), lambda t: ~t.isin(LEGAL)), " ")
    x = x.withColumn("name_core", F.when(core == "", F.col("name_n")).otherwise(core))
    return x.withColumns(
        {
            "name_nosp": F.replace("name_core", F.lit(" "), F.lit("")),
            "nums": F.array_distinct(F.filter(tokens(F.col("addr_n")), lambda t: t.rlike(r"^\d+$"))),
            "has_addr": F.col("addr_n") != "",
            "non_ascii": F.coalesce("business_name", F.lit("")).rlike(r"[^\x00-\x7F]"),
        }
    ).drop("business_name", "business_address", "name_c", "name_pre_c", "name_post_c", "_a", "_name_map", "_addr_map")
