"""Record text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The word lists below must equal those of the pipeline whose results are matched.
LEGAL_FORMS = ["inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "pllc", "pc", "ltd", "limited", "pvt", "private", "sarl", "sas", "sasu", "eurl", "sci", "sa", "ets", "etablissements", "cie", "opc", "plc"]
FUNCTION_WORDS = ["and", "the", "of", "de", "la", "le", "les", "du", "des", "d", "l", "et", "www", "com", "net", "org"]
DOTTED_FORMS = {"l l c": "llc", "p l l c": "pllc", "l l p": "llp", "s a r l": "sarl", "e u r l": "eurl", "s a s u": "sasu", "s a s": "sas", "s c i": "sci"}
ADDRESS_ABBREVIATIONS = {
    "road": "rd", "street": "st", "saint": "st", "avenue": "av", "ave": "av", "boulevard": "blvd", "bd": "blvd", "drive": "dr", "lane": "ln", "rue": "r", "court": "ct", "highway": "hwy",
    "parkway": "pkwy", "circle": "cir", "place": "pl", "square": "sq", "terrace": "ter", "trail": "trl", "route": "rte", "suite": "ste", "apartment": "apt", "appt": "apt", "appartement": "apt",
    "floor": "fl", "flr": "fl", "building": "bldg", "north": "n", "south": "s", "east": "e", "west": "w", "allee": "all", "impasse": "imp", "chemin": "ch",
}
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl",
    "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
IN_STATES = {
    "maharashtra": "mh", "delhi": "dl", "uttar pradesh": "up", "karnataka": "ka", "tamil nadu": "tn", "west bengal": "wb", "gujarat": "gj", "telangana": "tg", "haryana": "hr", "rajasthan": "rj",
    "kerala": "kl", "keralam": "kl", "madhya pradesh": "mp", "bihar": "br", "andhra pradesh": "ap", "punjab": "pb", "odisha": "od", "orissa": "od", "goa": "ga", "assam": "as", "jharkhand": "jh",
    "chhattisgarh": "cg", "uttarakhand": "uk", "himachal pradesh": "hp", "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py",
}
NATIVE_STATES = {
    "महाराष्ट्र": "maharashtra", "दिल्ली": "delhi", "उत्तर प्रदेश": "uttar pradesh", "ಕರ್ನಾಟಕ": "karnataka", "தமிழ்நாடு": "tamil nadu", "পশ্চিমবঙ্গ": "west bengal", "ગુજરાત": "gujarat", "తెలంగాణ": "telangana",
    "हरियाणा": "haryana", "राजस्थान": "rajasthan", "കേരളം": "kerala", "बिहार": "bihar", "मध्य प्रदेश": "madhya pradesh", "ఆంధ్రప్రదేశ్": "andhra pradesh", "ਪੰਜਾਬ": "punjab", "ଓଡ଼ିଶା": "odisha",
}
FALLBACK_FIXES = {"praivet": "private", "praibhet": "private", "piraivet": "private", "praivrr": "private", "pra": "private", "limitet": "limited", "limirrd": "limited", "limtid": "limited", "li": "limited", "elelpi": "llp"}
NULL_PLACEHOLDERS = r"(?i)(?:\bnull\b|\bn/a\b)"
ALIAS = r"\b(?:d\s*b\s*a|dba|aka|fka|t\s+a|doing business as|formerly)\b"
DOMAIN = r"\b(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9.-]*\.[a-z]{2,12})(?:[/\s]|$)"
TOP_LEVEL = r"\.(?:co\.in|co\.uk|com\.au|com|net|org|in|fr|us|[a-z]{2,12})$"
HOUSE = r"^\s*(?:(?:plot|house|door|h)\s*[.\s]*(?:no\.?\s*)?|no\.?\s*|n[°º]\s*|#\s*)?([a-z]?-?\d+[a-z]?(?:[/-]\d+[a-z]?)*)(?:\s+(bis|ter)\b)?(?=\s|[,.;:]|$)"
UNIT = r"\b(?:suite|ste|unit|apt|apartment|flat|shop)\s*(?:no[.\s]*)?([a-z0-9][a-z0-9/-]*)"
FLOOR = r"\b(\d+)(?:st|nd|rd|th)?\s*(?:floor|fl)\b|\b(?:floor|fl)\s*(\d+)"
JOINERS = "\u200b\u200c\u200d\u2060\ufeff"
TOKEN = r"[^\s,;:()\[\]{}|<>\"]+"
NUMBER_MARK = r"^(?:n°|nº|no\.?)(\d)"
INDIC = r"[\x{0900}-\x{0DFF}]"
# End of the fixed values.


def squeeze(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC, zero-width characters deleted, Latin accents folded, NFC. Spark has no builtin for these forms."""

    def one(t: str | None) -> str:
        t = unicodedata.normalize("NFKC", t or "")
        t = "".join(ch for ch in t if ch not in JOINERS)
        t = unicodedata.normalize("NFKD", t)
        return unicodedata.normalize("NFC", "".join(ch for ch in t if not "̀" <= ch <= "ͯ"))

    return text.map(one)


def clean(c: Column) -> Column:
    """Lower case, & as "and", apostrophes deleted, other marks as spaces. Unicode forms are ``fold``'s."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    c = F.regexp_replace(c, "['’‘`´]", "")
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", " "))


def basic_clean(c: Column) -> Column:
    return clean(fold(c))


def tokens(c: Column) -> Column:
    """Words of cleaned text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def map_words(c: Column, mapping: dict[str, str]) -> Column:
    """Whole-word replacement, phrases longest first, then single words by lookup.

    Spaces are doubled while phrases are replaced, so two that stand side by
    side share none and both are met.
    """
    phrases = sorted((k for k in mapping if " " in k), key=lambda k: (-len(k), k))
    if phrases:
        c = F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))
        for phrase in phrases:
            c = F.replace(c, F.lit(f" {phrase.replace(' ', '  ')} "), F.lit(f" {mapping[phrase]} "))
        c = squeeze(c)
    single = [F.lit(x) for k, v in mapping.items() if " " not in k for x in (k, v)]
    if not single:
        return c
    table = F.create_map(*single)
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def strip_legal(c: Column) -> Column:
    """Dotted forms joined, legal forms and function words dropped; the text itself if nothing remains."""
    joined = map_words(c, DOTTED_FORMS)
    drop = F.array(*[F.lit(w) for w in LEGAL_FORMS + FUNCTION_WORDS])
    kept = F.array_join(F.filter(F.split(joined, " "), lambda t: ~F.array_contains(drop, t)), " ")
    return F.when(kept == "", c).otherwise(kept)


def states_and_streets(c: Column) -> Column:
    """State names to codes, then street abbreviations (so "west bengal" goes before "west")."""
    return map_words(map_words(c, {**US_STATES, **IN_STATES}), ADDRESS_ABBREVIATIONS)


def no_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, NULL_PLACEHOLDERS, " ")


def number_tokens(c: Column) -> Column:
    """Sorted distinct tokens with a digit: edges stripped, number marks and leading zeros gone."""
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), NUMBER_MARK, "$1")
    found = F.regexp_extract_all(_raw(c), F.lit(TOKEN), F.lit(0))
    kept = F.transform(F.filter(found, lambda t: t.rlike(r"\d")), lambda t: F.regexp_replace(bare(t), r"\b0+(\d)", "$1"))
    return F.array_sort(F.array_distinct(F.filter(kept, lambda t: t.rlike(r"\d"))))


def nonlatin(c: Column) -> Column:
    """A letter of a script other than Latin occurs."""
    return F.coalesce(c, F.lit("")).rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]")


def domain_stem(c: Column) -> Column:
    """First domain without www and top level, marks as spaces."""
    found = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), DOMAIN, 1)
    stem = F.regexp_replace(F.regexp_replace(found, r"^www\.", ""), TOP_LEVEL, "")
    return squeeze(F.regexp_replace(stem, "[^a-z0-9]", " "))


def aliases(c: Column) -> Column:
    """Names around "dba", "aka" and the like, legal words dropped; none unless there are two."""
    sides = F.split(c, ALIAS)
    drop = F.array(*[F.lit(w) for w in LEGAL_FORMS + FUNCTION_WORDS])
    named = F.filter(F.transform(sides, lambda s: F.array_join(F.filter(F.split(F.trim(s), " "), lambda t: (t != "") & ~F.array_contains(drop, t)), " ")), lambda s: s != "")
    return F.when(F.size(sides) > 1, named).otherwise(F.array().cast("array<string>"))


def _raw(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC alone, so that full-width and raised digits are digits."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t or ""))


def number_views(address: Column) -> dict[str, Column]:
    """House, unit, floor and whether a house was read, from the NFKC form of a raw address."""
    c = compatible(address)
    return {"house": house(c), "unit": unit(c), "floor": floor_number(c), "house_parsed": (house(c) != "").cast("int")}


def house(c: Column) -> Column:
    """House number at the start of an address, bis or ter appended."""
    return F.concat(F.regexp_extract(_raw(c), HOUSE, 1), F.regexp_extract(_raw(c), HOUSE, 2))


def unit(c: Column) -> Column:
    """Unit number, where it has a digit."""
    found = F.regexp_extract(_raw(c), UNIT, 1)
    return F.when(found.rlike(r"\d"), found).otherwise("")


def floor_number(c: Column) -> Column:
    """Floor number, before or after its word."""
    return F.concat(F.regexp_extract(_raw(c), FLOOR, 1), F.regexp_extract(_raw(c), FLOOR, 2))


def native_states() -> dict[str, str]:
    """The native state names as cleaned text holds them."""
    return {unicodedata.normalize("NFC", "".join(ch for ch in k if ch not in JOINERS)): v for k, v in NATIVE_STATES.items()}


def to_latin(texts: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    """``column`` with every token in an Indic script replaced by its word in ``dictionary`` (token, latin), else by generic romanisation.

    Only distinct Indic tokens are romanised, and only rows that hold one are
    shuffled; tokens that leave nothing are dropped.
    """
    plain = texts.where(~F.coalesce(F.col(column).rlike(INDIC), F.lit(False)))
    rows = texts.where(F.col(column).rlike(INDIC)).withColumn("_row", F.struct(*texts.columns))
    words = rows.select("_row", F.posexplode(F.split(column, " ")).alias("_at", "token"))
    native = words.where(F.col("token").rlike(INDIC)).select("token").distinct()
    known = dictionary.select("token", "latin") if dictionary is not None else native.select("token", F.lit(None).cast("string").alias("latin")).limit(0)
    table = native.join(known, "token", "left").select("token", F.coalesce(F.nullif("latin", F.lit("")), romanise(F.col("token"))).alias("_new"))
    joined = words.join(table, "token", "left").withColumn("_new", F.coalesce("_new", "token")).where("_new <> ''")
    back = joined.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_new"))), lambda x: x._new), " ").alias("_text"))
    found = rows.select("_row").distinct().join(back, "_row", "left").select(*[(F.coalesce("_text", F.lit("")) if c == column else F.col(f"_row.{c}")).alias(c) for c in texts.columns])
    return plain.unionByName(found)


def coverage(texts: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """One row: Indic token occurrences, and the share of them that ``dictionary`` knows."""
    words = texts.select(F.explode(F.split(column, " ")).alias("token")).where(F.col("token").rlike(INDIC)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = words.join(dictionary.select("token", F.lit(1).alias("_k")).distinct(), "token", "left")
    return known.agg(F.sum("n").alias("occurrences"), F.try_divide(F.sum(F.when(F.col("_k") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("known_share"))


def normalise(records: DataFrame, dictionary: DataFrame | None = None, romanised: bool = False) -> DataFrame:
    """The whole record normaliser: entity_id, source, country and the derived texts.

    Indic words become Latin where a ``dictionary`` is given or ``romanised`` is set.
    """
    raw = no_placeholders(F.coalesce("business_address", F.lit("")))
    out = records.withColumns({"name_cons": basic_clean(F.col("business_name")), "_clean": map_words(basic_clean(raw), native_states()), "addr_nums": number_tokens(raw), "name_nonlatin": nonlatin(F.col("business_name"))})
    out = out.drop("business_name", "business_address")
    if dictionary is not None or romanised:
        out = to_latin(to_latin(out, "name_cons", dictionary), "_clean", dictionary)
    out = out.withColumns({"name_red": strip_legal(F.col("name_cons")), "addr_norm": states_and_streets(F.col("_clean"))}).drop("_clean")
    return out.withColumns({"addr_missing": F.col("addr_norm") == "", "retrieval_text": squeeze(F.concat_ws(" ", "name_red", "addr_norm"))})


def _roman(token: str) -> str:
    """Romanise Indic letters: the scripts' blocks of 128 share one order, so one row of values serves all."""
    consonants = dict(zip(range(0x15, 0x3A), "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(), strict=True))
    vowels = dict(zip(range(0x05, 0x15), "a a i i u u r l e e e ai o o o au".split(), strict=True))
    signs = dict(zip(range(0x3E, 0x4D), "a i i u u r r e e e ai o o o au".split(), strict=True))
    out, bare = [], False
    for ch in token:
        at = ord(ch)
        k = (at - 0x900) % 0x80 if 0x900 <= at <= 0xDFF else -1
        if k in consonants:
            out.append(("a" if bare else "") + consonants[k])
            bare = True
        elif k in signs or k == 0x4D:
            out.append(signs.get(k, ""))
            bare = False
        elif k in vowels:
            out.append(("a" if bare else "") + vowels[k])
            bare = False
        elif k in (0x01, 0x02):
            out.append("am" if bare else "m")
            bare = False
        else:
            if k >= 0x66 and k <= 0x6F:
                ch = str(k - 0x66)
            out.append(ch)
            bare = False
    ascii_only = unicodedata.normalize("NFKD", "".join(out)).lower()
    return "".join(ch for ch in ascii_only if ch in "abcdefghijklmnopqrstuvwxyz0123456789")


@F.pandas_udf(StringType())
def romanise(token: pd.Series) -> pd.Series:
    """Generic romanisation with the fixed fallback spellings and a final mg as ng."""

    def one(t: str | None) -> str:
        r = _roman(t or "")
        r = FALLBACK_FIXES.get(r, r)
        return r[:-2] + "ng" if r.endswith("mg") else r

    return token.map(one)
