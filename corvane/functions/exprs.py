"""Column expressions for semi-structured fields, names and texts. All run in the JVM.

VARIANT columns keep the type that a field has in each record: a missing field is
SQL NULL, a JSON null is a variant null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as Python's str.strip() and \s see it.
UNICODE_SPACE = r"(?U)[\s\x1C-\x1F]"


def kind(v: Column) -> Column:
    """'NULL', 'BOOLEAN', 'BIGINT', 'DECIMAL(..)', 'DOUBLE', 'STRING', 'OBJECT<..>', 'ARRAY<..>' or SQL NULL."""
    k = F.schema_of_variant(v)
    return F.when(k == "VOID", F.lit("NULL")).otherwise(k)


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def is_integer(v: Column) -> Column:
    """A JSON integer; not a boolean and not a number with a fraction or exponent."""
    return F.coalesce(kind(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))


def is_number(v: Column) -> Column:
    return is_integer(v) | F.coalesce(kind(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def text_of(v: Column) -> Column:
    """The string of a JSON scalar; objects and arrays as JSON; null for nulls."""
    return F.when(F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def is_empty(v: Column) -> Column:
    """Missing, null, "", [] or {}; 0 and false are not empty, and neither is the string "[]"."""
    blank = F.when(is_string(v), F.try_variant_get(v, "$", "string") == "").when(is_object(v) | is_array(v), F.to_json(v).isin("{}", "[]")).otherwise(F.lit(False))
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True)) | F.coalesce(blank, F.lit(False))


def is_truthy(v: Column) -> Column:
    """What Python takes for true: not empty, not 0 and not false. The string "False" is true."""
    scalar = F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(is_number(v), F.try_variant_get(v, "$", "double") != 0).otherwise(F.lit(True))
    return ~is_empty(v) & F.coalesce(scalar, F.lit(False))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def to_bool(v: Column) -> Column:
    """A boolean, or "true" or "false" in any case between spaces; null for all else."""
    word = F.lower(strip(F.try_variant_get(v, "$", "string")))
    return F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(is_string(v) & word.isin("true", "false"), word == "true")


NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def number_text(s: Column) -> Column:
    """The number that a string spells, or null; 1_000 and .5 are numbers, 85d is none."""
    s = strip(s)
    plain = F.replace(s, F.lit("_"), F.lit(""))
    special = F.regexp_replace(F.lower(F.regexp_replace(s, r"^\+", "")), "^(-?)inf$", "$1infinity")
    return F.when(s.rlike(NUMBER), plain.try_cast("double")).when(s.rlike(SPECIAL), special.try_cast("double"))


def to_number(v: Column) -> Column:
    """A JSON number, or a string that spells one; booleans and all else give null."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double")).when(is_string(v), number_text(F.try_variant_get(v, "$", "string")))


def is_numeric(v: Column) -> Column:
    return to_number(v).isNotNull()


def to_int(v: Column) -> Column:
    """An integer, or a string or number that spells one; "12.5" gives null."""
    s = strip(F.try_variant_get(v, "$", "string"))
    return F.when(s.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("long"))


def first_present(v: Column, paths: list[str], kind: str = "long") -> Column:
    """The first path that exists at all; a null there does not fall through."""
    out = F.lit(None).cast(kind)
    for path in reversed(paths):
        field = F.try_variant_get(v, path, "variant")
        out = F.when(field.isNotNull(), F.try_variant_get(v, path, kind)).otherwise(out)
    return out


# --- names and paths ---


def normal_name(s: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def slug(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


def without_hashes(s: Column) -> Column:
    """Without the hexadecimal groups of 1 to 16 digits at its end."""
    return F.regexp_replace(s, "(?i)(-[0-9a-f]{1,16})+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(name: Column) -> Column:
    """The last dot and what follows; nothing for a leading or a final dot."""
    return F.regexp_extract(base_name(name), r"^.+(\.[^.]+)$", 1)


def decoded(path: Column) -> Column:
    """A path as it is spelled, from the encoded one that Spark tells."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def stem(name: Column) -> Column:
    name = base_name(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


VERSION = r"Version_\d{8}_\d{4}"


def version_stamp(path: Column) -> Column:
    """The first version folder's name in a path; null without one."""
    return F.nullif(F.regexp_extract(path, VERSION, 0), F.lit(""))


# --- numbers ---


def band(value: Column, low: float, high: float, bands: int) -> Column:
    """Number of the equal band of [low, high] that holds a value, cut at both ends."""
    return F.least(F.lit(bands - 1), F.greatest(F.lit(0), ((value - low) / ((high - low) / bands)).cast("int")))


def position_band(start: Column, length: Column) -> Column:
    """Fifth of the text in which something starts; null for empty texts."""
    return F.when((length > 0) & start.isNotNull(), F.least(F.lit(4), F.greatest(F.lit(0), (start / length * 5).cast("int"))))


#: Keyword distances by difficulty: lowest, highest, whether the highest belongs to it, and the number of bands.
KEYWORD_BANDS = {"easy": (0.0, 200.0, False, 4), "hard": (201.0, 300.0, True, 5)}


def keyword_band(difficulty: Column, distance: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (low, high, closed, bands) in KEYWORD_BANDS.items():
        inside = (distance >= low) & ((distance <= high) if closed else (distance < high))
        out = F.when((difficulty == name) & inside, band(distance, low, high, bands)).otherwise(out)
    return out


def grade(score: Column, strong: float, acceptable: float, weak: float) -> Column:
    return F.when(score.isNull(), "n/a").when(score >= strong, "strong").when(score >= acceptable, "acceptable").when(score >= weak, "weak").otherwise("critical")


#: Widths of histogram bins; beyond them, multiples of the last.
NICE_WIDTHS = (10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000)


def nice_width(span: Column, bins: int) -> Column:
    raw, last = span / bins, NICE_WIDTHS[-1]
    fitting = F.array_min(F.filter(F.lit(list(NICE_WIDTHS)), lambda w: w >= raw))
    return F.coalesce(fitting.cast("long"), (last * F.greatest(F.lit(1), F.bround(raw / last))).cast("long"))


# --- texts ---


def evenly(items: Column, cap: int) -> Column:
    """At most cap items at equal steps over the whole array."""

    def of(held: Column) -> Column:  # as a lambda's argument the items are made once, not once for each pick
        at = lambda i: F.floor(i * (F.size(held) / cap)).cast("int") + 1
        picked = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.element_at(held, at(i)))
        return F.when(F.size(held) <= cap, held).otherwise(picked)

    return F.transform(F.array(items), of)[0]


SHINGLE_WORDS = 5
CAP = 150


def shingles(text: Column, cap: int | None = CAP) -> Column:
    """Distinct shingles of five [a-z0-9] words; a shorter text is one; no word, none."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    held = F.array(F.struct(words.alias("w")))

    def of(h: Column) -> Column:
        n = F.size(h["w"])
        listed = F.transform(F.sequence(F.lit(1), n - SHINGLE_WORDS + 1), lambda i: F.array_join(F.slice(h["w"], i, SHINGLE_WORDS), " "))
        whole = F.when(n == 0, F.array().cast("array<string>")).when(n < SHINGLE_WORDS, F.array(F.array_join(h["w"], " ")))
        return F.array_distinct(whole.otherwise(listed if cap is None else evenly(listed, cap)))

    return F.transform(held, of)[0]


def assessable_words(text: Column, planted: Column) -> Column:
    """Words fit for a guess at the language: no addresses, planted values, acronyms or single letters."""
    plain = F.regexp_replace(text, r"\S*(?:https?://|www\.|@)\S*", " ")
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    return evenly(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(planted, w) & ~w.rlike("^[A-Z]{2,}$")), CAP)


# Frequent short words of each language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that"], "de": ["der", "die", "und", "in", "den", "von", "zu"],
    "fr": ["de", "la", "le", "et", "les", "des", "en"], "es": ["de", "la", "que", "el", "en", "y", "los"],
}


def guessed_language(words: Column) -> Column:
    """The language of STOP_WORDS that has most of the words; the first one of equals; null if none has any."""
    among = lambda known: F.size(F.filter(words, lambda x: F.lower(x).isin(known)))
    hits = F.array(*[F.struct(among(known).alias("n"), F.lit(-i).alias("early"), F.lit(lang).alias("lang")) for i, (lang, known) in enumerate(STOP_WORDS.items())])
    return F.transform(F.array(F.array_max(hits)), lambda best: F.when(best["n"] > 0, best["lang"]))[0]


def tolerant_pattern(value: Column) -> Column:
    """A pattern for the value with an optional separator between its characters."""
    return F.array_join(F.transform(F.split(value, "(?<=.)(?=.)|(?<=\n)"), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), r"[\s\-.]?")


def unseparated(text: Column) -> Column:
    """A text without the separators that tolerant_pattern() lets through."""
    return F.translate(text, " \t\n\x0b\f\r-.", "")


def find_span(text: Column, value: Column) -> Column:
    """struct(start, length) of a value in a text, or null: as it is, else, up to 40 characters, with separators.

    What the pattern finds is there without separators too, which is one plain search; only then is the pattern made, to tell the place.
    """
    exact = F.instr(text, value)
    near = F.when((F.length(value) <= 40) & (exact == 0) & F.contains(unseparated(text), unseparated(value)), F.regexp_substr(text, tolerant_pattern(value)))
    found = F.when(exact > 0, value).otherwise(near)
    return F.when((F.length(value) > 0) & found.isNotNull(), F.struct((F.instr(text, found) - 1).alias("start"), F.length(found).alias("length")))


def observed_label(text: Column, start: Column) -> Column:
    """The last four words, in lower case, before a place in its line or sentence; null without any."""
    low = F.greatest(F.lit(0), start - 80)
    window = F.substring(text, low + 1, start - low)
    window = F.regexp_replace(window, r"(?s)^.*(?:\n|(?<=[.!?])\s)", "")
    window = F.regexp_replace(window, "^[ \\t:\u2013-]+|[ \\t:\u2013-]+$", "")
    words = F.filter(F.split(window, f"{UNICODE_SPACE}+"), lambda w: w != "")
    last = F.slice(words, F.greatest(F.lit(1), F.size(words) - 3), F.lit(4))
    label = F.lower(F.regexp_replace(F.array_join(last, " "), "^[ :,-]+|[ :,-]+$", ""))
    return F.nullif(label, F.lit(""))


def proximity_window(text: Column, start: Column, length: Column, distance: Column, direction: Column) -> Column:
    """Where a keyword is looked for: the distance and 60 more characters, 250 at least, on the side named or both."""
    width = F.greatest(F.lit(250), F.coalesce(distance, F.lit(0)) + 60).cast("int")
    low = F.greatest(F.lit(0), start - width)
    side = F.lower(strip(F.coalesce(direction, F.lit(""))))
    end = start + length
    return (
        F.when(side == "before", F.substring(text, low + 1, start - low))
        .when(side == "after", F.substring(text, end + 1, width))
        .otherwise(F.substring(text, low + 1, end + width - low))
    )


def sentence_context(text: Column, start: Column, length: Column) -> Column:
    """struct(before, current, after): the sentence around a place and its neighbours."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("hit"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s)
        hit = F.when((acc["hit"] < 0) & (acc["at"] <= start) & (start <= end), acc["n"]).otherwise(acc["hit"])
        return F.struct((end + 1).alias("at"), (acc["n"] + 1).alias("n"), hit.alias("hit"))

    hit = F.aggregate(parts, first, step, lambda acc: acc["hit"])
    held = F.array(F.struct(parts.alias("p"), hit.alias("hit")))

    def pick(h: Column) -> Column:
        item = lambda d: F.coalesce(F.when((h["hit"] + d >= 0), strip(F.get(h["p"], h["hit"] + d))), F.lit(""))
        low = F.greatest(F.lit(0), start - 150)
        none = F.struct(F.substring(text, low + 1, start - low).alias("before"), F.substring(text, start + 1, length).alias("current"), F.substring(text, start + length + 1, F.lit(150)).alias("after"))
        return F.when(h["hit"] < 0, none).otherwise(F.struct(item(-1).alias("before"), item(0).alias("current"), item(1).alias("after")))

    return F.transform(held, pick)[0]
