"""Names of entities and languages: word tokens, how well two names match, and what languages are called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about an entity.
STOP_WORDS = "sit definition and testdata test data combined v1 final spec".split()
# Words that many entities share.
GENERIC = "number card id license passport account registration identification national south north east west".split()
# Words for countries and regions. Names with different ones never match.
QUALIFIERS = """us usa uk eu canada china chinese japan japanese korea korean india indian mexico mexican brazil brazilian france french
germany german sweden swedish norway norwegian denmark danish finland finnish poland polish russia russian australia australian taiwan
taiwanese singapore singaporean ireland irish italy italian spain spanish netherlands dutch belgium belgian austria austrian switzerland
swiss portugal portuguese greece greek turkey turkish israel israeli saudi uae qatar egypt egyptian nigeria nigerian kenya kenyan
argentina argentine chile chilean colombia colombian peru peruvian vietnam vietnamese thailand thai malaysia malaysian indonesia
indonesian philippines filipino ukraine ukrainian africa african america american zealand newzealand hongkong hong scotland scottish
wales welsh hungary hungarian czech slovakia slovak slovenia slovenian croatia croatian serbia serbian romania romanian bulgaria
bulgarian estonia estonian latvia latvian lithuania lithuanian""".split()
# Languages by code.
LANGUAGES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish",
    "da": "Danish", "no": "Norwegian", "fi": "Finnish", "pl": "Polish", "ru": "Russian", "uk": "Ukrainian", "bg": "Bulgarian", "ro": "Romanian",
    "hu": "Hungarian", "cs": "Czech", "sk": "Slovak", "sl": "Slovenian", "hr": "Croatian", "sr": "Serbian", "et": "Estonian", "lv": "Latvian",
    "lt": "Lithuanian", "el": "Greek", "tr": "Turkish", "he": "Hebrew", "ar": "Arabic", "hi": "Hindi", "th": "Thai", "vi": "Vietnamese",
    "id": "Indonesian", "ms": "Malay", "zh": "Chinese", "zh-hans": "Chinese (Simplified)", "zh-hant": "Chinese (Traditional)", "ja": "Japanese",
    "ko": "Korean", "af": "Afrikaans", "sw": "Swahili", "zu": "Zulu", "fa": "Persian", "ur": "Urdu", "bn": "Bengali", "ta": "Tamil", "te": "Telugu",
    "mr": "Marathi", "gu": "Gujarati", "kn": "Kannada", "ml": "Malayalam", "pa": "Punjabi", "am": "Amharic", "ka": "Georgian", "hy": "Armenian",
    "az": "Azerbaijani", "kk": "Kazakh", "uz": "Uzbek", "mn": "Mongolian", "ne": "Nepali", "si": "Sinhala", "km": "Khmer", "lo": "Lao",
    "my": "Burmese", "is": "Icelandic", "ga": "Irish", "cy": "Welsh", "mt": "Maltese", "sq": "Albanian", "mk": "Macedonian", "bs": "Bosnian",
}
# Languages whose names the locales of reference material are compared by.
LOCALES = "en de es fr it ja pl ar zh cs fi sv pt nl ru ko hi tr no da ro hu el he th vi id uk bg sk sl hr sr".split()


def _holding(x: Column, of) -> Column:
    """of(x), with x worked out once however often it is used."""
    return F.transform(F.array(x), of)[0]


def tokens(name: Column) -> Column:
    """Distinct words of a name without stop words, and the initials of its words that aren't qualifiers, if they are 2 to 6."""
    words = F.filter(F.split(F.lower(F.replace(name, F.lit("."), F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))

    def of(held: Column) -> Column:
        plain = F.filter(held, lambda w: ~w.isin(QUALIFIERS))
        initials = F.array_join(F.transform(plain, lambda w: F.substring(w, 1, 1)), "")
        return F.array_distinct(F.concat(held, F.when(F.size(plain).between(2, 6), F.array(initials)).otherwise(F.array().cast("array<string>"))))

    return _holding(words, of)


def specific(words: Column) -> Column:
    """The words that tell entities apart: neither generic nor qualifiers."""
    return F.filter(words, lambda w: ~w.isin([*GENERIC, *QUALIFIERS]))


def match_score(a: Column, b: Column) -> Column:
    """Share of the shorter name's words that the other has; all are needed of up to two. 0 without a specific common word or if qualifiers differ.

    Of several qualifiers in a name the first by text counts.
    """
    mark = lambda words: F.array_min(F.filter(words, lambda w: w.isin(QUALIFIERS)))
    smaller = F.least(F.size(a), F.size(b))

    def of(common: Column) -> Column:
        part = F.when(smaller > 2, F.size(common) / smaller).otherwise((F.size(common) == smaller).cast("double"))
        return F.when((F.size(specific(common)) == 0) | F.coalesce(mark(a) != mark(b), F.lit(False)), 0.0).otherwise(part)

    return _holding(F.array_intersect(a, b), of)


def language_name(code: Column) -> Column:
    """English name of a language code; an unknown code stays."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(code))), F.trim(code))


def shown_language(code: Column) -> Column:
    """'EN - English'; an unknown code in upper case."""
    code, name = F.trim(code), language_name(code)
    return F.when(name == code, F.upper(code)).otherwise(F.concat(F.upper(code), F.lit(" - "), name))
