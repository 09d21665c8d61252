"""Text functions on balloon texts, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.profile import let

#: Words that name a sound.
SOUND_WORDS = (
    "BOOM", "BAM", "POW", "CRASH", "BANG", "WHAM", "ZAP", "ZING", "KABOOM", "KAPOW", "BLAM", "KA-BOOM",
    "KA-POW", "SMASH", "THUD", "THUMP", "CLUNK", "CLANK", "RATTLE", "SHAKE", "CLANG", "RING", "DING", "DONG",
    "BONG", "BONK", "SWOOSH", "WHOOSH", "VROOM", "SNAP", "CRACK", "POP", "SPLAT", "SPLASH", "DRIP", "DROP",
    "ROAR", "GROWL", "HISS", "BUZZ", "WHIR", "CRUNCH", "CHOMP", "MUNCH", "SLURP", "GULP", "FIZZ", "BOING",
    "AH", "OH", "EH", "UH", "HUH", "HA", "HEH", "HEE", "EEK", "GASP", "PANT", "WHEE", "ZZZ", "ZZ", "Z",
    "SCREAM", "SHOUT", "YELL", "WHISPER", "MUMBLE", "SIGH", "SNIFF", "COUGH", "SNEEZE", "GRUNT",
)
#: Words that may be said twice in a row.
REPEATABLE_WORDS = (
    "yes", "no", "yeah", "nope", "hey", "hi", "ok", "okay", "oh", "ah", "ha", "ho", "wow", "please", "stop",
    "wait", "help", "run", "come", "go", "now", "never", "more", "very", "so", "well", "hello", "bye",
    "sorry", "si", "ehi", "ciao", "dai", "presto", "aiuto", "forza", "basta", "fermo", "ferma", "vai",
    "corri", "subito", "mai", "piu", "molto", "certo", "davvero", "scusa", "grazie",
)
#: Language names in cache keys.
CACHE_LANGUAGES = {"en": "English", "fr": "French", "it": "Italian"}
#: Fixed patterns, applied in this order by ``clean``; word borders are those of Unicode.
URL = r"(?iU)\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^\s]*)?\b|https?://[^\s]+|www\.[^\s]+"
EMAIL = r"(?U)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?U)\b\d{3,}[-\s]?\d{3,}[-\s]?\d{3,}\b"
PAGE_NUMBER = r"(?iU)\b(?:pag\.?\s*)?\d{1,4}\b"
#: White space of any script, and the four separators below it.
WHITE = r"[\s\x1C-\x1F]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"(?U)^{WHITE}+|{WHITE}+$", "")


def words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(text, f"(?U){WHITE}+"), lambda w: w != "")


def clean(text: Column) -> Column:
    """Drop addresses, phone numbers and page numbers, and collapse white space."""
    for pattern in (URL, EMAIL, PHONE, PAGE_NUMBER):
        text = F.regexp_replace(text, pattern, "")
    return strip(F.regexp_replace(text, f"(?U){WHITE}+", " "))


def is_sound_effect(text: Column) -> Column:
    """A sound word, alone or with an exclamation mark; or a short shout with a letter three times in a row.

    A null or empty text counts as one.
    """
    said = F.upper(strip(text))
    named = said.isin(*SOUND_WORDS) | said.rlike(f"^(?:{'|'.join(SOUND_WORDS)})!")
    stretched = ~said.rlike(r"[\p{Ll}\p{Lt}]") & (F.char_length(said) <= 8) & said.rlike(r"([A-Z])\1{2,}")
    return F.coalesce((text == "") | named | stretched, F.lit(True))


def is_shout(text: Column) -> Column:
    return text.rlike(r"[!?]{2,}")


def normalize_ellipsis(text: Column) -> Column:
    return F.regexp_replace(text, r"\.{3,}", "…")


def is_all_caps(text: Column) -> Column:
    """Some letter, and all of them upper case; letters without case are not."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def doubled_words(text: Column) -> Column:
    """Pairs of equal neighbours without a pause between them, lower-cased."""
    # The letters of all words in one pass: words hold no white space, so line breaks keep them apart.
    bared = lambda found: F.split(F.lower(F.regexp_replace(F.array_join(found, "\n"), r"(?U)[^\w\n]", "")), "\n")

    def pairs(found, bare):
        rest = F.greatest(F.size(found) - 1, F.lit(0))
        beside = F.zip_with(F.slice(bare, 1, rest), F.slice(bare, 2, rest), lambda a, b: F.when(a == b, a))
        both = F.zip_with(beside, F.slice(found, 1, rest), lambda same, said: F.struct(same.alias("same"), said.alias("said")))
        return F.filter(both, lambda p: F.coalesce((p["same"] != "") & ~p["same"].isin(*REPEATABLE_WORDS), F.lit(False)) & ~p["said"].rlike(r"[,.;:!?…—-]$"))

    doubled = let(words(text), lambda found: let(bared(found), lambda bare: pairs(found, bare)))
    return F.transform(doubled, lambda p: p["same"])


def is_overlong(text: Column, area: Column | None = None) -> Column:
    """More letters than a balloon of this area (or a small one) can hold."""
    most = F.lit(250) if area is None else F.greatest(F.lit(250), F.floor(area / 600))
    return F.char_length(text) > most


@F.pandas_udf(T.DoubleType())
def zlib_ratio(texts: pd.Series) -> pd.Series:
    """Compressed bytes per character; one for texts below 20 characters, which are not judged."""
    import zlib

    return texts.map(lambda t: len(zlib.compress(t.encode())) / len(t) if t and len(t) >= 20 else 1.0)


def is_degenerate(text: Column, area: Column | None = None) -> Column:
    """Model output that is too long, compresses too well, or doubles words."""
    return is_overlong(text, area) | (zlib_ratio(text) < 0.35) | (F.size(doubled_words(text)) > 0)


def cache_key(source: Column, target: Column, text: Column) -> Column:
    return F.sha2(F.concat(source, F.lit(":"), target, F.lit(":"), text), 256)


def language_name(code: Column, names: dict = CACHE_LANGUAGES) -> Column:
    """The name of a language code; an unknown one passes through."""
    found = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(found, code), code)


def trim_reply(text: Column) -> Column:
    """A model's reading without quotes, back-quotes and line breaks, cleaned."""
    return clean(F.regexp_replace(F.regexp_replace(text, r"^[\"'`\s]+|[\"'`\s]+$", ""), r"\n", " "))


def tagged_lines(reply: Column) -> Column:
    """``array<struct<id, text>>`` from lines ``[balloon N] text``."""
    pattern = r"(?m)^\[balloon\s+(\d+)\]\s*(.*)$"
    ids = F.regexp_extract_all(reply, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(reply, F.lit(pattern), F.lit(2))
    return F.zip_with(ids, texts, lambda i, t: F.struct(i.cast("int").alias("id"), strip(t).alias("text")))


def prompt_line(balloon_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[balloon "), balloon_id.cast("string"), F.lit("] "), strip(text))


def shorter_reply(reply: Column, current: Column) -> Column:
    """First line of a reply that is not blank, without quotes and label, in the case of ``current``."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(x, r"^[\s\"]+|[\s\"]+$", ""))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"(?i)^(traduzione|versione corta|testo)\s*:\s*", ""))
    first = F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))
    upper = F.regexp_count(current, F.lit(r"\p{Lu}")) > 0.8 * F.regexp_count(current, F.lit(r"\p{L}"))
    return F.when(upper, F.upper(first)).otherwise(first)


def review_status(original: Column, translated: Column) -> Column:
    """discarded, to translate, sound effect or ok."""
    original, translated = F.coalesce(original, F.lit("")), F.coalesce(translated, F.lit(""))
    return (
        F.when((original == "") & (translated == ""), "discarded").when(translated == "", "to translate")
        .when(translated == "-", "sound effect").otherwise("ok")
    )


def html_texts(html: Column) -> Column:
    """Texts between tags that are not blank."""
    return F.filter(F.regexp_extract_all(html, F.lit(r">([^<>]+)<"), F.lit(1)), lambda t: strip(t) != "")


def is_safe_component(name: Column) -> Column:
    return ~name.rlike(r"[/\\]|\.\.")


def positive_int(text: Column) -> Column:
    """A whole number above zero, else null."""
    n = strip(text).try_cast("int")
    return F.when(n > 0, n)
