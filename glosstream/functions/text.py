"""Text functions as Column -> Column expressions; no Python runs per row.

Patterns that mean white space, digits or word characters in Unicode carry
``(?U)``: without it the JVM takes them as ASCII.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, spelling variants, affixes and patterns.
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
SCRIPTURE_MARKS = "[۝۞۩ﷺﷻ﷽ۖ-ۜ]"
PUNCTUATION = "[،؛؟٪-٭۔.,;:!?\"'«»﴿﴾()\\[\\]{}\\-–—…]"
SPELLING_FROM, SPELLING_TO = "أإآٱىؤئ", "اااايوي"
DAGGER = "ٰ"
PREFIXES = ("وبال", "فبال", "وال", "فال", "بال", "كال", "لل", "ال", "وب", "فب", "ول", "فل", "و", "ف", "ب", "ل", "ك")
PRONOUNS = ("هما", "كما", "ها", "هم", "هن", "كم", "كن", "نا", "ه", "ك")
ENDINGS = ("ا", "ات", "ون", "ين", "ان")
NARROW_DIACRITICS = "[ً-ْٰـ]"
SPEAKER_DIACRITICS = "[ً-ْٰـۖ-ۭ]"
LETTER_RANGES = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
ALLOWED_SIGNS = "[ﷺﷻﷲﷴﷳﷰﷱ﴾﴿۝،؛؟٪٫٬٠-٩]"
PRAYER = "(?U)صلى\\s+الله\\s+عليه\\s+وسلم"
ARABIC_SCRIPT_LANGUAGES = ("ur", "fa", "prs", "ps", "ug", "sd", "ks", "ku", "kmr", "ba", "bh", "rhg", "uzb_arab")
EDGE_PUNCTUATION = ".,،؛;:!?؟«»\"'()[]{}﴿﴾"
QUERY_SIGNS = "[*\"”“{}\\[\\]()﴿﴾؛:\\d،,.\u200c'\\-«»!؟?]"
EMOJI = "[\\x{1F000}-\\x{1FAFF}☀-➿⬀-⯿←-⇿\\x{FE0F}\\x{200D}⃣™ℹ]"
HASHTAG_LINE = "(?U)^(?:[#＃][^\\s#＃]+[\\s،,]*)+$"
RULE_LINE = "(?U)^[\\W_]{2,}$"

#: A word of white-space separated text; RE2 and the JVM agree on it.
ASCII_SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def strip(text: Column) -> Column:
    """All Unicode white space off both ends (``trim`` takes spaces only)."""
    return replace(text, "(?U)^\\s+|\\s+$")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(replace(text, "(?U)\\s+", " "))


def _bare(text: Column) -> Column:
    return replace(text, SCRIPTURE_MARKS[:-1] + DIACRITICS[1:])


def _signs(pattern: str) -> str:
    """The signs of a character class."""
    return "".join(c for c in map(chr, range(0x10000)) if re.match(pattern, c))


#: A translation is one look at each sign; a class of many signs asks for them one by one.
BARED, PARTED = _signs(SCRIPTURE_MARKS[:-1] + DIACRITICS[1:]), _signs(PUNCTUATION)


def _spelled(text: Column, old: str, new: str) -> Column:
    """Bare, in one spelling and without punctuation, words apart by one space."""
    return collapse(F.translate(text, old + PARTED + BARED, new + " " * len(PARTED)))


def light(text: Column) -> Column:
    """Without marks and diacritics; spelling stays."""
    return collapse(_bare(text))


def diacritic_density(text: Column) -> Column:
    """Diacritics for each other character of the Arabic block; 0 where there is none."""
    letters = F.regexp_count(replace(text, DIACRITICS), F.lit("[\u0600-\u06ff]"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(DIACRITICS)) / letters).otherwise(0.0)


def lexical(text: Column) -> Column:
    """Form for dictionary lookup: unified spelling, no punctuation; the feminine ending stays apart from the pronoun."""
    return _spelled(text, SPELLING_FROM, SPELLING_TO)


def normalize(text: Column) -> Column:
    """Form for matching: as :func:`lexical`, with both endings unified."""
    return _spelled(text, SPELLING_FROM + "ة", SPELLING_TO + "ه")


def words(text: Column) -> Column:
    """White-space separated words; none of an empty text."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    """As :func:`words`, of a text whose words are one space apart."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def tokens(text: Column) -> Column:
    return words(normalize(text))


def lexical_tokens(text: Column) -> Column:
    return words(lexical(text))


def expand_dagger(text: Column) -> Column:
    """Old spelling to new: the dagger alef, alone or after waw and yeh, and hamza with alef."""
    return replace(F.replace(replace(text, f"[وي]{DAGGER}", "ا"), F.lit(DAGGER), F.lit("ا")), "ءَ?ا", "ا")


def has_old_spelling(text: Column) -> Column:
    return text.contains(DAGGER) | text.contains("ء")


def split_vocative(text: Column) -> Column:
    """The joined vocative, after normalising, as two words."""
    return replace(text, "(?U)\\bياا?يها\\b", "يا ايها")


def ngrams(items: Column, n: int) -> Column:
    """Arrays of n consecutive items joined by a space; none if there are fewer."""
    size = F.size(items)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))


def places(items: Column) -> Column:
    """Places (from 0) of an array's items; none of null."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1))


def gram(items: Column, place: Column, n: int) -> Column:
    """The n items from a place on, joined by a space.

    At places that were exploded before this runs in generated code, which
    :func:`ngrams` with its lambda does not.
    """
    return F.concat_ws(" ", *(F.get(items, place + i) for i in range(n)))


def affix_forms(word: Column) -> Column:
    """Forms of a word with prefixes and suffixes off, the least reduced first, then by spelling."""
    prefixed = [F.when(word.startswith(p) & (F.length(word) - len(p) >= 3), F.substring(word, len(p) + 1, 1000)) for p in PREFIXES]
    bases = F.array_distinct(F.array_compact(F.array(word, *prefixed)))

    def stems(base: Column) -> Column:
        out = [base]
        for s in PRONOUNS + ENDINGS:
            fits = base.endswith(s) & (F.length(base) - len(s) >= 3)
            stem = F.substring(base, F.lit(1), F.length(base) - len(s))
            out.append(F.when(fits, stem))
            if s in PRONOUNS:
                head = F.substring(stem, F.lit(1), F.length(stem) - 1)
                out.append(F.when(fits & stem.endswith("ت"), F.concat(head, F.lit("ة"))))
                out.append(F.when(fits & stem.endswith("ا"), F.concat(head, F.lit("ي"))))
        return F.array_compact(F.array(*out))

    forms = F.array_distinct(F.flatten(F.transform(bases, stems)))
    keyed = F.transform(forms, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def expand_ligatures(text: Column) -> Column:
    """Spaces around honorific signs, none before punctuation, and no verse number before a closing bracket."""
    spaced = reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(f" {sign} ")), ("ﷺ", "ﷻ"), text)
    unnumbered = replace(spaced, "(?U)\\s*\\d+\\s*(?=﴾)")
    return strip(F.replace(replace(unnumbered, " +([،.:!؟»)\\]])", "$1"), F.lit("  "), F.lit(" ")))


def clean_noise(text: Column) -> Column:
    """Without emoji and doubled spaces; empty if only hashtags or rules are left."""
    bare = replace(strip(replace(text, EMOJI, " ")), "(?U)\\s{2,}", " ")
    return F.when(bare.rlike(HASHTAG_LINE) | bare.rlike(RULE_LINE), "").otherwise(bare)


def clean_translation(text: Column) -> Column:
    """Without a leading number and bracketed note numbers; one space between words and none before the final stop."""
    bare = replace(text, "(?U)^\\s*\\d+\\s*[.),:،]?\\s*")
    bare = replace(bare, "(?U)\\*?\\(\\d+\\)|\\[\\d+\\]|\\{\\d+\\}")
    return collapse(replace(bare, "(?U)\\s*\\.\\s*$", "."))


def audit_normalize(text: Column) -> Column:
    """The audit's own normal form; it differs from :func:`normalize` and must stay apart."""
    bare = replace(F.coalesce(text, F.lit("")), NARROW_DIACRITICS)
    bare = F.translate(bare, "إأآىة", "ااايه")
    return F.lower(collapse(replace(bare, "(?U)[^\\w\\s]", " ")))


def speaker_form(text: Column) -> Column:
    return replace(text, SPEAKER_DIACRITICS)


def anchor_key(text: Column) -> Column:
    """Without white space and guillemets, for finding footnote anchors."""
    return replace(text, "(?U)[\\s«»]")


def foreign_letters(text: Column) -> Column:
    """Arabic letters that a translation into another script should not hold; null counts as empty."""
    bare = replace(replace(replace(F.coalesce(text, F.lit("")), NARROW_DIACRITICS), ALLOWED_SIGNS), PRAYER)
    return F.array_join(F.regexp_extract_all(bare, F.lit(f"({LETTER_RANGES})")), "")


def is_arabic_script(iso: Column) -> Column:
    return F.lower(strip(F.coalesce(iso, F.lit("")))).isin(*ARABIC_SCRIPT_LANGUAGES)


def unbalanced(text: Column) -> Column:
    """Is a bracket left open, or closed without being open?  A fold over the characters; '!' marks the failure."""
    pairs = {"(": ")", "[": "]", "{": "}", "«": "»", "﴿": "﴾"}
    signs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([()\\[\\]{}«»﴿﴾])"))
    due = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))

    def step(stack: Column, sign: Column) -> Column:
        opened = F.concat(F.element_at(due, sign), stack)
        closed = F.when(F.substring(stack, 1, 1) == sign, F.substring(stack, 2, 1_000_000)).otherwise("!")
        return F.when(stack == "!", stack).when(sign.isin(*pairs), opened).otherwise(closed)

    return F.aggregate(signs, F.lit(""), step) != ""


def quoted_part(text: Column) -> Column:
    """What stands in verse brackets and has letters, joined; all of the text if there is none."""
    spans = F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?s)﴿(.+?)﴾")), strip), lambda s: s.rlike("[ء-يٱ]"))
    return F.when(F.size(spans) > 0, F.array_join(spans, " ")).otherwise(text)


def query_forms(text: Column) -> Column:
    """(light, normal, normal of the expanded spelling) of the quoted part without signs and digits."""
    part = replace(quoted_part(text), "(?U)" + QUERY_SIGNS, " ")
    expanded = F.when(has_old_spelling(part), normalize(expand_dagger(part))).otherwise(normalize(part))
    return F.struct(light(part).alias("clean"), normalize(part).alias("normal"), expanded.alias("expanded"))


def matching_forms(old: Column, new: Column) -> dict[str, Column]:
    """The four derived columns of a verse in two spellings."""
    return {"clean_uthmani": light(old), "clean_imlaei": light(new), "normalized_uthmani": normalize(expand_dagger(old)), "normalized_imlaei": normalize(new)}


def surface(text: Column, term: Column) -> Column:
    """The first window of the text's words whose normal form contains the term, without punctuation at its edges; else the term itself."""
    found, want = words(text), normalize(term)
    n = F.greatest(F.size(words(want)), F.lit(1))
    starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.slice(found, i, n))
    hits = F.filter(windows, lambda w: F.array_join(F.transform(w, normalize), " ").contains(want))
    return F.coalesce(F.btrim(F.array_join(F.get(hits, F.lit(0)), " "), F.lit(EDGE_PUNCTUATION)), term)


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("﴿﴾{}«»()“”\" "))


def display(text: Column) -> Column:
    """For showing: no guillemets, single spaces."""
    return collapse(F.translate(text, "«»", ""))


def safe_file_name(text: Column) -> Column:
    return collapse(replace(text, "[\\\\/:*?\"<>|]+", " "))


def shorten(text: Column, width: int, placeholder: str = " [...]") -> Column:
    """The text with single spaces; if it is longer than ``width``, as many of its first words as fit with the placeholder behind them, or that alone."""
    found = words(collapse(text))
    grown = F.aggregate(
        found,
        F.struct(F.lit("").alias("text"), F.lit(True).alias("fits")),
        lambda done, w: F.when(
            done["fits"] & (F.length(done["text"]) + F.length(w) + F.when(done["text"] == "", 0).otherwise(1) + len(placeholder) <= width),
            F.struct(F.when(done["text"] == "", w).otherwise(F.concat(done["text"], F.lit(" "), w)).alias("text"), F.lit(True).alias("fits")),
        ).otherwise(F.struct(done["text"].alias("text"), F.lit(False).alias("fits"))),
        lambda done: done["text"],
    )
    return F.when(F.length(collapse(text)) <= width, collapse(text)).otherwise(F.when(grown == "", placeholder.strip()).otherwise(F.concat(grown, F.lit(placeholder))))
