"""Text scalars as column expressions: normalising, scripts, directions, greetings, file names, formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements in their order (an earlier one may hide a later one).
CURRENCIES = (
    (" שקלים", " ₪"), (" שקל", " ₪"), (' ש"ח', " ₪"), (" ש״ח", " ₪"), (" NIS", " ₪"), (" nis", " ₪"),
    (" דולר", " $"), (" דולרים", " $"), (" dollars", " $"), (" dollar", " $"),
    (" рублей", " ₽"), (" рубля", " ₽"), (" руб.", " ₽"), (" руб", " ₽"),
)
# What an agent opens a call with.
GREETINGS = (
    "במה אפשר לעזור", "מדבר", "מדברת", "תודה שהתקשרת", "מוקד שירות", "שירות לקוחות",
    "чем я могу помочь", "чем могу помочь", "служба поддержки", "компания", "меня зовут",
    "how can i help", "thank you for calling", "customer support",
)
# The flags' words.
FLAGS = {
    "cancellation": ("לבטל", "ביטול", "отменить", "отмена", "cancel"),
    "complaint": ("תלונה", "גרוע", "жалоба", "ужасно", "bad service"),
}
# Letters that Hebrew joins to the front of a word.
PROCLITICS = ("ה", "ו", "ב", "ל", "מ", "כ", "ש")
#: Hebrew and Arabic blocks, Cyrillic blocks, and all alphabets that transcripts are written in.
RTL = "\\u0590-\\u05FF\\uFB1D-\\uFB4F\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
HEBREW, ARABIC = "\\u0590-\\u05FF\\uFB1D-\\uFB4F", "\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
CYRILLIC = "\\u0400-\\u052F"
#: Letters of the Arabic script that Persian and Urdu have and Arabic hasn't.
NOT_ARABIC = "\\u0679\\u067E\\u0686\\u0688\\u0691\\u0698\\u06A9\\u06AF\\u06BA\\u06BE\\u06C1\\u06CC\\u06D2"
EXPECTED = "A-Za-z\\u00C0-\\u024F\\u0400-\\u052F\\u0590-\\u05FF\\u0600-\\u06FF\\u0750-\\u077F"
#: White space as Unicode has it.
BLANK = r"(?U)\s+"


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def tokens(c: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(c, BLANK), lambda t: t != "")


def currencies(c: Column) -> Column:
    for old, new in CURRENCIES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def phones(c: Column) -> Column:
    """Ten-digit mobile numbers that begin with 05 as 05x-xxx-xxxx; white space becomes single spaces."""
    mobile = lambda t: F.when(t.rlike("^05[0-9]{8}$"), F.regexp_replace(t, "^(...)(...)(....)$", "$1-$2-$3")).otherwise(t)
    return F.array_join(F.transform(tokens(c), mobile), " ")


def normalised(c: Column) -> Column:
    """Squeezed white space, currency signs, phone forms; blank is empty."""
    squeezed = F.array_join(tokens(c), " ")
    return F.when(squeezed == "", "").otherwise(phones(currencies(squeezed)))


def count_of(c: Column, chars: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{chars}]"))


def direction(c: Column, lang: Column) -> Column:
    """rtl or ltr: by the language, else by which letters are more."""
    rtl, letters = count_of(c, RTL), F.regexp_count(c, F.lit(f"[\\p{{IsAlphabetic}}&&[^{RTL}]]"))
    return F.when(lang.isin("he", "ar"), "rtl").when(lang.isin("ru", "en"), "ltr").when(rtl > letters, "rtl").otherwise("ltr")


def script_language(c: Column) -> Column:
    """ar, he, ru, en or unknown by the script with the most letters; the Arabic script is ar without letters that only others have, else he."""
    h, r, e = count_of(c, RTL), count_of(c, CYRILLIC), count_of(c, "A-Za-z")
    a = count_of(c, ARABIC)
    arabic = (a > count_of(c, HEBREW)) & (a > r) & (a > e) & (count_of(c, NOT_ARABIC) == 0)
    return F.when(arabic, "ar").when((h > r) & (h > e), "he").when((r > h) & (r > e), "ru").when(e > 0, "en").otherwise("unknown")


def is_greeting(c: Column) -> Column:
    return contains_any(F.lower(c), GREETINGS)


def flag(name: str, c: Column) -> Column:
    return contains_any(F.lower(c), FLAGS[name])


def is_degenerate(c: Column) -> Column:
    """Four words or more, of which a third at most are different."""
    ws = tokens(c)
    plain = F.transform(ws, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{Nd}]+|[^\p{IsAlphabetic}\p{Nd}]+$", "")))
    return (F.size(ws) >= 4) & (F.size(F.array_distinct(plain)) * 3 <= F.size(ws))


def has_foreign_script(c: Column) -> Column:
    """Three letters or more, and over two per cent of all, from alphabets not used here."""
    letters = F.regexp_count(c, F.lit(r"\p{IsAlphabetic}"))
    foreign = F.regexp_count(c, F.lit(f"[\\p{{IsAlphabetic}}&&[^{EXPECTED}]]"))
    return (foreign >= 3) & (foreign > 0.02 * letters)


def vocabulary(c: Column, phrases: Mapping[str, str]) -> Column:
    """Aliases replaced by phrases, in order."""
    for alias, phrase in phrases.items():
        c = F.replace(c, F.lit(alias), F.lit(phrase))
    return c


def query_terms(query: str) -> list[str]:
    """A search box's text as prefix terms; Hebrew words also with each joined letter in front."""
    import re

    out = []
    for t in filter(None, re.split(r"[\s\"*:()'&|!<>\\]+", query)):
        out.append(t)
        if re.search("[֐-׿]", t):
            out += [p + t for p in PROCLITICS]
    return out


def fts5_query(query: str) -> str:
    return " OR ".join(f'"{t}"*' for t in query_terms(query))


def tsquery(query: str) -> str:
    return " | ".join(f"{t}:*" for t in query_terms(query))


def speaker_label(role: Column, speaker: Column) -> Column:
    """Speaker 1 for agents, 2 for customers, 3 for supervisors, else by number."""
    number = F.when(role == "agent", 1).when(role == "customer", 2).when(role == "supervisor", 3).otherwise(F.coalesce(speaker, F.lit(0)) + 1)
    return F.concat(F.lit("Speaker "), number.cast("string"))


def mm_ss(ms: Column) -> Column:
    """Minutes (not wrapped at 60) and seconds."""
    return F.format_string("%02d:%02d", F.floor(ms / 60_000), F.floor(ms % 60_000 / 1000))


def clock(ms: Column, mark: str) -> Column:
    """HH:MM:SS and milliseconds behind ``mark``."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def parsed_filename(c: Column) -> Column:
    """A struct (contact, phone, started_at) from names like ``Call recording NAME_YYMMDD_HHMMSS.ext``.

    The tail counts only if it is a date and a time and something stands before
    it; a caller of digits and ``+-() `` with three digits or more is a phone.
    """
    base = F.regexp_replace(c, r"\.[^.]*$", "")
    base = F.regexp_replace(base, "^Call recording |^Call ", "")
    tail = F.regexp_extract(base, r"_(\d{6}_\d{6})$", 1)
    at = F.when(tail != "", F.try_to_timestamp(F.concat(F.lit("20"), tail), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"))
    caller = F.when(at.isNotNull(), F.regexp_replace(base, r"_\d{6}_\d{6}$", "")).otherwise(base)
    phone = (F.trim(caller) != "") & F.trim(caller).rlike(r"^[0-9+\-() ]+$") & (F.regexp_count(caller, F.lit("[0-9]")) >= 3)
    return F.struct(F.when(~phone & (caller != ""), caller).alias("contact"), F.when(phone, caller).alias("phone"), at.alias("started_at"))


def escaped(c: Column) -> Column:
    """Text safe inside HTML."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def highlighted(c: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The first match of ``query``, whatever its case, marked; all text escaped."""
    if not query:
        return escaped(c)
    at, n = F.locate(query.lower(), F.lower(c)), len(query)
    marked = F.concat(escaped(c.substr(F.lit(1), at - 1)), F.lit(before), escaped(c.substr(at, F.lit(n))), F.lit(after), escaped(c.substr(at + n, F.length(c))))
    return F.when(at > 0, marked).otherwise(escaped(c))


def percent_encoded(c: Column) -> Column:
    """All but letters, digits and ``-_.~`` as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parties(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" → "), b)).otherwise(F.coalesce(a, b, F.lit("—")))


def number_of_jid(c: Column) -> Column:
    return F.substring_index(c, "@", 1)


#: Media types by file ending.
MIME = {"wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac", "ogg": "audio/ogg", "flac": "audio/flac"}


def mime_of(name: Column) -> Column:
    ending, out = F.lower(F.substring_index(name, ".", -1)), None
    for k, v in MIME.items():
        out = F.when(ending == k, v) if out is None else out.when(ending == k, v)
    return out.otherwise("application/octet-stream")


def byte_range(header: Column, size: Column) -> Column:
    """A struct (first, last) for ``bytes=a-b``, ``a-`` or ``-n``; null if it can't be met."""
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1).try_cast("bigint")
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2).try_cast("bigint")
    first = F.when(a.isNotNull(), a).when(b > 0, F.greatest(size - b, F.lit(0)))
    last = F.when(a.isNull(), size - 1).otherwise(F.least(F.coalesce(b, size - 1), size - 1))
    return F.when((first <= last) & (first < size), F.struct(first.alias("first"), last.alias("last")))


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 3)


def fallback_title(lang: Column) -> Column:
    return F.when(lang == "he", "שיחה מוקלטת").when(lang == "ru", "Записанный разговор").otherwise("Recorded conversation")


def age(seconds: Column) -> Column:
    """Minutes, hours or days ago."""
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86_400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d")))


def role_name(c: Column) -> Column:
    return _known(c, ("agent", "customer", "supervisor"), "unknown")


def direction_name(c: Column) -> Column:
    return _known(c, ("incoming", "outgoing", "internal"), "unknown")


def status_name(c: Column) -> Column:
    return _known(c, ("pending", "processing", "completed", "failed"), "pending")


def job_status_name(c: Column) -> Column:
    return _known(c, ("pending", "running", "completed", "failed", "cancelled"), "pending")


def _known(c: Column, names: tuple[str, ...], default: str) -> Column:
    return F.when(F.lower(c).isin(*names), F.lower(c)).otherwise(default)


def language_code(c: Column) -> Column:
    """Names, two- and three-letter codes of the four languages; others as they are, unknown for none."""
    low = F.lower(c)
    return F.when(low.isin("he", "heb", "hebrew", "iw"), "he").when(low.isin("ru", "rus", "russian"), "ru").when(low.isin("en", "eng", "english"), "en").when(low.isin("ar", "ara", "arabic"), "ar").when(low.isin("und", "unknown", ""), "unknown").otherwise(F.coalesce(low, F.lit("unknown")))
