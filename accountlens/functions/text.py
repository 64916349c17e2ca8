"""Cleaning, URL, date and hash expressions. Each takes and returns columns, and stays in generated code where it can."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .letters import casefolds, gate, marked_letters

# Query parameters that only track, and lines of cookie banners.
TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid"]
COOKIE_LINE = "(?i)^(accept (all )?cookies|cookie settings|manage cookies|privacy settings|alle cookies akzeptieren)$"
# Characters kept of a text, by source type.
CAPS = {"website": 50_000, "jobs": 8_000, "report": 40_000}

SPACES = r"(?U)\s+"
# Characters that count as one in quotes.
SAME_MARKS = str.maketrans({**dict.fromkeys("“”„‟«»", '"'), **dict.fromkeys("‘’‚‛`´‹›", "'"), **dict.fromkeys("‐‑‒–—―−", "-"), "…": "..."})


def _written(text: Column, lower: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Letters of a lower-case form of the text written as several: those of Latin-1 at once, others only in texts that have one of them."""
    near, far = ([p for p in pairs if (ord(p[0]) < 0x100) == low] for low in (True, False))
    for a, b in near:
        lower = F.replace(lower, F.lit(a), F.lit(b))
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in far])
    return F.when(text.rlike(gate("".join(a for a, _ in far))), F.aggregate(rules, lower, lambda s, r: F.replace(s, r["a"], r["b"]))).otherwise(lower)


def casefold(text: Column) -> Column:
    """Lower case in which letters of one kind are one, as case folding has it: sharp s, final sigma, ligatures and the rest."""
    letters, plain, pairs = casefolds()
    # Few texts have a letter that the table changes; the others are spared it.
    return _written(text, F.when(text.rlike(gate(letters)), F.translate(F.lower(text), letters, plain)).otherwise(F.lower(text)), pairs)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(F.trim(url), F.lit(part))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, tracking parameter, fragment or final slash."""
    scheme = F.coalesce(F.lower(url_part(url, "PROTOCOL")), F.lit("https"))
    authority = F.regexp_replace(F.lower(F.coalesce(url_part(url, "AUTHORITY"), F.lit(""))), "^[^@]*@", "")
    host = F.regexp_replace(authority, ":(80|443)?$", "")
    path = F.rtrim(F.coalesce(url_part(url, "PATH"), F.lit("")), F.lit("/"))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(F.coalesce(url_part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.when(url.isNotNull(), F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def clean_text(text: Column, cap: int | Column = CAPS["website"]) -> Column:
    """White space collapsed in each line; no blank, banner or repeated line; at most cap characters."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), collapse), lambda x: (x != "") & ~x.rlike(COOKIE_LINE))
    # Repeats are neighbours once sorted; the first of each goes back to its place. Nothing is looked up line by line.
    order = F.sort_array(F.transform(lines, lambda x, i: F.struct(casefold(x).alias("k"), i.alias("i"), x.alias("x"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(order, lambda r: r["k"]))
    first = F.filter(F.zip_with(order, before, lambda r, k: F.when(r.isNotNull() & ~r["k"].eqNullSafe(k), F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r.isNotNull())
    kept = F.transform(F.sort_array(first), lambda r: r["x"])
    return F.regexp_replace(F.left(F.array_join(kept, "\n"), F.lit(cap) if isinstance(cap, int) else cap), r"(?U)\s+$", "")


def content_hash(text: Column) -> Column:
    """C03. Folding neither makes nor takes white space, so it may come first."""
    return F.sha2(collapse(casefold(text)), 256)


def clean_title(title: Column) -> Column:
    """C04."""
    return F.nullif(F.left(collapse(title), F.lit(500)), F.lit(""))


def utc_datetime(text: Column) -> Column:
    """ISO-8601, a date alone, or RFC-2822; without a zone UTC; null if it is none of them."""
    t = F.trim(text)
    mail = F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]+, *", ""), r"\s*\([^)]*\)$", "")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
    forms = [F.try_to_timestamp(F.when(mail.rlike("^[0-9]{1,2} [A-Z]"), mail), F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(iso, *forms)


# Frequent short words of each language.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "as", "by", "was", "are", "from", "this"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "im", "für", "auf", "ein", "eine", "nicht", "sich"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "est", "pour", "que", "qui", "dans", "sur"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "se", "del", "al"],
}


def guess_language(text: Column) -> Column:
    """By the most frequent short words among the first 400 characters; null under 40 characters or without any."""
    words = F.split(F.lower(F.left(text, F.lit(400))), r"(?U)\W+")

    def hits(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(known)))

    votes = [F.struct(hits(known).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, known) in enumerate(LANGUAGE_WORDS.items())]
    best = F.array_max(F.array(*votes))
    return F.when((F.length(F.trim(text)) >= 40) & (best["n"] > 0), best["k"])


def cap(text: Column, source_type: Column) -> Column:
    """C07."""
    n = F.lit(CAPS["website"])
    for kind, most in CAPS.items():
        n = F.when(source_type == kind, most).otherwise(n)
    return F.left(text, n)


def normalize_domain(value: Column) -> Column:
    """Host of a domain or URL, without www., port, path or final dot; null if it has no dot or odd characters."""
    host = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(host, r"[/?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r":\d*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(host.rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9-]{2,}$"), host)


def host(url: Column) -> Column:
    """C09."""
    return F.regexp_replace(F.lower(url_part(url, "HOST")), r"^www\.", "")


def own_host(h: Column, domain: Column) -> Column:
    """Equal, or a subdomain."""
    return (h == domain) | h.endswith(F.concat(F.lit("."), domain))


def fold(text: Column) -> Column:
    """Lower case without marks, in Latin letters: Greek and Cyrillic are written in them."""
    letters, plain, pairs = marked_letters()
    return _written(text, F.translate(F.lower(text), letters, plain), pairs)


#: Words that carry no topic. A parameter of tokenize; these are the shortest and most frequent of three languages.
STOP_WORDS = sorted({fold_word for ws in (LANGUAGE_WORDS["en"], LANGUAGE_WORDS["de"], LANGUAGE_WORDS["fr"]) for fold_word in (w.replace("ü", "u") for w in ws)} | {"a", "an", "or", "it", "at", "be", "au", "aux", "ne", "pas", "es", "an", "am", "als", "auch"})


def tokenize(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """C11: folded [a-z0-9]+ words, repeats kept, without stop words."""
    return F.filter(F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(stop_words))


def _normal_quotes(quotes: pd.Series) -> pd.Series:
    def normal(x: str | None) -> str | None:
        return None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(SAME_MARKS).casefold().split())

    return quotes.map(normal, na_action="ignore")


def normal_quote(text: Column) -> Column:
    """Compatible forms of a character as one, one kind of quotes, dashes and ellipses; case folded; white space collapsed."""
    return F.pandas_udf(_normal_quotes, "string")(text)


def evidence_key(question_key: Column, quote: Column, url: Column) -> Column:
    """C13."""
    return F.sha2(F.concat_ws("\n", question_key, normal_quote(quote), F.coalesce(canonical_url(url), F.lit(""))), 256)


def novelty_quote(quote: Column) -> Column:
    """C14."""
    return F.lower(collapse(quote))


def source_key(url: Column, document_id: Column) -> Column:
    """Host and path of the address in lower case, without www., query and final slash, else the document."""
    address = F.lower(F.trim(url))
    host = F.regexp_replace(url_part(address, "AUTHORITY"), r"^www\.", "")
    return F.coalesce(F.concat(host, F.rtrim(F.coalesce(url_part(address, "PATH"), F.lit("")), F.lit("/"))), document_id.cast("string"))


def numbers(text: Column) -> Column:
    """The numbers of a text, without separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1)), lambda n: F.translate(n, ".,", "")))


def numbers_agree(a: Column, b: Column) -> Column:
    """One set holds the other; a text without numbers agrees with any."""
    x, y = numbers(a), numbers(b)
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def estimate_tokens(text: Column) -> Column:
    """C17."""
    return F.floor(F.length(text) / 4)


# Legal forms at the end of company names.
LEGAL_FORMS = ["ag", "se", "gmbh", "kg", "kgaa", "co", "inc", "corp", "corporation", "company", "ltd", "limited", "llc", "plc", "sa", "sas", "sarl", "spa", "srl", "nv", "bv", "ab", "as", "asa", "oy", "oyj", "holding", "group"]
_FORMS = "|".join(LEGAL_FORMS)


def name_key(name: Column) -> Column:
    """Folded words without a leading "the" and without legal forms at the end."""
    words = F.trim(F.regexp_replace(F.replace(fold(name), F.lit("."), F.lit("")), "[^a-z0-9]+", " "))
    short = F.regexp_replace(F.regexp_replace(words, "^the ", ""), f"( ({_FORMS}))+$", "")
    return F.when(short != "", short).otherwise(words)


def name_variants(name: Column) -> Column:
    """The name, and the name without legal forms."""
    bare = F.trim(F.regexp_replace(name, rf"(?i)([\s,]+(&\s*)?({_FORMS})\.?)+$", ""))
    return F.filter(F.array_distinct(F.array(F.trim(name), bare)), lambda x: x != "")


def search_name(name: Column, legal_name: Column, aliases: Column) -> Column:
    """C20: the legal name, else the name; one of up to four letters gives way to the first longer alias."""
    base = F.coalesce(F.nullif(F.trim(legal_name), F.lit("")), F.trim(name))
    longer = F.try_element_at(F.filter(aliases, lambda a: F.length(F.trim(a)) > 4), F.lit(1))
    return F.when(F.length(base) <= 4, F.coalesce(F.trim(longer), base)).otherwise(base)


def amount(text: Column) -> Column:
    """The first amount of a text as a number: "€81.8bn", "10001+", "1001-5000", "1.234,5"."""
    t = F.lower(F.trim(text))
    raw = F.nullif(F.regexp_extract(t, r"(\d[\d.,]*)", 1), F.lit(""))
    unit = F.regexp_extract(t, r"\d[\d.,]*\s*(bn|billion|mrd|milliarden|b|mn|mio|million|millionen|m|k|thousand|tsd)?\b", 1)
    bare = F.rtrim(raw, F.lit(".,"))
    both = bare.contains(".") & bare.contains(",")
    comma_last = F.locate(",", F.reverse(bare)) < F.locate(".", F.reverse(bare))
    grouped = bare.rlike(r"^\d{1,3}([.,]\d{3})+$")
    plain = (
        F.when(both & comma_last, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(bare, F.lit(","), F.lit("")))
        .when(grouped, F.regexp_replace(bare, "[.,]", ""))
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    )
    times = F.when(unit.isin("bn", "billion", "mrd", "milliarden", "b"), 1e9).when(unit.isin("mn", "mio", "million", "millionen", "m"), 1e6).when(unit.isin("k", "thousand", "tsd"), 1e3).otherwise(1.0)
    return F.when(raw.isNotNull(), F.round(plain.try_cast("double") * times, 2)).try_cast("decimal(38,2)")


def gist(text: Column) -> Column:
    """The first sentence, at most 90 characters."""
    one = collapse(text)
    first = F.regexp_extract(one, r"^(.*?[.!?])(\s|$)", 1)
    sentence = F.when(first != "", first).otherwise(one)
    return F.when(F.length(sentence) > 90, F.concat(F.rtrim(F.left(sentence, F.lit(89))), F.lit("…"))).otherwise(sentence)


def lead_link(base: str, company_id: Column, service_id: Column) -> Column:
    """C25."""
    return F.concat(F.lit(base.rstrip("/") + "/leads/"), company_id.cast("string"), F.lit("?service="), service_id.cast("string"))


def index_text(title: Column, text: Column, source_type: Column) -> Column:
    """News and jobs are indexed with their title, unless the text starts with it."""
    headed = source_type.isin("news", "jobs") & (F.coalesce(title, F.lit("")) != "") & ~text.startswith(title)
    return F.when(headed, F.concat(title, F.lit("\n"), text)).otherwise(text)


# Character entities of plain pages.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_text(html: Column, escaped: bool = False) -> Column:
    """Text of HTML; block tags end lines; scripts, styles and navigation go. escaped: entities hide the tags."""
    h = unescape(html) if escaped else html
    h = F.regexp_replace(h, r"(?is)<!--.*?-->|<(script|style|noscript|template|nav|header|footer|aside|form)\b[^>]*>.*?</\1\s*>", " ")
    h = F.regexp_replace(h, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/section|/article|p|div|li|h[1-6]|tr)\b[^>]*>", "\n")
    h = unescape(F.regexp_replace(h, r"(?s)<[^>]*>", ""))
    lines = F.filter(F.transform(F.split(h, "\n"), collapse), lambda x: x != "")
    return F.array_join(lines, "\n")


def report_date(meta: Column, url: Column) -> Column:
    """A PDF date, missing parts 1 or 0, else 1 January of the newest year in the URL."""
    form = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda i, d: F.coalesce(F.nullif(F.regexp_extract(meta, form, i), F.lit("")).cast("int"), F.lit(d))
    exact = F.when(meta.rlike(form), F.try_make_timestamp(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(8,6)")))
    year = F.array_max(F.transform(F.regexp_extract_all(url, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")))
    return F.coalesce(exact, F.try_make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
