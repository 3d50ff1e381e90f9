"""Text, time and conditional functions of the news engine, as column functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: rules that results depend on, in order of precedence ---
CATEGORY_RULES = {
    "sports": "sport|cricket|football|ipl|tennis|olympics|मैच|क्रिकेट|ఫుట్‌బాల్|క్రికెట్|ಫುಟ್ಬಾಲ್|ಕ್ರೀಡೆ",
    "tech": "tech|ai|digital|startup|cyber|software|app|तकनीक|प्रौद्योगिकी|టెక్|ಸಾങ്കേതിക",
    "business": "business|economy|market|stock|sensex|gdp|rupee|trade|बाजार|अर्थव्यवस्था|शेयर|వ్యాపార|ಮಾರುಕಟ್ಟೆ",
    "politics": "politics|election|parliament|minister|cm |pm |governor|bjp|congress|सरकार|चुनाव|संसद|मंत्री|ರಾಜಕೀಯ|चालू घडामोडी|current affairs",
    "entertainment": "film|cinema|bollywood|celebrity|entertainment|award|movie|actor|actress|फिल्म|मनोरंजन|సినిమా|ಮನರಂಜನೆ",
}
DEFAULT_CATEGORY = "world"
SOURCE_LANGUAGES = {
    "hi": ["hindi", "हिंदी", "jagran", "amar ujala", "abp live hindi"],
    "mr": ["marathi", "maratha", "maharashtra times", "lokmat", "sakal"],
    "bn": ["bengali", "bangla", "ananda", "eisamay", "abp ananda", "prothom alo"],
    "ta": ["tamil", "dinamalar", "dinamani", "vikatan"],
    "te": ["telugu", "eenadu", "sakshi", "tv9 telugu"],
    "kn": ["kannada", "prajavani", "vijaya karnataka", "tv9 kannada"],
    "pa": ["punjabi", "jagbani", "punjab kesari"],
    "gu": ["gujarati", "divya bhaskar", "gujarat samachar", "sandesh"],
    "ar": ["arabic", "عربي", "al jazeera arabic", "al arabiya", "ahram"],
    "ur": ["urdu", "jang", "geo urdu"],
    "fr": ["french", "le monde", "le figaro", "radio-canada", "ledevoir", "rfi"],
    "de": ["german", "spiegel", "zeit", "deutsche welle german", "süddeutsche"],
    "es": ["spanish", "el país", "el pais", "el mundo", "rtve", "bbc mundo", "infobae"],
    "pt": ["portuguese", "g1 globo", "folha", "bbc brasil"],
    "ru": ["russian", "tass", "ria novosti", "rt russian"],
    "ja": ["japanese", "nhk", "asahi"],
    "ko": ["korean", "yonhap", "korea herald", "joongang"],
    "zh": ["chinese", "xinhua", "cgtn"],
    "id": ["indonesian", "kompas"],
    "tr": ["turkish"],
}
SCRIPTS = {
    "ja": (0x3040, 0x30FF), "ko": (0xAC00, 0xD7AF), "ru": (0x0400, 0x04FF), "ar": (0x0600, 0x06FF), "hi": (0x0900, 0x097F), "bn": (0x0980, 0x09FF),
    "pa": (0x0A00, 0x0A7F), "gu": (0x0A80, 0x0AFF), "ta": (0x0B80, 0x0BFF), "te": (0x0C00, 0x0C7F), "kn": (0x0C80, 0x0CFF), "zh": (0x4E00, 0x9FFF),
}
DEAD_SOURCE = ["status code 404", "status code 410", "status code 451", "status code 522", "status code 530", "enotfound", "getaddrinfo", "attribute without value"]
TRANSITIONS = {
    "DRAFT": ["PENDING_REVIEW"], "PENDING_REVIEW": ["AI_PROCESSING", "DRAFT"], "AI_PROCESSING": ["NEEDS_EDIT", "APPROVED"], "NEEDS_EDIT": ["PENDING_REVIEW"],
    "APPROVED": ["SCHEDULED", "PUBLISHING"], "SCHEDULED": ["PUBLISHING", "APPROVED"], "PUBLISHING": ["PUBLISHED", "PUBLISH_FAILED"],
    "PUBLISHED": ["ARCHIVED"], "PUBLISH_FAILED": ["PUBLISHING"], "ARCHIVED": [],
}
LOCALE_COUNTRIES = {
    "hi": "IN", "mr": "IN", "bn": "BD", "te": "IN", "ta": "IN", "gu": "IN", "kn": "IN", "pa": "IN", "ur": "PK", "de": "DE", "fr": "FR", "es": "ES", "it": "IT",
    "pt": "BR", "ar": "AE", "zh": "CN", "ja": "JP", "ko": "KR", "ru": "RU", "nl": "NL", "ms": "MY", "id": "ID",
    "en-US": "US", "en-GB": "GB", "en-AU": "AU", "en-CA": "CA",
}
DEFAULT_COUNTRY = "IN"
APP_LANGUAGES = ["en", "hi", "mr", "bn", "te", "ta", "gu", "kn", "pa", "ur", "ar", "fr", "de", "es", "pt", "ru", "zh", "ja", "ko", "id", "tr", "it"]
DEFAULT_LANGUAGE = "en"
RATE_LIMITED = ["429", "quota", "Too Many"]
QUOTA_BLOCKED = ["limit: 0", "Quota exceeded for metric", "free_tier"]
UNIQUE_VIOLATION = "P2002"
EMPTY_BODY = "(No body text in feed item.)"
IMAGE_SIZES = {"hero": "1200/630", "thumb": "120/80", "card": "800/450"}
IMAGE_HOST = "https://picsum.photos/seed/"
# --- end of fixed values ---

#: White space as browsers have it: Unicode's, and the byte order mark.
SPACE = r"(?U)[\s\uFEFF]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", "")


def _first_of(rules: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda rest, name: F.when(rules[name], F.lit(name)).otherwise(rest), reversed(rules), otherwise)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def raw_slug(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), 1, 60)


def html_text(html: Column, most: int = 80_000) -> Column:
    """Paragraph borders become blank lines and breaks line ends; other tags go."""
    c = F.regexp_replace(html, r"(?iU)</p>[\s\uFEFF]*<p[^>]*>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?iU)<br\s*/?>", "\n"), "<[^>]+>", "")
    return F.substring(trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n")), 1, most)


def excerpt(html: Column, length: int = 400) -> Column:
    return F.substring(trimmed(F.regexp_replace(html, "<[^>]+>", "")), 1, length)


def paragraphs(text: Column, border: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, border), trimmed), lambda x: x != "")


def sentences(text: Column, ends: str = ".!?।") -> Column:
    return F.split(text, rf"(?U)(?<=[{ends}])\s+")


def packed_sentences(text: Column, over: int = 6000, most: int = 4500) -> Column:
    """Long texts without paragraphs: sentences packed greedily into parts of at most `most` characters, but for single ones."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("cur"))
    add = lambda acc, s: F.when(
        F.length(acc["cur"]) + F.length(s) > most, F.struct(F.when(acc["cur"] != "", F.concat(acc["done"], F.array(trimmed(acc["cur"])))).otherwise(acc["done"]).alias("done"), s.alias("cur"))
    ).otherwise(F.struct(acc["done"].alias("done"), F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s)).alias("cur")))
    end = lambda acc: F.when(trimmed(acc["cur"]) != "", F.concat(acc["done"], F.array(trimmed(acc["cur"])))).otherwise(acc["done"])
    parts = paragraphs(text)
    return F.when((F.size(parts) <= 1) & (F.length(text) > over), F.aggregate(sentences(text), start, add, end)).otherwise(parts)


def or_placeholder(parts: Column, otherwise: str = EMPTY_BODY) -> Column:
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(otherwise)))


def paragraph_key(p: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(p), r"(?U)\s+", " "), r"(?U)[^\p{L}\p{N}\s]", ""))


def distinct_paragraphs(parts: Column) -> Column:
    """
    The first of each key stays; parts with an empty key go. Sorted by key and place, a key's first part is the one that follows
    another key, so a text of n parts takes n log n steps.
    """
    keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(paragraph_key(p).alias("key"), i.alias("i"), p.alias("p"))))
    first = lambda x: F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (F.get(x, i - 1)["key"] != "") & ((i == 1) | (F.get(x, i - 2)["key"] != F.get(x, i - 1)["key"])))
    kept = lambda x: F.when(F.size(x) > 0, F.transform(F.array_sort(F.transform(first(x), lambda i: F.struct(F.get(x, i - 1)["i"].alias("i"), F.get(x, i - 1)["p"].alias("p")))), lambda y: y["p"])).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(keyed), kept), 1)


def _apart(keys) -> list[int]:
    """Places of the keys that stay: an automaton of all keys finds those that one holds, in time of its length and of what is found."""
    import ahocorasick

    first: dict[str, int] = {}
    for i, k in enumerate(keys):
        if k:
            first.setdefault(k, i)
    if not first:
        return []
    known = ahocorasick.Automaton()
    for k, i in first.items():
        known.add_word(k, i)
    known.make_automaton()
    gone, kept = set(), set()
    for k, i in first.items():
        if i in gone:
            continue
        held = {j for _, j in known.iter(k)}
        if held.isdisjoint(kept):
            kept.add(i)
            gone |= held  # those that come later; i itself is done
    return sorted(kept)


def uncontained_paragraphs(parts: Column, short: int = 64) -> Column:
    """
    A part goes where its key equals, holds or is held by the key of one that stayed. Up to `short` parts each is held against those
    that stayed; more go to tasks' Python as keys, where the work grows with the text and not with the square of its parts.
    """

    def apart(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else _apart(k))

    many = F.size(parts) > short
    places = F.pandas_udf(apart, "array<int>")(F.when(many, F.transform(parts, lambda p: paragraph_key(p))))
    keyed = F.transform(parts, lambda p: F.struct(paragraph_key(p).alias("key"), trimmed(p).alias("p")))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))
    add = lambda acc, x: F.when((x["key"] == "") | F.exists(acc["keys"], lambda k: F.contains(k, x["key"]) | F.contains(x["key"], k)), acc).otherwise(
        F.struct(F.concat(acc["keys"], F.array(x["key"])).alias("keys"), F.concat(acc["out"], F.array(x["p"])).alias("out"))
    )
    return F.when(many, F.transform(places, lambda i: trimmed(F.get(parts, i)))).otherwise(F.aggregate(keyed, start, add, lambda acc: acc["out"]))


def enriched_body(long: Column, medium: Column, short: Column, summary: Column, enough: int = 2400) -> Column:
    each = [trimmed(F.coalesce(c, F.lit(""))) for c in (long, medium, short, summary)]
    parts = F.when(F.length(each[0]) >= enough, F.array(each[0])).otherwise(F.array(each[1], each[0], each[2], each[3]))
    return F.array_join(uncontained_paragraphs(F.flatten(F.transform(parts, lambda p: paragraphs(p)))), "\n\n")  # paragraphs alone would be given places as its second argument


def article_paragraphs(body: Column, medium: Column, short: Column, excerpt_: Column, enough: int = 900) -> Column:
    """The body's paragraphs; where they are short or none, those of the other texts follow. Each key once."""
    none = F.array().cast("array<string>")
    body = F.coalesce(F.filter(body, lambda p: p != ""), none)
    texts = F.filter(F.array(medium, short, excerpt_), lambda t: trimmed(F.coalesce(t, F.lit(""))) != "")
    rest = F.coalesce(paragraphs(F.array_join(texts, "\n\n"), r"\n(?U)\s*\n|(?U)(?<=[.!?।])\s+(?=[A-Z0-9])"), none)
    joined = F.when((F.size(body) == 0) | (F.length(F.array_join(body, " ")) < enough), F.concat(body, rest)).otherwise(body)
    return distinct_paragraphs(joined)


def first_image(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))


def video_url(mime: Column, media: Column, link: Column) -> Column:
    """The medium itself where its type is a video's, else a link to a video site."""
    own = F.when(F.startswith(mime, F.lit("video")), F.nullif(media, F.lit("")))
    return F.coalesce(own, F.when(link.rlike(r"(?i)youtube\.com|youtu\.be|vimeo\.com"), link))


def storage_key(url: Column, bucket: str) -> Column:
    """What follows the bucket in a URL; the URL itself where it names another."""
    mark = f"/{bucket}/"
    at = F.instr(url, mark)
    return F.when(at > 0, F.substr(url, at + len(mark))).otherwise(url)


def preferred_image(assets: Column, body_image: Column, slug_: Column, size: str = "card") -> Column:
    """The first image asset with a URL, else the body's image, else a placeholder by slug. `assets`: array<struct<type,url>>."""
    own = F.try_element_at(F.filter(assets, lambda m: (m["type"] == "IMAGE") & (F.coalesce(m["url"], F.lit("")) != "")), F.lit(1))["url"]
    return F.coalesce(own, F.nullif(body_image, F.lit("")), F.concat(F.lit(IMAGE_HOST), uri_part(slug_), F.lit("/" + IMAGE_SIZES[size])))


def uri_part(c: Column) -> Column:
    """Percent-encoded as a part of a URI: all but letters, digits and -_.!~*'()."""
    return _percent(c, "!~'()")


def uri(c: Column) -> Column:
    """Percent-encoded as a whole URI: its delimiters stay."""
    return _percent(c, "!~'();,/?:@&=+$#")


def _percent(c: Column, plain: str) -> Column:
    encoded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return reduce(lambda out, x: F.replace(out, F.lit(f"%{ord(x):02X}"), F.lit(x)), plain, encoded)

def is_playable(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce((trimmed(url) != "") & (low.rlike(r"youtube\.com|youtu\.be|\.(mp4|webm|m3u8)$") | F.startswith(low, F.lit("http"))), F.lit(False))


def embed_url(url: Column) -> Column:
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    found = F.when(host == "youtu.be", some(F.regexp_extract(path, "^/?([^/]*)", 1))).when(F.contains(host, F.lit("youtube.com")), F.coalesce(some(F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))), some(F.regexp_extract(path, "/(?:embed|shorts)/([^/?]+)", 1))))
    return F.concat(F.lit("https://www.youtube.com/embed/"), found)


def category(title: Column, source: Column | str = "") -> Column:
    low = F.lower(F.concat(title, F.lit(" "), source if isinstance(source, Column) else F.lit(source)))
    return _first_of({name: low.rlike(words) for name, words in CATEGORY_RULES.items()}, F.lit(DEFAULT_CATEGORY))


def source_language(name: Column) -> Column:
    low = F.lower(name)
    return _first_of({lang: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) for lang, words in SOURCE_LANGUAGES.items()}, F.lit("en"))


def script_language(text: Column) -> Column:
    return _first_of({lang: F.coalesce(text, F.lit("")).rlike(rf"[\u{a:04X}-\u{b:04X}]") for lang, (a, b) in SCRIPTS.items()}, F.lit(None).cast("string"))


def language_tag(preferred: Column, *samples: Column) -> Column:
    """What the script shows overrides `en` only."""
    tag = F.lower(F.coalesce(F.nullif(preferred, F.lit("")), F.lit("en")))
    found = script_language(F.concat_ws("\n", *samples))
    return F.when(found.isNotNull() & (tag == "en"), found).otherwise(tag)


def feed_language(language: Column, name: Column) -> Column:
    return F.when(F.coalesce(language, F.lit("")).isin("", "en"), source_language(name)).otherwise(language)


def content_hash(link: Column, title: Column) -> Column:
    return F.sha2(F.coalesce(link, title, F.lit("")), 256)


def tokens(text: Column, longer_than: int = 4) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[\s\uFEFF]+"), lambda w: F.length(w) > longer_than))


def escaped_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_caption(caption: Column, title: Column, url: Column, most: int = 280) -> Column:
    return F.substring(F.concat(F.coalesce(F.nullif(caption, F.lit("")), title), F.lit("\n"), url), 1, most)


def tagged_caption(caption: Column, url: Column, tags: Column) -> Column:
    return F.concat_ws("\n", caption, url, F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))


def public_url(base: str, slug_: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/")), F.lit("/article/"), slug_)


def or_else(*parts: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def platform_text(platform: Column, title: Column, excerpt_: Column, caption: Column, url: Column) -> Column:
    """What is posted, by platform; null where the platform takes no plain text."""
    said, line = or_else(caption, title), F.lit("\n")
    link = F.concat(F.lit('<a href="'), uri(url), F.lit('">Read more</a>'))
    return (
        F.when(platform == "FACEBOOK", F.concat(said, line, line, url))
        .when(platform.isin("LINKEDIN", "THREADS"), F.concat(said, line, url))
        .when(platform == "WHATSAPP", F.concat(F.lit("*"), title, F.lit("*"), line, line, or_else(excerpt_, caption), line, line, url))
        .when(platform == "TELEGRAM", F.concat(F.lit("<b>"), escaped_html(title), F.lit("</b>"), line, line, escaped_html(excerpt_), line, line, link))
    )


def channel_target(explicit: Column, channel_url: Column) -> Column:
    """The channel's id, else the last part of its URL's path; null where there is neither."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(channel_url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    return F.coalesce(F.nullif(explicit, F.lit("")), F.try_element_at(parts, F.lit(-1)))


def slug_title(slug_: Column) -> Column:
    """A title from a slug: fallback numbers go, hyphens become spaces, each word's first letter becomes a capital."""
    clean = trimmed(F.replace(F.regexp_replace(slug_, r"(?i)-fallback-\d+$", ""), F.lit("-"), F.lit(" ")))
    words = F.transform(F.split(clean, r"(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])"), capitalised)
    return F.when(clean == "", F.lit("Preview Article")).otherwise(F.array_join(words, ""))


def capitalised(c: Column) -> Column:
    """The first letter as a capital, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def _has_any(c: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(c, F.lit("")), F.lit(m)) for m in marks])


def error_class(message: Column, code: Column) -> Column:
    """What to do about an error: a known row, a hard quota, a passing rate limit, or anything else."""
    limited = _has_any(message, RATE_LIMITED)
    return F.when(code == UNIQUE_VIOLATION, "known").when(limited & _has_any(message, QUOTA_BLOCKED), "quota").when(limited, "rate_limit").otherwise("other")


def unfenced(c: Column) -> Column:
    return F.regexp_replace(c, "```json\\n?|\\n?```", "")


def is_dead_source(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(DEAD_SOURCE))


def script_chunks(text: Column, most: int, keep: int = 40, otherwise: str = "Video update.") -> Column:
    """Sentences packed into chunks of at most `most` characters; longer sentences are cut."""
    whole = trimmed(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / most).cast("int")), lambda i: F.substr(s, i * most + 1, F.lit(most))), lambda x: x != "")
    done = lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        parts = cut(s)
        return F.when(F.length(longer) <= most, F.struct(acc["done"].alias("done"), longer.alias("cur"))).when(F.length(s) <= most, F.struct(done(acc).alias("done"), s.alias("cur"))).otherwise(
            F.struct(F.concat(done(acc), F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("done"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("cur"))
        )

    return F.when(whole == "", F.array(F.lit(otherwise))).otherwise(F.slice(F.aggregate(sentences(whole, ".!?"), start, add, done), 1, keep))


def locale_country(locale: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LOCALE_COUNTRIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, locale), F.try_element_at(known, F.split(locale, "-")[0]), F.lit(DEFAULT_COUNTRY))


def locale_language(locale: Column, chosen: Column | None = None) -> Column:
    """A stored choice if it is supported, else the locale's language if that is, else the default."""
    supported = lambda c: F.when(c.isin(APP_LANGUAGES), c)
    return F.coalesce(*([supported(chosen)] if chosen is not None else []), supported(F.lower(F.split(locale, "-")[0])), F.lit(DEFAULT_LANGUAGE))


def country_languages(own: Column, extra: Column) -> Column:
    """The default language, the country's own and its further ones, as far as they are supported, each once."""
    codes = F.array_union(F.array(F.lit(DEFAULT_LANGUAGE), own), F.coalesce(extra, F.array().cast("array<string>")))
    return F.filter(codes, lambda c: c.isin(APP_LANGUAGES))


def default_language(own: Column, own_available: Column, default_available: Column) -> Column:
    """The country's language if it is supported; the default where that alone has articles."""
    preferred = F.when(own.isin(APP_LANGUAGES), own).otherwise(DEFAULT_LANGUAGE)
    return F.when(F.coalesce(own_available, F.lit(False)), preferred).when(F.coalesce(default_available, F.lit(False)), DEFAULT_LANGUAGE).otherwise(preferred)


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f-]{36}\z"), F.lit(False))


def age_label(ts: Column, as_of: Column, just_now: int = 2, days: int = 0) -> Column:
    """Minutes, hours and, up to `days`, days of age, then the date. Under `just_now` minutes there is no number."""
    minutes = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 60)
    hours = F.floor(minutes / 60)
    number = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    out = F.when(minutes < just_now, "Just now").when(minutes < 60, number(minutes, "m")).when(hours < 24, number(hours, "h"))
    return out.when(F.floor(hours / 24) < days, number(F.floor(hours / 24), "d")).otherwise(F.date_format(ts, "d MMM"))


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "d MMMM yyyy"), F.lit("Unknown date"))


def feed_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text))


def srt_time(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((seconds % 1) * 1000))


def risk_level(score: Column) -> Column:
    return F.when(F.coalesce(score, F.lit(0.0)) < 0.3, "low").when(score < 0.6, "medium").otherwise("high")


def is_transition(old: Column, new: Column) -> Column:
    known = F.create_map(*[x for a, to in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, to)).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(known, old), new), F.lit(False))


VIDEO = "struct<title:string,narration:string,summary:string,language:string,status:string,script:string,generatedAt:string,videoUrl:string>"
#: Schema of an article's body.
BODY = f"struct<type:string,imageUrl:string,imageCredit:string,content:array<struct<type:string,content:array<struct<type:string,text:string>>>>,aiVideo:{VIDEO}>"


def body_json(parts: Column) -> Column:
    node = lambda p: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), p.alias("text"))).alias("content"))
    return F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(parts, node).alias("content")))


def with_video(body: Column, script: Column, generated_at: Column, url: Column) -> Column:
    """The body's JSON with what a finished video adds to its `aiVideo`; all other fields stay."""
    doc = F.from_json(body, BODY)
    video = F.when(doc["aiVideo"].isNull(), F.from_json(F.lit("{}"), VIDEO)).otherwise(doc["aiVideo"])
    made = {"status": F.lit("generated"), "script": script, "generatedAt": generated_at, "videoUrl": url}
    return F.to_json(doc.withField("aiVideo", reduce(lambda v, name: v.withField(name, made[name]), made, video)))


def body_paragraphs(body: Column) -> Column:
    nodes = F.filter(F.from_json(body, BODY)["content"], lambda n: n["type"] == "paragraph")
    return F.filter(F.transform(nodes, lambda n: trimmed(F.array_join(F.transform(n["content"], lambda t: F.coalesce(t["text"], F.lit(""))), ""))), lambda p: p != "")
