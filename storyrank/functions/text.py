"""Column expressions over text, titles, URLs and dates (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyrank import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def any_of(needles, test) -> Column:
    """OR of ``test(needle)`` over a fixed list; false when the list is empty."""
    out = F.lit(False)
    for needle in needles:
        out = out | test(needle)
    return out


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_array(values, kind: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


# --- whitespace -----------------------------------------------------------------
def strip(col) -> Column:
    return F.btrim(_c(col), F.lit(K.WS_CHARS))


def rstrip(col) -> Column:
    return F.rtrim(_c(col), F.lit(K.WS_CHARS))


def squeeze(col) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), f"{K.WS}+", " "))


def non_blank(col) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


# --- identity -------------------------------------------------------------------
def content_hash(url, text) -> Column:
    basis = F.coalesce(
        F.lower(non_blank(url)),
        F.lower(squeeze(F.coalesce(_c(text), F.lit("")))),
    )
    return F.sha2(basis, 256)


def item_id(url, title, body) -> Column:
    joined = F.concat(F.coalesce(_c(title), F.lit("")), F.lit("\n"), F.coalesce(_c(body), F.lit("")))
    return content_hash(url, joined)


def slugify(col, max_len: int = 80) -> Column:
    dashed = F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "-")
    cut = F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(max_len))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled"))


def story_id(title, item_ids) -> Column:
    digest = F.sha2(F.array_join(F.sort_array(_c(item_ids)), "|"), 256)
    return F.concat(slugify(title), F.lit("-"), F.left(digest, F.lit(8)))


# --- URLs -----------------------------------------------------------------------
def url_path(col) -> Column:
    """Path key without scheme, host, query and fragment; the host if there is no path."""
    bare = F.regexp_replace(F.lower(strip(col)), "^https?://", "")
    bare = F.regexp_replace(bare, r"(?s)[#?].*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)/.*$", 0), "/+$", "")
    return F.when(_c(col) != "", F.coalesce(F.nullif(path, F.lit("")), bare))


def arxiv_id(raw_id, url) -> Column:
    """Version-free paper id from metadata, else from an abstract-page URL."""
    from_url = F.when(
        F.contains(_c(url), F.lit("arxiv.org/abs/")), F.substring_index(_c(url), "/abs/", -1)
    )
    full = F.coalesce(F.nullif(_c(raw_id), F.lit("")), from_url)
    return F.nullif(F.substring_index(full, "v", 1), F.lit(""))


def first_paper_id(*cols) -> Column:
    """First ``dddd.ddddd`` found, looking through the columns in order."""
    found = [F.nullif(F.regexp_extract(_c(c), K.PAPER_ID, 1), F.lit("")) for c in cols]
    return F.coalesce(*found)


def link_label(url) -> Column:
    low = F.lower(_c(url))
    host = F.nullif(F.regexp_extract(_c(url), r"https?://(?:www\.)?([^/]+)", 1), F.lit(""))
    out = F.coalesce(host, F.lit("link"))
    for needle, label in reversed(K.LINK_LABELS):
        out = F.when(F.contains(low, F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def trim_links(links, n: int) -> Column:
    """First ``n`` distinct non-blank links, order kept."""
    kept = F.filter(_c(links), lambda u: u.isNotNull() & (u != ""))
    return F.slice(F.array_distinct(kept), 1, n)


# --- titles ---------------------------------------------------------------------
def title_tokens(col) -> Column:
    words = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit("([A-Za-z]{3,})"), F.lit(1))
    return F.array_except(F.transform(F.array_distinct(words), F.lower), literal_array(K.TITLE_STOP_WORDS))


def token_jaccard(a, b) -> Column:
    """Overlap of two token sets; 0 when either is empty."""
    both = F.size(F.array_intersect(_c(a), _c(b)))
    either = F.size(F.array_union(_c(a), _c(b)))
    return F.when((F.size(_c(a)) == 0) | (F.size(_c(b)) == 0), F.lit(0.0)).otherwise(both / either)


def _matches(col, pattern: str) -> Column:
    return F.coalesce(F.rlike(_c(col), F.lit(pattern)), F.lit(False))


def is_release_title(col) -> Column:
    return _matches(col, K.RELEASE_TITLE) | _matches(col, K.DEAL_TITLE)


def is_recap_title(col) -> Column:
    return _matches(col, K.RECAP_TITLE)


def is_anecdote_title(col) -> Column:
    return _matches(col, K.ANECDOTE_TITLE)


def is_promo_title(col) -> Column:
    low = strip(F.lower(_c(col)))
    hit = any_of(K.SELF_PROMO_PREFIXES, lambda p: F.startswith(low, F.lit(p)))
    return F.coalesce(hit | F.contains(low, F.lit("[p]")), F.lit(False))


def announce_score(col) -> Column:
    return (
        F.when(_matches(col, K.ANNOUNCE_TITLE), F.lit(1.0))
        .when(_matches(col, K.ESSAY_TITLE), F.lit(0.0))
        .otherwise(F.lit(0.4))
    )


def is_relevant(*cols) -> Column:
    """Substring test against the keyword list over all given texts."""
    blob = F.lower(F.concat_ws(" ", *[F.nullif(_c(c), F.lit("")) for c in cols]))
    return any_of(K.RELEVANCE_KEYWORDS, lambda k: F.contains(blob, F.lit(k)))


# --- markup ---------------------------------------------------------------------
def html_to_text(col, n: int = K.HTML_CHARS) -> Column:
    out = F.regexp_replace(F.coalesce(_c(col), F.lit("")), "<[^>]+>", " ")
    for entity, char in K.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.left(squeeze(out), F.lit(n))


def html_to_text_blocks(col) -> Column:
    out = F.regexp_replace(_c(col), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|h[1-6]|li|tr)>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# --- dates ----------------------------------------------------------------------
def parse_dt(col) -> Column:
    """ISO text, RFC 822 text or epoch seconds to a timestamp; NULL when none fits."""
    text = strip(_c(col).cast("string"))
    mail = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    mail = F.regexp_replace(mail, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    epoch = F.when(F.rlike(text, F.lit(r"^-?\d{7,}(\.\d+)?$")), text.try_cast("double"))
    return F.coalesce(
        text.try_cast("timestamp"),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm[:ss] xx")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm[:ss]")),
        epoch.cast("timestamp"),
    )


def from_epoch_seconds(col) -> Column:
    return _c(col).try_cast("double").cast("timestamp")


def week_of(col) -> Column:
    """Monday of the week."""
    return F.trunc(_c(col), "WEEK").cast("date")


def weekly_id(col) -> Column:
    day = _c(col)
    return F.concat(
        F.lit("weekly-"),
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def week_dates(col) -> Column:
    monday = week_of(col)
    return F.sequence(monday, F.date_add(monday, 6), F.expr("interval 1 day"))


def local_date(ts, tz: str) -> Column:
    """Calendar day of a UTC timestamp in a named zone."""
    return F.to_date(F.from_utc_timestamp(_c(ts), tz))


# --- clipping -------------------------------------------------------------------
def _rfind(col: Column, sep: str) -> Column:
    """0-based index of the last occurrence, -1 when absent."""
    at = F.locate(sep[::-1], F.reverse(col))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(col) - (at - 1) - len(sep))


def clip(col, limit) -> Column:
    """At most ``limit`` characters, ending at a sentence, clause or word boundary."""
    text = strip(col)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.left(text, limit)
    half = limit * 0.5
    sentence, semi, comma, space = (_rfind(cut, s) for s in (". ", "; ", ", ", " "))
    word = rstrip(F.when(space > 0, F.left(cut, space)).otherwise(cut))
    ellipsis = F.lit("…")
    return (
        F.when(F.length(text) <= limit, text)
        .when(sentence > half, strip(F.left(cut, sentence + 1)))
        .when(semi > half, F.concat(strip(F.left(cut, semi)), ellipsis))
        .when(comma > half, F.concat(strip(F.left(cut, comma)), ellipsis))
        .otherwise(F.concat(word, ellipsis))
    )


def clip_sentence(col, limit: int) -> Column:
    """Cut after the last complete sentence; word clipping when there is none."""
    text = strip(col)
    cut = F.left(text, F.lit(limit))
    last = F.greatest(*[_rfind(cut, s) for s in (". ", "! ", "? ")])
    return (
        F.when(F.length(text) <= limit, text)
        .when(last > 0, strip(F.left(cut, last + 1)))
        .otherwise(clip(col, limit))
    )


def snippet(body, n: int = K.SNIPPET_CHARS) -> Column:
    return F.left(squeeze(F.coalesce(_c(body), F.lit(""))), F.lit(n))


def embedding_text(title, body) -> Column:
    lead = non_blank(F.left(F.coalesce(_c(body), F.lit("")), F.lit(K.EMBED_LEAD_CHARS)))
    return F.concat_ws("\n", _c(title), lead)


# --- tags, lists, profile -------------------------------------------------------
def tag_key(col) -> Column:
    spelled = F.replace(F.lower(_c(col)), F.lit("&"), F.lit("and"))
    return strip(F.replace(spelled, F.lit("  "), F.lit(" ")))


def canonical_tags(tags, catalogue, n: int = 3) -> Column:
    """First ``n`` non-blank tags in the catalogue's own spelling where it has one."""
    known = F.map_from_entries(
        F.array(*[F.struct(tag_key(F.lit(t)), F.lit(t)) for t in catalogue])
    )
    given = F.slice(F.filter(F.transform(_c(tags), strip), lambda t: t != ""), 1, n)
    return F.transform(given, lambda t: F.coalesce(F.try_element_at(known, tag_key(t)), t))


def dedupe_ci(arr) -> Column:
    """Case-insensitive distinct, first spelling and order kept."""
    keys = F.transform(_c(arr), F.lower)
    return F.filter(_c(arr), lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def merge_ids(a, b) -> Column:
    return F.array_distinct(F.concat(_c(a), _c(b)))


def profile_text(subfields, venues, voices, must_follow) -> Column:
    """The sentence block that is embedded to represent a reader."""

    def clean(arr):
        return F.filter(
            F.transform(F.coalesce(_c(arr), literal_array([])), strip), lambda x: x != ""
        )

    def line(arr, head, sep):
        return F.when(F.size(arr) > 0, F.concat(F.lit(head), F.array_join(arr, sep), F.lit(".")))

    heard = clean(voices)
    heard = F.when(F.size(heard) > 0, heard).otherwise(clean(must_follow))
    text = F.concat_ws(
        "\n",
        line(clean(subfields), "Research subfields: ", "; "),
        line(clean(venues), "Primary venues: ", ", "),
        line(heard, "Voices followed: ", ", "),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(K.DEFAULT_PROFILE_TEXT))


# --- numbers in generated text --------------------------------------------------
def sig_numbers(col) -> Column:
    """Bare cores of money, percentage, magnitude and decimal tokens."""
    tokens = F.regexp_extract_all(
        F.coalesce(_c(col), F.lit("")), F.lit(K.SIGNIFICANT_NUMBER), F.lit(0)
    )
    cores = F.transform(
        tokens,
        lambda t: F.replace(F.regexp_extract(t, K.NUMBER_CORE, 0), F.lit(","), F.lit("")),
    )
    return F.filter(cores, lambda n: n != "")


def ungrounded(text, ground) -> Column:
    """Number cores in ``text`` that the comma-free source text does not contain."""
    source = F.replace(F.coalesce(_c(ground), F.lit("")), F.lit(","), F.lit(""))
    return F.filter(sig_numbers(text), lambda n: ~F.contains(source, n))


def sentences(text) -> Column:
    return F.split(strip(F.coalesce(_c(text), F.lit(""))), rf"(?<=[.!?]){K.WS}+")


def strip_ungrounded(text, ground) -> Column:
    """struct(text, dropped): sentences carrying an ungrounded number are removed."""
    every = sentences(text)
    kept = F.filter(every, lambda s: F.size(ungrounded(s, ground)) == 0)
    return F.struct(
        strip(F.array_join(kept, " ")).alias("text"),
        (F.size(every) - F.size(kept)).alias("dropped"),
    )


# --- tolerant parsing -----------------------------------------------------------
def parse_json_obj(col) -> Column:
    """VARIANT object out of model text; NULL when there is none."""
    text = strip(F.coalesce(_c(col), F.lit("")))
    bare = F.regexp_replace(text, "^`+|`+$", "")
    inner = F.when(
        F.contains(bare, F.lit("\n")), F.regexp_replace(bare, r"(?s)^[^\n]*\n", "")
    ).otherwise(bare)
    clean = F.when(F.startswith(text, F.lit("```")), strip(inner)).otherwise(text)
    whole = F.try_parse_json(clean)
    braces = F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))
    value = F.coalesce(whole, F.try_parse_json(braces))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def text_upvotes(col) -> Column:
    return F.coalesce(F.regexp_extract(_c(col), K.TEXT_UPVOTES, 1).try_cast("bigint"), F.lit(0))
