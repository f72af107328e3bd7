"""The expressions as SQL functions. Each body is one SQL expression, so the optimizer
puts it in place of the call: filters on it still reach the scan, and no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from storyrank import constants as K

_WS = K.WS.replace("\\", "\\\\")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _when(mapping: dict, subject: str, default: float) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in mapping.items())
    return f"CASE {subject} {cases} ELSE {default}D END"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, expression)."""
    def strip(sql: str) -> str:
        return f"regexp_replace({sql}, '^{_WS}+|{_WS}+$', '')"

    def squeeze(sql: str) -> str:
        return strip(f"regexp_replace({sql}, '{_WS}+', ' ')")

    metric = "coalesce(try_cast(try_element_at(metrics, '{}') AS DOUBLE), 0D)"
    up = " + ".join(metric.format(k) for k in ("upvotes", "score", "hf_upvotes"))
    com = " + ".join(metric.format(k) for k in ("comments", "num_comments"))
    raw = f"({up} + 0.5D * ({com}))"
    cites = f"({metric.format('citations')} + {metric.format('citationCount')})"
    age = "greatest((unix_micros(as_of) - unix_micros(at)) / 86400000000D, 0D)"
    slug = (
        "coalesce(nullif(left(regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-'),"
        " '^-+|-+$', ''), 80), ''), 'untitled')"
    )
    bare = f"regexp_replace(regexp_replace(lower({strip('url')}), '^https?://', ''), '(?s)[#?].*$', '')"
    entities = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ')"
    for entity, char in K.HTML_ENTITIES:
        entities = f"replace({entities}, '{entity}', {_quoted(char)})"
    stops = ", ".join(f"'{w}'" for w in K.TITLE_STOP_WORDS)
    tokens = (
        "array_except(transform(array_distinct(regexp_extract_all(coalesce({0}, ''), '([A-Za-z]{{3,}})', 1)),"
        f" w -> lower(w)), array({stops}))"
    )
    numbers = (
        f"filter(transform(regexp_extract_all(coalesce(body, ''), {_quoted(K.SIGNIFICANT_NUMBER)}, 0),"
        f" t -> replace(regexp_extract(t, {_quoted(K.NUMBER_CORE)}, 0), ',', '')), n -> n <> '')"
    )
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    return {
        "sr_content_hash": ("url STRING, body STRING", "STRING",
            f"sha2(coalesce(lower(nullif({strip('url')}, '')), lower({squeeze('coalesce(body, chr(32))')})), 256)"),
        "sr_slug": ("value STRING", "STRING", slug),
        "sr_is_release": ("title STRING", "BOOLEAN",
            f"coalesce(title RLIKE {_quoted(K.RELEASE_TITLE)} OR title RLIKE {_quoted(K.DEAL_TITLE)}, false)"),
        "sr_is_recap": ("title STRING", "BOOLEAN", f"coalesce(title RLIKE {_quoted(K.RECAP_TITLE)}, false)"),
        "sr_announce_score": ("title STRING", "DOUBLE",
            f"CASE WHEN title RLIKE {_quoted(K.ANNOUNCE_TITLE)} THEN 1D WHEN title RLIKE {_quoted(K.ESSAY_TITLE)} THEN 0D ELSE 0.4D END"),
        "sr_engagement": ("metrics MAP<STRING, DOUBLE>", "DOUBLE",
            f"CASE WHEN {raw} <= 0 THEN 0D ELSE least(1D, pow({raw} / {K.VIRAL_ENGAGEMENT}D, {K.ENGAGEMENT_POWER}D)) END"),
        "sr_citation_velocity": ("metrics MAP<STRING, DOUBLE>, at TIMESTAMP, as_of TIMESTAMP", "DOUBLE",
            f"CASE WHEN {cites} <= 0 THEN 0D ELSE least(1D, log1p({cites} / greatest({age}, 1D)) / log1p(5D)) END"),
        "sr_authority": ("family STRING, source STRING", "DOUBLE",
            f"greatest({_when(K.FAMILY_AUTHORITY, 'family', K.UNKNOWN_AUTHORITY)}, {_when(K.SOURCE_AUTHORITY, 'source', 0.0)})"),
        "sr_decay": ("at TIMESTAMP, as_of TIMESTAMP, half_life_days DOUBLE", "DOUBLE",
            f"CASE WHEN half_life_days <= 0 THEN 1D ELSE pow(0.5D, {age} / half_life_days) END"),
        "sr_saturate": ("v DOUBLE, k DOUBLE", "DOUBLE",
            "CASE WHEN greatest(0D, v) + k > 0 THEN greatest(0D, v) / (greatest(0D, v) + k) ELSE 0D END"),
        "sr_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
            f"CASE WHEN size(a) > 0 AND size(a) = size(b) AND {dot.format('a', 'a')} > 0 AND {dot.format('b', 'b')} > 0"
            f" THEN greatest(-1D, least(1D, {dot.format('a', 'b')} / (sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})))) ELSE 0D END"),
        "sr_url_path": ("url STRING", "STRING",
            "CASE WHEN url <> '' THEN coalesce(nullif(regexp_replace(regexp_extract(" + bare + ", '(?s)/.*$', 0), '/+$', ''), ''), " + bare + ") END"),
        "sr_arxiv_id": ("raw_id STRING, url STRING", "STRING",
            "nullif(substring_index(coalesce(nullif(raw_id, ''), CASE WHEN contains(url, 'arxiv.org/abs/')"
            " THEN substring_index(url, '/abs/', -1) END), 'v', 1), '')"),
        "sr_html_to_text": ("html STRING", "STRING", f"left({squeeze(entities)}, {K.HTML_CHARS})"),
        "sr_snippet": ("body STRING", "STRING", f"left({squeeze('coalesce(body, chr(32))')}, {K.SNIPPET_CHARS})"),
        "sr_link_label": ("url STRING", "STRING",
            "CASE " + " ".join(f"WHEN contains(lower(url), '{n}') THEN '{v}'" for n, v in K.LINK_LABELS)
            + " ELSE coalesce(nullif(regexp_extract(url, 'https?://(?:www\\\\.)?([^/]+)', 1), ''), 'link') END"),
        "sr_title_tokens": ("title STRING", "ARRAY<STRING>", tokens.format("title")),
        "sr_title_jaccard": ("a STRING, b STRING", "DOUBLE",
            f"CASE WHEN size({tokens.format('a')}) = 0 OR size({tokens.format('b')}) = 0 THEN 0D ELSE"
            f" size(array_intersect({tokens.format('a')}, {tokens.format('b')})) / size(array_union({tokens.format('a')}, {tokens.format('b')})) END"),
        "sr_sig_numbers": ("body STRING", "ARRAY<STRING>", numbers),
        "sr_ungrounded": ("body STRING, ground STRING", "ARRAY<STRING>",
            f"filter({numbers}, n -> NOT contains(replace(coalesce(ground, ''), ',', ''), n))"),
        "sr_is_anecdote": ("title STRING", "BOOLEAN", f"coalesce(title RLIKE {_quoted(K.ANECDOTE_TITLE)}, false)"),
        "sr_is_promo": ("title STRING", "BOOLEAN",
            "coalesce(" + " OR ".join(f"startswith({strip('lower(title)')}, '{p}')" for p in K.SELF_PROMO_PREFIXES)
            + " OR contains(lower(title), '[p]'), false)"),
        "sr_is_relevant": ("body STRING", "BOOLEAN",
            "coalesce(" + " OR ".join(f"contains(lower(body), '{k}')" for k in K.RELEVANCE_KEYWORDS) + ", false)"),
        "sr_clamp01": ("v STRING, fallback DOUBLE", "DOUBLE",
            "CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN fallback ELSE greatest(0D, least(1D, try_cast(v AS DOUBLE))) END"),
        "sr_weekly_id": ("day DATE", "STRING",
            "concat('weekly-', extract(YEAROFWEEK FROM day), '-W', lpad(CAST(weekofyear(day) AS STRING), 2, '0'))"),
        "sr_story_id": ("title STRING, ids ARRAY<STRING>", "STRING",
            f"concat({slug.replace('value', 'title')}, '-', left(sha2(array_join(sort_array(ids), '|'), 256), 8))"),
        "sr_week_of": ("day DATE", "DATE", "CAST(trunc(day, 'WEEK') AS DATE)"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    made = []
    for name, (params, returns, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
        made.append(name)
    return made
