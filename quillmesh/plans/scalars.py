"""F: scalar functions over items, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import numeric as N
from quillmesh.functions import text as T
from quillmesh.functions import urls as U
from quillmesh.session import ship
from quillmesh.sources.fixtures import NOW_S, articles, read, with_tables

from .base import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
W = r"[\p{L}\p{N}]+"


@query("f01_collapse_plain", r"""SELECT page_id, trim(regexp_replace(html, '[ \t\n\r\f]+', ' ', 'g')) AS collapsed,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS body FROM pages""")
def f01(spark, d):
    return read(spark, d, "pages").select("page_id", T.collapse(F.col("html")).alias("collapsed"), T.plain(F.col("html")).alias("body"))


@query("f02_parse_dates", """SELECT event_id, date_trunc('second', ts) AS from_rfc, date_trunc('second', ts) AS from_iso, CAST(NULL AS TIMESTAMP) AS from_junk FROM events""")
def f02(spark, d):
    ts = F.col("ts")
    rfc = F.date_format(ts, "d MMM yyyy HH:mm:ss")
    stamped = F.concat(F.lit("Thu, "), rfc, F.lit(" +0000"))
    parse = lambda x: F.coalesce(F.try_to_timestamp(F.regexp_replace(x, r"^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return read(spark, d, "events").select("event_id", parse(stamped).cast("timestamp_ntz").alias("from_rfc"), parse(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz").alias("from_iso"), parse(F.lit("no date")).cast("timestamp_ntz").alias("from_junk"))


@query("f03_title_words", with_tables("articles") + rf"SELECT id, regexp_extract_all(lower(regexp_replace(title, '\s+[-|–—:]\s+[^-|–—:]{{1,40}}$', '')), '{W}') AS words FROM articles")
def f03(spark, d):
    return articles(spark, d).select("id", T.title_words(F.col("title")).alias("words"))


@query("f04_strip_outlet", with_tables("articles") + r"""SELECT id, regexp_replace(title, p, '') AS bare, regexp_replace(title || ' - The Daily of ' || upper(source_id), p, '') AS stripped, regexp_replace(title || ' - the daily', p, '') AS kept
  FROM articles, (SELECT '\s+[-|–—]\s+[A-Z0-9][\p{L}\p{N}_.&''’]*(?:\s+(?:[A-Z0-9][\p{L}\p{N}_.&''’]*|of|the|and|for|on|in)){0,5}\s*$' AS p)""")
def f04(spark, d):
    """an outlet's name goes, a tail in small letters stays."""
    tailed = lambda *x: T.strip_outlet(F.concat("title", *x))
    return articles(spark, d).select("id", tailed().alias("bare"), tailed(F.lit(" - The Daily of "), F.upper("source_id")).alias("stripped"), tailed(F.lit(" - the daily")).alias("kept"))


@query("f05_bigrams", with_tables("articles") + rf"""SELECT id, CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS pairs
  FROM (SELECT id, regexp_extract_all(lower(regexp_replace(title, '\s+[-|–—:]\s+[^-|–—:]{{1,40}}$', '')), '{W}') AS w FROM articles)""")
def f05(spark, d):
    return articles(spark, d).withColumn("w", T.title_words(F.col("title"))).select("id", T.bigrams(F.col("w")).alias("pairs"))


@query("f06_jaccard", with_tables("articles") + r"""SELECT a.id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS similarity
  FROM (SELECT id, list_distinct(string_split(title, ' ')) AS w FROM articles) a JOIN (SELECT id, list_distinct(string_split(title, ' ')) AS w FROM articles) b ON b.id = a.id + 1""")
def f06(spark, d):
    a = articles(spark, d).select("id", F.array_distinct(F.split("title", " ")).alias("w"))
    b = a.select((F.col("id") - 1).alias("id"), F.col("w").alias("x"))
    return a.join(b, "id").select("id", T.jaccard(F.col("w"), F.col("x")).alias("similarity"))


@query("f07_hash60", with_tables("articles") + "SELECT id, CAST(('0x' || substr(md5(title), 1, 15)) AS BIGINT) AS h FROM articles")
def f07(spark, d):
    return articles(spark, d).select("id", T.hash60(F.col("title")).alias("h"))


@query("f09_plural_fold", with_tables("articles") + r"""SELECT w, CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y'
    WHEN length(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN substr(w, 1, length(w) - 1) ELSE w END AS folded,
  CASE WHEN length(w) > 3 THEN regexp_replace(regexp_replace(w, 's$', ''), 'ie$', 'y') ELSE w END AS work_folded
  FROM (SELECT DISTINCT unnest(string_split(lower(title), ' ')) AS w FROM articles)""")
def f09(spark, d):
    w = articles(spark, d).select(F.explode(F.split(F.lower("title"), " ")).alias("w")).distinct()
    return w.select("w", T.plural_fold(F.col("w")).alias("folded"), T.work_fold(F.col("w")).alias("work_folded"))


@query("f10_demonym_fold", with_tables("articles") + """SELECT id, list_transform(string_split(lower(title), ' '), lambda w: CASE w WHEN 'nicht' THEN 'not' WHEN 'avec' THEN 'with' WHEN 'para' THEN 'for' ELSE w END) AS folded FROM articles""")
def f10(spark, d):
    table = F.create_map(*[F.lit(x) for x in ("nicht", "not", "avec", "with", "para", "for")])
    return articles(spark, d).select("id", F.transform(F.split(F.lower("title"), " "), lambda w: F.coalesce(table[w], w)).alias("folded"))


@query("f11_dotted_thousands", "SELECT item, joined FROM (VALUES ('The U.N. met', 'The UN met'), ('U.S.A. and 1,234,567 more', 'USA and 1234567 more'), ('no. 5', 'no. 5'), ('12,34', '12,34')) t(item, joined)")
def f11(spark, d):
    rows = spark.createDataFrame([("The U.N. met",), ("U.S.A. and 1,234,567 more",), ("no. 5",), ("12,34",)], "item string")
    return rows.select("item", T.dotted(F.col("item")).alias("joined"))


@query("f12_amounts", "SELECT item, tokens FROM (VALUES ('a $5 bn deal and 3 million more', '$5e+09 #3e+06'), ('€12.345', '$12.3'), ('none', '')) t(item, tokens)")
def f12(spark, d):
    ship(spark)
    rows = spark.createDataFrame([("a $5 bn deal and 3 million more",), ("€12.345",), ("none",)], "item string")
    return rows.select("item", T.amount_tokens("item").alias("tokens"))


@query("f13_content_words", with_tables("articles") + rf"""SELECT id, list_filter(regexp_extract_all(lower(title), '{W}'), lambda w: w NOT IN ({STOP}) AND CASE WHEN regexp_matches(w, '^\d+$') THEN length(w) >= 3 ELSE length(w) >= 2 END) AS words FROM articles""")
def f13(spark, d):
    return articles(spark, d).select("id", T.content_words(F.col("title")).alias("words"))


@query("f14_entities", with_tables("articles") + rf"""SELECT id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(title, '{W}'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND length(w) >= 2 AND lower(w) NOT IN ({STOP})), lambda w: lower(w)))) AS entities FROM articles""")
def f14(spark, d):
    w = F.regexp_extract_all("title", F.lit(f"({T.WORD})"))
    keep = F.filter(w, lambda x: x.rlike(r"^\p{Lu}") & (F.length(x) >= 2) & ~F.lower(x).isin(T.STOPWORDS))
    return articles(spark, d).select("id", F.array_sort(F.array_distinct(F.transform(keep, F.lower))).alias("entities"))


@query("f17_cosine", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cos,
  round(0.2 * greatest(0, least(1, (list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) - 0.775) / 0.225)), 9) AS term FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f17(spark, d):
    a = read(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = N.cosine(F.col("embedding"), F.col("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(c, 9).alias("cos"), F.round(N.embed_term(c), 9).alias("term"))


@query("f19_decay_recency", with_tables("articles") + f"""SELECT id, round(exp(-({NOW_S} - published_s) / 86400.0), 9) AS decay, CAST(round_even(20 * pow(2, -(({NOW_S} - published_s) / 3600.0) / 12), 0) AS BIGINT) AS points,
  CAST(floor(round(pow(2, -(({NOW_S} - published_s) / 3600.0) / 12), 9) * 1e6 + 0.5) AS BIGINT) AS micro FROM articles""")
def f19(spark, d):
    age = (F.lit(NOW_S) - F.col("published_s")) / 3600.0
    return articles(spark, d).select("id", F.round(N.decay(age * 3600), 9).alias("decay"), N.recency_points(age).alias("points"), N.micro(F.round(F.pow(F.lit(2.0), -age / 12), 9)).alias("micro"))


@query("f22_quantize", """SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 127 / p, 0) AS INT)) AS bytes
  FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS p FROM embeddings)""")
def f22(spark, d):
    return read(spark, d, "embeddings").select("vec_id", N.quantized(F.col("embedding")).alias("bytes"))


@query("f23_base64", with_tables("articles") + "SELECT id, base64(encode(title)) AS coded, decode(from_base64(base64(encode(title)))) AS back FROM articles")
def f23(spark, d):
    coded = F.regexp_replace(F.base64(F.encode("title", "utf-8")), r"\s", "")
    return articles(spark, d).select("id", coded.alias("coded"), F.decode(F.unbase64(coded), "utf-8").alias("back"))


@query("f24_tokens_bytes", with_tables("articles") + """SELECT id, CAST(ceil(strlen(title) / 3.0) + 2 AS BIGINT) AS tokens, CAST(strlen('{"id":' || id || ',"source_id":"' || source_id || '"}') AS BIGINT) AS record_bytes FROM articles""")
def f24(spark, d):
    record = F.octet_length(F.to_json(F.struct("id", "source_id"))).cast("long")
    return articles(spark, d).select("id", N.token_estimate(F.col("title")).alias("tokens"), record.alias("record_bytes"))


@query("f26_canonical_url", r"""SELECT page_id, regexp_replace(h, '^www\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN len(p) > 0 THEN '?' || array_to_string(p, '&') ELSE '' END AS canonical,
  CASE WHEN len(x) <= 2 THEN array_to_string(x, '.') ELSE array_to_string(x[len(x) - 1:len(x)], '.') END AS domain
  FROM (SELECT *, string_split(regexp_replace(h, '^www\.', ''), '.') AS x FROM (SELECT *, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS h, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '^(utm_.*|oc|ocid|cmpid|smid|fbclid|gclid|ref)$'))) AS p FROM pages))""")
def f26(spark, d):
    return read(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"), U.base_domain(F.col("url")).alias("domain"))


@query("f28_title_key", with_tables("articles") + rf"""SELECT id, CASE WHEN length(k) >= 20 AND len(string_split(k, ' ')) >= 3 THEN k END AS key FROM (SELECT id, array_to_string(regexp_extract_all(lower(title), '{W}'), ' ') AS k FROM articles)""")
def f28(spark, d):
    k = F.array_join(F.regexp_extract_all(F.lower("title"), F.lit(f"({T.WORD})")), " ")
    return articles(spark, d).withColumn("k", k).select("id", F.when((F.length("k") >= 20) & (F.size(F.split("k", " ")) >= 3), F.col("k")).alias("key"))


@query("f29_watch_tag", with_tables("articles") + r"SELECT id, 'w:' || substr(sha256(lower(trim(regexp_replace(title, '[ \t\n\r\f]+', ' ', 'g')))), 1, 10) AS tag FROM articles")
def f29(spark, d):
    return articles(spark, d).select("id", T.watch_tag(F.col("title")).alias("tag"))


@query("f30_nfkd_fold", with_tables("articles") + "SELECT id, lower(strip_accents(title)) AS folded FROM articles")
def f30(spark, d):
    ship(spark)
    return articles(spark, d).select("id", F.lower(T.nfkd("title")).alias("folded"))


@query("f31_contains_words", with_tables("articles") + "SELECT a.id, contains(' ' || lower(a.dek) || ' ', ' ' || lower(array_to_string(string_split(b.title, ' ')[2:3], ' ')) || ' ') AS found FROM articles a JOIN articles b ON b.id = a.id")
def f31(spark, d):
    return articles(spark, d).select("id", T.contains_words(F.split(F.lower("dek"), " "), F.slice(F.split(F.lower("title"), " "), 2, 2)).alias("found"))


@query("f32_quoted_spans", with_tables("articles") + r"""SELECT id, list_filter([replace(title, '"', ''''), replace(dek, '"', '''')], lambda x: length(x) >= 8) AS spans
  FROM (SELECT id, translate(title, '‘’“”–—', '''''""--') AS title, translate(array_to_string(string_split(dek, ' ')[1:6], ' '), '‘’“”–—', '''''""--') AS dek FROM articles) WHERE title <> '' AND dek <> ''""")
def f32(spark, d):
    """F32: all quoted spans of eight characters or more, typographic and plain quotes alike."""
    inner = lambda x: F.replace(T.quote_fold(x), F.lit('"'), F.lit("'"))
    a = articles(spark, d).select("id", inner(F.col("title")).alias("title"), inner(F.array_join(F.slice(F.split("dek", " "), 1, 6), " ")).alias("dek")).filter("title != '' and dek != ''")
    said = F.concat(F.lit("He said “"), "title", F.lit('” and then "'), "dek", F.lit('" and “ok”, no more'))
    return a.select("id", T.quoted_spans(said).alias("spans"))


@query("f34_cut_at_word", with_tables("articles") + r"""SELECT id, CASE WHEN length(dek) <= 80 THEN dek WHEN regexp_extract(substr(dek, 1, 81), '^(.*) ', 1) = '' THEN substr(dek, 1, 80) ELSE regexp_extract(substr(dek, 1, 81), '^(.*) ', 1) END AS lead FROM articles""")
def f34(spark, d):
    return articles(spark, d).select("id", T.cut_at_word(F.col("dek"), 80).alias("lead"))


@query("f36_sentences", with_tables("articles") + r"""SELECT id, list_filter(list_transform(string_split(regexp_replace(dek, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM articles""")
def f36(spark, d):
    return articles(spark, d).select("id", T.sentences(F.col("dek")).alias("parts"))


@query("f35_junk_strip", with_tables("articles") + r"SELECT id, trim(regexp_replace(regexp_replace(dek, '[#%&*$]{3}', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS clean FROM articles")
def f35(spark, d):
    out = F.col("dek")
    for _ in range(3):  # to a fixpoint: what is left may not join to junk again
        out = F.regexp_replace(out, r"[#%&*$]{3}", "")
    return articles(spark, d).select("id", T.collapse(out).alias("clean"))


@query("f37_quote_fold", "SELECT item, folded FROM (VALUES ('“a” – ‘b’', '\"a\" - ''b'''), ('plain', 'plain')) t(item, folded)")
def f37(spark, d):
    return spark.createDataFrame([("“a” – ‘b’",), ("plain",)], "item string").select("item", T.quote_fold(F.col("item")).alias("folded"))


@query("f39_headline_key", with_tables("articles") + r"""SELECT w, CASE WHEN length(k) > 3 AND ends_with(k, 's') AND NOT ends_with(k, 'ss') THEN substr(k, 1, length(k) - 1) ELSE k END AS key FROM (SELECT w, regexp_replace(lower(w), '[''’]s$', '') AS k FROM (SELECT DISTINCT unnest(string_split(title, ' ')) AS w FROM articles))""")
def f39(spark, d):
    return articles(spark, d).select(F.explode(F.split("title", " ")).alias("w")).distinct().select("w", T.headline_key(F.col("w")).alias("key"))


@query("f41_iso_week", "SELECT event_id, strftime(ts, '%G') || 'W' || strftime(ts, '%V') AS week FROM events")
def f41(spark, d):
    return read(spark, d, "events").select("event_id", N.iso_week(F.col("ts")).alias("week"))


@query("f42_age_text", with_tables("articles") + f"""SELECT id, CASE WHEN h < 1 THEN 'just now' WHEN h < 2 THEN '1 hour ago' WHEN h < 24 THEN CAST(floor(h) AS INT) || ' hours ago' WHEN h < 48 THEN '1 day ago' ELSE CAST(floor(h / 24) AS INT) || ' days ago' END AS age FROM (SELECT id, ({NOW_S} - published_s) / 3600.0 AS h FROM articles)""")
def f42(spark, d):
    h = (F.lit(NOW_S) - F.col("published_s")) / 3600.0
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(f" {unit}s ago"))
    return articles(spark, d).select("id", F.when(h < 1, "just now").when(h < 2, "1 hour ago").when(h < 24, n(h, "hour")).when(h < 48, "1 day ago").otherwise(n(h / 24, "day")).alias("age"))


@query("f43_answer_bands", """SELECT event_id, CASE WHEN p >= 0.6 AND p - q >= 0.15 THEN 'sure' WHEN p >= 0.4 AND p - q >= 0.15 THEN 'leaning' ELSE 'split' END AS choice, CASE WHEN p >= 0.7 THEN 'likely' WHEN p >= 0.4 THEN 'possible' ELSE 'low' END AS noul
  FROM (SELECT event_id, (event_id % 101) / 100.0 AS p, ((event_id * 7) % 51) / 100.0 AS q FROM events)""")
def f43(spark, d):
    p, q = (F.col("event_id") % 101 / 100.0).cast("double"), (F.col("event_id") * 7 % 51 / 100.0).cast("double")
    return read(spark, d, "events").select("event_id", N.choice_band(F.round(p, 2), F.round(q, 2)).alias("choice"), N.likely_band(p).alias("noul"))


@query("f44_clean_answers", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def f44(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("f45_weighted_points", """SELECT event_id, round(8 * (event_id % 5) / 10.0 + 4 * (event_id % 3) / 10.0 - 6 * (event_id % 2) / 10.0, 9) AS points FROM events""")
def f45(spark, d):
    p = F.create_map(F.lit("report"), F.col("event_id") % 5 / 10.0, F.lit("analysis"), F.col("event_id") % 3 / 10.0, F.lit("summary"), F.col("event_id") % 2 / 10.0)
    worth = F.create_map(F.lit("report"), F.lit(8), F.lit("analysis"), F.lit(4), F.lit("summary"), F.lit(-6))
    total = F.aggregate(F.map_entries("p"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(worth[e["key"]], F.lit(0)))
    return read(spark, d, "events").withColumn("p", p).select("event_id", F.round(total, 9).alias("points"))


@query("f46_event_slug", with_tables("articles") + r"""SELECT id, CASE WHEN regexp_full_match(s, '[a-z0-9-]{1,60}') THEN 'e_' || s ELSE 'e_' || substr(sha256(e), 1, 12) END AS slug FROM (SELECT id, e, replace(e, ' ', '-') AS s FROM (SELECT id, lower(array_to_string(string_split(title, ' ')[1:2], ' ')) AS e FROM articles))""")
def f46(spark, d):
    e = F.lower(F.array_join(F.slice(F.split("title", " "), 1, 2), " "))
    s = F.replace(e, F.lit(" "), F.lit("-"))
    return articles(spark, d).select("id", F.when(s.rlike("^[a-z0-9-]{1,60}$"), F.concat(F.lit("e_"), s)).otherwise(F.concat(F.lit("e_"), F.substring(F.sha2(e, 256), 1, 12))).alias("slug"))


@query("f49_image_tags", r"""SELECT page_id, len(regexp_extract_all(html, '<img[^>]*>')) AS images, len(regexp_extract_all(html, '<a [^>]*>')) AS links, nullif(regexp_extract(html, '<a [^>]*href="([^"]*)"', 1), '') AS first_href FROM pages""")
def f49(spark, d):
    href = F.regexp_extract("html", r'<a [^>]*href="([^"]*)"', 1)
    return read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<img[^>]*>"), 0)).cast("long").alias("images"), F.size(F.regexp_extract_all("html", F.lit("<a [^>]*>"), 0)).cast("long").alias("links"), F.when(href != "", href).alias("first_href"))


@query("f47_ratios", "SELECT p_partkey, greatest(0.5, least(2.0, round(p_retailprice / (p_size * 100.0), 6))) AS ratio, try_cast(p_name AS INT) AS parsed FROM part")
def f47(spark, d):
    return read(spark, d, "part").select("p_partkey", F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.round(F.col("p_retailprice") / (F.col("p_size") * 100.0), 6))).alias("ratio"), F.expr("try_cast(p_name as int)").alias("parsed"))


@query("f50_profile_key", """SELECT user_id, '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS key FROM (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def f50(spark, d):
    n = read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).count()
    entries = F.array_sort(F.collect_list(F.struct("kind", "count")))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(entries)).alias("key"))


@query("f52_lean_words", with_tables("sources") + """SELECT source_id, CASE lean WHEN 'left' THEN 'leans left' WHEN 'right' THEN 'leans right' WHEN 'center' THEN 'center' ELSE 'lean unknown' END || ', ' || country AS mark FROM sources""")
def f52(spark, d):
    from quillmesh.sources.fixtures import sources

    return sources(spark, d).select("source_id", F.concat(F.when(F.col("lean") == "left", "leans left").when(F.col("lean") == "right", "leans right").when(F.col("lean") == "center", "center").otherwise("lean unknown"), F.lit(", "), "country").alias("mark"))


@query("f48_small_parses", """SELECT page_id, url AS plain, CASE WHEN page_id % 4 >= 2 THEN CAST(page_id AS INT) END AS width FROM pages WHERE page_id > 0""")
def f48(spark, d):
    """an attribute's &amp; as the character, and a positive whole number or nothing."""
    p, i = read(spark, d, "pages").filter("page_id > 0"), F.col("page_id")
    width = F.when(i % 4 == 0, F.concat(F.lit("-"), i.cast("string"))).when(i % 4 == 1, F.concat(i.cast("string"), F.lit("px"))).otherwise(i.cast("string"))
    return p.select("page_id", T.unescape_amp(F.replace("url", F.lit("&"), F.lit("&amp;"))).alias("plain"), N.positive_int(width).alias("width"))


@query("f37_document_quotes", "SELECT doc_id, sha256(translate(coalesce(text, ''), '‘’“”–—', chr(39) || chr(39) || '\"\"--')) AS folded FROM documents")
def f37_documents(spark, d):
    """F37 over whole documents, by digest."""
    return read(spark, d, "documents").select("doc_id", F.sha2(T.quote_fold(F.coalesce("text", F.lit(""))), 256).alias("folded"))
