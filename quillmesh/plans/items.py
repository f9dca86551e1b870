"""P, S, U and the ledger part of A: items on their way into a pool."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.items import cap_pass, first_by, ledger, skip_fill, streaks, validate
from quillmesh.sources.fixtures import BASE_S, HARD_NEWS, NOW_S, TOPICS, articles, history, members, read, runs, sources, with_tables

from quillmesh.operators.order import placed

from .base import query

#: Items with faults at fixed ids: every rule drops some.
RAW = f"""raw AS (SELECT id, source_id, CASE WHEN id % 17 = 3 THEN '' ELSE title END AS title,
  CASE WHEN id % 19 = 4 THEN 'ftp://x' WHEN id % 23 = 5 THEN 'https://same.example/1' ELSE url END AS url,
  CASE WHEN id % 29 = 6 THEN NULL WHEN id % 31 = 7 THEN published_s - 4000000 ELSE published_s END AS published_s FROM articles)"""
REASON = f"""CASE WHEN trim(title) = '' THEN 'no_title' WHEN contains(title, 'The ') AND source_id = 'src1' THEN 'title_rule' WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_url'
  WHEN id <> min(id) OVER (PARTITION BY url) THEN 'duplicate_url' WHEN published_s IS NULL THEN 'no_date'
  WHEN published_s < {NOW_S} - 2592000 OR published_s > {NOW_S} + 86400 THEN 'absurd_date' END"""


def raw(spark, d):
    i = F.col("id")
    return articles(spark, d).select(
        "id",
        "source_id",
        F.when(i % 17 == 3, "").otherwise(F.col("title")).alias("title"),
        F.when(i % 19 == 4, "ftp://x").when(i % 23 == 5, "https://same.example/1").otherwise(F.col("url")).alias("url"),
        F.when(i % 29 == 6, None).when(i % 31 == 7, F.col("published_s") - 4_000_000).otherwise(F.col("published_s")).alias("published_s"),
    )


def checked(spark, d):
    return validate(raw(spark, d), NOW_S, F.col("title").contains("The ") & (F.col("source_id") == "src1"), absurd=True)


@query("p01_item_validation", with_tables("articles", also=RAW) + f"SELECT id, {REASON} AS drop_reason FROM raw")
def p01(spark, d):
    return checked(spark, d).select("id", "drop_reason")


@query("p02_absurd_date", with_tables("articles", also=RAW) + f"SELECT id, published_s < {NOW_S} - 2592000 OR published_s > {NOW_S} + 86400 AS absurd FROM raw")
def p02(spark, d):
    return raw(spark, d).select("id", ((F.col("published_s") < NOW_S - 2_592_000) | (F.col("published_s") > NOW_S + 86_400)).alias("absurd"))


@query("p03_drop_titles", with_tables("articles", also="rules AS (SELECT 'src1' AS source_id, ['^The', 'of'] AS patterns UNION ALL SELECT 'src2', ['ing'])") + "SELECT id, coalesce(len(list_filter(patterns, lambda p: regexp_matches(title, p))) > 0, false) AS dropped FROM articles LEFT JOIN rules USING (source_id)")
def p03(spark, d):
    rules = spark.createDataFrame([("src1", ["^The", "of"]), ("src2", ["ing"])], "source_id string, patterns array<string>")
    hit = F.exists("patterns", lambda p: F.regexp(F.col("title"), p))
    return articles(spark, d).join(F.broadcast(rules), "source_id", "left").select("id", F.coalesce(hit, F.lit(False)).alias("dropped"))


@query("p04_link_from_guid", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url END AS link FROM pages")
def p04(spark, d):
    m = F.col("page_id") % 3
    link = F.when(m == 0, F.col("url")).when(m == 1, "tag:none").otherwise(None)
    guid = F.when(m == 1, F.col("url")).otherwise("id-7")
    ok = "^https?://"
    return read(spark, d, "pages").select("page_id", F.coalesce(F.when(link.rlike(ok), link), F.when(guid.rlike(ok), guid)).alias("link"))


@query("p05_outlet_href", r"""SELECT page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: NOT regexp_matches(h, 'the'))[1] AS href FROM pages""")
def p05(spark, d):
    h = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"')), lambda x: ~x.rlike("the"))
    return read(spark, d, "pages").select("page_id", F.try_element_at(h, F.lit(1)).alias("href"))


@query("p06_pool_source", with_tables("sources") + "SELECT source_id, CASE WHEN regexp_matches(upper(substr(country, 1, 2)), '^[A-Z]{2}$') THEN upper(substr(country, 1, 2)) END AS country, paywall FROM sources")
def p06(spark, d):
    c = F.upper(F.substring("country", 1, 2))
    return sources(spark, d).select("source_id", F.when(c.rlike("^[A-Z]{2}$"), c).alias("country"), "paywall")


@query("p07_closed_schema", with_tables("articles") + "SELECT id, list_filter([CASE WHEN length(title) > 60 THEN 'title too long' END, CASE WHEN dek = '' THEN 'dek empty' END, CASE WHEN NOT regexp_matches(url, '^https://') THEN 'url not https' END], lambda x: x IS NOT NULL) AS errors FROM articles")
def p07(spark, d):
    rules = [F.when(F.length("title") > 60, "title too long"), F.when(F.col("dek") == "", "dek empty"), F.when(~F.col("url").rlike("^https://"), "url not https")]
    return articles(spark, d).select("id", F.array_compact(F.array(*rules)).alias("errors"))


@query("p08_published_dek", r"""SELECT doc_id AS id, CASE WHEN length(t) <= 600 THEN t WHEN regexp_extract(substr(t, 1, 601), '^(.*) ', 1) = '' THEN substr(t, 1, 600) ELSE regexp_extract(substr(t, 1, 601), '^(.*) ', 1) END AS dek FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM documents)""")
def p08(spark, d):
    """Whole texts as deks, cut at 600 characters."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.cut_at_word(T.collapse(F.col("text")), 600).alias("dek"))


@query("p09_rank_input", with_tables("articles") + "SELECT id, source_id, title, substr(dek, 1, 200) AS dek, topics, published_s FROM articles")
def p09(spark, d):
    return articles(spark, d).select("id", "source_id", "title", F.substring("dek", 1, 200).alias("dek"), "topics", "published_s")


STORY = """facts AS (SELECT cluster_id, list_sort(list_distinct(flatten(list(topics)))) AS topics, count(DISTINCT syndication_group) AS independent, list_sort(list(DISTINCT lean) FILTER (WHERE lean IS NOT NULL)) AS leans,
  list_sort(list(DISTINCT source_id)) AS source_ids, max(published_s) AS latest_s, count(*) AS n FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) GROUP BY cluster_id)"""


def facts(spark, d):
    """Stories with topics, independent outlets, leans, sources, the newest time and size."""
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id")
    return m.groupBy("cluster_id").agg(
        F.array_sort(F.array_compact(F.array(*[F.when(F.bool_or(F.array_contains("topics", t)), t) for t in TOPICS]))).alias("topics"),
        F.countDistinct("syndication_group").alias("independent"),
        F.array_sort(F.collect_set("lean")).alias("leans"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        F.max("published_s").alias("latest_s"),
        F.count(F.lit(1)).alias("n"),
    )


@query("p10_must_know", with_tables("articles", "sources", "members", also=STORY) + f"SELECT cluster_id, list_has_any(topics, {HARD_NEWS}) AND independent >= 2 AND len(coalesce(leans, [])) >= 2 AS must_know FROM facts")
def p10(spark, d):
    hard = F.arrays_overlap("topics", F.array(*map(F.lit, HARD_NEWS)))
    return facts(spark, d).select("cluster_id", (hard & (F.col("independent") >= 2) & (F.size("leans") >= 2)).alias("must_know"))


@query("p11_sections", with_tables("articles", "sources") + "SELECT id, list_has_any(topics, ['economy', 'science']) OR bucket = 'ASIA' AS in_section FROM articles JOIN sources USING (source_id)")
def p11(spark, d):
    return articles(spark, d).join(F.broadcast(sources(spark, d)), "source_id").select("id", (F.arrays_overlap("topics", F.array(F.lit("economy"), F.lit("science"))) | (F.col("bucket") == "ASIA")).alias("in_section"))


@query("p12_standing_gate", with_tables("articles") + "SELECT id FROM articles WHERE regexp_matches(lower(title), 'tion') AND list_has_any(topics, ['politics', 'conflict'])")
def p12(spark, d):
    return articles(spark, d).filter(F.lower("title").rlike("tion") & F.arrays_overlap("topics", F.array(F.lit("politics"), F.lit("conflict")))).select("id")


@query("p13_syndicated_copy", with_tables("articles", "sources") + "SELECT id, syndication_group <> source_id OR regexp_matches(dek, '(?i)apache license') AS copy FROM articles JOIN sources USING (source_id)")
def p13(spark, d):
    return articles(spark, d).join(F.broadcast(sources(spark, d)), "source_id").select("id", ((F.col("syndication_group") != F.col("source_id")) | F.col("dek").rlike("(?i)apache license")).alias("copy"))


@query("p14_opinion_url", "SELECT page_id, regexp_matches(url, '(?i)/(opinion|opinions|commentary|op-ed|oped|columns?|columnists?|views|editorials?|voices)/') AS opinion FROM pages")
def p14(spark, d):
    return read(spark, d, "pages").select("page_id", F.col("url").rlike("(?i)/(opinion|opinions|commentary|op-ed|oped|columns?|columnists?|views|editorials?|voices)/").alias("opinion"))


@query("p15_image_checks", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'data_uri' WHEN NOT regexp_matches(url, '^https://') THEN 'not_https' WHEN page_id % 5 = 0 THEN 'tiny_pixel' END AS reject, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 100 + page_id % 400 END AS width FROM pages")
def p15(spark, d):
    i = F.col("page_id")
    p = read(spark, d, "pages").select("page_id", F.when(i % 7 == 0, "data:image/png;base64,x").otherwise(F.col("url")).alias("src"), F.when(i % 5 == 0, F.lit(1).cast("long")).otherwise(100 + i % 400).alias("width"))
    return p.select("page_id", F.when(F.col("src").startswith("data:"), "data_uri").when(~F.col("src").rlike("^https://"), "not_https").when(F.col("width") <= 2, "tiny_pixel").alias("reject"), "width")


@query("p16_image_shape", "SELECT p_partkey, p_size >= 20 AND p_retailprice >= 1000 AS hero_worthy, p_size >= 5 AS thumb_ok, p_retailprice / p_size BETWEEN 30 AND 120 AS well_shaped FROM part")
def p16(spark, d):
    ratio = F.col("p_retailprice") / F.col("p_size")
    return read(spark, d, "part").select("p_partkey", ((F.col("p_size") >= 20) & (F.col("p_retailprice") >= 1000)).alias("hero_worthy"), (F.col("p_size") >= 5).alias("thumb_ok"), ratio.between(30, 120).alias("well_shaped"))


@query("p17_mute", with_tables("articles") + "SELECT id FROM articles WHERE source_id NOT IN ('src3', 'src4') AND NOT list_has_any(topics, ['culture'])")
def p17(spark, d):
    muted = spark.createDataFrame([("src3",), ("src4",)], "source_id string")
    return articles(spark, d).join(F.broadcast(muted), "source_id", "left_anti").filter(~F.array_contains("topics", "culture")).select("id")


@query("p18_live_overrides", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, CAST(row_number() OVER (ORDER BY cluster_id <> 7, independent DESC, cluster_id) AS INT) AS place FROM facts WHERE cluster_id NOT IN (3, 5)")
def p18(spark, d):
    f = facts(spark, d).filter(~F.col("cluster_id").isin(3, 5))
    return placed(f.withColumn("unpinned", F.col("cluster_id") != 7), "unpinned", F.desc("independent"), "cluster_id").select("cluster_id", "place")


@query("p19_search_history", with_tables("articles") + "SELECT id FROM articles WHERE contains(lower(title), 'tion') OR contains(lower(source_id), 'src1')")
def p19(spark, d):
    return articles(spark, d).filter(F.lower("title").contains("tion") | F.lower("source_id").contains("src1")).select("id")


@query("p20_search_sources", with_tables("sources") + "SELECT source_id FROM sources WHERE contains(lower(country), 'an') OR contains(lower(bucket), 'asia')")
def p20(spark, d):
    return sources(spark, d).filter(F.lower("country").contains("an") | F.lower("bucket").contains("asia")).select("source_id")


@query("p21_window", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts < (SELECT min(ts) FROM events) + INTERVAL 7 DAY")
def p21(spark, d):
    e = read(spark, d, "events")
    start = F.broadcast(e.agg(F.min("ts").alias("start")))
    return e.join(start, (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + F.expr("INTERVAL 7 DAYS"))).select("event_id")


@query("p22_stale", with_tables("articles") + f"SELECT id, published_s < {NOW_S} - 10800 AS stale FROM articles")
def p22(spark, d):
    return articles(spark, d).select("id", (F.col("published_s") < NOW_S - 3 * 3600).alias("stale"))


@query("p23_health_word", with_tables("runs") + "SELECT source_id, run, CASE state WHEN 'error' THEN 'failing' WHEN 'empty' THEN 'quiet' ELSE 'ok' END AS word FROM runs")
def p23(spark, d):
    return runs(spark, d).select("source_id", "run", F.when(F.col("state") == "error", "failing").when(F.col("state") == "empty", "quiet").otherwise("ok").alias("word"))


@query("p24_leads_because", with_tables("articles") + f"""SELECT id, list_transform(list_sort(list_filter([{{'neg': -len(topics), 'term': 'topics'}}, {{'neg': -(id % 5), 'term': 'trust'}}, {{'neg': 0, 'term': 'zero'}}, {{'neg': -1, 'term': 'age'}}], lambda t: t.neg < 0))[1:3], lambda t: t.term) AS reasons FROM articles""")
def p24(spark, d):
    t = lambda name, v: F.struct((-v).cast("long").alias("neg"), F.lit(name).alias("term"))
    terms = F.array(t("topics", F.size("topics")), t("trust", F.col("id") % 5), t("zero", F.lit(0)), t("age", F.lit(1)))
    return articles(spark, d).select("id", F.transform(F.slice(F.array_sort(F.filter(terms, lambda x: x.neg < 0)), 1, 3), lambda x: x.term).alias("reasons"))


@query("a01_ledger", with_tables("articles", also=RAW + f", c AS (SELECT coalesce({REASON}, 'published') AS metric FROM raw)") + "SELECT metric, count(*) AS n FROM c GROUP BY metric HAVING true UNION ALL SELECT 'fetched', count(*) FROM raw")
def a01(spark, d):
    return ledger(checked(spark, d))


@query("a02_feed_states", with_tables("runs") + "SELECT state, count(run) AS n FROM (VALUES ('ok'), ('empty'), ('error'), ('timeout')) s(state) LEFT JOIN runs USING (state) GROUP BY state")
def a02(spark, d):
    domain = spark.createDataFrame([("ok",), ("empty",), ("error",), ("timeout",)], "state string")
    n = runs(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query("u01_union_feeds", with_tables("articles") + "SELECT id, min(source_order) AS source_order FROM (SELECT id, 1 AS source_order FROM articles WHERE id % 2 = 0 UNION ALL SELECT id, 2 FROM articles WHERE id % 3 = 0) GROUP BY id")
def u01(spark, d):
    a = articles(spark, d).select("id")
    both = a.filter("id % 2 = 0").withColumn("source_order", F.lit(1)).unionByName(a.filter("id % 3 = 0").withColumn("source_order", F.lit(2)))
    return first_by(both, ["id"], F.col("source_order"))


@query("u02_url_dedup", with_tables("articles", also=RAW) + "SELECT url, min(id) AS id FROM raw GROUP BY url")
def u02(spark, d):
    return first_by(raw(spark, d), ["url"], F.col("id")).select("url", "id")


@query("u03_title_dedup", with_tables("articles", "sources", "members", also=STORY) + """SELECT title, cluster_id FROM (SELECT title, cluster_id, row_number() OVER (PARTITION BY title ORDER BY independent DESC, n DESC, latest_s DESC, cluster_id) AS r FROM (SELECT DISTINCT lower(title) AS title, cluster_id FROM members JOIN articles ON article_id = id WHERE length(title) >= 20) JOIN facts USING (cluster_id)) WHERE r = 1""")
def u03(spark, d):
    titles = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).filter(F.length("title") >= 20).select(F.lower("title").alias("title"), "cluster_id").distinct()
    return first_by(titles.join(facts(spark, d), "cluster_id"), ["title"], F.desc("independent"), F.desc("n"), F.desc("latest_s"), F.col("cluster_id")).select("title", "cluster_id")


@query("u04_rule_difference", with_tables("articles") + "SELECT id, CASE WHEN n_chars > 2000 THEN 'only_new' ELSE 'only_old' END AS side FROM articles WHERE (n_chars > 2000) <> (len(topics) >= 2)")
def u04(spark, d):
    a = articles(spark, d)
    new, old = a.filter("n_chars > 2000").select("id"), a.filter(F.size("topics") >= 2).select("id")
    return new.exceptAll(old).withColumn("side", F.lit("only_new")).union(old.exceptAll(new).withColumn("side", F.lit("only_old")))


@query("u05_latest_wins", with_tables("history") + "SELECT user_id, article_id, arg_max(kind, event_id) AS kind FROM history GROUP BY ALL")
def u05(spark, d):
    return history(spark, d).groupBy("user_id", "article_id").agg(F.max_by("kind", "event_id").alias("kind"))


@query("u06_archive", with_tables("history") + "SELECT user_id, article_id FROM (SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, article_id) AS r FROM (SELECT user_id, article_id, max(ts) AS seen FROM history GROUP BY ALL) WHERE seen >= (SELECT max(ts) FROM history) - INTERVAL 30 DAY) WHERE r <= 200")
def u06(spark, d):
    """Each reader's items of 30 days, the newest 200."""
    latest = history(spark, d).groupBy("user_id", "article_id").agg(F.max("ts").alias("at"))
    now = F.broadcast(latest.agg(F.max("at").alias("now")))  # one row
    recent = latest.crossJoin(now).filter(F.col("at") >= F.col("now") - F.expr("INTERVAL 30 DAY"))
    return recent.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "article_id"))).filter("r <= 200").select("user_id", "article_id")


@query("u07_shown_not_opened", with_tables("history") + "SELECT DISTINCT user_id, article_id FROM history h WHERE kind = 'shown' AND NOT EXISTS (SELECT 1 FROM history o WHERE o.kind = 'opened' AND o.user_id = h.user_id AND o.article_id = h.article_id)")
def u07(spark, d):
    h = history(spark, d)
    pick = lambda k: h.filter(F.col("kind") == k).select("user_id", "article_id").distinct()
    return pick("shown").join(pick("opened"), ["user_id", "article_id"], "left_anti")


@query("u08_profile_diff", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change FROM (SELECT 'user/' || user_id AS k, count(*) AS v FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY ALL) a FULL JOIN (SELECT 'user/' || user_id AS k, count(*) AS v FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 1 GROUP BY ALL) b ON a.k = b.k")
def u08(spark, d):
    e = read(spark, d, "events").withColumn("path", F.concat(F.lit("user/"), F.col("user_id").cast("string")))
    a = e.filter("event_id % 2 = 0 and user_id % 3 <> 0").groupBy("path").agg(F.count(F.lit(1)).alias("v"))
    b = e.filter("event_id % 2 = 1 and user_id % 3 <> 1").groupBy("path").agg(F.count(F.lit(1)).alias("w"))
    return a.join(b, "path", "full").select("path", F.when(F.col("v").isNull(), "added").when(F.col("w").isNull(), "removed").when(F.col("v") != F.col("w"), "changed").otherwise("same").alias("change"))


@query("u09_raised_topics", with_tables("history", "articles") + "SELECT topic FROM (SELECT topic, count(*) FILTER (WHERE event_id % 2 = 0) AS b, count(*) FILTER (WHERE event_id % 2 = 1) AS a FROM (SELECT event_id, unnest(topics) AS topic FROM history JOIN articles ON article_id = id) GROUP BY topic) WHERE a > b")
def u09(spark, d):
    t = history(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).select("event_id", F.explode("topics").alias("topic"))
    return t.groupBy("topic").agg(F.count_if(F.col("event_id") % 2 == 0).alias("b"), F.count_if(F.col("event_id") % 2 == 1).alias("a")).filter("a > b").select("topic")


@query("u10_tag_closure", with_tables("articles") + "SELECT id, list_sort(list_distinct(list_concat(topics, CASE WHEN list_contains(topics, 'conflict') THEN ['world', 'news'] ELSE [] END, CASE WHEN list_contains(topics, 'economy') THEN ['news'] ELSE [] END))) AS tags FROM articles")
def u10(spark, d):
    implies = spark.createDataFrame([("conflict", "world"), ("world", "news"), ("economy", "news")], "tag string, implied string")
    closure = implies
    for _ in range(2):  # the depth of the rule table
        closure = closure.union(closure.select("tag", F.col("implied").alias("m")).join(implies.withColumnRenamed("tag", "m"), "m").select("tag", "implied")).distinct()
    table = closure.groupBy("tag").agg(F.collect_set("implied").alias("implied"))
    a = articles(spark, d).select("id", "topics", F.explode_outer("topics").alias("tag")).join(F.broadcast(table), "tag", "left")
    return a.groupBy("id").agg(F.array_sort(F.array_distinct(F.concat(F.first("topics"), F.flatten(F.collect_list(F.coalesce("implied", F.array().cast("array<string>"))))))).alias("tags"))


@query("s02_fetch_states", with_tables("runs") + "SELECT source_id, arg_max(state, run) AS last_state, sum(items) AS items FROM runs GROUP BY source_id")
def s02(spark, d):
    return runs(spark, d).groupBy("source_id").agg(F.max_by("state", "run").alias("last_state"), F.sum("items").alias("items"))


@query("s04_routes", with_tables("sources") + "SELECT source_id, CASE WHEN k % 6 = 0 THEN 'relay' WHEN k % 6 = 1 THEN 'search' ELSE 'direct' END AS route FROM sources")
def s04(spark, d):
    return sources(spark, d).select("source_id", F.when(F.col("k") % 6 == 0, "relay").when(F.col("k") % 6 == 1, "search").otherwise("direct").alias("route"))


@query("s14_pool_json", with_tables("articles") + """SELECT id, '{"id":' || id || ',"source_id":"' || source_id || '","published_s":' || published_s || '}' AS record FROM articles""")
def s14(spark, d):
    return articles(spark, d).select("id", F.to_json(F.struct("id", "source_id", "published_s")).alias("record"))


@query("s16_reserve_shards", with_tables("articles") + "SELECT tag, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT unnest(topics) AS tag, n_chars FROM articles) GROUP BY tag")
def s16(spark, d):
    return articles(spark, d).select(F.explode("topics").alias("tag"), "n_chars").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s17_candidate_dump", with_tables("articles") + "SELECT id, source_id, url, substr(dek, 1, 600) AS dek FROM articles WHERE id % 11 <> 2")
def s17(spark, d):
    hidden = articles(spark, d).filter("id % 11 = 2").select("id")
    return articles(spark, d).join(hidden, "id", "left_anti").select("id", "source_id", "url", F.substring("dek", 1, 600).alias("dek"))


@query("s20_phrase_search", with_tables("articles") + "SELECT q, id FROM (VALUES ('the thation'), ('of the'), ('de la')) t(q) JOIN articles ON contains(' ' || lower(title || ' ' || dek) || ' ', ' ' || q || ' ')")
def s20(spark, d):
    q = spark.createDataFrame([("the thation",), ("of the",), ("de la",)], "q string")
    hay = F.concat(F.lit(" "), F.lower(F.concat("title", F.lit(" "), "dek")), F.lit(" "))
    return articles(spark, d).withColumn("hay", hay).join(F.broadcast(q), F.col("hay").contains(F.concat(F.lit(" "), "q", F.lit(" ")))).select("q", "id")


@query("s22_cache_ttl", f"SELECT vec_id, {BASE_S} + vec_id * 400 AS made_s FROM embeddings WHERE {BASE_S} + vec_id * 400 >= {NOW_S} - 172800")
def s22(spark, d):
    made = F.lit(BASE_S) + F.col("vec_id") * 400
    return read(spark, d, "embeddings").select("vec_id", made.alias("made_s")).filter(F.col("made_s") >= NOW_S - 48 * 3600)


@query("s26_reserve_merge", with_tables("articles") + "SELECT id FROM articles WHERE id % 2 = 0 OR id % 3 = 0")
def s26(spark, d):
    a = articles(spark, d).select("id", "url")
    main, reserve = a.filter("id % 2 = 0"), a.filter("id % 3 = 0")
    return main.union(reserve.join(main.select("id"), "id", "left_anti").join(main.select("url"), "url", "left_anti").select("id", "url")).select("id")


@query("w01_cap_pass", with_tables("articles", also="""r AS (SELECT id, source_id, id % 3 = 0 AS multi, row_number() OVER (PARTITION BY source_id ORDER BY published_s, id) AS rn FROM articles),
  s AS (SELECT *, row_number() OVER (PARTITION BY source_id, rn > 5, multi ORDER BY rn) AS rest FROM r)""") + "SELECT id, source_id FROM s WHERE rn <= 5 OR (multi AND rest <= 3)")
def w01(spark, d):
    a = articles(spark, d).select("id", "source_id", F.col("published_s").alias("position"))
    return cap_pass(a, a.filter("id % 3 = 0"), 5, 3).select("id", "source_id")


@query("w12_health_streaks", with_tables("runs", also="""i AS (SELECT *, sum(CASE WHEN state <> 'error' THEN 1 ELSE 0 END) OVER w AS ie, sum(CASE WHEN state <> 'empty' THEN 1 ELSE 0 END) OVER w AS im FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY run)),
  c AS (SELECT *, CAST(sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, ie ORDER BY run) AS BIGINT) AS consecutive_error, CAST(sum(CASE WHEN state = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, im ORDER BY run) AS BIGINT) AS consecutive_empty FROM i)""") + "SELECT source_id, run, consecutive_error, consecutive_empty, consecutive_error >= 3 OR consecutive_empty >= 5 AS unhealthy FROM c")
def w12(spark, d):
    return streaks(runs(spark, d)).select("source_id", "run", "consecutive_error", "consecutive_empty", "unhealthy")


@query("o06_skip_fill", with_tables("articles", also="""o AS (SELECT id, source_id, n_chars, row_number() OVER (PARTITION BY source_id ORDER BY id) AS r FROM articles),
  f AS (SELECT id, source_id, r, n_chars <= 20000 AS kept, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM o WHERE r = 1
  UNION ALL SELECT o.id, o.source_id, o.r, f.used + o.n_chars <= 20000, CASE WHEN f.used + o.n_chars <= 20000 THEN f.used + o.n_chars ELSE f.used END FROM f JOIN o ON o.source_id = f.source_id AND o.r = f.r + 1)""") + "SELECT id, kept FROM f")
def o06(spark, d):
    return skip_fill(articles(spark, d).select("id", "source_id", "n_chars"), "source_id", ["id"], "n_chars", 20_000).select("id", "kept")
