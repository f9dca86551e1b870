"""Further rows of the inventory: feeds, rules, packing, ordered picks, reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import numeric as N
from quillmesh.functions import text as T
from quillmesh.operators.items import first_by
from quillmesh.operators.order import placed
from quillmesh.sources import feeds
from quillmesh.sources.fixtures import BASE_S, HARD_NEWS, NOW_S, articles, history, members, read, runs, sources, with_tables

from .base import query
from .items import STORY, facts


def joined(spark, d):
    return members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))


def parsed_back(a, *feed):
    """Feeds of articles, one for each value of `feed`, written out and parsed back."""
    a = a.withColumn("t", F.replace("title", F.lit("&"), F.lit("+")))
    rss = F.concat(F.lit("<item><title><![CDATA["), "t", F.lit("]]></title><link>"), "url", F.lit("</link></item>"))
    atom = F.concat(F.lit("<entry><title><![CDATA["), "t", F.lit(']]></title><link rel="self" href="x"/><link rel="alternate" href="'), "url", F.lit('"/></entry>'))
    is_atom = F.col("source_id").isin("src1", "src3")
    packed = a.groupBy(*feed).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.when(is_atom, atom).otherwise(rss).alias("x")))), lambda s: s.x), "").alias("x"))
    body = F.when(is_atom, F.concat(F.lit("junk<feed>"), "x", F.lit("</feed>"))).otherwise(F.concat(F.lit("<?xml version='1.0'?><rss>"), "x", F.lit("</rss>")))
    return feeds.items(feeds.repaired(packed.select(*feed, body.alias("body")))).select(*feed, "kind", "position", "title", "link")


@query("s09_feed_items", with_tables("articles") + "SELECT source_id, kind, CAST(row_number() OVER (PARTITION BY source_id ORDER BY id) - 1 AS INT) AS position, replace(title, '&', '+') AS title, url AS link FROM (SELECT *, CASE WHEN source_id IN ('src1', 'src3') THEN 'atom' ELSE 'rss' END AS kind FROM articles WHERE id < 200)")
def s09(spark, d):
    """A feed of each outlet, written out and parsed back."""
    return parsed_back(articles(spark, d).filter("id < 200"), "source_id")


@query("s09_all_feed_items", with_tables("articles") + r"SELECT source_id, feed, kind, CAST(row_number() OVER (PARTITION BY source_id, feed ORDER BY id) - 1 AS INT) AS position, nullif(regexp_replace(replace(title, '&', '+'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '') AS title, url AS link FROM (SELECT *, id // 1000 AS feed, CASE WHEN source_id IN ('src1', 'src3') THEN 'atom' ELSE 'rss' END AS kind FROM articles)")
def s09_all(spark, d):
    """All items: several feeds of each outlet, so that none outgrows a thousand ids."""
    return parsed_back(articles(spark, d).withColumn("feed", F.floor(F.col("id") / 1000)), "source_id", "feed")


@query("s07_repairs", "SELECT * FROM (VALUES ('junk<rss>a & b</rss>', '<rss>a &amp; b</rss>', 1, 0, 0, 1), ('<rss>a&nbsp;b &amp; c&rsquo;s</rss>', '<rss>a' || chr(160) || 'b &amp; c’s</rss>', 0, 0, 2, 0), ('<rss/>', '<rss/>', 0, 0, 0, 0), ('<rss><![CDATA[R&D &nbsp;]]></rss>', '<rss><![CDATA[R&D &nbsp;]]></rss>', 0, 0, 0, 0), ('<rss>&unknown; &#8217; x' || chr(1) || '</rss>', '<rss>&unknown; &#8217; x</rss>', 0, 1, 0, 0)) t(item, body, leading_junk, control_chars, html_entity, bare_ampersand)")
def s07(spark, d):
    rows = spark.createDataFrame([("junk<rss>a & b</rss>",), ("<rss>a&nbsp;b &amp; c&rsquo;s</rss>",), ("<rss/>",), ("<rss><![CDATA[R&D &nbsp;]]></rss>",), ("<rss>&unknown; &#8217; x\x01</rss>",)], "item string").withColumn("body", F.col("item"))
    return feeds.repaired(rows).select("item", "body", *[F.col(c).cast("int").alias(c) for c in feeds.REPAIRS])


@query("s18_archive", "SELECT item_id, length(text) AS n FROM benchmark WHERE length(text) >= 100")
def s18(spark, d):
    return read(spark, d, "benchmark").filter(F.length("text") >= 100).select("item_id", F.length("text").cast("long").alias("n"))


@query("w06_hero_photo", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size < 20, abs(p_retailprice - 1000), p_size DESC, p_partkey) = 1")
def w06(spark, d):
    return first_by(read(spark, d, "part"), ["p_brand"], F.col("p_size") < 20, F.abs(F.col("p_retailprice") - 1000), F.desc("p_size"), F.col("p_partkey")).select("p_brand", "p_partkey")


@query("t04_near_miss_top", with_tables("articles") + "SELECT a.id AS a, b.id AS b FROM articles a JOIN articles b ON a.title = b.title AND a.id < b.id ORDER BY a.id, b.id LIMIT 40")
def t04(spark, d):
    """Of one title only its 41 least ids can be in the first 40 pairs."""
    r = F.row_number().over(Window.partitionBy("title").orderBy("id"))
    a = articles(spark, d).select(F.col("id").alias("a"), "title", r.alias("r")).filter("r <= 41").drop("r")
    return a.join(a.select(F.col("a").alias("b"), "title"), "title").filter("a < b").orderBy("a", "b").limit(40).select("a", "b")


@query("t09_saved_newest", with_tables("history") + "SELECT user_id, article_id, max(ts) AS ts FROM history WHERE kind = 'save' GROUP BY ALL ORDER BY ts DESC, user_id, article_id LIMIT 50")
def t09(spark, d):
    s = history(spark, d).filter("kind = 'save'").groupBy("user_id", "article_id").agg(F.max("ts").alias("ts"))
    return s.orderBy(F.desc("ts"), "user_id", "article_id").limit(50)


@query("t12_follow_matches", with_tables("articles") + "SELECT t AS phrase, id FROM (VALUES ('tion'), ('eur'), ('ung')) f(t) JOIN articles ON contains(lower(title), t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY published_s DESC, id) <= 15")
def t12(spark, d):
    f = spark.createDataFrame([("tion",), ("eur",), ("ung",)], "phrase string")
    m = articles(spark, d).join(F.broadcast(f), F.lower("title").contains(F.col("phrase")))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("published_s"), "id"))).filter("r <= 15").select("phrase", "id")


@query("f25_record_bytes", with_tables("articles") + """SELECT id, CAST(strlen('{"id":' || id || ',"source_id":"' || source_id || '","published_s":' || published_s || '}') + 60 AS BIGINT) AS bytes FROM articles""")
def f25(spark, d):
    return articles(spark, d).select("id", (F.octet_length(F.to_json(F.struct("id", "source_id", "published_s"))) + 60).cast("long").alias("bytes"))


@query("f33_geo_text", with_tables("articles") + "SELECT id, replace(replace(replace(lower(title), '’', ''''), '–', '-'), '—', '-') AS folded FROM articles")
def f33(spark, d):
    return articles(spark, d).select("id", F.translate(F.lower("title"), "’–—", "'--").alias("folded"))


@query("f38_headline_score", with_tables("articles") + r"SELECT id, greatest(-5, least(6, 2 * len(list_filter(string_split(title, ' '), lambda w: regexp_matches(w, '^\P{L}*\p{Lu}')))) + least(2, len(regexp_extract_all(title, '[0-9]+'))) - 3 * (CASE WHEN contains(title, '?') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '\p{Lu}{5,}') THEN 1 ELSE 0 END))::INT AS points FROM articles")
def f38(spark, d):
    names = F.size(F.filter(F.split("title", " "), lambda w: w.rlike(r"^\P{L}*\p{Lu}")))
    numbers = F.size(F.regexp_extract_all("title", F.lit("([0-9]+)")))
    bad = F.col("title").contains("?").cast("int") + F.col("title").rlike(r"\p{Lu}{5,}").cast("int")
    return articles(spark, d).select("id", F.greatest(F.lit(-5), F.least(F.lit(6), 2 * names) + F.least(F.lit(2), numbers) - 3 * bad).cast("int").alias("points"))


@query("f40_word_marks", with_tables("articles") + "SELECT id, list_transform(string_split(title, ' '), lambda w: CASE WHEN length(w) > 8 THEN '*' || w ELSE w END) AS segments FROM articles")
def f40(spark, d):
    return articles(spark, d).select("id", F.transform(F.split("title", " "), lambda w: F.when(F.length(w) > 8, F.concat(F.lit("*"), w)).otherwise(w)).alias("segments"))


@query("r03_two_signals", with_tables("articles") + "SELECT id, (contains(dek, 'que') OR contains(dek, 'der')) AND (contains(dek, 'la') OR contains(dek, 'die')) AS signal FROM articles")
def r03(spark, d):
    has = lambda *ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.col("dek"), w))
    return articles(spark, d).select("id", (has("que", "der") & has("la", "die")).alias("signal"))


@query("r04_implications", with_tables("articles", "sources") + "SELECT id, CASE WHEN len(topics) = 0 AND bucket = 'ASIA' THEN ['world'] WHEN list_contains(topics, 'conflict') THEN list_concat(topics, ['world']) ELSE topics END AS tags FROM articles JOIN sources USING (source_id)")
def r04(spark, d):
    a = articles(spark, d).join(F.broadcast(sources(spark, d)), "source_id")
    return a.select("id", F.when((F.size("topics") == 0) & (F.col("bucket") == "ASIA"), F.array(F.lit("world"))).when(F.array_contains("topics", "conflict"), F.array_union("topics", F.array(F.lit("world")))).otherwise(F.col("topics")).alias("tags"))


@query("r05_geo_signals", with_tables("articles") + "SELECT id, CASE WHEN regexp_matches(dek, 'nicht') THEN NULL WHEN regexp_matches(dek, 'avec|dans') THEN 'strong' WHEN regexp_matches(dek, 'que') THEN 'weak' END AS signal FROM articles")
def r05(spark, d):
    x = F.col("dek")
    return articles(spark, d).select("id", F.when(x.rlike("nicht"), None).when(x.rlike("avec|dans"), "strong").when(x.rlike("que"), "weak").alias("signal"))


@query("r12_topic_match", with_tables("articles") + "SELECT id, topic FROM (SELECT id, unnest(topics) AS topic FROM articles) WHERE topic IN ('politics', 'science')")
def r12(spark, d):
    profile = spark.createDataFrame([("politics", True), ("science", True), ("culture", False)], "topic string, enabled boolean").filter("enabled")
    return articles(spark, d).select("id", F.explode("topics").alias("topic")).join(F.broadcast(profile), "topic").select("id", "topic")


@query("r17_version_slides", with_tables("articles", "members") + "SELECT unit_id, list_sort(list(id)) AS versions FROM members JOIN articles ON article_id = id GROUP BY unit_id HAVING count(*) > 1")
def r17(spark, d):
    return joined(spark, d).groupBy("unit_id").agg(F.array_sort(F.collect_list("id")).alias("versions")).filter(F.size("versions") > 1)


@query("r18_urgent", with_tables("articles", "sources", "members", also=STORY) + f"SELECT cluster_id, CASE WHEN list_has_any(topics, {HARD_NEWS}) AND independent >= 3 THEN 'hard news, several outlets' WHEN {NOW_S} - latest_s < 10800 THEN 'just in' END AS reason FROM facts")
def r18(spark, d):
    hard = F.arrays_overlap("topics", F.array(*map(F.lit, HARD_NEWS)))
    return facts(spark, d).select("cluster_id", F.when(hard & (F.col("independent") >= 3), "hard news, several outlets").when(F.lit(NOW_S) - F.col("latest_s") < 10_800, "just in").alias("reason"))


@query("r23_allowed_features", with_tables("runs") + "SELECT state AS feature, bool_and(items < 1000) AND count(*) >= 10 AS allowed FROM runs GROUP BY state")
def r23(spark, d):
    g = runs(spark, d).groupBy(F.col("state").alias("feature")).agg(F.bool_and(F.col("items") < 1000).alias("ok"), F.count(F.lit(1)).alias("n"))
    return g.select("feature", (F.col("ok") & (F.col("n") >= 10)).alias("allowed"))


@query("o13_other_side", with_tables("articles", "sources", "members", also="l AS (SELECT cluster_id, id, lean, count(*) OVER (PARTITION BY lean) AS c FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) WHERE lean IS NOT NULL)") + "SELECT cluster_id, id FROM l QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 3 AND row_number() OVER (PARTITION BY cluster_id ORDER BY c, id) = 1")
def o13(spark, d):
    v = joined(spark, d).join(F.broadcast(sources(spark, d)), "source_id").filter("lean is not null").select("cluster_id", "id", "lean")
    c = v.groupBy("lean").agg(F.count(F.lit(1)).alias("c"))
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy("c", "id"))
    return v.join(F.broadcast(c), "lean").select("cluster_id", "id", n.alias("n"), r.alias("r")).filter("n >= 3 and r = 1").select("cluster_id", "id")


@query("o17_version_swap", with_tables("articles", "sources", "members") + "SELECT cluster_id, id FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY paywall, n_chars DESC, id) = 1")
def o17(spark, d):
    v = joined(spark, d).join(F.broadcast(sources(spark, d)), "source_id")
    return first_by(v, ["cluster_id"], F.col("paywall"), F.desc("n_chars"), F.col("id")).select("cluster_id", "id")


@query("o18_query_packing", with_tables("sources", also="""o AS (SELECT bucket, source_id, row_number() OVER (PARTITION BY bucket ORDER BY source_id) AS r FROM sources),
  f AS (SELECT bucket, source_id, r, 0 AS pack, length(source_id) AS used FROM o WHERE r = 1
  UNION ALL SELECT o.bucket, o.source_id, o.r, CASE WHEN f.used + 4 + length(o.source_id) <= 14 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.used + 4 + length(o.source_id) <= 14 THEN f.used + 4 + length(o.source_id) ELSE length(o.source_id) END FROM f JOIN o ON o.bucket = f.bucket AND o.r = f.r + 1)""") + "SELECT bucket, pack, string_agg(source_id, ' OR ' ORDER BY source_id) AS q FROM f GROUP BY bucket, pack")
def o18(spark, d):
    """Terms in order into queries of a bounded length: a fold over each group's ordered terms."""
    g = sources(spark, d).groupBy("bucket").agg(F.array_sort(F.collect_list("source_id")).alias("ts"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("done"))
    step = lambda s, t: F.when(s.last == "", F.struct(t.alias("last"), s.done.alias("done"))).when(F.length(s.last) + 4 + F.length(t) <= 14, F.struct(F.concat(s.last, F.lit(" OR "), t).alias("last"), s.done.alias("done"))).otherwise(F.struct(t.alias("last"), F.concat(s.done, F.array(s.last)).alias("done")))
    x = F.aggregate("ts", start, step, lambda s: F.concat(s.done, F.array(s.last)))
    return g.select("bucket", F.posexplode(x).alias("pack", "q"))


@query("k05_vector_budget", f"SELECT vec_id FROM (SELECT vec_id, sum(100) OVER (PARTITION BY (({BASE_S} + vec_id * 400) // 86400) ORDER BY vec_id DESC) AS used FROM embeddings) WHERE used <= 5000")
def k05(spark, d):
    day = F.floor((F.lit(BASE_S) + F.col("vec_id") * 400) / 86_400)
    used = F.sum(F.lit(100)).over(Window.partitionBy(day).orderBy(F.desc("vec_id")).rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, d, "embeddings").select("vec_id", used.alias("used")).filter("used <= 5000").select("vec_id")


@query("k06_late_drops", with_tables("articles") + f"SELECT id FROM articles WHERE published_s >= {NOW_S} - 172800")
def k06(spark, d):
    return articles(spark, d).filter(F.col("published_s") >= NOW_S - 2 * 86_400).select("id")


@query("c01_schema_faults", with_tables("articles") + "SELECT fault, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(title) > 60 THEN 'title' END, CASE WHEN len(topics) = 0 THEN 'topics' END, CASE WHEN n_chars < 100 THEN 'n_chars' END], lambda x: x IS NOT NULL)) AS fault FROM articles) GROUP BY fault")
def c01(spark, d):
    faults = F.array_compact(F.array(F.when(F.length("title") > 60, "title"), F.when(F.size("topics") == 0, "topics"), F.when(F.col("n_chars") < 100, "n_chars")))
    return articles(spark, d).select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("c06_catalog_faults", with_tables("sources") + "SELECT source_id, lean IS NULL AS no_lean, NOT regexp_matches(country, '^[A-Z ]+$') AS bad_country FROM sources")
def c06(spark, d):
    return sources(spark, d).select("source_id", F.col("lean").isNull().alias("no_lean"), (~F.col("country").rlike("^[A-Z ]+$")).alias("bad_country"))


@query("x04_query_plan", with_tables("sources") + "SELECT source_id, CASE WHEN row_number() OVER (ORDER BY k % 4, k) <= 12 THEN 'run' ELSE 'over_cap' END AS plan FROM sources")
def x04(spark, d):
    rows = placed(sources(spark, d).withColumn("tier", F.col("k") % 4), "tier", "k")
    return rows.select("source_id", F.when(F.col("place") <= 12, "run").otherwise("over_cap").alias("plan"))


@query("x06_search_clean", with_tables("articles") + r"SELECT id, regexp_replace(title, '\s+[-|–—:]\s+[^-|–—:]{1,40}$', '') AS title, '' AS dek FROM articles")
def x06(spark, d):
    return articles(spark, d).select("id", T.strip_suffix(F.col("title")).alias("title"), F.lit("").alias("dek"))


@query("x07_sweep", "SELECT floor_, round(avg(CASE WHEN list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= floor_ THEN 1.0 ELSE 0.0 END), 9) AS joined FROM (VALUES (0.1), (0.3), (0.5)) p(floor_) CROSS JOIN embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY floor_")
def x07(spark, d):
    a = read(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cos = a.join(b, "vec_id").select(N.cosine(F.col("embedding"), F.col("other")).alias("cos"))
    grid = cos.select("cos", F.explode(F.array(*[F.lit(x).cast("decimal(2,1)") for x in (0.1, 0.3, 0.5)])).alias("floor_"))
    return grid.groupBy("floor_").agg(F.round(F.avg(F.when(F.col("cos") >= F.col("floor_").cast("double"), 1.0).otherwise(0.0)), 9).alias("joined"))


@query("x12_openable", with_tables("articles", "members") + "SELECT cluster_id, id FROM members JOIN articles ON article_id = id WHERE n_chars >= 600 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n_chars DESC, id) = 1")
def x12(spark, d):
    return first_by(joined(spark, d).filter("n_chars >= 600"), ["cluster_id"], F.desc("n_chars"), F.col("id")).select("cluster_id", "id")


@query("x14_other_links", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, unnest(source_ids) AS source_id FROM facts WHERE independent >= 3")
def x14(spark, d):
    return facts(spark, d).filter("independent >= 3").select("cluster_id", F.explode("source_ids").alias("source_id"))


@query("x20_read_rates", "SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, CASE WHEN count(*) < 10 THEN 'too few' WHEN avg(length(text)) > 500 THEN 'long' ELSE 'short' END AS word FROM conversations GROUP BY role")
def x20(spark, d):
    g = read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("m"))
    return g.select("role", "n", F.round("m", 6).alias("mean_chars"), F.when(F.col("n") < 10, "too few").when(F.col("m") > 500, "long").otherwise("short").alias("word"))


@query("x24_suggest_topics", with_tables("history", "articles", also="t AS (SELECT topic, count(*) FILTER (WHERE kind = 'up') AS up, count(*) FILTER (WHERE kind = 'down') AS down FROM (SELECT kind, unnest(topics) AS topic FROM history JOIN articles ON article_id = id) GROUP BY topic)") + "SELECT * FROM (SELECT topic, 'more' AS way FROM t ORDER BY up - down DESC, topic LIMIT 2) UNION ALL SELECT * FROM (SELECT topic, 'less' FROM t ORDER BY up - down, topic LIMIT 2)")
def x24(spark, d):
    t = history(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).select("kind", F.explode("topics").alias("topic")).groupBy("topic").agg((F.count_if(F.col("kind") == "up") - F.count_if(F.col("kind") == "down")).alias("v"))
    return t.orderBy(F.desc("v"), "topic").limit(2).select("topic", F.lit("more").alias("way")).union(t.orderBy("v", "topic").limit(2).select("topic", F.lit("less")))


@query("x27_import_counts", with_tables("history") + "SELECT count(*) AS rows, count(DISTINCT article_id) AS articles, count(DISTINCT user_id) AS users FROM history")
def x27(spark, d):
    return history(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("article_id").alias("articles"), F.countDistinct("user_id").alias("users"))


@query("a39_follow_coverage", with_tables("articles") + "SELECT topic, count(*) AS stories, count(DISTINCT source_id) AS outlets, max(published_s) AS newest FROM (SELECT unnest(topics) AS topic, source_id, published_s FROM articles) GROUP BY topic")
def a39(spark, d):
    return articles(spark, d).select(F.explode("topics").alias("topic"), "source_id", "published_s").groupBy("topic").agg(F.count(F.lit(1)).alias("stories"), F.countDistinct("source_id").alias("outlets"), F.max("published_s").alias("newest"))


@query("a31_image_tally", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(html, '<img') THEN 'image' WHEN contains(html, '<table') THEN 'table' ELSE 'none' END AS kind FROM pages) GROUP BY kind")
def a31(spark, d):
    return read(spark, d, "pages").select(F.when(F.col("html").contains("<img"), "image").when(F.col("html").contains("<table"), "table").otherwise("none").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("a37_run_averages", with_tables("runs") + "SELECT run // 1000 AS block, round(avg(items), 6) AS items, round(sum(CASE WHEN state = 'ok' THEN 1 ELSE 0 END) / count(*), 9) AS ok_share FROM runs GROUP BY ALL")
def a37(spark, d):
    return runs(spark, d).groupBy(F.floor(F.col("run") / 1000).alias("block")).agg(F.round(F.avg("items"), 6).alias("items"), F.round(F.count_if(F.col("state") == "ok") / F.count(F.lit(1)), 9).alias("ok_share"))


@query("s13_state_round_trip", with_tables("runs") + "SELECT source_id, arg_max(state, run) AS state, max(run) AS run FROM runs GROUP BY source_id")
def s13(spark, d):
    """State written to the shared folder and read back."""
    from quillmesh.operators.scale import materialize, scratch

    s = runs(spark, d).groupBy("source_id").agg(F.max_by("state", "run").alias("state"), F.max("run").alias("run"))
    return materialize(s, scratch(spark, "state"))


@query("s15_bodies", "SELECT page_id % 4 AS shard, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY ALL")
def s15(spark, d):
    """Bodies written by partition and read back."""
    from quillmesh.operators.scale import scratch

    path = scratch(spark, "bodies")
    read(spark, d, "pages").withColumn("shard", F.col("page_id") % 4).repartition("shard").write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))


@query("j19_split_members", with_tables("members") + "SELECT cluster_id, article_id FROM members JOIN (SELECT DISTINCT event_id % 1000 AS article_id FROM events WHERE value < 5) USING (article_id)")
def j19(spark, d):
    answers = read(spark, d, "events").filter("value < 5").select((F.col("event_id") % 1000).alias("article_id"))
    return members(spark, d).join(answers, "article_id", "left_semi").select("cluster_id", "article_id")


@query("a25_trial_bands", "SELECT CASE WHEN value >= 70 THEN 'likely' WHEN value >= 40 THEN 'possible' ELSE 'low' END AS band, event_type, count(*) AS n FROM events GROUP BY ALL")
def a25(spark, d):
    band = F.when(F.col("value") >= 70, "likely").when(F.col("value") >= 40, "possible").otherwise("low")
    return read(spark, d, "events").groupBy(band.alias("band"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("k10_trial_history", "SELECT event_id FROM events WHERE event_id % 3 = 2 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 8 DAY")
def k10(spark, d):
    e = read(spark, d, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    return e.join(last, F.col("ts") >= F.col("last") - F.expr("INTERVAL 8 DAYS")).filter("event_id % 3 = 2").select("event_id")


@query("k04_event_inheritance", with_tables("members", also="o AS (SELECT a.cluster_id % 20 AS now, b.cluster_id % 19 AS before, count(*) AS shared FROM members a JOIN members b USING (article_id) GROUP BY ALL)") + "SELECT now, before FROM o QUALIFY row_number() OVER (PARTITION BY now ORDER BY shared DESC, before) = 1")
def k04(spark, d):
    m = members(spark, d).select("article_id", (F.col("cluster_id") % 20).alias("now"), (F.col("cluster_id") % 19).alias("before"))
    o = m.groupBy("now", "before").agg(F.count(F.lit(1)).alias("shared"))
    return first_by(o, ["now"], F.desc("shared"), F.col("before")).select("now", "before")


@query("x03_rule_union", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def x03(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, d, "events").select("user_id", "event_id", r.alias("r")).filter("r <= 3").select("user_id", "event_id")


@query("x28_follow_archive", with_tables("history") + "SELECT DISTINCT h.user_id, h.article_id FROM history h WHERE kind = 'save' AND user_id IN (SELECT user_id FROM history WHERE kind = 'up')")
def x28(spark, d):
    h = history(spark, d)
    return h.filter("kind = 'save'").join(h.filter("kind = 'up'").select("user_id"), "user_id", "left_semi").select("user_id", "article_id").distinct()


@query("x30_run_notice", with_tables("runs") + """SELECT '{"ok":' || count(*) FILTER (WHERE state = 'ok') || ',"error":' || count(*) FILTER (WHERE state = 'error') || '}' AS notice FROM runs""")
def x30(spark, d):
    g = runs(spark, d).agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "error").alias("error"))
    return g.select(F.to_json(F.struct("ok", "error")).alias("notice"))


@query("r22_sorted_by", "SELECT doc_id, CASE WHEN quality = toxic THEN 'rules and model' WHEN quality = 1 THEN 'rules' ELSE 'model' END AS sorted_by FROM labels")
def r22(spark, d):
    return read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == F.col("toxic"), "rules and model").when(F.col("quality") == 1, "rules").otherwise("model").alias("sorted_by"))


@query("r21_proposal_gate", with_tables("history") + "SELECT user_id, count(*) AS n, count(*) <= 70 AND count(DISTINCT kind) >= 3 AS allowed FROM history GROUP BY user_id")
def r21(spark, d):
    g = history(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))
    return g.select("user_id", "n", ((F.col("n") <= 70) & (F.col("kinds") >= 3)).alias("allowed"))
