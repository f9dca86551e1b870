"""J, A, C, X: joins, aggregates over answers and runs, integrity checks, page helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.items import first_by
from quillmesh.operators.order import placed_in
from quillmesh.operators.quotes import quoted, sources_of
from quillmesh.operators.scale import materialize, scratch, skew_join
from quillmesh.session import ship
from quillmesh.sources.fixtures import BASE_S, NOW_S, articles, members, read, runs, sources, with_tables

from .base import query
from .items import RAW, STORY, facts

W = r"[\p{L}\p{N}]+"


def joined(spark, d):
    return members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))


@query("j01_article_source", with_tables("articles", "sources") + "SELECT id, source_id, country, lean FROM articles LEFT JOIN sources USING (source_id)")
def j01(spark, d):
    return articles(spark, d).join(F.broadcast(sources(spark, d)), "source_id", "left").select("id", "source_id", "country", "lean")


@query("j02_cluster_articles", with_tables("articles", "members") + "SELECT cluster_id, list_sort(list(id)) AS article_ids FROM members JOIN articles ON article_id = id GROUP BY cluster_id")
def j02(spark, d):
    return joined(spark, d).groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("article_ids"))


@query("j06_quote_archive", r"""WITH b AS (SELECT item_id, lower(text) AS q, array_to_string(string_split(lower(text), ' ')[1:6], ' ') AS k FROM benchmark), t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, item_id FROM t JOIN b ON contains(t.t, b.q)""")
def j06(spark, d):
    """Each text is scanned once for all quotes, of any length."""
    ship(spark)
    b = read(spark, d, "benchmark").select("item_id", F.lower("text").alias("q"))
    t = read(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return quoted(b, "item_id", t, "doc_id")


POST_S = f"{BASE_S} + (item_id * 104729) % 259200 - 43200"
FOLD = lambda x: rf"trim(regexp_replace(lower(replace(replace({x}, '’', ''''), '‘', '''')), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'))"
WORDS = lambda x: rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)*'))"
QUOTES = rf"""posts AS (SELECT item_id AS url, {POST_S} AS published_s, {FOLD("text")} AS t FROM benchmark WHERE NOT regexp_matches(text, '(?i)^\s*RT\b')),
  versions AS (SELECT id, published_s, title || ' on Truth Social: “' || array_to_string(string_split(text, ' ')[2:5 + id % 7], ', ') || '” and "' || lower(array_to_string(string_split(text, ' ')[3:11], ' ')) || '"' AS text FROM articles JOIN benchmark ON id % 41 = item_id),
  spans AS (SELECT id, published_s, unnest(s) AS raw, generate_subscripts(s, 1) AS place FROM (SELECT id, published_s, regexp_extract_all(text, '"[^"]+"|“[^”]+”') AS s FROM versions WHERE regexp_matches(text, '(?i)truth social'))),
  folded AS (SELECT id, published_s, place, {FOLD("substr(raw, 2, length(raw) - 2)")} AS q FROM spans),
  one AS (SELECT id, place, min(url) AS url FROM folded f JOIN posts p ON contains(p.t, f.q) AND f.published_s - p.published_s BETWEEN 0 AND 259200 WHERE {WORDS("q")} >= 6 AND {WORDS("t")} >= 6 GROUP BY id, place HAVING count(DISTINCT url) = 1)"""


@query("j06_quote_sources", with_tables("articles", also=QUOTES) + "SELECT id, url FROM one QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1")
def j06_sources(spark, d):
    """Items as posts, and versions that quote one of them twice, once too short at times."""
    b = read(spark, d, "benchmark")
    posts = b.select(F.col("item_id").alias("url"), F.expr(POST_S).alias("published_s"), "text")
    w = F.split("text", " ")
    cut = F.concat("title", F.lit(" on Truth Social: “"), F.array_join(F.slice(w, F.lit(2), (F.col("id") % 7 + 4).cast("int")), ", "), F.lit('” and "'), F.lower(F.array_join(F.slice(w, 3, 9), " ")), F.lit('"'))
    a = articles(spark, d).select("id", "published_s", "title")
    versions = a.join(F.broadcast(b), F.col("id") % 41 == F.col("item_id")).select("id", "published_s", cut.alias("text"))
    return sources_of(versions, posts)


@query("j07_first_match", with_tables("articles", "members") + "SELECT cluster_id, id FROM members JOIN articles ON article_id = id WHERE contains(lower(dek), 'the') QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY published_s, id) = 1")
def j07(spark, d):
    return first_by(joined(spark, d).filter(F.lower("dek").contains("the")), ["cluster_id"], F.col("published_s"), F.col("id")).select("cluster_id", "id")


@query("j08_priority_match", with_tables("articles", also="c AS (SELECT a.id, b.id AS other, 1 AS pri FROM articles a JOIN articles b ON b.title = a.title AND b.source_id = a.source_id AND b.id <> a.id UNION ALL SELECT a.id, b.id, 2 FROM articles a JOIN articles b ON b.title = a.title AND b.id <> a.id)") + "SELECT id, other, pri FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY pri, other) = 1")
def j08(spark, d):
    """A group's two least ids answer for all its rows, so equal titles are never paired with each other."""
    a = materialize(articles(spark, d).select("id", "title", "source_id"), scratch(spark, "titles"))

    def least(keys):
        r = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        two = a.withColumn("r", r).filter("r <= 2").groupBy(*keys).agg(F.min("id").alias("low"), F.max("id").alias("next")).filter("low <> next")
        return two.select(F.to_json(F.struct(*keys)).alias("group"), "low", "next")

    n, out = a.count(), []
    for pri, keys in ((1, ["title", "source_id"]), (2, ["title"])):
        met = skew_join(a.select("id", F.to_json(F.struct(*keys)).alias("group")), least(keys), "group", F.col("id"), n)
        out.append(met.select("id", F.when(F.col("id") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("other"), F.lit(pri).alias("pri")))
    return first_by(out[0].union(out[1]), ["id"], F.col("pri"), F.col("other"))


@query("j09_outlet_resolve", with_tables("sources") + r"""SELECT page_id, coalesce(a.source_id, b.source_id) AS source_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages) p LEFT JOIN sources a ON p.h = a.source_id || '.example.com' LEFT JOIN sources b ON p.page_id % 20 = b.k""")
def j09(spark, d):
    s = sources(spark, d)
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("h"))
    by_host = s.select(F.concat("source_id", F.lit(".example.com")).alias("h"), F.col("source_id").alias("x"))
    by_name = s.select("k", F.col("source_id").alias("y"))
    return p.join(F.broadcast(by_host), "h", "left").join(F.broadcast(by_name), F.col("page_id") % 20 == F.col("k"), "left").select("page_id", F.coalesce("x", "y").alias("source_id"))


@query("j10_reserve", with_tables("articles") + "SELECT id FROM articles WHERE id % 5 <> 0 AND url NOT IN (SELECT url FROM articles WHERE id % 5 = 0)")
def j10(spark, d):
    a = articles(spark, d).select("id", "url")
    published = a.filter("id % 5 = 0")
    return a.join(published.select("id"), "id", "left_anti").join(published.select("url"), "url", "left_anti").select("id")


@query("j11_published_members", with_tables("articles", "members") + "SELECT cluster_id, article_id FROM members WHERE article_id IN (SELECT id FROM articles WHERE id % 5 = 0)")
def j11(spark, d):
    return members(spark, d).join(articles(spark, d).filter("id % 5 = 0").select(F.col("id").alias("article_id")), "article_id", "left_semi").select("cluster_id", "article_id")


MISSES = rf"""t AS (SELECT id, published_s, list_distinct(list_filter(regexp_extract_all(lower(title), '{W}'), lambda w: length(w) >= 3)) AS w FROM articles), p AS (SELECT id, published_s, w, unnest(w) AS x FROM t), df AS (SELECT x, count(*) AS n FROM p GROUP BY x)"""


@query("j12_near_misses", with_tables("articles", also=MISSES) + "SELECT a.id AS a, b.id AS b, count(*) AS shared FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND abs(a.published_s - b.published_s) <= 172800 JOIN df ON df.x = a.x AND df.n <= 60 GROUP BY a.id, b.id HAVING count(*) >= 3 AND 4 * count(*) >= any_value(len(a.w)) + any_value(len(b.w)) - count(*)")
def j12(spark, d):
    """Postings longer than 60 are left out, as the definition has it."""
    w = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("title"), F.lit(f"({W})")), lambda x: F.length(x) >= 3))
    t = articles(spark, d).select("id", "published_s", w.alias("w"))
    p = t.select("id", "published_s", F.size("w").alias("n"), F.explode("w").alias("x"))
    df = p.groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter("df <= 60")
    p = p.join(df.select("x"), "x")
    q = p.select("x", F.col("id").alias("b"), F.col("published_s").alias("tb"), F.col("n").alias("nb"))
    met = p.join(q, "x").filter((F.col("id") < F.col("b")) & (F.abs(F.col("published_s") - F.col("tb")) <= 172_800))
    return met.groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("na"), F.first("nb").alias("nb")).filter("shared >= 3 and 4 * shared >= na + nb - shared").select("a", "b", "shared")


@query("j13_known_pairs", with_tables("articles", "members") + "SELECT unit_id, lag(article_id) OVER w AS a, article_id AS b FROM members WINDOW w AS (PARTITION BY unit_id ORDER BY article_id) QUALIFY a IS NOT NULL")
def j13(spark, d):
    w = Window.partitionBy("unit_id").orderBy("article_id")
    return members(spark, d).select("unit_id", F.lag("article_id").over(w).alias("a"), F.col("article_id").alias("b")).filter("a is not null")


@query("j14_anchor_pairs", with_tables("members") + "SELECT cluster_id, min(article_id) OVER (PARTITION BY cluster_id) AS anchor, article_id AS member FROM members QUALIFY anchor <> member")
def j14(spark, d):
    m = members(spark, d)
    return m.select("cluster_id", F.min("article_id").over(Window.partitionBy("cluster_id")).alias("anchor"), F.col("article_id").alias("member")).filter("anchor <> member")


@query("j15_event_overlap", with_tables("members") + "SELECT a.cluster_id % 20 AS now, b.cluster_id % 19 AS before, count(*) AS shared FROM members a JOIN members b USING (article_id) GROUP BY ALL")
def j15(spark, d):
    m = members(spark, d)
    b = m.select("article_id", (F.col("cluster_id") % 19).alias("before"))
    return m.join(b, "article_id").groupBy((F.col("cluster_id") % 20).alias("now"), "before").agg(F.count(F.lit(1)).alias("shared"))


@query("j18_cluster_event", "SELECT cluster_id, min(event_id) AS event_id FROM (SELECT event_id % 50 AS event_id, unnest([event_id % 257, event_id * 3 % 257]) AS cluster_id FROM events) GROUP BY cluster_id")
def j18(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 50).alias("event_id"), F.explode(F.array(F.col("event_id") % 257, F.col("event_id") * 3 % 257)).alias("cluster_id"))
    return first_by(e.distinct(), ["cluster_id"], F.col("event_id"))


@query("j20_rule_text", "SELECT r.term, conv_id, turn FROM (VALUES ('que la'), ('of the'), ('nicht')) r(term) JOIN conversations ON contains(' ' || lower(text) || ' ', ' ' || r.term || ' ')")
def j20(spark, d):
    rules = spark.createDataFrame([("que la",), ("of the",), ("nicht",)], "term string")
    hay = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    return read(spark, d, "conversations").withColumn("hay", hay).join(F.broadcast(rules), F.col("hay").contains(F.concat(F.lit(" "), "term", F.lit(" ")))).select("term", "conv_id", "turn")


@query("a12_locality", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, min(CASE WHEN bucket = 'ASIA' THEN 0 WHEN bucket = 'EUROPE' THEN 1 ELSE 2 END) AS tier FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) GROUP BY cluster_id")
def a12(spark, d):
    return joined(spark, d).join(F.broadcast(sources(spark, d)), "source_id").groupBy("cluster_id").agg(F.min(F.when(F.col("bucket") == "ASIA", 0).when(F.col("bucket") == "EUROPE", 1).otherwise(2)).alias("tier"))


@query("a15_rule_stats", with_tables("articles") + f"SELECT lang, count(*) AS kept, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE {NOW_S} - published_s > 129600) AS over_36h, list_sort(list({NOW_S} - published_s))[count(*) // 2 + 1] AS upper_median FROM articles GROUP BY lang")
def a15(spark, d):
    """The upper median is the age at its place; no group is gathered."""
    a = placed_in(articles(spark, d).select("id", "lang", "n_chars", (F.lit(NOW_S) - F.col("published_s")).alias("age")), ["lang"], "age", "id")
    g = a.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("kept"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("age") > 36 * 3600).alias("over_36h"))
    return g.join(a, F.col("of").eqNullSafe(F.col("lang")) & (F.col("place") == F.floor(F.col("kept") / 2) + 1)).select("lang", "kept", "bytes", "over_36h", F.col("age").alias("upper_median"))


@query("a16_bucket_lean", with_tables("articles", "sources") + "SELECT bucket, count(*) FILTER (WHERE lean = 'left') AS l, count(*) FILTER (WHERE lean = 'center') AS c, count(*) FILTER (WHERE lean = 'right') AS r FROM articles JOIN sources USING (source_id) GROUP BY bucket")
def a16(spark, d):
    a = articles(spark, d).join(F.broadcast(sources(spark, d)), "source_id")
    return a.groupBy("bucket").agg(*[F.count_if(F.coalesce(F.col("lean") == name, F.lit(False))).alias(name[0]) for name in ("left", "center", "right")])


@query("a17_missed", with_tables("articles", "sources", "members", also=STORY) + "SELECT count(*) AS missed FROM members JOIN facts USING (cluster_id) WHERE article_id % 3 = 0 AND independent >= 2")
def a17(spark, d):
    return members(spark, d).join(facts(spark, d), "cluster_id").filter("article_id % 3 = 0 and independent >= 2").agg(F.count(F.lit(1)).alias("missed"))


@query("a18_gate", with_tables("runs") + "SELECT source_id, count(*) >= 20 AND sum(items) >= 100 AND avg(CASE WHEN state = 'error' THEN 1.0 ELSE 0.0 END) <= 0.25 AND bool_or(state = 'ok') AS passes FROM runs GROUP BY source_id")
def a18(spark, d):
    g = runs(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("items").alias("items"), F.avg(F.when(F.col("state") == "error", 1.0).otherwise(0.0)).alias("bad"), F.bool_or(F.col("state") == "ok").alias("some"))
    return g.select("source_id", ((F.col("n") >= 20) & (F.col("items") >= 100) & (F.col("bad") <= 0.25) & F.col("some")).alias("passes"))


@query("a19_answer_share", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) / count(*) AS share, count(*) >= 20 AND count(*) FILTER (WHERE quality = 1) >= 0.8 * count(*) AS passes FROM labels")
def a19(spark, d):
    g = read(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("y"))
    return g.select("n", (F.col("y") / F.col("n")).alias("share"), ((F.col("n") >= 20) & (F.col("y") >= 0.8 * F.col("n"))).alias("passes"))


@query("a20_agreement_rollup", "SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agree FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)")
def a20(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("agree"))


@query("a21_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a21(spark, d):
    return read(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("a22_percentiles", "SELECT event_type, v[CAST(floor(0.5 * n) AS INT) + 1] AS p50, v[CAST(floor(0.9 * n) AS INT) + 1] AS p90 FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)")
def a22(spark, d):
    """The element at int(q * n), by its place; no group is gathered into one task."""
    e = placed_in(read(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "event_id")
    n = e.groupBy(F.col("event_type").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    at = n.select("of", F.floor(F.lit(0.5) * F.col("n")).alias("a"), F.floor(F.lit(0.9) * F.col("n")).alias("b")).withColumn("wanted", F.explode(F.array_distinct(F.array("a", "b"))))
    met = at.join(e, F.col("of").eqNullSafe(F.col("event_type")) & (F.col("place") == F.col("wanted") + 1))
    return met.groupBy("event_type").agg(F.max(F.when(F.col("wanted") == F.col("a"), F.col("value"))).alias("p50"), F.max(F.when(F.col("wanted") == F.col("b"), F.col("value"))).alias("p90"))


@query("a23_scorecard", "SELECT feature, CASE WHEN n < 10 THEN 'too_few' WHEN share >= 0.8 THEN 'met' WHEN share >= 0.6 THEN 'near' ELSE 'missed' END AS status FROM (SELECT lang AS feature, count(*) AS n, avg(quality) AS share FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def a23(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", F.col("lang").alias("feature")), "doc_id").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("share"))
    return j.select("feature", F.when(F.col("n") < 10, "too_few").when(F.col("share") >= 0.8, "met").when(F.col("share") >= 0.6, "near").otherwise("missed").alias("status"))


@query("a24_topic_trial", with_tables("articles") + "SELECT topic, count(*) FILTER (WHERE id % 2 = 0) AS own, count(*) FILTER (WHERE id % 2 = 1) AS other FROM (SELECT id, unnest(topics) AS topic FROM articles) GROUP BY topic")
def a24(spark, d):
    return articles(spark, d).select("id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.count_if(F.col("id") % 2 == 0).alias("own"), F.count_if(F.col("id") % 2 == 1).alias("other"))


@query("a30_placeholder_image", "SELECT h, count(*) AS n FROM (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h, page_id % 3 AS img FROM pages) GROUP BY h HAVING count(*) >= 2 AND count(DISTINCT img) = 1")
def a30(spark, d):
    p = read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("h"), (F.col("page_id") % 3).alias("img"))
    return p.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("img").alias("x"), F.max("img").alias("y")).filter("n >= 2 and x = y").select("h", "n")


@query("a33_unique_words", with_tables("articles", "members", also="w AS (SELECT DISTINCT cluster_id, id, unnest(string_split(lower(title), ' ')) AS word FROM members JOIN articles ON article_id = id)") + "SELECT cluster_id, min(id) AS id, word FROM w GROUP BY cluster_id, word HAVING count(*) = 1")
def a33(spark, d):
    w = joined(spark, d).select("cluster_id", "id", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    return w.groupBy("cluster_id", "word").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("cluster_id", "id", "word")


@query("a34_coverage", with_tables("articles", "sources", "members") + "SELECT cluster_id, coalesce(lean, 'none') AS lean, list_sort(list(DISTINCT source_id)) AS outlets FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) GROUP BY ALL")
def a34(spark, d):
    return joined(spark, d).join(F.broadcast(sources(spark, d)), "source_id").groupBy("cluster_id", F.coalesce("lean", F.lit("none")).alias("lean")).agg(F.array_sort(F.collect_set("source_id")).alias("outlets"))


@query("a35_story_build", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, topics, independent, source_ids, latest_s FROM facts")
def a35(spark, d):
    return facts(spark, d).select("cluster_id", "topics", "independent", "source_ids", "latest_s")


@query("a38_zero_fill", with_tables("articles") + "SELECT lang, topic, count(id) AS n FROM (SELECT DISTINCT lang FROM articles) CROSS JOIN (SELECT unnest(['politics', 'economy', 'science', 'conflict', 'culture', 'sport']) AS topic) LEFT JOIN (SELECT id, lang, unnest(topics) AS topic FROM articles) USING (lang, topic) GROUP BY ALL")
def a38(spark, d):
    topics = spark.createDataFrame([(t,) for t in ("politics", "economy", "science", "conflict", "culture", "sport")], "topic string")
    a = articles(spark, d)
    n = a.select("lang", F.explode("topics").alias("topic")).groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("n"))
    domain = a.select("lang").distinct().crossJoin(F.broadcast(topics))  # a stated domain of a few rows
    return domain.join(n, ["lang", "topic"], "left").select("lang", "topic", F.coalesce("n", F.lit(0)).alias("n"))


@query("a40_keyword_scores", with_tables("articles", also="w AS (SELECT DISTINCT id, unnest(string_split(lower(title), ' ')) AS word FROM articles), df AS (SELECT word, count(*) AS df FROM w GROUP BY word), n AS (SELECT count(*) AS n FROM articles)") + "SELECT word, round(ln((n + 1) / (df + 0.5)), 9) AS idf FROM df, n WHERE n < 20 OR df <= 0.2 * n")
def a40(spark, d):
    a = articles(spark, d)
    n = F.broadcast(a.agg(F.count(F.lit(1)).alias("n")))
    df = a.select(F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)
    return df.filter("n < 20 or df <= 0.2 * n").select("word", F.round(F.log((F.col("n") + 1) / (F.col("df") + 0.5)), 9).alias("idf"))


@query("a41_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a41(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


@query("c02_cross_references", with_tables("members") + "SELECT 'article in several clusters' AS fault, count(*) AS n FROM (SELECT article_id FROM (SELECT article_id, cluster_id FROM members UNION ALL SELECT article_id, cluster_id + 1 FROM members WHERE article_id % 50 = 0) GROUP BY article_id HAVING count(DISTINCT cluster_id) > 1) UNION ALL SELECT 'unit across clusters', count(*) FROM (SELECT unit_id FROM members GROUP BY unit_id HAVING count(DISTINCT cluster_id) > 1)")
def c02(spark, d):
    m = members(spark, d)
    bad = m.select("article_id", "cluster_id").union(m.filter("article_id % 50 = 0").select("article_id", F.col("cluster_id") + 1))
    several = bad.groupBy("article_id").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1").agg(F.lit("article in several clusters").alias("fault"), F.count(F.lit(1)).alias("n"))
    across = m.groupBy("unit_id").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1").agg(F.lit("unit across clusters").alias("fault"), F.count(F.lit(1)).alias("n"))
    return several.union(across)


@query("c03_ledger_balance", with_tables("articles", also=RAW) + "SELECT true AS balanced, count(*) AS fetched FROM raw")
def c03(spark, d):
    from .items import checked

    g = checked(spark, d).agg(F.count(F.lit(1)).alias("fetched"), F.count("drop_reason").alias("drops"), F.count_if(F.col("drop_reason").isNull()).alias("kept"))
    return g.select((F.col("fetched") == F.col("drops") + F.col("kept")).alias("balanced"), "fetched")


@query("c04_event_checks", "SELECT count(*) AS unknown FROM (SELECT DISTINCT event_id % 300 AS c FROM events) WHERE c NOT IN (SELECT (doc_id * 31) % 257 FROM documents)")
def c04(spark, d):
    known = members(spark, d).select(F.col("cluster_id").alias("c")).distinct()
    return read(spark, d, "events").select((F.col("event_id") % 300).alias("c")).distinct().join(known, "c", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))


@query("c07_gold_rule", with_tables("articles", "members") + "SELECT cluster_id, max(published_s) - min(published_s) <= 172800 AS within FROM members JOIN articles ON article_id = id GROUP BY cluster_id")
def c07(spark, d):
    return joined(spark, d).groupBy("cluster_id").agg((F.max("published_s") - F.min("published_s") <= 172_800).alias("within"))


@query("c08_floors", "SELECT lang, avg(quality) >= 0.8 AS ok FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def c08(spark, d):
    floors = spark.createDataFrame([(x, 0.8) for x in ("en", "de", "fr", "es")], "lang string, floor double")
    m = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("v"))
    return m.join(F.broadcast(floors), "lang").select("lang", (F.col("v") >= F.col("floor")).alias("ok"))


@query("x01_live_rows", with_tables("articles", "members") + "SELECT cluster_id, CASE WHEN bool_or(list_contains(topics, 'culture')) THEN NULL ELSE min(title) END AS label FROM members JOIN articles ON article_id = id WHERE cluster_id % 3 = 0 GROUP BY cluster_id")
def x01(spark, d):
    g = joined(spark, d).filter("cluster_id % 3 = 0").groupBy("cluster_id").agg(F.bool_or(F.array_contains("topics", "culture")).alias("tagged"), F.min("title").alias("t"))
    return g.select("cluster_id", F.when(~F.col("tagged"), F.col("t")).alias("label"))


@query("x02_query_union", "SELECT tag, CAST(row_number() OVER (ORDER BY r, user_id) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY r, user_id) AS d FROM (SELECT user_id, event_type AS tag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 5) WHERE d = 1 QUALIFY place <= 60")
def x02(spark, d):
    q = read(spark, d, "events").select("user_id", F.col("event_type").alias("tag"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("r")).filter("r <= 5")
    one = first_by(q, ["tag"], F.col("r"), F.col("user_id"))
    first = one.orderBy("r", "user_id").limit(60)
    return first.select("tag", F.row_number().over(Window.orderBy("r", "user_id")).alias("place"))


def combined(r):
    """ok where any run of a source was, else empty, else error."""
    g = r.groupBy("source_id").agg(F.bool_or(F.col("state") == "ok").alias("ok"), F.bool_or(F.col("state") == "empty").alias("empty"))
    return g.select("source_id", F.when(F.col("ok"), "ok").when(F.col("empty"), "empty").otherwise("error").alias("state"))


@query("x05_combined_state", with_tables("runs") + "SELECT source_id, CASE WHEN bool_or(state = 'ok') THEN 'ok' WHEN bool_or(state = 'empty') THEN 'empty' ELSE 'error' END AS state FROM runs WHERE run % 7 = 0 GROUP BY source_id")
def x05(spark, d):
    return combined(runs(spark, d).filter("run % 7 = 0"))


@query("x05_all_runs", with_tables("runs") + "SELECT source_id, CASE WHEN bool_or(state = 'ok') THEN 'ok' WHEN bool_or(state = 'empty') THEN 'empty' ELSE 'error' END AS state FROM runs GROUP BY source_id")
def x05_all(spark, d):
    return combined(runs(spark, d))


@query("x08_version_review", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, independent FROM facts WHERE n >= 2 ORDER BY independent DESC, cluster_id LIMIT 20")
def x08(spark, d):
    return facts(spark, d).filter("n >= 2").orderBy(F.desc("independent"), "cluster_id").limit(20).select("cluster_id", "independent")


@query("x10_carousel", with_tables("members") + "SELECT article_id FROM members WHERE cluster_id IN (SELECT cluster_id FROM members GROUP BY cluster_id HAVING count(DISTINCT unit_id) > 1)")
def x10(spark, d):
    m = members(spark, d)
    many = m.groupBy("cluster_id").agg(F.countDistinct("unit_id").alias("n")).filter("n > 1")
    return m.join(many, "cluster_id", "left_semi").select("article_id")


@query("x11_body_chars", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS chars FROM pages")
def x11(spark, d):
    return read(spark, d, "pages").select("page_id", F.length(T.collapse(F.regexp_replace("html", "<[^>]*>", " "))).cast("long").alias("chars"))


@query("x13_event_share", with_tables("articles", "members") + "SELECT max(n) AS largest FROM (SELECT e, count(*) AS n FROM (SELECT cluster_id % 5 AS e FROM members JOIN articles ON article_id = id ORDER BY n_chars DESC, id LIMIT 12) GROUP BY e)")
def x13(spark, d):
    top = joined(spark, d).orderBy(F.desc("n_chars"), "id").limit(12)
    return top.groupBy((F.col("cluster_id") % 5).alias("e")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))


@query("x15_story_marks", with_tables("articles", "members") + "SELECT cluster_id, bool_or(len(topics) >= 3) AS tagged, bool_or(id % 9 = 0) AS joined FROM members JOIN articles ON article_id = id GROUP BY cluster_id")
def x15(spark, d):
    return joined(spark, d).groupBy("cluster_id").agg(F.bool_or(F.size("topics") >= 3).alias("tagged"), F.bool_or(F.col("id") % 9 == 0).alias("joined"))


@query("x17_sections", with_tables("articles") + r"""SELECT id, CAST(floor((i - 1) / 5) AS INT) AS section, count(*) AS n FROM (SELECT id, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(dek, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM articles)) GROUP BY ALL""")
def x17(spark, d):
    return articles(spark, d).select("id", F.posexplode(T.sentences(F.col("dek"))).alias("i", "s")).groupBy("id", F.floor(F.col("i") / 5).cast("int").alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("x19_longest_run", "SELECT conv_id, max(n) AS longest FROM (SELECT conv_id, g, count(*) AS n FROM (SELECT conv_id, length(text) > 200 AS m, turn - row_number() OVER (PARTITION BY conv_id, length(text) > 200 ORDER BY turn) AS g FROM conversations) WHERE NOT m GROUP BY conv_id, g) GROUP BY conv_id")
def x19(spark, d):
    c = read(spark, d, "conversations").filter(F.length("text") <= 200).withColumn("g", F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.max("n").alias("longest"))


@query("x21_first_answers", "SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def x21(spark, d):
    return first_by(read(spark, d, "conversations").filter("role = 'assistant'"), ["conv_id"], F.col("turn")).select("conv_id", "turn")


@query("x22_expected_position", "SELECT event_id, round((1 * a + 2 * b + 3 * c) / (a + b + c), 9) AS position FROM (SELECT event_id, event_id % 5 + 1 AS a, event_id % 3 + 1 AS b, event_id % 7 + 1 AS c FROM events)")
def x22(spark, d):
    p = F.array(*[(F.col("event_id") % m + 1).cast("double") for m in (5, 3, 7)])
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.zip_with("p", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return read(spark, d, "events").withColumn("p", p).select("event_id", F.round(mean / total, 9).alias("position"))
