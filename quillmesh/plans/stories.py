"""J, A, O, R: from items to stories and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import features, storybuild
from quillmesh.operators import stories as S
from quillmesh.operators.scale import materialize, scratch
from quillmesh.session import ship
from quillmesh.sources.fixtures import articles, members, read, sources, with_tables

from .base import query
from .items import STORY, facts

W = r"[\p{L}\p{N}]+"
BIG = "CASE WHEN len({0}) < 2 THEN {0} ELSE list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) END"
SETS = rf"""ws AS (SELECT id, source_id, published_s, regexp_extract_all(lower(regexp_replace(title, '\s+[-|–—:]\s+[^-|–—:]{{1,40}}$', '')), '{W}') AS t, regexp_extract_all(lower(dek), '{W}')[1:30] AS dk FROM articles),
  w2 AS (SELECT *, list_concat(t, dk) AS w FROM ws),
  sets AS (SELECT id, source_id, published_s, list_distinct({BIG.format('w')}) AS f, CASE WHEN len(t) >= 6 THEN list_distinct({BIG.format('t')}) ELSE [] END AS h FROM w2),
  fp AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM (SELECT id, unnest(f) AS g FROM sets) a JOIN (SELECT id, unnest(f) AS g FROM sets) b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
  hp AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM (SELECT id, unnest(h) AS g FROM sets) a JOIN (SELECT id, unnest(h) AS g FROM sets) b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
  near AS (SELECT a, b, coalesce(fp.n / (len(x.f) + len(y.f) - fp.n), 0.0) AS similarity, coalesce(hp.n / (len(x.h) + len(y.h) - hp.n), 0.0) AS titles FROM fp FULL JOIN hp USING (a, b) JOIN sets x ON x.id = a JOIN sets y ON y.id = b WHERE abs(x.published_s - y.published_s) <= 172800),
  pairs AS (SELECT * FROM near WHERE similarity >= 0.5 OR titles >= 0.8)"""
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
FOLD = "CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN substr(w, 1, length(w) - 1) ELSE w END"


def content_sql(text: str, cut: str = "") -> str:
    return rf"list_transform(list_filter(regexp_extract_all(lower({text}), '{W}'), lambda w: w NOT IN ({STOP}) AND CASE WHEN regexp_matches(w, '^\d+$') THEN length(w) >= 3 ELSE length(w) >= 2 END){cut}, lambda w: {FOLD})"


TERMS = f"""cw AS (SELECT id, {content_sql('title', '')} AS t, {content_sql('dek', '[1:50]')} AS dk FROM articles),
  tr AS (SELECT id, unnest(t) AS term, 2 AS n, true AS title FROM cw UNION ALL SELECT id, unnest({BIG.format('t')}), 1, true FROM cw WHERE len(t) > 1 UNION ALL SELECT id, unnest(dk), 1, false FROM cw),
  terms AS (SELECT id, term, sum(n) AS tf, bool_or(title) AS title FROM tr GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
  rawv AS (SELECT id, term, df, title, tf * pow(ln((1 + (SELECT count(*) FROM articles)) / (1 + df)) + 1, 0.75) AS w FROM terms JOIN dfs USING (term)),
  vectors AS (SELECT id, term, df, title, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM rawv)"""
BLOCKED = """blocked AS (SELECT a.id AS a, b.id AS b FROM (SELECT * FROM vectors JOIN (SELECT id, source_id, published_s FROM articles) USING (id) WHERE title AND df <= greatest(25, CAST(floor(0.01 * (SELECT count(*) FROM articles)) AS INT))) a
  JOIN (SELECT * FROM vectors JOIN (SELECT id, source_id, published_s FROM articles) USING (id) WHERE title) b ON a.term = b.term AND a.id < b.id AND a.source_id <> b.source_id AND abs(a.published_s - b.published_s) <= 129600
  JOIN unit ua ON ua.id = a.id JOIN unit ub ON ub.id = b.id AND ua.unit <> ub.unit GROUP BY ALL HAVING count(*) FILTER (WHERE a.df <= 10) >= 1 OR count(*) >= 2)"""
UNIT = """edge AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
  reach AS (SELECT x, y FROM edge UNION SELECT r.x, p.y FROM reach r JOIN edge p ON r.y = p.x),
  unit AS (SELECT id, least(id, coalesce(m, id)) AS unit FROM articles LEFT JOIN (SELECT x AS id, min(y) AS m FROM reach GROUP BY x) USING (id))"""


@query("near_duplicate_pairs", with_tables("articles", also=SETS) + "SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def near_duplicate_pairs(spark, d):
    """The flagship: candidates by their rarest shingles, the time band, the exact check."""
    ship(spark)
    return S.near_pairs(articles(spark, d)).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("o01_units", with_tables("articles", also=SETS + ", " + UNIT) + "SELECT id, unit FROM unit")
def o01(spark, d):
    ship(spark)
    return S.units(articles(spark, d))


@query("j04_near_classes")
def j04(spark, d):
    """J4 in proportion to the items: their classes and titles, and the pairs of those; the tests expand it to `near_duplicate_pairs`."""
    ship(spark)
    return S.class_links(articles(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query("a03_idf", with_tables("articles", also=TERMS) + "SELECT term, df, round(pow(ln((1 + (SELECT count(*) FROM articles)) / (1 + df)) + 1, 0.75), 9) AS idf FROM dfs")
def a03(spark, d):
    a = articles(spark, d)
    n = a.count()
    df = S.term_rows(a).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.round(F.pow(F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1, F.lit(0.75)), 9).alias("idf"))


@query("a05_vectors", with_tables("articles", also=TERMS) + "SELECT id, term, round(w, 9) AS w FROM vectors")
def a05(spark, d):
    a = articles(spark, d)
    return S.tf_idf(S.term_rows(a), a.count()).select("id", "term", F.round("w", 9).alias("w"))


def linked(spark, d):
    """(items, units, vectors, blocked pairs), each written once."""
    ship(spark)
    kept = lambda df, tag: materialize(df, scratch(spark, tag))
    a = kept(articles(spark, d).select("id", "source_id", "title", "dek", "published_s"), "articles")
    n = a.count()
    u = kept(S.units(a), "units")
    v = kept(S.tf_idf(kept(S.term_rows(a), "terms"), n), "vectors")
    return a, u, v, kept(S.blocked_pairs(v, a, u, n), "blocked")


@query("j05_blocked_pairs", with_tables("articles", also=", ".join((SETS, UNIT, TERMS, BLOCKED))) + "SELECT a, b FROM blocked")
def j05(spark, d):
    return linked(spark, d)[3]


@query("f16_pair_scores", with_tables("articles", also=", ".join((SETS, UNIT, TERMS, BLOCKED))) + """SELECT a, b, round(dot * exp(-abs(x.published_s - y.published_s) / 86400.0), 6) AS score FROM (SELECT a, b, sum(p.w * q.w) AS dot FROM blocked JOIN vectors p ON p.id = a JOIN vectors q ON q.id = b AND q.term = p.term GROUP BY ALL) JOIN articles x ON x.id = a JOIN articles y ON y.id = b""")
def f16(spark, d):
    a, _, v, pairs = linked(spark, d)
    return S.scored_pairs(pairs, v, a, digits=6)


@query("o02_average_link")
def o02(spark, d):
    """Rounds of joins, held against one join at a time in the tests."""
    ship(spark)
    a, u, v, pairs = linked(spark, d)
    return S.average_link(a, u, S.scored_pairs(pairs, v, a))


@query("a05_story_vectors")
def a05_stories(spark, d):
    """A4, A5, F12 to F14 in full: story stopwords, amounts, entities by the run's own capitals, weighted half as much again."""
    ship(spark)
    a = articles(spark, d)
    return features.story_vectors(features.story_terms(a), a.count()).select("id", "term", "df", "entity", F.round("w", 9).alias("w"))


@query("o03_stories")
def o03(spark, d):
    """O2 and O3 in full: average link with the threshold of rare entities, then the merge pass over shared headline words."""
    ship(spark)
    return storybuild.build_stories(articles(spark, d))


@query("r24_story_method", with_tables("members", also="s AS (SELECT cluster_id, count(DISTINCT unit_id) AS units, count(*) > count(DISTINCT unit_id) AS dups, bool_or(article_id < 500) AS emb FROM members GROUP BY cluster_id)") + "SELECT cluster_id, CASE WHEN units = 1 AND dups THEN 'minhash' ELSE (CASE WHEN dups THEN 'minhash+cosine_entity' ELSE 'cosine_entity' END) || (CASE WHEN emb THEN '+embedding' ELSE '' END) END AS method FROM s")
def r24(spark, d):
    s = members(spark, d).groupBy("cluster_id").agg(F.countDistinct("unit_id").alias("units"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("article_id") < 500).alias("emb"))
    return s.select("cluster_id", S.method_of(F.col("units"), F.col("n") > F.col("units"), F.col("emb")).alias("method"))


PROPER = rf"""pw AS (SELECT unnest(list_transform(regexp_extract_all(t, '{W}')[2:], lambda w: w)) AS w FROM (SELECT title AS t FROM articles UNION ALL SELECT dek FROM articles)),
  proper AS (SELECT lower(w) AS k, count(*) FILTER (WHERE regexp_matches(w, '^\p{{Lu}}')) AS cap, count(*) AS n FROM pw GROUP BY ALL)"""


def proper(spark, d):
    a = articles(spark, d)
    w = a.select("title").union(a.select("dek")).select(F.explode(F.slice(F.regexp_extract_all("title", F.lit(f"({T.WORD})")), F.lit(2), F.length("title") + 1)).alias("w"))
    return w.groupBy(F.lower("w").alias("k")).agg(F.count_if(F.col("w").rlike(r"^\p{Lu}")).alias("cap"), F.count(F.lit(1)).alias("n"))


@query("a04_proper_ratio", with_tables("articles", also=PROPER) + "SELECT k, cap / n AS ratio FROM proper WHERE cap > 0")
def a04(spark, d):
    return proper(spark, d).filter("cap > 0").select("k", (F.col("cap") / F.col("n")).alias("ratio"))


ENTS = rf"""ents AS (SELECT DISTINCT id, lower(w) AS entity FROM (SELECT id, unnest(regexp_extract_all(title || ' ' || dek, '{W}')) AS w FROM articles) JOIN proper ON k = lower(w) WHERE regexp_matches(w, '^\p{{Lu}}') AND length(w) >= 2 AND cap / n >= 0.8 AND lower(w) NOT IN ({STOP}))"""


def entities(spark, d):
    a = articles(spark, d)
    w = a.select("id", F.explode(F.regexp_extract_all(F.concat("title", F.lit(" "), "dek"), F.lit(f"({T.WORD})"))).alias("w"))
    keep = w.filter(F.col("w").rlike(r"^\p{Lu}") & (F.length("w") >= 2) & ~F.lower("w").isin(T.STOPWORDS)).select("id", F.lower("w").alias("entity")).distinct()
    return keep.join(proper(spark, d).filter("cap / n >= 0.8").withColumnRenamed("k", "entity"), "entity").select("id", "entity")


@query("f14b_item_entities", with_tables("articles", also=PROPER + ", " + ENTS) + "SELECT id, entity FROM ents")
def f14b(spark, d):
    return entities(spark, d)


KEYS = """ce AS (SELECT cluster_id, entity, count(*) AS c FROM members JOIN ents ON id = article_id GROUP BY ALL),
  cn AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY cluster_id), ed AS (SELECT entity, count(*) AS df FROM ents GROUP BY entity),
  keys AS (SELECT cluster_id, entity FROM ce JOIN cn USING (cluster_id) JOIN ed USING (entity) WHERE c >= greatest(2, ceil(n / 2)) AND df <= greatest(0.08 * (SELECT count(*) FROM articles), 12))"""


def key_entities(spark, d):
    m, e = members(spark, d), entities(spark, d)
    n_items = articles(spark, d).count()
    ce = m.join(e, F.col("article_id") == F.col("id")).groupBy("cluster_id", "entity").agg(F.count(F.lit(1)).alias("c"))
    n = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    df = e.groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    return ce.join(n, "cluster_id").join(df, "entity").filter((F.col("c") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))) & (F.col("df") <= max(0.08 * n_items, 12))).select("cluster_id", "entity")


@query("a08_key_entities", with_tables("articles", "members", also=", ".join((PROPER, ENTS, KEYS))) + "SELECT cluster_id, entity FROM keys")
def a08(spark, d):
    return key_entities(spark, d)


@query("o04_events")
def o04(spark, d):
    """Greedy, so held against a single-group run in the tests."""
    ship(spark)
    keys = key_entities(spark, d).select(F.col("cluster_id").cast("long"), "entity")
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).groupBy(F.col("cluster_id").cast("long").alias("cluster_id")).agg(F.max("published_s").alias("newest_s"), F.count(F.lit(1)).alias("n"))
    return S.greedy_events(keys, m)


@query("a13_b_cubed", """WITH l AS (SELECT vec_id % 40 AS story, label AS gold FROM embeddings), b AS (SELECT story, gold, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT story, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT gold, count(*) AS n FROM l GROUP BY ALL),
  x AS (SELECT sum(b.n * b.n / s.n) / sum(b.n) AS p, sum(b.n * b.n / g.n) / sum(b.n) AS r, sum(b.n * (b.n - 1) / 2) AS tp FROM b JOIN s USING (story) JOIN g USING (gold))
  SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round(tp / (SELECT sum(n * (n - 1) / 2) FROM s), 9) AS pair_precision, round(tp / (SELECT sum(n * (n - 1) / 2) FROM g), 9) AS pair_recall,
  round((SELECT sum(m) FROM (SELECT max(n) AS m FROM b GROUP BY story)) / (SELECT count(*) FROM l), 9) AS purity FROM x""")
def a13(spark, d):
    return S.b_cubed(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 40).alias("story"), F.col("label").alias("gold")))


@query("a14_split_stories", "WITH b AS (SELECT label AS gold, vec_id % 7 AS story, count(*) AS n FROM embeddings GROUP BY ALL) SELECT gold, arg_max(story, n * 100 - story) AS home, sum(n)::BIGINT - max(n) AS outside FROM b GROUP BY gold")
def a14(spark, d):
    b = read(spark, d, "embeddings").groupBy(F.col("label").alias("gold"), (F.col("vec_id") % 7).alias("story")).agg(F.count(F.lit(1)).alias("n"))
    return b.groupBy("gold").agg(F.max_by("story", F.col("n") * 100 - F.col("story")).alias("home"), (F.sum("n") - F.max("n")).alias("outside"))


@query("a06_independent_leans", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, independent, coalesce(leans, []) AS leans FROM facts")
def a06(spark, d):
    return facts(spark, d).select("cluster_id", "independent", "leans")


@query("a07_folded_outlets", with_tables("articles", "members") + "SELECT cluster_id, count(DISTINCT CASE WHEN c > 1 THEN 'u' || unit_id ELSE source_id END) AS outlets FROM (SELECT *, count(*) OVER (PARTITION BY unit_id) AS c FROM members JOIN articles ON article_id = id) GROUP BY cluster_id")
def a07(spark, d):
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))
    c = m.groupBy("unit_id").agg(F.count(F.lit(1)).alias("c"))
    unit = F.when(F.col("c") > 1, F.concat(F.lit("u"), F.col("unit_id").cast("string"))).otherwise(F.col("source_id"))
    return m.join(c, "unit_id").groupBy("cluster_id").agg(F.countDistinct(unit).alias("outlets"))


@query("a09_hype", with_tables("articles", "sources", "members") + "SELECT cluster_id % 20 AS event_id, count(DISTINCT CASE WHEN published_s >= 1767398400 THEN cluster_id END) * count(DISTINCT CASE WHEN published_s >= 1767398400 THEN syndication_group END) AS hype FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) GROUP BY ALL")
def a09(spark, d):
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id")
    recent = F.col("published_s") >= 1_767_398_400
    return m.groupBy((F.col("cluster_id") % 20).alias("event_id")).agg((F.countDistinct(F.when(recent, F.col("cluster_id"))) * F.countDistinct(F.when(recent, F.col("syndication_group")))).alias("hype"))


@query("a10_event_label", with_tables("articles", "members", also=rf"""p AS (SELECT cluster_id % 20 AS event_id, unnest({BIG.format('w')}) AS phrase FROM (SELECT article_id, regexp_extract_all(lower(title), '{W}') AS w FROM members JOIN articles ON article_id = id) JOIN members USING (article_id)), c AS (SELECT event_id, phrase, count(*) AS n FROM p GROUP BY ALL)""") + "SELECT event_id, phrase AS label FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, length(phrase) DESC, phrase DESC) AS r FROM c) WHERE r = 1")
def a10(spark, d):
    from quillmesh.operators.items import first_by

    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))
    p = m.select((F.col("cluster_id") % 20).alias("event_id"), F.explode(T.bigrams(F.regexp_extract_all(F.lower("title"), F.lit(f"({T.WORD})")))).alias("phrase"))
    c = p.groupBy("event_id", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return first_by(c, ["event_id"], F.desc("n"), F.desc(F.length("phrase")), F.desc("phrase")).select("event_id", F.col("phrase").alias("label"))


@query("a11_story_countries", with_tables("articles", "sources", "members", also="o AS (SELECT DISTINCT cluster_id, source_id, bucket FROM members JOIN articles ON article_id = id JOIN sources USING (source_id)), t AS (SELECT cluster_id, count(*) AS outlets FROM o GROUP BY ALL), c AS (SELECT cluster_id, bucket, count(*) AS n FROM o GROUP BY ALL)") + "SELECT cluster_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, bucket) AS r FROM c JOIN t USING (cluster_id) WHERE 2 * n >= outlets) WHERE r <= 2")
def a11(spark, d):
    from pyspark.sql import Window

    o = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id").select("cluster_id", "source_id", "bucket").distinct()
    t, c = o.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("outlets")), o.groupBy("cluster_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "bucket"))
    return c.join(t, "cluster_id").filter("2 * n >= outlets").withColumn("r", r).filter("r <= 2").select("cluster_id", "bucket")


@query("a36_headline_words", with_tables("articles", "members", also=f"w AS (SELECT DISTINCT cluster_id, id, unnest({content_sql('title', '')}) AS word FROM members JOIN articles ON article_id = id), n AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY ALL)") + "SELECT cluster_id, word FROM w JOIN n USING (cluster_id) GROUP BY cluster_id, word, n HAVING count(*) >= n / 2")
def a36(spark, d):
    m = members(spark, d)
    w = m.join(articles(spark, d), F.col("article_id") == F.col("id")).select("cluster_id", "id", F.explode(F.array_distinct(F.transform(T.content_words(F.col("title")), T.plural_fold))).alias("word"))
    n = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("cluster_id", "word").agg(F.count(F.lit(1)).alias("c")).join(n, "cluster_id").filter("c >= n / 2").select("cluster_id", "word")
