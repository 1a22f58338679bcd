"""Queries of retrieval, archetypes, stores, generation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..complete import Retry, Stub, answered, instruction
from ..functions import text as tx
from ..functions.fixture import Fixture
from ..operators import cluster as cu
from ..operators import measure as ms
from ..operators import retrieve as rt
from ..operators import sequence as sq
from ..sources import store as st
from ..sources.shared import kept
from ..streaming import windows as sw
from .made import FOLD_SENTS
from .registry import PARAS, SENTS, list_sql, over, query, table, tokens_sql, words_sql
from .texts import STYLE

DIM = 64
E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
CENTRES = f"e AS (SELECT vec_id, label, {E} AS v FROM embeddings), c AS (SELECT label, count(*) AS n, [{', '.join(f'avg(v[{i + 1}])' for i in range(DIM))}] AS c FROM e GROUP BY label)"
DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - {c}[i]) * (e.v[i] - {c}[i]))))"


@query(f"WITH {CENTRES}, d AS (SELECT e.vec_id, c.label AS cluster, {DIST.format(c='c.c')} AS d FROM e, c) SELECT vec_id, cluster, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM d) WHERE r = 1")
def assign_fixed_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest centre, the centres being the labels' means."""
    rows = table(spark, sf_dir, "embeddings")
    centres = cu.held(cu.centroids(rows, "label", "embedding", DIM), "label")
    return rows.select("vec_id", cu.nearest(F.col("embedding"), centres).alias("n")).select("vec_id", F.col("n.key").alias("cluster"), F.round("n.distance", 6).alias("distance"))


@query(f"WITH {CENTRES}, d AS (SELECT e.label, e.vec_id, round({DIST.format(c='c.c')}, 9) AS d FROM e JOIN c ON e.label = c.label) SELECT label, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r FROM d) WHERE r = 1")
def medoid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.medoids(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", DIM)


@query(f"WITH {CENTRES}, b AS (SELECT list_transform(range(1, 65), lambda i: a.c[i] * 0.5::DOUBLE + z.c[i] * 0.5::DOUBLE) AS m FROM c a, c z WHERE a.label = 0 AND z.label = 1) SELECT vec_id, round({DIST.format(c='b.m')}, 6) AS distance FROM e, b ORDER BY round({DIST.format(c='b.m')}, 9), vec_id LIMIT 5")
def blend_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest halfway between two groups' centres."""
    rows = table(spark, sf_dir, "embeddings")
    c = dict(cu.held(cu.centroids(rows.where("label in (0, 1)"), "label", "embedding", DIM), "label"))
    middle = [a * 0.5 + z * 0.5 for a, z in zip(c[0], c[1], strict=True)]
    far = rows.select("vec_id", cu.distance(F.col("embedding"), F.lit(middle)).alias("d"))
    return far.orderBy(F.round("d", 9), "vec_id").limit(5).select("vec_id", F.round("d", 6).alias("distance"))


NEAR = f"q AS (SELECT {E} AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, round(list_cosine_similarity({E}, q), 6) AS similarity FROM embeddings, q)"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query(f"WITH {NEAR} SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 8")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette of a query: its eight nearest fragments."""
    return cu.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", first_vector(spark, sf_dir), 8)


@query(f"WITH {NEAR} SELECT vec_id, similarity FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, vec_id LIMIT 2")
def situation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", first_vector(spark, sf_dir), 2, 0.3)


LABELS = """n AS (SELECT vec_id // 50 AS author_id, label AS src, lead(label) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS tgt FROM embeddings), t AS (SELECT author_id, src, tgt, count(*) AS n FROM n WHERE tgt IS NOT NULL GROUP BY author_id, src, tgt),
tr AS (SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY author_id, src), 8) AS p FROM t)"""


def label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("author_id", F.floor(F.col("vec_id") / 50).cast("long"))
    return sq.transitions(rows, ["author_id"], ["vec_id"], "label", "author_id")


@query(f"WITH {LABELS} SELECT author_id, src, tgt, n, p FROM tr")
def archetype_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_transitions(spark, sf_dir)


@query(f"WITH {LABELS} SELECT author_id, src, tgt AS next_archetype FROM (SELECT *, row_number() OVER (PARTITION BY author_id, src ORDER BY p DESC, tgt) AS r FROM tr) WHERE r = 1")
def next_archetype_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = label_transitions(spark, sf_dir).groupBy("author_id", "src").agg(F.min(F.struct((-F.col("p")).alias("q"), "tgt")).alias("b"))
    return best.select("author_id", "src", F.col("b.tgt").alias("next_archetype"))


SHAPES = f"""{SENTS}, shapes AS (SELECT source, doc_id, para_idx, count(*) AS n_sents, avg(CAST(len({tokens_sql("sentence")}) AS DOUBLE)) AS avg_len, stddev_pop(CAST(len({tokens_sql("sentence")}) AS DOUBLE)) AS sd FROM sents GROUP BY source, doc_id, para_idx),
marked AS (SELECT *, CASE WHEN n_sents <= 2 THEN 0 WHEN n_sents <= 4 THEN 1 ELSE 2 END AS archetype_id FROM shapes)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph features from each paragraph's own array, and a coarse archetype by number of sentences."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).withColumn("n", F.transform(tx.sentences(F.col("paragraph")), lambda x: F.size(tx.tokens(x)).cast("double"))).where(F.size("n") > 0)
    size = F.size("n")
    mean = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / size
    sd = F.sqrt(tx.let(mean, lambda m: F.aggregate("n", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / size))
    out = rows.select("source", "doc_id", "para_idx", size.cast("long").alias("n_sents"), mean.alias("avg_len"), sd.alias("sd"))
    return out.withColumn("archetype_id", F.when(F.col("n_sents") <= 2, 0).when(F.col("n_sents") <= 4, 1).otherwise(2))


@query(f"WITH {SHAPES} SELECT doc_id, para_idx, n_sents, round(avg_len, 6) AS avg_len, round(CASE WHEN avg_len > 0 THEN sd / avg_len ELSE 0.0 END, 6) AS burstiness FROM marked")
def paragraph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("doc_id", "para_idx", "n_sents", F.round("avg_len", 6).alias("avg_len"), F.round(F.when(F.col("avg_len") > 0, F.col("sd") / F.col("avg_len")).otherwise(0.0), 6).alias("burstiness"))


@query(f"WITH {SHAPES} SELECT archetype_id, count(*) AS n, round(avg(n_sents), 6) AS avg_sents, round(avg(avg_len), 6) AS mean_len, CASE WHEN avg(CASE WHEN avg_len > 0 THEN sd / avg_len ELSE 0.0 END) > 0.6 THEN 'High' ELSE 'Low' END AS burstiness FROM marked GROUP BY archetype_id UNION ALL SELECT -1, count(*), round(avg(n_sents), 6), round(avg(avg_len), 6), CASE WHEN avg(CASE WHEN avg_len > 0 THEN sd / avg_len ELSE 0.0 END) > 0.6 THEN 'High' ELSE 'Low' END FROM marked")
def archetype_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archetype's means and, as -1, those of all paragraphs: one rollup."""
    cv = F.when(F.col("avg_len") > 0, F.col("sd") / F.col("avg_len")).otherwise(0.0)
    out = shapes(spark, sf_dir).rollup("archetype_id").agg(F.count("*").alias("n"), F.round(F.avg("n_sents"), 6).alias("avg_sents"), F.round(F.avg("avg_len"), 6).alias("mean_len"), F.when(F.avg(cv) > 0.6, "High").otherwise("Low").alias("burstiness"))
    return out.withColumn("archetype_id", F.coalesce("archetype_id", F.lit(-1)))


@query(f"WITH {SHAPES}, a AS (SELECT source, archetype_id, avg(n_sents) AS s FROM marked GROUP BY source, archetype_id) SELECT source, archetype_id, round(abs(s - 4), 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(abs(s - 4), 9), archetype_id) AS r FROM a) WHERE r = 1 AND abs(s - 4) <= 3")
def style_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's archetype whose number of sentences comes nearest four, within three."""
    a = shapes(spark, sf_dir).groupBy("source", "archetype_id").agg(F.avg("n_sents").alias("s"))
    best = a.groupBy("source").agg(F.min(F.struct(F.round(F.abs(F.col("s") - 4), 9).alias("g"), "archetype_id")).alias("b")).where("b.g <= 3")
    return best.select("source", "b.archetype_id", F.round("b.g", 6).alias("gap"))


@query(
    f"""WITH {PARAS}, r AS (SELECT source, doc_id, para_idx, CAST(len({words_sql("paragraph")}) AS DOUBLE) / 40.0 AS r FROM paras), s AS (SELECT *, exp(-0.5 * pow((r - 1.1) / 0.2, 2)) AS s FROM r WHERE r BETWEEN 0.6 AND 2.0)
SELECT source, doc_id, para_idx, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(s, 9) DESC, doc_id, para_idx) AS k FROM s) WHERE k = 1"""
)
def structure_match_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's paragraph whose length suits an input of forty words best."""
    ratio = F.size(tx.words(F.col("paragraph"))) / 40.0
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).select("source", "doc_id", "para_idx", ratio.alias("r")).where("r between 0.6 and 2.0")
    return rt.best_by(rows, "source", F.round(rt.length_score(F.col("r")), 9), "doc_id", "para_idx")


TIER = f"""t AS (SELECT source, doc_id, len({tokens_sql("text")}) AS n, lang, CASE WHEN lang = 'de' AND len({tokens_sql("text")}) BETWEEN 70 AND 130 THEN 1 WHEN len({tokens_sql("text")}) BETWEEN 70 AND 130 THEN 2 WHEN lang = 'de' THEN 3 END AS tier FROM documents)"""


@query(f"WITH {TIER}, m AS (SELECT source, min(tier) AS m FROM t GROUP BY source) SELECT t.source, doc_id, tier, CAST(row_number() OVER (PARTITION BY t.source ORDER BY doc_id) AS INTEGER) AS rank FROM t JOIN m ON t.source = m.source AND tier = m QUALIFY rank <= 3")
def tiered_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's examples from the first tier that has any: kind and length, length alone, kind alone."""
    n = F.size(tx.tokens(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", n.alias("n"))
    tier = F.when((F.col("lang") == "de") & F.col("n").between(70, 130), 1).when(F.col("n").between(70, 130), 2).when(F.col("lang") == "de", 3)
    return rt.first_tier(rows, "source", tier, 3, "doc_id").select("source", "doc_id", "tier", "rank")


VOCAB = f"""v AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest({tokens_sql("text")}) AS word FROM documents WHERE source IN ('src1', 'src2')) GROUP BY source, word),
r AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM v)"""


@query(f"WITH {VOCAB} SELECT source, word, CAST(r AS INTEGER) AS rank FROM r WHERE (source = 'src2' AND r <= 3) OR (source = 'src1' AND r <= 7)")
def hybrid_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten words, three tenths from the second author, by frequency."""
    words = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select("source", F.explode(tx.tokens(F.col("text"))).alias("word"))
    top = ms.top_words(words, "source", "word", 7)
    return top.where((F.col("source") == "src1") | (F.col("rank") <= 3)).select("source", "word", "rank")


@query(f"SELECT source, count(*) AS documents, count(DISTINCT lang) AS languages, CAST(sum(len({words_sql('text')})) AS BIGINT) AS words, round(avg(len({words_sql('text')})), 4) AS mean_words, CAST(count(*) FILTER (text IS NULL) AS BIGINT) AS without_text FROM documents GROUP BY source")
def author_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.inventory(table(spark, sf_dir, "documents"), F.size(tx.words(F.col("text"))))


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field, unnest([count(doc_id), count(text), count(lang), count(source), count(n_chars)]) AS present, count(*) AS rows FROM documents")
def metadata_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.presence(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END, length(text)) AS text_length FROM documents")
def length_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths where they are missing (here: every third)."""
    given = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(given, F.length("text").cast("long")).alias("text_length"))


NAMES = Fixture("names", "asked string", [("Ann Bee",), ("ann bee",), ("CARL",), ("Nobody",)])
PROFILES = Fixture("profiles", "name string, dna string", [("Ann Bee", "terse"), ("Carl", "ornate"), ("carl", "plain")])


LOOKED = """l AS (SELECT lower(name) AS low, min(struct_pack(name := name, dna := dna)) AS any_ FROM profiles GROUP BY lower(name))
SELECT asked, coalesce(p.dna, l.any_.dna, '') AS dna, p.dna IS NOT NULL OR l.any_ IS NOT NULL AS known FROM names LEFT JOIN profiles p ON asked = p.name LEFT JOIN l ON lower(asked) = low"""


@query(f"WITH {NAMES.cte()}, {PROFILES.cte()}, {LOOKED}")
def style_registry_lookup_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.lookup(NAMES.df(spark), PROFILES.df(spark))


@query(f"WITH names AS (SELECT CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE 'nobody' || doc_id END AS asked FROM documents), profiles AS (SELECT source AS name, 'author of ' || count(*) AS dna FROM documents WHERE source IS NOT NULL GROUP BY source), {LOOKED}")
def style_registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each document's author, asked by name, by another case of it, or by a name that is not there."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(F.expr("CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE 'nobody' || doc_id END").alias("asked"))
    profiles = docs.where("source is not null").groupBy(F.col("source").alias("name")).agg(F.concat(F.lit("author of "), F.count("*").cast("string")).alias("dna"))
    return rt.lookup(asked, profiles)


FOLD = Fixture("skeletons", "id int, pos int, skeleton string", [(1, 1, "a b c d"), (1, 2, "a b c d"), (1, 3, "x y z"), (1, 4, "d c b a"), (2, 1, "q r")])


def jaccard_sql(x: str, y: str) -> str:
    a, b = (f"list_distinct({words_sql(z)})" for z in (x, y))
    both = f"len(list_intersect({a}, {b}))"
    return f"CAST({both} AS DOUBLE) / greatest(len({a}) + len({b}) - {both}, 1)"


@over(
    FOLD,
    FOLD_SENTS,
    f""", l AS (SELECT id, list(skeleton ORDER BY pos) AS l FROM skeletons GROUP BY id)
SELECT id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: {jaccard_sql("y", "x[1]")} > 0.9)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM l""",
)
def greedy_dedup(rows: DataFrame) -> DataFrame:
    """Skeletons in order, without those whose words are those of one kept before (Jaccard above 0.9)."""
    from ..functions import compare as cp

    rows = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "skeleton"))).alias("s"))
    step = lambda a, x: F.when(F.exists(a, lambda y: cp.jaccard(x, y) > 0.9), a).otherwise(F.concat(a, F.array(x)))
    return rows.select("id", F.aggregate(F.col("s.skeleton"), F.array().cast("array<string>"), step).alias("kept"))


ARCHETYPES, ROUNDS = 8, 4


def _kmeans_sql() -> str:
    """Seeds and rounds one after the other: c0 to c7 are seeds, r0 to r4 the centres of each round."""
    dims = ms.DIMENSIONS
    far = "round(sqrt(list_sum(list_transform(range(1, {n} + 1), lambda i: (x[i] - {c}[i]) * (x[i] - {c}[i])))), {d})"
    apart = lambda c, d: far.format(n=len(dims), c=c, d=d)
    out = [STYLE, f"stats AS (SELECT {', '.join(f'avg({x}) AS m{i}, stddev_pop({x}) AS s{i}' for i, x in enumerate(dims))} FROM style)"]
    out.append("v AS MATERIALIZED (SELECT doc_id, [" + ", ".join(f"CASE WHEN s{i} > 0 THEN round(({x} - m{i}) / s{i}, 6) ELSE 0.0::DOUBLE END" for i, x in enumerate(dims)) + "] AS x FROM style, stats)")
    out.append("c0 AS MATERIALIZED (SELECT 0 AS k, x AS c FROM v ORDER BY doc_id LIMIT 1)")
    for k in range(1, ARCHETYPES):
        out.append(f"c{k} AS MATERIALIZED (SELECT * FROM c{k - 1} UNION ALL (SELECT {k}, x FROM (SELECT doc_id, any_value(x) AS x, min({apart('c', 6)}) AS d FROM v, c{k - 1} GROUP BY doc_id) WHERE d > 0 ORDER BY d DESC, doc_id LIMIT 1))")
    last = f"c{ARCHETYPES - 1}"
    for r in range(ROUNDS):
        out.append(f"a{r} AS MATERIALIZED (SELECT doc_id, any_value(x) AS x, min(struct_pack(d := {apart('c', 9)}, k := k)).k AS k FROM v, {last} GROUP BY doc_id)")
        out.append(f"r{r} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM {last} o LEFT JOIN (SELECT k, [{', '.join(f'round(avg(x[{i + 1}]), 6)' for i in range(len(dims)))}] AS c FROM a{r} GROUP BY k) n USING (k))")
        last = f"r{r}"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, CAST(min(struct_pack(d := {apart('c', 9)}, k := k)).k AS INTEGER) AS archetype_id FROM v, {last} GROUP BY doc_id"


@query(_kmeans_sql())
def kmeans_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetypes of documents by their standardised style vectors: seeds far apart, then a fixed number of rounds."""
    rows = kept(ms.style_vectors(table(spark, sf_dir, "documents"), "doc_id"), "style")
    vectors = kept(cu.standardised(rows, ms.DIMENSIONS, "doc_id"), "features")
    centres, _ = cu.lloyd(vectors, "doc_id", "features", cu.farthest_first(vectors, "doc_id", "features", ARCHETYPES), ROUNDS)
    if not centres:
        return vectors.select("doc_id", F.lit(None).cast("int").alias("archetype_id"))
    return vectors.select("doc_id", cu.nearest(F.col("features"), centres, 9)["key"].alias("archetype_id"))


def asked(spark: SparkSession, sf_dir: str, kind: str, **values: object) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.lit(instruction(kind, **values)).alias("system"), F.col("text").alias("user"))
    return answered(rows, lambda: Retry(Stub())).select("item_id", "response")


@query(rf"""SELECT item_id, array_to_string(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:2], ' ') AS response FROM benchmark""")
def neutral_summary_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, "summary", perspective="third person")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.hourly(table(spark, sf_dir, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.sessions(table(spark, sf_dir, "events"))
