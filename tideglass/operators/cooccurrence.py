"""Co-occurrence of techniques within episodes, actor profiles and bundles."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.scratch import written
from tideglass.functions.sqlop import Op

# One exchange brings the techniques of an episode together as an ordered array, which is no longer than there are
# techniques; pairs come from the array, so no rows are joined, and their counts are combined before they are shuffled.
# Supports come from the same arrays. NPMI of a pair that is in every episode is NULL.
# Equal arrays count once, with a weight.
_SETS = "sets AS (SELECT ts, count(*) AS w FROM (SELECT array_sort(collect_set(technique)) AS ts FROM {et} GROUP BY episode) AS e WHERE size(ts) >= :min_episode_size GROUP BY ts)"
_PAIRS = """
firsts AS (SELECT ts, w, i, a FROM sets LATERAL VIEW posexplode(ts) AS i, a),
pairs AS (SELECT a, b, sum(w) AS n FROM firsts LATERAL VIEW explode(slice(ts, i + 2, size(ts))) AS b GROUP BY a, b),
support AS (SELECT technique, sum(w) AS s FROM sets LATERAL VIEW explode(ts) AS technique GROUP BY technique),
total AS (SELECT CAST(coalesce(sum(w), 0) AS DOUBLE) AS n_all FROM sets)"""
_COUNTED = "counted AS (SELECT pairs.a, pairs.b, n, sa.s AS s_a, sb.s AS s_b, n_all FROM pairs JOIN support AS sa ON pairs.a = sa.technique JOIN support AS sb ON pairs.b = sb.technique CROSS JOIN total)"
_METRICS = """SELECT a AS technique_a, b AS technique_b, CAST(n AS BIGINT) AS n_both, CAST(s_a AS BIGINT) AS support_a, CAST(s_b AS BIGINT) AS support_b,
  round(CAST(n AS DOUBLE) / s_a, 6) AS confidence_a_b, round(CAST(n AS DOUBLE) / s_b, 6) AS confidence_b_a,
  round(n * n_all / (CAST(s_a AS DOUBLE) * s_b), 6) AS lift,
  round(log2(n * n_all / (CAST(s_a AS DOUBLE) * s_b)), 6) AS pmi,
  round(log2(n * n_all / (CAST(s_a AS DOUBLE) * s_b)) / nullif(-log2(n / n_all), 0), 6) AS npmi,
  round(CAST(n AS DOUBLE) / (s_a + s_b - n), 6) AS jaccard
FROM counted WHERE n >= :min_pair AND s_a >= :min_support AND s_b >= :min_support"""
_GLOBAL = f"WITH {_SETS}, {_PAIRS}, {_COUNTED} {_METRICS}"

# For the check: pairs as a self-join of episodes, probabilities instead of counts.
_CHECK_PAIRS = """eps AS (SELECT DISTINCT episode, technique FROM {et} WHERE episode IN (SELECT episode FROM {et} GROUP BY episode HAVING count(DISTINCT technique) >= :min_episode_size)),
pairs AS (SELECT a.technique AS a, b.technique AS b, count(*) AS n FROM eps AS a JOIN eps AS b ON a.episode = b.episode AND a.technique < b.technique GROUP BY a.technique, b.technique),
total AS (SELECT CAST(count(DISTINCT episode) AS DOUBLE) AS n_all FROM eps),
support AS (SELECT technique, count(*) AS s FROM eps GROUP BY technique),
p AS (SELECT a, b, n, x.s AS s_a, y.s AS s_b, n / n_all AS p_ab, x.s / n_all AS p_a, y.s / n_all AS p_b FROM pairs JOIN support AS x ON x.technique = a JOIN support AS y ON y.technique = b, total)"""
_CHECK_GLOBAL = f"""WITH {_CHECK_PAIRS}
SELECT a AS technique_a, b AS technique_b, n::BIGINT AS n_both, s_a::BIGINT AS support_a, s_b::BIGINT AS support_b, round(p_ab / p_a, 6) AS confidence_a_b, round(p_ab / p_b, 6) AS confidence_b_a,
  round(p_ab / (p_a * p_b), 6) AS lift, round(log2(p_ab / (p_a * p_b)), 6) AS pmi, round(CASE WHEN p_ab < 1 THEN log2(p_ab / (p_a * p_b)) / -log2(p_ab) END, 6) AS npmi, round(p_ab / (p_a + p_b - p_ab), 6) AS jaccard
FROM p WHERE n >= :min_pair AND least(s_a, s_b) >= :min_support"""

_TOP = """WITH g AS ({metrics}), best AS (SELECT * FROM g ORDER BY npmi DESC, technique_a, technique_b LIMIT :top), n AS (SELECT count(DISTINCT t) AS technique_count FROM (SELECT technique_a AS t FROM best UNION ALL SELECT technique_b FROM best) AS u)
SELECT x.name AS name_a, y.name AS name_b, n_both, round(confidence_a_b, 3) AS confidence, round(lift, 2) AS lift, round(npmi, 3) AS npmi, CAST(technique_count AS BIGINT) AS technique_count FROM best JOIN {{technique_names}} AS x ON technique_a = x.technique JOIN {{technique_names}} AS y ON technique_b = y.technique CROSS JOIN n"""

# Smoothed metrics for each actor: half a count is added to counts, one to totals.
_ACTOR = """
sets AS (SELECT actor, episode, array_sort(collect_set(technique)) AS ts FROM {eta} GROUP BY actor, episode HAVING count(DISTINCT technique) >= 2),
firsts AS (SELECT actor, ts, i, a FROM sets LATERAL VIEW posexplode(ts) AS i, a),
pairs AS (SELECT actor, a, b, CAST(count(*) AS DOUBLE) AS n FROM firsts LATERAL VIEW explode(slice(ts, i + 2, size(ts))) AS b GROUP BY actor, a, b),
support AS (SELECT actor, technique, CAST(count(*) AS DOUBLE) AS s FROM sets LATERAL VIEW explode(ts) AS technique GROUP BY actor, technique),
total AS (SELECT actor, CAST(count(*) AS DOUBLE) AS n_all FROM sets GROUP BY actor),
counted AS (SELECT pairs.actor, pairs.a, pairs.b, n, sa.s AS s_a, sb.s AS s_b, n_all, (n + 0.5) / (n_all + 1) AS p_ab, (sa.s + 0.5) / (n_all + 1) AS p_a, (sb.s + 0.5) / (n_all + 1) AS p_b
  FROM pairs JOIN support AS sa ON pairs.actor = sa.actor AND pairs.a = sa.technique JOIN support AS sb ON pairs.actor = sb.actor AND pairs.b = sb.technique JOIN total ON pairs.actor = total.actor),
metrics AS (SELECT actor, a, b, n, s_a, s_b, (n + 0.5) / (s_a + 1) AS conf_ab, (n + 0.5) / (s_b + 1) AS conf_ba, (n + 0.5) / ((s_a + 1) * (s_b + 1) / (n_all + 2)) AS lift, log2(p_ab / (p_a * p_b)) AS pmi, log2(p_ab / (p_a * p_b)) / -log2(p_ab) AS npmi, n / (s_a + s_b - n) AS jaccard
  FROM counted WHERE s_a >= :min_support AND s_b >= :min_support)"""
_CHECK_ACTOR = """
eps AS (SELECT DISTINCT actor, episode, technique FROM {eta} WHERE (actor, episode) IN (SELECT (actor, episode) FROM {eta} GROUP BY actor, episode HAVING count(DISTINCT technique) > 1)),
n AS (SELECT actor, count(DISTINCT episode) AS n FROM eps GROUP BY actor),
c AS (SELECT x.actor, x.technique AS a, y.technique AS b, count(*) AS ab, any_value(n.n) AS n, (SELECT count(*) FROM eps AS e WHERE e.actor = x.actor AND e.technique = x.technique) AS sa, (SELECT count(*) FROM eps AS e WHERE e.actor = y.actor AND e.technique = y.technique) AS sb
  FROM eps AS x JOIN eps AS y USING (actor, episode) JOIN n USING (actor) WHERE x.technique < y.technique GROUP BY x.actor, y.actor, x.technique, y.technique),
metrics AS (SELECT actor, a, b, ab AS n, (ab + 0.5::DOUBLE) / (sa + 1) AS conf_ab, (ab + 0.5::DOUBLE) / (sb + 1) AS conf_ba, (ab + 0.5::DOUBLE) * (n + 2) / ((sa + 1) * (sb + 1)) AS lift,
  ln((ab + 0.5::DOUBLE) * (n + 1) / ((sa + 0.5) * (sb + 0.5))) / ln(2::DOUBLE) AS pmi, ln((ab + 0.5::DOUBLE) * (n + 1) / ((sa + 0.5) * (sb + 0.5))) / ln((n + 1) / (ab + 0.5::DOUBLE)) AS npmi, ab::DOUBLE / (sa + sb - ab) AS jaccard
  FROM c WHERE least(sa, sb) >= :min_support)"""


def bundles(et: DataFrame, min_size: int = 3, max_size: int = 5, min_support: int = 2) -> DataFrame:
    """Frequent sets of min_size to max_size techniques: size, techniques (ordered), support, confidence (against the
    rarest member), lift, and lift_reference, which divides by the episode count twice. Episodes of fewer than min_size
    techniques don't count, but for the supports of single techniques.

    Equal arrays of episodes count once, with a weight, and are written: every level starts from them. Sets grow from
    an ordered array one member at a time. All parts of a frequent set are frequent, so only sets whose part without the
    last member is frequent grow; counts are combined before they are shuffled.
    """
    support = et.select("episode", "technique").distinct().groupBy("technique").agg(F.count(F.lit(1)).cast("double").alias("s"))
    arrays = et.groupBy("episode").agg(F.array_sort(F.collect_set("technique")).alias("ts")).where(F.size("ts") >= min_size)
    arrays = written(arrays.groupBy("ts").agg(F.count(F.lit(1)).alias("w")), "episode-arrays")
    total = arrays.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("n"))
    rows = arrays.select("ts", "w", F.posexplode("ts").alias("at", "t")).select("ts", "w", "at", F.array("t").alias("members"))
    levels: list[DataFrame] = []
    for size in range(1, max_size + 1):
        if size > 1:
            rows = rows.select("members", "ts", "w", F.posexplode(F.slice("ts", F.col("at") + 2, F.size("ts"))).alias("step", "t"), F.col("at").alias("from"))
            rows = rows.select("ts", "w", (F.col("from") + F.col("step") + 1).alias("at"), F.concat("members", F.array("t")).alias("members"))
        counted = rows.groupBy("members").agg(F.sum("w").alias("support"))
        counted = written(counted.where(F.col("support") >= min_support), "bundles")
        if size >= min_size:
            levels.append(counted)
        if size < max_size:
            rows = rows.join(counted.select("members"), "members", "left_semi")
    if not levels:
        levels = [rows.limit(0).select("members", F.lit(0).cast("bigint").alias("support"))]
    found = reduce(DataFrame.unionByName, levels)
    # Supports of members come by a join, whatever the number of techniques.
    each = found.select("members", "support", F.explode("members").alias("technique")).join(support, "technique").crossJoin(F.broadcast(total))  # one row
    known = each.groupBy("members", "support").agg(F.min("s").alias("rarest"), F.product(F.col("s") / F.col("n")).alias("chance"), F.first("n").alias("n"))
    return known.select(
        F.size("members").cast("bigint").alias("size"),
        F.col("members").alias("techniques"),
        "support",
        (F.col("support") / F.col("rarest")).alias("confidence"),
        (F.col("support") / (F.col("n") * F.col("chance"))).alias("lift"),
        (F.col("support") / (F.col("n") * F.col("n") * F.col("chance"))).alias("lift_reference"),
    )


def bundle_report(et: DataFrame) -> DataFrame:
    return bundles(et).select("size", F.array_join("techniques", ", ").alias("techniques"), "support", *[F.round(c, d).alias(c) for c, d in (("confidence", 6), ("lift", 6), ("lift_reference", 9))])


def bundle_coverage(et: DataFrame, detects: DataFrame, top: int = 50, min_size: int = 3, max_size: int = 5, min_support: int = 2) -> DataFrame:
    """The `top` bundles by lift with the share of their techniques that some strategy detects."""
    best = bundles(et, min_size, max_size, min_support).withColumn("order", F.round("lift", 6)).orderBy(F.desc("order"), "techniques").limit(top)
    covered = detects.select("technique").distinct().agg(F.collect_list("technique").alias("covered"))  # one entry for each technique
    open_ = F.size(F.array_except("techniques", "covered"))
    found = best.crossJoin(F.broadcast(covered))
    return found.select("size", F.array_join("techniques", ", ").alias("techniques"), "support", F.col("order").alias("lift"), open_.cast("bigint").alias("gap_count"), F.round(100.0 * (F.col("size") - open_) / F.col("size"), 1).alias("coverage_pct"))


# For the check: joins of episodes for each size, without pruning.
_CHECK_SETS = """e AS (SELECT DISTINCT episode, technique AS t FROM et), big AS (SELECT episode, t, count(*) OVER (PARTITION BY episode) AS k FROM e), b AS (SELECT episode, t FROM big WHERE k >= 3),
s AS (SELECT t, count(*)::DOUBLE AS s FROM e GROUP BY t), n AS (SELECT count(DISTINCT episode)::DOUBLE AS n FROM b),
three AS (SELECT x.episode, [x.t, y.t, z.t] AS m FROM b AS x JOIN b AS y ON x.episode = y.episode AND x.t < y.t JOIN b AS z ON x.episode = z.episode AND y.t < z.t),
four AS (SELECT three.episode, list_append(m, t) AS m FROM three JOIN b ON b.episode = three.episode AND t > m[3]), five AS (SELECT four.episode, list_append(m, t) AS m FROM four JOIN b ON b.episode = four.episode AND t > m[4]),
c AS (SELECT m, count(*) AS support FROM (SELECT * FROM three UNION ALL SELECT * FROM four UNION ALL SELECT * FROM five) AS u GROUP BY m HAVING count(*) >= 2),
f AS (SELECT m, support, unnest(m) AS t FROM c), g AS (SELECT m, any_value(support) AS support, min(s) AS least, product(s / n) AS chance, any_value(n) AS n FROM f JOIN s USING (t), n GROUP BY m),
bundles AS (SELECT m, len(m)::BIGINT AS size, array_to_string(m, ', ') AS techniques, support, round(support / least, 6) AS confidence, round(support / (n * chance), 6) AS lift, round(support / (n * n * chance), 9) AS lift_reference FROM g)"""

# Of few techniques every actor uses every one and all weights vanish, so profiles take the sparse techniques.
_TFIDF = """
freq AS (SELECT actor, technique, CAST(count(DISTINCT episode) AS DOUBLE) AS f FROM {part_use} GROUP BY actor, technique),
sized AS (SELECT actor, technique, f, sum(f) OVER (PARTITION BY actor) AS total FROM freq),
df AS (SELECT technique, count(*) AS df FROM freq GROUP BY technique),
actors AS (SELECT CAST(count(DISTINCT actor) AS DOUBLE) AS n FROM freq),
weights AS (SELECT actor, sized.technique, f, total, f / total * ln(n / df) AS tfidf FROM sized JOIN df ON sized.technique = df.technique CROSS JOIN actors)"""
_SIMILAR = """
norms AS (SELECT actor, sqrt(sum(tfidf * tfidf)) AS norm FROM weights GROUP BY actor),
dots AS (SELECT a.actor AS a, b.actor AS b, sum(a.tfidf * b.tfidf) AS dot, CAST(count(*) AS BIGINT) AS shared FROM weights AS a JOIN weights AS b ON a.technique = b.technique AND a.actor < b.actor GROUP BY a.actor, b.actor),
similar_actors AS (SELECT a, b, shared, dot / (x.norm * y.norm) AS similarity FROM dots JOIN norms AS x ON a = x.actor JOIN norms AS y ON b = y.actor WHERE x.norm > 0 AND y.norm > 0 AND dot / (x.norm * y.norm) >= :min_similarity)"""

OPS = {
    "a01_global_cooccurrence": Op("Pair metrics over episodes with at least two techniques.", _GLOBAL, min_support=2, min_pair=2, min_episode_size=2).against(_CHECK_GLOBAL),
    "a02_actor_cooccurrence": Op(
        "Smoothed pair metrics within each actor's episodes.",
        f"WITH {_ACTOR} SELECT actor, a AS technique_a, b AS technique_b, CAST(n AS BIGINT) AS n_both, round(conf_ab, 6) AS confidence_a_b, round(conf_ba, 6) AS confidence_b_a, round(lift, 5) AS lift, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(jaccard, 6) AS jaccard FROM metrics",
        min_support=1,
    ).against(f"WITH {_CHECK_ACTOR} SELECT actor, a AS technique_a, b AS technique_b, n::BIGINT AS n_both, round(conf_ab, 6) AS confidence_a_b, round(conf_ba, 6) AS confidence_b_a, round(lift, 5) AS lift, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(jaccard, 6) AS jaccard FROM metrics"),
    "a04_actor_profiles": Op(
        "TF-IDF weights of techniques by actor; the ten heaviest above a threshold are the signature and have a rank.",
        f"WITH {_TFIDF}, ranked AS (SELECT actor, technique, f, total, tfidf, row_number() OVER (PARTITION BY actor ORDER BY round(tfidf, 9) DESC, technique) AS rn FROM weights) SELECT actor, technique, CAST(f AS BIGINT) AS frequency, CAST(total AS BIGINT) AS total_episodes, round(tfidf, 9) AS tfidf, CAST(CASE WHEN rn <= :top AND tfidf > :threshold THEN rn END AS BIGINT) AS signature_rank FROM ranked",
        threshold=0.01,
        top=10,
    ),
    "a04_dominant_tactics": Op(
        "Three tactics with the most distinct episodes and techniques by actor.",
        "SELECT actor, tactic, n_actions FROM (SELECT actor, tactic, n_actions, row_number() OVER (PARTITION BY actor ORDER BY n_actions DESC, tactic) AS rn FROM (SELECT actor, tactic, CAST(count(*) AS BIGINT) AS n_actions FROM {eta} AS e JOIN {technique_tactic} AS t ON e.technique = t.technique GROUP BY actor, tactic) AS c) AS r WHERE rn <= :top",
        top=3,
    ),
    "a05_actor_similarity": Op("Cosine of sparse TF-IDF profiles, by a join on shared techniques.", f"WITH {_TFIDF}, {_SIMILAR} SELECT a AS actor_a, b AS actor_b, shared AS shared_techniques, round(similarity, 6) AS similarity FROM similar_actors", min_similarity=0.3),
    "a06_bridging_techniques": Op("Techniques of many actors.", "SELECT technique, CAST(count(DISTINCT actor) AS BIGINT) AS n_actors, CAST(count(DISTINCT episode) AS BIGINT) AS n_episodes, round(CAST(count(DISTINCT episode) AS DOUBLE) / count(DISTINCT actor), 6) AS avg_importance FROM {eta} GROUP BY technique HAVING count(DISTINCT actor) >= :min_actors", min_actors=3),
    "a07_top_pairs": Op(
        "Most frequent pairs with names; with a tactic, a pair stays if either side has it.",
        f"""WITH {_SETS}, {_PAIRS} SELECT a AS technique_a, b AS technique_b, coalesce(x.name, a) AS name_a, coalesce(y.name, b) AS name_b, CAST(n AS BIGINT) AS n_both FROM pairs LEFT JOIN {{technique_names}} AS x ON a = x.technique LEFT JOIN {{technique_names}} AS y ON b = y.technique
        WHERE :tactic IS NULL OR a IN (SELECT technique FROM {{technique_tactic}} WHERE tactic = :tactic) OR b IN (SELECT technique FROM {{technique_tactic}} WHERE tactic = :tactic) ORDER BY n DESC, a, b LIMIT :top""",
        min_episode_size=2,
        tactic=None,
        top=25,
    ).against(f"WITH {_CHECK_PAIRS} SELECT a AS technique_a, b AS technique_b, (SELECT any_value(name) FROM {{technique_names}} WHERE technique = a) AS name_a, (SELECT any_value(name) FROM {{technique_names}} WHERE technique = b) AS name_b, n::BIGINT AS n_both FROM pairs ORDER BY n DESC, a, b LIMIT :top"),
    "a08_conditional": Op(
        "P(B | A) for one technique A.",
        "WITH has AS (SELECT DISTINCT episode FROM {et} WHERE technique = :technique), total AS (SELECT greatest(count(*), 1) AS n FROM has), co AS (SELECT technique, count(DISTINCT e.episode) AS co FROM {et} AS e JOIN has ON e.episode = has.episode WHERE technique <> :technique GROUP BY technique) SELECT technique, CAST(co AS BIGINT) AS n_both, round(CAST(co AS DOUBLE) / n, 4) AS probability FROM co CROSS JOIN total ORDER BY co DESC, technique LIMIT :top",
        technique="Brand#11",
        top=25,
    ),
    "a08_conditional_all": Op("P(B | A) for every ordered pair.", f"WITH {_SETS}, {_PAIRS}, both_ways AS (SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs) SELECT a AS given, b AS technique, CAST(n AS BIGINT) AS n_both, round(CAST(n AS DOUBLE) / s, 6) AS probability FROM both_ways JOIN support ON a = support.technique", min_episode_size=1).against(
        "SELECT x.technique AS given, y.technique AS technique, count(*)::BIGINT AS n_both, round(count(*) / (SELECT count(DISTINCT episode) FROM {et} AS e WHERE e.technique = x.technique)::DOUBLE, 6) AS probability FROM {et} AS x JOIN {et} AS y ON x.episode = y.episode AND x.technique <> y.technique GROUP BY x.technique, y.technique"
    ),
    "a09_actor_top_pairs": Op(
        "Twenty best pairs of each actor by a metric, with names and rounded metrics.",
        f"WITH {_ACTOR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY round(npmi, 9) DESC, a, b) AS rn FROM metrics) SELECT actor, x.name AS name_a, y.name AS name_b, CAST(n AS BIGINT) AS n_both, round(greatest(conf_ab, conf_ba), 3) AS confidence, round(lift, 2) AS lift, round(npmi, 3) AS npmi, CAST(rn AS BIGINT) AS position FROM ranked JOIN {{technique_names}} AS x ON a = x.technique JOIN {{technique_names}} AS y ON b = y.technique WHERE rn <= :top",
        min_support=1,
        top=20,
    ).against(
        f"WITH {_CHECK_ACTOR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY round(npmi, 9) DESC, a, b) AS rn FROM metrics) SELECT actor, concat('Technique ', a) AS name_a, concat('Technique ', b) AS name_b, n::BIGINT AS n_both, round(greatest(conf_ab, conf_ba), 3) AS confidence, round(lift, 2) AS lift, round(npmi, 3) AS npmi, rn::BIGINT AS position FROM ranked WHERE rn <= :top"
    ),
    "a11_actor_similarity_named": Op("Actor similarity as a percentage.", f"WITH {_TFIDF}, {_SIMILAR} SELECT a AS actor_a, b AS actor_b, round(similarity, 3) AS similarity, round(similarity * 100, 1) AS similarity_pct FROM similar_actors", min_similarity=0.0),
    "a12_bridging_detail": Op(
        "Bridging techniques with their tactics' number and first actors.",
        "WITH b AS (SELECT technique, count(DISTINCT actor) AS n_actors, count(DISTINCT episode) AS n_episodes, min(actor) AS first_actor, max(actor) AS last_actor FROM {eta} GROUP BY technique HAVING count(DISTINCT actor) >= :min_actors), t AS (SELECT technique, count(*) AS n_tactics FROM {technique_tactic} GROUP BY technique) SELECT b.technique, CAST(n_actors AS BIGINT) AS n_actors, CAST(n_episodes AS BIGINT) AS n_episodes, round(CAST(n_episodes AS DOUBLE) / n_actors, 2) AS avg_importance, CAST(n_tactics AS BIGINT) AS n_tactics, first_actor, last_actor FROM b LEFT JOIN t ON b.technique = t.technique ORDER BY n_actors DESC, n_episodes DESC, b.technique LIMIT :top",
        min_actors=3,
        top=50,
    ),
    "a13_global_top": Op("Best pairs over all episodes with names, and how many techniques they have in all.", _TOP.format(metrics=_GLOBAL), min_support=2, min_pair=2, min_episode_size=2, top=50).against(_TOP.format(metrics=_CHECK_GLOBAL)),
}

FUNCTIONS = {
    "a03_bundles": (bundle_report, ["et"], f"WITH {_CHECK_SETS} SELECT size, techniques, support, confidence, lift, lift_reference FROM bundles"),
    "a10_bundle_coverage": (
        bundle_coverage,
        ["et", "brand_detects"],
        f"WITH {_CHECK_SETS}, best AS (SELECT * FROM bundles ORDER BY lift DESC, m LIMIT 50), open_parts AS (SELECT m, count(*) FILTER (t NOT IN (SELECT technique FROM brand_detects)) AS gaps FROM (SELECT m, unnest(m) AS t FROM best) AS u GROUP BY m) SELECT size, techniques, support, lift, gaps::BIGINT AS gap_count, round(100.0::DOUBLE * (size - gaps) / size, 1) AS coverage_pct FROM best JOIN open_parts USING (m)",
    ),
}
