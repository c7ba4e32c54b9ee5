"""Names: similarity joins that lose no pair, resolution of mentions, chains of aliases, consolidation of entities.

Two names are compared in lower case without outer spaces, by three numbers from 0 to 1:

- edit: one less the edit distance over the longer length;
- token: words that both have over the words of the one with fewer (words are split at spaces);
- partial: the edit number of the shorter name and the part of the longer one, as long, that is most like it.

similarity is 1 for equal names, else the highest of 0.4 edit + 0.4 token + 0.2 partial, of token, and of 0.8 partial.
The measures are plain SQL functions. Null and blank names are like nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.scratch import written

Q = 2


def plain(name: str) -> Column:
    return F.lower(F.trim(name))


def edit(a: str, b: str) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def words(name: str) -> Column:
    return F.array_distinct(F.filter(F.split(name, " +"), lambda w: w != ""))


def token(a: str, b: str) -> Column:
    return F.size(F.array_intersect(words(a), words(b))) / F.least(F.size(words(a)), F.size(words(b)))


def partial(a: str, b: str) -> Column:
    first = F.length(a) <= F.length(b)
    small, large = F.when(first, F.col(a)).otherwise(F.col(b)), F.when(first, F.col(b)).otherwise(F.col(a))
    n = F.length(small)
    parts = F.transform(F.sequence(F.lit(1), F.length(large) - n + 1), lambda i: F.levenshtein(small, F.substr(large, i, n)))
    return 1 - F.array_min(parts) / n


def similarity(a: str, b: str) -> Column:
    mixed = F.greatest(0.4 * edit(a, b) + 0.4 * token(a, b) + 0.2 * partial(a, b), token(a, b), 0.8 * partial(a, b))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(mixed)


def _grams(names: DataFrame, share: float) -> DataFrame:
    """name, gram, length: the rarest q-grams of each name, so many that names alike by edits share one.

    Names whose edit number is at least `share` are within d = floor((1 - share) * longer length) edits, and one edit
    changes at most q q-grams; so of its q-grams in any one order of all, the first q * d + 1 of either meet. Repeats of
    a q-gram are told apart by number. Names shorter than q are their own q-gram.
    """
    n = F.length("name")
    starts = F.sequence(F.lit(1), F.greatest(n - (Q - 1), F.lit(1)))
    each = names.select("name", n.alias("length"), F.explode(F.transform(starts, lambda i: F.substr("name", i, F.lit(Q)))).alias("g"))
    counted = each.groupBy("name", "length", "g").agg(F.count(F.lit(1)).alias("k"))
    grams = written(counted.select("name", "length", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat_ws(":", "g", i.cast("string")))).alias("gram")), "grams")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    most = F.floor(F.floor(F.col("length") / share + 1e-9) * (1 - share) + 1e-9)
    order = F.row_number().over(Window.partitionBy("name").orderBy("often", "gram"))
    return grams.join(often, "gram").withColumn("place", order).where(F.col("place") <= Q * most + 1).select("name", "gram", "length")


def _tokens(names: DataFrame, share: float, few: bool) -> DataFrame:
    """name, word: all words of each name, or (few) its rarest ones, so many that a name of as many words or more that
    has `share` of them has one of these."""
    each = written(names.select("name", F.size(words("name")).alias("n"), F.explode(words("name")).alias("word")), "words")
    if not few:
        return each.select("name", "word")
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    order = F.row_number().over(Window.partitionBy("name").orderBy("often", "word"))
    return each.join(often, "word").withColumn("place", order).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("name", "word")


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.85, or_edit: bool = False) -> DataFrame:
    """Every pair of names of left and right (column name) whose similarity (or, with or_edit, edit number) is at least
    the threshold: a, b, edit, token, partial, similarity. Names are taken in plain form, each once.

    A pair that passes without token does so by 0.4 edit + 0.4 token + 0.2 partial with token under the threshold, so its
    edit number is at least (threshold - 0.4 threshold - 0.2) / 0.4; 0.8 partial passes only thresholds up to 0.8, which
    are refused. Pairs come from q-grams by edits, and from words by token; each is then measured.
    """
    if not 0.8 < threshold <= 1:
        raise ValueError("the threshold must be above 0.8 and at most 1")
    share = max(0.5, (0.6 * threshold - 0.2) / 0.4)
    one = lambda t: written(t.select(plain("name").alias("name")).where("name <> ''").distinct(), "names")
    mine, theirs = one(left), one(right)
    # One order of q-grams and words for both sides: prefixes are taken over all names together.
    every = written(mine.unionByName(theirs).distinct(), "all-names")
    grams = written(_grams(every, share), "prefixes")
    side = lambda t, names, to: t.join(names, "name", "left_semi").withColumnRenamed("name", to)
    near = side(grams, mine, "a").withColumnRenamed("length", "la").join(side(grams, theirs, "b").withColumnRenamed("length", "lb"), "gram")
    by_edit = near.where(F.least("la", "lb") >= share * F.greatest("la", "lb") - 1e-9).select("a", "b")
    few, full = written(_tokens(every, threshold, True), "few-words"), written(_tokens(every, threshold, False), "all-words")
    by_token = side(few, mine, "a").join(side(full, theirs, "b"), "word").select("a", "b").unionByName(side(full, mine, "a").join(side(few, theirs, "b"), "word").select("a", "b"))
    pairs = written(by_edit.unionByName(by_token).distinct(), "name-pairs")
    # The edit number is cheap and the partial one is not: pairs that no mix can save are dropped before it.
    measured = pairs.select("a", "b", edit("a", "b").alias("edit"), token("a", "b").alias("token")).where(F.greatest(F.col("token"), 0.4 * F.col("edit") + 0.4 * F.col("token") + 0.2, F.col("edit") if or_edit else F.lit(0.0)) >= threshold - 1e-9)
    whole = measured.withColumn("partial", partial("a", "b"))
    mixed = F.greatest(0.4 * F.col("edit") + 0.4 * F.col("token") + 0.2 * F.col("partial"), F.col("token"), 0.8 * F.col("partial"))
    score = F.round(F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(mixed), 9)
    return whole.withColumn("similarity", score).where((F.col("similarity") >= threshold) | F.lit(or_edit) & (F.col("edit") >= threshold - 1e-9))


#: Groups that are named by letters and a number, with or without something between.
PATTERN = r"\b(apt|ta|fin|unc|dev|g)[ -]?([0-9]+)\b"


def pattern_key(name: str) -> Column:
    """What a numbered name is called by: its letters and its number; null for other names."""
    return F.when(F.col(name).rlike(PATTERN), F.concat(F.regexp_extract(name, PATTERN, 1), F.regexp_extract(name, PATTERN, 2)))


def resolve(mentions: DataFrame, known: DataFrame, aliases: DataFrame, threshold: float = 0.85, token_weight: float = 0.9) -> DataFrame:
    """What each mention (name, type or null) stands for, among the known entities (id, name, type): name, type, id, step,
    score. The first step that finds something decides: an equal alias (alias, id); an equal numbered name; the ratio (the
    higher of edit and `token_weight` * token) with an alias; the similarity with a known name. Within a step the highest
    score wins, then the smaller id. A mention with a type meets entities of that type only. Mentions of equal plain name
    and type are one; those that nothing is found for have null id and step. Blank names are left out."""
    asked = written(mentions.select(plain("name").alias("name"), "type").where("name <> ''").distinct(), "mentions")
    named = written(known.select("id", plain("name").alias("known"), F.col("type").alias("of")).where("known <> '' AND id IS NOT NULL"), "known")
    called = written(aliases.select(plain("alias").alias("known"), "id").where("known <> ''").distinct().join(named.select("id", "of").distinct(), "id"), "aliases")
    fits = F.col("type").isNull() | (F.col("type") == F.col("of"))
    step = lambda t, n, score: t.where(fits).select("name", "type", "id", F.lit(n).alias("step"), score.alias("score"))
    by_alias = step(asked.join(called.withColumnRenamed("known", "name"), "name"), 1, F.lit(1.0))
    numbered = asked.withColumn("key", pattern_key("name")).where("key IS NOT NULL")
    by_pattern = step(numbered.join(named.withColumn("key", pattern_key("known")).where("key IS NOT NULL"), "key"), 2, F.lit(1.0))
    pairs = written(similar_names(asked, named.select(F.col("known").alias("name")).unionByName(called.select(F.col("known").alias("name"))), threshold, or_edit=True), "similar-names")
    ratio = F.greatest(F.col("edit"), token_weight * F.col("token"))
    met = asked.join(pairs.withColumnRenamed("a", "name"), "name").withColumnRenamed("b", "known")
    by_ratio = step(met.join(called, "known").withColumn("ratio", F.round(ratio, 9)).where(F.col("ratio") >= threshold), 3, F.col("ratio"))
    by_similarity = step(met.where(F.col("similarity") >= threshold).join(named, "known"), 4, F.col("similarity"))
    every = by_alias.unionByName(by_pattern).unionByName(by_ratio).unionByName(by_similarity)
    best = every.groupBy("name", F.col("type").alias("t")).agg(F.min(F.struct("step", (-F.col("score")).alias("less"), "id")).alias("b"))
    out = asked.join(best.withColumnRenamed("name", "n"), (F.col("name") == F.col("n")) & F.col("type").eqNullSafe(F.col("t")), "left")
    return out.select("name", "type", F.col("b.id").alias("id"), F.col("b.step").cast("bigint").alias("step"), F.round(-F.col("b.less"), 6).alias("score"))


def alias_roots(aliases: DataFrame) -> DataFrame:
    """alias, root: where each alias's chain of (alias, target) ends, however long; a chain that runs into a cycle ends
    at the cycle's least name. Of several targets of an alias the least counts; rows with nulls are left out.

    Pointers double each round, and with each goes the least name on the way that it leaps over; chains that have ended
    only lend their ends. What has not ended after as many rounds as doubling needs for all names runs in a cycle, and
    then the way from its place has been round the whole of it.
    """
    links = written(aliases.where("alias IS NOT NULL AND target IS NOT NULL").groupBy("alias").agg(F.min("target").alias("target")), "alias-links")
    rounds = math.ceil(math.log2(max(2, links.count()))) + 1
    ends = links.join(links.select(F.col("alias").alias("target"), F.lit(False).alias("onward")), "target", "left")
    now = written(ends.select("alias", F.col("target").alias("at"), F.col("target").alias("least"), F.coalesce("onward", F.lit(True)).alias("done")), "alias-steps")
    for _ in range(rounds):
        open_ = now.where("NOT done")
        if open_.isEmpty():
            break
        leap = now.select(F.col("alias").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"), F.col("done").alias("over"))
        moved = open_.join(leap, "at").select("alias", F.col("next").alias("at"), F.least("least", "other").alias("least"), F.col("over").alias("done"))
        now = written(now.where("done").unionByName(moved), "alias-steps")
    loops = now.where("NOT done").select(F.col("alias").alias("at"), F.col("least").alias("root"))
    return now.where("done").select("alias", F.col("at").alias("root")).unionByName(now.where("NOT done").select("alias", "at").join(loops, "at").select("alias", "root"))


_AKA = [(r"(?i)([^,]+),\s*also known as\s+([^,\\.]+)"), (r"(?i)([^,(]+)[\s,]*\(?\s*\baka\s+([^,).]+)")]


def quoted_aliases(mentions: DataFrame) -> DataFrame:
    """alias, target of quotes (quote) that say "X, also known as Y" or "X (aka Y)": Y, in lower case, and X. A leading
    "the" and trailing punctuation go; names of two characters or fewer name nothing."""
    clean = lambda c: F.rtrim(F.regexp_replace(F.trim(c), r"^(?:The|the)\s+", ""), F.lit(".,;:"))
    found = F.array(*[F.struct(clean(F.regexp_extract("quote", p, 1)).alias("target"), clean(F.regexp_extract("quote", p, 2)).alias("alias")) for p in _AKA])
    pairs = mentions.select(F.explode(found).alias("p")).select(F.lower("p.alias").alias("alias"), F.lower("p.target").alias("target"))
    return pairs.where("length(alias) > 2 AND length(target) > 2 AND alias <> target").distinct()


def consolidate(mentions: DataFrame, boost: int = 5, most: int = 20) -> DataFrame:
    """Entities of mentions (name, type, confidence, quote), aliases in the quotes followed to their roots: name (the
    root, in lower case), type, aliases (other names, sorted), mentions (distinct beginnings of 100 characters of their
    quotes), confidence (the highest, and `boost` for each of these up to `most`, at most 100)."""
    rows = mentions.select(F.trim("name").alias("shown"), plain("name").alias("alias"), "type", "confidence", "quote").where("alias <> ''")
    roots = alias_roots(quoted_aliases(mentions))
    placed = rows.join(roots, "alias", "left").withColumn("name", F.coalesce("root", "alias"))
    head = F.substring("quote", 1, 100)
    got = placed.groupBy("name", "type").agg(F.max("confidence").alias("best"), F.countDistinct(F.when(head != "", head)).alias("mentions"), F.collect_set(F.when(F.col("alias") != F.col("name"), F.col("alias"))).alias("others"))
    confidence = F.least(F.lit(100), F.col("best") + F.least(F.lit(most), boost * F.col("mentions")))
    return got.select("name", "type", F.array_join(F.array_sort("others"), "|").alias("aliases"), F.col("mentions").cast("bigint").alias("mentions"), confidence.cast("bigint").alias("confidence"))


def first_kept(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (grp, k) taken in order of k: one that is paired with a kept one before it joins the first such, others are
    kept. pairs (grp, a, b) with a before b. Returns grp, k, kept (its own k if it is kept).

    Rows without an open pair before them are settled together, round by round, so there are as many rounds as the
    longest chain of pairs and not as rows."""
    edges, left, kept = written(pairs.select("grp", "a", "b").distinct(), "edges"), written(rows.select("grp", "k"), "open"), None
    every = edges
    while not left.isEmpty():
        sure = written(left.join(edges.select("grp", F.col("b").alias("k")).distinct(), ["grp", "k"], "left_anti"), "sure")
        gone = edges.join(sure.withColumnRenamed("k", "a"), ["grp", "a"], "left_semi").select("grp", F.col("b").alias("k")).distinct()
        done = written(sure.unionByName(gone).distinct(), "done")
        left = written(left.join(done, ["grp", "k"], "left_anti"), "open")
        edges = written(edges.join(done.withColumnRenamed("k", "a"), ["grp", "a"], "left_anti").join(done.withColumnRenamed("k", "b"), ["grp", "b"], "left_anti"), "edges")
        kept = sure if kept is None else kept.unionByName(sure)
    if kept is None:
        return rows.select("grp", "k", F.col("k").alias("kept"))
    home = every.join(kept.withColumnRenamed("k", "a"), ["grp", "a"], "left_semi").groupBy("grp", F.col("b").alias("k")).agg(F.min("a").alias("home"))
    own = kept.withColumn("own", F.lit(True))
    return rows.select("grp", "k").join(own, ["grp", "k"], "left").join(home, ["grp", "k"], "left").select("grp", "k", F.when(F.col("own"), F.col("k")).otherwise(F.col("home")).alias("kept"))


def merge_names(entities: DataFrame, threshold: float = 0.85, apart: float = 0.3) -> DataFrame:
    """Entities of a group (grp, name, confidence, family) merged by their names: in order of confidence (highest first)
    and name, an entity whose name's edit number with a kept one is at least the threshold joins the first such; never
    one of its own family, nor one whose name is under `apart` times as long: grp, name, confidence, family, kept.

    Equal rows are one. Pairs come from the q-grams of distinct names, so a group is never compared with itself.
    """
    order = F.struct((-F.col("confidence")).alias("less"), "name", "family").alias("k")
    rows = written(entities.select("grp", F.col("name").cast("string").alias("name"), F.col("confidence").cast("double").alias("confidence"), F.coalesce(F.col("family").cast("string"), F.lit("")).alias("family")).where("name IS NOT NULL AND grp IS NOT NULL AND confidence IS NOT NULL").distinct(), "entities")
    rows = rows.withColumn("low", F.lower("name"))
    grams = written(_grams(rows.select(F.col("low").alias("name")).distinct(), threshold), "prefixes")
    near = grams.select(F.col("name").alias("x"), F.col("length").alias("lx"), "gram").join(grams.select(F.col("name").alias("y"), F.col("length").alias("ly"), "gram"), "gram")
    near = near.where(F.least("lx", "ly") >= threshold * F.greatest("lx", "ly") - 1e-9).select("x", "y").distinct()
    near = written(near.where(edit("x", "y") >= threshold - 1e-9), "near-names")
    one = rows.select("grp", F.col("low").alias("x"), order.alias("a"), F.col("family").alias("fa"))
    two = rows.select("grp", F.col("low").alias("y"), order.alias("b"), F.col("family").alias("fb"))
    ratio = F.least(F.length("x"), F.length("y")) >= apart * F.greatest(F.length("x"), F.length("y"))
    pairs = one.join(near, "x").join(two, ["grp", "y"]).where((F.col("a") < F.col("b")) & (F.col("fa") != F.col("fb")) & ratio).select("grp", "a", "b")
    kept = first_kept(rows.select("grp", order), pairs)
    return kept.select("grp", F.col("k.name").alias("name"), (-F.col("k.less")).alias("confidence"), F.col("k.family").alias("family"), F.col("kept.name").alias("kept"))


_SIM = """lev AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS e, len(list_intersect(wa, wb)) / least(len(wa), len(wb))::DOUBLE AS t FROM pairs),
  part AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM lev WHERE greatest(t, 0.4 * e + 0.4 * t + 0.2, e) >= 0.849),
  sims AS (SELECT a, b, e, t, 1 - list_min(list_transform(range(1, length(l) - length(s) + 2), lambda i: levenshtein(s, substr(l, i, length(s))))) / length(s)::DOUBLE AS p FROM part),
  sim AS (SELECT a, b, e, t, p, round(CASE WHEN a = b THEN 1 ELSE greatest(0.4::DOUBLE * e + 0.4::DOUBLE * t + 0.2::DOUBLE * p, t, 0.8::DOUBLE * p) END, 9) AS s FROM sims)"""
_PAIRS = "n AS (SELECT DISTINCT lower(trim(name)) AS a FROM mentioned_names WHERE trim(name) <> ''), m AS (SELECT b FROM (SELECT lower(trim(name)) AS b FROM known_names UNION SELECT lower(trim(alias)) FROM known_aliases) AS u WHERE b <> ''), pairs AS (SELECT a, b, list_distinct(list_filter(string_split(a, ' '), lambda w: w <> '')) AS wa, list_distinct(list_filter(string_split(b, ' '), lambda w: w <> '')) AS wb FROM n, m)"
_KEY = r"CASE WHEN regexp_matches({c}, '\b(apt|ta|fin|unc|dev|g)[ -]?([0-9]+)\b') THEN regexp_extract({c}, '\b(apt|ta|fin|unc|dev|g)[ -]?([0-9]+)\b', 1) || regexp_extract({c}, '\b(apt|ta|fin|unc|dev|g)[ -]?([0-9]+)\b', 2) END"
FUNCTIONS = {
    "m20_similar_names": (
        lambda m, k, a: similar_names(m, k.select("name").unionByName(a.select(F.col("alias").alias("name")))).select("a", "b", F.round("edit", 6).alias("edit"), F.round("token", 6).alias("token"), F.round("partial", 6).alias("partial"), F.round("similarity", 6).alias("similarity")),
        ["mentioned_names", "known_names", "known_aliases"],
        f"WITH {_PAIRS}, {_SIM} SELECT a, b, round(e, 6) AS edit, round(t, 6) AS token, round(p, 6) AS partial, round(s, 6) AS similarity FROM sim WHERE s >= 0.85",
    ),
    "m20_resolution": (
        resolve,
        ["mentioned_names", "known_names", "known_aliases"],
        f"""WITH {_PAIRS}, {_SIM}, q AS (SELECT DISTINCT lower(trim(name)) AS name, type FROM mentioned_names WHERE trim(name) <> ''), k AS (SELECT id, lower(trim(name)) AS known, type AS of FROM known_names), c AS (SELECT DISTINCT lower(trim(alias)) AS known, a.id, k.of FROM known_aliases AS a JOIN k USING (id)),
        f AS (SELECT name, type, id, 1 AS step, 1.0::DOUBLE AS score, of FROM q JOIN c ON name = known UNION ALL SELECT name, type, id, 2, 1.0, of FROM q JOIN k ON {_KEY.format(c="name")} = {_KEY.format(c="known")}
          UNION ALL SELECT name, type, id, 3, round(greatest(e, 0.9::DOUBLE * t), 9), of FROM q JOIN sim ON a = name JOIN c ON b = known WHERE round(greatest(e, 0.9::DOUBLE * t), 9) >= 0.85 UNION ALL SELECT name, type, id, 4, s, of FROM q JOIN sim ON a = name JOIN k ON b = known WHERE s >= 0.85),
        g AS (SELECT name, type, id, step, score FROM f WHERE type IS NULL OR type = of QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY step, score DESC, id) = 1)
        SELECT q.name, q.type, g.id, g.step::BIGINT AS step, round(g.score, 6) AS score FROM q LEFT JOIN g ON q.name = g.name AND q.type IS NOT DISTINCT FROM g.type""",
    ),
    "p08_alias_roots": (
        alias_roots,
        ["alias_links"],
        """WITH RECURSIVE l AS (SELECT alias, min(target) AS target FROM alias_links WHERE alias IS NOT NULL AND target IS NOT NULL GROUP BY alias), w AS (SELECT alias, target AS here FROM l UNION SELECT w.alias, l.target FROM w JOIN l ON l.alias = w.here),
        e AS (SELECT w.alias, min(w.here) AS root FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.alias = w.here) GROUP BY w.alias), c AS (SELECT alias FROM w WHERE alias = here)
        SELECT alias, root FROM e UNION ALL SELECT w.alias, min(w.here) FROM w WHERE w.here IN (SELECT alias FROM c) AND w.alias NOT IN (SELECT alias FROM e) GROUP BY w.alias""",
    ),
    "m18_consolidated_entities": (
        consolidate,
        ["quoted_mentions"],
        r"""WITH RECURSIVE x AS (SELECT regexp_extract(quote, '([^,]+),\s*also known as\s+([^,\\.]+)', 1, 'i') AS t, regexp_extract(quote, '([^,]+),\s*also known as\s+([^,\\.]+)', 2, 'i') AS a FROM quoted_mentions UNION ALL SELECT regexp_extract(quote, '([^,(]+)[\s,]*\(?\s*\baka\s+([^,).]+)', 1, 'i'), regexp_extract(quote, '([^,(]+)[\s,]*\(?\s*\baka\s+([^,).]+)', 2, 'i') FROM quoted_mentions),
        y AS (SELECT lower(rtrim(regexp_replace(trim(a), '^(?:The|the)\s+', ''), '.,;:')) AS alias, lower(rtrim(regexp_replace(trim(t), '^(?:The|the)\s+', ''), '.,;:')) AS target FROM x), l AS (SELECT alias, min(target) AS target FROM y WHERE length(alias) > 2 AND length(target) > 2 AND alias <> target GROUP BY alias),
        w AS (SELECT alias, target AS here FROM l UNION SELECT w.alias, l.target FROM w JOIN l ON l.alias = w.here), e AS (SELECT w.alias, min(w.here) AS root FROM w WHERE w.here NOT IN (SELECT alias FROM l) GROUP BY w.alias),
        r AS (SELECT alias, root FROM e UNION ALL SELECT w.alias, min(w.here) FROM w WHERE w.here IN (SELECT alias FROM w WHERE alias = here) AND w.alias NOT IN (SELECT alias FROM e) GROUP BY w.alias),
        m AS (SELECT coalesce(root, lower(trim(name))) AS name, type, confidence, quote, lower(trim(name)) AS own FROM quoted_mentions LEFT JOIN r ON alias = lower(trim(name)) WHERE trim(name) <> ''), g AS (SELECT name, type, max(confidence) AS c, count(DISTINCT quote[:100]) FILTER (quote <> '') AS k, string_agg(DISTINCT own, '|' ORDER BY own) FILTER (own <> name) AS o FROM m GROUP BY name, type)
        SELECT name, type, coalesce(o, '') AS aliases, k::BIGINT AS mentions, least(100, c + least(20, 5 * k))::BIGINT AS confidence FROM g""",
    ),
    "g15_merged_names": (merge_names, ["grouped_names"], None),
}
