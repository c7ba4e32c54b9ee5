"""Dictionaries matched in texts: phrases, tools, red flags, cues and patterns, many at once.

All phrases of a dictionary stand in one Aho-Corasick automaton, so a text is read once however many phrases there are,
and no text is joined with phrases. A dictionary of more than SHARD phrases is dealt into several automata by hash; texts
are then read once for each.

A dictionary is a table with a column `phrase`; optional boolean columns are `whole` (the phrase must not touch letters
or digits) and `cased` (case matters), both false where they are missing or null. Null and empty phrases match nothing,
null texts hold nothing. Case is dropped code point by code point, so positions are those of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that one automaton holds; what is broadcast is bounded by it.
SHARD = 200_000
#: Bytes of phrases that one automaton holds.
SHARD_BYTES = 64 << 20


def fold(text: str) -> str:
    """text in lower case, as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Phrases:
    """An automaton over phrases (text, whole, cased)."""

    def __init__(self, phrases: list[tuple[str, bool, bool]]):
        import ahocorasick

        self.phrases = phrases
        self.by_case = []
        for cased in (False, True):
            keys: dict[str, list[int]] = {}
            for i, (phrase, _, own_case) in enumerate(phrases):
                if phrase and own_case == cased:
                    keys.setdefault(phrase if cased else fold(phrase), []).append(i)
            if keys:
                held = ahocorasick.Automaton()
                for key, numbers in keys.items():
                    held.add_word(key, (len(key), numbers))
                held.make_automaton()
                self.by_case.append((cased, held))

    def find(self, text: str) -> dict[int, list[int]]:
        """Number of hits and place of the first one, by phrase."""
        found: dict[int, list[int]] = {}
        for cased, held in self.by_case:
            for end, (size, numbers) in held.iter(text if cased else fold(text)):
                start = end - size + 1
                apart = (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum())
                for i in numbers:
                    if apart or not self.phrases[i][1]:
                        if i in found:
                            found[i][0] += 1
                        else:
                            found[i] = [1, start]
        return found


def match_phrases(texts: DataFrame, dictionary: DataFrame, key: str | list[str] = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Each phrase of the dictionary in each text that holds it: the key columns, phrase, whole, cased, n (hits,
    overlapping ones too), at (place of the first one, from 0). Equal rows of the dictionary count once."""
    keys = [key] if isinstance(key, str) else list(key)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) if c in dictionary.columns else F.lit(False).alias(c)
    phrases = dictionary.select(F.col("phrase").cast("string").alias("phrase"), flag("whole"), flag("cased")).where("phrase <> ''").distinct()
    size = phrases.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("b")).first()
    shards = max(1, -(-size["n"] // shard), -(-int(size["b"]) // SHARD_BYTES))
    rows = texts.select(*[texts[k] for k in keys], texts[text].cast("string").alias("_body"))
    schema = rows.select(*keys, F.lit("").alias("phrase"), F.lit(True).alias("whole"), F.lit(True).alias("cased"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at")).schema
    found = None
    for i in range(shards):
        # At most about `shard` phrases and SHARD_BYTES bytes.
        part = phrases if shards == 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == i)
        one = rows.mapInArrow(_scan(texts, sorted((r["phrase"], r["whole"], r["cased"]) for r in part.collect())), schema)
        found = one if found is None else found.unionByName(one)
    return found


def _scan(texts: DataFrame, phrases: list[tuple[str, bool, bool]]):
    shared = texts.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Phrases(shared.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                at: list[int] = []
                out: list[tuple[Any, ...]] = []
                for row, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for i, (n, start) in known.find(body).items() if body else ():
                        at.append(row)
                        out.append((*known.phrases[i], n, start))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                taken = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
                types = (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.record_batch([*taken, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*batch.schema.names[:-1], "phrase", "whole", "cased", "n", "at"])

    return run


def normal(column: str) -> Column:
    """Phrases as they are looked for: lower case, separators as spaces, no apostrophes."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(column), r"[-_/\\]+", " "), "'", "")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def hints(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries of a dictionary (ord, kind, phrase, technique) in each text: doc_id, kind, phrase, technique, n, at.

    An entry of kind `phrase` is found as it stands or in its normal form (lower case, separators as spaces); n and at
    are those of the form that has more hits. Other kinds are found as they stand, without case.
    """
    forms = dictionary.select("kind", "phrase", "technique", F.explode(F.array_distinct(F.when(F.col("kind") == "phrase", F.array(F.lower("phrase"), normal("phrase"))).otherwise(F.array(F.lower("phrase"))))).alias("form")).distinct()
    hits = match_phrases(texts, forms.select(F.col("form").alias("phrase"))).select("doc_id", F.col("phrase").alias("form"), "n", "at")
    met = hits.join(forms, "form")
    return met.groupBy("doc_id", "kind", "phrase", "technique").agg(F.max("n").alias("n"), F.min_by("at", F.struct((-F.col("n")).alias("less"), "at")).alias("at"))


def relevance(texts: DataFrame, dictionary: DataFrame, wanted: DataFrame, scores: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """How relevant each wanted technique is for each text that hints at it: doc_id, technique, relevance, phrase.

    Kinds are tried in the order of `scores` (kind: score of the technique itself, score of its parent), entries of a
    kind in the dictionary's order (`ord`); the first one found decides.
    """
    scores = scores or {"phrase": (100, 75), "pattern": (80, 80), "tool": (60, 40)}
    spark = texts.sparkSession
    ladder = spark.createDataFrame([(k, i, *s) for i, (k, s) in enumerate(scores.items())], "kind string, rung int, own bigint, parent bigint")
    hit = hints(texts, dictionary).select("doc_id", "kind", "phrase", "technique").join(dictionary.select("kind", "phrase", "technique", "ord"), ["kind", "phrase", "technique"])
    w = wanted.select(F.col("technique").alias("wanted")).distinct()
    # A wanted technique meets entries of its own and of its parent: two equi-joins' worth of keys.
    asks = w.select("wanted", F.explode(F.array_distinct(F.array("wanted", F.substring_index("wanted", ".", 1)))).alias("technique"))
    value = F.when(F.col("technique") == F.col("wanted"), F.col("own")).otherwise(F.col("parent"))
    met = hit.join(asks, "technique").join(F.broadcast(ladder), "kind")
    best = met.groupBy("doc_id", "wanted").agg(F.min_by(F.struct(value.alias("relevance"), "phrase"), F.struct("rung", "ord", "phrase")).alias("b"))
    return best.select("doc_id", F.col("wanted").alias("technique"), "b.relevance", "b.phrase")


def lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of texts: key, line (from 0), text."""
    return texts.select(texts[key].alias(key), F.posexplode(F.split(texts[text], "\n")).alias("line", "text")).select(key, F.col("line").cast("bigint").alias("line"), "text")


def cue_scores(texts: DataFrame, cues: DataFrame, least: float = 0.6, further: float = 0.1, most: float = 0.3) -> DataFrame:
    """Lines by the weights of the cues (cue, weight) that they hold: the highest, and `further` for each further cue up
    to `most`, capped at one; those of at least `least`: doc_id, line, score."""
    hits = match_phrases(lines(texts), cues.select(F.col("cue").alias("phrase")), ["doc_id", "line"])
    met = hits.join(cues.groupBy(F.col("cue").alias("phrase")).agg(F.max("weight").cast("double").alias("weight")), "phrase")
    score = F.least(F.lit(1.0), F.max("weight") + F.least(F.lit(most), F.lit(further) * (F.count(F.lit(1)) - 1)))
    return met.groupBy("doc_id", "line").agg(F.round(score, 4).alias("score")).where(F.col("score") >= least)


def span_scores(texts: DataFrame, patterns: DataFrame, sections: DataFrame, keywords: DataFrame, least: float = 0.6, sure: str = r"\bT\d{4}(?:\.\d{3})?\b", each: float = 0.3, most: float = 1.0) -> DataFrame:
    """Lines that tell of behaviour: doc_id, line, score, tactics, n_keywords, prior.

    patterns (pattern, tactic, weight) are regular expressions without case, each worth its weight once a line; `sure`
    (explicit ids) is worth two; each keyword (phrase) found is worth `each`, up to `most`. Lines of at least `least`
    remain, with a score of one at most. prior is the highest weight of the sections (phrase, weight) that the line
    names, else one. Patterns are configuration: they are collected, and more than 10,000 are refused.
    """
    held = [(r["pattern"], r["tactic"], float(r["weight"])) for r in patterns.select("pattern", "tactic", "weight").distinct().orderBy("tactic", "pattern").limit(10_001).collect()]
    if len(held) > 10_000:
        raise ValueError("more than 10000 patterns")
    known = lines(texts).where(F.trim("text") != "")
    found = [F.when(F.col("text").rlike("(?i)" + p), F.struct(F.lit(t).alias("tactic"), F.lit(w).alias("weight"))) for p, t, w in held]
    found.append(F.when(F.col("text").rlike(sure), F.struct(F.lit("explicit-technique").alias("tactic"), F.lit(2.0).alias("weight"))))
    base = known.select("doc_id", "line", "text", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("hits"))
    words = match_phrases(known, keywords, ["doc_id", "line"]).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_keywords"))
    named = match_phrases(known, sections, ["doc_id", "line"]).select("doc_id", "line", "phrase").join(sections.groupBy("phrase").agg(F.max("weight").cast("double").alias("weight")), "phrase")
    prior = named.groupBy("doc_id", "line").agg(F.max("weight").alias("prior"))
    rows = base.join(words, ["doc_id", "line"], "left").join(prior, ["doc_id", "line"], "left")
    n = F.coalesce("n_keywords", F.lit(0))
    score = F.aggregate("hits", F.lit(0.0), lambda s, x: s + x["weight"]) + F.least(F.lit(most), F.lit(each) * n)
    tactics = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["tactic"])))
    return rows.withColumn("raw", F.round(score, 6)).where(F.col("raw") >= least).select("doc_id", "line", F.least(F.lit(1.0), F.col("raw")).alias("score"), F.array_join(tactics, ",").alias("tactics"), n.cast("bigint").alias("n_keywords"), F.coalesce("prior", F.lit(1.0)).alias("prior"))


def red_flags(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """Red flags (phrase, technique, reason) in texts, without case: doc_id, phrase, technique, reason."""
    hits = match_phrases(texts, flags.select(F.lower("phrase").alias("phrase"))).select("doc_id", F.col("phrase").alias("low"))
    return hits.join(flags.select(F.lower("phrase").alias("low"), "phrase", "technique", "reason").distinct(), "low").drop("low")


def suggest_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """What usually goes with the techniques found in each episode and is missing: episode, technique, triggered_by.

    found (episode, technique), pairs (ord, if_found, check_for). A sub-technique also triggers the rules of its parent;
    a technique is not missing if it or one of its sub-techniques was found; of several rules the first one tells.
    """
    parent = F.substring_index("technique", ".", 1)
    wide = found.select("episode", F.explode(F.array_distinct(F.array("technique", parent))).alias("technique")).distinct()
    met = wide.join(pairs.select(F.col("if_found").alias("technique"), "check_for", "ord"), "technique")
    best = met.groupBy("episode", F.col("check_for").alias("wanted")).agg(F.min_by("technique", F.struct("ord", "technique")).alias("triggered_by"))
    # What is found, and everything above it, isn't missing: T1.2 found means that T1 is there, not the reverse.
    there = found.select("episode", F.explode(F.array_distinct(F.array("technique", parent))).alias("wanted")).distinct()
    return best.join(there, ["episode", "wanted"], "left_anti").select("episode", F.col("wanted").alias("technique"), "triggered_by")


def expand(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """Queries (item_id, text) with the synonyms of the groups (word, synonym) whose words they mention: item_id, synonym."""
    hits = match_phrases(queries, groups.select(F.lower("word").alias("phrase")), "item_id").select("item_id", F.col("phrase").alias("low"))
    return hits.join(groups.select(F.lower("word").alias("low"), "synonym").distinct(), "low").select("item_id", "synonym").distinct()


def error_classes(messages: DataFrame, rules: DataFrame, other: str = "other") -> DataFrame:
    """Validation messages (message_id, text) by class: the first rule (ord, phrase, class) that a message holds decides,
    without case: class, n."""
    hits = match_phrases(messages, rules.select(F.lower("phrase").alias("phrase")), "message_id").select("message_id", F.col("phrase").alias("low"))
    best = hits.join(rules.select(F.lower("phrase").alias("low"), "class", "ord"), "low").groupBy("message_id").agg(F.min_by("class", F.struct("ord", "class")).alias("class"))
    total = messages.agg(F.count(F.lit(1)).alias("n"))
    known = best.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    rest = total.join(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"))).select(F.lit(other).alias("class"), (F.col("n") - F.col("k")).alias("n"))
    return known.unionByName(rest).groupBy("class").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


_PLAIN = r"regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(phrase), '[-_/\\]+', ' ', 'g'), chr(39), ''), '\s+', ' ', 'g')), '^$', phrase)"
_HINTS = f"h AS (SELECT *, {_PLAIN} AS plain FROM phrase_hints), m AS (SELECT doc_id, ord, kind, phrase, technique FROM documents, h WHERE strpos(lower(text), lower(phrase)) > 0 OR kind = 'phrase' AND strpos(lower(text), plain) > 0)"
FUNCTIONS = {
    "g03_query_expansion": (expand, ["benchmark", "synonym_groups"], "SELECT DISTINCT item_id, synonym FROM benchmark JOIN synonym_groups ON strpos(lower(text), lower(word)) > 0"),
    "k12_errors": (
        error_classes,
        ["validation_messages", "error_rules"],
        "SELECT class, count(*) AS n FROM (SELECT message_id, coalesce((SELECT arg_min(class, (ord, class)) FROM error_rules WHERE strpos(lower(text), lower(phrase)) > 0), 'other') AS class FROM validation_messages) GROUP BY class",
    ),
    "m15_phrases": (lambda d, h: hints(d, h).select("doc_id", "kind", "phrase", "technique"), ["documents", "phrase_hints"], f"WITH {_HINTS} SELECT DISTINCT doc_id, kind, phrase, technique FROM m"),
    "m15_phrase_hits": (
        lambda d, h: match_phrases(d, h).select("doc_id", "phrase", "whole", "cased", "n", "at"),
        ["documents", "phrase_flags"],
        r"""WITH d AS (SELECT doc_id, text, CASE WHEN cased THEN text ELSE lower(text) END AS body, phrase, CASE WHEN cased THEN phrase ELSE lower(phrase) END AS low, whole, cased FROM documents, (SELECT DISTINCT * FROM phrase_flags)),
        c AS (SELECT *, unnest(range(1, length(body) - length(low) + 2)) AS i FROM d WHERE strpos(body, low) > 0),
        k AS (SELECT * FROM c WHERE substr(body, i, length(low)) = low AND (NOT whole OR NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '^[\p{L}\p{N}]')) AND NOT regexp_matches(substr(text, i + length(low), 1), '^[\p{L}\p{N}]')))
        SELECT doc_id, phrase, whole, cased, count(*) AS n, min(i) - 1 AS at FROM k GROUP BY doc_id, phrase, whole, cased""",
    ),
    "p23_relevance_ladder": (
        relevance,
        ["documents", "phrase_hints", "wanted_techniques"],
        f"""WITH {_HINTS}, w AS (SELECT DISTINCT technique AS t, string_split(technique, '.')[1] AS base FROM wanted_techniques), l AS (SELECT doc_id, t, phrase, ord + CASE kind WHEN 'phrase' THEN 0 WHEN 'pattern' THEN 1000000 ELSE 2000000 END AS place, CASE kind WHEN 'phrase' THEN 75 WHEN 'pattern' THEN 80 ELSE 40 END + CASE WHEN technique = t AND kind = 'phrase' THEN 25 WHEN technique = t AND kind = 'tool' THEN 20 ELSE 0 END AS v FROM w JOIN m ON technique IN (t, base))
        SELECT doc_id, t AS technique, arg_min(v, place)::BIGINT AS relevance, arg_min(phrase, place) AS phrase FROM l GROUP BY doc_id, t""",
    ),
    "m03_span_scores": (
        cue_scores,
        ["documents", "cues"],
        """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM t), h AS (SELECT doc_id, i, list_max(list(weight)) AS top, len(list(cue)) AS n FROM l JOIN cues ON strpos(lower(line), cue) > 0 GROUP BY doc_id, i)
        SELECT doc_id, i - 1 AS line, round(least(1, top::DOUBLE + least(0.3::DOUBLE, (n - 1) / 10.0::DOUBLE)), 4) AS score FROM h WHERE least(1, top + least(0.3, (n - 1) * 0.1)) >= 0.6""",
    ),
    "m03_tactic_spans": (
        lambda d, p, s, k: span_scores(d, p, s, k.select(F.col("keyword").alias("phrase"))),
        ["documents", "tactic_patterns", "section_weights", "keyword_index"],
        r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) - 1 AS line, unnest(ls) AS body FROM t), r AS (SELECT * FROM l WHERE trim(body) <> ''),
        p AS (SELECT doc_id, line, sum(weight)::DOUBLE AS w, string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS tactics FROM r JOIN (SELECT DISTINCT pattern, tactic, weight FROM tactic_patterns UNION ALL SELECT 'explicit', 'explicit-technique', 2.0) AS q ON CASE WHEN pattern = 'explicit' THEN regexp_matches(body, '\bT\d{4}(?:\.\d{3})?\b') ELSE regexp_matches(body, pattern, 'i') END GROUP BY doc_id, line),
        k AS (SELECT doc_id, line, count(*) AS n FROM r JOIN (SELECT DISTINCT keyword FROM keyword_index) ON strpos(lower(body), keyword) > 0 GROUP BY doc_id, line), s AS (SELECT doc_id, line, max(weight)::DOUBLE AS prior FROM r JOIN section_weights ON strpos(lower(body), phrase) > 0 GROUP BY doc_id, line)
        SELECT r.doc_id, r.line, least(1, round(coalesce(w, 0) + least(1, 0.3::DOUBLE * coalesce(n, 0)), 6)) AS score, coalesce(tactics, '') AS tactics, coalesce(n, 0) AS n_keywords, coalesce(prior, 1) AS prior FROM r LEFT JOIN p USING (doc_id, line) LEFT JOIN k USING (doc_id, line) LEFT JOIN s USING (doc_id, line) WHERE round(coalesce(w, 0) + least(1, 0.3::DOUBLE * coalesce(n, 0)), 6) >= 0.6""",
    ),
    "l41_red_flags": (red_flags, ["documents", "red_flags"], "SELECT doc_id, phrase, technique, reason FROM documents JOIN red_flags ON strpos(lower(text), lower(phrase)) > 0"),
    "l41_pair_suggestions": (
        suggest_pairs,
        ["dotted_et", "technique_pairs"],
        """WITH f AS (SELECT DISTINCT episode, technique FROM dotted_et), x AS (SELECT episode, technique FROM f UNION SELECT episode, string_split(technique, '.')[1] FROM f)
        SELECT x.episode, check_for AS technique, arg_min(if_found, (ord, if_found)) AS triggered_by FROM x JOIN technique_pairs ON if_found = x.technique WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.episode = x.episode AND (f.technique = check_for OR starts_with(f.technique, concat(check_for, '.')))) GROUP BY x.episode, check_for""",
    ),
}
