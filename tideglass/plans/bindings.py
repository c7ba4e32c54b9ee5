"""How the domain's logical tables are bound to the star-schema test tables: the same SQL for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TABLE = re.compile(r"\{(\w+)\}")

#: Logical table -> SQL over other tables. Episodes are orders, techniques are brands (dense) or parts (sparse), actors
#: are nations, tactics are part types; detection and mitigation are supplier-part pairs of high-quantity lines.
VIEWS = {
    "et": "SELECT DISTINCT l_orderkey AS episode, p_brand AS technique FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "attribution": "SELECT o_orderkey AS episode, n_name AS actor FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "eta": "SELECT actor, et.episode, technique FROM {et} AS et JOIN {attribution} AS att ON et.episode = att.episode",
    "part_use": "SELECT DISTINCT actor, episode, l_partkey AS technique FROM {lineitem} JOIN {attribution} AS att ON l_orderkey = att.episode",
    "technique_tactic": "SELECT DISTINCT p_brand AS technique, p_type AS tactic FROM {part}",
    "primary_tactic": "SELECT technique, min(tactic) AS tactic FROM {technique_tactic} GROUP BY technique",
    "tactic_rank": "SELECT tactic, row_number() OVER (ORDER BY tactic) AS tactic_order FROM (SELECT DISTINCT p_type AS tactic FROM {part}) AS t",
    "technique_names": "SELECT DISTINCT p_brand AS technique, concat('Technique ', p_brand) AS name FROM {part}",
    "actions": """SELECT l_orderkey AS episode, p_brand AS technique, CAST(l_linenumber AS BIGINT) AS ord, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS BIGINT) AS action_id,
      CASE WHEN l_discount > 0.08 THEN NULL ELSE l_quantity * 2 END AS confidence, l_shipdate AS ts FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "techniques": "SELECT p_partkey AS technique, p_name AS name, p_brand AS family, p_type AS tactic, p_size > 25 AS is_sub, CASE WHEN p_size % 10 = 0 THEN TRUE WHEN p_size % 10 = 1 THEN NULL ELSE FALSE END AS revoked FROM {part}",
    "detects": "SELECT DISTINCT l_suppkey AS strategy, l_partkey AS technique FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45",
    "mitigates": "SELECT DISTINCT l_suppkey AS mitigation, l_partkey AS technique FROM {lineitem} WHERE l_returnflag = 'A' AND l_quantity > 48",
    "uses": "SELECT DISTINCT n_name AS actor, l_partkey AS technique FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "brand_detects": "SELECT DISTINCT strategy, p_brand AS technique FROM {detects} AS d JOIN {part} ON technique = p_partkey WHERE p_size > 35",
    "brand_mitigates": "SELECT DISTINCT mitigation, p_brand AS technique FROM {mitigates} AS d JOIN {part} ON technique = p_partkey WHERE p_size > 44",
    "next_edges": "SELECT user_id AS flow, event_type AS src, dst, p FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CASE WHEN value < 5 THEN NULL ELSE least(value / 100, 1.0) END AS p FROM {events}) AS t WHERE dst IS NOT NULL AND dst <> event_type",
    "transitions": "SELECT src, dst, CAST(count(*) AS BIGINT) AS n, avg(p) AS p FROM {next_edges} GROUP BY src, dst",
    "ptg_edges": "SELECT src, dst, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, n, sum(n) OVER (PARTITION BY src) AS total FROM {transitions}) AS t WHERE n * 100 >= total",
    "reports": "SELECT doc_id AS report_id, source, lang, n_chars, text, TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id % 60 AS INT) * INTERVAL 1 DAY AS ingested, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('c', CAST(doc_id % 11 AS VARCHAR(9))) END AS campaign, CASE doc_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE 'failed' END AS status FROM {documents}",
    "candidates": "SELECT event_id AS candidate, event_type AS type, CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN NULL ELSE 'pending' END AS status, value AS confidence, ts AS created FROM {events}",
    "predictions": "SELECT d.doc_id, d.source AS model_type, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 600 THEN 'good' WHEN n_chars > 200 THEN 'bad' ELSE 'tiny' END AS predicted, CAST(n_chars % 101 AS DOUBLE) / 100 AS confidence FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id",
    "claim_rows": "SELECT l_orderkey AS chunk, p_brand AS technique, CAST(l_quantity * 2 AS BIGINT) AS confidence, l_linenumber AS span, l_orderkey % 500 AS doc FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "chunk_ranges": "SELECT doc_id, CAST(floor(c_start / 500) AS BIGINT) AS chunk_no, c_start, least(c_start + 600, n_chars) AS c_end FROM (SELECT doc_id, n_chars, explode(sequence(CAST(0 AS BIGINT), n_chars - 1, CAST(500 AS BIGINT))) AS c_start FROM {documents} WHERE n_chars > 0) AS k",
    "span_ranges": "SELECT doc_id, CAST(floor(s_start / 137) AS BIGINT) AS span_no, s_start, s_start + 90 AS s_end FROM (SELECT doc_id, explode(sequence(CAST(0 AS BIGINT), n_chars - 90, CAST(137 AS BIGINT))) AS s_start FROM {documents} WHERE n_chars >= 90) AS s",
    "entity_mentions": "SELECT lower(trim(e.event_type)) AS name, CASE WHEN e.user_id % 2 = 0 THEN 'tool' ELSE 'actor' END AS type, CAST(floor(e.value) AS BIGINT) AS confidence, e.user_id AS chunk, e.props AS quote FROM {events} AS e",
    "entity_names": "SELECT DISTINCT p_name AS name FROM {part} UNION SELECT DISTINCT event_type FROM {events} UNION SELECT DISTINCT p_type FROM {part}",
    "ignore_rules": "SELECT * FROM (VALUES ('user', 'part_1'), ('vendor', 'Part_2'), ('extension', '.exe'), ('extension', 'ick'), ('generic', 'view'), ('code', 'signup'), ('pattern', 'part_[0-9]*99$'), ('pattern', 'STANDARD$|ECON')) AS v(kind, value)",
    "path_steps": "SELECT l_orderkey AS episode, l_partkey AS technique FROM {lineitem}",
    "described": "SELECT DISTINCT l_orderkey AS report, l_partkey AS object FROM {lineitem}",
    "actors": "SELECT n_nationkey AS actor, n_name AS name FROM {nation}",
    "analytics": "SELECT s_suppkey AS analytic, s_acctbal AS setting FROM {supplier}",
    "environment": "SELECT l_suppkey AS analytic, max(l_extendedprice) AS setting FROM {lineitem} WHERE l_discount > 0.095 GROUP BY l_suppkey",
    "required_keys": "SELECT DISTINCT l_suppkey AS analytic, l_orderkey % 40 AS source, l_linenumber AS k FROM {lineitem} WHERE l_quantity > 40",
    "supplied_keys": "SELECT DISTINCT l_orderkey % 40 AS source, l_linenumber AS k FROM {lineitem} WHERE l_orderkey % 40 < 30 AND l_linenumber < 5",
    "rules": "SELECT p_partkey AS rule, p_name AS title, p_type AS body, p_size AS level FROM {part}",
    "stix_objects": """SELECT 'attack-pattern' AS type, concat(CASE WHEN p_size = 7 THEN 'tool' ELSE 'attack-pattern' END, '--', concat(substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 8), '-', substr(md5(CAST(p_partkey AS VARCHAR(20))), 9, 4), '-4', substr(md5(CAST(p_partkey AS VARCHAR(20))), 14, 3), '-a', substr(md5(CAST(p_partkey AS VARCHAR(20))), 18, 3), '-', substr(md5(CAST(p_partkey AS VARCHAR(20))), 21, 12))) AS id, CASE WHEN p_size = 9 THEN '2.0' END AS spec_version, CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS name, CAST(NULL AS VARCHAR(9)) AS source_ref, CAST(NULL AS VARCHAR(9)) AS target_ref, CAST(NULL AS VARCHAR(9)) AS relationship_type, CAST(NULL AS VARCHAR(9)) AS pattern, CAST(NULL AS DOUBLE) AS confidence FROM {part}
      UNION ALL SELECT 'relationship', concat('relationship--', CASE WHEN l_linenumber = 6 THEN 'bad' ELSE concat(substr(md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))), 1, 8), '-', substr(md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))), 9, 4), '-4', substr(md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))), 14, 3), '-a', substr(md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))), 18, 3), '-', substr(md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))), 21, 12)) END), NULL, NULL, concat('s', CAST(l_suppkey AS VARCHAR(20))), CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('t', CAST(l_partkey AS VARCHAR(20))) END, CASE WHEN l_returnflag = 'N' THEN 'uses' WHEN l_returnflag = 'A' THEN 'likes' ELSE 'mitigates' END, NULL, CAST(l_quantity * 2.5 AS DOUBLE) FROM {lineitem}""",
    "cues": "SELECT * FROM (VALUES ('ing the', 0.5), ('und ', 0.4), ('que ', 0.3), ('tion', 0.25), ('akia', 2.0), ('password', 0.9)) AS v(cue, weight)",
    "phrase_hints": """SELECT * FROM (VALUES (1, 'phrase', 'the ', 'T1'), (2, 'phrase', 'und ', 'T2.1'), (3, 'phrase', 'thing', 'T1.1'), (4, 'pattern', 'tion', 'T3'), (5, 'pattern', 'que ', 'T2'), (6, 'tool', 'token', 'T4'), (7, 'tool', 'pass', 'T4.2'), (8, 'phrase', 'of-the', 'T9')) AS v(ord, kind, phrase, technique)
      UNION ALL SELECT CAST(100 + row_number() OVER (ORDER BY l, r, i) AS INT), CASE i % 3 WHEN 0 THEN 'phrase' WHEN 1 THEN 'pattern' ELSE 'tool' END, concat(l, CASE WHEN i % 2 = 0 THEN ' ' ELSE '-' END, r), concat('T', CAST(i % 12 AS VARCHAR(9)), CASE WHEN i % 5 = 0 THEN '.1' ELSE '' END) FROM (SELECT lower(split_part(text, ' ', 2)) AS l, lower(split_part(text, ' ', 3)) AS r, min(item_id) AS i FROM {benchmark} GROUP BY lower(split_part(text, ' ', 2)), lower(split_part(text, ' ', 3))) AS p WHERE l <> '' AND r <> ''""",
    "phrase_flags": "SELECT * FROM (VALUES ('the', TRUE, FALSE), ('The', FALSE, TRUE), ('und', TRUE, TRUE), ('ing the', FALSE, FALSE), ('aa', FALSE, FALSE), ('que ', FALSE, TRUE), ('ß', FALSE, FALSE)) AS v(phrase, whole, cased)",
    "tactic_patterns": "SELECT pattern, tactic, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('(ing|tion)s? the', 'execution', 0.85), ('und ?(die|der|das)', 'discovery', 0.6), ('que |qui ', 'impact', 0.95), ('pass(word|wd)', 'credential-access', 0.85), ('[0-9]+[.][0-9]+[.][0-9]+', 'command-and-control', 0.9)) AS v(pattern, tactic, weight)",
    "section_weights": "SELECT phrase, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('the', 1.1), ('und', 1.2), ('licen', 0.5)) AS v(phrase, weight)",
    "red_flags": "SELECT * FROM (VALUES ('Password', 'T1', 'secrets'), ('akia', 'T2.1', 'keys'), ('licensed', 'T3', 'terms'), ('tion of', 'T4', 'prose')) AS v(phrase, technique, reason)",
    "dotted_et": "SELECT episode, concat('T', substr(technique, 7, 1), CASE WHEN substr(technique, 8, 1) IN ('', '5') THEN '' ELSE concat('.', substr(technique, 8, 1)) END) AS technique FROM {et}",
    "technique_pairs": "SELECT * FROM (VALUES (1, 'T1', 'T2'), (2, 'T1.2', 'T2'), (3, 'T2.3', 'T3.1'), (4, 'T3', 'T4'), (5, 'T4.4', 'T5.5'), (6, 'T5', 'T1')) AS v(ord, if_found, check_for)",
    "wanted_techniques": "SELECT * FROM (VALUES ('T1'), ('T1.1'), ('T2.1'), ('T3'), ('T4.2'), ('T9')) AS v(technique)",
    "keyword_index": "SELECT DISTINCT keyword, technique FROM (SELECT lower(split_part(text, ' ', 1)) AS keyword, concat('T', CAST(item_id AS VARCHAR(19))) AS technique FROM {benchmark} UNION ALL SELECT lower(concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))), concat('T', CAST(item_id AS VARCHAR(19))) FROM {benchmark}) AS k WHERE length(trim(keyword)) > 1",
    "kill_chain": "SELECT p_brand AS technique, CASE CAST(substr(p_brand, 7, 2) AS INT) % 9 WHEN 0 THEN 'initial-access' WHEN 1 THEN 'persistence' WHEN 2 THEN 'credential-access' WHEN 3 THEN 'lateral-movement' WHEN 4 THEN 'collection' WHEN 5 THEN 'exfiltration' WHEN 6 THEN 'execution' WHEN 7 THEN 'command-and-control' ELSE 'discovery' END AS tactic FROM (SELECT DISTINCT p_brand FROM {part}) AS b",
    "flow_reports": "SELECT o_orderkey AS flow, o_custkey AS report_id, o_orderdate AS created, o_totalprice AS score, o_orderstatus AS status, o_orderpriority AS kind FROM {orders}",
    "report_fields": "SELECT doc_id AS report_id, substr(text, 1, 60) AS name, text AS description, concat(lang, ' ', source) AS techniques FROM {documents}",
    "search_queries": "SELECT item_id AS query_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 4), ' ', split_part(text, ' ', 6)) AS text FROM {benchmark}",
    "named_techniques": "SELECT p_partkey AS id, p_name AS name, concat(p_type, ' ', p_brand, ' ', p_name) AS description FROM {part}",
    "named_entities": "SELECT s_suppkey AS id, concat(s_name, ' of ', n_name) AS name, CAST(floor(s_acctbal) AS BIGINT) AS n FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "name_queries": "SELECT CAST(row_number() OVER (ORDER BY t) AS BIGINT) AS query_id, t AS text FROM (SELECT DISTINCT p_name AS t FROM {part} UNION SELECT n_name FROM {nation} UNION SELECT concat(' ', p_type, ' ') FROM {part}) AS q",
    "requests": "SELECT event_id AS request_id, ts, user_id AS client, concat('/v1/', event_type, '/', CAST(event_id % 7 AS VARCHAR(9))) AS path FROM {events}",
    "endpoint_limits": "SELECT prefix, CAST(allowance AS BIGINT) AS allowance FROM (VALUES ('/v1/click', 4), ('/v1/click/3', 2), ('/v1/view', 3), ('/v1/view/', 5), ('/', 6)) AS v(prefix, allowance)",
    "job_events": "SELECT event_id, ts, user_id % 60 AS job, concat('w', CAST(user_id % 4 AS VARCHAR(9))) AS worker, CASE WHEN value > 99 THEN 'complete' WHEN value > 98.5 THEN 'fail' WHEN event_type IN ('click', 'error') THEN 'claim' ELSE 'heartbeat' END AS kind FROM {events}",
    "known_names": """SELECT id, name, CASE id % 3 WHEN 0 THEN 'tool' ELSE 'malware' END AS type FROM (SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name FROM (SELECT DISTINCT translate(concat(split_part(text, ' ', i), ' ', split_part(text, ' ', i + 1)), 'ÄÇÈÉÊÑÖÜßäçèéêíñóöü', 'ACEEENOUsaceeeinoou') AS name FROM {benchmark} CROSS JOIN (SELECT explode(sequence(1, 30)) AS i) AS s WHERE split_part(text, ' ', i + 1) <> '') AS d) AS n
      UNION ALL SELECT * FROM (VALUES (CAST(100001 AS BIGINT), 'APT 28', 'group'), (100002, 'Fin7', 'group'), (100003, 'UNC-2452', 'group'), (100004, 'Lazarus Group', 'group'), (100005, ' ', 'tool')) AS v(id, name, type)""",
    "known_aliases": "SELECT * FROM (VALUES ('Fancy Bear', CAST(100001 AS BIGINT)), ('sofacy group', 100001), ('Hidden Cobra', 100004), ('Dark Halo', 100003), (NULL, 100002)) AS v(alias, id) UNION ALL SELECT concat('the ', name), id FROM {known_names} WHERE id % 7 = 0",
    "mentioned_names": """SELECT name, CASE WHEN id % 4 = 0 THEN NULL ELSE type END AS type FROM {known_names} WHERE id % 5 = 0 UNION ALL SELECT concat(substr(name, 1, 2), substr(name, 4)), NULL FROM {known_names} WHERE id % 3 = 0 UNION ALL SELECT concat(' The ', upper(name)), type FROM {known_names} WHERE id % 11 = 0 UNION ALL SELECT concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)), type FROM {known_names} WHERE id % 2 = 0
      UNION ALL SELECT * FROM (VALUES ('apt28', 'group'), ('APT-28', NULL), ('FIN 7', 'group'), ('fin-8', 'group'), ('fancy bear', NULL), ('fancy baer', NULL), ('Lazarus', 'group'), ('lazarus groop', 'group'), ('', NULL), (NULL, 'tool'), ('unc2452', 'tool')) AS v(name, type)""",
    "alias_links": "SELECT concat('n', CAST(p_partkey AS VARCHAR(20))) AS alias, concat('n', CAST(CASE WHEN p_partkey % 250 = 0 THEN p_partkey + 249 WHEN p_partkey < 1000 THEN p_partkey - 1 ELSE CAST(floor(p_partkey / 3) AS BIGINT) END AS VARCHAR(20))) AS target FROM {part} WHERE p_partkey NOT IN (500, 77)",
    "quoted_mentions": """SELECT name, 'actor' AS type, CAST(60 + id % 30 AS BIGINT) AS confidence, CASE id % 6 WHEN 0 THEN concat('The ', name, ', also known as Name', CAST(id AS VARCHAR(9)), '. It') WHEN 1 THEN concat(name, ' (aka Name', CAST(id - 1 AS VARCHAR(9)), ')') WHEN 2 THEN '' ELSE concat('quote ', CAST(id % 40 AS VARCHAR(9)), ' on ', name) END AS quote FROM {known_names} WHERE id < 100000
      UNION ALL SELECT concat('name', CAST(id AS VARCHAR(9))), 'actor', CAST(50 AS BIGINT), concat('NAME', CAST(id AS VARCHAR(9)), ' was seen') FROM {known_names} WHERE id < 2000 UNION ALL SELECT * FROM (VALUES ('A1x', 'actor', CAST(70 AS BIGINT), 'A1x, also known as B1x.'), ('B1x', 'actor', 95, 'B1x, also known as A1x.'), (' ', 'actor', 1, 'x')) AS v(name, type, confidence, quote)""",
    "grouped_names": "SELECT CAST(label AS VARCHAR(9)) AS grp, name, CAST(c AS DOUBLE) AS confidence, CAST(k AS VARCHAR(9)) AS family FROM (SELECT id % 5 AS label, name, id % 90 AS c, id % 4 AS k FROM {known_names} UNION ALL SELECT id % 5, concat(name, 's'), id % 70, 9 FROM {known_names} UNION ALL SELECT id % 5, concat(substr(name, 1, 3), substr(name, 5)), id % 50, id % 3 FROM {known_names}) AS t",
    "pair_verdicts": "SELECT src, dst, CASE WHEN n % 4 = 0 THEN 'unknown' WHEN n % 4 = 1 THEN 'forward' WHEN n % 4 = 2 THEN 'reverse' ELSE 'bidirectional' END AS verdict, CAST(n % 100 AS DOUBLE) / 100 AS confidence, n % 4 AS cited, 5 AS available FROM {transitions}",
    "judge_cache": "SELECT flow AS entry, status, created, report_id % 5 AS accesses FROM {flow_reports}",
    "stored_models": "SELECT flow AS model, report_id % 50 AS scope, created FROM {flow_reports}",
    "base_model": "SELECT src, dst, p FROM {ptg_edges} WHERE length(src) % 2 = 0 OR p > 0.2",
    "other_model": "SELECT src, dst, p * 0.9 AS p FROM {ptg_edges} WHERE length(dst) % 2 = 1 OR p > 0.25",
    "decisions": "SELECT event_id AS candidate, CASE WHEN value >= 60 THEN 'approved' ELSE 'rejected' END AS decision FROM {events} WHERE event_type = 'signup'",
    "entity_edits": "SELECT event_id AS candidate, CAST(50 AS DOUBLE) AS adjusted FROM {events} WHERE event_type = 'error'",
    "action_reviews": "SELECT episode, action_id, CASE WHEN action_id = 3 THEN 'rejected' ELSE 'edited' END AS status, CASE WHEN action_id = 4 THEN CAST(75 AS DOUBLE) END AS confidence FROM {actions} WHERE action_id IN (3, 4)",
    "campaign_merges": "SELECT * FROM (VALUES ('NATION_1', 'NATION_0'), ('NATION_2', 'NATION_0'), ('NATION_9', 'NATION_8')) AS v(campaign, merged)",
    "provisional": "SELECT * FROM (VALUES ('NATION_7'), ('c3')) AS v(campaign)",
    "report_entities": "SELECT l_orderkey % 500 AS report_id, l_partkey AS entity FROM {lineitem}",
    "scored_candidates": "SELECT p_partkey AS technique, CAST(p_partkey * 37 % 100 AS DOUBLE) / 100 AS similarity, p_size % 3 = 1 AS keyword_match, p_size > 25 AS is_sub, CASE WHEN p_size = 8 THEN NULL ELSE p_type END AS tactic FROM {part}",
    "scored_hits": "SELECT p_partkey AS technique, p_brand AS family, p_size > 25 AS is_sub, CAST(1 AS DOUBLE) / (1 + p_partkey % 50) AS score FROM {part}",
    "synonym_groups": "SELECT * FROM (VALUES ('the', 'article'), ('And', 'conjunction'), ('tion', 'suffix'), ('that', 'pronoun'), ('that', 'article')) AS v(word, synonym)",
    "validation_messages": "SELECT doc_id AS message_id, text FROM {documents}",
    "error_rules": "SELECT * FROM (VALUES (1, 'the', 'schema'), (2, 'und', 'reference'), (3, 'que', 'value'), (3, 'qui', 'range')) AS v(ord, phrase, class)",
    "rule_files": """SELECT CAST(p_partkey AS VARCHAR(20)) AS path, concat('# rule', chr(10), CASE WHEN p_size % 17 = 0 THEN '' ELSE concat('title: ', p_name, chr(10)) END, 'id: r-', CAST(p_partkey AS VARCHAR(20)), '   # own', chr(10), 'status: ', CASE p_size % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'test' WHEN 2 THEN 'broken' ELSE 'experimental' END, chr(10),
      'tags:', chr(10), CASE WHEN p_size % 2 = 0 THEN '  - attack.execution' ELSE '- attack.execution' END, chr(10), CASE WHEN p_size % 2 = 0 THEN '  - ' ELSE '- ' END, 'attack.t1', lpad(CAST(p_size AS VARCHAR(9)), 3, '0'), chr(10), 'logsource: ', chr(123), 'product: ', CASE p_size % 3 WHEN 0 THEN 'windows, service: sysmon' WHEN 1 THEN 'nginx' ELSE 'Linux' END, chr(125), chr(10),
      'detection:', chr(10), '  sel_a:', chr(10), '    Image|endswith: "cmd.exe"', chr(10), '    Brand:', chr(10), '      - ', chr(39), p_brand, chr(39), chr(10), '  filter_b:', chr(10), '    - Type: "', p_type, '"', chr(10), '    - Size: ', CAST(p_size AS VARCHAR(9)), chr(10), '  condition: ', CASE WHEN p_size % 5 = 0 THEN 'sel_a and not sel_z' ELSE 'sel_a and not (1 of filter_*)' END, chr(10),
      'description: >', chr(10), '  two lines: one', chr(10), '  and another', chr(10), 'level: ', CASE WHEN p_size > 40 THEN 'urgent' ELSE 'high' END, chr(10), 'license: ', CASE WHEN p_size % 7 = 0 THEN 'Own' ELSE 'mit license' END, chr(10)) AS text FROM {part}""",
    "embedded": "SELECT vec_id, embedding, label FROM {embeddings}",
    "words": "SELECT item_id, text FROM {benchmark}",
}


def frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base or logical table at a scale."""
    known = {} if known is None else known
    if name not in known:
        if name in BASE:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            known[name] = spark.sql(VIEWS[name], **{t: frame(spark, sf_dir, t, known) for t in dict.fromkeys(_TABLE.findall(VIEWS[name]))})
    return known[name]


def prelude(names: list[str]) -> str:
    """WITH clause that defines the logical tables among the names."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for t in _TABLE.findall(VIEWS[name]):
                visit(t)
            order.append(name)

    for n in names:
        visit(n)
    return ", ".join(f"{n} AS ({_TABLE.sub(r'\1', VIEWS[n])})" for n in order).replace("explode(sequence(", "unnest(generate_series(")


def oracle(names: list[str], text: str) -> str:
    """DuckDB SQL of a text that reads the named tables."""
    with_ = prelude(names)
    return f"WITH {with_}{', ' if with_ else ''}result AS ({text}) SELECT * FROM result"
