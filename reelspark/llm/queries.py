"""The numbered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import alignment, byte_bpe, fingerprint, flac, language_id, license_scan, ngram_join, packing, periodic_runs, substring_dedup, toxicity, url_rules, warc
from reelspark.llm.common import held_out, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Notices and openings of public licenses, as they stand in texts.
LICENSES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Reserved", "All rights reserved."),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.drop("ids")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out())
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), held_out())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), spark.createDataFrame(LICENSES, "template_id string, text string"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_join": op4_ngram_join,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_media": op8_media,
    "op9_license_scan": op9_license_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_alignment": op11_alignment,
    "op12_warc": op12_warc,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op12_warc": """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
""",
    # pairs of equal windows of 16 words, q apart, in one text; islands of them are runs of period q or of a divisor of q
    "op13_periodic_runs": r"""
WITH RECURSIVE crc_steps(byte, crc, step) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT byte, CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384::UBIGINT) ELSE crc // 2 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS (
  SELECT list(crc ORDER BY byte) AS crcs FROM crc_steps WHERE step = 8
), hashed AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda x, y: xor(x // 256, crcs[(xor(x, y) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents, crc_table
), texts AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM hashed
), placed AS (
  SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN g % len(words) END AS a FROM texts
), periods AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE words END AS words FROM periods
), listed AS (
  SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM planted
), windows AS (
  SELECT doc_id, n, pos, md5(string_agg(word, ' ') OVER w) AS content, count(*) OVER w AS size
  FROM listed WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)
), pairs AS (
  SELECT x.doc_id, x.pos, y.pos - x.pos AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.content = y.content AND x.pos < y.pos
  WHERE x.size = 16 AND y.size = 16 AND 3 * (y.pos - x.pos) <= x.n
), islands AS (
  SELECT doc_id, q, pos, pos - row_number() OVER (PARTITION BY doc_id, q ORDER BY pos) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(pos) AS start, count(*) + 15 + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), listing AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, start, q) AS place FROM runs
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS pos FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words FROM listed ANTI JOIN dropped USING (doc_id, pos) GROUP BY doc_id
)
SELECT planted.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period,
       (1000 * length // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM planted LEFT JOIN listing USING (doc_id) LEFT JOIN best ON best.doc_id = planted.doc_id AND place = 1 LEFT JOIN kept ON kept.doc_id = planted.doc_id
""",
    # doc_id tells documents apart
    "op4_ngram_join": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), windows AS (
  SELECT doc_id, string_agg(word, ' ') OVER w AS shingle, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), sets AS (
  SELECT DISTINCT doc_id, shingle FROM windows WHERE n = 3
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM texts WHERE len(words) IN (1, 2)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM texts UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)
""",
    "op2_substring_dedup": r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER w AS content, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY content) AS times FROM windows WHERE n = 35) WHERE times > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM repeated, (SELECT unnest(generate_series(0, 34)) AS k)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
""",
    "op3_url_filters": r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fit ON parts.page_id = fit.page_id
""",
}
