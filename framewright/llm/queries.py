"""The subpackage's queries on the provided tables, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import chat_views, collocations, decontaminate, mixing, near_dedup, pseudo_likelihood, quality_classifier, quality_rules, secrets, token_counts, toxicity, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.views(_table(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_table(spark, sf_dir, "documents"))


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality_classifier.train(docs, labels.where(~quality_classifier.held_out()))
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op7_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op10_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(_table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op9_quality_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v2")
    base_failed = F.col("failures").bitwiseAND(F.lit(quality_rules.mask(quality_rules.POLICIES["base"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "n_lines", "failures")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~toxicity.held_out())))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_windows")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_secret_scan": op3_secret_scan,
    "op4_sainte_lague_mix": op4_sainte_lague_mix,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_masked_pseudo_likelihood": op7_masked_pseudo_likelihood,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_rule_ledger": op9_quality_rule_ledger,
    "quality_rule_ablations": quality_rule_ablations,
    "op10_warc_index_merge": op10_warc_index_merge,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Each round of op13 in SQL: nearest entries (ties to the lower index) of the parts x.q by the books b0, b1, ...
_ROUNDS = ",\n".join(
    f"""a{k} AS MATERIALIZED (SELECT row, part, q, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.row, x.part, x.q, b.entry, list_sum(list_transform(list_zip(x.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} b ON x.part = b.part) GROUP BY row, part, q)"""
    + (
        f""",
s{k} AS (SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS v FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(floor_div ORDER BY i) AS q FROM (SELECT part, entry, i, CASE WHEN s % n <> 0 AND s < 0 THEN s // n - 1 ELSE s // n END AS floor_div FROM s{k}) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""
        if k < 4
        else ""
    )
    for k in range(5)
)

ORACLE_SQL = {
    "op11_phrase_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, array_to_string(ws[p:p + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS p FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
    "op13_vector_codes": f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row FROM e
      WHERE v IS NOT NULL AND len(v) > 0 AND len(v) % 4 = 0 AND len(list_filter(v, lambda c: c IS NULL OR isnan(c) OR isinf(c) OR abs(c) >= 65536)) = 0),
r AS (SELECT *, len(v) // 4 AS width, list_transform(v, lambda c: floor(1024 * c)::BIGINT) AS w FROM u WHERE len(v) = (SELECT arg_min(len(v), row) FROM u)),
k AS (SELECT *, row_number() OVER (ORDER BY row) AS place FROM r),
x AS MATERIALIZED (SELECT row, place, part, w[part * width + 1:(part + 1) * width] AS q FROM k CROSS JOIN (VALUES (0), (1), (2), (3)) AS p(part)),
b0 AS MATERIALIZED (SELECT part, place - 1 AS entry, q FROM x WHERE place <= 256),
{_ROUNDS},
h AS (SELECT sha256(array_to_string(flatten(list(q ORDER BY part, entry)), ',')) AS codebooks_sha256 FROM b4),
f AS (SELECT row, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY row)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k ON k.row = f.row CROSS JOIN h""",
    "op2_chat_perspectives": r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.conv_id, p.perspective, m.turn, m.speaker, m.text, CASE WHEN m.speaker = 'system' THEN 'system' WHEN m.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM m JOIN p ON m.conv_id = p.conv_id),
h AS (SELECT *, '<|' || chat_role || '|>' || CASE WHEN chat_role = 'user' THEN ' ' || speaker ELSE '' END || chr(10) AS head FROM r),
t AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS place, sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop FROM t
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text))
SELECT conv_id, perspective, place, turn, speaker, chat_role, rendered, stop - length(rendered) AS start, stop,
       CASE WHEN chat_role = 'assistant' THEN stop - length(rendered) + length(head) ELSE stop END AS mask_start, stop AS mask_stop FROM o""",
    "op10_warc_index_merge": r"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
             regexp_extract(url, '^(.*?)://([^/?#]*)(.*)$', 2) AS host, regexp_extract(url, '^(.*?)://([^/?#]*)((.|
)*)$', 3) AS rest FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest ELSE url END AS urlkey,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 315360000), '%Y%m%d%H%M%S') AS captured FROM f""",
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id""",
    "op8_benchmark_decontamination": rf"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
q AS (
  SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM q) AS ks)),
m AS (SELECT w.doc_id, w.p, w.k, q.item FROM w JOIN q ON w.g = q.g AND w.k = q.k),
h AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_quality_rule_ledger": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
p AS (SELECT DISTINCT doc_id, i + j AS pos FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
             + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, n_lines, failures FROM f""",
}

_CASES = ", ".join(f"('{v}', '{r}', {quality_rules.mask(rules)}, {1 << quality_rules.RULES.index(r)})" for v, rules in quality_rules.POLICIES.items() for r in rules)
ORACLE_SQL["quality_rule_ablations"] = f"""
WITH l AS ({ORACLE_SQL["op9_quality_rule_ledger"]}), c AS (SELECT * FROM (VALUES {_CASES}) AS v(policy, rule, mask, bit))
SELECT policy, rule, count(*) FILTER (failures & mask & bit <> 0) AS fails, count(*) FILTER (failures & mask = bit) AS fails_alone, count(*) FILTER ((failures & mask) | bit = bit) AS kept_without
FROM l CROSS JOIN c GROUP BY policy, rule"""
