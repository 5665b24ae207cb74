"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.byte_bpe import byte_bpe
from colloquy.llm.collocations import collocations
from colloquy.llm.common import remainder, table
from colloquy.llm.exact_dedup import exact_duplicates
from colloquy.llm.html_extraction import main_text
from colloquy.llm.lattice_lm import lattice_scores
from colloquy.llm.merkle import merkle_manifest
from colloquy.llm.mixing import mix
from colloquy.llm.quality import quality
from colloquy.llm.simhash import simhash_components
from colloquy.llm.token_counts import token_counts
from colloquy.llm.topk import top_k
from colloquy.llm.toxicity import toxicity
from colloquy.llm.url_filter import DAMPING, LEAST, ROUNDS, THRESHOLD, url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


MIX_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, row_number() OVER w AS place,
    sum(source_size) OVER () AS total, sum(weight) OVER () - sum(weight) OVER w AS open_weight,
    sum(3 * source_size) OVER w AS full_size
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
-- The factor after the first n sources are full is right if the next is not below it.
factors AS (
  SELECT 0 AS place, (max(total)::DOUBLE / sum(weight)::DOUBLE) AS factor FROM filled
  UNION ALL
  SELECT place, (total - full_size)::DOUBLE / open_weight::DOUBLE FROM filled WHERE open_weight > 0),
factor AS (
  SELECT factor FROM factors f LEFT JOIN filled n ON n.place = f.place + 1
  WHERE n.place IS NULL OR 3 * n.source_size > n.weight * factor ORDER BY f.place LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size <= weight * factor THEN (3 * source_size)::DOUBLE ELSE factor * weight END AS target
  FROM sources, factor),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN target - copies * source_size ELSE 0 END AS budget FROM plan),
sums AS (
  SELECT d.source, d.hash, sum(d.size) AS words, any_value(budget) AS budget,
    sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.hash) AS reached
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source WHERE budget > 0 GROUP BY d.source, d.hash),
cuts AS (
  SELECT source, hash + CASE WHEN (budget - (reached - words)) * 2 >= words THEN 1 ELSE 0 END AS threshold
  FROM sums WHERE reached >= budget AND reached - words < budget)
SELECT d.doc_id, d.source, d.size, b.source_size, b.target,
  (d.size * (b.copies + CASE WHEN d.hash < coalesce(c.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source"""


@query(MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("""
WITH docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM docs WINDOW same AS (PARTITION BY body)""")
def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.selectExpr("doc_id", "held_out", "score", "predicted", "size(passages) AS n_passages")


@query()
def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op6_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def _url_sql(rounds: int) -> str:
    absolute = "'(?s)^.*?://([^/?#]*)([^?#]*)'"

    def host(url: str) -> str:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return f"translate(coalesce(regexp_extract({url}, {absolute}, 1), ''), '{upper}', '{lower}')"

    scores = "".join(
        f""",
s{n + 1} AS MATERIALIZED (
  SELECT h.host,
    {1 - DAMPING!r} * h.good + {DAMPING} * coalesce((SELECT sum(s.trust / o.sent * l.links)
      FROM links l JOIN s{n} s ON s.host = l.src JOIN hosts o ON o.host = l.src WHERE l.dst = h.host), 0) AS trust,
    {1 - DAMPING!r} * h.bad + {DAMPING} * coalesce((SELECT sum(s.distrust / o.received * l.links)
      FROM links l JOIN s{n} s ON s.host = l.dst JOIN hosts o ON o.host = l.dst WHERE l.src = h.host), 0) AS distrust
  FROM hosts h)"""
        for n in range(rounds)
    )
    return f"""
WITH judged AS MATERIALIZED (
  SELECT page_id, {host("url")} AS host, coalesce(regexp_extract(url, {absolute}, 2), '') AS path, html FROM pages),
ruled AS MATERIALIZED (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM judged),
hrefs AS (
  SELECT host, unnest(regexp_extract_all(coalesce(html, ''),
    '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]*)', 1)) AS raw FROM judged WHERE host <> ''),
full_hrefs AS (SELECT host, CASE WHEN starts_with(raw, '//') THEN 'http:' || raw ELSE raw END AS href FROM hrefs),
edges AS (
  SELECT host AS src, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN {host("href")}
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN NULL ELSE host END AS dst
  FROM full_hrefs
  UNION ALL SELECT DISTINCT host, host FROM judged WHERE host <> ''),
links AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM edges WHERE dst <> '' GROUP BY src, dst),
seeds AS (
  SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 ELSE 0 END) AS good,
    avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0 ELSE 0 END) AS bad
  FROM ruled WHERE host <> '' GROUP BY host),
sent AS (SELECT src AS host, sum(links) AS sent FROM links GROUP BY src),
received AS (SELECT dst AS host, sum(links) AS received FROM links GROUP BY dst),
hosts AS MATERIALIZED (
  SELECT host, sent, received, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM sent FULL JOIN received USING (host) FULL JOIN seeds USING (host)),
s0 AS MATERIALIZED (SELECT host, good AS trust, bad AS distrust FROM hosts){scores}
SELECT page_id, r.host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN s.distrust > {LEAST!r} AND s.distrust > {THRESHOLD} * (s.distrust + s.trust) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN s{rounds} s ON s.host = r.host"""


@query(_url_sql(ROUNDS))
def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


@query()
def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, half a byte at a time; the 16 remainders follow from the polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    halves = f"list_transform(flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4])), lambda x: x::BIGINT)"
    step = f"lambda crc, half: xor(crc >> 4, {table}[(xor(crc, half) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), {step}), 4294967295::BIGINT)"


def _merkle_fields(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce(':' || source, '') AS tree, {_merkle_fields("text")} AS leaf,
    CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_merkle_fields("replace(text, chr(10), '')")}
      ELSE {_merkle_fields("text")} END AS other
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS total FROM leaves),
inner_nodes AS (
  SELECT tree, 0 AS height, place, total, leaf AS node FROM placed
  UNION ALL
  SELECT tree, height + 1, place // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM inner_nodes WHERE total > 1 GROUP BY tree, height, place // 3),
tops AS MATERIALIZED (
  SELECT tree, height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total
  FROM inner_nodes WHERE total = 1),
outer_nodes AS (
  SELECT 0 AS height, place, total, subroot AS node FROM tops
  UNION ALL
  SELECT height + 1, place // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM outer_nodes WHERE total > 1 GROUP BY height, place // 3),
beside AS MATERIALIZED (
  SELECT 0 AS part, tree, height, place,
    coalesce(lag(node, 2) OVER w, '') || coalesce(lag(node) OVER w, '') AS before,
    coalesce(lead(node) OVER w, '') || coalesce(lead(node, 2) OVER w, '') AS after
  FROM inner_nodes WHERE total > 1 WINDOW w AS (PARTITION BY tree, height, place // 3 ORDER BY place)
  UNION ALL
  SELECT 1, NULL, height, place,
    coalesce(lag(node, 2) OVER w, '') || coalesce(lag(node) OVER w, ''),
    coalesce(lead(node) OVER w, '') || coalesce(lead(node, 2) OVER w, '')
  FROM outer_nodes WHERE total > 1 WINDOW w AS (PARTITION BY height, place // 3 ORDER BY place)),
paths AS MATERIALIZED (
  SELECT p.id, b.height AS step, b.before, b.after FROM placed p JOIN beside b
    ON b.part = 0 AND b.tree = p.tree AND b.place = p.place // (3 ** b.height)::BIGINT
  UNION ALL
  SELECT p.id, t.height + b.height, b.before, b.after FROM placed p JOIN tops t USING (tree) JOIN beside b
    ON b.part = 1 AND b.place = t.place // (3 ** b.height)::BIGINT),
folded AS (
  SELECT id, 0 AS step, other AS node FROM placed
  UNION ALL
  SELECT f.id, f.step + 1, sha256(p.before || f.node || p.after) FROM folded f JOIN paths p ON p.id = f.id AND p.step = f.step),
ends AS (SELECT id, max_by(node, step) AS folded_root FROM folded GROUP BY id),
proofs AS (SELECT id, string_agg(before || after, '' ORDER BY step) AS proof FROM paths GROUP BY id),
root AS (SELECT node AS root FROM outer_nodes WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN tops USING (tree) JOIN ends USING (id) LEFT JOIN proofs USING (id), root"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, folded from a copy in which half of the texts lost their line ends."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proved = merkle_manifest(docs, altered=tampered, proofs=False)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"), blocks=False, carry=True)
    return found.select("page_id", "doc.url", "text", "n_chars")


COLLOCATION_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (
  SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM numbered),
grams AS (
  SELECT lang, w, w || ' ' || lead(w) OVER p AS w2, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS w3
  FROM places WINDOW p AS (PARTITION BY piece ORDER BY place)),
counts AS MATERIALIZED (
  SELECT lang, w AS phrase, 1 AS size, count(*) AS f FROM grams GROUP BY ALL
  UNION ALL SELECT lang, w2, 2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w3, 3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase, f FROM counts WHERE size = 3
  UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), f FROM counts WHERE size = 3),
candidates AS (
  SELECT lang, phrase, size, f AS a FROM counts c WHERE size > 1
    AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 50 * c.f)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lft,
    array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS rgt
  FROM candidates, (VALUES (1), (2)) AS cut(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lft JOIN counts y ON y.lang = c.lang AND y.phrase = c.rgt),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query(COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
