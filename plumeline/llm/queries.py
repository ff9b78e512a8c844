"""The queries of this subpackage over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumeline.llm import (
    bpe_codec, collocations, decontaminate, graph_search, hard_negatives, quality_fm, secret_ledger, sharding, simhash_dedup, source_mix,
    substring_dedup, token_store, toxicity,
)
from plumeline.session import scratch_path, staged

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The definition of a public tokenizer; tasks get its text, so no path has to exist on executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digest(substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), 50))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_read(spark, sf_dir, "documents"), tokenizer_json())


def op4_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    index = staged(graph_search.build_index(vectors), "graph_index")
    return graph_search.nearest(index, vectors.filter("vec_id % 100 = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(toxicity.fold("doc_id", 5) != 0))
    return _predicted(toxicity.score(docs, model), toxicity.fold("doc_id", 5) == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    machine = quality_fm.train(docs, labels.filter(toxicity.fold("doc_id", 3) != 1))
    return _predicted(quality_fm.score(docs, machine), toxicity.fold("doc_id", 3) == 1)


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_ledger.update_ledger(versions, scratch_path(spark, "ledger"))
    return secret_ledger.digest(secret_ledger.findings(versions, ledger)).drop("blob")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(hard_negatives.usable(_read(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_codec.Vocabulary(tokenizer_json())
    return bpe_codec.digest(bpe_codec.decode(bpe_codec.encode(_read(spark, sf_dir, "documents"), vocabulary), vocabulary))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_decontamination, op3_token_store, op4_graph_search, op5_toxicity, op6_quality,
        op7_source_mix, op8_sharding, op9_simhash, op10_secret_ledger, op11_hard_negatives, op12_collocations, op13_bpe_codec,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL = {
    "op1_substring_dedup": f"""
WITH split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, p, sha256(array_to_string(list_slice(w, p, p + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split WHERE len(w) >= 50)),
least_doc AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS g, count(*) FILTER (gap) AS n
  FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS gap
        FROM windows JOIN least_doc USING (h) WHERE d < doc_id)
  GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' ')) AS kept_sha256,
  coalesce(n, 0)::INT AS n_intervals
FROM split s LEFT JOIN gone USING (doc_id)
""",
    "op7_source_mix": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
  FROM rows GROUP BY source),
filled AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(remaining::DOUBLE / open) AS level FROM filled WHERE cap / weight >= remaining::DOUBLE / open),
targets AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM filled, level),
placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(budget - epochs * source_size - start, 0)))::BIGINT AS taken
FROM cut
""",
    "op11_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""",
    "op12_collocations": r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) t(k) WHERE len(w) >= k)),
frequent AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
cuts AS (SELECT lang, k, g, f, unnest(range(1, k)) AS c FROM frequent WHERE k > 1),
scored AS (
  SELECT c.lang, c.g, c.k, c.f AS a, c.c, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.c)
  JOIN frequent y ON y.lang = c.lang AND y.g = list_slice(c.g, c.c + 1, c.k)),
weakest AS (SELECT *, array_to_string(g, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT lang, part, max(f) AS most
  FROM (SELECT lang, f, list_slice(g, i, i + s - 1) AS part
        FROM (SELECT lang, f, g, k, s, unnest(range(1, k - s + 2)) AS i FROM frequent, range(2, 4) t(s) WHERE k > s))
  GROUP BY lang, part)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest w JOIN totals USING (lang) LEFT JOIN inside p ON p.lang = w.lang AND p.part = w.g
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
QUALIFY rank <= 2000
""",
}
