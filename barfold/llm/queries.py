"""Queries over the whole documents, pages, benchmark and conversations tables, beside DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.llm import bpe, centroids, chat, chosen_path, decontaminate, divergence, kd_shards, line_runs, mixing, randomness, resample, tokenfile, url_tree
from barfold.llm.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(column: str) -> str:
    """DuckDB: A-Z to a-z and nothing else."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op1_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


ORACLES["op1_wu_manber"] = f"""
WITH i AS (
  SELECT item_id, regexp_extract_all({lowered("text")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all({lowered("text")}, '{_ALNUM}'), []) AS w FROM documents
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, item_id, k, s FROM dw JOIN win USING (k, p)
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    docs = table(spark, sf_dir, "documents")
    tokenfile.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("raw").alias("ids_crc32"))


@query
def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.drop("text", "lang")


@query
def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_chosen_path"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({lowered("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id
"""


@query
def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


ORACLES["op8_snapshot_collapse"] = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT conv_id, row_number() OVER w AS k,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w AS prefix,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), n AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(rendered) AS rendered, any_value(n_turns) AS n_turns
  FROM n WHERE k = n_turns GROUP BY 1
)
SELECT conv_id, n_turns, n_equal, rendered FROM whole
WHERE prefix NOT IN (SELECT prefix FROM n WHERE k < n_turns)
"""


@query
def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


RULES = [
    url_tree.Rule("net", "/", False),
    url_tree.Rule("example.net", "/en/", True),
    url_tree.Rule("example.com", "/de/", False),
    url_tree.Rule("org", "/fr/", True),
]


@query
def op4_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_tree.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.withColumn("purity", F.round("purity", 6))


def _templates_sql() -> str:
    """The same tree, one set of tables for each level, down to ten segments."""
    fits = []
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.allow)):
        fits.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'")
    allowed = ", ".join(f"'{r.name}'" for r in RULES if r.allow)
    d = 10

    def unlike(x: str, n: str, whole: str, total: str) -> str:
        share = f"({whole}::DOUBLE / {total})"
        up = f"CASE WHEN {x} > 0 THEN {x} * ln({x} / ({n} * {share})) ELSE 0 END"
        down = f"CASE WHEN {n} > {x} THEN ({n} - {x}) * ln(({n} - {x}) / ({n} * (1 - {share}))) ELSE 0 END"
        return f"coalesce({up} + {down} > ln(2 * vals / {url_tree.LEVEL}), false)"

    parts = [
        f"""r AS (
  SELECT page_id, {lowered("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), q AS (
  SELECT *, CASE {" ".join(fits)} END AS rule FROM r
), p AS (
  SELECT host, path, count(*) AS n, count(rule) AS m, count(*) FILTER (WHERE rule NOT IN ({allowed})) AS bad,
    string_split(path, '/') AS seg FROM q GROUP BY host, path
), t0 AS MATERIALIZED (
  SELECT host, path, n, m, bad, '' AS template,
    seg FROM p
)"""
    ]
    sums = "sum(n) AS n, sum(m) AS m, sum(bad) AS bad"
    for k in range(1, d + 1):
        parts.append(
            f"""b{k} AS (
  SELECT host, template, seg[{k + 1}] AS s, {sums} FROM t{k - 1} WHERE len(seg) > {k} GROUP BY ALL
), a{k} AS (
  SELECT host, template, count(*) AS vals, sum(n) AS an, sum(m) AS am, sum(bad) AS ab FROM b{k} GROUP BY ALL
), s{k} AS (
  SELECT host, template, s, CASE WHEN {unlike("m", "n", "am", "an")} OR {unlike("bad", "m", "ab", "am")} THEN s ELSE '*' END AS shown
  FROM b{k} JOIN a{k} USING (host, template)
), t{k} AS MATERIALIZED (
  SELECT t.host, path, n, m, bad, CASE WHEN len(seg) > {k} THEN t.template || '/' || shown ELSE t.template END AS template, seg
  FROM t{k - 1} t LEFT JOIN s{k} s ON t.host = s.host AND t.template = s.template AND t.seg[{k + 1}] = s.s
)"""
        )
    return f"""
WITH {", ".join(parts)}, o AS (
  SELECT coalesce(sum(bad) / sum(m), 0) AS share FROM p
), j AS (
  SELECT host, template, sum(m) AS m, (sum(bad) + {url_tree.PRIOR_WEIGHT}::DOUBLE * any_value(share)) / (sum(m) + {url_tree.PRIOR_WEIGHT}) AS purity
  FROM t{d}, o GROUP BY ALL
)
SELECT page_id, q.host, q.path, rule,
  CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN j.m >= {url_tree.LEAST_LABELS} AND purity >= {url_tree.REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict,
  j.template, round(purity, 6) AS purity
FROM q JOIN t{d} t ON q.host = t.host AND q.path = t.path JOIN j ON j.host = t.host AND j.template = t.template
"""


ORACLES["op4_path_templates"] = _templates_sql()


@query
def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = randomness.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = F.array(*[F.lit(k) for k in randomness.KINDS])
    base = F.filter("secrets", lambda s: s["kind"] < len(randomness.PATTERNS))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{randomness.KINDS[k]}")

    counts = [count(k) for k in range(len(randomness.PATTERNS))]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


@query
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


@query
def op11_incremental_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def _centroids_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """One pair of tables for each round: the assignment, and the centroids after it."""
    parts = [
        f"""e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x AS p FROM e ORDER BY sha256('3:' || vec_id) LIMIT {k}
)"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, list_sum(list_transform(list_zip(x, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{n}) GROUP BY r
)"""
        )
        if n < rounds:
            parts.append(
                f"""s{n} AS (
  SELECT c, i, sum(v) AS s, count(*) AS m FROM (SELECT a{n}.c, unnest(x) AS v, unnest(range({width})) AS i FROM a{n} JOIN e USING (r)) GROUP BY ALL
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(q, p) AS p FROM c{n} LEFT JOIN (
    SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS q FROM s{n} GROUP BY c
  ) m ON m.c = c{n}.c
)"""
            )
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


ORACLES["op11_incremental_distances"] = _centroids_sql()


@query
def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op12_line_runs"] = f"""
WITH l AS (
  SELECT r, doc_id, pos, line, {lowered("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (
    SELECT r, doc_id, unnest(w) AS line, unnest(range(len(w))) AS pos
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)
  )
), k AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE l.doc_id > first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR l.doc_id = first), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.key = k.key GROUP BY r, l.doc_id
"""


@query
def op13_quickselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
