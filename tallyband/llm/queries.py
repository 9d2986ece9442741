"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyband.llm import byte_bpe, byte_gru, lattice_lm, lsm_dedup, mean_sorted_clusters, mixture, pii_spans, pivot_index, prefix_trie, rule_ensemble, simhash_pivots, token_files, virtual_slots
from tallyband.llm.common import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice_lm.score_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), lattice_lm.training_part())
    return scored.select("doc_id", (~lattice_lm.training_part()).alias("held_out"), *scored.columns[1:])


def op2_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_gru.identified(table(spark, sf_dir, "documents"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.digest(pii_spans.find_spans(table(spark, sf_dir, "documents")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture.copies_in_mixture(docs, mixture.plan_mixture(mixture.token_counts(docs)))


def op9_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_mean_sorted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_sorted_clusters.clustered(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_byte_gru": op2_byte_gru,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_pivot_index": op4_pivot_index,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_pii_spans": op6_pii_spans,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_hierarchical_mixture": op8_hierarchical_mixture,
    "op9_lsm_dedup": op9_lsm_dedup,
    "op10_simhash_pivots": op10_simhash_pivots,
    "op11_token_files": op11_token_files,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_mean_sorted_clusters": op13_mean_sorted_clusters,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_lsm_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL["op4_pivot_index"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_SHARE = """
{name}_n AS (SELECT {path}, budget, sum(capacity)::BIGINT AS capacity FROM {src} GROUP BY {path}, budget),
{name}_w AS (SELECT *, {weight} AS w FROM {name}_n),
{name}_r AS (SELECT *,
    (budget - coalesce(sum(capacity) OVER f, 0))::BIGINT AS rest,
    (sum(w) OVER (PARTITION BY {parents}budget) - coalesce(sum(w) OVER f, 0))::BIGINT AS rest_w
  FROM {name}_w WINDOW f AS (PARTITION BY {parents}budget ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_l AS (SELECT *, capacity * rest_w >= rest * w AS fits,
    max(CASE WHEN capacity * rest_w >= rest * w THEN {{'rest': rest, 'w': rest_w}} END) OVER (PARTITION BY {parents}budget) AS lft FROM {name}_r),
{name}_g AS (SELECT {path}, CASE WHEN fits THEN (lft.rest * w) // lft.w ELSE capacity END AS given FROM {name}_l),
{name} AS (SELECT s.* EXCLUDE (budget), g.given AS budget FROM {src} s JOIN {name}_g g USING ({path}))
"""


def _mixture_sql(spec: mixture.Mixture) -> str:
    def weight(level: str) -> str:
        cases = "".join(f"WHEN '{k}' THEN {v} " for k, v in spec.weights.get(level, {}).items())
        return f"(CASE {level} {cases}ELSE 1 END)::BIGINT" if cases else "1::BIGINT"

    steps, src = [], "base"
    for depth, level in enumerate(mixture.LEVELS):
        parents = "".join(f"{x}, " for x in mixture.LEVELS[:depth])
        path = ", ".join(mixture.LEVELS[: depth + 1])
        steps.append(_SHARE.format(name=f"b{depth}", src=src, path=path, parents=parents, level=level, weight=weight(level)))
        src = f"b{depth}"
    domain = "CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]+$') THEN 'd' || (right(regexp_extract(source, '([0-9]+)$', 1), 9)::INT % 4)::VARCHAR ELSE '' END"
    return f"""
WITH counted AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
base AS (SELECT *, tokens * {spec.max_epochs} AS capacity, (SELECT (sum(tokens) * {spec.share}) // 100 FROM leaves)::BIGINT AS budget FROM leaves),
{", ".join(steps)},
plan AS (SELECT domain, lang, source, (budget // tokens)::INT AS epochs, budget % tokens AS part FROM {src} WHERE tokens > 0),
placed AS (SELECT c.*, p.epochs, p.part,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{spec.seed}', p.epochs::VARCHAR, coalesce(doc_id::VARCHAR, '')))) AS upto
  FROM counted c LEFT JOIN plan p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, coalesce(epochs, 0)::INT AS epochs,
    coalesce(epochs + CASE WHEN upto <= part THEN 1 ELSE 0 END, 0)::INT AS copies
FROM placed
"""


ORACLE_SQL["op8_hierarchical_mixture"] = _mixture_sql(mixture.PRODUCTION)

_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda d: ascii(d)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END))"""

ORACLE_SQL["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.BLOCK} AS base, xor({_CRC.format(x="conv_id::VARCHAR")}, 4294967295::BIGINT) % {prefix_trie.MOST_SHARED} AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
both_parts AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.base AND k <= h
    UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
r AS (SELECT conv_id, text, row_number() OVER w AS depth, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS path
    FROM both_parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, '', 0, '' FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved FROM r GROUP BY depth, path),
m AS (SELECT r.conv_id AS member, n.* FROM r JOIN n USING (depth, path)),
e AS (SELECT DISTINCT m.depth, m.conv_id, p.conv_id AS parent_conv_id FROM m LEFT JOIN m p ON p.member = m.member AND p.depth = m.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL),
below AS (SELECT DISTINCT a.depth, a.conv_id, d.depth AS d_depth, d.conv_id AS d_conv_id, d.saved FROM m a JOIN m d ON a.member = d.member AND d.depth >= a.depth),
sums AS (SELECT b.depth, b.conv_id, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
    FROM below b LEFT JOIN kids k ON k.depth = b.d_depth AND k.conv_id = b.d_conv_id GROUP BY ALL),
last AS (SELECT member, max(depth) AS depth FROM m GROUP BY member),
ends AS (SELECT m.depth, m.conv_id, string_agg(m.member::VARCHAR, ',' ORDER BY m.member) AS ids FROM m JOIN last USING (member, depth) GROUP BY ALL)
SELECT n.conv_id, n.depth, e.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM n JOIN e USING (depth, conv_id) JOIN sums s USING (depth, conv_id) LEFT JOIN kids k USING (depth, conv_id) LEFT JOIN ends x USING (depth, conv_id)
"""


def _clusters_sql(clusters: int, rounds: int, components: int, scale: int, seed: int) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.id, c.c, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, c{k} c) GROUP BY id)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i FROM a{k} a JOIN p USING (id)) GROUP BY c, i),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN m{k} m USING (c))""")
    end = f"""SELECT p.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c.x, lambda v: v::VARCHAR), ',')) AS centroid_sha256 FROM a{rounds} a JOIN p USING (id) JOIN c{rounds} c USING (c)"""
    return f"""
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {components}
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM v),
c0 AS (SELECT (row_number() OVER (ORDER BY key, x) - 1)::INT AS c, x FROM (SELECT x, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS key FROM p ORDER BY key, x LIMIT {clusters})),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) if x.startswith("a") else x for x in steps)}
{end}
"""


_c = mean_sorted_clusters
ORACLE_SQL["op13_mean_sorted_clusters"] = _clusters_sql(_c.CLUSTERS, _c.ROUNDS, _c.COMPONENTS, _c.SCALE, _c.SEED)
