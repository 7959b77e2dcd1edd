"""Registered queries that choose among texts, pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm import centroids, resample, url_filter
from quantframe.llm.common import documents, read, shared

SEED, PERCENT = 2024, 10


def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    gain = resample.gains(
        resample.bucket_counts(docs), resample.bucket_counts(read(spark, folder, "benchmark"))
    )
    w = F.col("importance")
    scored = shared(
        resample.with_weights(docs, gain).select(
            "doc_id",
            w["n_features"].alias("n_features"),
            w["n_words"].alias("n_words"),
            w["weight"].alias("weight"),
            (w["weight"] + resample.perturbation(F.col("doc_id"), SEED)).alias("score"),
        ),
        "resample",
    )
    drawn = resample.draw(scored, "score", "doc_id", F.col("n_words") >= resample.MIN_WORDS, PERCENT)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 from its polynomial: a table of 256 registers, then one step a byte.
OP11_SQL = r"""
with recursive steps as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t
),
words as materialized (
  select 0 as side, row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 1, 0, null, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
),
dealt as materialized (select side, row, unnest(w) as word from words),
spelled as (select distinct word, hex(encode(word)) as h from dealt),
bucket_of as materialized (
  select word, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i:
      (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 as bucket
  from spelled, steps
),
counts as (
  select bucket, count(*) filter (side = 0)::double as s, count(*) filter (side = 1)::double as t
  from dealt join bucket_of using (word) group by bucket
),
totals as (select coalesce(sum(s), 0) + 10000 as s_all, coalesce(sum(t), 0) + 10000 as t_all from counts),
gain as (
  select bucket, floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all)))::bigint as g from counts, totals
),
weighed as (
  select row, sum(g)::bigint as weight
  from dealt join bucket_of using (word) join gain using (bucket) where side = 0 group by row
),
scored as (
  select row, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
      / 4294967296))))::bigint as score
  from words left join weighed using (row) where side = 0
),
ranked as (
  select row, row_number() over (order by score desc, doc_id nulls first, row) as place,
    10 * count(*) over () // 100 as k
  from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= k then place end::bigint as rank
from scored left join ranked using (row)
"""

RULES = [
    ("net", "/", url_filter.BLOCK),
    ("example.net", "/en/", url_filter.ALLOW),
    ("example.com", "/de/", url_filter.BLOCK),
    ("org", "/fr/", url_filter.ALLOW),
]


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select(F.col("page_id").cast("bigint"), "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    f = F.col("filtered")
    return url_filter.with_verdict(pages, rules).select(
        "page_id", *[f[c].alias(c) for c in ("host", "path", "rule", "verdict")]
    )


OP12_SQL = (
    r"""
with rules(rule_host, rule_path, action) as (values """
    + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    + r"""),
parted as (
  select row_number() over () as row, page_id::bigint as page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages
),
best as (
  select row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(action, length(rule_host || rule_path)) as action
  from parted join rules on (host = rule_host or ends_with(host, '.' || rule_host))
    and starts_with(path, rule_path)
  group by row
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict
from parted left join best using (row)
"""
)

CLUSTERS, ROUNDS, FIRST_SEED, DIMS = 40, 5, 2, 64


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").cast("bigint"), "embedding")
    found, last = centroids.cluster_vectors(rows, CLUSTERS, ROUNDS, FIRST_SEED, DIMS)
    c = F.col("clustered")
    found = found.select("vec_id", c["cluster"].alias("cluster"), c["distance"].alias("distance"))
    sums = centroids.inertia(found, last)
    return found.join(sums, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op13_sql() -> str:
    nearest = """
d{r} as materialized (
  select row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as d
  from v join c{r} c using (pos) group by row, c.cluster
),
a{r} as materialized (
  select row, cluster, d as distance from d{r} qualify row_number() over (partition by row order by d, cluster) = 1
)"""
    means = """,
m{r} as (
  select cluster, pos, sum(x)::bigint as s, count(*) as n from a{r} join v using (row) group by cluster, pos
),
c{n} as materialized (
  select c.cluster, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.x)::bigint as x
  from c{r} c left join m{r} m on m.cluster = c.cluster and m.pos = c.pos
),"""
    rounds = "".join(nearest.format(r=r) + means.format(r=r, n=r + 1) for r in range(ROUNDS))
    return f"""
with kept as materialized (
  select row_number() over () as row, vec_id::bigint as vec_id,
    list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as e
  from embeddings
  where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}
),
v as materialized (
  select row, generate_subscripts(e, 1) as pos, unnest(e) as x from kept
),
firsts as (
  select row, row_number() over (order by sha256('{FIRST_SEED}:' || coalesce(vec_id::varchar, '')), e) - 1 as cluster
  from kept
),
c0 as materialized (
  select cluster, pos, x from firsts join v using (row) where cluster < {CLUSTERS}
),{rounds}{nearest.format(r=ROUNDS)},
shown as (
  select cluster, sha256(string_agg(x::varchar, ',' order by pos)) as centroid_sha256 from c{ROUNDS} group by cluster
)
select vec_id, cluster::int as cluster, distance,
  (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256
from a{ROUNDS} join kept using (row) join shown using (cluster)
"""


QUERIES = {
    "op11_resample": op11_resample,
    "op12_url_filter": op12_url_filter,
    "op13_centroids": op13_centroids,
}
ORACLES = {"op11_resample": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_centroids": _op13_sql()}
