"""Schema, text, sampling, clustering and object-path queries, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edit_distance as distance
from ..functions.text import joined_key, padded_id
from ..operators import cluster, indexing, sampling, schema
from ..sources import objects
from ..sources.tables import table


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nested records, with names that collide but for case and a column without values."""
    c = table(spark, d, "customer")
    seg = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return c.select(
        F.struct("c_custkey", "c_name", F.struct(seg.alias("segment"), F.array("c_name", "c_mktsegment").alias("tags")).alias("market")).alias("who"),
        F.concat(F.lit("alt "), "c_mktsegment").alias("WHO_market_segment"),
        F.struct(F.col("c_acctbal").alias("bal"), F.lit(None).cast("string").alias("note")).alias("acct"),
    )


def flatten_schema(spark: SparkSession, d: str) -> DataFrame:
    paths = [(".".join(p), kind) for kind in ("string_array", "all") for p in schema.flatten_schema(table(spark, d, "agent_states").schema, kind)]
    return spark.createDataFrame(paths, "path string, leaf_types string")


def flatten_df(spark: SparkSession, d: str) -> DataFrame:
    return schema.flatten_df(_nested(spark, d)).withColumn("who_market_tags", F.concat_ws(",", "who_market_tags"))


def flatten_df_all(spark: SparkSession, d: str) -> DataFrame:
    return schema.flatten_df(_nested(spark, d), "all", keep_merged=True).drop("who_market_tags")


def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return schema.null_profile(schema.flatten_df(table(spark, d, "agent_states"), "all"))


def drop_all_null(spark: SparkSession, d: str) -> DataFrame:
    flat = schema.flatten_and_drop_null(table(spark, d, "agent_states"), "all")
    text = {c: F.to_json(c, {"ignoreNullFields": "false"}) for c in ("nics", "marks", "host_site_tags") if c in flat.columns}  # as SQL writes nested values
    return flat.withColumns({"disk_main_size_gb": F.nanvl("disk_main_size_gb", F.lit(None).cast("double")), **text})


def flatten_dict(spark: SparkSession, d: str) -> DataFrame:
    flat = schema.flatten_dict(_nested(spark, d))
    return flat.withColumn("who->market->tags", F.concat_ws(",", F.col("`who->market->tags`")))


def flatten_array(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array(F.array(F.min("n_name")), F.array(F.max("n_name"), F.lit("z"))).alias("names"))
    return schema.flatten_array(n, "names").select("n_regionkey", F.explode("names").alias("name"))


def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's name against the other nations of its region."""
    n = table(spark, d, "nation")
    other = n.select("n_regionkey", F.col("n_name").alias("other"))
    return n.join(other, "n_regionkey").where("n_name < other").select("n_name", "other", distance(F.col("n_name"), F.col("other")).alias("dist"))


def joined_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", joined_key(F.col("o_orderstatus"), F.col("o_custkey")).alias("key"), padded_id("ord_", F.col("o_orderkey"), 10).alias("id"))


def _object_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss.SSSSSS'Z'")
    made = F.concat(F.lit("cust"), F.col("user_id") % 7, F.lit("/"), "event_type", F.lit("-"), F.when(F.col("event_id") % 11 == 0, "bad").otherwise(stamp), F.lit("-x"))
    return e.select("event_id", made.alias("name"))


def path_filter(spark: SparkSession, d: str) -> DataFrame:
    return objects.filter_paths(_object_names(spark, d), "name", ["cust1", "cust4"], datetime(2024, 1, 5), datetime(2024, 1, 20, 12))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def balanced_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    sample = sampling.balanced_sample(table(spark, d, "part"), "p_brand", "p_partkey", "both", seed=3)
    return sample.groupBy("p_brand").agg(F.count("*").alias("n"))


def balanced_sample_down(spark: SparkSession, d: str) -> DataFrame:
    """The rows drawn without replacement."""
    return sampling.balanced_sample(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "down", seed=5, replace=False).select("o_orderpriority", "o_orderkey")


def balanced_sample_up(spark: SparkSession, d: str) -> DataFrame:
    """The rows drawn with replacement, with the number of their draws."""
    sample = sampling.balanced_sample(table(spark, d, "part"), "p_brand", "p_partkey", "up", seed=3)
    return sample.groupBy("p_brand", "p_partkey").agg(F.count("*").alias("n"))


def balanced_sample_fixed(spark: SparkSession, d: str) -> DataFrame:
    sample = sampling.balanced_sample(table(spark, d, "part"), "p_brand", "p_partkey", fixed_size=7, seed=4)
    return sample.groupBy("p_brand", "p_partkey").agg(F.count("*").alias("n"))


def init_centroids(spark: SparkSession, d: str) -> DataFrame:
    centres = cluster.init_centroids(table(spark, d, "embeddings"), "vec_id", "embedding", 4, seed=2)
    return spark.createDataFrame([(i, j, round(v, 6)) for i, c in enumerate(centres) for j, v in enumerate(c)], "cluster int, dim int, v double")


def number_rows(spark: SparkSession, d: str) -> DataFrame:
    return indexing.number_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "idx")


def sort_values(spark: SparkSession, d: str) -> DataFrame:
    """Each row's place in the order that the operator gives."""
    v = table(spark, d, "agent_states").select("state_id", F.col("disk.main.size_gb").alias("v"))
    return indexing.number_in_order(sampling.sorted_values(v, "v", "state_id"), "rank", 1).select("state_id", "rank")


_CENTRES = 3


def _first_vectors(spark: SparkSession, d: str) -> list[list[float]]:
    rows = table(spark, d, "embeddings").where(f"vec_id < {_CENTRES}").orderBy("vec_id").collect()
    return [[float(x) for x in r["embedding"]] for r in rows]


def assign_cosine(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", cluster.assign(F.col("embedding").cast("array<double>"), _first_vectors(spark, d), "cosine").alias("cluster"))


def assign_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", cluster.assign(F.col("embedding").cast("array<double>"), _first_vectors(spark, d), "euclidean").alias("cluster"))


def median_centroids(spark: SparkSession, d: str) -> DataFrame:
    """One round of k-medians from the first vectors."""
    _, centres = cluster.k_medians(table(spark, d, "embeddings"), "vec_id", "embedding", centroids=_first_vectors(spark, d), max_rounds=1)
    return spark.createDataFrame([(i, j, round(v, 6)) for i, c in enumerate(centres) for j, v in enumerate(c)], "cluster int, dim int, v double")


def k_medians(spark: SparkSession, d: str) -> DataFrame:
    return cluster.k_medians(table(spark, d, "embeddings"), "vec_id", "embedding", 4, seed=2)[0]


def k_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_linenumber"), F.floor("l_quantity") % 7, F.floor(F.col("l_discount") * 100)).alias("v"))
    return cluster.k_modes(rows, "id", "v", 3, seed=4)[0]


def queries() -> dict:
    names = (
        "flatten_schema flatten_df flatten_df_all null_profile drop_all_null flatten_dict flatten_array edit_distance joined_keys path_filter json_fields "
        "balanced_sample_sizes balanced_sample_down balanced_sample_up balanced_sample_fixed init_centroids number_rows sort_values assign_cosine assign_euclidean median_centroids k_medians k_modes"
    ).split()
    return {n: globals()[n] for n in names}


_VEC = f"""c as (select vec_id as k, embedding as c from embeddings where vec_id < {_CENTRES}),
p as (select e.vec_id, k, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * c.c[i]::double)) as dot,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * e.embedding[i]::double))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: c.c[i]::double * c.c[i]::double))) as size,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - c.c[i]::double) ** 2))) as dist from embeddings e, c)"""


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


_COSINE = "case when list_dot_product(v, v) * list_dot_product(vec, vec) > 0 then -list_dot_product(v, vec) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(vec, vec))) else 0 end"


def _rounds(dist: str, middle: str, dims: int, most: int = 60) -> str:
    """Rounds of assignment and update from the centroids of f; more of them than it takes to settle."""
    return f"""c as (select row_number() over (order by h) - 1 as cluster, vec, 0 as i from f
        union all select cluster, list(x order by dim), i + 1 from (select cluster, dim, {middle} as x, any_value(i) as i from
          (select a.cluster, a.i, unnest(range({dims})) as dim, unnest(e.v) as x from
            (select rid, any_value(i) as i, arg_min(cluster, (round(dist, 12), cluster)) as cluster from (select rid, cluster, i, {dist} as dist from e, c where i < {most}) group by rid) a join e using (rid))
          group by cluster, dim) group by cluster, i)
        select any_value(id) as key, arg_min(cluster, (round(dist, 12), cluster))::int as cluster from (select rid, id, cluster, {dist} as dist from e, c where i = {most}) group by rid"""


def _drawn(seed: int, size: str) -> str:
    """Draw d of a class takes the row of its hash's rank, the rows being ranked by theirs."""
    return f"""with c as (select p_brand, count(*) as n from part group by 1), r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by {_hash(f"'{seed}|' || p_partkey")}, p_partkey) as rank from part),
        d as (select p_brand, {_hash(f"'{seed + 1}|' || p_brand || '|' || d")} % n + 1 as rank from (select p_brand, n, unnest(range(1, {size} + 1)) as d from c))
        select p_brand, p_partkey, count(*) as n from d join r using (p_brand, rank) group by all"""


def oracle_sql() -> dict[str, str]:
    seg = "case when c_custkey % 3 <> 0 then c_mktsegment end"
    return {
        "flatten_schema": """select * from (values ('host.id', 'string_array'), ('host.os', 'string_array'), ('host.site.room', 'string_array'), ('host.site.tags', 'string_array'), ('host_os', 'string_array'), ('nics', 'string_array'),
            ('disk.main.mount', 'string_array'), ('disk.main.label', 'string_array'), ('disk_main_mount', 'string_array'), ('legacy_note', 'string_array'),
            ('state_id', 'all'), ('host.id', 'all'), ('host.os', 'all'), ('host.site.room', 'all'), ('host.site.rack', 'all'), ('host.site.tags', 'all'), ('host_os', 'all'), ('nics', 'all'),
            ('disk.main.mount', 'all'), ('disk.main.label', 'all'), ('disk.main.size_gb', 'all'), ('disk.encrypted', 'all'), ('disk_main_mount', 'all'), ('marks', 'all'), ('legacy_note', 'all')) v(path, leaf_types)""",
        "flatten_df": f"select c_name as who_c_name, coalesce({seg}, 'alt ' || c_mktsegment) as who_market_segment, c_name || ',' || c_mktsegment as who_market_tags, null::varchar as acct_note from customer",
        "flatten_df_all": f"""select c_custkey as who_c_custkey, c_name as who_c_name, coalesce({seg}, 'alt ' || c_mktsegment) as who_market_segment, 'alt ' || c_mktsegment as who_market_segment_x,
            c_acctbal as acct_bal, null::varchar as acct_note from customer""",
        "null_profile": """select count(*) filter (state_id is null) as state_id, count(*) filter (host.id is null) as host_id, count(*) filter (coalesce(host.os, host_os) is null) as host_os,
            count(*) filter (host.site.room is null) as host_site_room, count(*) filter (host.site.rack is null) as host_site_rack, count(*) filter (coalesce(disk.main.mount, disk_main_mount) is null) as disk_main_mount,
            count(*) filter (disk.main.label is null) as disk_main_label, count(*) filter (disk.main.size_gb is null or isnan(disk.main.size_gb)) as disk_main_size_gb, count(*) filter (disk.encrypted is null) as disk_encrypted,
            count(*) filter (legacy_note is null) as legacy_note, count(*) filter (nics is null) as nics, count(*) filter (marks is null) as marks, count(*) filter (host.site.tags is null) as host_site_tags from agent_states""",
        "drop_all_null": """select state_id, host.id as host_id, coalesce(host.os, host_os) as host_os, host.site.room as host_site_room, host.site.rack as host_site_rack, to_json(host.site.tags)::varchar as host_site_tags, to_json(nics)::varchar as nics, to_json(marks)::varchar as marks,
            coalesce(disk.main.mount, disk_main_mount) as disk_main_mount, disk.main.label as disk_main_label,
            case when isnan(disk.main.size_gb) then null else disk.main.size_gb end as disk_main_size_gb, disk.encrypted as disk_encrypted from agent_states""",
        "flatten_dict": f"""select c_custkey as "who->c_custkey", c_name as "who->c_name", {seg} as "who->market->segment", c_name || ',' || c_mktsegment as "who->market->tags", 'alt ' || c_mktsegment as "WHO_market_segment", c_acctbal as "acct->bal", null::varchar as "acct->note" from customer""",
        "flatten_array": "select n_regionkey, unnest([min(n_name), max(n_name), 'z']) as name from nation group by n_regionkey",
        "edit_distance": "select a.n_name, b.n_name as other, levenshtein(a.n_name, b.n_name)::int as dist from nation a join nation b using (n_regionkey) where a.n_name < b.n_name",
        "joined_keys": "select o_orderkey, o_orderstatus || '|' || o_custkey as key, 'ord_' || lpad(o_orderkey::varchar, 10, '0') as id from orders",
        "path_filter": """select event_id, 'cust' || (user_id % 7) || '/' || event_type || '-' || strftime(ts, '%Y%m%dT%H%M%S.%fZ') || '-x' as name from events
            where event_id % 11 <> 0 and user_id % 7 in (1, 4) and ts between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'""",
        "json_fields": "select event_id, json_extract_string(props, '$.k') as k from events",
        "balanced_sample_sizes": "with c as (select p_brand, count(*) as n from part group by 1) select p_brand, (select floor(quantile_cont(n, 0.5))::bigint from c) as n from c",
        "balanced_sample_down": f"""with c as (select o_orderpriority, count(*) as n from orders group by 1)
            select o_orderpriority, o_orderkey from orders qualify row_number() over (partition by o_orderpriority order by {_hash("'5|' || o_orderkey")}, o_orderkey) <= (select min(n) from c)""",
        "balanced_sample_up": _drawn(3, "(select max(n) from c)"),
        "balanced_sample_fixed": _drawn(4, "7"),
        "init_centroids": f"""with f as (select embedding, min({_hash("'2|' || vec_id")}) as h from embeddings group by embedding order by 2 limit 4), k as (select embedding, row_number() over (order by h) - 1 as cluster from f)
            select cluster::int as cluster, unnest(range(64))::int as dim, round(unnest(embedding)::double, 6) as v from k""",
        "k_medians": f"""with recursive f as (select embedding::double[] as vec, min({_hash("'2|' || vec_id")}) as h from embeddings group by 1 order by 2 limit 4),
            e as (select vec_id as rid, vec_id as id, embedding::double[] as v from embeddings), {_rounds("sqrt(list_sum(list_transform(range(1, 65), lambda j: (v[j] - vec[j]) ** 2)))", "quantile_cont(x, 0.5)", 64)}""",
        "k_modes": f"""with recursive w as (select l_orderkey * 10 + l_linenumber as id, [l_linenumber::double, floor(l_quantity) % 7, floor(l_discount * 100)] as v from lineitem), e as (select row_number() over (order by id, v) as rid, id, v from w),
            f as (select v as vec, min({_hash("'4|' || id")}) as h from e group by 1 order by 2 limit 3), {_rounds(_COSINE, "list_aggregate(list_sort(list(x)), 'mode')", 3)}""",
        "number_rows": "select p_partkey, row_number() over (order by p_name, p_partkey) - 1 as idx from part",
        "sort_values": "select state_id, row_number() over (order by v is null, isnan(v), v, state_id) as rank from (select state_id, disk.main.size_gb as v from agent_states)",
        "assign_cosine": f"with {_VEC} select vec_id, arg_min(k, (round(-dot / size, 12), k))::int as cluster from p group by vec_id",
        "assign_euclidean": f"with {_VEC} select vec_id, arg_min(k, (round(dist, 12), k))::int as cluster from p group by vec_id",
        "median_centroids": f"""with {_VEC}, a as (select vec_id, arg_min(k, (round(dist, 12), k))::int as cluster from p group by vec_id),
            v as (select cluster, unnest(embedding)::double as v, unnest(range(64)) as dim from a join embeddings using (vec_id))
            select cluster, dim::int as dim, round(quantile_cont(v, 0.5), 6) as v from v group by all""",
    }
