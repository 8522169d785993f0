"""Queries on manifests, registries and instance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions import ids

from .registry import query, table

_MANIFEST = """manifest AS (SELECT doc_id, lang AS object, CASE WHEN source IN ('src0', 'src1') THEN 'train' ELSE 'test' END AS split,
  CASE WHEN doc_id % 3 = 0 THEN 'anomaly' ELSE 'normal' END AS label, source || '/' || (n_chars % 50) || '.png' AS image FROM documents)"""


def manifest(spark, sf_dir):
    """documents as a split manifest: object, split, label, image."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("object"),
        F.when(F.col("source").isin("src0", "src1"), "train").otherwise("test").alias("split"),
        F.when(F.col("doc_id") % 3 == 0, "anomaly").otherwise("normal").alias("label"),
        F.concat("source", F.lit("/"), (F.col("n_chars") % 50).cast("string"), F.lit(".png")).alias("image"),
    )


def annotations(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.format_string("defect_%d", F.col("quality")).alias("defect"))


_ROUTED = f"""{_MANIFEST}, notes AS (SELECT doc_id, 'defect_' || quality AS defect FROM labels WHERE toxic = 1),
  routed AS (SELECT m.doc_id, object, image, CASE WHEN m.label = 'normal' AND split = 'train' THEN 'train' ELSE 'test' END AS to_split,
    CASE WHEN m.label = 'normal' THEN 'good' ELSE coalesce(defect, 'anomaly') END AS to_label FROM manifest m LEFT JOIN notes USING (doc_id))"""


def routed(spark, sf_dir):
    rows = manifest(spark, sf_dir).join(annotations(spark, sf_dir), "doc_id", "left")
    split, label = ids.routed("split", "label", "defect")
    return rows.select("doc_id", "object", "image", split.alias("to_split"), label.alias("to_label"))


@query(f"WITH {_ROUTED} SELECT doc_id, to_split, to_label FROM routed")
def split_route(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "to_split", "to_label")


@query(f"WITH {_MANIFEST} SELECT object, image, arg_max(doc_id, doc_id) AS doc_id, arg_max(split, doc_id) AS split, arg_max(label, doc_id) AS label FROM manifest GROUP BY object, image")
def split_dedup(spark, sf_dir):
    """The last manifest row of each image wins."""
    last = manifest(spark, sf_dir).groupBy("object", "image").agg(F.max_by(F.struct("doc_id", "split", "label"), "doc_id").alias("r"))
    return last.select("object", "image", "r.*")


@query("SELECT d.doc_id, coalesce('defect_' || quality, 'anomaly') AS defect FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) USING (doc_id)")
def annotate_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(annotations(spark, sf_dir), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("defect", F.lit("anomaly")).alias("defect"))


@query(f"WITH {_MANIFEST} SELECT doc_id, image FROM manifest WHERE object = 'fr'")
def category_filter(spark, sf_dir):
    return manifest(spark, sf_dir).where("object = 'fr'").select("doc_id", "image")


@query("SELECT DISTINCT lang AS object FROM documents ORDER BY 1")
def category_distinct(spark, sf_dir):
    return manifest(spark, sf_dir).select("object").distinct().orderBy("object")


_PATHS = "paths AS (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) || CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' ELSE '' END AS path FROM pages)"


def paths(spark, sf_dir):
    i = F.col("page_id") % 4
    tail = F.when(i == 0, ".PNG").when(i == 1, ".jpeg").when(i == 2, ".txt").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"://[^/]*([^?#]*)", 1), tail).alias("path"))


@query(f"WITH {_PATHS} SELECT page_id, path FROM paths WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'bmp')")
def ext_filter(spark, sf_dir):
    return paths(spark, sf_dir).where(ids.is_image("path"))


@query(f"""WITH {_PATHS} SELECT page_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
  coalesce(split_part(path, '/', 2), '') AS top FROM paths""")
def path_parse(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", ids.extension("path").alias("ext"), ids.file_stem("path").alias("stem"), F.coalesce(F.split_part("path", F.lit("/"), F.lit(2)), F.lit("")).alias("top"))


@query("SELECT conv_id, turn, printf('conv_%d_%02d', conv_id, turn * 37) AS instance_id, 'train/' || role || '/' || conv_id AS image FROM conversations")
def id_format(spark, sf_dir):
    stem = F.format_string("conv_%d", F.col("conv_id"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ids.instance_id(stem, F.col("turn") * 37).alias("instance_id"), ids.image_id(F.lit("train"), "role", F.col("conv_id").cast("string")).alias("image")
    )


@query("SELECT conv_id, turn, regexp_replace(printf('conv_%d_%02d', conv_id, turn * 37), '^(.*)_\\d{2}$', '\\1') AS stem FROM conversations")
def stem_strip(spark, sf_dir):
    return id_format(spark, sf_dir).select("conv_id", "turn", ids.stem_of("instance_id").alias("stem"))


@query(f"""WITH {_ROUTED} SELECT object, count(*) FILTER (to_split = 'train')::BIGINT AS train, count(*) FILTER (to_split = 'test' AND to_label = 'good')::BIGINT AS test_normal,
  count(*) FILTER (to_label <> 'good')::BIGINT AS test_anomaly FROM routed GROUP BY object""")
def ingest_counts(spark, sf_dir):
    good = F.col("to_label") == "good"
    return routed(spark, sf_dir).groupBy("object").agg(
        F.count_if(F.col("to_split") == "train").alias("train"), F.count_if((F.col("to_split") == "test") & good).alias("test_normal"), F.count_if(~good).alias("test_anomaly")
    )


@query(f"WITH {_ROUTED} SELECT object, string_agg(DISTINCT to_label, ', ' ORDER BY to_label) AS defects FROM routed WHERE to_label <> 'good' GROUP BY object")
def defect_set_join(spark, sf_dir):
    rows = routed(spark, sf_dir).where("to_label <> 'good'")
    return rows.groupBy("object").agg(F.array_join(F.sort_array(F.collect_set("to_label")), ", ").alias("defects"))


def pending(spark, sf_dir) -> DataFrame:
    """Orders that play the masks of those images that have any."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")


@query("SELECT c_custkey, r_name FROM customer, region")
def prompts_cross(spark, sf_dir):
    """Images times prompts; the prompts are a handful by configuration."""
    return table(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name")))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def images_without_masks(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(pending(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_existing(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""WITH m AS (SELECT c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'))
  SELECT c_name, (SELECT greatest(count(*) - 10, 0) FROM m)::BIGINT AS more FROM m ORDER BY c_name LIMIT 10""")
def first_ten_failures(spark, sf_dir):
    """What an error lists: the first ten by name, and how many more there are."""
    missing = table(spark, sf_dir, "customer").join(pending(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_name")
    more = missing.agg(F.greatest(F.count("*") - 10, F.lit(0)).cast("long")).scalar()
    return missing.orderBy("c_name").limit(10).withColumn("more", more)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(pending(spark, sf_dir).select("o_custkey"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) - 1)::INTEGER AS idx FROM conversations")
def instance_number(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("role", "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).alias("idx"))


@query("SELECT l_orderkey, l_linestatus AS prompt, bool_or(l_quantity > 25) AS covered FROM lineitem GROUP BY ALL")
def mask_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("prompt")).agg(F.bool_or(F.col("l_quantity") > 25).alias("covered"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 25)::BIGINT AS area FROM lineitem GROUP BY l_orderkey")
def mask_area(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("area"))


@query("SELECT r_name AS prompt, count(c_custkey)::BIGINT AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9990) ON c_nationkey = n_nationkey GROUP BY r_name")
def mask_count_by_prompt(spark, sf_dir):
    """Prompts without a mask count zero."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select("c_nationkey", "c_custkey")
    nations = table(spark, sf_dir, "nation")
    prompts = table(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return prompts.join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("prompt")).agg(F.count("c_custkey").alias("n"))


@query("SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' GROUP BY o_custkey")
def train_good_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and startswith(o_orderpriority, '1')")
    return rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))


@query("""SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS reference, arg_min(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey""")
def reference_pick(spark, sf_dir):
    """The first instance, in order, whose mask is large enough."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("r"))
    return rows.select("o_custkey", F.col("r.o_orderkey").alias("reference"), F.col("r.o_orderstatus").alias("status"))


@query("""WITH b AS (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 9000)
  SELECT o_orderkey, (o_custkey IN (SELECT c_custkey FROM b)) AS in_bank FROM orders""")
def in_bank_flag(spark, sf_dir):
    bank = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "orders").join(bank, "o_custkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("in_bank"))


@query("""SELECT c_custkey, coalesce(a.m, b.m) AS best FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a USING (c_custkey)
  LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (c_custkey)""")
def coalesce_fallback(spark, sf_dir):
    """The refined result where there is one, else the plain one."""
    best = lambda s, n: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias(n))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best("P", "a"), "c_custkey", "left").join(best("F", "b"), "c_custkey", "left").select("c_custkey", F.coalesce("a", "b").alias("best"))


@query("""WITH files AS (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.png' ELSE '_mask.png' END AS f FROM nation WHERE n_nationkey % 5 <> 0 UNION SELECT n_name || '_mask.png' FROM nation WHERE n_nationkey % 4 = 0),
  tries AS (SELECT n_name, 0 AS pos, n_name || '.png' AS f FROM nation UNION ALL SELECT n_name, 1, n_name || '_mask.png' FROM nation)
  SELECT n_name, arg_min(f, pos) AS mask FROM tries JOIN files USING (f) GROUP BY n_name""")
def mask_name_fallback(spark, sf_dir):
    """The first of two possible mask names that exists."""
    nation = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    files = nation.where(k % 5 != 0).select(F.concat(name, F.when(k % 2 == 0, ".png").otherwise("_mask.png")).alias("f")).union(nation.where(k % 4 == 0).select(F.concat(name, F.lit("_mask.png")))).distinct()
    tries = nation.select("n_name", F.posexplode(F.array(F.concat(name, F.lit(".png")), F.concat(name, F.lit("_mask.png")))).alias("pos", "f"))
    return tries.join(files, "f").groupBy("n_name").agg(F.min_by("f", "pos").alias("mask"))


@query("""SELECT o_orderkey, len(list(l_linenumber))::BIGINT AS n, list_sum(list(l_quantity)) AS total, min(l_linenumber)::INTEGER AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def metadata_json_roundtrip(spark, sf_dir):
    """Per image a JSON document with its sorted instances, written and parsed again."""
    inner = "instances array<struct<instance_id:int,area:double>>"
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("instance_id"), F.col("l_quantity").alias("area")))).alias("instances"))).alias("doc")
    )
    parsed = docs.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.from_json("doc", inner).alias("m"))
    total = F.aggregate("m.instances", F.lit(0.0), lambda a, x: a + x["area"])
    return parsed.select("o_orderkey", F.size("m.instances").cast("long").alias("n"), total.alias("total"), F.col("m.instances")[0]["instance_id"].alias("first"))


@query("SELECT l_orderkey AS o_orderkey, l_linenumber AS instance_id, l_quantity AS area FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def metadata_explode(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("instance_id"), F.col("l_quantity").alias("area"))).alias("instances"))
    return docs.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.inline("instances"))


@query("SELECT count(*)::BIGINT AS n, count(quality)::BIGINT AS done, (count(*) - count(quality))::BIGINT AS skipped FROM documents LEFT JOIN labels USING (doc_id)")
def done_skipped(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count("quality").alias("done"), F.count_if(F.col("quality").isNull()).alias("skipped"))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS heatmaps, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey")
def viewer_left_joins(spark, sf_dir):
    """Images with their ground truth and heatmap where there are any."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("heatmaps"), F.max("o_totalprice").alias("best"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def instance_to_image(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_custkey", "c_name")


@query("SELECT c_custkey, coalesce(u, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS u FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def registry_update(spark, sf_dir):
    """New values of a stage over the registry's old ones."""
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("u"))
    return table(spark, sf_dir, "customer").join(new, "c_custkey", "left").select("c_custkey", F.coalesce("u", "c_acctbal").alias("balance"))


@query("SELECT item_id, (item_id IN (SELECT doc_id FROM labels)) AS labelled FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def benchmark_semi_anti(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    clean = table(spark, sf_dir, "benchmark").join(labels.where("toxic = 1").select(F.col("doc_id").alias("item_id")), "item_id", "left_anti")
    known = labels.select(F.col("doc_id").alias("item_id")).distinct().withColumn("labelled", F.lit(True))
    return clean.join(known, "item_id", "left").select("item_id", F.coalesce("labelled", F.lit(False)).alias("labelled"))
