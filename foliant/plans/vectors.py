from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import vector as fn
from foliant.operators import vectorindex
from foliant.operators import vectors as op
from foliant.plans.registry import query
from foliant.session import scratch
from foliant.sources import tables as src

V = "(SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
PAIRS = f"FROM {V} a JOIN {V} b ON b.vec_id = a.vec_id + 1"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one, as the old and the new vector of a document."""
    v = src.vectors(spark, sf_dir)
    return v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)


@query(f"SELECT a.vec_id AS x, b.vec_id AS y, round({COS}, 6) AS cosine, round(greatest(0, {COS}), 6) AS similarity {PAIRS}")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a.v"), F.col("b.v")
    return pairs(spark, sf_dir).select(F.col("a.vec_id").alias("x"), F.col("b.vec_id").alias("y"), F.round(fn.cosine(a, b), 6).alias("cosine"), F.round(fn.similarity(a, b), 6).alias("similarity"))


@query(f"""
SELECT a.vec_id AS x, b.vec_id AS y, round(list_distance(a.v, b.v), 6) AS euclidean, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS manhattan,
  round(list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS max_move, round(list_avg(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS mean_move, {COS} < 0.95 AS significant {PAIRS}
""")
def l2_l1_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fn.comparison(F.col("a.v"), F.col("b.v"))
    own = [F.round(m[n], 6).alias(n) for n in ("euclidean", "manhattan", "max_move", "mean_move")]
    return pairs(spark, sf_dir).select(F.col("a.vec_id").alias("x"), F.col("b.vec_id").alias("y"), *own, m["significant"].alias("significant"))


@query(f"SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, label FROM {V}")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.vectors(spark, sf_dir).select("vec_id", F.round(fn.norm(F.col("v")), 6).alias("norm"), "label")


@query(f"SELECT vec_id, rank::INTEGER AS rank, other, similarity FROM (SELECT a.vec_id, b.vec_id AS other, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM {V} a JOIN {V} b ON a.vec_id <> b.vec_id) WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.nearest_rows(src.vectors(spark, sf_dir), 10).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT vec_id, rank::INTEGER AS rank, other, similarity FROM (SELECT a.vec_id, b.vec_id AS other, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM {V} a JOIN {V} b ON a.vec_id <> b.vec_id AND a.label = b.label) WHERE rank <= 5")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.nearest_rows(src.vectors(spark, sf_dir), 5, same="label").withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT b.vec_id, round({COS}, 6) AS similarity FROM {V} a JOIN {V} b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {COS} DESC, b.vec_id LIMIT 10")
def similar_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.similar_documents(src.vectors(spark, sf_dir), 0, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT b.vec_id, round({COS}, 6) AS similarity FROM {V} a JOIN {V} b ON a.vec_id = 0 AND b.vec_id <> 0 AND b.label IN (1, 2, 3) AND b.vec_id >= 100 ORDER BY {COS} DESC, b.vec_id LIMIT 2")
def similar_with_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.similar_documents(src.vectors(spark, sf_dir), 0, 3, {"label": {"$in": [1, 2, 3]}, "$or": [{"vec_id": {"$gte": 100}}]}, count_self=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT vec_id, other, similarity FROM (SELECT a.vec_id, b.vec_id AS other, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM {V} a JOIN {V} b ON a.vec_id <> b.vec_id) WHERE rank = 1 AND similarity >= 0.4")
def semantic_dup_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.semantic_duplicates(src.vectors(spark, sf_dir), 0.4).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH m AS (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM {V}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY 1)
SELECT label, (i - 1)::INTEGER AS i, round(x / size, 6) AS x, n FROM m JOIN s USING (label)
""")
def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = op.mean_vectors(src.vectors(spark, sf_dir), "label")
    return pooled.select("label", F.posexplode("v").alias("i", "x"), "n").select("label", "i", F.round("x", 6).alias("x"), "n")


@query("SELECT conv_id || '_page_' || (turn + 1) AS id, conv_id AS paper_id, substr(text, 1, 500) AS preview FROM conversations")
def page_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_rows(src.pages(spark, sf_dir)).select("id", "paper_id", "preview")


@query("SELECT conv_id || '_page_' || (turn + 1) AS id, concat_ws(',', CASE WHEN turn % 3 > 0 THEN 'model_name:' || role END, 'page_number:' || (turn + 1)) AS metadata FROM conversations")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the page collection; a page whose model isn't known has no such key."""
    pages = src.pages(spark, sf_dir).withColumn("model_name", F.when(F.col("page_number") % 3 != 1, F.col("model_name")))
    said = F.transform(F.array_sort(F.map_entries("metadata")), lambda m: F.concat(m["key"], F.lit(":"), m["value"]))
    return op.page_rows(pages).select("id", F.array_join(said, ",").alias("metadata"))


#: Cells of the index here, and the recall that its searches are set to.
CELLS, RECALL = 16, 0.95


def indexed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a stored index over all vectors."""
    folder = scratch(spark, "index")
    vectorindex.build(src.vectors(spark, sf_dir).select("vec_id", "v"), folder, CELLS)
    return folder


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector, from as many cells of the index as the recall needs; tests measure it against the exact search."""
    own, folder = src.vectors(spark, sf_dir).select("vec_id", "v"), indexed(spark, sf_dir)
    found = vectorindex.nearest(own, folder, 10, vectorindex.probes_for(own, folder, 10, RECALL))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT vec_id, rank::INTEGER AS rank, other, similarity FROM (SELECT a.vec_id, b.vec_id AS other, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM {V} a JOIN {V} b ON a.vec_id <> b.vec_id) WHERE rank <= 10")
def knn_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all cells."""
    own = src.vectors(spark, sf_dir).select("vec_id", "v")
    return vectorindex.nearest(own, indexed(spark, sf_dir), 10).withColumn("similarity", F.round("similarity", 6))


NEWER = """(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 <> 3 AND vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 5 = 1
  UNION ALL SELECT a.vec_id, b.embedding::DOUBLE[] FROM embeddings a JOIN embeddings b ON a.vec_id % 7 = 0 AND a.vec_id % 10 <> 3 AND b.vec_id = a.vec_id + 1)"""


@query(f"SELECT vec_id, rank::INTEGER AS rank, other, similarity FROM (SELECT a.vec_id, b.vec_id AS other, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id) AS rank FROM {V} a JOIN {NEWER} b ON a.vec_id <> b.vec_id) WHERE rank <= 3")
def knn_index_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches after rows were added to the index, replaced by others and deleted."""
    own, folder = src.vectors(spark, sf_dir).select("vec_id", "v"), indexed(spark, sf_dir)
    gone = own.where("vec_id % 10 = 3")
    moved = own.where("vec_id % 7 = 0 AND vec_id % 10 <> 3").select("vec_id").join(own.select((F.col("vec_id") - 1).alias("vec_id"), "v"), "vec_id")
    lost = own.where("vec_id % 7 = 0 AND vec_id % 10 <> 3").join(moved, "vec_id", "left_anti")
    added = own.where("vec_id % 5 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    vectorindex.upsert(added.unionByName(moved), folder, gone.select("vec_id").unionByName(lost.select("vec_id")))
    found = vectorindex.nearest(own, folder, 3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT b.vec_id, round({COS}, 6) AS similarity FROM {V} a JOIN {V} b ON a.vec_id = 1 AND b.vec_id <> -1 ORDER BY {COS} DESC, b.vec_id LIMIT 10")
def similar_in_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search, of the vector of a stored row."""
    query_vector = src.vectors(spark, sf_dir).where("vec_id = 1").first()["v"]
    return vectorindex.similar_to(spark, indexed(spark, sf_dir), query_vector, 10).withColumn("similarity", F.round("similarity", 6))
