"""Queries through the readers and report writers: test tables written as files, read again, and compared row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, itemsets, recommend
from ..operators.similarity import dense_index
from ..session import scratch_path, written
from ..sources import files, reports
from ..sources.tables import table
from . import mining

KEYWORDS = ["service", "PIZZA", "bueno"]


def _driver_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that the driver may open as a file."""
    path = scratch_path(spark, tag)
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError("reports of one file need a shared folder that is mounted")
    return path


def review_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews as JSON lines, of which NULL fields are left out, read by the schema of reviews."""
    path = scratch_path(spark, "reviews-json")
    reports.json_lines(table(spark, folder, "review").select(*files.REVIEW.fieldNames()), path)
    return files.json_lines(spark, path, files.REVIEW).withColumn("text", F.md5("text"))


def basket_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs as CSV with a header, read with the columns swapped."""
    path = scratch_path(spark, "pairs-csv")
    reports.csv(mining.user_business(spark, folder).repartition(3), path)
    return files.csv_pairs(spark, path, swap=True)


def stop_word_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stop-words")
    reports.text(table(spark, folder, "stop_words").where("word is not null").select(F.concat(F.lit(" "), "word").alias("line")), path)
    return files.stop_words(spark, path)


def tagged_model(spark: SparkSession, folder: str) -> DataFrame:
    """The user numbers of a model file that holds rows of several kinds."""
    path, edges = scratch_path(spark, "model"), mining.user_business(spark, folder)
    reports.tagged({"user_index": dense_index(edges, "user_id"), "business_index": dense_index(edges, "business_id")}, path)
    return files.tagged(spark, path, "user_id string, idx long", "user_index")


def average_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Averages as one-entry objects, read as a map."""
    path = scratch_path(spark, "averages")
    held = recommend.entity_averages(mining.reviews(spark, folder, "business_id", "stars"), "business_id")
    reports.text(held.select(F.to_json(F.create_map("business_id", F.round("avg_stars", 6))).alias("line")), path)
    return files.average_map(spark, path)


def tracked_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that mention a keyword."""
    return files.tracked(mining.reviews(spark, folder, "text"), "text", KEYWORDS).select("review_id")


def parsed_states(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON messages, as the socket brings them."""
    lines = table(spark, folder, "user_state").select(F.to_json(F.struct("user_id", "state")).alias("value"))
    return files.parsed(lines, "user_id string, state string")


def review_object(spark: SparkSession, folder: str) -> DataFrame:
    """The report of one JSON object: a number and a list of rows."""
    path = _driver_path(spark, "object")
    reports.json_object(path, n=mining.review_count(spark, folder).first().n, users=mining.top_users(spark, folder))
    held = spark.read.schema("n long, users array<array<string>>").json(path)
    return held.select("n", F.explode("users").alias("u")).select("n", F.col("u")[0].alias("user_id"), F.col("u")[1].cast("long").alias("reviews"))


def itemset_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the itemset report, written and read."""
    path, edges = _driver_path(spark, "itemsets"), written(mining.user_business(spark, folder), "user-business")
    sets = written(itemsets.frequent_itemsets(edges, "user_id", "business_id", mining._support(edges, "user_id", mining.ITEMSET_SHARE, 3)), "itemsets")
    reports.itemset_report(path, sets.where("size < 0"), sets)
    return spark.read.text(path).select(F.col("value").alias("line")).where("line != ''")


def community_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The communities of label propagation, a line each, and the place of the line."""
    path, e = scratch_path(spark, "communities"), mining._user_graph(spark, folder)
    reports.text(reports.community_lines(graph.label_propagation(graph.vertices(e), e).withColumnRenamed("label", "community")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def betweenness_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "betweenness")
    reports.text(reports.betweenness_lines(mining.edge_betweenness(spark, folder)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def hits_line(spark: SparkSession, folder: str) -> DataFrame:
    """Bloom hits of the businesses of reviews in order, as one line of T and F."""
    path = _driver_path(spark, "hits")
    hits = mining.bloom_probe(spark, folder).orderBy("name").select("hit")
    reports.hits_row(path, (r.hit for r in hits.toLocalIterator()))
    return spark.read.text(path).select(F.col("value").alias("line"))


def feature_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Rating features as CSV with a header, read again."""
    path = scratch_path(spark, "features")
    made = mining.rating_features(spark, folder)
    reports.csv(made, path)
    return spark.read.option("header", True).schema(made.schema).csv(path)


def trending_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The report of trending tags, of which each batch is reported once."""
    path = _driver_path(spark, "trending")
    tags = mining.trending_tags(spark, folder).orderBy(F.desc("n"), "tag").collect()  # few
    for batch in (0, 0, 1, 1, 0):
        reports.append_batch(path, batch, ["batch", "tag", "n"], lambda state: ([(batch, r.tag, r.n) for r in tags], state))
    return spark.read.option("header", True).schema("batch int, tag string, n long").csv(path)


QUERIES = {f.__name__: f for f in (
    review_json_lines, basket_csv, stop_word_lines, tagged_model, average_lines, tracked_reviews, parsed_states, review_object,
    itemset_lines, community_lines, betweenness_lines, hits_line, feature_csv, trending_lines)}

_LINE = "'(''' || replace(items, ',', ''', ''') || ''')'"

SQL = {
    "review_json_lines": "select review_id, user_id, business_id, stars, md5(text) as text, date from review",
    "basket_csv": f"with {mining._UB} select b as basket, u as item from ub",
    "stop_word_lines": "select distinct trim(word) as word from stop_words where trim(word) <> ''",
    "tagged_model": f"with {mining._UB} select u as user_id, row_number() over (order by u) - 1 as idx from (select distinct u from ub)",
    "average_lines": f"with {mining._R} select business_id as id, round(avg(stars), 6) as avg_stars from r where business_id is not null and stars is not null group by 1",
    "tracked_reviews": f"with {mining._R} select review_id from r where {' or '.join(f'contains(lower(text), {chr(39)}{k.lower()}{chr(39)})' for k in KEYWORDS)}",
    "parsed_states": "select user_id, state from user_state",
    "review_object": f"with {mining._R} select (select count(*) from r) as n, user_id, count(*) as reviews from r where user_id is not null group by user_id order by reviews desc, user_id limit {mining.TOP}",
    "itemset_lines": f"""with sets as ({mining._BY_USER}) select 'Frequent Itemsets:' as line union all select 'Candidates:' union all
        select string_agg({_LINE}, ',' order by string_split(items, ',')) from sets group by size""",
    "community_lines": f"with {mining._LPA} select string_agg('''' || id || '''', ', ' order by id) as line from l5 group by label",
    "betweenness_lines": f"select '(''' || src || ''', ''' || dst || '''), ' || cast(betweenness as varchar) as line from ({mining.SQL['edge_betweenness']})",
    "hits_line": f"select string_agg(case when hit then 'T' else 'F' end, ' ' order by name) as line from ({mining.SQL['bloom_probe']})",
    "feature_csv": mining.SQL["rating_features"],
    "trending_lines": f"select k as batch, tag, n from ({mining.SQL['trending_tags']}), range(2) t(k)",
}
