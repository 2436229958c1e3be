"""Command line: ``python -m dredgeline COMMAND ...`` runs one job from files to files.

    review-stats REVIEWS OUT STOP_WORDS YEAR M N        counts, top users and top words, one JSON object
    top-categories REVIEWS BUSINESS OUT N               categories by mean stars
    partition-stats REVIEWS OUT N [--partitions P]      partitions, their sizes, businesses above N reviews
    itemsets CSV OUT SUPPORT [--case 1|2]               candidates and frequent itemsets, a text report
    similar-business REVIEWS OUT [--threshold T]        pairs of businesses by MinHash bands and exact Jaccard
    content-train REVIEWS MODEL STOP_WORDS              word profiles of businesses and users
    content-predict PAIRS MODEL OUT                     cosine scores
    cf-train REVIEWS MODEL item|user                    correlations
    cf-predict REVIEWS PAIRS MODEL OUT item|user        predicted stars
    communities CSV OUT THRESHOLD                       label propagation over users sharing items
    divide CSV OUT BETWEENNESS [--case 1|2]             betweenness and division of highest modularity
    bloom FIRST SECOND OUT                              which names of SECOND occur in FIRST
    stream-distinct HOST PORT OUT CHECKPOINT            distinct states in sliding windows, from a socket
    trending HOST PORT OUT CHECKPOINT                   trending tags of a sample, from a socket
    rate-train REVIEWS USERS BUSINESS MODEL             boosted trees
    rate-predict PAIRS USERS BUSINESS MODEL OUT         predicted stars

REVIEWS, BUSINESS, USERS, PAIRS, FIRST and SECOND are JSON lines.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import key
from .operators import graph, itemsets, profiles, recommend, regression, review, similarity, sketches
from .sources import files, reports
from .sources.tables import stars
from .streaming import sampling, windows

PAIRS, BUSINESS = "user_id string, business_id string", "business_id string, categories string, latitude double, longitude double"
USERS = "user_id string, useful long, funny long, fans long"


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    rows = files.json_lines(spark, path, files.REVIEW)
    return rows.withColumns({c: key(F.col(c)) for c in ("user_id", "business_id")}).withColumn("stars", stars(F.col("stars")))


def review_stats(spark, reviews, out, stop, year, m, n):
    r = _reviews(spark, reviews)
    words = review.top_words(r, "text", int(n), files.stop_words(spark, stop)).select("word")
    reports.json_object(out, A=review.review_count(r).first()[0], B=review.review_count_year(r, int(year)).first()[0], C=review.distinct_business(r).first()[0],
                        D=review.top_users(r, int(m)), E=[x.word for x in words.collect()])


def top_categories(spark, reviews, business, out, n):
    reports.json_object(out, result=review.top_categories(_reviews(spark, reviews), files.json_lines(spark, business, BUSINESS), int(n)))


def partition_stats(spark, reviews, out, n, partitions=None):
    r = _reviews(spark, reviews).select("business_id")
    held = review.partition_stats(r, "business_id", int(partitions) if partitions else None).orderBy("partition_id").collect()
    reports.json_object(out, n_partitions=len(held), n_items=[x.n_items for x in held], result=review.busy_business(r, int(n)))


def frequent(spark, csv, out, support, case="1"):
    rows = files.csv_pairs(spark, csv, swap=case == "2")
    candidates = itemsets.son_candidates(rows, "basket", "item", int(support))
    reports.itemset_report(out, candidates, itemsets.frequent_itemsets(rows, "basket", "item", int(support)))


def similar_business(spark, reviews, out, threshold="0.055"):
    r = _reviews(spark, reviews).select("user_id", "business_id").dropna().distinct()
    sigs = similarity.minhash(r.join(similarity.dense_index(r, "user_id"), "user_id"), "business_id", "idx")
    found = similarity.jaccard_join(r, "business_id", "user_id", float(threshold), similarity.lsh_candidates(sigs, "business_id"))
    reports.json_lines(found.select(F.col("id1").alias("b1"), F.col("id2").alias("b2"), "sim"), out)


def content_train(spark, reviews, model, stop):
    r = _reviews(spark, reviews)
    top = profiles.business_profile(profiles.tfidf(r, "business_id", "text", files.stop_words(spark, stop)))
    top.write.mode("overwrite").parquet(f"{model}/business_profile")
    profiles.user_profile(r, spark.read.parquet(f"{model}/business_profile")).write.mode("overwrite").parquet(f"{model}/user_profile")


def content_predict(spark, pairs, model, out):
    held = [spark.read.parquet(f"{model}/{part}_profile") for part in ("user", "business")]
    reports.json_lines(profiles.cosine_score(files.json_lines(spark, pairs, PAIRS), *held), out)


def cf_train(spark, reviews, model, kind):
    rated = recommend.ratings(_reviews(spark, reviews))
    made = recommend.item_cf_model(rated) if kind == "item" else recommend.user_cf_model(rated)
    reports.json_lines(made, model)


def cf_predict(spark, reviews, pairs, model, out, kind):
    r = _reviews(spark, reviews)
    rated, asked = recommend.ratings(r), files.json_lines(spark, pairs, PAIRS)
    if kind == "item":
        made = files.json_lines(spark, model, "b1 string, b2 string, sim double")
        found = recommend.item_cf_predict(asked, rated, made, recommend.entity_averages(r, "business_id"))
    else:
        made = files.json_lines(spark, model, "u1 string, u2 string, sim double")
        found = recommend.user_cf_predict(asked, rated, made, recommend.entity_averages(r, "user_id"))
    reports.json_lines(found, out)


def communities(spark, csv, out, threshold):
    e = graph.cooccur_graph(files.csv_pairs(spark, csv), "basket", "item", int(threshold))
    reports.text(reports.community_lines(graph.label_propagation(graph.vertices(e), e).withColumnRenamed("label", "community")), out)


def divide(spark, csv, out, betweenness, case="2"):
    rows = files.csv_pairs(spark, csv)
    e = graph.jaccard_graph(rows, "basket", "item", 0.5) if case == "2" else graph.edge_graph(rows, "basket", "item")
    reports.text(reports.betweenness_lines(graph.edge_betweenness(graph.vertices(e), e)), betweenness)
    reports.text(reports.community_lines(graph.girvan_newman(graph.vertices(e), e, "2m" if case == "2" else "m")), out)


def bloom(spark, first, second, out):
    bits = sketches.bloom_build(files.json_lines(spark, first, "name string"), "name")
    asked = files.json_lines(spark, second, "name string").withColumn("at", F.monotonically_increasing_id())
    hits = sketches.bloom_probe(asked, "name", bits)
    ordered = asked.join(hits, asked["name"].eqNullSafe(hits["name"])).orderBy("at").select("hit")
    reports.hits_row(out, (r.hit for r in ordered.toLocalIterator()))


def stream_distinct(spark, host, port, out, checkpoint):
    rows = files.parsed(files.socket_lines(spark, host, int(port)), "state string")
    windows.start(windows.distinct_stream(rows, "timestamp", "state"), checkpoint, csv=out, every="5 seconds").awaitTermination()


def trending(spark, host, port, out, checkpoint):
    rows = files.parsed(files.socket_lines(spark, host, int(port)), "entities struct<hashtags: array<struct<text: string>>>")
    sampled = sampling.reservoir_stream(rows.select(F.col("entities.hashtags.text").alias("tags")), "tags")
    sampling.report_trending(sampled, out, checkpoint, once=False).awaitTermination()


def rate_train(spark, reviews, users, business, model):
    features = regression.rating_features(recommend.ratings(_reviews(spark, reviews)), files.json_lines(spark, users, USERS), files.json_lines(spark, business, BUSINESS))
    regression.fit_ratings(features).save(spark, model)


def rate_predict(spark, pairs, users, business, model, out):
    features = regression.rating_features(files.json_lines(spark, pairs, PAIRS), files.json_lines(spark, users, USERS), files.json_lines(spark, business, BUSINESS))
    reports.json_lines(regression.predict_ratings(regression.Trees.load(spark, model), features), out)


COMMANDS = {
    "review-stats": review_stats, "top-categories": top_categories, "partition-stats": partition_stats, "itemsets": frequent, "similar-business": similar_business,
    "content-train": content_train, "content-predict": content_predict, "cf-train": cf_train, "cf-predict": cf_predict, "communities": communities, "divide": divide,
    "bloom": bloom, "stream-distinct": stream_distinct, "trending": trending, "rate-train": rate_train, "rate-predict": rate_predict,
}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    plain, named, rest = [], {}, list(args[1:])
    while rest:
        one = rest.pop(0)
        if one.startswith("--"):
            named[one[2:]] = rest.pop(0)
        else:
            plain.append(one)
    COMMANDS[args[0]](spark or SparkSession.builder.appName(f"dredgeline {args[0]}").getOrCreate(), *plain, **named)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
