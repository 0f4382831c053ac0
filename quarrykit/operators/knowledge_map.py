"""The map of a space: its domain, topics, documents, cards and insights as weighted nodes, and what ties them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of topics by importance, of others, the least of a document, cards from which a topic counts as full.
IMPORTANCE, OTHER_IMPORTANCE, LEAST_DOCUMENT, FULL = {"core": 1.0, "common": 0.7, "advanced": 0.5}, 0.6, 0.2, 3
DOMAIN = "domain"


def _unit(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))


def knowledge_map(topics: DataFrame, documents: DataFrame, cards: DataFrame, insights: DataFrame, most_cards: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of topics(id, importance, cards), documents(id, status), cards(id, confidence, documents) and insights(id, confidence, cards); cards and documents
    are arrays of ids.

    The ``most_cards`` of greatest confidence are drawn; others still count for a topic's mastery and a document's weight. Topics and documents hang on the domain,
    cards on their topics and documents, or on the domain where they have none that is drawn, insights on their cards, or on the domain. nodes are (id, kind,
    weight, mastery, status), edges (src, dst, kind), each once.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    drawn = cards.orderBy(F.desc("confidence"), "id").limit(most_cards).select("id", "confidence", "documents")
    made = cards.select("id", F.explode(F.array_distinct("documents")).alias("document")).join(documents.select(F.col("id").alias("document")), "document").groupBy("document").agg(F.count("*").alias("produced"))
    hits = topics.select(F.col("id").alias("topic"), F.explode(F.array_distinct("cards")).alias("id")).join(cards.select("id", "confidence"), "id")
    mastery = hits.groupBy("topic").agg((F.least(F.lit(1.0), F.count("*") / FULL) * F.avg(_unit("confidence"))).alias("m"))
    importance = F.coalesce(*(F.when(F.col("importance") == k, w) for k, w in IMPORTANCE.items()), F.lit(OTHER_IMPORTANCE))
    topic_nodes = topics.join(mastery.withColumnRenamed("topic", "id"), "id", "left").select(name("topic", "id").alias("id"), F.lit("topic").alias("kind"), importance.alias("weight"), F.round(F.coalesce("m", F.lit(0.0)), 3).alias("mastery"), F.when(F.col("m").isNull(), "uncovered").otherwise("covered").alias("status"))
    whole = topic_nodes.agg(F.round(F.avg("mastery"), 3).alias("mastery")).select(F.lit(DOMAIN).alias("id"), F.lit(DOMAIN).alias("kind"), F.lit(1.0).alias("weight"), "mastery", F.lit(None).cast("string").alias("status"))
    top = made.agg(F.coalesce(F.max("produced"), F.lit(0)).alias("top"))
    share = F.when(F.col("top") > 0, F.coalesce("produced", F.lit(0)) / F.col("top")).otherwise(0.0)
    document_nodes = documents.join(made.withColumnRenamed("document", "id"), "id", "left").join(F.broadcast(top)).select(name("document", "id").alias("id"), F.lit("document").alias("kind"), F.round(F.greatest(F.lit(LEAST_DOCUMENT), share), 3).alias("weight"), F.lit(None).cast("double").alias("mastery"), "status")
    unit = F.round(_unit("confidence"), 3)
    own = lambda df, kind: df.select(name(kind, "id").alias("id"), F.lit(kind).alias("kind"), unit.alias("weight"), unit.alias("mastery"), F.lit(None).cast("string").alias("status"))
    nodes = whole.unionByName(topic_nodes).unionByName(document_nodes).unionByName(own(drawn, "card")).unionByName(own(insights, "insight"))

    def links(df, src, dst, kind):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))

    covers = links(hits.join(drawn.select("id"), "id", "left_semi"), name("topic", "topic"), name("card", "id"), "covers")
    made_by = drawn.select("id", F.explode("documents").alias("document")).join(documents.select(F.col("id").alias("document")), "document", "left_semi")
    source = links(made_by, name("document", "document"), name("card", "id"), "source")
    tied = covers.select("dst").unionByName(source.select("dst")).distinct()
    orphans = drawn.select(name("card", "id").alias("dst")).join(tied, "dst", "left_anti").select(F.lit(DOMAIN).alias("src"), "dst", F.lit("covers").alias("kind"))
    led = insights.select("id", F.explode("cards").alias("card")).join(drawn.select(F.col("id").alias("card")), "card", "left_semi")
    insight = links(led, name("card", "card"), name("insight", "id"), "insight")
    free = insights.select(name("insight", "id").alias("dst")).join(insight.select("dst").distinct(), "dst", "left_anti").select(F.lit(DOMAIN).alias("src"), "dst", F.lit("insight").alias("kind"))
    hang = lambda df, kind, edge: df.select(F.lit(DOMAIN).alias("src"), name(kind, "id").alias("dst"), F.lit(edge).alias("kind"))
    edges = hang(topics, "topic", "topic").unionByName(hang(documents, "document", "source")).unionByName(covers).unionByName(source).unionByName(orphans).unionByName(insight).unionByName(free)
    return nodes, edges.distinct()
