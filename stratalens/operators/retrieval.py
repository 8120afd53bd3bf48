"""Looking documents up by words: bounded inverted lists for the best documents, and words that hold a keyword by their trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators.reach import settled

BLOCK_DOCS, SMALL_SIDE, LEAST_TERM = 1024, 20_000, 3


def terms_of(text: Column) -> Column:
    """Runs of letters a-z, digits and underscores of the lower-cased text, of three characters or more, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: F.length(x) >= LEAST_TERM)


def checked(table: DataFrame, most: int = SMALL_SIDE) -> DataFrame:
    """A written table: broadcast if it has `most` rows at most, else joined like any other."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def best_documents(docs: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """item_id, doc_id, score, k: each question's k documents (doc_id, text) with most of its terms, ties to the smaller id; documents without any are none.

    A question's terms are met rarest first, in rounds that double. A document with `floor` of a question's m terms holds one of its m - floor + 1 rarest,
    so once k documents are known lists of terms behind that are never read. Lists are cut into blocks of documents of like numbers of
    terms; a block whose largest document has fewer terms than the floor is passed over. Only what is left becomes rows, which are scored on their whole terms.
    """
    asked = questions.select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
    asked = settled(asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    held = settled(docs.select("doc_id", F.array_distinct(terms_of(F.col("text"))).alias("terms")))  # read in every round
    word = asked.select("item_id", F.explode("terms").alias("term"), F.size("terms").alias("m"))
    wanted = checked(settled(word.select("term").distinct()))
    postings = settled(held.select("doc_id", F.size("terms").alias("size"), F.explode("terms").alias("term")).join(wanted, "term"))
    held_by = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy("n", "term"))
    placed = settled(word.join(held_by, "term").withColumn("place", place))
    buckets = max(1, -(-held.count() // BLOCK_DOCS))
    best, low = None, 1
    while True:
        floors = asked.select("item_id", F.lit(1).alias("floor"))
        if best is not None:
            full = best.groupBy("item_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
            floors = floors.join(full, "item_id", "left").select("item_id", F.greatest("floor", F.coalesce("least", "floor")).alias("floor"))
        ahead = settled(placed.filter(F.col("place") >= low).join(floors, "item_id").filter(F.col("place") <= F.col("m") - F.col("floor") + 1))
        if ahead.isEmpty():
            break
        now = settled(ahead.filter(F.col("place") < 2 * low).select("term", "item_id", "floor"))
        lists = postings.join(checked(settled(now.groupBy("term").agg(F.min("floor").alias("low")))), "term").filter(F.col("size") >= F.col("low"))
        block = ["term", F.floor(F.log2("size")).alias("class"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")]
        lists = lists.groupBy(*block).agg(F.collect_list("doc_id").alias("docs"), F.max("size").alias("bound"))
        found = lists.join(now, "term").filter(F.col("bound") >= F.col("floor")).select("item_id", F.explode("docs").alias("doc_id")).distinct()
        found = settled(found if best is None else found.join(best.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti"))
        ids = checked(settled(found.select("doc_id").distinct()))
        score = F.size(F.array_intersect("terms", "held"))
        scored = found.join(held.join(ids, "doc_id", "left_semi").withColumnRenamed("terms", "held"), "doc_id").join(asked, "item_id").select("item_id", "doc_id", score.alias("score"))
        every = scored if best is None else best.select("item_id", "doc_id", "score").union(scored)
        rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        best = settled(every.withColumn("k", rank).filter(F.col("k") <= k))
        low *= 2
    return best if best is not None else placed.select("item_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("score"), F.lit(0).alias("k")).limit(0)


def holding(vocabulary: DataFrame, keywords: DataFrame) -> DataFrame:
    """term, keyword: which of the terms hold which keyword (of three characters or more) within them; met by one trigram of the keyword, never all with all."""
    trigrams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    grams = vocabulary.filter(F.length("term") >= LEAST_TERM).select("term", F.explode(F.array_distinct(trigrams(F.col("term")))).alias("gram"))
    sought = keywords.select("keyword", F.substring("keyword", F.floor((F.length("keyword") + 1) / 2).cast("int") - 1, F.lit(3)).alias("gram")).distinct()
    return grams.join(sought, "gram").filter(F.contains("term", "keyword")).select("term", "keyword").distinct()


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, no (from 1), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("no"), "line")


def keyword_hits(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, doc_id, no, keyword, times: lines that hold a question's keyword (asked: item_id, keyword), and how often, within words too."""
    tokens = lines_of(docs).select("doc_id", "no", F.explode(terms_of(F.col("line"))).alias("term"))
    matched = settled(holding(tokens.select("term").distinct(), asked))
    times = (F.length("term") - F.length(F.replace("term", "keyword", F.lit("")))) / F.length("keyword")
    found = tokens.join(checked(matched), "term").select("doc_id", "no", "keyword", times.cast("long").alias("times")).groupBy("doc_id", "no", "keyword").agg(F.sum("times").alias("times"))
    return found.join(asked, "keyword").select("item_id", "doc_id", "no", "keyword", "times")
