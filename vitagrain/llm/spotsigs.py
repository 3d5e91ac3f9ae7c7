"""SpotSigs document fingerprints, in SQL functions only.

An anchor is a very common word (short function words of four languages, or any
word of one or two characters); the CHAIN content words that follow it form a
spot. A document's fingerprint is the set of its spots as 32-bit hashes, so
pieces of running prose count and bare lists or markup hardly do. A text without
spots is the set of its words instead, and one without words a single zero, so
equal texts always have equal fingerprints.

Sets are compared by Jaccard, pruned by length: sets fall into classes of sizes
that grow by 1 / likeness, sets two classes apart cannot reach it, and inside
those the smaller size over the larger bounds the likeness before any set is
intersected.

Every text is one row: words, positions of content words and the slices between
them are arrays of that row, each passed once. The edited texts of the query
need the next document: ids are range partitioned and numbered without a global
sort of texts, then half texts travel to their predecessors.

Defined cases: null text is empty; of rows with a null id the order is by text
and they come first; rows equal in id and text count once in the order and each
get the result; a single document is its own next; very long texts are taken
whole; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import shared_folder, written

#: Common short words of English, German, French and Spanish.
ANCHORS = (
    "the and for was are that this with his her they from have has had not you but all one can were been would there "
    "their what which will about when who more its into than them some "
    "der die das und den von mit ist des für auf dem ein eine einen nicht sich als auch werden aus hat dass sie nach "
    "wird bei einer über noch war "
    "les des une est que pour qui dans pas sur par plus avec son sont aux mais comme ses nous vous cette été "
    "los las del una por con para como pero sus más este esta entre cuando muy sin sobre ser todo"
).split()
CHAIN = 2
LEAST_ID = -(1 << 63)


def spots(text: str = "text") -> list[tuple[str, str]]:
    """Columns to add one after another, as (name, SQL): words, content words, and the spots."""
    anchors = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))
    chain = ", ".join(f"get(content, k + {n}).w" for n in range(1, CHAIN))
    between = "slice(words, IF(k = 0, 0, get(content, k - 1).i + 1) + 1, x.i - IF(k = 0, 0, get(content, k - 1).i + 1))"
    return [
        ("words", f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"),
        ("content", f"filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), "
                    f"x -> length(x.w) > 2 AND x.w NOT IN ({anchors}))"),
        ("spots", f"array_distinct(flatten(transform(content, (x, k) -> IF(k + {CHAIN} > size(content), "
                  f"cast(array() AS array<int>), transform({between}, a -> hash(a, x.w, {chain}))))))"),
        ("spots", "CASE WHEN size(spots) > 0 THEN spots WHEN size(words) > 0 "
                  "THEN array_distinct(transform(words, w -> hash(w))) ELSE array(0) END"),
    ]


def with_spots(df: DataFrame, text: str, out: str) -> DataFrame:
    """The frame with `out`: the distinct spot hashes of a text."""
    for name, sql in spots(text):
        df = df.withColumn(name, F.expr(sql))
    return df.withColumnRenamed("spots", out).drop("words", "content")


def fingerprint(found: Column) -> Column:
    """Spots in order as one string."""
    return F.array_join(F.array_sort(found).cast("array<string>"), " ")


def length_class(found: Column, likeness: float) -> Column:
    """Sets that reach the likeness lie in the same or in neighbouring classes of size."""
    return F.floor(F.log(F.size(found)) / F.log(F.lit(1 / likeness)) + 1e-9).cast("int")


def pruned_jaccard(a: Column, b: Column, likeness: float = 0.0) -> Column:
    """Jaccard of two spot sets; 0 where their sizes rule the likeness out."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.least(F.size(a), F.size(b)) < F.greatest(F.size(a), F.size(b)) * likeness, 0.0).otherwise(
        both / (F.size(a) + F.size(b) - both))


def near(pairs: DataFrame, a: str, b: str, likeness: float = 0.8) -> DataFrame:
    """The pairs whose spot sets in columns a and b reach the likeness."""
    apart = F.abs(length_class(F.col(a), likeness) - length_class(F.col(b), likeness))
    return pairs.where((apart <= 1) & (pruned_jaccard(F.col(a), F.col(b), likeness) >= likeness))


def keyed(docs: DataFrame) -> DataFrame:
    """id (least for null), text hash, doc_id and text of each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    key = docs["doc_id"].cast("long")
    return docs.select(F.coalesce(key, F.lit(LEAST_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def successors(rows: DataFrame) -> DataFrame:
    """id, mark, n_chars, next_id, next_mark: the next document in ascending id, after the last the first.

    Ids are range partitioned; the next one is found inside each part, and the
    first of the next part (one row a part) follows the last of a part.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.groupBy("id", "mark").agg(F.max(F.char_length("text")).alias("n_chars"))
    ids = written(ids.repartitionByRange(parts, "id", "mark").withColumn("part", F.spark_partition_id()),
                  shared_folder(rows.sparkSession), "ids")
    here = F.struct("id", "mark")
    inside = ids.withColumn("follows", F.lead(here).over(Window.partitionBy("part").orderBy("id", "mark")))
    firsts = ids.groupBy("part").agg(F.min(here).alias("first"))
    ring = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(ring), F.min("first").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    met = inside.join(F.broadcast(firsts), "part")  # one row for each shuffle partition
    after = F.coalesce("follows", "beyond")
    return met.select("id", "mark", "n_chars", after["id"].alias("next_id"), after["mark"].alias("next_mark"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses."""
    rows = keyed(docs)
    asked = successors(rows).select(F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), "n_chars",
                                    F.col("next_id").alias("id"), F.col("next_mark").alias("mark"))
    half = F.expr("substring(text, 1, cast(n_chars div 2 AS int))")
    sent = with_spots(rows.join(asked, ["id", "mark"]), "text", "next_spots").select(
        F.col("to_id").alias("id"), F.col("to_mark").alias("mark"), "n_chars", half.alias("half"), "next_spots")
    sent = sent.dropDuplicates(["id", "mark"])  # a repeated next row sends the same
    met = rows.join(sent, ["id", "mark"])
    met = met.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 AS int)), half)"))
    met = with_spots(with_spots(met, "text", "own"), "edited", "other")
    own, other = F.col("own"), F.col("other")
    return met.select(
        F.when(F.col("id") != LEAST_ID, F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
        pruned_jaccard(own, other).alias("near_edited"), pruned_jaccard(own, F.col("next_spots")).alias("near_next"),
        length_class(own, 0.8).alias("length_class"))
