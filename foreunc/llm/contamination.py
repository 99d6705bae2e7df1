"""Benchmark items inside documents: size-partitioned MinHash containment search, DataFrame only.

An item is held in a document if the document has at least a given share of the item's distinct word
shingles. Items are partitioned by size; those of one class keep equally many of their least shingle
hashes, one more than the shingles that a document may lack in the largest item of the class, so a
document that holds an item has at least one of them and no item is missed. Documents too short for
an item are dropped at once. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreunc.llm.common import written

BLANKS = " \t\n\x0b\f\r"
WORDS = 5
SHARE = 80
#: Rows of kept hashes (under 50 bytes each) up to which they are broadcast; above it they are
#: joined by a shuffle of both sides.
BROADCAST_ROWS = 1_000_000


def word_list(text: str) -> Column:
    """Words of a text column, lowered, parted by ASCII white space; none for null or blank."""
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def shingle_places(rows: DataFrame, key: list[str], words: int) -> DataFrame:
    """``key``, ``words`` and ``at``: one row per shingle, which starts at word ``at`` (from 0).

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    listed = rows.select(*key, word_list("text").alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(words), F.lit(0))
    return listed.select(*key, "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))


def shingle_hash(words: int) -> Column:
    return F.xxhash64(*(F.get("words", F.col("at") + j) for j in range(words)))


def shingle_text(words: int) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, words), " ")


def contaminated(
    docs: DataFrame, items: DataFrame, words: int = WORDS, share: int = SHARE
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where ``docs`` (doc_id, text) hold ``items`` (item_id, text).

    n_item is the number of distinct shingles of the item, n_shared how many of them the document
    has; 100 * n_shared >= share * n_item. Rows with a null id and null or blank texts take no part;
    rows with one id count as one document or item; a text of fewer than ``words`` words is one
    shingle, so such an item is found in an equal text only. Other columns are ignored.
    """
    item_places = shingle_places(items.filter("item_id IS NOT NULL"), ["item_id"], words)
    item_shingles = written(
        item_places.select("item_id", shingle_hash(words).alias("hash"), shingle_text(words).alias("shingle"))
        .distinct(),
        "items",
    )
    sizes = item_shingles.groupBy("item_id").agg(F.countDistinct("shingle").alias("n_item"))
    sizes = sizes.withColumn("class", F.floor(F.log2("n_item")))
    # The class's largest size is below 2^(class + 1); a document may lack n - ceil(share n / 100).
    kept = F.floor((F.pow(F.lit(2.0), F.col("class") + 1) - 1) * (100 - share) / 100) + 1
    ranked = item_shingles.join(sizes, "item_id").withColumn(
        "place", F.expr("row_number() OVER (PARTITION BY item_id ORDER BY hash, shingle)")
    )
    sketch = written(
        ranked.filter(F.col("place") <= kept).select(
            "hash", "item_id", F.ceil(F.col("n_item") * share / 100).alias("need")
        ),
        "sketch",
    )
    small = sketch.count() <= BROADCAST_ROWS
    doc_places = shingle_places(docs.filter("doc_id IS NOT NULL"), ["doc_id"], words)
    hashed = doc_places.select("doc_id", shingle_hash(words).alias("hash"))
    candidates = written(
        hashed.join(F.broadcast(sketch) if small else sketch, "hash")
        .select("doc_id", "item_id", "need")
        .distinct(),
        "candidates",
    )
    suspects = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    held = (
        shingle_places(suspects, ["doc_id"], words)
        .select("doc_id", shingle_text(words).alias("shingle"))
        .join(item_shingles.select("item_id", "shingle").distinct(), "shingle")
        .join(candidates.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("shingle").alias("n_shared"))
    )
    return (
        held.join(sizes.select("item_id", "n_item"), "item_id")
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * share)
        .select("doc_id", "item_id", "n_shared", "n_item")
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns; rows without an id stay."""
    found = written(contaminated(docs, items).select("doc_id").distinct(), "found")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
