"""Exact dedup by deterministic block naming, in DataFrame functions alone.

Texts are equal when their normal forms are: the text without ASCII white space. A text whose
length and 64-bit hash no other text has is alone. The others are cut into fixed-size blocks; the
distinct blocks, sorted, are numbered, and adjacent numbers are paired and the distinct pairs
numbered again, until every text is one number. Equal texts meet in the same number and different
ones never do, as each step maps distinct blocks or pairs to distinct numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import SPACE_CLASS, materialise, text_or_empty

#: Code points in a block.
BLOCK = 4096


def normal_form(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), SPACE_CLASS, "")


def _numbered(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows in sorted order with rising unique integers, written once so that they stay."""
    return materialise(distinct.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), name)


def block_identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, normal) to (key, round, name): equal (round, name) if and only if equal ``normal``.

    ``key`` must tell rows with different texts apart; repeated rows are equal in both.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("normal") / block)).cast("int") - 1)
    blocks = texts.select("key", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("normal"), i * block + 1, block))).alias("idx", "block"))
    names = _numbered(blocks.select(F.col("block").alias("n_block")).distinct(), ["n_block"], "block-names")
    left = materialise(blocks.join(names, F.col("block") == F.col("n_block")).select("key", "idx", "name"), "blocks")
    done, step = None, 0
    while True:
        counted = left.groupBy("key", F.shiftright("idx", 1).alias("idx")).agg(
            F.min_by("name", "idx").alias("a"),
            F.when(F.min("idx") < F.max("idx"), F.max_by("name", "idx")).otherwise(-1).alias("b"),
            F.max("idx").alias("top"),
        )
        # A key whose only block is number 0 has its identity: nothing of it has a place above 0.
        longest = left.groupBy("key").agg(F.max("idx").alias("last"))
        single = left.join(longest.filter("last = 0").select(F.col("key").alias("s_key")), F.col("key") == F.col("s_key")).select("key", F.lit(step).alias("round"), "name")
        single = materialise(single.distinct(), "named")
        done = single if done is None else done.unionByName(single)
        open_keys = longest.filter("last > 0").select(F.col("key").alias("o_key"))
        pairs = materialise(counted.join(open_keys, F.col("key") == F.col("o_key")).select("key", "idx", "a", "b"), "pairs")
        if pairs.isEmpty():
            return done
        step += 1
        names = _numbered(pairs.select(F.col("a").alias("n_a"), F.col("b").alias("n_b")).distinct(), ["n_a", "n_b"], "pair-names")
        left = materialise(pairs.join(names, (F.col("a") == F.col("n_a")) & (F.col("b") == F.col("n_b"))).select("key", "idx", "name"), "blocks")


def exact_groups(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the one with
    the smallest id, null ids last. Null text counts as empty, and empty texts are equal to each
    other. Rows repeated with id and text are one document and share its decision. Other columns
    are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("normal", normal_form())
    facts = base.select("doc_id", F.length("text").alias("chars"), F.length("normal").alias("n"), F.xxhash64("normal").alias("h"), F.sha2("normal", 256).alias("text_sha256"))
    facts = materialise(facts, "dedup-facts")
    shared = materialise(facts.groupBy(F.col("n").alias("c_n"), F.col("h").alias("c_h")).count().filter("count > 1").drop("count"), "dedup-candidates")
    keyed = base.select(F.struct("doc_id", F.sha2("normal", 256).alias("text_sha256")).alias("key"), F.length("normal").alias("n"), F.xxhash64("normal").alias("h"), "normal")
    texts = materialise(keyed.join(shared, (F.col("n") == F.col("c_n")) & (F.col("h") == F.col("c_h"))).select("key", "normal"), "dedup-texts")
    named = block_identities(texts, block).select(F.col("key.doc_id").alias("i_doc"), F.col("key.text_sha256").alias("i_sha"), "round", "name")
    same = F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_sha256") == F.col("i_sha"))
    rows = materialise(facts.join(named, same, "left").select("doc_id", "chars", "text_sha256", "round", "name"), "dedup-rows")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id")))
    groups = rows.filter("name IS NOT NULL").groupBy(F.col("round").alias("g_round"), F.col("name").alias("g_name")).agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = materialise(groups.select("g_round", "g_name", "best.keep_id", "group_size"), "dedup-groups")
    joined = rows.join(groups, (F.col("round") == F.col("g_round")) & (F.col("name") == F.col("g_name")), "left")
    alone = F.col("g_name").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
