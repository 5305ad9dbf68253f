"""Exact duplicates by distributed most-significant-byte radix partitioning.

Every round splits the open groups by their next run of bytes; a group that is left with one text, or whose texts have
ended, is closed. Texts are compared by their bytes alone. Copies share all their bytes, so the runs grow by a factor and
the number of rounds is the logarithm of the longest repeated text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siterank.llm.common import Scratch

SALTS = 32
HOT = 1000
WHITE = r"[\x20\x09-\x0D]+"


def normal(text: str = "text") -> Column:
    """Text with every run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, " ")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", first_run: int = 128, growth: int = 8) -> DataFrame:
    """One row per input row: id, keep_id (smallest id of its equal texts), group_size (rows of the group), kept, sha256.

    Null text counts as empty. Rows that repeat both id and text give a row each, all of them kept where theirs is the smallest id.
    A null id is never preferred to another one. Columns other than the two named are not read. An empty table
    gives an empty result. The hash is output only and takes no part in the comparison.

    Group sizes and smallest ids are partial aggregates, so thousands of copies reach a reducer as one row per task. In the
    join that hands them back, groups of more than a thousandth of the rows (under a thousand of them, known by a hash) are dealt over ``SALTS`` keys.
    """
    scratch = Scratch(docs.sparkSession)
    text = normal(text_column)
    live = docs.select(F.col(id_column).alias("id"), F.sha2(text, 256).alias("sha256"), text.cast("binary").alias("rest"), F.lit(None).cast("long").alias("grp"))
    done, rounds, run = [], [], first_run
    while True:
        keyed = live.select("id", "sha256", "rest", F.coalesce("grp", F.lit(-1)).alias("grp"), F.expr(f"substring(rest, 1, {run})").alias("head"), (F.octet_length("rest") <= run).alias("ended"))
        keys = ["grp", "head", "ended"]
        keyed = keyed.withColumn("tag", F.monotonically_increasing_id())  # names the group even where ids repeat or are null
        tagged = keyed.select("id", *keys, "tag")
        counted = scratch.write(tagged.groupBy(keys).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("tag").alias("next")).filter("n > 1"))
        hot = [r.h for r in counted.filter(F.col("n") * HOT > live.count()).select(F.xxhash64(*keys).alias("h")).collect()]
        is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
        shared = counted.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        keyed = keyed.withColumn("salt", F.when(is_hot, F.pmod("tag", F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        goes_on = F.col("n").isNotNull() & ~F.col("ended")
        split = keyed.join(shared, [*keys, "salt"], "left").select(
            "id", "sha256", goes_on.alias("live"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("rep")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
            F.when(goes_on, F.expr(f"substring(rest, {run + 1})")).alias("rest"), F.when(goes_on, F.col("next")).alias("grp"))
        table = scratch.write(split)
        rounds += [table, counted]
        done.append(table.filter("not live").select("id", "keep_id", "group_size", "sha256"))
        live = table.filter("live").select("id", "sha256", "rest", "grp")
        if live.isEmpty():
            break
        run *= growth
    out = scratch.write(reduce(DataFrame.unionByName, done))
    scratch.drop(*rounds)  # they hold what was left of the texts
    return out.select(F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256")
