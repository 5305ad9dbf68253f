"""A Merkle manifest of a table of documents: one tree of digests per language, and one tree over the languages' roots.

Levels are built bottom-up and stored as node rows that name their parent, their place among its children and their
own children's digests. A recursive query then climbs from every leaf to the root: each step appends the
siblings it meets and folds the (possibly tampered) digest into its parent's. The up to eight leaves of one run climb in one row, each with
a folded digest of its own, as from their parent on they have the same siblings. A node that many runs meet is stored in as
many numbered copies as it has groups of 64 leaves below it (4,096 at most), and a run meets the copy of its own number, so no
step of the climb gathers a language, or all leaves, under one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.llm.common import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
TOP = ""  # the tree over the languages; trees of languages have the encoded language as name, which is never empty
GROUP, MOST_COPIES = 64, 4096
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def positions(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``row`` (a number of its own), ``pos`` (place in its group from 0) and ``n`` (rows of the group).

    Rows are sorted by ranges over all tasks; a group's place in a partition is the sum of the counts before it, so only one
    row for each group and partition passes through a window. Nulls come first.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    sorted_ = scratch.write(rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    counts = sorted_.groupBy(*group, part.alias("part")).agg(F.min("row").alias("low"), F.count("*").alias("size"))
    whole = W.partitionBy(*group)
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    counts = counts.select(*group, "part", (before - F.col("low")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return sorted_.withColumn("part", part).join(counts, [*group, "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "shift")


def children_text(children: str = "children") -> Column:
    return F.lower(F.hex(children))


def build_levels(bottom: DataFrame, scratch: Scratch, level: int) -> list[DataFrame]:
    """All levels above ``bottom`` (tree, pos, n, digest), which is level ``level``: rows tree, level, pos, n (nodes of the level), children (their
    digests, one after the other) and digest. Every run of FAN nodes meets in one row."""
    levels, now = [], bottom.select("tree", "pos", "n", "digest")
    most = now.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = now.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        made = runs.select("tree", F.lit(len(levels) + level + 1).alias("level"), "pos", F.ceil(F.col("n") / FAN).alias("n"), F.unhex(F.array_join("run.digest", "")).alias("children"))
        levels.append(scratch.write(made.withColumn("digest", F.sha2(children_text(), 256))))
        now, most = levels[-1], -(-most // FAN)
    return levels


def copies(tree: str, level: str, leaves: int) -> Column:
    """In how many copies a node is stored: one for each GROUP leaves below it, up to MOST_COPIES."""
    top = min(MOST_COPIES, max(1, leaves // GROUP))
    return F.when(F.col(tree) == TOP, top).otherwise(F.least(F.lit(MOST_COPIES), F.greatest(F.lit(1), F.pow(F.lit(FAN), F.col(level)) / GROUP))).cast("long")


def linked(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Nodes with their parent (up_tree, up_level, up_pos) and their place in its run; null at the root. ``roots``: place and
    number of the trees' roots in the tree over them."""
    inner = nodes.filter("n > 1").select(*nodes.columns, F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.floor(F.col("pos") / FAN).alias("up_pos"), (F.col("pos") % FAN).cast("int").alias("slot"),
                                         F.lit(None).cast("string").alias("subroot"))
    ends, up = nodes.filter("n = 1"), F.lit(None)
    if roots is not None:
        ends = ends.join(roots, "tree")
        up = F.when(F.col("trees") > 1, F.lit(TOP))
    place = F.col("place") if roots is not None else F.lit(None).cast("long")
    return inner.unionByName(ends.select(*nodes.columns, up.cast("string").alias("up_tree"), F.when(up.isNotNull(), 1).alias("up_level"), F.when(up.isNotNull(), F.floor(place / FAN)).alias("up_pos"),
                                         F.when(up.isNotNull(), place % FAN).cast("int").alias("slot"), (F.col("digest") if roots is not None else F.lit(None).cast("string")).alias("subroot")))


_FOLD = "unhex(sha2(concat(lower(hex({before})), lower(hex({digest})), lower(hex({after}))), 256))"
_SIDES = {"before": "substring(n.children, 1, 32 * c.slot)", "after": "substring(n.children, 32 * c.slot + 33)"}
CLIMB = f"""
WITH RECURSIVE climb (tree, pos, ids, children, step, up_tree, up_level, up_pos, slot, subroot, folded, siblings) AS (
  SELECT tree, pos, ids, children, 0, up_tree, up_level, up_pos, slot, subroot,
         CASE WHEN level = 0 THEN presented ELSE transform(presented, (p, i) -> {_FOLD.format(before="substring(children, 1, 32 * i)", digest="p", after="substring(children, 32 * i + 33)")}) END,
         CAST('' AS BINARY) FROM {{leaves}}
  UNION ALL
  SELECT c.tree, c.pos, CAST(NULL AS ARRAY<BIGINT>), CAST(NULL AS BINARY), c.step + 1, n.up_tree, n.up_level, n.up_pos, n.slot, n.subroot,
         transform(c.folded, f -> {_FOLD.format(digest="f", **_SIDES)}), concat({_SIDES["before"]}, {_SIDES["after"]})
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos
    AND n.copy = pmod(c.pos, CASE WHEN c.up_tree = '{TOP}' THEN {{top_copies}} ELSE CAST(least({MOST_COPIES}, greatest(1, pow({FAN}, c.up_level) / {GROUP})) AS BIGINT) END))
SELECT tree, pos, ids, children, step, subroot, CASE WHEN up_tree IS NULL THEN folded END AS folded, siblings FROM climb"""


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings from the leaf up), folded_root
    and verified. Reads doc_id, source, lang, n_chars and text; other columns are ignored.

    Rows for which ``tampered`` holds present the digest of their text with A-Z lower-cased; a null condition counts as
    false. Nulls are encoded as ``-``, so a null and an empty text differ. Within a language leaves ascend by doc_id (null
    first), then by digest; equal rows give equal leaves, in whichever order. A null language is a language of its own,
    ordered first. A lone leaf is its language's root, a lone language's root is the root; siblings are none then.
    Texts of any length are hashed where they lie. An empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    touched = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("n_chars").cast("long").alias("n_chars"))
    digests = scratch.write(base.select("doc_id", field(F.col("lang")).alias("tree"), leaf_digest(F.col("text")).alias("digest"), F.when(touched, leaf_digest(lower_ascii(F.col("text")))).alias("presented")))
    placed = positions(digests, ["tree"], ["doc_id", "digest"], scratch)
    run = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "digest", "presented")))
    runs = placed.groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos"), "n").agg(run.alias("run"))
    runs = runs.withColumn("children", F.unhex(F.array_join("run.digest", "")))
    bottom = scratch.write(runs.select(
        "tree", F.when(F.col("n") > 1, 1).otherwise(0).alias("level"), "pos", F.ceil(F.col("n") / FAN).alias("n"), F.size("run").alias("leaves"), "children",
        F.when(F.col("n") > 1, F.sha2(children_text(), 256)).otherwise(children_text()).alias("digest"),
        F.col("run.doc_id").alias("ids"), F.transform("run", lambda x: F.unhex(F.coalesce(x.presented, x.digest))).alias("presented")))
    scratch.drop(digests)
    total = bottom.agg(F.sum("leaves")).first()[0] or 0

    levels = build_levels(bottom, scratch, 1)
    short = ["tree", "level", "pos", "n", "children", "digest"]
    ends = reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "digest") for x in (bottom, *levels)])
    named = ends.withColumn("lang", F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)")))
    langs = scratch.write(positions(named, [], ["lang"], scratch).withColumnRenamed("tree", "of"))
    over = build_levels(langs.withColumn("tree", F.lit(TOP)), scratch, 0)
    last = (over[-1] if over else langs).select("digest").first()
    root = last[0] if last else None

    roots = langs.select(F.col("of").alias("tree"), F.col("pos").alias("place"), F.col("n").alias("trees"))
    none = spark.createDataFrame([], "tree string, level int, pos long, n long, children binary, digest string")
    nodes = linked(reduce(DataFrame.unionByName, [x.select(short) for x in levels], none), roots).unionByName(linked(reduce(DataFrame.unionByName, [x.select(short) for x in over], none), None))
    copied = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies("tree", "level", total) - 1))).drop("n", "digest")

    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # one row for each run and level
    try:
        path = spark.sql(CLIMB, leaves=linked(bottom, roots), nodes=scratch.write(copied), top_copies=min(MOST_COPIES, max(1, total // GROUP)))
        upper = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "siblings"))), lambda x: F.lower(F.hex(x.siblings))), "")
        found = path.groupBy("tree", "pos").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("ids", "children", "subroot", "folded")], upper.alias("upper"))
        each = found.select("children", "subroot", "upper", F.posexplode(F.arrays_zip("ids", "folded")).alias("i", "leaf"))
        own = F.concat(F.expr("substring(children, 1, 32 * i)"), F.expr("substring(children, 32 * i + 33)"))
        out = scratch.write(each.select(F.col("leaf.ids").alias("doc_id"), F.lower(F.hex(F.expr("substring(children, 32 * i + 1, 32)"))).alias("leaf"), "subroot",
                                        F.sha2(F.concat(F.lower(F.hex(own)), "upper"), 256).alias("proof_sha256"), F.lower(F.hex("leaf.folded")).alias("folded_root")))
    finally:
        spark.conf.set(ROW_LIMIT, before)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
