"""Fingerprints of documents: homomorphic multiset hashes of their paragraphs, by DataFrame functions alone.

A fingerprint is a sum of vectors, so it does not depend on the order of the paragraphs, and a paragraph is put in or taken
out by adding or subtracting its vector. Two parts lie side by side. ``wide`` has lanes of 32 bits, filled by hashes of the whole
paragraph and summed modulo 2**32: it decides equality. ``votes`` counts, modulo 2**32, the shingles of three words of the
paragraphs: a shingle's hash names one of ``GROUPS`` groups of 16 lanes, and the lanes of the bits it has set there get one
each. With the number of shingles in each group these are sums of signs, whose squared distance
estimates how many shingles two texts do not share. A shingle starts at each word of a paragraph, shorter shingles at its end included.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WIDE = 8  # longs with two lanes of 32 bits each
LANES = 0x0000000100000001
LOW = 0xFFFFFFFF
GROUPS = 8
#: White space, and the places behind characters of scripts that are written without spaces.
BREAK = r"[\x20\x09-\x0D]+|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def _sum(array: str, one) -> Column:
    """Lane-wise sum modulo 2**32 of one(x) over an array, for two lanes in a long."""
    low = F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + one(x).bitwiseAND(LOW), lambda s: s.bitwiseAND(LOW))
    high = F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(one(x), 32), lambda s: s.bitwiseAND(LOW))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _word(lane: int, h: Column) -> Column:
    return F.xxhash64(h, F.lit(lane))


def _vote(bit: int):
    return lambda s, h: s + F.shiftrightunsigned(h, bit).bitwiseAND(LANES)


def _shingles(words: Column) -> Column:
    """Hash of the up to three words from each word of a paragraph on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _group(g: int):
    return lambda h: F.shiftrightunsigned(h, 61) == g


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: struct of wide (array<long>), votes (array<long>) and n (array<long>, shingles by group). Null text has none of the three's mass."""
    empty = F.array().cast("array<long>")
    paragraphs = F.when(F.col(text).isNull(), empty).otherwise(F.transform(F.split(text, "\n"), lambda p: F.xxhash64(F.sha2(p, 256))))
    words = F.transform(F.split(text, "\n"), lambda p: F.array_remove(F.split(p, BREAK), ""))
    shingles = F.when(F.col(text).isNull(), empty).otherwise(F.flatten(F.transform(words, _shingles)))
    hashed = df.withColumns({"_paragraphs": paragraphs, "_shingles": shingles}).withColumns({f"_group{g}": F.filter("_shingles", _group(g)) for g in range(GROUPS)}).drop("_shingles")
    wide = F.array(*[_sum("_paragraphs", partial(_word, j)) for j in range(WIDE)])
    votes = F.array(*[F.aggregate(f"_group{g}", F.lit(0).cast("long"), _vote(j)) for g in range(GROUPS) for j in range(8)])
    sizes = F.array(*[F.size(f"_group{g}").cast("long") for g in range(GROUPS)])
    return hashed.withColumn(name, F.struct(wide.alias("wide"), votes.alias("votes"), sizes.alias("n"))).drop("_paragraphs", *[f"_group{g}" for g in range(GROUPS)])


def _lanes(a: Column, b: Column, sign: int) -> Column:
    """a + sign * b in each 32-bit lane."""
    def one(x: Column, y: Column) -> Column:
        low = (x.bitwiseAND(LOW) + sign * y.bitwiseAND(LOW)).bitwiseAND(LOW)
        high = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(LOW)
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.zip_with(a, b, one)


def combined(a: str, b: str, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both, or with sign -1 of those of ``a`` without those of ``b``."""
    return F.struct(_lanes(F.col(f"{a}.wide"), F.col(f"{b}.wide"), sign).alias("wide"), _lanes(F.col(f"{a}.votes"), F.col(f"{b}.votes"), sign).alias("votes"), F.zip_with(f"{a}.n", f"{b}.n", lambda x, y: x + sign * y).alias("n"))


def spelled(fingerprint: str) -> Column:
    """All lanes and the numbers of shingles in hexadecimal digits."""
    digits = lambda lanes: F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.lower(F.concat(digits(F.col(f"{fingerprint}.wide")), digits(F.col(f"{fingerprint}.votes")), digits(F.col(f"{fingerprint}.n"))))


def likeness(a: str, b: str) -> Column:
    """0 to 1: the share of shingles, counted on both sides, that two fingerprints have in common, as estimated by the
    signed sums (standard error about 0.125 of the share not in common); 1 for equal fingerprints.

    The squared distance, over 16 lanes a group, estimates the squared differences of the shingles' counts. It is set against the squares of
    both sides' sums, so a shingle that a text repeats weighs alike in both.
    """
    def parts(x: Column, i: Column) -> Column:
        na, nb = F.get(F.col(f"{a}.n"), F.floor(i / 8).cast("int")), F.get(F.col(f"{b}.n"), F.floor(i / 8).cast("int"))
        pairs = [(2 * lane(x["x"]) - na, 2 * lane(x["y"]) - nb) for lane in (lambda v: v.bitwiseAND(LOW), lambda v: F.shiftrightunsigned(v, 32))]
        pairs = [(p.cast("double"), q.cast("double")) for p, q in pairs]
        return F.struct(sum((p - q) * (p - q) for p, q in pairs).alias("apart"), sum(p * p + q * q for p, q in pairs).alias("mass"))

    lanes = F.transform(F.zip_with(f"{a}.votes", f"{b}.votes", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), parts)
    zero = F.struct(F.lit(0.0).alias("apart"), F.lit(0.0).alias("mass"))
    total = F.aggregate(lanes, zero, lambda s, x: F.struct((s["apart"] + x["apart"]).alias("apart"), (s["mass"] + x["mass"]).alias("mass")),
                        lambda s: F.greatest(F.lit(0.0), 1 - s["apart"] / F.greatest(s["mass"], F.lit(1.0))))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def with_next(docs: DataFrame, id_column: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows in descending order of id; the last is followed by the first.

    Rows are dealt by ranges of ids between quantiles that occur among them, four for each shuffle partition. The largest id
    of a range also goes to the range above as its last follower, so no window spans the table. Rows with
    the same id follow each other by the hash of their columns; a null id comes last.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_column), F.lit(-(2**63)))
    shares = [(i + 1) / ranges for i in range(ranges)]
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, 10000).alias("q"), F.max("k").alias("m")).first()
    ends = sorted({*(cuts["q"] or []), *([cuts["m"]] if cuts["m"] is not None else [])})
    listed = F.lit(ends) if ends else F.array().cast("array<long>")
    n = max(1, len(ends))
    own = docs.withColumn("_key", key).withColumn("_range", F.size(F.filter(listed, lambda e: e < F.col("_key"))))
    homes = F.when(F.array_contains(listed, F.col("_key")), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy")), F.struct(F.pmod(F.col("_range") + 1, F.lit(n)).alias("r"), F.lit(True).alias("copy"))))
    homes = homes.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy"))))
    dealt = own.withColumn("_home", F.explode(homes)).withColumns({"_range": F.col("_home.r"), "_copy": F.col("_home.copy"), "_tie": F.xxhash64(*columns)}).drop("_home")
    order = W.partitionBy("_range").orderBy("_copy", F.desc("_key"), "_tie")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("not _copy").drop("_key", "_range", "_copy", "_tie")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of code points replaced by as many first ones of the next document. Null counts as
    empty text, which has one empty paragraph. A single document follows itself. Other columns are not read; an empty table
    gives none.
    """
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    follow = with_next(with_fingerprint(base, "text", "own"), "id", ["text", "own"])
    n = F.length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), cut))
    out = with_fingerprint(follow.withColumns({"edited": edited, "n_chars": n}).drop("text", "next_text"), "edited", "changed")
    return out.select(F.col("id").alias(id_column), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled("own").alias("fingerprint"), spelled("changed").alias("edited_fingerprint"),
                      likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
