"""All pairs of records whose sets overlap above a Jaccard threshold.

Prefix-filtered join. Tokens get ranks by rarity; a record is indexed only under the
prefix a partner must meet; length and position filters thin the candidates; the exact
overlap decides.

The join key holds the length class as well, so a long posting list meets only sets of
about its members' sizes.

Scale. Records with equal sets are one class and only representatives are joined, so
copies cost one row each. Posting lists longer than ``BLOCK`` are cut into blocks: the
smaller side is spread over the blocks and the other repeated to each, so a hot token
is many tasks instead of one. Sets travel as arrays of bigint ranks and are fetched
for candidates only.

Defined cases. Records without tokens have no pairs (the union must not be empty).
Null tokens and null records are ignored, repeated tokens and repeated rows collapse:
a record is the union of its rows. A record never pairs with itself.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.session import splittable, written

#: Rows of a posting list handled in one task.
BLOCK = 2000


def ranked_sets(members: DataFrame) -> DataFrame:
    """(record, token) rows to (record, tokens, n): distinct ranks, rarest token first."""
    distinct = members.where(F.col("record").isNotNull() & F.col("token").isNotNull()).select("record", "token").distinct()
    counts = distinct.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # ids that rise with (df, token): the sort is by range, so no task holds all tokens
    ranks = counts.orderBy("df", "token").select("token", F.monotonically_increasing_id().alias("rank"))
    return distinct.join(ranks, "token").groupBy("record").agg(F.sort_array(F.collect_list("rank")).alias("tokens")).withColumn("n", F.size("tokens"))


def set_classes(sets: DataFrame, side: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes (class_id, tokens, n, copies, lefts, rights) and membership (record, class_id, copies).

    ``side``: is a record of the left table? Without it, every record is of both.
    """
    # written before it is used twice: ranks may come out differently in a second run
    keyed = written(sets.withColumn("digest", F.sha2(F.to_json("tokens"), 256)), "sets")
    left, right = (side, ~side) if side is not None else (F.lit(True), F.lit(True))
    classes = keyed.groupBy("digest").agg(F.min("record").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max(left).alias("lefts"), F.max(right).alias("rights"))
    stored = written(keyed.join(splittable(classes), "digest").drop("digest"), "set-classes")
    return stored.where(F.col("record") == F.col("class_id")).drop("record"), stored.select("record", "class_id", "copies")


def length_borders(threshold: Fraction, longest: int) -> list[int]:
    """Borders such that partners' sizes lie in one length class or in neighbouring ones.

    Each border is at least the one before divided by the threshold, and a partner is
    at most that much larger.
    """
    borders = [1]
    while borders[-1] < longest:
        borders.append(max(borders[-1] + 1, -(-borders[-1] * threshold.denominator // threshold.numerator)))
    return borders


def similar_classes(classes: DataFrame, threshold: Fraction, block: int = BLOCK) -> DataFrame:
    """(a, b, overlap, similarity) for pairs of class representatives, a < b.

    Classes meet only if one has records of the left table and the other of the right.
    """
    p, q = threshold.numerator, threshold.denominator
    # integer forms of n - ceil(t n) + 1 and ceil(t/(1+t) (n_a + n_b))
    prefix = F.expr(f"n - (({p} * n + {q - 1}) div {q}) + 1")
    rows = classes.select("class_id", "lefts", "rights", F.col("n").cast("bigint").alias("n"), F.posexplode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("pos", "rank"))
    longest = classes.agg(F.max("n")).first()[0] or 1
    borders = F.array(*[F.lit(b).cast("bigint") for b in length_borders(threshold, longest)])
    rows = rows.withColumn("span", F.size(F.filter(borders, lambda b: b <= F.col("n"))))
    longs = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    blocks = longs.select("rank", F.expr(f"cast((len + {block - 1}) div {block} as int)").alias("blocks"))
    posted = written(rows.join(splittable(blocks), "rank"), "postings")
    a = posted.select("rank", "span", F.expr("pmod(xxhash64(class_id), blocks)").cast("int").alias("block"), F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("lefts").alias("la"), F.col("rights").alias("ra"))
    # the longer set of a pair is of the shorter one's length class or of the next
    b = posted.withColumn("span", F.explode(F.array(F.col("span"), F.col("span") - 1)))
    b = b.select("rank", "span", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("lefts").alias("lb"), F.col("rights").alias("rb"))
    needed = f"(({p} * (na + nb) + {p + q - 1}) div {p + q})"
    met = a.join(b, ["rank", "span", "block"]).where(
        # each pair once: the shorter set on the left, ties by id
        F.expr(f"((la and rb) or (ra and lb)) and (na < nb or (na = nb and a < b)) and {q} * na >= {p} * nb and 1 + least(na - pa - 1, nb - pb - 1) >= {needed}")
    )
    pairs = met.select("a", "b").distinct()
    left = classes.select(F.col("class_id").alias("a"), F.col("tokens").alias("ta"), F.col("n").cast("bigint").alias("na"))
    right = classes.select(F.col("class_id").alias("b"), F.col("tokens").alias("tb"), F.col("n").cast("bigint").alias("nb"))
    exact = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("overlap"))
    alike = exact.where(F.expr(f"{q} * overlap >= {p} * (na + nb - overlap)"))
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("similarity"))


def similar_sets(members: DataFrame, threshold: Fraction, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, membership). Copies stay in the membership, unexpanded."""
    classes, membership = set_classes(ranked_sets(members))
    return similar_classes(classes, threshold, block), membership


def expanded(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Every pair of records (a < b), between and within classes."""
    of_a = membership.select(F.col("record").alias("ra"), F.col("class_id").alias("a"))
    of_b = membership.select(F.col("record").alias("rb"), F.col("class_id").alias("b"))
    between = pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("ra", "rb")
    copies = membership.where("copies > 1")
    left, right = copies.select(F.col("record").alias("ra"), "class_id"), copies.select(F.col("record").alias("rb"), "class_id")
    within = left.join(right, "class_id").where("ra < rb").select("ra", "rb")
    both = between.unionByName(within)
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def similar_between(left: DataFrame, right: DataFrame, threshold: Fraction, block: int = BLOCK) -> DataFrame:
    """Pairs between two tables of (record, token): (left_record, right_record), as they were.

    Both tables share one ranking and one classing. Candidates of one table only are
    dropped in the join that makes them. Pairs are expanded to records, as every one is
    asked for.
    """
    kinds = {n: df.schema["record"].dataType for n, df in (("left", left), ("right", right))}

    def tagged(df: DataFrame, name: str) -> DataFrame:
        held = [(F.col("record") if n == name else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]
        return df.where(F.col("record").isNotNull()).select(F.struct(F.lit(name == "left").alias("is_left"), *held).alias("record"), "token")

    classes, membership = set_classes(ranked_sets(tagged(left, "left").unionByName(tagged(right, "right"))), F.col("record.is_left"))
    pairs = similar_classes(classes, threshold, block).select("a", "b")
    own = classes.where("lefts and rights").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own)
    lefts = membership.where("record.is_left").select(F.col("record.left").alias("left_record"), F.col("class_id").alias("a"))
    rights = membership.where("not record.is_left").select(F.col("record.right").alias("right_record"), F.col("class_id").alias("b"))
    return links.join(lefts, "a").join(rights, "b").select("left_record", "right_record")
