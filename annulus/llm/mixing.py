"""Operator 3: mix sources to target weights by pivotal dependent rounding.

DataFrame functions only.  Each source has a target of words by water-filling;
each of its documents starts with the same fractional number of copies.  In a
group of up to FAN units the largest document is paired with the pool of the
rest of its group: a random transfer of words between the two, unbiased and
limited by what either can give or take, makes the document's copies integral
(or empties or fills the pool).  A group ends with at most one fractional
document; these residuals meet in groups of the next level, up to one group per
source, so only ids and numbers move and a source that holds a third of all rows
is spread over many groups.  The last residual of a source is drawn with its
probability.  Words are conserved at every transfer, so a source misses its
target by less than its last document, usually one of the smallest.

Random numbers are hashes of (seed, level, id, size): reruns agree.

Defined cases: null and empty texts have size 0 and take 0; a null source is a
source of its own and sorts last; repeated rows are separate documents; null ids
are kept; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._blocks import shared_dir, written

FAN = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, path: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, n, sid, weight, target) by source."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = F.col("source").asc_nulls_last()
    src = written(src.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), path, "sources")
    # rank over range partitions: their number bounds the one unpartitioned window
    part = F.shiftright("at", 33)
    ahead = src.groupBy(part.alias("part")).agg(F.count("*").alias("k")).select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("ahead"))
    ranked = src.join(F.broadcast(ahead), part == F.col("part")).withColumn("sid", F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "n", "sid", w.cast("long").alias("weight")), path, "weights")
    # each source stops at the rate `full`; the rate that spends the total is enclosed ever closer, 64 parts a job
    full = F.col("source_size") * most / F.col("weight")
    total, low, high = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.lit(0.0), F.coalesce(F.max(full), F.lit(0.0))).first()
    while True:
        steps = [low + (high - low) * k / 64 for k in range(65)]
        spent = [F.coalesce(F.sum(F.least(F.col("weight") * F.lit(x), (F.col("source_size") * most).cast("double"))), F.lit(0.0)) for x in steps]
        got = ranked.agg(*spent).first()
        k = max((k for k in range(65) if got[k] <= total), default=0)
        below, above = steps[k], steps[min(k + 1, 64)]
        inside = (full > F.lit(below)) & (full < F.lit(above))
        n, held, share = ranked.agg(F.count_if(inside), F.coalesce(F.sum(F.when(full <= F.lit(below), F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(full > F.lit(below), F.col("weight"))), F.lit(0))).first()
        if not n or not share or below >= above or (below, above) == (low, high):
            rate = (total - held) / share if share else below
            break
        low, high = below, above
    target = F.least(F.col("weight") * F.lit(rate), (F.col("source_size") * most).cast("double"))
    return ranked.withColumn("target", target)


def draw(seed: int, level: int) -> F.Column:
    """A number in [0, 1) of a unit at a level."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _settle(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: groups (sid, at) of units (.., size, p); p is integral in all but one of a group's units."""
    u = draw(seed, level)
    unit = F.struct("size", u.alias("u"), "doc_id", "p", "whole", "source_size", "target", "source")
    grouped = units.groupBy("sid", "at").agg(F.sort_array(F.collect_list(unit), asc=False).alias("all"))
    zero = F.lit(0.0)
    mass = F.aggregate("all", zero, lambda s, x: s + x["p"] * x["size"])
    room = F.aggregate("all", zero, lambda s, x: s + x["size"])
    done = F.expr("cast(array() as array<double>)")

    def pair(s, x):
        def with_let(value, body):  # a name for a value inside an expression
            return F.element_at(F.transform(F.array(value), body), 1)

        def step(t):
            # t: p of the document, mass and room of the pool, scale and shift of the pool's p
            up = F.least((1 - t["p"]) * x["size"], t["mass"])
            down = F.least(t["p"] * x["size"], t["room"] - t["mass"])

            def move(d):
                rise = x["u"] * (d["up"] + d["down"]) < d["down"]
                moved = F.when((d["up"] + d["down"]) <= 1e-9, zero).when(rise, d["up"]).otherwise(-d["down"])

                def apply(m):
                    p = t["p"] + m / x["size"]
                    p = F.when(p < 1e-9, zero).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)
                    k = F.when(m > 0, (t["mass"] - m) / t["mass"]).when(m < 0, (t["room"] - t["mass"] + m) / (t["room"] - t["mass"])).otherwise(1.0)
                    shift = F.when(m < 0, 1 - k).otherwise(zero)
                    return F.struct(
                        F.greatest(t["mass"] - m, zero).alias("mass"), t["room"].alias("room"),
                        (s["a"] * k).alias("a"), (s["b"] * k + shift).alias("b"),
                        F.concat(s["p"], F.array(p)).alias("p"),
                    )

                return with_let(moved, apply)

            return with_let(F.struct(F.greatest(up, zero).alias("up"), F.greatest(down, zero).alias("down")), move)

        p = F.least(F.greatest(s["a"] * x["p"] + s["b"], zero), F.lit(1.0))
        return with_let(F.struct(p.alias("p"), F.greatest(s["mass"] - p * x["size"], zero).alias("mass"), F.greatest(s["room"] - x["size"], zero).alias("room")), step)

    start = F.struct(mass.alias("mass"), room.alias("room"), F.lit(1.0).alias("a"), zero.alias("b"), done.alias("p"))
    settled = grouped.withColumn("ps", F.aggregate("all", start, pair, lambda s: s["p"]))
    rows = settled.select("sid", "at", F.explode(F.arrays_zip("all", "ps")).alias("r"))
    return rows.select("sid", "at", *[F.col(f"r.all.{c}").alias(c) for c in ("doc_id", "size", "whole", "source_size", "target", "source")], F.col("r.ps").alias("p"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    path = shared_dir(docs.sparkSession)
    sizes = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), path, "sizes")
    src = source_targets(sizes, path, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN))
    start = (
        sizes.join(src.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")))
        .withColumn("whole", F.floor(rate))
        .withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
        .withColumn("at", F.pmod(F.xxhash64("doc_id", "size"), groups))
    )
    columns = ["sid", "at", "doc_id", "size", "whole", "source_size", "target", "source", "p"]
    level, largest = 0, src.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    units, out = start.select(*columns), []
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    left = -(-largest // FAN)
    out.append(units.where(~open_))
    units = units.where(open_)
    while True:
        now = written(_settle(units, level, seed), path, f"level{level}")
        if left <= 1:
            out.append(now.withColumn("p", F.when(open_, (draw(seed, level + 1) < F.col("p")).cast("double")).otherwise(F.col("p"))))
            break
        out.append(now.where(~open_))
        units = now.where(open_).withColumn("at", F.floor(F.col("at") / FAN))
        level, left = level + 1, -(-left // FAN)
    every = functools.reduce(lambda a, b: a.unionByName(b), [d.select(*columns) for d in out])
    copies = (F.col("whole") + F.col("p")).cast("long")
    return every.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, all columns, with their number of copies (a column of that name is replaced). Rows equal in id, source and size get their decisions in the order of their texts."""
    columns = [c for c in docs.columns if c != "copies"]
    # all columns travel in one struct, so no name of theirs can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("_i"), F.col("source").cast("string").alias("_s"), word_count(F.col("text")).alias("_n"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_i", "_s", "_n").orderBy("_row.text")))
    chosen = mix_sources(docs, **options).groupBy(F.col("doc_id").alias("_i2"), F.col("source").alias("_s2"), F.col("size").alias("_n2")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    both = ranked.join(chosen, F.col("_i").eqNullSafe(F.col("_i2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_n") == F.col("_n2")))
    return both.withColumn("_c", F.element_at("_copies", F.col("_k"))).where("_c > 0").select("_row.*", F.col("_c").alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
