"""Local outlier factor (Breunig, Kriegel, Ng and Sander 2000), exact at any size.

Equal rows have equal factors, so everything runs on distinct vectors with a weight: copies
are counted before any shuffle and never meet in a task.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.detectors.base import RAW, Detector, moments
from barloom.functions.columns import name
from barloom.operators.evaluate import number_in_order
from barloom.operators.layout import max_rows
from barloom.operators.neighbours import NeighbourIndex, k_nearest
from barloom.session import cut_lineage

EPSILON = 1e-10
AUTO_CUT = 1.5


class LocalOutlierFactor(Detector):
    """``predict`` returns the training factors for rows seen in training, and scores others
    against the training rows. With ``novelty`` all rows are scored as new.

    Equal distances are decided by the order of the vectors. Features are used as they
    are unless ``scale`` is set.

    With ``partition_by``, rows are compared with rows of the same value in that column only, as if every group
    were fitted apart; null is a group of its own. All groups are searched in one job: a group's code leads its vectors,
    so the tree splits groups first and long groups further. Scaling, range and cut are those of the whole table. A row
    that is alone in its group has the factor 1; a row of a group not seen in training has no score and no flag.
    """

    kind = "lof"
    model: DataFrame | None = None
    defaults = {"n_neighbors": 20, "contamination": None, "novelty": False, "scale": False, "partition_by": None}

    def learn(self, df: DataFrame) -> None:
        self.__dict__.pop("index", None)  # of an earlier fit
        if self.params["partition_by"]:
            self.check_columns(df, [self.params["partition_by"]])
            self.state["seed"] = self.separating_seed(df)
        if self.params["scale"]:
            means, spreads = moments(df, self.feature_columns)
            self.state["scaling"] = [means, spreads]
        rows = df.withColumn("x", self.scaled(df))
        vectors = rows.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
        vectors = cut_lineage(number_in_order(vectors, [F.col("x")], "id"))
        total = vectors.agg(F.sum("w")).first()[0]
        k = min(int(self.params["n_neighbors"]), total - 1)
        self.state["k"] = k
        if k < 1:
            self.model = vectors.withColumns({"kdist": F.lit(0.0), "lrd": F.lit(1.0), "factor": F.lit(1.0)})
        else:
            self.model = self.densities(vectors, k)
        known = rows.select("x").withColumn("_row_x", F.col("x"))
        self.note_training_scores(cut_lineage(attach(known, self.factors())), self.params["contamination"], AUTO_CUT)

    def separating_seed(self, df: DataFrame) -> int:
        """The first seed that gives every group a code of its own."""
        groups = cut_lineage(df.select(name(self.params["partition_by"]).alias("g")).distinct())
        for seed in range(16):
            codes = groups.select(group_code(F.col("g"), seed).alias("code"))
            if codes.count() == codes.distinct().count():
                return seed
        raise ValueError("too many groups to tell apart by a code of 52 bits")

    def search(self, asked: DataFrame, known: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """The k nearest, of the same group where there are groups."""
        if not self.params["partition_by"]:
            return self.index.search(asked, k) if known is self.model else k_nearest(asked, known, k, skip_self)
        gap = float(self.gap(asked, known))
        far = lambda df: df.withColumn("x", F.transform("x", lambda v, i: F.when(i == 0, v * gap).otherwise(v)))
        return k_nearest(far(asked), far(known), k, skip_self, within=gap)

    @functools.cached_property
    def index(self) -> NeighbourIndex:
        """The training rows, made ready once for all later searches, as by the batches of a stream."""
        return NeighbourIndex(self.model)

    def gap(self, asked: DataFrame, known: DataFrame) -> float:
        """A power of two, so that codes times it stay exact, beyond the distance of any two vectors of a group."""
        sides = [F.col("x")[i + 1] for i in range(len(self.feature_columns))]
        both = asked.select("x").unionByName(known.select("x"))
        spans = both.agg(*[F.max(v) - F.min(v) for v in sides]).first()
        widest = math.sqrt(sum(float(s) ** 2 for s in spans if s is not None))
        return 2.0 ** max(0, math.ceil(math.log2(widest)) + 1) if widest > 0 else 1.0

    def densities(self, vectors: DataFrame, k: int) -> DataFrame:
        near = self.search(vectors, vectors, k, skip_self=True).join(vectors.select("id", "w"), "id")
        copies = F.struct(F.lit(0.0).alias("d2"), F.col("id").alias("id"), (F.col("w") - 1).alias("w"))
        near = near.select("id", F.concat(F.array(copies), "near").alias("near"))
        pairs = cut_lineage(taken(near, k))
        reach_of = pairs.groupBy("id").agg(F.max("d").alias("kdist"))
        # only a row that is alone in its group has no neighbours
        with_kdist = cut_lineage(vectors.join(reach_of, "id", "left").na.fill(0.0, ["kdist"]))
        density = local_density(pairs, with_kdist.select("id", "kdist"))
        with_lrd = cut_lineage(with_kdist.join(density, "id", "left").na.fill(1.0, ["lrd"]))
        return cut_lineage(with_lrd.join(relative_density(pairs, with_lrd), "id", "left").na.fill(1.0, ["factor"]))

    def factors(self) -> DataFrame:
        return self.model.select("x", "w", "factor")

    def scaled(self, df: DataFrame):
        """The features as compared, led by the group's code where there are groups."""
        vector = self.vector(df)
        if "scaling" in self.state:
            means, spreads = self.state["scaling"]
            shift = F.array(*[F.lit(m) for m in means])
            width = F.array(*[F.lit(s) for s in spreads])
            vector = F.zip_with(F.zip_with(vector, shift, lambda a, b: a - b), width, lambda a, b: a / b)
        if not self.params["partition_by"]:
            return vector
        return F.concat(F.array(group_code(name(self.params["partition_by"]), self.state["seed"])), vector)

    def raw_scores(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_row_x", self.scaled(df))
        asked = rows.groupBy(F.col("_row_x").alias("x")).agg(F.count(F.lit(1)).alias("w"))
        if self.params["novelty"]:
            return attach(rows, self.novel_factors(asked)).drop("_row_x")
        known = asked.join(self.model.select("x", "factor"), "x", "left")
        new = known.filter(F.col("factor").isNull()).select("x", "w")
        table = known.filter(F.col("factor").isNotNull())
        if not new.isEmpty():
            table = table.unionByName(self.novel_factors(new))
        return attach(rows, table).drop("_row_x")

    def novel_factors(self, asked: DataFrame) -> DataFrame:
        asked = cut_lineage(number_in_order(asked, [F.col("x")], "id"))
        k = max(1, self.state["k"])
        if self.params["partition_by"]:
            # one more than k shows whether the group has more rows than k
            near = cut_lineage(self.search(asked, self.model, k + 1))
            rows = F.aggregate("near", F.lit(0).cast("bigint"), lambda n, one: n + one["w"])
            near = near.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(k), rows - 1)))
            pairs = cut_lineage(taken(near, F.col("k")))
        else:
            pairs = cut_lineage(taken(self.search(asked, self.model, k), k))
        density = local_density(pairs, self.model.select("id", "kdist"))
        own = cut_lineage(asked.join(density, "id"))
        factor = relative_density(pairs, self.model.select("id", "lrd"), own)
        return own.join(factor, "id").select("x", "w", "factor")

    def finish(self, scored: DataFrame, low: float, high: float) -> DataFrame:
        if not self.params["partition_by"]:
            return super().finish(scored, low, high)
        unknown = F.col("_unknown")
        done = super().finish(scored.withColumn("_unknown", F.col(RAW).isNull()), low, high)
        return done.withColumns({c: F.when(~unknown, F.col(c)) for c in ("anomaly_score", "is_anomaly")}).drop("_unknown")

    def predict_stream(self, df: DataFrame) -> DataFrame:
        raise ValueError("neighbours need a join per batch: score streams with score_available or score_batch")

    def tables(self) -> dict[str, DataFrame]:
        return {"vectors": self.model}

    def restore(self, tables: dict[str, DataFrame]) -> None:
        self.model = tables["vectors"]


def group_code(group: Column, seed: int) -> Column:
    """52 bits of a hash, a whole number that a double holds; null has a code of its own."""
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double")


def taken(near: DataFrame, k: int | Column) -> DataFrame:
    """Pairs (id, other, d, n): how many copies of each neighbour belong to the k nearest."""
    order = Window.partitionBy("id").orderBy("d2", "other").rowsBetween(Window.unboundedPreceding, -1)
    limit = k if isinstance(k, Column) else F.lit(k)
    pairs = near.select("id", limit.alias("k"), F.inline("near").alias("d2", "other", "w")).filter(F.col("w") > 0)
    before = F.coalesce(F.sum("w").over(order), F.lit(0))
    counted = pairs.withColumn("n", F.least(F.col("w"), F.col("k") - before)).filter(F.col("n") > 0)
    return counted.select("id", "other", F.sqrt("d2").alias("d"), "n")


def local_density(pairs: DataFrame, kdist: DataFrame) -> DataFrame:
    reach = F.greatest("kdist", "d")
    return (
        pairs.join(kdist.withColumnRenamed("id", "other"), "other")
        .groupBy("id")
        .agg((1 / (F.sum(F.col("n") * reach) / F.sum("n") + EPSILON)).alias("lrd"))
    )


def relative_density(pairs: DataFrame, lrd: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Mean density of the neighbours over the own one."""
    around = (
        pairs.join(lrd.select(F.col("id").alias("other"), "lrd"), "other")
        .groupBy("id")
        .agg((F.sum(F.col("n") * F.col("lrd")) / F.sum("n")).alias("around"))
    )
    mine = (own if own is not None else lrd).select("id", "lrd")
    return around.join(mine, "id").select("id", (F.col("around") / F.col("lrd")).alias("factor"))


def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Give every row the factor of its vector.

    Vectors with more copies than a task takes are few (row count / limit) and are
    broadcast; all others are joined by shuffle.
    """
    limit = max_rows(rows.sparkSession)
    table = cut_lineage(table.select(F.col("x").alias("_row_x"), "w", F.col("factor").alias(RAW)))
    if table.filter(F.col("w") > limit).isEmpty():
        return rows.join(table.drop("w"), "_row_x", "left")
    hot = table.filter(F.col("w") > limit).select("_row_x", F.col(RAW).alias("_hot"))
    marked = rows.join(F.broadcast(hot), "_row_x", "left")
    rare = table.filter(F.col("w") <= limit).drop("w")
    direct = marked.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", RAW)
    joined = marked.filter(F.col("_hot").isNull()).drop("_hot").join(rare, "_row_x", "left")
    return direct.unionByName(joined)
