"""The vote log as a stream: each row once, windows, running ratings, expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screeline.operators.graph import min_label_components
from screeline.operators.ratings import elo_replay
from screeline.staging import Staging


def vote_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 4) -> DataFrame:
    """The append-only log as a stream of its parquet files; ``path`` is a folder or one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def windowed_counts(stream: DataFrame, at: str, by: list[str], length: str, late: str) -> DataFrame:
    """Events in tumbling windows by key."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = timed.groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("window.start").alias("start"), *by, "events")


def drain(stream: DataFrame, name: str, mode: str, staging: Staging, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over what its source holds now and returns all that came out.

    Append output goes to a parquet sink with its own checkpoint, so a restarted run goes
    on where it was; other modes keep the last state.  ``each`` takes micro-batches instead.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{staging.root}/{name}-checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    out = f"{staging.root}/{name}-out"
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    last: list[int] = []
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def answered_in_time(assignments: DataFrame, answers: DataFrame, late: str, ttl_seconds: int) -> DataFrame:
    """Answers of the assignment's owner before it expired, as an interval join of two streams.

    ``assignments`` is (assignment_id, owner, created), ``answers`` (id, assignment_id, voter, received).
    """
    a = assignments.withWatermark("created", late)
    b = answers.withColumnRenamed("assignment_id", "_assignment").withWatermark("received", late)
    within = (F.col("received") >= F.col("created")) & (F.col("received") < F.col("created") + F.expr(f"interval {ttl_seconds} seconds"))
    return a.join(b, (F.col("assignment_id") == F.col("_assignment")) & (F.col("owner") == F.col("voter")) & within).drop("_assignment")


class OnceLog:
    """The log's rows once each, kept as a table that micro-batches add to.

    A row is new if no earlier batch holds one of its ``event`` and time.  The table is cut by
    batch and day, so a batch reads the ids of its own days only, however long the log grows and
    however late a row comes; the stream itself keeps no state and drops nothing.  A batch that
    is run again replaces what it wrote.  ``then`` takes each batch's new rows and its number.
    Rows without a time are one day; null events are one event.
    """

    def __init__(self, spark: SparkSession, staging: Staging, schema: T.StructType, event: str, at: str, then: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.root, self.schema, self.event, self.at, self.then = spark, f"{staging.root}/once", schema, event, at, then
        self.full = T.StructType([*schema.fields, T.StructField("_day", T.StringType()), T.StructField("_batch", T.LongType())])
        self.batches: set[int] = set()

    def rows(self) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], self.full)
        return self.spark.read.schema(self.full).option("basePath", self.root).parquet(*[f"{self.root}/_batch={n}" for n in sorted(self.batches)])

    def log(self) -> DataFrame:
        return self.rows().drop("_day", "_batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        day = F.coalesce(F.date_format(F.col(self.at).cast("timestamp"), "yyyy-MM-dd"), F.lit("none"))
        new = batch.withColumn("_day", day).dropDuplicates([self.event, "_day"])
        self.batches.discard(number)
        if self.batches:
            days = [r[0] for r in new.select("_day").distinct().collect()]  # days, not rows
            seen = self.rows().filter(F.col("_day").isin(days)).select(F.col(self.event).alias("_e"), F.col("_day").alias("_d"))
            new = new.join(seen, F.col(self.event).eqNullSafe(F.col("_e")) & (F.col("_day") == F.col("_d")), "left_anti")
        path = f"{self.root}/_batch={number}"
        new.write.mode("overwrite").partitionBy("_day").parquet(path)
        if self.spark.read.option("recursiveFileLookup", True).schema(self.schema).parquet(path).limit(1).count():
            self.batches.add(number)
            if self.then:
                self.then(self.rows().filter(F.col("_batch") == number).drop("_day", "_batch"), number)


def _fold(initial: float, k: float):
    """Folds one component's votes of a batch onto its items' ratings."""

    def run(key, votes, stored):  # noqa: ANN001, ANN202 - pandas frames
        import pandas as pd

        state = {i: [r, n, s] for i, r, n, s in stored[["item", "rating", "votes", "seq"]].itertuples(index=False)}
        for seq, a, b, o in votes.sort_values(["seq", "route_a", "route_b"])[["seq", "route_a", "route_b", "outcome"]].itertuples(index=False):
            one, two = (state.setdefault(i, [initial, 0, seq]) for i in (a, b))
            change = k * ((1.0 if o == "A" else 0.0 if o == "B" else 0.5) - 1 / (1 + 10 ** ((two[0] - one[0]) / 400)))
            one[:], two[:] = [one[0] + change, one[1] + 1, seq], [two[0] - change, two[1] + 1, seq]
        return pd.DataFrame([(i, key[0], *s) for i, s in state.items()], columns=["item", "component", "rating", "votes", "seq"])

    return run


class RunningElo:
    """Ratings kept up to date by micro-batches of qualified votes, each delivered once.

    Votes change the ratings of their own component of the comparison graph only.  A batch whose
    votes all come after what their component has folded is folded onto its items' ratings,
    component by component; a component to which a vote comes late is replayed from the log.
    So the ratings equal those of ``elo_replay`` over the whole log, in whatever order its files
    come.  A batch writes the items it changed, and one that is run again replaces them.
    """

    _STATE = "item string, component string, rating double, votes long, seq long"

    def __init__(self, spark: SparkSession, staging: Staging, initial: float = 1500.0, k: float = 24.0):
        self.spark, self.staging, self.root, self.initial, self.k = spark, staging, f"{staging.root}/elo", initial, k
        self.batches: set[int] = set()

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], f"{schema}, _batch long")
        return self.spark.read.schema(f"{schema}, _batch long").option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/_batch={n}" for n in sorted(self.batches)])

    def state(self) -> DataFrame:
        """Of each item what the last batch wrote that changed it."""
        newest = self._read("state", self._STATE).groupBy("item").agg(F.max(F.struct("_batch", "component", "rating", "votes", "seq")).alias("s"))
        return newest.select("item", "s.component", "s.rating", "s.votes", "s.seq")

    def ratings(self) -> DataFrame:
        return self.state().select("item", "rating", "votes")

    def __call__(self, batch: DataFrame, number: int) -> None:
        staging, vote = self.staging, "seq long, route_a string, route_b string, outcome string"
        self.batches.discard(number)
        path = f"{self.root}/votes/_batch={number}"
        batch.select("seq", "route_a", "route_b", "outcome").write.mode("overwrite").parquet(path)
        votes, state = self.spark.read.schema(vote).parquet(path), staging.put("elo-before", self.state())
        label = lambda c: state.select(F.col("item").alias(c), F.col("component").alias(f"c_{c[-1]}"))
        links = votes.join(label("route_a"), "route_a", "left").join(label("route_b"), "route_b", "left")
        links = links.withColumn("c_a", F.coalesce("c_a", "route_a")).withColumn("c_b", F.coalesce("c_b", "route_b"))
        links = staging.put("elo-links", links)
        joined = min_label_components(links.select(F.col("c_a").alias("u"), F.col("c_b").alias("v")), staging, name="elo")
        nodes = links.select(F.explode(F.array("c_a", "c_b")).alias("node")).distinct()
        merged = staging.put("elo-merged", nodes.join(joined, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        members = staging.put("elo-members", state.join(merged, state["component"] == merged["node"]).drop("node"))
        mine = links.join(merged, links["c_a"] == merged["node"]).select("label", "seq", "route_a", "route_b", "outcome")
        last = members.groupBy("label").agg(F.max("seq").alias("last"))
        late = staging.put("elo-late", mine.groupBy("label").agg(F.min("seq").alias("first")).join(last, "label").filter("first < last").select("label"))
        # on time: folded onto the ratings of the batch's own items
        touched = votes.select(F.explode(F.array("route_a", "route_b")).alias("item")).distinct()
        start = members.join(touched, "item", "left_semi").join(late, "label", "left_anti").select("label", "item", "rating", "votes", "seq")
        fresh = mine.join(late, "label", "left_anti").groupBy("label").cogroup(start.groupBy("label")).applyInPandas(_fold(self.initial, self.k), self._STATE)
        # late: the component's votes of all batches, replayed in order
        self.batches.add(number)
        of = members.join(late, "label", "left_semi").select("item", "label").unionByName(
            mine.join(late, "label", "left_semi").select(F.explode(F.array("route_a", "route_b")).alias("item"), "label")
        ).distinct()
        again = self._read("votes", vote).drop("_batch").join(of.withColumnRenamed("item", "route_a"), "route_a")
        seen = again.select("seq", "label", F.explode(F.array("route_a", "route_b")).alias("item")).groupBy("item", "label").agg(F.max("seq").alias("seq"))
        replayed = elo_replay(again, None, self.initial, self.k).join(seen, "item").select("item", F.col("label").alias("component"), "rating", "votes", "seq")
        changed = staging.put("elo-changed", fresh.unionByName(replayed))
        # items that only changed their component
        moved = members.filter("component <> label").join(changed, "item", "left_anti").select("item", F.col("label").alias("component"), "rating", "votes", "seq")
        changed.unionByName(moved).write.mode("overwrite").parquet(f"{self.root}/state/_batch={number}")
