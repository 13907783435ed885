"""Registered queries: every operator over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.hashing import hashed_slot
from clickloom.functions.scalar import Loss
from clickloom.operators import ftrl, metrics, running, splits, trees
from clickloom.operators.counts import CountEncoder, count_stats, explode_features
from clickloom.operators.encode import category_text
from clickloom.operators.segments import fit_by_segment, progress_by_segment
from clickloom.operators.vectorize import (
    POSITIONAL_OFFSET,
    OneHotIndex,
    cells,
    positional_columns,
    vectorize_named,
    vectorize_positional,
)
from clickloom.options import BoostingParams, ColumnRoles, FtrlParams, LearnerOptions
from clickloom.plans import checks
from clickloom.plans.ctr import two_stage
from clickloom.session import delete_directory, new_path, path_exists, spread, write_table
from clickloom.sources.records import numbered, read_lines_in_place
from clickloom.sources.sinks import submission, write_csv, write_lines, write_submission
from clickloom.sources.staging import stage_in_order
from clickloom.sources.tables import (
    EVENT_FEATURES,
    EVENT_ROLES,
    LINEITEM_FEATURES,
    ORDER_ROLES,
    click_events,
    customer_orders,
    returned_items,
    scored_events,
    table,
)
from clickloom.sources.text import (
    join_fields,
    parse_lines,
    read_csv,
    read_lines,
    split_fields,
)
from clickloom.streaming.online import OnlineModel, fit_stream, score_stream

OPTIONS = LearnerOptions()
PARAMS = FtrlParams()
# slots under the hashing trick are bounded by the option, so the weights may be broadcast
HASHED = ftrl.Ftrl(PARAMS, slots=OPTIONS.max_features)
STREAM_FILES = 8

# A fixed ensemble over event columns, with a numeric and a category split
EVENT_TREES = trees.Ensemble(
    trees=(
        trees.Split(
            "value",
            trees.Split("hour", trees.Leaf(0.2), trees.Leaf(-0.1), threshold=11.0),
            trees.Leaf(-0.3),
            threshold=50.0,
        ),
        trees.Split(
            "hour",
            trees.Leaf(0.4),
            trees.Split("user_id", trees.Leaf(-0.2), trees.Leaf(0.1), threshold=75.0),
            categories=(0.0, 1.0, 2.0, 22.0, 23.0),
        ),
        trees.Split("user_id", trees.Leaf(-0.5), trees.Leaf(0.6), threshold=20.0),
    ),
    weights=(1.0, 0.5, 0.1),
)

# positions of the fields in the event lines: label, three categories, one number
LINE_ROLES = ColumnRoles("0", "event_id", ("4",), ("1", "2", "3"))


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, reals rounded to six places: the form the results are compared in."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- text ---------------------------------------------------------------------------------------


def csv_lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        join_fields(F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("value")).alias("value")
    )
    columns = [("event_id", "bigint"), ("event_type", "string"), ("user_id", "bigint"), ("amount", "double")]
    return parse_lines(splits.without_text(lines, "signup"), columns)


def csv_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"')).alias("title"), "p_size"
    )
    write_csv(parts, path)
    return read_csv(spark, path, parts.schema)


def csv_breaks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with line breaks, read back in byte ranges."""
    path = new_path(spark, "csv")
    titled = F.concat_ws("\n", F.col("o_orderpriority"), F.lit('"as, it, is"'), F.col("o_orderdate").cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", titled.alias("note"), "o_totalprice")
    write_csv(orders, path)
    return read_csv(spark, path, orders.schema, multi_line=True)


def text_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    lines = click_events(spark, sf_dir).select(
        join_fields(F.col("click"), F.col("hour"), F.col("user_id"), F.col("k"), F.col("event_id")).alias("value")
    )
    write_lines(lines, path)
    columns = [("click", "int"), ("hour", "int"), ("user_id", "bigint"), ("k", "string"), ("event_id", "bigint")]
    return parse_lines(read_lines(spark, path), columns)


# ---- counts -------------------------------------------------------------------------------------


def q_explode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_features(click_events(spark, sf_dir), ["hour", "user_id", "k"], "click", ["event_id"])


def q_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_stats(click_events(spark, sf_dir), EVENT_FEATURES, "click")


def count_stats_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_stats(returned_items(spark, sf_dir), LINEITEM_FEATURES, "returned")


def count_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from the training part, applied to all rows."""
    log = click_events(spark, sf_dir)
    train, _ = splits.hash_split(log, "event_id")
    encoder = CountEncoder.fit(train, EVENT_FEATURES, "click")
    return encoder.transform(log.select("click", *EVENT_FEATURES)).select(
        "event_id", "click", *encoder.slots
    )


# ---- splits -------------------------------------------------------------------------------------


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = click_events(spark, sf_dir).select("event_id")
    return log.select("event_id", splits.in_training(F.col("event_id")).cast("int").alias("is_train"))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splits.random_split(click_events(spark, sf_dir).select("event_id", "click"))
    return train.withColumn("is_train", F.lit(1)).unionByName(test.withColumn("is_train", F.lit(0)))


def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = click_events(spark, sf_dir).select("event_id", "click")
    return splits.sample_negatives(log, "click", "event_id", keep_percent=25)


# ---- vectorizers --------------------------------------------------------------------------------


def hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = click_events(spark, sf_dir)
    return log.select(
        "event_id",
        *[
            hashed_slot(c, category_text(c), OPTIONS.max_features).alias(f"{c}_slot")
            for c in ("hour", "user_id", "k")
        ],
    )


def hash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(vectorize_named(customer_orders(spark, sf_dir), ORDER_ROLES))


def hash_vector_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = LearnerOptions(max_features=20)
    return cells(vectorize_named(customer_orders(spark, sf_dir), ORDER_ROLES, few))


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comma lines ``click,hour,user_id,k,value`` split by position."""
    lines = click_events(spark, sf_dir).select(
        "event_id",
        join_fields(
            F.col("click"), F.col("hour"), F.col("user_id"), F.col("k"), F.col("value") - 1
        ).alias("value"),
    )
    return split_fields(lines)


def hash_vector_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(
        vectorize_positional(
            event_fields(spark, sf_dir), "fields", LINE_ROLES, OPTIONS, offset=POSITIONAL_OFFSET
        )
    )


def onehot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OneHotIndex.fit(click_events(spark, sf_dir), EVENT_ROLES).entries.table


def onehot_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the first training batch, grown by the whole log: old numbers stay."""
    log = click_events(spark, sf_dir)
    return OneHotIndex.fit(log.where("batch = 0"), EVENT_ROLES).refit(log).entries.table.select("feature", "value", "idx")


def onehot_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by position without hashing: zero categories and numbers that are not positive have no cell."""
    line = join_fields(F.col("click"), F.col("hour"), F.col("user_id"), F.col("k"), F.col("value") - 1)
    lines = split_fields(click_events(spark, sf_dir).select("event_id", line.alias("value")))
    columns = positional_columns(lines, "fields", LINE_ROLES)
    return cells(OneHotIndex.fit(columns, LINE_ROLES, positional=True).transform(columns))


def onehot_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = write_table(customer_orders(spark, sf_dir), "customer-orders")
    return cells(OneHotIndex.fit(orders, ORDER_ROLES).transform(orders))


# ---- ranks and sorts ----------------------------------------------------------------------------


def rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir).select("event_id", "click", "probability")
    return running.rank_rows(scored, ["probability", "event_id"])


def rank_rows_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir).select("event_id", "click", "probability")
    return running.rank_rows(scored, [F.desc("click"), F.desc("probability"), F.asc("event_id")])


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = scored_events(spark, sf_dir).select(F.round("probability", 1).alias("score"))
    return running.average_ranks(coarse, "score")


def _typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_type", "event_id", "value", F.col("user_id").alias("payload")
    )


def argsort_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    sorted_ = running.sort_within_groups(
        _typed_events(spark, sf_dir), "event_type", ["value", "event_id"], original="event_id"
    )
    return sorted_.select("event_type", "sorted_position", F.col("event_id").alias("original_id"))


def cosort_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    sorted_ = running.sort_within_groups(
        _typed_events(spark, sf_dir), "event_type", ["value", "event_id"], original="event_id"
    )
    return sorted_.select("event_type", "sorted_position", "value", "payload")


def argsort_head_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 of each group sorted, the others left in place: the n argument of the sort."""
    placed = running.running(
        _typed_events(spark, sf_dir), ["event_id"], by=["event_type"], number="_n"
    ).withColumn("original", F.col("_n") - 1)
    sorted_ = running.sort_within_groups(
        placed, "event_type", ["value", "event_id"], original="original", head=100
    )
    return sorted_.select("event_type", "event_id", "original", "sorted_position", "value")


# ---- metrics ------------------------------------------------------------------------------------


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(scored_events(spark, sf_dir), "click", "probability")


def auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = scored_events(spark, sf_dir).withColumn("probability", F.round("probability", 1))
    return metrics.auc(coarse, "click", "probability")


def logloss_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_log_loss(scored_events(spark, sf_dir), "click", "probability")


def logloss_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores pushed to exactly 0 and 1, where only the clip keeps the loss finite."""
    hard = scored_events(spark, sf_dir).withColumn("probability", F.round("probability", 0))
    return hard.groupBy("probability", "click").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(metrics.log_loss(F.col("probability"), F.col("click"))).alias("loss"),
    )


def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_rate(scored_events(spark, sf_dir), "click", "prediction")


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.mismatches(scored_events(spark, sf_dir), "click", "prediction").select(
        "event_id", "click", "prediction"
    )


def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.base_rate(scored_events(spark, sf_dir), "click")


def accuracy_at_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir)
    return metrics.accuracy_at(scored, "click", "probability", metrics.base_rate(scored, "click"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(scored_events(spark, sf_dir), "click", "probability", prediction="prediction")


def eval_report_at_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir)
    cut = metrics.base_rate(scored, "click")
    return metrics.report(scored, "click", "probability", threshold=cut)


def predict_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir).select("event_id", "click", "probability")
    cut = metrics.base_rate(scored, "click")
    return metrics.predicted_class(scored, "probability", cut).select("event_id", "class")


def running_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scored_events(spark, sf_dir).select("event_id", "ts", "click")
    return metrics.running_progress(log, "click", ["ts", "event_id"], report_every=1).select(
        "event_id", "seq", "running_base_rate"
    )


def progressive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running loss, reported at every 100th row."""
    log = scored_events(spark, sf_dir).select("event_id", "ts", "click", "probability")
    return metrics.running_progress(
        log, "click", ["ts", "event_id"], score="probability", report_every=100
    ).select("event_id", "seq", "running_base_rate", "cumulative_loss")


# ---- FTRL ---------------------------------------------------------------------------------------


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize_named(click_events(spark, sf_dir), EVENT_ROLES, OPTIONS, ["batch"])


def stored_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, numbered in a written table, for steps that read them more than once."""
    return ftrl.keyed(event_rows(spark, sf_dir))


def _state_after(spark: SparkSession, sf_dir: str, epochs: int) -> DataFrame:
    return ftrl.fit(event_rows(spark, sf_dir), "batch", HASHED, epochs=epochs)


def _first_step(rows: DataFrame) -> DataFrame:
    return HASHED.step(ftrl.empty_state(rows.sparkSession), rows)


def ftrl_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step over all events from an empty model."""
    return ftrl.model_of(_first_step(stored_event_rows(spark, sf_dir)))


def ftrl_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.weights_of(_first_step(stored_event_rows(spark, sf_dir)), PARAMS)


def ftrl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_event_rows(spark, sf_dir)
    return HASHED.score(rows, write_table(_first_step(rows), "state"))


def q_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as a submission file and read back."""
    path = new_path(spark, "submission")
    write_submission(ftrl_score(spark, sf_dir), path)
    return read_csv(spark, path, "id string, click double")


def ftrl_fit_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of a quarter of the negatives, each weighing four."""
    log = splits.sample_negatives(click_events(spark, sf_dir), "click", "event_id", 25)
    rows = vectorize_named(log, EVENT_ROLES, OPTIONS, ["batch", "weight"])
    return ftrl.model_of(ftrl.fit(rows, "batch", HASHED, epochs=OPTIONS.epochs))


def eval_report_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the sampled events as what they stand for."""
    log = splits.sample_negatives(scored_events(spark, sf_dir), "click", "event_id", 25)
    return metrics.report(log, "click", "probability", prediction="prediction", weight="weight")


def progressive_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's probability before its update, in the exact order of its user."""
    rows = vectorize_named(click_events(spark, sf_dir), EVENT_ROLES, OPTIONS, ["user_id", "event_id"])
    return progress_by_segment(rows, "user_id", "event_id", PARAMS, report_every=1)


def ftrl_squared_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step with another model plugged in: identity link, squared loss."""
    squared = Loss(
        link=lambda margin: margin, gradient=lambda p, y, x: (p - y) * x, cost=lambda p, y: (p - y) * (p - y)
    )
    learner = ftrl.Ftrl(PARAMS, squared, OPTIONS.max_features)
    return ftrl.model_of(learner.step(ftrl.empty_state(spark), stored_event_rows(spark, sf_dir)))


def ftrl_custom_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit loop with another learner plugged in: per slot the sums of values and of values times labels."""

    def step(state: DataFrame, rows: DataFrame) -> DataFrame:
        cell = rows.select("y", F.inline("features")).selectExpr(
            "idx", "x * y AS z", "x AS n", "1L AS seen", "0D AS label_sum", "0D AS loss_sum"
        )
        sums = [F.sum(c).alias(c) for c in ("z", "n", "seen", "label_sum", "loss_sum")]
        return state.unionByName(cell).groupBy("idx").agg(*sums)

    return ftrl.model_of(ftrl.fit(event_rows(spark, sf_dir), "batch", epochs=1, step=step))


def overwrite_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a folder that is written twice, and whether it is there after it was deleted twice."""
    path, log = new_path(spark, "overwritten"), click_events(spark, sf_dir).select("event_id", "click")
    write_csv(log, path)
    write_csv(log.where("click = 1"), path)
    rows = read_csv(spark, path, "event_id bigint, click int").count()
    deleted = [delete_directory(spark, path) for _ in range(2)]
    return spark.range(1).select(
        F.lit(rows).alias("rows"),
        *[F.lit(int(d)).alias(f"deleted_{k}") for k, d in enumerate(deleted)],
        F.lit(int(path_exists(spark, path))).alias("there"),
    )


def submission_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a submission file in order of the rows: one header, then the scores."""
    path = f"{new_path(spark, 'submission')}/scores.csv"
    write_submission(ftrl_score(spark, sf_dir), path, number="row_id", single_file=True)
    lines = numbered(write_table(read_lines_in_place(spark, path), "lines"), "position")
    fields = F.split("value", ",")
    return lines.select("position", F.get(fields, F.lit(0)).alias("id"), F.get(fields, F.lit(1)).try_cast("double").alias("click"))


def ftrl_fit_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.model_of(_state_after(spark, sf_dir, OPTIONS.epochs))


def ftrl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, label sum, progressive loss and base rate after both epochs."""
    return ftrl.progress_of(_state_after(spark, sf_dir, OPTIONS.epochs))


def ftrl_fit_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectorize_named(click_events(spark, sf_dir), EVENT_ROLES, OPTIONS, ["user_id", "event_id"])
    return fit_by_segment(rows, "user_id", "event_id", PARAMS)


# ---- trees --------------------------------------------------------------------------------------


def tree_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = [EVENT_TREES.leaf(i).alias(f"leaf{i}") for i in range(len(EVENT_TREES.trees))]
    return click_events(spark, sf_dir).select("event_id", *leaf)


def tree_ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENT_TREES.score(click_events(spark, sf_dir)).select(
        "event_id", "raw_score", "probability", "prediction"
    )


def leaf_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = trees.leaf_slots(EVENT_TREES.leaf_positions(), EVENT_TREES.leaf_counts)
    return click_events(spark, sf_dir).select("event_id", F.posexplode(slots).alias("tree", "slot"))


def leaf_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = trees.leaf_line(F.col("click"), EVENT_TREES.leaf_positions(), EVENT_TREES.leaf_counts)
    return click_events(spark, sf_dir).select("event_id", line.alias("line"))


def ftrl_fit_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTRL on leaf lines read back by position, the second stage of the original job."""
    width = sum(EVENT_TREES.leaf_counts)
    roles = ColumnRoles("0", "event_id", (), tuple(str(i + 1) for i in range(width)))
    line = trees.leaf_line(F.col("click"), EVENT_TREES.leaf_positions(), EVENT_TREES.leaf_counts)
    lines = split_fields(click_events(spark, sf_dir).select("event_id", "batch", line.alias("value")))
    rows = vectorize_positional(lines, "fields", roles, OPTIONS, ["batch"])
    return ftrl.model_of(ftrl.fit(rows, "batch", HASHED, epochs=OPTIONS.epochs))


def _encoded_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CountEncoder]:
    log = click_events(spark, sf_dir)
    log = spread(log, log.count())
    train, _ = splits.hash_split(log, "event_id")
    encoder = CountEncoder.fit(train, EVENT_FEATURES, "click")
    return write_table(encoder.transform(log), "encoded"), encoder


def _boosted_events(spark: SparkSession, sf_dir: str) -> tuple[trees.BoostedTrees, DataFrame]:
    encoded, encoder = _encoded_events(spark, sf_dir)
    train, _ = splits.hash_split(encoded, "event_id")
    fitted = trees.BoostedTrees.fit(train, encoder.slots, "click", BoostingParams())
    return fitted, fitted.transform(encoded)


def gbdt_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored = _boosted_events(spark, sf_dir)
    return scored.select("event_id", "click", "raw_score", "probability", "prediction")


def gbdt_leaf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, scored = _boosted_events(spark, sf_dir)
    slots = trees.leaf_slots(F.col("leaf_positions"), fitted.leaf_counts)
    return scored.select(
        "event_id",
        F.posexplode(slots).alias("tree", "slot"),
        F.lit(sum(fitted.leaf_counts)).alias("slots"),
    )


def gbdt_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted_events(spark, sf_dir)[0].nodes().drop("categories")


def gbdt_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, encoder = _encoded_events(spark, sf_dir)
    return checks.gbdt_consistency(spark, sf_dir, encoded, encoder.slots)


def ctr_two_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_stage(
        click_events(spark, sf_dir),
        EVENT_FEATURES,
        "click",
        "event_id",
        "batch",
    ).report()


# ---- streaming ----------------------------------------------------------------------------------


def _batch_values(log: DataFrame) -> list:
    """The training batches of the log in order, the missing one first; one per micro-batch to come."""
    return [r[0] for r in log.select("batch").distinct().orderBy(F.asc_nulls_first("batch")).toLocalIterator()]


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events staged as files in batch order and read as a stream, one training batch per micro-batch."""
    log = click_events(spark, sf_dir).select("event_id", "click", "hour", "user_id", "k", "batch")
    stream = stage_in_order(log, "batch", _batch_values(log), new_path(spark, "stream-source"), STREAM_FILES)
    return vectorize_named(stream, EVENT_ROLES, OPTIONS)


def _stream_model(spark: SparkSession, sf_dir: str) -> OnlineModel:
    model = OnlineModel(spark, new_path(spark, "online-model"))
    fit_stream(_event_stream(spark, sf_dir), model, new_path(spark, "stream-checkpoint"), HASHED)
    return model


def ftrl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.model_of(_stream_model(spark, sf_dir).latest())


def ftrl_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_model(spark, sf_dir).progress()


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = write_table(_first_step(stored_event_rows(spark, sf_dir)), "state")
    out = new_path(spark, "stream-scores")
    score_stream(
        _event_stream(spark, sf_dir), state, out, new_path(spark, "stream-checkpoint"), HASHED
    )
    return spark.read.parquet(out).select("row_id", "probability")


PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removeprefix("q_"): f
    for f in (
        csv_lines_parse,
        csv_files_read,
        csv_breaks_read,
        text_files_read,
        q_explode_features,
        q_count_stats,
        count_stats_items,
        count_encode,
        hash_split,
        random_split,
        negative_sampling,
        hash_index,
        hash_vector,
        hash_vector_collisions,
        hash_vector_positional,
        onehot_index,
        onehot_refit,
        onehot_positional,
        onehot_vector,
        rank_rows,
        rank_rows_by_keys,
        average_ranks,
        argsort_by_group,
        cosort_by_group,
        argsort_head_by_group,
        auc_rank,
        auc_ties,
        logloss_mean,
        logloss_clipped,
        error_rate,
        mismatches,
        base_rate,
        accuracy_at_base_rate,
        eval_report,
        eval_report_at_base_rate,
        eval_report_weighted,
        predict_class,
        running_base_rate,
        progressive_loss,
        ftrl_step,
        ftrl_weights,
        ftrl_score,
        q_submission,
        submission_lines,
        ftrl_fit_sampled,
        ftrl_squared_loss,
        ftrl_custom_step,
        progressive_by_segment,
        overwrite_and_delete,
        ftrl_fit_epochs,
        ftrl_progress,
        ftrl_fit_by_segment,
        tree_route,
        tree_ensemble_score,
        leaf_onehot,
        leaf_file_rows,
        ftrl_fit_leaf,
        gbdt_fit_score,
        gbdt_leaf_features,
        gbdt_nodes,
        gbdt_consistency,
        ctr_two_stage_report,
        checks.two_stage_counts,
        checks.random_split_counts,
        checks.click_log_encode,
        checks.click_log_two_stage,
        checks.learner_csv_scores,
        checks.learner_csv_report,
        checks.learner_csv_in_order,
        checks.learner_file_report,
        checks.learner_file_onehot,
        ftrl_stream,
        ftrl_stream_metrics,
        stream_score,
    )
}


def _tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(query(spark, sf_dir))


QUERIES = {name: _tidied(query) for name, query in PLAIN.items()}
