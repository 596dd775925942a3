"""Models on training samples with Spark ML: next place and trip duration, as random forests."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACE_TEXT = ("user_id", "from_cluster_id", "from_place_type", "previous_cluster_id", "day_of_week", "time_of_day")
PLACE_NUMBERS = ("is_weekend", "departure_hour", "current_stay_duration_sec", "from_cluster_visit_count", "from_cluster_avg_duration_sec", "from_cluster_night_visit_ratio", "from_cluster_day_visit_ratio")
TRIP_TEXT, TRIP_NUMBERS = ("user_id", "from_cluster_id", "to_cluster_id", "travel_mode", "day_of_week"), ("departure_hour", "distance_meters")
LEAST_ROWS, SPLIT, SEED = 10, (0.8, 0.2), 42
#: Classes that a text column's values are hashed to, and bins of a feature.
CATEGORIES = BINS = 256
#: Share of the days that a model is fitted on where it is judged by the days after them.
FIRST_DAYS = 0.8


def _prepared(samples: DataFrame, text: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    filled = samples.withColumns({c: F.coalesce(F.col(c), F.lit("START")) for c in text})
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers})


def _stages(text: tuple[str, ...], numbers: tuple[str, ...]) -> list:
    """Text columns as numbers of CATEGORIES classes by their hash, so neither a tree's bins nor the driver grow with the users or places."""
    hashed = ", ".join(f"double(pmod(xxhash64({c}), {CATEGORIES})) as {c}_i" for c in text)
    return [SQLTransformer(statement=f"select *, {hashed} from __THIS__"), VectorAssembler(inputCols=[f"{c}_i" for c in text] + list(numbers), outputCol="features")]


def fit_next_place(samples: DataFrame, trees: int = 100, depth: int = 12) -> tuple[PipelineModel, float]:
    """(model, accuracy on the held-out fifth); at least LEAST_ROWS samples."""
    rows = _prepared(samples, PLACE_TEXT, PLACE_NUMBERS)
    if rows.count() < LEAST_ROWS:
        raise ValueError("too few samples")
    label = StringIndexer(inputCol="to_cluster_id", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=BINS, seed=SEED)
    train, test = rows.randomSplit(list(SPLIT), SEED)
    model = Pipeline(stages=[*_stages(PLACE_TEXT, PLACE_NUMBERS), label, forest]).fit(train)
    return model, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))


def fit_trip_duration(samples: DataFrame, trees: int = 100, depth: int = 12) -> tuple[PipelineModel, float, float]:
    """(model, mean absolute error, R2) on the held-out fifth."""
    rows = _prepared(samples, TRIP_TEXT, TRIP_NUMBERS)
    if rows.count() < LEAST_ROWS:
        raise ValueError("too few samples")
    forest = RandomForestRegressor(labelCol="duration_sec", numTrees=trees, maxDepth=depth, maxBins=BINS, seed=SEED)
    train, test = rows.randomSplit(list(SPLIT), SEED)
    model = Pipeline(stages=[*_stages(TRIP_TEXT, TRIP_NUMBERS), forest]).fit(train)
    scored = model.transform(test)
    score = lambda name: RegressionEvaluator(labelCol="duration_sec", metricName=name).evaluate(scored)
    return model, score("mae"), score("r2")


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted model, in place of one that is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The model at path, or none where there is none."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        if "exist" in str(error).lower():
            return None
        raise


def predict_next(model: PipelineModel, samples: DataFrame, key: list[str], top: int = 3, least: float = 0.01) -> DataFrame:
    """(key.., rank, next_cluster_id, confidence): the likeliest places of every sample, those below `least` left out."""
    names = next(s for s in model.stages if isinstance(s, StringIndexerModel) and s.isSet("outputCol") and s.getOutputCol() == "label").labels
    scored = model.transform(_prepared(samples, PLACE_TEXT, PLACE_NUMBERS).withColumn("to_cluster_id", F.coalesce("to_cluster_id", F.lit(""))))
    each = scored.select(*key, F.posexplode(vector_to_array("probability")).alias("k", "confidence")).where((F.col("k") < len(names)) & (F.col("confidence") >= least))
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "k")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(*key, "rank", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("next_cluster_id"), F.round("confidence", 4).alias("confidence"))


def trip_duration_model(samples: DataFrame) -> PipelineModel | None:
    """The fitted model, or none for fewer than LEAST_ROWS samples."""
    return fit_trip_duration(samples)[0] if samples.count() >= LEAST_ROWS else None


def predict_duration(model: PipelineModel | None, trips: DataFrame) -> DataFrame:
    """trips with predicted_sec, null without a model."""
    if model is None:
        return trips.withColumn("predicted_sec", F.lit(None).cast("double"))
    scored = model.transform(_prepared(trips, TRIP_TEXT, TRIP_NUMBERS))
    return scored.select(*trips.columns, F.col("prediction").alias("predicted_sec"))


def with_place_and_duration(predicted: DataFrame, model: PipelineModel | None, clusters: DataFrame, metres: float = 5000.0, mode: str = "DRIVE") -> DataFrame:
    """Predictions (.., from_cluster_id, day_of_week, departure_hour) whose place the user has, with its type, position and the trip's minutes by the second model.

    Ranks are those of all places, so one may be absent.
    """
    place = clusters.select("user_id", F.col("cluster_id").alias("next_cluster_id"), F.coalesce("place_type", F.lit("UNKNOWN")).alias("next_place_type"), "lat", "lng")
    trips = predicted.join(place, ["user_id", "next_cluster_id"]).withColumns({"to_cluster_id": F.col("next_cluster_id"), "distance_meters": F.lit(metres), "travel_mode": F.lit(mode)})
    timed = predict_duration(model, trips).withColumn("expected_trip_duration_min", F.round(F.col("predicted_sec") / 60, 1))
    return timed.drop("to_cluster_id", "distance_meters", "travel_mode", "predicted_sec")


def split_by_days(samples: DataFrame, share: float = FIRST_DAYS, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(samples of the first `share` of all days, those of the days after): what comes later is never learned from."""
    days = samples.where(F.col(date).isNotNull()).select(date).distinct()
    # a row for each day
    numbered = days.withColumns({"_k": F.row_number().over(Window.orderBy(date)), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    marked = samples.join(numbered.select(date, (F.col("_k") <= F.floor(F.col("_n") * share)).alias("_first")), date)
    return marked.where("_first").drop("_first"), marked.where("not _first").drop("_first")


def split_by_time(samples: DataFrame, share: float = FIRST_DAYS, order: tuple[str, ...] = ("trip_start", "date", "from_cluster_id", "to_cluster_id")) -> tuple[DataFrame, DataFrame]:
    """(the first `share` of each user's samples, those after them), for what is learned for each user alone."""
    w = Window.partitionBy("user_id")
    marked = samples.withColumn("_first", F.row_number().over(w.orderBy(*order)) <= F.floor(F.count("*").over(w) * share))
    return marked.where("_first").drop("_first"), marked.where("not _first").drop("_first")


def place_metrics(predicted: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(user_id, trips, accuracy, top3_accuracy) of predictions (key.., rank, next_cluster_id) for actual (key.., to_cluster_id); a null user adds up all.

    Trips without a prediction count as missed. The key holds user_id.
    """
    hit = predicted.join(actual.select(*key, F.col("to_cluster_id").alias("next_cluster_id")), [*key, "next_cluster_id"]).groupBy(*key).agg(F.min("rank").alias("rank"))
    judged = actual.select(*key).join(hit, key, "left")
    mean = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return judged.rollup("user_id").agg(F.count("*").alias("trips"), mean(F.col("rank") == 1).alias("accuracy"), mean(F.col("rank") <= 3).alias("top3_accuracy"))


def duration_metrics(predicted: DataFrame) -> DataFrame:
    """(user_id, trips, mae, rmse, median_error) in seconds of (user_id, duration_sec, predicted_sec); a null user adds up all; rows without a prediction are left out."""
    off = F.abs(F.col("predicted_sec") - F.col("duration_sec"))
    rows = predicted.where("predicted_sec is not null").select("user_id", off.alias("off"))
    return rows.rollup("user_id").agg(F.count("*").alias("trips"), F.round(F.avg("off"), 4).alias("mae"), F.round(F.sqrt(F.avg(F.col("off") * F.col("off"))), 4).alias("rmse"), F.round(F.median("off"), 4).alias("median_error"))


def common_places(trips: DataFrame, requests: DataFrame, key: list[str], top: int = 3) -> DataFrame:
    """(key.., rank, next_cluster_id): for requests the user's commonest places after from_cluster_id in `trips`, ties to the least id; what a model should beat."""
    n = trips.groupBy("user_id", "from_cluster_id", "to_cluster_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id", "from_cluster_id").orderBy(F.desc("n"), "to_cluster_id")
    best = n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return requests.join(best.select("user_id", "from_cluster_id", "rank", F.col("to_cluster_id").alias("next_cluster_id")), ["user_id", "from_cluster_id"]).select(*key, "rank", "next_cluster_id")


def mean_durations(trips: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with predicted_sec, the mean duration of the user's `trips` between the same places, or else of all the user's trips; null for users without any."""
    route = trips.groupBy("user_id", "from_cluster_id", "to_cluster_id").agg(F.avg("duration_sec").alias("_route"))
    user = trips.groupBy("user_id").agg(F.avg("duration_sec").alias("_user"))
    known = requests.join(route, ["user_id", "from_cluster_id", "to_cluster_id"], "left").join(user, "user_id", "left")
    return known.withColumn("predicted_sec", F.coalesce("_route", "_user")).drop("_route", "_user")


def requests_of(clusters: DataFrame, day: str, hour: int) -> DataFrame:
    """Samples for asking the next-place model from every cluster of every user, as after an ordinary stay there."""
    from tracewell.functions import timefn as T

    return clusters.select(
        "user_id", F.col("cluster_id").alias("from_cluster_id"), F.coalesce("place_type", F.lit("UNKNOWN")).alias("from_place_type"), F.lit(None).cast("string").alias("previous_cluster_id"), F.lit(day).alias("day_of_week"),
        F.lit(day in ("Saturday", "Sunday")).alias("is_weekend"), T.time_of_day(F.lit(hour), "ping").alias("time_of_day"), F.lit(hour).alias("departure_hour"), F.col("avg_duration_sec").alias("current_stay_duration_sec"),
        F.col("visit_count").alias("from_cluster_visit_count"), F.col("avg_duration_sec").alias("from_cluster_avg_duration_sec"), F.col("night_visit_ratio").alias("from_cluster_night_visit_ratio"), F.col("day_visit_ratio").alias("from_cluster_day_visit_ratio"), F.lit(None).cast("string").alias("to_cluster_id"),
    )
