"""Registered queries: features, models, and timed sweeps.

Model scores differ in their last digits from run to run and from engine to engine,
so these queries return counts that are exact and properties that must hold, next
to the few numbers that plain SQL can also find.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.fixtures import ACCOUNTS, accounts_raw, accounts_split
from tabwright.functions.layouts import TRIAL_STORE_COLUMNS
from tabwright.functions.spec import TableSpec
from tabwright.functions.vectors import declared_width, flatten_vector, set_cells, vector_size
from tabwright.operators import evaluate, features, index_table, models
from tabwright.operators.sampling import held, with_split
from tabwright.plans import sweep as sweep_plan
from tabwright.plans.prepare import Prepared, prepare
from tabwright.plans.train import compare, needed
from tabwright.sources import sinks, tables
from tabwright.sources.models import load_model, load_pipeline, save_model
from tabwright.sources.workspace import fresh_path


def _prepared(spark, sf) -> Prepared:
    return prepare(accounts_raw(spark, sf), ACCOUNTS)


@contextmanager
def _training(spark, sf):
    """(prepared, training rows held for the fits inside the block), dealt to all cores: a
    fit reads them hundreds of times, and the input may be a file or two."""
    prepared = _prepared(spark, sf)
    cores = spark.sparkContext.defaultParallelism
    with held(*needed(prepared.split("train"), partitions=cores)) as (train,):
        yield prepared, train


def _fitted(spark, sf, name: str):
    with _training(spark, sf) as (prepared, train):
        return prepared, models.estimator(name).fit(train)


def _closeness(observed, expected, tolerance: float):
    return F.abs(observed - expected) <= tolerance


# ------------------------------------------------------------------------ features


def category_index_apply(spark, sf) -> DataFrame:
    """Values outside the training vocabulary, planted by renaming one region."""
    rows = accounts_split(spark, sf)
    values = features.vocabulary(rows.filter("split = 'train'"), ACCOUNTS.categorical)
    index = PipelineModel(features.indexers(values))
    moved = rows.withColumn(
        "region", F.when(F.col("region") == "ASIA", "ATLANTIS").otherwise(F.col("region"))
    )
    return index.transform(moved).select(
        "account_id", *[F.col(f"{c}_index") for c in ACCOUNTS.categorical]
    )


def one_hot_long(spark, sf) -> DataFrame:
    """The slots of the categories that are set, by name."""
    prepared = _prepared(spark, sf)
    first = len(ACCOUNTS.numeric)
    cells = flatten_vector(prepared.features, "account_id", "features").filter(
        (F.col("slot") >= first) & (F.col("value") != 0)
    )
    names = features.slot_table(prepared.features, prepared.encoder, ACCOUNTS)
    return cells.join(names.withColumnRenamed("value", "category"), "slot").select(
        "account_id", "slot", "column_name", "category", "value"
    )


def features_long(spark, sf) -> DataFrame:
    return flatten_vector(_prepared(spark, sf).features, "account_id", "features")


ORDERS = TableSpec(
    key="o_orderkey",
    categorical=("o_custkey", "o_orderpriority"),
    integers=(),
    doubles=("o_totalprice",),
    label="o_orderstatus",
    positive="F",
    negative="O",
)


def _orders(spark, sf) -> DataFrame:
    """All orders; the customer has nearly as many values as there are customers, and
    two fifths of the orders are given to one customer that no index may stumble over."""
    orders = tables.read_parquet(spark, f"{sf}/orders.parquet")
    hot = F.when(F.col("o_orderkey") % 5 < 2, "hot").otherwise(F.col("o_custkey").cast("string"))
    chosen = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 29 > 0, hot))
    return with_split(chosen.select(*ORDERS.columns), ORDERS.key)


def _index_written_twice(spark, sf):
    """(rows, index): the index of the training rows, after storing and loading."""
    rows = _orders(spark, sf)
    path = fresh_path(spark, "index")
    index_table.fit_index_table(rows.filter("split = 'train'"), ORDERS, path)
    return rows, index_table.load_index_table(spark, path, ORDERS)


def encode_any_cardinality(spark, sf) -> DataFrame:
    """Every set slot of every order's vector, and how wide the vector is."""
    rows, index = _index_written_twice(spark, sf)
    encoded = index_table.write_features(rows, index, fresh_path(spark, "features"))
    return set_cells(encoded, ORDERS.key, "features").withColumn("width", F.lit(index.width))


def index_table_slots(spark, sf) -> DataFrame:
    return index_table.slot_rows(spark, _index_written_twice(spark, sf)[1])


def wide_label_rates(spark, sf) -> DataFrame:
    """Stored wide features by label: rows, their width, and the slots set in all."""
    rows, index = _index_written_twice(spark, sf)
    path = fresh_path(spark, "features")
    encoded = index_table.write_features(rows, index, path, ["split"], ["split"])
    return encoded.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(vector_size("features")).alias("narrowest"),
        F.max(vector_size("features")).alias("widest"),
    )


def feature_width(spark, sf) -> DataFrame:
    prepared = _prepared(spark, sf)
    declared = declared_width(prepared.features)
    return prepared.features.agg(
        F.max(vector_size("features")).alias("width"),
        F.min(vector_size("features")).alias("smallest"),
    ).withColumn("declared", F.lit(declared))


# ----------------------------------------------------------------- sinks and models


def parquet_roundtrip(spark, sf) -> DataFrame:
    """Feature vectors after writing and reading, summed up per slot."""
    prepared = _prepared(spark, sf)
    path = sinks.write_parquet(prepared.features, fresh_path(spark, "features"))
    back = flatten_vector(tables.read_parquet(spark, path), "account_id", "features")
    return back.groupBy("slot").agg(
        F.count_if(F.col("value") != 0).alias("filled"),
        F.round(F.sum("value"), 2).alias("total"),
    )


def sink_verify(spark, sf) -> DataFrame:
    prepared = _prepared(spark, sf)
    return sinks.write_parquet_verified(prepared.features, fresh_path(spark, "features"))


def model_roundtrip(spark, sf) -> DataFrame:
    """Raw rows through the stored encoder and each stored model, against the ones
    never stored."""
    test = accounts_split(spark, sf).filter(F.col("split") == "test")
    with _training(spark, sf) as (prepared, train):
        fitted = models.fit_models(train)
    again = load_pipeline(save_model(prepared.encoder, fresh_path(spark, "encoder")))
    stored = {
        f"{name}_stored": load_model(name, save_model(model, fresh_path(spark, "model")))
        for name, model in fitted.items()
    }
    encoded = features.encode(test, again, ACCOUNTS)
    both = models.score_all(encoded, {**fitted, **stored}, ["account_id"])
    per_row = both.groupBy("account_id", F.regexp_replace("Model", "_stored$", "").alias("Model")).agg(
        (F.max("probability") - F.min("probability")).alias("gap")
    )
    return per_row.groupBy("Model").agg(
        F.count(F.lit(1)).alias("rows"), (F.max("gap") == 0).alias("same_scores")
    )


def model_scores(spark, sf) -> DataFrame:
    """Vector lengths over all rows, and probabilities that add up to one."""
    prepared, model = _fitted(spark, sf, "Decision_Tree")
    scored = models.score(prepared.split("test"), model)
    pair = vector_to_array("probability")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(vector_size("rawPrediction")).alias("shortest"),
        F.max(vector_size("rawPrediction")).alias("longest"),
        F.max(F.abs(pair[0] + pair[1] - 1)).between(0, 1e-9).alias("sums_to_one"),
    )


def lr_base_rate(spark, sf) -> DataFrame:
    """An unregularised fit with intercept gives back the share of positives."""
    with _training(spark, sf) as (prepared, train):
        model = models.estimator("Logistic_Regression").fit(train)
    scored = models.score(prepared.split("train"), model)
    return scored.agg(
        F.round(F.avg(vector_to_array("probability")[1]), 3).alias("mean_probability"),
        F.round(F.avg("label"), 3).alias("base_rate"),
    )


def lr_scores(spark, sf) -> DataFrame:
    """At the optimum the predicted and the actual positives agree in every category,
    as the gradient in the slot of that category is zero."""
    prepared, model = _fitted(spark, sf, "Logistic_Regression")
    scored = models.score(
        features.encode(
            accounts_split(spark, sf).filter(F.col("split") == "train"),
            prepared.encoder,
            ACCOUNTS,
            keep=ACCOUNTS.categorical,
        ),
        model,
    )
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
        for c in ACCOUNTS.categorical
    ]
    return (
        scored.select(
            "label", vector_to_array("probability")[1].alias("p"), F.inline(F.array(*pairs))
        )
        .groupBy("column_name", "value")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("label").cast("bigint").alias("positives"),
            _closeness(F.avg("p"), F.avg("label"), 0.002).alias("calibrated"),
        )
    )


def dt_stump(spark, sf) -> DataFrame:
    """The best first split on the one-hot slots for a near-balanced target."""
    rows = accounts_split(spark, sf).filter(F.col("split") == "train")
    encoder = features.fit_encoder(rows, ACCOUNTS)
    urgent = F.col("priority").isin("1-URGENT", "2-HIGH")
    points = (
        F.when(urgent, 40).otherwise(0)
        + F.when(F.col("status") == "F", 25).otherwise(0)
        + F.when(F.col("segment") == "BUILDING", 20).otherwise(0)
        + (80 - F.col("tenure"))
    )
    from pyspark.ml.feature import VectorSlicer

    first = len(ACCOUNTS.numeric)
    named = features.slots(encoder, ACCOUNTS)
    slicer = VectorSlicer(
        inputCol="features", outputCol="slots", indices=list(range(first, len(named)))
    )
    target = F.when(points > 75, 1.0).otherwise(0.0)
    cut = slicer.transform(encoder.transform(rows.withColumn("target", target)))
    with held(cut.select("slots", "target")) as (train,):
        stump = models.estimator(
            "Decision_Tree", features="slots", label="target", maxDepth=1
        ).fit(train)
    chosen = first + int(stump.featureImportances.toArray().argmax())
    _, column, value = named[chosen]
    side = rows.agg(
        F.count_if(F.col(column) == value).alias("rows_with_value"),
        F.count_if(F.col(column) != value).alias("rows_without"),
    )
    return side.select(
        F.lit(column).alias("column_name"),
        F.lit(value).alias("value"),
        "rows_with_value",
        "rows_without",
    )


def dt_scores(spark, sf) -> DataFrame:
    """Each leaf predicts the share of positives of its training rows."""
    prepared, model = _fitted(spark, sf, "Decision_Tree")
    scored = models.score_all(
        prepared.split("train"), {"Decision_Tree": model}, ["label"]
    )
    leaves = scored.groupBy("probability").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("positives"),
        F.min("prediction").alias("prediction"),
    )
    share = F.col("positives") / F.col("rows")
    return leaves.agg(
        F.sum("rows").alias("rows"),
        F.sum("positives").cast("bigint").alias("positives"),
        (F.count(F.lit(1)) <= 2**5).alias("at_most_32_leaves"),
        F.max(F.abs(share - F.col("probability"))).between(0, 1e-9).alias("leaf_shares"),
        F.bool_and(
            (F.col("prediction") == 1) == (F.col("probability") > 0.5)
        ).alias("majority_wins"),
    )


def _ensemble_scores(spark, sf, name: str) -> DataFrame:
    prepared, model = _fitted(spark, sf, name)
    scored = models.score_all(prepared.split("test"), {name: model}, ["label"])
    quality = evaluate.metric_rows(scored, ["Model"])
    ranges = scored.groupBy("Model").agg(
        (F.min("probability") >= 0).alias("not_below_zero"),
        (F.max("probability") <= 1).alias("not_above_one"),
        F.bool_and((F.col("prediction") == 1) == (F.col("probability") > 0.5)).alias(
            "predicts_the_likelier"
        ),
    )
    return quality.join(ranges, "Model").select(
        "Model",
        "rows",
        (F.col("True_Positives") + F.col("False_Negatives")).alias("positives"),
        "not_below_zero",
        "not_above_one",
        "predicts_the_likelier",
        (F.col("ROC_AUC") > 0.9).alias("auc_above_0_9"),
    )


def rf_scores(spark, sf) -> DataFrame:
    return _ensemble_scores(spark, sf, "Random_Forest")


def gbt_scores(spark, sf) -> DataFrame:
    return _ensemble_scores(spark, sf, "Gradient_Boosted_Tree")


def model_facts(spark, sf) -> DataFrame:
    with _training(spark, sf) as (_, train):
        fitted = models.fit_models(train)
    return models.model_facts(train, fitted)


def compare_models(spark, sf) -> DataFrame:
    prepared = _prepared(spark, sf)
    _, comparison = compare(
        prepared.split("train"), prepared.split("test"), prepared.width
    )
    right = F.col("True_Positives") + F.col("True_Negatives")
    return comparison.select(
        "Model",
        "Dataset_Rows",
        "Training_Rows",
        "Testing_Rows",
        "Feature_Count",
        (F.col("True_Positives") + F.col("False_Negatives")).alias("positives"),
        _closeness(F.col("Accuracy"), right / F.col("Testing_Rows"), 1e-6).alias(
            "accuracy_agrees"
        ),
        (F.col("ROC_AUC") > 0.8).alias("auc_above_0_8"),
        (F.col("Training_Time_Seconds") > 0).alias("fit_was_timed"),
        (F.col("Prediction_Time_Seconds") > 0).alias("predict_was_timed"),
    )


# --------------------------------------------------------------------------- sweeps

_TINY = {"scales": (1, 2), "models": ("Logistic_Regression", "Decision_Tree"), "trials": 1}


def sweep(spark, sf) -> DataFrame:
    prepared = _prepared(spark, sf)
    trials, _ = sweep_plan.run_sweep(
        prepared.split("train"),
        prepared.split("test"),
        prepared.width,
        fresh_path(spark, "trials"),
        **_TINY,
    )
    return trials.select(
        "Scale_Factor",
        "Model",
        "Trial",
        "Base_Dataset_Rows",
        "Synthetic_Total_Rows",
        "Training_Rows",
        "Testing_Rows",
        "Feature_Count",
        (F.col("Training_Throughput_Rows_Per_Second") > 0).alias("fit_was_timed"),
        (F.col("Prediction_Throughput_Rows_Per_Second") > 0).alias("predict_was_timed"),
    )


def trial_resume(spark, sf) -> DataFrame:
    """A sweep over a part of the grid, then over all of it on the same store: what
    was finished is not run again, and the summary covers the whole grid."""
    prepared = _prepared(spark, sf)
    store = fresh_path(spark, "trials")
    with held(prepared.split("train"), prepared.split("test")) as (train, test):
        frames = (train, test, prepared.width, store)
        names = ("Decision_Tree",)
        sweep_plan.run_sweep(*frames, (1,), names, trials=1, warm_up=False)
        before = tables.read_stored(spark, store, TRIAL_STORE_COLUMNS).select(
            "Scale_Factor", "Trial", F.col("Training_Time_Seconds").alias("before")
        )
        first = spark.createDataFrame(before.collect(), before.schema)  # one trial
        sweep_plan.run_sweep(*frames, (1, 2), names, trials=2, warm_up=False)
    stored = tables.read_stored(spark, store, TRIAL_STORE_COLUMNS)
    kept = F.col("before").isNull() | (F.col("before") == F.col("Training_Time_Seconds"))
    return stored.join(first, ["Scale_Factor", "Trial"], "left").select(
        "Scale_Factor",
        "Trial",
        "Training_Rows",
        "Testing_Rows",
        kept.alias("kept_if_finished"),
        F.col("Accuracy").isNotNull().alias("has_quality"),
    )


# ------------------------------------------------------------------------------ SQL

_CATEGORY = ACCOUNTS.categorical
_VALUES = " union all ".join(
    f"select '{c}' as column_name, {i} as place, {c} as value, count(*) as rows"
    f" from accounts_split where split='train' group by {c}"
    for i, c in enumerate(_CATEGORY)
)
_INDEX = f"""(select column_name, place, value,
                     row_number() over (partition by column_name
                                        order by rows desc, value) - 1 as idx,
                     count(*) over (partition by column_name) as size
              from ({_VALUES}) v)"""
_SLOTS = f"""(select column_name, value,
                     cast({len(ACCOUNTS.numeric)} - 1
                          + row_number() over (order by place, idx) as integer) as slot
              from {_INDEX} i)"""
_NUMERIC_CELLS = " union all ".join(
    f"select account_id, {i} as slot, cast({c} as double) as value from accounts_split"
    for i, c in enumerate(ACCOUNTS.numeric)
)
_CATEGORY_CELLS = " union all ".join(
    f"""select account_id, s.slot, case when {c} = s.value then 1.0 else 0.0 end as value
        from accounts_split cross join {_SLOTS} s where s.column_name = '{c}'"""
    for c in _CATEGORY
)
_CELLS = f"({_NUMERIC_CELLS} union all {_CATEGORY_CELLS})"
_WIDTH = f"(select {len(ACCOUNTS.numeric)} + count(*) from {_INDEX} w)"
_TEST_COUNTS = """(select count(*) as rows, cast(sum(case when churn='Yes' then 1 else 0 end)
                    as bigint) as positives from accounts_split where split='test') t"""
_ENSEMBLE = f"""select '{{}}' as Model, rows, positives, true as not_below_zero,
                       true as not_above_one, true as predicts_the_likelier,
                       true as auc_above_0_9 from {_TEST_COUNTS}"""
_PARTS = """(select count(*) filter (where split='train') as train_n,
                    count(*) filter (where split='test') as test_n,
                    count(*) filter (where split='test' and churn='Yes') as test_positives
             from accounts_split) p"""
_STUMP_TARGET = """(select *, case when 40*(case when priority in ('1-URGENT','2-HIGH')
                                             then 1 else 0 end)
                        + 25*(case when status='F' then 1 else 0 end)
                        + 20*(case when segment='BUILDING' then 1 else 0 end)
                        + (80 - tenure) > 75 then 1 else 0 end as target
                    from accounts_split where split='train')"""
_STUMP_SIDES = " union all ".join(
    f"""select '{c}' as column_name, value, count(*) filter (where {c}=value) as n1,
               count(*) filter (where {c}<>value) as n0,
               coalesce(sum(target) filter (where {c}=value), 0) as p1,
               coalesce(sum(target) filter (where {c}<>value), 0) as p0
        from {_STUMP_TARGET} t, (select distinct {c} as value from accounts_split) v
        group by value"""
    for c in _CATEGORY
)

_ORDERS = """(select o_orderkey, o_orderpriority, o_totalprice, o_orderstatus,
                     case when o_orderkey % 29 = 0 then null
                          when o_orderkey % 5 < 2 then 'hot'
                          else cast(o_custkey as varchar) end as o_custkey,
                     case when ('0x'||substr(md5('split:' || cast(o_orderkey as varchar)),
                                             1, 8))::bigint % 100 < 80
                          then 'train' else 'test' end as split from orders)"""
_ORDER_SLOTS = f"""(select column_name, value,
                           cast(row_number() over (order by place, n desc, value)
                                as integer) as slot
                    from (select 'o_custkey' as column_name, 0 as place, o_custkey as value,
                                 count(*) as n
                          from {_ORDERS} o where split = 'train' group by o_custkey
                          union all
                          select 'o_orderpriority', 1, o_orderpriority, count(*)
                          from {_ORDERS} o where split = 'train' group by o_orderpriority) v
                    where value is not null)"""
_ORDER_WIDTH = f"(select cast(1 + count(*) as integer) from {_ORDER_SLOTS} w)"

CASES = {
    "encode_any_cardinality": (
        encode_any_cardinality,
        f"""select *, {_ORDER_WIDTH} as width
            from (select o_orderkey, 0 as slot, o_totalprice::double as value
                  from orders where o_totalprice <> 0
                  union all
                  select o_orderkey, s.slot, 1.0::double from {_ORDERS} o
                  join {_ORDER_SLOTS} s on s.column_name = 'o_custkey' and s.value = o_custkey
                  union all
                  select o_orderkey, s.slot, 1.0::double from {_ORDERS} o
                  join {_ORDER_SLOTS} s on s.column_name = 'o_orderpriority'
                                       and s.value = o_orderpriority) c""",
    ),
    "index_table_slots": (
        index_table_slots,
        f"""select 0 as slot, 'o_totalprice' as column_name, null::varchar as value
            union all select slot, column_name, value from {_ORDER_SLOTS} s""",
    ),
    "wide_label_rates": (
        wide_label_rates,
        f"""select split, label, count(*) as rows, {_ORDER_WIDTH} as narrowest,
                   {_ORDER_WIDTH} as widest
            from (select split, case o_orderstatus when 'F' then 1.0::double
                                                   when 'O' then 0.0::double end as label
                  from {_ORDERS} o) r
            group by split, label""",
    ),
    "category_index_apply": (
        category_index_apply,
        "select account_id, "
        + ", ".join(
            f"""cast(coalesce(
                  (select idx from {_INDEX} i where column_name='{c}' and value=r.{c}),
                  (select max(size) from {_INDEX} i where column_name='{c}')) as double)
                  as {c}_index"""
            for c in _CATEGORY
        )
        + """ from (select * replace (case when region='ASIA' then 'ATLANTIS'
                                           else region end as region)
                    from accounts_split) r""",
    ),
    "one_hot_long": (
        one_hot_long,
        " union all ".join(
            f"""select account_id, s.slot, s.column_name, s.value as category,
                       1.0::double as value
                from accounts_split join {_SLOTS} s
                  on s.column_name='{c}' and s.value = {c}"""
            for c in _CATEGORY
        ),
    ),
    "features_long": (
        features_long,
        f"select account_id, slot, cast(value as double) as value from {_CELLS} c",
    ),
    "feature_width": (
        feature_width,
        f"""select cast(w as integer) as width, cast(w as integer) as smallest,
                   cast(w as integer) as declared from (select {_WIDTH} as w) x""",
    ),
    "parquet_roundtrip": (
        parquet_roundtrip,
        f"""select slot, count(*) filter (where value <> 0) as filled,
                   round(sum(value)::double, 2) as total
            from {_CELLS} c group by slot""",
    ),
    "sink_verify": (
        sink_verify,
        f"""select 'rows' as rule, count(*) as expected, count(*) as observed, true as ok
            from accounts_split
            union all select 'smallest_vector', {_WIDTH}, {_WIDTH}, true
            union all select 'largest_vector', {_WIDTH}, {_WIDTH}, true
            union all select 'same_schema', 1, 1, true""",
    ),
    "model_roundtrip": (
        model_roundtrip,
        f"""select Model, rows, true as same_scores from {_TEST_COUNTS}
            cross join (values ('Logistic_Regression'), ('Decision_Tree'), ('Random_Forest'),
                               ('Gradient_Boosted_Tree')) m(Model)""",
    ),
    "model_scores": (
        model_scores,
        f"select rows, 2 as shortest, 2 as longest, true as sums_to_one from {_TEST_COUNTS}",
    ),
    "lr_base_rate": (
        lr_base_rate,
        """select round(avg(y), 3) as mean_probability, round(avg(y), 3) as base_rate
           from (select case when churn='Yes' then 1.0 else 0.0 end as y
                 from accounts_split where split='train') t""",
    ),
    "lr_scores": (
        lr_scores,
        " union all ".join(
            f"""select '{c}' as column_name, {c} as value, count(*) as rows,
                       count(*) filter (where churn='Yes') as positives, true as calibrated
                from accounts_split where split='train' group by {c}"""
            for c in _CATEGORY
        ),
    ),
    "dt_stump": (
        dt_stump,
        f"""select column_name, value, n1 as rows_with_value, n0 as rows_without
            from ({_STUMP_SIDES}) s
            order by 2*p1*(n1-p1)/n1::double + 2*p0*(n0-p0)/nullif(n0,0)::double limit 1""",
    ),
    "dt_scores": (
        dt_scores,
        """select count(*) as rows, count(*) filter (where churn='Yes') as positives,
                  true as at_most_32_leaves, true as leaf_shares, true as majority_wins
           from accounts_split where split='train'""",
    ),
    "rf_scores": (rf_scores, _ENSEMBLE.format("Random_Forest")),
    "gbt_scores": (gbt_scores, _ENSEMBLE.format("Gradient_Boosted_Tree")),
    "model_facts": (
        model_facts,
        f"""select m.Model, f.fact, cast(case f.fact when 'features' then {_WIDTH}
                     when 'classes' then 2 else m.trees end as bigint) as value
            from (values ('Logistic_Regression', null), ('Decision_Tree', null),
                         ('Random_Forest', 50), ('Gradient_Boosted_Tree', 30)) m(Model, trees)
            cross join (values ('features'), ('classes'), ('trees')) f(fact)
            where f.fact <> 'trees' or m.trees is not null""",
    ),
    "compare_models": (
        compare_models,
        f"""select m.Model, train_n + test_n as Dataset_Rows, train_n as Training_Rows,
                   test_n as Testing_Rows, cast({_WIDTH} as integer) as Feature_Count,
                   test_positives as positives, true as accuracy_agrees,
                   true as auc_above_0_8, true as fit_was_timed, true as predict_was_timed
            from {_PARTS} cross join (values {", ".join(f"('{m}')" for m in models.MODEL_NAMES)})
              m(Model)""",
    ),
    "sweep": (
        sweep,
        f"""select s.s as Scale_Factor, m.Model, 1 as Trial,
                   train_n + test_n as Base_Dataset_Rows,
                   (train_n + test_n) * s.s as Synthetic_Total_Rows,
                   train_n * s.s as Training_Rows, test_n * s.s as Testing_Rows,
                   cast({_WIDTH} as integer) as Feature_Count, true as fit_was_timed,
                   true as predict_was_timed
            from {_PARTS} cross join (values (1), (2)) s(s)
            cross join (values ('Logistic_Regression'), ('Decision_Tree')) m(Model)""",
    ),
    "trial_resume": (
        trial_resume,
        f"""select s.s as Scale_Factor, t.t as Trial, train_n * s.s as Training_Rows,
                   test_n * s.s as Testing_Rows, true as kept_if_finished,
                   t.t = 1 as has_quality
            from {_PARTS} cross join (values (1), (2)) s(s) cross join (values (1), (2)) t(t)""",
    ),
}
