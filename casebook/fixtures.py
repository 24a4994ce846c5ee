"""Stand-in tables for the registered queries, each from whole given tables.

Every fixture exists twice: as DataFrame code, and as a named SQL query for the
comparison. The SQL is put together by ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.layouts import TRIAL_STORE_COLUMNS, conform
from tabwright.functions.spec import TableSpec
from tabwright.operators.clean import clean
from tabwright.operators.evaluate import metric_rows
from tabwright.operators.sampling import with_split
from tabwright.operators.trials import metrics_in_first_trial, with_throughput

ACCOUNTS = TableSpec(
    key="account_id",
    categorical=("segment", "priority", "status", "region"),
    integers=("tenure",),
    doubles=("total_charges", "balance"),
    label="churn",
    positive="Yes",
    negative="No",
)
RULES = {"rule_85": 85, "rule_95": 95, "rule_105": 105, "rule_120": 120}
RULE_NAMES = tuple(RULES)
SCALES = (1, 5, 10, 20, 50, 100)
EVENT_MODELS = ("click", "view", "purchase", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text row per order with its customer, nation and region. Spark picks the
    join strategy by size; a customer with very many orders is split by AQE."""
    orders, customer, nation, region = (
        table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")
    )
    joined = (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    digest = F.md5(F.col("o_orderkey").cast("string"))
    hashed = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    months = (2001 - F.year("o_orderdate")) * 12 + (8 - F.month("o_orderdate"))
    base = joined.withColumns({"hb": hashed, "mon": months})
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    rating = (
        F.when(urgent, 40).otherwise(0)
        + F.when(F.col("o_orderstatus") == "F", 25).otherwise(0)
        + F.when(F.col("c_mktsegment") == "BUILDING", 20).otherwise(0)
        + (80 - F.col("mon"))
        + F.col("hb") % 60
    )
    charges = F.when(F.col("hb") % 640 == 0, " ").otherwise(
        F.col("o_totalprice").cast("string")
    )
    return base.select(
        F.col("o_orderkey").cast("string").alias("account_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("r_name").alias("region"),
        F.col("mon").cast("string").alias("tenure"),
        charges.alias("total_charges"),
        F.col("c_acctbal").cast("string").alias("balance"),
        F.when(rating > 125, "Yes").otherwise("No").alias("churn"),
    )


def accounts_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(accounts_raw(spark, sf_dir), ACCOUNTS)


def accounts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(accounts_clean(spark, sf_dir), ACCOUNTS.key)


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts_split(spark, sf_dir).filter(F.col("split") == "train")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scores, for answers that are exact on both sides."""
    urgent = F.col("priority").isin("1-URGENT", "2-HIGH")
    points = (
        F.when(urgent, 40).otherwise(0)
        + F.when(F.col("status") == "F", 25).otherwise(0)
        + F.when(F.col("segment") == "BUILDING", 20).otherwise(0)
        + (80 - F.col("tenure"))
    )
    rows = accounts_clean(spark, sf_dir).select(
        "account_id",
        F.when(F.col("churn") == "Yes", 1).otherwise(0).alias("label"),
        points.cast("bigint").alias("score"),
    )
    return rows.withColumn("prediction", F.when(F.col("score") > 95, 1).otherwise(0))


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules with their own thresholds, in long form from one scan."""
    rules = [
        F.struct(
            F.lit(name).alias("Model"),
            F.when(F.col("score") > limit, 1).otherwise(0).alias("prediction"),
        )
        for name, limit in RULES.items()
    ]
    return scored(spark, sf_dir).select(
        "account_id", "label", "score", F.inline(F.array(*rules))
    )


def trial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one observation of a trial: the event type is the model, the
    day picks the scale, the id the trial."""
    scale = F.element_at(
        F.array(*[F.lit(s) for s in SCALES]), F.dayofmonth("ts") % len(SCALES) + 1
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        scale.alias("Scale_Factor"),
        F.col("event_type").alias("Model"),
        (F.col("event_id") % 3 + 1).cast("int").alias("Trial"),
        cents.alias("cents"),
        F.when(cents > 5000, 1).otherwise(0).alias("label"),
        (cents + F.col("user_id") % 50 * 100).alias("raw_score"),
        F.when(cents + F.col("user_id") % 50 * 100 > 7000, 1)
        .otherwise(0)
        .alias("prediction"),
    )


def trials_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (scale, model, trial) with sizes, times and quality, all from one
    pass over the events."""
    key = ["Scale_Factor", "Model", "Trial"]
    grouped = metric_rows(
        trial_events(spark, sf_dir),
        key,
        sums={
            "Training_Rows": F.when(F.col("cents") >= 1000, 1).otherwise(0),
            "total_cents": F.col("cents"),
        },
    )
    times = grouped.withColumns(
        {
            "Base_Dataset_Rows": F.expr("rows div Scale_Factor"),
            "Synthetic_Total_Rows": F.col("rows"),
            "Testing_Rows": F.col("rows") - F.col("Training_Rows"),
            "Feature_Count": F.lit(45),
            "Training_Time_Seconds": F.round(F.col("total_cents") / 100, 6),
            "Prediction_Time_Seconds": F.round(F.col("total_cents") / 1000, 6),
        }
    )
    return conform(with_throughput(times), TRIAL_STORE_COLUMNS)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_in_first_trial(trials_all(spark, sf_dir))


# ---------------------------------------------------------------- SQL counterparts

_HASH = "('0x'||substr(md5({}),1,8))::bigint"
_RATING = (
    "40*(case when {p} in ('1-URGENT','2-HIGH') then 1 else 0 end)"
    " + 25*(case when {s}='F' then 1 else 0 end)"
    " + 20*(case when {m}='BUILDING' then 1 else 0 end)"
)
_RAW_RATING = _RATING.format(p="o_orderpriority", s="o_orderstatus", m="c_mktsegment")
_NUMBER = r"'^[+-]?[0-9]+$'"
_TRIAL_KEY = "Scale_Factor, Model, Trial"


def _sql_metrics(tn: str, fp: str, fn: str, tp: str) -> str:
    """Ratios from four counts, spelt out from their definitions."""
    def ratio(top, bottom):
        return f"coalesce(({top})::double / nullif({bottom}, 0), 0.0)"

    precision, recall = ratio(tp, f"{tp}+{fp}"), ratio(tp, f"{tp}+{fn}")
    neg_precision, neg_recall = ratio(tn, f"{tn}+{fn}"), ratio(tn, f"{tn}+{fp}")
    f1 = ratio(f"2*{precision}*{recall}", f"{precision}+{recall}")
    neg_f1 = ratio(f"2*{neg_precision}*{neg_recall}", f"{neg_precision}+{neg_recall}")
    total = f"({tn}+{fp}+{fn}+{tp})"
    weighted = ratio(f"({tn}+{fp})*{neg_f1} + ({fn}+{tp})*{f1}", total)
    return (
        f"round({ratio(f'{tn}+{tp}', total)}, 6) as Accuracy, "
        f"round({precision}, 6) as Precision_Churn, round({recall}, 6) as Recall_Churn, "
        f"round({f1}, 6) as F1_Churn, round({weighted}, 6) as Weighted_F1"
    )


SQL_COUNTS = (
    "count(*) filter (where label=0 and prediction=0) as True_Negatives, "
    "count(*) filter (where label=0 and prediction=1) as False_Positives, "
    "count(*) filter (where label=1 and prediction=0) as False_Negatives, "
    "count(*) filter (where label=1 and prediction=1) as True_Positives"
)
SQL_METRICS = _sql_metrics(
    "True_Negatives", "False_Positives", "False_Negatives", "True_Positives"
)


def sql_auc(source: str, by: str, score: str) -> str:
    """Rank-sum form with mid-ranks: another route than the Spark side takes."""
    part = f"partition by {by} " if by else ""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
select {keys}(sum(case when label=1 then mid else 0 end) - n1*(n1+1)/2.0) / nullif(n1*n0, 0) as auc
from (select {keys}label,
             rank() over ({part}order by {score})
               + (count(*) over (partition by {keys}{score}) - 1) / 2.0 as mid,
             sum(label) over ({part}) as n1, sum(1-label) over ({part}) as n0
      from {source}) ranked
{group}{',' if by else 'group by'} n1, n0"""


FIXTURE_SQL = {
    "accounts_raw": f"""
select cast(o_orderkey as varchar) account_id, c_mktsegment segment,
       o_orderpriority priority, o_orderstatus status, r_name region,
       cast(mon as varchar) tenure,
       case when hb % 640 = 0 then ' ' else cast(o_totalprice as varchar) end total_charges,
       cast(c_acctbal as varchar) balance,
       case when {_RAW_RATING} + (80 - mon) + hb % 60 > 125
            then 'Yes' else 'No' end churn
from (select *, {_HASH.format('cast(o_orderkey as varchar)')} hb,
             (2001-year(o_orderdate))*12 + (8-month(o_orderdate)) as mon
      from orders join customer on c_custkey=o_custkey
                  join nation on n_nationkey=c_nationkey
                  join region on r_regionkey=n_regionkey) t""",
    "accounts_trimmed": """
select nullif(trim(account_id), '') account_id, nullif(trim(segment), '') segment,
       nullif(trim(priority), '') priority, nullif(trim(status), '') status,
       nullif(trim(region), '') region, nullif(trim(tenure), '') tenure,
       nullif(trim(total_charges), '') total_charges,
       nullif(trim(balance), '') balance, nullif(trim(churn), '') churn
from accounts_raw""",
    "accounts_typed": f"""
select account_id, segment, priority, status, region,
       case when regexp_matches(tenure, {_NUMBER})
            then try_cast(tenure as integer) end tenure,
       try_cast(total_charges as double) total_charges,
       try_cast(balance as double) balance, churn
from accounts_trimmed""",
    "accounts_clean": """
select * from accounts_typed
where account_id is not null and segment is not null and priority is not null
  and status is not null and region is not null and tenure is not null
  and total_charges is not null and not isnan(total_charges)
  and balance is not null and not isnan(balance) and churn is not null""",
    "accounts_split": f"""
select *, case when {_HASH.format("'split:' || account_id")} % 100 < 80
               then 'train' else 'test' end as split
from accounts_clean""",
    "scored": f"""
select account_id, label, score, case when score > 95 then 1 else 0 end prediction
from (select account_id, case when churn='Yes' then 1 else 0 end label,
             cast({_RATING.format(p='priority', s='status', m='segment')}
                  + (80 - tenure) as bigint) score
      from accounts_clean) s""",
    "scored_models": """
select account_id, label, score, m.Model,
       case when score > m.threshold then 1 else 0 end prediction
from scored cross join (values """
    + ", ".join(f"('{n}', {t})" for n, t in RULES.items())
    + """) m(Model, threshold)""",
    "model_metrics": f"""
select Model, n as rows, {SQL_METRICS}, round(auc, 6) as ROC_AUC,
       True_Negatives, False_Positives, False_Negatives, True_Positives
from (select Model, count(*) n, {SQL_COUNTS} from scored_models group by Model) c
join ({sql_auc('scored_models', 'Model', 'score')}) a using (Model)""",
    "trial_events": f"""
select ([{', '.join(map(str, SCALES))}])[day(ts) % 6 + 1] as Scale_Factor,
       event_type as Model, cast(event_id % 3 + 1 as integer) as Trial, cents,
       case when cents > 5000 then 1 else 0 end as label,
       cents + user_id % 50 * 100 as raw_score,
       case when cents + user_id % 50 * 100 > 7000 then 1 else 0 end as prediction
from (select *, cast(round(value*100) as bigint) as cents from events) e""",
    "trials_all": f"""
select {_TRIAL_KEY}, n // Scale_Factor as Base_Dataset_Rows, n as Synthetic_Total_Rows,
       t as Training_Rows, n - t as Testing_Rows, 45 as Feature_Count,
       round(cents/100, 6) as Training_Time_Seconds,
       round(cents/1000, 6) as Prediction_Time_Seconds,
       round(coalesce(t / nullif(round(cents/100, 6), 0), 0.0), 2)
         as Training_Throughput_Rows_Per_Second,
       round(coalesce((n - t) / nullif(round(cents/1000, 6), 0), 0.0), 2)
         as Prediction_Throughput_Rows_Per_Second,
       {SQL_METRICS}, round(auc, 6) as ROC_AUC,
       True_Negatives, False_Positives, False_Negatives, True_Positives
from (select {_TRIAL_KEY}, count(*) n, count(*) filter (where cents >= 1000) t,
             sum(cents)::double cents, {SQL_COUNTS}
      from trial_events group by {_TRIAL_KEY}) c
join ({sql_auc('trial_events', _TRIAL_KEY, 'raw_score')}) a using ({_TRIAL_KEY})""",
    "trials": """
select * replace (
    case when Trial=1 then Accuracy end as Accuracy,
    case when Trial=1 then Precision_Churn end as Precision_Churn,
    case when Trial=1 then Recall_Churn end as Recall_Churn,
    case when Trial=1 then F1_Churn end as F1_Churn,
    case when Trial=1 then Weighted_F1 end as Weighted_F1,
    case when Trial=1 then ROC_AUC end as ROC_AUC,
    case when Trial=1 then True_Negatives end as True_Negatives,
    case when Trial=1 then False_Positives end as False_Positives,
    case when Trial=1 then False_Negatives end as False_Negatives,
    case when Trial=1 then True_Positives end as True_Positives)
from trials_all""",
}


def _spread_sql() -> str:
    runs = ", ".join(
        f"max(case when Trial={i} then {part}_Time_Seconds end) as {part}_Time_Run_{i}"
        for part in ("Training", "Prediction")
        for i in (1, 2, 3)
    )
    stats = ", ".join(
        f"round(avg({c}), {d}) as Mean_{c}, "
        f"round(coalesce(stddev_samp({c}), 0.0), {d}) as Std_{c}"
        for part in ("Training", "Prediction")
        for c, d in (
            (f"{part}_Time_Seconds", 6),
            (f"{part}_Throughput_Rows_Per_Second", 2),
        )
    )
    return f"{runs}, {stats}"


# The size and quality columns of the published tables.
_SIZE_AND_QUALITY = (
    "Base_Dataset_Rows",
    "Synthetic_Total_Rows",
    "Training_Rows",
    "Testing_Rows",
    "Feature_Count",
    "Accuracy",
    "Precision_Churn",
    "Recall_Churn",
    "F1_Churn",
    "Weighted_F1",
    "ROC_AUC",
    "True_Negatives",
    "False_Positives",
    "False_Negatives",
    "True_Positives",
)
_FIRST = ", ".join(
    f"max(case when Trial=1 then {c} end) as {c}" for c in _SIZE_AND_QUALITY
)
FIXTURE_SQL["summary"] = f"""
select Scale_Factor, Model, count(*) as Trials, {_FIRST}, {_spread_sql()}
from trials group by Scale_Factor, Model"""


def oracle(query: str) -> str:
    """The query with the fixtures it names, and theirs, as common table expressions."""
    needed: list[str] = []

    def add(text: str) -> None:
        words = set(_words(text))
        for name, body in FIXTURE_SQL.items():
            if name in words and name not in needed:
                add(body)
                if name not in needed:
                    needed.append(name)

    add(query)
    ctes = ", ".join(f"{n} as ({FIXTURE_SQL[n].strip()})" for n in needed)
    query = query.strip()
    if not ctes:
        return query
    own = query.removeprefix("with ")
    return f"with {ctes}{', ' if own != query else ' '}{own}"


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
