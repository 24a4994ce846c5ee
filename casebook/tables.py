"""Registered queries: sources, sinks, profiles, cleaning, checks, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.fixtures import (
    ACCOUNTS,
    accounts_clean,
    accounts_raw,
    accounts_split,
    scored,
    table,
)
from tabwright.functions.layouts import retype
from tabwright.operators import clean, gates, profile, sampling, selection, validate
from tabwright.operators.features import category_index
from tabwright.sources import sinks, tables
from tabwright.sources.workspace import fresh_path

RAW = list(ACCOUNTS.columns)
RAW_SQL = ", ".join(RAW)
_RAW_ORDER = (
    "account_id",
    "segment",
    "priority",
    "status",
    "region",
    "tenure",
    "total_charges",
    "balance",
    "churn",
)


def csv_infer_scan(spark, sf) -> DataFrame:
    path = sinks.write_csv(accounts_raw(spark, sf), fresh_path(spark, "raw.csv"))
    return tables.read_csv_inferred(spark, path)


def csv_string_scan(spark, sf) -> DataFrame:
    raw = accounts_raw(spark, sf).select(*RAW)
    path = sinks.write_csv(raw, fresh_path(spark, "raw.csv"))
    back = tables.read_csv_text(spark, path, ACCOUNTS.text_schema())
    return tables.require_rows(back, "the raw table")


def parquet_scan(spark, sf) -> DataFrame:
    return tables.read_parquet(spark, f"{sf}/orders.parquet")


def csv_sink_roundtrip(spark, sf) -> DataFrame:
    from casebook.evaluation import scored_output

    flat = scored_output(spark, sf)
    path = sinks.write_csv(flat, fresh_path(spark, "scores.csv"))
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    return tables.read_stored_csv(spark, path, layout)


def csv_roundtrip_documents(spark, sf) -> DataFrame:
    """Whole texts with line breaks, quotes and backslashes through the CSV sink."""
    texts = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit('"\\n'), "text", F.lit('\r\n\\\\"')).alias("text"),
    )
    path = sinks.write_csv(texts, fresh_path(spark, "texts.csv"))
    return tables.read_stored_csv(spark, path, "doc_id bigint, text string")


def retype_rows(spark, sf) -> DataFrame:
    text = accounts_raw(spark, sf).select(
        "account_id",
        F.concat("tenure", F.lit(".0")).alias("tenure"),
        F.col("balance").alias("whole_balance"),
        "total_charges",
    )
    layout = "account_id string, tenure int, whole_balance bigint, total_charges double"
    return retype(text, layout)


def range_source(spark, sf) -> DataFrame:
    """Ids 0 .. n-1 for the n orders, compared with the order keys."""
    orders = table(spark, sf, "orders")
    ids = tables.id_range(spark, orders.count(), "o_orderkey")
    found = ids.join(orders.select("o_orderkey", F.lit(1).alias("hit")), "o_orderkey", "left")
    return found.agg(
        F.count(F.lit(1)).alias("ids"),
        F.sum("o_orderkey").alias("id_sum"),
        F.count_if(F.col("hit").isNull()).alias("ids_without_order"),
    )


def table_profile(spark, sf) -> DataFrame:
    raw = accounts_raw(spark, sf)
    return profile.row_count(raw).withColumn("column_count", F.lit(len(raw.columns)))


def schema_rows(spark, sf) -> DataFrame:
    """The schema of the typed table next to the NULLs of each column."""
    typed = cast_numeric(spark, sf)
    return profile.schema_rows(typed).join(profile.null_counts(typed), "column_name")


def head_n(spark, sf) -> DataFrame:
    return profile.first_rows(accounts_clean(spark, sf), ["account_id"], 5)


def label_distribution(spark, sf) -> DataFrame:
    return profile.label_distribution(accounts_clean(spark, sf), "churn")


def label_values(spark, sf) -> DataFrame:
    return profile.label_values(accounts_clean(spark, sf), "churn")


def clean_accounting(spark, sf) -> DataFrame:
    return profile.cleaning_accounts(
        clean.to_typed(accounts_raw(spark, sf), ACCOUNTS), ACCOUNTS
    )


def split_accounting(spark, sf) -> DataFrame:
    return profile.split_accounting(accounts_split(spark, sf))


def clean_blank_to_null(spark, sf) -> DataFrame:
    return clean.trim_blanks(accounts_raw(spark, sf))


def cast_numeric(spark, sf) -> DataFrame:
    return clean.to_typed(accounts_raw(spark, sf), ACCOUNTS)


def drop_incomplete(spark, sf) -> DataFrame:
    trimmed = clean.trim_blanks(accounts_raw(spark, sf))
    return clean.drop_incomplete(trimmed)


def null_counts(spark, sf) -> DataFrame:
    typed = clean.to_typed(accounts_raw(spark, sf), ACCOUNTS)
    return profile.null_counts(typed, RAW)


def alias_columns(spark, sf) -> DataFrame:
    return clean.resolve_columns(
        table(spark, sf, "customer"),
        {
            "customer": ["Customer", "c_custkey"],
            "balance": ["balance", "acctbal", "c_acctbal"],
            "segment": ["c_mktsegment", "segment"],
        },
    )


def numeric_gate(spark, sf) -> DataFrame:
    raw = accounts_raw(spark, sf)
    rules = [validate.numeric_text(c) for c in ("tenure", "total_charges", "priority")]
    return validate.validate(raw, rules)


def display_names(spark, sf) -> DataFrame:
    names = {"F": "finished", "O": "open"}
    shown = clean.with_display_name(accounts_clean(spark, sf), "status", names, "shown")
    return shown.groupBy("status", "shown").agg(F.count(F.lit(1)).alias("rows"))


def report_rules() -> list:
    return [
        validate.columns_present("account_id", "churn", "no_such_column"),
        validate.not_empty(),
        validate.no_nulls("churn"),
        validate.no_nulls("total_charges"),
        validate.domain("churn", ("Yes", "No"), complete=True),
        validate.domain("churn", ("Yes", "No", "Maybe"), complete=True),
        validate.domain("status", ("F", "O")),
        validate.row_count_is(7043, severity="warn"),
        validate.none_where("balance_below_zero", F.col("balance") < 0, "warn"),
    ]


def validate_report(spark, sf) -> DataFrame:
    return validate.validate(clean.to_typed(accounts_raw(spark, sf), ACCOUNTS), report_rules())


def gates_after_append(spark, sf) -> DataFrame:
    """The report on a table that grew, where only the appended files were read for it.
    Either part alone would fail the rule on both labels."""
    typed = clean.to_typed(accounts_raw(spark, sf), ACCOUNTS)
    path, state = fresh_path(spark, "grown"), fresh_path(spark, "gates")
    stays = F.col("churn").eqNullSafe("No")
    sinks.write_parquet(typed.where(stays), path)
    first = gates.gate_table(spark, path, state, report_rules())
    sinks.write_parquet(typed.where(~stays), path, "append")
    grown = gates.gate_table(spark, path, state, report_rules())
    apart = set(first.scanned).isdisjoint(grown.scanned)
    only_new = apart and 0 < len(grown.scanned) == grown.files - first.files
    return grown.report.withColumn("only_new_read", F.lit(only_new))


def hash_split(spark, sf) -> DataFrame:
    return accounts_split(spark, sf).select("account_id", "split")


def exact_split(spark, sf) -> DataFrame:
    """Exactly three tenths of the rows, rounded down, by the smallest hashes of the key."""
    rows = accounts_clean(spark, sf).select("account_id", "segment")
    return selection.exact_split(rows, "account_id", train_share=0.3)


def exact_split_repeated_keys(spark, sf) -> DataFrame:
    """A key of five values, so that the cut goes through rows of one key, and of these
    through rows that are equal in all columns."""
    rows = accounts_clean(spark, sf).select("segment", "priority")
    split = selection.exact_split(rows, "segment", train_share=0.3)
    return split.groupBy("segment", "priority", "split").agg(F.count(F.lit(1)).alias("rows"))


def random_split(spark, sf) -> DataFrame:
    """Both parts together are the table, and no key is in both."""
    train, test = sampling.random_split(accounts_clean(spark, sf).select("account_id"))
    both = train.withColumn("part", F.lit(1)).unionByName(test.withColumn("part", F.lit(2)))
    per_key = both.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("part").alias("part")
    )
    share = F.count_if(F.col("part") == 1) / F.count(F.lit(1))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count_if(F.col("n") > 1).alias("keys_in_both"),
        share.between(0.75, 0.85).alias("share_near_four_fifths"),
    )


def replicate(spark, sf) -> DataFrame:
    copies = sampling.replicate(accounts_split(spark, sf), 5)
    return copies.groupBy("split", "churn").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tenure").alias("tenure_sum")
    )


def cross_join(spark, sf) -> DataFrame:
    copies = sampling.with_copies(accounts_clean(spark, sf).select("account_id"), 3)
    return copies.withColumn("copy_id", F.col("copy_id").cast("bigint"))


def category_counts(spark, sf) -> DataFrame:
    train = accounts_split(spark, sf).filter(F.col("split") == "train")
    return category_index(train, ACCOUNTS.categorical)


def label_index(spark, sf) -> DataFrame:
    """Labels by frequency next to the label by declared positive value."""
    rows = accounts_clean(spark, sf)
    index = category_index(rows, [ACCOUNTS.label])
    positive = F.when(F.col("value") == ACCOUNTS.positive, 1.0).otherwise(0.0)
    return index.select("value", "rows", "category_index", positive.alias("label"))


def strip_metadata(spark, sf) -> DataFrame:
    from pyspark.ml.feature import StringIndexer

    from tabwright.functions.vectors import strip_metadata as strip

    rows = scored(spark, sf).withColumn("text", F.col("label").cast("string"))
    indexed = StringIndexer(inputCol="text", outputCol="index", handleInvalid="keep")
    marked = indexed.fit(rows).transform(rows)
    plain = strip(marked, "index")
    return plain.groupBy(F.col("index")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(marked.schema["index"].metadata)).alias("metadata_before"),
        F.lit(len(plain.schema["index"].metadata)).alias("metadata_after"),
    )


_CATEGORY_SQL = " union all ".join(
    f"select '{c}' as column_name, {c} as value from accounts_split where split='train'"
    for c in ACCOUNTS.categorical
)

REPORT_SQL = """
with t as (select count(*) n, count(*) filter (where churn is null) no_churn,
                  count(*) filter (where total_charges is null) no_charges,
                  count(*) filter (where churn not in ('Yes','No')) odd,
                  count(*) filter (where status not in ('F','O')) other_status,
                  count(*) filter (where balance < 0) below,
                  2 - count(distinct churn) as absent,
                  2 - count(distinct case when status in ('F','O') then status end) as absent_status
           from accounts_typed)
select 'columns_present' as rule, 'error' as severity, false as ok,
       'no_such_column' as observed, '' as expected
union all select 'not_empty', 'error', n > 0, cast(n as varchar), '>0' from t
union all select 'no_nulls:churn', 'error', no_churn = 0, cast(no_churn as varchar), '0' from t
union all select 'no_nulls:total_charges', 'error', no_charges = 0,
                 cast(no_charges as varchar), '0' from t
union all select 'domain:churn', 'error', odd = 0 and absent = 0,
                 'outside=' || odd || ' absent=' || absent, 'equal Yes,No' from t
union all select 'domain:churn', 'error', false,
                 'outside=' || odd || ' absent=' || (absent + 1), 'equal Yes,No,Maybe' from t
union all select 'domain:status', 'error', other_status = 0,
                 'outside=' || other_status || ' absent=' || absent_status, 'subset F,O' from t
union all select 'row_count', 'warn', n = 7043, cast(n as varchar), '7043' from t
union all select 'balance_below_zero', 'warn', below = 0, cast(below as varchar), '0' from t"""

CASES = {
    "csv_infer_scan": (
        csv_infer_scan,
        f"""select cast(account_id as integer) account_id, segment, priority, status, region,
                   cast(tenure as integer) tenure, total_charges,
                   cast(balance as double) balance, churn from accounts_raw""",
    ),
    "csv_string_scan": (csv_string_scan, f"select {RAW_SQL} from accounts_raw"),
    "parquet_scan": (parquet_scan, "select * from orders"),
    "csv_roundtrip_documents": (
        csv_roundtrip_documents,
        r"""select doc_id, '"\n' || text || chr(13) || chr(10) || '\\"' as text
            from documents""",
    ),
    "csv_sink_roundtrip": (
        csv_sink_roundtrip,
        """select account_id, cast(label as double) actual_label,
                  cast(prediction as double) predicted_label,
                  case when prediction=1 then 'Churn' else 'No Churn' end prediction_result,
                  round(1 - score/200.0, 6) probability_no_churn,
                  round(score/200.0, 6) probability_churn
           from scored""",
    ),
    "retype_rows": (
        retype_rows,
        """select account_id, cast(tenure as integer) tenure,
                  cast(trunc(cast(balance as double)) as bigint) whole_balance,
                  try_cast(total_charges as double) total_charges
           from accounts_raw""",
    ),
    "range_source": (
        range_source,
        """select count(*) as ids, cast(sum(id) as bigint) as id_sum,
                  count(*) filter (where o_orderkey is null) as ids_without_order
           from (select range as id from range((select count(*) from orders))) r
           left join orders on o_orderkey = id""",
    ),
    "profile": (
        table_profile,
        "select count(*) as row_count, 9 as column_count from accounts_raw",
    ),
    "schema_rows": (
        schema_rows,
        " union all ".join(
            f"""select {i} as position, '{c}' as column_name,
                       case min(typeof({c})) when 'VARCHAR' then 'string'
                            when 'INTEGER' then 'int' else lower(min(typeof({c}))) end
                         as data_type,
                       count(*) filter (where {c} is null) as nulls from accounts_typed"""
            for i, c in enumerate(_RAW_ORDER)
        ),
    ),
    "head_n": (head_n, "select * from accounts_clean order by account_id limit 5"),
    "label_distribution": (
        label_distribution,
        "select churn, count(*) as rows from accounts_clean group by churn",
    ),
    "label_values": (label_values, "select distinct churn from accounts_clean"),
    "clean_accounting": (
        clean_accounting,
        """select r.n as original_rows, c.n as clean_rows, r.n - c.n as removed_rows
           from (select count(*) n from accounts_raw) r,
                (select count(*) n from accounts_clean) c""",
    ),
    "split_accounting": (
        split_accounting,
        """select split, count(*) as rows,
                  round(count(*)*100.0 / (select count(*) from accounts_split), 2) as percentage
           from accounts_split group by split""",
    ),
    "clean_blank_to_null": (clean_blank_to_null, "select * from accounts_trimmed"),
    "cast_numeric": (cast_numeric, "select * from accounts_typed"),
    "drop_incomplete": (
        drop_incomplete,
        "select * from accounts_trimmed where "
        + " and ".join(f"{c} is not null" for c in RAW),
    ),
    "clean_accounts": (accounts_clean, "select * from accounts_clean"),
    "null_counts": (
        null_counts,
        " union all ".join(
            f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls"
            " from accounts_typed"
            for c in RAW
        ),
    ),
    "strip_metadata": (
        strip_metadata,
        """select cast(label as double) as index, count(*) as rows,
                  1 as metadata_before, 0 as metadata_after
           from scored group by label""",
    ),
    "alias_columns": (
        alias_columns,
        "select c_custkey customer, c_acctbal balance, c_mktsegment segment from customer",
    ),
    "numeric_gate": (
        numeric_gate,
        " union all ".join(
            f"""select 'numeric:{c}' as rule, 'error' as severity,
                       bad = 0 as ok, cast(bad as varchar) as observed, '0' as expected
                from (select count(*) filter (where try_cast(trim({c}) as double) is null) bad
                      from accounts_raw) b"""
            for c in ("tenure", "total_charges", "priority")
        ),
    ),
    "display_names": (
        display_names,
        """select status, case status when 'F' then 'finished' when 'O' then 'open'
                                      else status end as shown, count(*) as rows
           from accounts_clean group by status""",
    ),
    "validate_report": (validate_report, REPORT_SQL),
    "gates_after_append": (
        gates_after_append,
        f"select r.*, true as only_new_read from ({REPORT_SQL}) r",
    ),
    "hash_split": (hash_split, "select account_id, split from accounts_split"),
    "exact_split": (
        exact_split,
        """select account_id, segment,
                  case when place <= floor(total * 0.3) then 'train' else 'test' end as split
           from (select account_id, segment, count(*) over () as total,
                        row_number() over (order by ('0x'||substr(md5('exact:' || account_id),
                                                                  1, 15))::bigint) as place
                 from accounts_clean) r""",
    ),
    "exact_split_repeated_keys": (
        exact_split_repeated_keys,
        """select segment, priority, case when place <= floor(total * 0.3) then 'train'
                                         else 'test' end as split, count(*) as rows
           from (select *, count(*) over () as total, row_number() over (order by
                     ('0x'||substr(md5('exact:' || segment), 1, 15))::bigint,
                     ('0x'||substr(md5('exact:{"segment":"' || segment || '","priority":"'
                                       || priority || '"}'), 1, 15))::bigint) as place
                 from accounts_clean) r
           group by 1, 2, 3""",
    ),
    "random_split": (
        random_split,
        """select count(*) as rows, cast(0 as bigint) as keys_in_both,
                  true as share_near_four_fifths from accounts_clean""",
    ),
    "replicate": (
        replicate,
        """select split, churn, count(*) as rows, cast(sum(tenure) as bigint) as tenure_sum
           from accounts_split cross join range(5) copies group by split, churn""",
    ),
    "cross_join": (
        cross_join,
        """select account_id, range as copy_id from accounts_clean cross join range(3)""",
    ),
    "category_index": (
        category_counts,
        f"""select column_name, value, rows,
                   cast(row_number() over (partition by column_name
                                           order by rows desc, value) - 1 as integer)
                     as category_index
            from (select column_name, value, count(*) as rows
                  from ({_CATEGORY_SQL}) c group by column_name, value) g""",
    ),
    "label_index": (
        label_index,
        """select churn as value, count(*) as rows,
                  cast(row_number() over (order by count(*) desc, churn) - 1 as integer)
                    as category_index,
                  case when churn='Yes' then 1.0::double else 0.0::double end as label
           from accounts_clean group by churn""",
    ),
}
