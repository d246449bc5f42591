"""The jobs on landed files must give what the plans give on the frames."""

import pytest
from pyspark.sql import functions as F

from quantloom.__main__ import main
from quantloom.operators import forest
from quantloom.operators.blend import display
from quantloom.plans import serving
from quantloom.sources import derived, readers

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    derived.listing(spark, SF_DIR).select(
        F.col("ticker").alias("Code"), F.col("name").alias("Name"), F.col("shares").alias("Stocks")
    ).write.parquet(f"{root}/listing")
    readers.write_bars(derived.bars(spark, SF_DIR), f"{root}/bars")
    derived.companies(spark, SF_DIR).write.option("header", True).csv(f"{root}/companies")
    label = F.col("account")
    for ours, theirs in readers.ACCOUNT_LABELS.items():
        label = F.when(F.col("account") == ours, F.lit(theirs)).otherwise(label)
    item = F.struct(
        F.col("ticker").alias("stock_code"), label.alias("account_nm"), F.col("amount_raw").alias("thstrm_amount")
    )
    (
        derived.statements(spark, SF_DIR)
        .groupBy("year", "ticker")
        .agg(F.collect_list(item).alias("list"))
        .withColumn("status", F.lit(readers.STATUS_OK))
        .drop("ticker")
        .write.partitionBy("year")
        .json(f"{root}/statements")
    )
    as_of = derived.last_day(spark, SF_DIR)
    derived.headlines(spark, SF_DIR).select(
        "ticker", F.date_sub(F.lit(as_of), F.col("age_days").cast("int")).alias("date"), "seq", "title"
    ).write.parquet(f"{root}/headlines")
    main(["code-map", "--companies", f"{root}/companies", "--out", f"{root}/code_map"])
    return root, as_of


def test_train_and_rank(spark, landed):
    root, as_of = landed
    tables = [x for t in ("listing", "code_map", "bars", "statements") for x in (f"--{t}", f"{root}/{t}")]
    common = ["--excluded", derived.EXCLUDED_NAMES]
    main(
        ["train", *tables, *common, "--model", f"{root}/model", "--n_iter", "1", "--max_depth", "4"]
        + ["--trees", "5", "5", "--balance", "weight"]
    )
    main(["train-sequences", "--listing", f"{root}/listing", "--bars", f"{root}/bars", *common]
         + ["--model", f"{root}/trend", "--epochs", "3"])
    main(
        ["rank", *tables, *common, "--model", f"{root}/model", "--out", f"{root}/ranked"]
        + ["--sequence_model", f"{root}/trend", "--headlines", f"{root}/headlines"]
    )
    model = forest.load_model(f"{root}/model")
    want = serving.rank_universe(
        derived.listing(spark, SF_DIR),
        derived.code_map(spark, SF_DIR),
        derived.bars(spark, SF_DIR),
        derived.statements(spark, SF_DIR),
        as_of,
        predict=lambda universe: forest.score_instruments(model, universe),
        excluded=derived.EXCLUDED_NAMES,
        one_bar_a_day=True,
    )
    got = spark.read.parquet(f"{root}/ranked")
    shown = display(want)
    assert got.columns == shown.columns and got.count() > 3
    assert got.exceptAll(shown).count() == 0 and shown.exceptAll(got).count() == 0


def test_rank_without_a_model_stops(landed):
    root, _ = landed
    tables = [x for t in ("listing", "code_map", "bars", "statements") for x in (f"--{t}", f"{root}/{t}")]
    with pytest.raises(FileNotFoundError):
        main(["rank", *tables, "--model", f"{root}/nothing", "--out", f"{root}/none"])
