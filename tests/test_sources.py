import datetime as dt
from pathlib import Path

import pytest

from tidemark.session import materialize, scratch, shared_folder
from tidemark.sources import csv, star

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def test_retail_file(spark, tmp_path):
    path = tmp_path / "retail.csv"
    text = HEADER + "536365,85123A,CAFÉ MUG,6,12/1/2010 8:26,2.55,17850,United Kingdom\nC1,D,x,-1,1/10/2011 14:05,27.5,,France\n"
    path.write_bytes(text.encode("latin-1"))
    first, second = sorted(csv.read_transactions(spark, str(path)).collect(), key=lambda r: r.InvoiceNo)
    assert first.InvoiceDate == dt.datetime(2010, 12, 1, 8, 26) and first.CustomerID == 17850
    assert first.Description == "CAFÉ MUG"
    assert second.CustomerID is None and second.Quantity == -1.0 and second.InvoiceDate.day == 10


def test_long_ids_stay_apart(spark, tmp_path):
    path = tmp_path / "ids.csv"
    ids = ["9007199254740992", "9007199254740993", "9007199254740993.0"]
    path.write_text(HEADER + "".join(f"{i},b,c,1,12/1/2010 8:26,1,{x},X\n" for i, x in enumerate(ids)))
    found = {r.InvoiceNo: r.CustomerID for r in csv.read_transactions(spark, str(path)).collect()}
    assert found == {"0": 9007199254740992, "1": 9007199254740993, "2": 9007199254740993}


def test_reordered_header_and_bad_lines_are_refused(spark, tmp_path):
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("StockCode,InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\na,b,c,1,12/1/2010 8:26,1,1,X\n")
    bad = tmp_path / "bad.csv"
    bad.write_text(HEADER + "a,b,c,one,12/1/2010 8:26,1,1,X\n")
    for path in (swapped, bad):
        with pytest.raises(Exception):
            csv.read_transactions(spark, str(path)).collect()


def test_subscriber_blanks_survive(spark, tmp_path):
    path = tmp_path / "subscribers.csv"
    names = [f.name for f in csv.SUBSCRIBER_SCHEMA]
    values = {"customerID": "7590", "gender": "Female", "SeniorCitizen": "0", "tenure": "0", "MonthlyCharges": "29.85", "TotalCharges": " ", "Churn": "Yes"}
    path.write_text(",".join(names) + "\n" + ",".join(values.get(n, "No") for n in names) + "\n")
    row = csv.read_subscribers(spark, str(path)).first()
    assert (row.TotalCharges, row.Churn, row.tenure) == (" ", 1, 0)


def test_sales_and_responses(spark, tmp_path):
    sales = tmp_path / "sales.csv"
    sales.write_text("date,store,item,sales\n2013-01-01,1,1,13\n")
    assert csv.read_daily_sales(spark, str(sales)).first().date == dt.date(2013, 1, 1)
    responses = tmp_path / "responses.csv"
    responses.write_text(
        "recency,history,used_discount,used_bogo,zip_code,is_referral,channel,offer,conversion\n10,142.44,1,0,Surburban,0,Phone,Buy One Get One,0\n"
    )
    assert csv.read_responses(spark, str(responses)).first().offer == "Buy One Get One"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_tables_and_columns_are_read(spark, sf_dir):
    text = plan(star.transactions(spark, sf_dir, ["CustomerID", "InvoiceYearMonth"]))
    assert "p_retailprice" not in text and "n_name" not in text and "l_quantity" not in text
    assert "l_partkey" not in text and text.count("Join") == 1
    with pytest.raises(ValueError):
        star.transactions(spark, sf_dir, ["Colour"])


def test_lookups_do_not_change_the_lines(spark, sf_dir):
    assert star.transactions(spark, sf_dir).count() == star.table(spark, sf_dir, "lineitem").count()


def test_materialize_keeps_rows_and_types(spark, sf_dir):
    frame = star.responses(spark, sf_dir)
    stored = materialize(frame)
    assert stored.dtypes == frame.dtypes and stored.exceptAll(frame).count() == 0
    assert all(shared_folder(spark).removeprefix("file:") in path for path in stored.inputFiles())


def test_scratch_is_deleted(spark):
    before = shared_folder(spark)
    with scratch(spark) as folder:
        assert materialize(spark.range(3)).count() == 3
        assert shared_folder(spark) == folder and folder.startswith(before)
        assert Path(folder.removeprefix("file://")).exists()
    assert shared_folder(spark) == before and not Path(folder.removeprefix("file://")).exists()
