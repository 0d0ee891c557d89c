import pytest
from pyspark.sql import functions as F

from tidegate.operators import cleaning as C
from tidegate.plans.prepare import clean_flows
from tidegate.schemas import FLOW_FEATURES
from tidegate.sources.flow_csv import discover, header_groups, header_names, load_raw


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_feature_list_has_77_names():
    assert len(FLOW_FEATURES) == 77 == len(set(FLOW_FEATURES))


@pytest.mark.parametrize("label, category", [
    ("BENIGN", "BENIGN"), (" BENIGN ", "BENIGN"), ("DoS Hulk", "DoS"), ("Heartbleed", "DoS"), ("DDoS", "DDoS"),
    ("FTP-Patator", "Brute Force"), ("SSH-Patator", "Brute Force"), ("Web Attack  XSS", "Web Attack"),
    ("PortScan", "PortScan"), ("Infiltration", "Infiltration"), ("Bot", "Bot"), ("Something new", "Something new"),
])
def test_categories(spark, label, category):
    df = spark.createDataFrame([(1.0, label)], "a double, Label string")
    assert C.normalise_labels(df).first().Category == category


def test_label_is_required(spark):
    with pytest.raises(KeyError):
        C.normalise_labels(spark.createDataFrame([(1.0,)], "a double"))


def test_numbers_are_repaired(spark):
    df = spark.createDataFrame(
        [("1.5", "A"), (" 2 ", "A"), ("Infinity", "A"), ("-inf", "A"), ("NaN", "A"), ("junk", "A"), ("", "A"), (None, "A"), ("3", None)],
        "`x.1` string, Label string")
    assert [r[0] for r in C.coerce_numeric(df).collect()] == [1.5, 2.0, None, None, None, None, None, None, 3.0]
    assert C.count_infinite(df).first()[0] == 2
    assert C.drop_missing(C.coerce_numeric(df)).count() == 2


def test_single_precision(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (0.1,)], "a double")
    out = [r.a for r in C.sanitise_features(df, ["a"]).select(F.col("a").cast("double")).collect()]
    assert out[:4] == [3.4028234663852886e38, -3.4028234663852886e38, 0.0, 0.0]
    assert out[4] == pytest.approx(0.1, abs=1e-8) and out[4] != 0.1


def test_rare_categories(spark):
    data = [("BENIGN",)] + [("Bot",)] * 2 + [("DoS",)] * 3
    df = spark.createDataFrame(data, "Category string")
    assert rows(C.drop_rare_categories(df, 3).distinct()) == [("BENIGN",), ("DoS",)]
    assert C.drop_rare_categories(df, 0).count() == 6


def test_duplicates_go_before_labels_are_merged(spark):
    data = [("1", "DoS Hulk"), ("1", "DoS Hulk"), ("1", "DoS GoldenEye")]
    out = clean_flows(spark.createDataFrame(data, "a string, Label string"), 1.0, 1)
    assert out.count() == 2 and rows(out.select("Category").distinct()) == [("DoS",)]
    assert clean_flows(spark.createDataFrame(data, "a string, Label string"), 1.0, 1, dedup=False).count() == 3


def test_headers():
    assert header_names(" Flow ID, Fwd Header Length,Label, Fwd Header Length,") == [
        "Flow ID", "Fwd Header Length", "Label", "Fwd Header Length.1", "Unnamed: 4"]


def test_csv_files_are_stacked_by_name(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes(b" Flow Duration, Fwd Header Length, Fwd Header Length, Label\n1,2,3,BENIGN\nInfinity,5,6,DDoS\n")
    (tmp_path / "sub" / "b.CSV").write_bytes(b" Flow Duration, Label, Fwd Header Length, Fwd Header Length\n7,Web Attack \x96 XSS,8,9\n")
    (tmp_path / "sub" / "c.csv").write_bytes(" Flow Duration, Label\n4,Web Attack – XSS\n".encode())
    (tmp_path / "note.txt").write_text("x\n")
    raw = load_raw(spark, str(tmp_path))
    assert raw.columns == ["Flow Duration", "Fwd Header Length", "Fwd Header Length.1", "Label"]
    got = {r["Flow Duration"]: (r["Fwd Header Length"], r["Fwd Header Length.1"], r["Label"]) for r in raw.collect()}
    assert got == {
        "1": ("2", "3", "BENIGN"), "Infinity": ("5", "6", "DDoS"), "7": ("8", "9", "Web Attack \x96 XSS"),
        "4": (None, None, "Web Attack – XSS"),
    }
    prepared = clean_flows(raw, 1.0, 42)
    assert rows(prepared.select("Flow Duration", "Category")) == [(1.0, "BENIGN"), (7.0, "Web Attack")]


def test_missing_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        load_raw(spark, str(tmp_path))


def test_headers_of_many_files(spark, tmp_path):
    for i in range(200):
        name, end = ("a é" if i % 3 == 0 else "b"), ("\r\n" if i % 2 else "\n")
        (tmp_path / f"f {i:03d}.csv").write_bytes(f" {name},Label{end}{i},x{end}".encode("utf-8" if i % 6 else "latin-1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    files = discover(spark, str(tmp_path))
    assert files.count() == 200  # empty files have no header
    groups = header_groups(spark, str(tmp_path))
    assert {names: len(paths) for names, paths in groups.items()} == {("a é", "Label"): 67, ("b", "Label"): 133}
    raw = load_raw(spark, str(tmp_path))
    assert set(raw.columns) == {"a é", "b", "Label"}
    numbers = [int(v) for r in raw.collect() for v in (r["a é"], r["b"]) if v is not None]
    assert sorted(numbers) == list(range(200))
