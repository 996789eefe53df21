"""Workbook and table sources, sinks and the whole pipeline."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.operators.validate import check_decoded
from statewalk.plans import pipeline
from statewalk.sinks.tables import Output
from statewalk.sources import tables, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_workbook(path, names, x, text_at=None):
    shared = "".join(f"<si><t>{n}</t></si>" for n in names)
    rows = ["".join(f'<c r="{chr(65 + c)}1" t="s"><v>{c}</v></c>' for c in range(len(names)))]
    for r, values in enumerate(x, 2):
        cells = []
        for c, v in enumerate(values):
            if text_at == (r - 2, c):
                cells.append(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>bad</t></is></c>')
            elif np.isfinite(v):
                cells.append(f'<c r="{chr(65 + c)}{r}"><v>{v!r}</v></c>')
        rows.append("".join(cells))
    body = "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture()
def study(tmp_path):
    rng = np.random.default_rng(4)
    for folder, count in (("Patients", 4), ("Controls", 4)):
        os.makedirs(tmp_path / "data" / folder)
        for s in range(count):
            level = np.repeat(rng.permutation([-2.0, 2.0] * 5), 6)
            x = level[:, None] * np.array([1.0, -0.8, 0.6]) + rng.normal(size=(60, 3))
            name = f"s{s}.XLSX" if s == 1 else f"s{s}.xlsx"
            write_workbook(tmp_path / "data" / folder / name, ["A", "B", "C"], x.tolist())
    return str(tmp_path)


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_workbooks(spark, study, hot_rows):
    df, names = workbooks.read_workbooks(spark, study, hot_rows=hot_rows)
    assert names == ["A", "B", "C"] and df.count() == 8 * 60
    ids = df.select("subject_id", "group", "file").distinct().orderBy("subject_id").collect()
    assert [r["subject_id"] for r in ids] == list(range(1, 9))
    assert [r["group"] for r in ids] == ["Dyslexia"] * 4 + ["TD"] * 4
    assert [r["file"] for r in ids[:4]] == ["s0.xlsx", "s1.XLSX", "s2.xlsx", "s3.xlsx"]


def test_workbook_errors(spark, study, tmp_path):
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, 0.1]]
    cases = {
        "not numbers": dict(x=good, text_at=(1, 0)), "infinite": dict(x=[[1.0, np.nan]] + good),
        "two rows": dict(x=good[:1]),
    }
    for message, case in cases.items():
        path = tmp_path / "one.xlsx"
        write_workbook(path, ["A", "B"], **case)
        with pytest.raises(ValueError, match=message):
            workbooks.read_workbook(path.read_bytes(), "one.xlsx")
    write_workbook(os.path.join(study, "data", "Patients", "z.xlsx"), ["A", "X", "C"],
                   np.random.default_rng(0).normal(size=(5, 3)).tolist())
    with pytest.raises(ValueError, match="disagree"):
        workbooks.read_workbooks(spark, study)


def test_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "data" / "Patients")
    os.makedirs(tmp_path / "data" / "Controls")
    with pytest.raises(FileNotFoundError):
        workbooks.read_workbooks(spark, str(tmp_path))


def test_decoded_csv(spark, tmp_path):
    path = tmp_path / "decoded.csv"
    path.write_text(
        "subject_id,group,file,timepoint,state\n1,controls,a,1,1\n1,TD,a,2,2\n2,Patient,b,1,2\n"
    )
    df = tables.read_decoded(spark, str(path))
    check_decoded(df, 2)
    assert {r["group"] for r in df.collect()} == {"TD", "Dyslexia"}


def test_matrix_files_and_fallback(spark, tmp_path):
    rows = [(s, i, j, 1.0 if i == j else 0.1 * s * (i + j - 3)) for s in (1, 2)
            for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    corr = spark.createDataFrame(rows, "state int, i int, j int, r double")
    out = Output(spark, str(tmp_path))
    out.matrices(corr, "r", "correlation_matrix", ["A", "B", "C"])
    back, source = tables.state_correlations(spark, str(tmp_path), 2)
    assert source == "csv"
    want = {(r["state"], r["i"], r["j"]): r["r"] for r in corr.collect()}
    assert {(r["state"], r["i"], r["j"]): r["r"] for r in back.collect()} == pytest.approx(want)
    with pytest.raises(FileNotFoundError):
        tables.state_correlations(spark, str(tmp_path), 3)
    cov = corr.withColumn("cov", F.col("r") * 4).drop("r")
    back, source = tables.state_correlations(spark, str(tmp_path), 3, cov)
    assert source == "model_covariance"
    assert {(r["state"], r["i"], r["j"]): r["r"] for r in back.collect()} == pytest.approx(want)


def test_single_matrix_files(spark, tmp_path):
    for s, r in ((1, 0.25), (2, -1.5)):
        (tmp_path / f"correlation_matrix_state_{s}.csv").write_text(
            f'"","A","B"\n"A",1,{r}\n"B",{r},1\n'
        )
    matrix, source = tables.state_correlations(spark, str(tmp_path), 2)
    assert source == "csv"
    got = {(r["state"], r["i"], r["j"]): r["r"] for r in matrix.collect()}
    assert got[1, 1, 2] == 0.25 and got[2, 1, 2] == -1.0 and got[2, 2, 2] == 1.0
    (tmp_path / "correlation_matrix_state_2.csv").write_text('"","A","B"\n"A",1,x\n"B",0,1\n')
    with pytest.raises(ValueError, match="state 2"):
        tables.state_correlations(spark, str(tmp_path), 2)


def test_pipeline(spark, study, tmp_path):
    df, names = workbooks.read_workbooks(spark, study)
    settings = pipeline.Settings(
        k_values=(2, 3), starts_model_selection=2, starts_selected_k=3, max_iterations=60,
        tolerance=0.1, kmeans_iterations=10, duration_cap=12, occupancy_permutations=50,
        sojourn_permutations=50, transition_permutations=50, bootstraps=50,
        louvain_repetitions=5, edge_proportions=(0.5,), sequence_width=60,
    )
    folder = str(tmp_path / "out")
    k = pipeline.run_pipeline(spark, df, ["x1", "x2", "x3"], names, folder, settings)
    assert k in (2, 3)
    for name in (
        "subject_information", "model_selection_bic", "final_model_summary", "decoded_states",
        "pairwise_stability", "stability_summary", "state_correlation", "group_occupancy_summary",
        "state_occupancy_permutation_tests", "sojourn_kl_permutation_results",
        "transition_group_comparison", "state_topology_primary_metrics",
        "state_topology_node_metrics", "threshold_summary", "analysis_settings",
    ):
        assert not spark.read.parquet(f"{folder}/{name}").isEmpty(), name
    assert spark.read.parquet(f"{folder}/decoded_states").count() == 480
    settings_rows = dict(spark.read.parquet(f"{folder}/topology_settings").collect())
    assert settings_rows["matrix_source"] == "csv"
    loaded = pipeline.load_analysis(spark, folder)
    total = loaded["initial_probabilities"].agg(F.sum("probability")).first()[0]
    assert total == pytest.approx(1.0)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        pipeline.run_pipeline(spark, df, ["x1", "x2", "x3"], names, folder, settings)
