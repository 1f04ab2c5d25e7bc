import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


NEWER = [
    "agg_16_empirical_cdf", "agg_48_ngram_overlap", "ext_24_archive_records", "ext_31_rating_reports", "ext_33_blind_sides", "ext_34_win_10_gap_sentences", "ext_47_sample_rates", "flt_02_04_detected_filter", "flt_04_language_detection", "flt_10_html_tables",
    "joi_13_14_15_skip_done", "joi_22_box_components", "joi_23_url_provenance", "pip_04_udf_04_benchmark", "pip_08_decontamination", "rul_04_05_06_variant_rules", "snk_02_11_13_markdown_files", "snk_06_16_src_11_bundles", "snk_10_summary_files", "src_17_candidate_outputs",
    "src_25_votes_with_metadata", "stm_03_runs_with_clear", "str_25_nested_equations", "str_26_tex_equations", "str_49_coherency", "udtf_word_ngrams", "win_03_chunks", "win_12_line_index",
]


def test_registry_needs_no_session():
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_parts(tmp_path):
    for part in ("__spark_entry__.py", "docflow"):
        (tmp_path / part).symlink_to(ROOT / part) if part.endswith(".py") else None
    import shutil

    shutil.copytree(ROOT / "docflow", tmp_path / "docflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); sys.path = [p for p in sys.path if p not in ('', {str(ROOT)!r})]; import importlib.util as u; s = u.spec_from_file_location('e', {str(ROOT / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert 'agg_14_rule_confusion' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print('ok')"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "ok", out.stderr


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", ["agg_14_rule_confusion", "agg_02_page_spans", "joi_01_map_01_attribute_merge", "win_04_snk_06_07_bins", "str_13_strip_markdown", "tbl_01_02_grid_cells", "stm_01_04_stream_window", "snk_03_04_aligned_attributes", "agg_41_medoid", "flt_02_document_filter", *NEWER])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, str(DATA))
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted(str([str(x) for x in r]) for r in rows)
    assert key(tuple(r[n] for n in names) for r in got.collect()) == key(want.fetchall())


def test_flagship(spark):
    if DATA.exists():
        assert entry.entry(spark).count() == 1
