"""Registered queries against their SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from marlstone.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares all of them.
NAMES = ["a01_run_totals", "a10_best_run", "w04_pareto_front", "w07_pareto_rank", "j04_nearest_rivals", "a11_a12_byte_entropy", "a13_u16_entropy", "a17_joint_histogram_cnw", "c02_order1_size", "c05_c06_qnw", "c15_c16_cscore", "c18_o04_best_predictor", "t06_ycocg_r_roundtrip", "t38_clampgrad_roundtrip", "t58_sel4_roundtrip", "t104_wht8_roundtrip", "t99_cdf97_roundtrip", "q07_ssim", "q14_o06_phase", "w16_t47_t48_filters", "f14_f20_bits", "pipeline_color_predict_size"]
NAMES += ["w19_running_state", "t78_mm_second_roundtrip", "t85_angles_roundtrip", "a19_context_histogram", "c04_entropy_recipe", "c07_adaptive_qnw", "c09_grctx", "c10_c2", "c11_golomb_rice", "c13_abac1", "c14_model_view", "c18_recipe", "c19_bpd0", "q17_curve_score", "a16_channel_ratios", "t26_rls_roundtrip", "t30_ols7_roundtrip", "t33_ols9_roundtrip", "t42_calic_roundtrip", "t55_mtf_roundtrip", "t59_cgplus_roundtrip", "t67_wgrad3_roundtrip", "t86_ols_roundtrip", "t97_squeeze_roundtrip", "t28_grfilt", "t81_custom4", "t106_fdct8", "codec_c10_l1_magnitude", "codec_c27_rice_size", "k07_streams", "c20_block_sizes", "c21_ols_or_wp", "c22_wp_or_l1", "c23_blend_choices", "t24_mixnc_roundtrip", "t29_l1crct_roundtrip", "t61_pu_roundtrip", "t71_wgrad5_roundtrip", "t94_zipper_roundtrip", "t100_awav_roundtrip", "s10_k04_png", "t18_pca"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
