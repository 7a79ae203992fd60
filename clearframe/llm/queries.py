"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import covertree, html_extract, language, licenses, mixing, neardup, nndescent, packing, pii, quality


def queries() -> dict:
    return {
        "op1_cover_tree": covertree.query,
        "op2_pii": pii.query,
        "op3_near_dedup": neardup.query,
        "op4_licenses": licenses.query,
        "op5_nn_descent": nndescent.query,
        "op6_language_id": language.query,
        "language_id_pages": language.pages_query,
        "op7_html_text": html_extract.query,
        "op8_quality": quality.query,
        "op9_packing": packing.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": covertree.ORACLE, "op3_near_dedup": neardup.ORACLE}
