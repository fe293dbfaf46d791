"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, decontam, html, langid, phrases, pii, projections, quality, secrets, simhash, urls, warc


def queries():
    import corpus_pipeline

    return {
        "op1_quality": quality.op1_quality,
        "op2_secrets": secrets.op2_secrets,
        "op3_urls": urls.op3_urls,
        "op4_html": html.op4_html,
        "op5_warc": warc.op5_warc,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_bpe": bpe.op7_bpe,
        "op8_simhash": simhash.op8_simhash,
        "op9_langid": langid.op9_langid,
        "op10_pii": pii.op10_pii,
        "op11_sort_means": centroids.op11_sort_means,
        "op12_phrases": phrases.op12_phrases,
        "op13_neighbours": projections.op13_neighbours,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op6_decontaminate": decontam.ORACLE, "op11_sort_means": centroids.ORACLE, "op12_phrases": phrases.ORACLE}
