"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, common, html, jaccard, langid, lm, mixing, neardup, quality, urls, warc


def queries():
    def shipped(f):
        def run(spark, sf_dir):
            common.ship(spark)
            return f(spark, sf_dir)

        return run

    found = {f.__name__: shipped(f) for f in OPERATORS}
    found["pipeline"] = shipped(corpus_pipeline.run)
    return found


def oracle_sql():
    return {"op5_warc_revisits": warc.ORACLE, "op6_mix_sources": mixing.ORACLE}


OPERATORS = [langid.op1_language_id, html.op2_html_text, jaccard.op3_ngram_jaccard, bpe.op4_bpe, warc.op5_warc_revisits, mixing.op6_mix_sources, quality.op7_quality_rules, urls.op8_url_rules, neardup.op9_embedding_neardup, lm.op10_lm_score]
