"""Queries and SQL of this subpackage."""

from __future__ import annotations

from .ann import op1_ann
from .gif import op8_gif
from .html_text import op7_html
from .mixing import OP3_SQL, op3_mixing
from .periodic import op12_periodic_runs
from .pieces import op2_sentencepiece
from .pii import op9_pii
from .sharding import op4_sharding
from .simhash import op5_simhash
from .token_files import op10_token_files
from .toxicity import op6_toxicity
from .vector_dups import op11_vector_dups


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ann": op1_ann,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_html": op7_html,
    "op8_gif": op8_gif,
    "op9_pii": op9_pii,
    "op10_token_files": op10_token_files,
    "op11_vector_dups": op11_vector_dups,
    "op12_periodic_runs": op12_periodic_runs,
    "pipeline": pipeline,
}

ORACLE_SQL = {"op3_mixing": OP3_SQL}
