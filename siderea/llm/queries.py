"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from siderea.llm.cube_mixing import op1_cube_mixing
from siderea.llm.hilbert_ann import op3_hilbert_ann
from siderea.llm.langid import op4_bayes_langid
from siderea.llm.line_dedup import op9_line_dedup
from siderea.llm.lsa_leaks import op10_lsa_leaks
from siderea.llm.nbsvm import op7_nbsvm
from siderea.llm.oracle import ORACLE
from siderea.llm.recompression import op8_recompression
from siderea.llm.simhash import op6_simhash
from siderea.llm.suffix_dedup import op2_suffix_dedup
from siderea.llm.warc import op5_warc_writer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mixing": op1_cube_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_hilbert_ann": op3_hilbert_ann,
    "op4_bayes_langid": op4_bayes_langid,
    "op5_warc_writer": op5_warc_writer,
    "op6_simhash": op6_simhash,
    "op7_nbsvm": op7_nbsvm,
    "op8_recompression": op8_recompression,
    "op9_line_dedup": op9_line_dedup,
    "op10_lsa_leaks": op10_lsa_leaks,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["ORACLE", "QUERIES"]
