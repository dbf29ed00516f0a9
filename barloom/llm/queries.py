"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.brown import op5_brown_class_bigrams
from barloom.llm.byte_bpe import op11_tiktoken_byte_bpe
from barloom.llm.chat import op8_role_machine_chat
from barloom.llm.cotraining import op1_cotraining_quality
from barloom.llm.embedding_dedup import op9_hyperplane_embedding_dedup
from barloom.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from barloom.llm.jpeg import op3_baseline_jpeg
from barloom.llm.language_id import op10_subword_language_id
from barloom.llm.minhash import op7_hyperminhash_dedup
from barloom.llm.packing import op4_best_fit_packing
from barloom.llm.speculative_bpe import op6_speculative_bpe
from barloom.llm.tandem import op12_suffix_tree_runs
from barloom.llm.token_store import op2_zstd_token_store


QUERIES = (
    op1_cotraining_quality, op2_zstd_token_store, op3_baseline_jpeg, op4_best_fit_packing, op5_brown_class_bigrams, op6_speculative_bpe, op7_hyperminhash_dedup, op8_role_machine_chat,
    op9_hyperplane_embedding_dedup, op10_subword_language_id, op11_tiktoken_byte_bpe, op12_suffix_tree_runs, op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op13_fill_in_middle": OP13_SQL}
