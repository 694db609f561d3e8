"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from echolake.llm import op1_ngram_jaccard as ngrams
from echolake.llm import op5_line_dedup as lines
from echolake.llm import op9_embedding_dedup as vectors
from echolake.llm import op11_fill_in_middle as middles
from echolake.llm import op12_prefix_trie as tries
from echolake.llm.op1_ngram_jaccard import op1_ngram_jaccard
from echolake.llm.op2_secret_scan import op2_secret_scan
from echolake.llm.op3_packing import op3_packing
from echolake.llm.op4_url_filter import op4_url_filter
from echolake.llm.op5_line_dedup import op5_line_dedup
from echolake.llm.op6_sharding import op6_sharding
from echolake.llm.op7_mixing import op7_mixing
from echolake.llm.op8_language_id import op8_language_id
from echolake.llm.op9_embedding_dedup import op9_embedding_dedup
from echolake.llm.op10_media_columns import op10_media_columns
from echolake.llm.op11_fill_in_middle import op11_fill_in_middle
from echolake.llm.op12_prefix_trie import op12_prefix_trie
from echolake.llm.op13_toxicity import op13_toxicity

_ALL = (
    op1_ngram_jaccard,
    op2_secret_scan,
    op3_packing,
    op4_url_filter,
    op5_line_dedup,
    op6_sharding,
    op7_mixing,
    op8_language_id,
    op9_embedding_dedup,
    op10_media_columns,
    op11_fill_in_middle,
    op12_prefix_trie,
    op13_toxicity,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": ngrams.ORACLE_SQL, "op5_line_dedup": lines.ORACLE_SQL, "op9_embedding_dedup": vectors.ORACLE_SQL, "op11_fill_in_middle": middles.ORACLE_SQL, "op12_prefix_trie": tries.ORACLE_SQL}
