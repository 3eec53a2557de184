"""The registered queries of this package and their SQL."""

from __future__ import annotations

from barloom.llm.decontaminate import op6_benchmark_windows
from barloom.llm.fingerprints import op3_weighted_fingerprints
from barloom.llm.htmltext import op5_tree_text
from barloom.llm.langid import op1_subword_language
from barloom.llm.linequality import OP11_SQL, op11_line_frequency
from barloom.llm.lmscore import op4_maxent_scores
from barloom.llm.mixing import op10_block_mix
from barloom.llm.ngramjoin import op9_ngram_links
from barloom.llm.prefixtrie import OP12_SQL, op12_centroid_trie
from barloom.llm.sharding import op8_sampled_shards
from barloom.llm.tokencounts import OP2_SQL, op2_token_rollup
from barloom.llm.toxicity import op7_recurrent_toxicity
from barloom.llm.turnrepair import OP13_SQL, op13_hirschberg_repair

QUERIES = {
    "op1_subword_language": op1_subword_language,
    "op2_token_rollup": op2_token_rollup,
    "op3_weighted_fingerprints": op3_weighted_fingerprints,
    "op4_maxent_scores": op4_maxent_scores,
    "op5_tree_text": op5_tree_text,
    "op6_benchmark_windows": op6_benchmark_windows,
    "op7_recurrent_toxicity": op7_recurrent_toxicity,
    "op8_sampled_shards": op8_sampled_shards,
    "op9_ngram_links": op9_ngram_links,
    "op10_block_mix": op10_block_mix,
    "op11_line_frequency": op11_line_frequency,
    "op12_centroid_trie": op12_centroid_trie,
    "op13_hirschberg_repair": op13_hirschberg_repair,
}

ORACLE = {"op2_token_rollup": OP2_SQL, "op11_line_frequency": OP11_SQL, "op12_centroid_trie": OP12_SQL, "op13_hirschberg_repair": OP13_SQL}
